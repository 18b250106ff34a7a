"""Header harmonisation: which incoming column stands for which attribute.

These functions look at column *names* (driver metadata).  Only :func:`find_key_column`
may look at data, and then at five values of a column.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill import config
from gristmill.functions.frames import cell_text, quoted, string_columns
from gristmill.functions.similarity import closest
from gristmill.functions.text import is_blank, strip

HEADER_SCORE = 80
DETECT_SCORE = 70
ALIAS_SCORE = 60
TEXT_COLUMN_SCORE = 70


def _touches(left: str, right: str) -> bool:
    return left in right or right in left


def map_headers(
    columns: Iterable[str],
    headers: Mapping[str, str] = config.CATALOGUE_HEADERS,
    min_score: float = HEADER_SCORE,
) -> dict[str, str]:
    """Known header first, otherwise the closest one scoring above ``min_score``."""
    mapping = {}
    for column in columns:
        header, score = (column, 100.0) if column in headers else closest(column, headers)
        if column in headers or score > min_score:
            mapping[column] = headers[header]
    return mapping


def detect_columns(
    columns: Iterable[str],
    targets: Sequence[str] = config.CATALOGUE_COLUMNS,
    min_score: float = DETECT_SCORE,
) -> dict[str, str]:
    """A target name that contains, or is contained in, the column name; else the closest."""
    mapping = {}
    for column in columns:
        lowered = column.lower()
        inside = [target for target in targets if _touches(lowered, target.lower())]
        if inside:
            mapping[column] = inside[0]
            continue
        target, score = closest(column, targets)
        if score > min_score:
            mapping[column] = target
    return mapping


def map_by_alias(
    columns: Sequence[str],
    aliases: Mapping[str, Sequence[str]] = config.HEADER_ALIASES,
    min_score: float = ALIAS_SCORE,
) -> dict[str, str]:
    """For each target: its own name, then a touching alias, then the closest column."""
    mapping: dict[str, str] = {}
    if not columns:
        return mapping
    for target, names in aliases.items():
        same = [c for c in columns if c.lower() == target.lower()]
        touching = [c for c in columns if any(_touches(c.lower(), name) for name in names)]
        if same or touching:
            mapping[(same or touching)[0]] = target
            continue
        column, score = closest(target, columns)
        if score > min_score:
            mapping[column] = target
    return mapping


def merged_map(columns: Sequence[str]) -> dict[str, str]:
    """Detected columns, overruled by the header map."""
    return {**detect_columns(columns), **map_headers(columns)}


def missing_essentials(
    mapping: Mapping[str, str], essential: Sequence[str] = config.ESSENTIAL_COLUMNS
) -> list[str]:
    return [name for name in essential if name not in mapping.values()]


def essentials_report(
    df: DataFrame, mapping: Mapping[str, str], essential: Sequence[str] = config.ESSENTIAL_COLUMNS
) -> DataFrame:
    """One row for each essential column: which column stands for it, and how many of its cells are filled.

    ``source`` is null and ``filled`` 0 where no column of the table is mapped to it.
    """
    sources = {name: column_for(mapping, name, last=True) for name in essential}
    sources = {name: source if source in df.columns else None for name, source in sources.items()}
    counts = df.agg(F.count(F.lit(1)).alias("total_rows"), *[
        F.count_if(~is_blank(cell_text(df, source)) if source else F.lit(False)).alias(f"n{i}")
        for i, source in enumerate(sources.values())])
    entries = [F.struct(F.lit(name).alias("column"), F.lit(source).cast("string").alias("source"),
                        F.lit(source is not None).alias("mapped"), F.col(f"n{i}").alias("filled"))
               for i, (name, source) in enumerate(sources.items())]
    return counts.select(F.inline(F.array(*entries)), "total_rows")


def column_for(mapping: Mapping[str, str], target: str, last: bool = False) -> str | None:
    """The incoming column mapped to ``target`` (the first one unless ``last``)."""
    hits = [column for column, mapped in mapping.items() if mapped == target]
    return (hits[-1] if last else hits[0]) if hits else None


def column_by_words(columns: Iterable[str], words: Sequence[str]) -> str | None:
    return next((c for c in columns if any(word in c.lower() for word in words)), None)


def find_key_column(df: DataFrame, mapping: Mapping[str, str]) -> str | None:
    """The name column: mapped, named like one, or the first one holding text."""
    mapped = column_for(mapping, "variety_release_name")
    if mapped in df.columns:
        return mapped
    named = column_by_words(df.columns, config.NAME_COLUMN_WORDS)
    if named:
        return named
    texts = string_columns(df)
    # The first values of every column, in one job; no more rows than columns come back.
    heads = [
        df.where(quoted(c).isNotNull()).select(F.lit(at).alias("at"), is_blank(quoted(c)).alias("blank")).limit(5)
        for at, c in enumerate(texts)]
    if heads:
        full = reduce(DataFrame.unionByName, heads).groupBy("at").agg(F.bool_or("blank").alias("blank"))
        given = [row["at"] for row in full.where(~F.col("blank")).collect()]
        if given:
            return texts[min(given)]
    return df.columns[0] if df.columns else None


def find_text_column(
    columns: Sequence[str], mapping: Mapping[str, str] | None = None, wanted: str | None = None
) -> str:
    """The free-text column to tag; raises when none can be told."""
    if not wanted:
        mapping = map_headers(columns) if mapping is None else mapping
        wanted = column_for(mapping, "special_attributes")
        wanted = wanted or column_by_words(columns, config.TEXT_COLUMN_WORDS)
    if not wanted:
        raise ValueError(f"no text column found among {list(columns)}")
    if wanted in columns:
        return wanted
    column, score = closest(wanted, columns)
    if score > TEXT_COLUMN_SCORE:
        return column
    raise ValueError(f"column {wanted!r} not found among {list(columns)}")


def combine_key_columns(
    columns: Sequence[str], mapping: Mapping[str, str]
) -> tuple[str | None, str | None]:
    """Crop and name column of a table that is to be combined with others."""
    crop = column_for(mapping, "crop", last=True)
    name = column_for(mapping, "variety_release_name", last=True)
    return (
        crop or column_by_words(columns, config.COMBINE_CROP_WORDS),
        name or column_by_words(columns, config.COMBINE_NAME_WORDS),
    )


def apply_mapping(
    df: DataFrame, mapping: Mapping[str, str], conflict: str = "coalesce"
) -> DataFrame:
    """Project to the mapped targets.

    When several columns carry one target, ``conflict`` picks ``"first"``, ``"last"`` or
    the first non-null (``"coalesce"``).
    """
    sources: dict[str, list[str]] = {}
    for column, target in mapping.items():
        if column in df.columns:
            sources.setdefault(target, []).append(column)

    def merged(columns: list[str]) -> Column:
        if conflict == "first":
            return quoted(columns[0])
        if conflict == "last":
            return quoted(columns[-1])
        if conflict != "coalesce":
            raise ValueError(f"unknown conflict rule {conflict!r}")
        return quoted(columns[0]) if len(columns) == 1 else F.coalesce(*map(quoted, columns))

    return df.select(*[merged(columns).alias(target) for target, columns in sources.items()])


def extract_name(df: DataFrame, key_column: str | None, mapping: Mapping[str, str]) -> Column:
    """The row's name: key column, then a mapped name, then any value that reads like one."""
    def filled(column: str) -> Column:
        text = strip(cell_text(df, column))
        return F.when(text != "", text)

    candidates = [filled(key_column)] if key_column in df.columns else []
    candidates += [
        filled(column) for column, target in mapping.items()
        if target in config.NAME_FALLBACK_TARGETS and column in df.columns
    ]
    for column in df.columns:
        text = filled(column)
        wordy = ~F.translate(text, "., ", "").rlike(r"^\p{Nd}+\z")
        candidates.append(F.when((F.length(text) > 2) & (F.length(text) < 100) & wordy, text))
    return F.coalesce(*candidates)
