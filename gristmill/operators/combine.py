"""Combining differently shaped tables, and keeping the most complete record per key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill import config
from gristmill.functions import text
from gristmill.functions.frames import cell, cell_text, percent, present, quoted, total
from gristmill.operators.cleaning import clean_text_columns
from gristmill.operators.headers import column_for, combine_key_columns, map_headers

PROVENANCE = ("source_file", "source_index")


@dataclass(frozen=True)
class Source:
    """A table to combine.  ``position`` is the row's 0-based place in its file."""

    name: str
    table: DataFrame
    mapping: Mapping[str, str] | None = None
    position: Column | None = None

    def resolved(self) -> dict[str, str]:
        return dict(map_headers(self.columns()) if self.mapping is None else self.mapping)

    def columns(self) -> list[str]:
        return self.table.columns

    def keys(self) -> tuple[str | None, str | None]:
        return combine_key_columns(self.columns(), self.resolved())

    def key_cells(self) -> tuple[Column, Column]:
        return tuple(
            F.lit(None).cast("string") if name is None else cell_text(self.table, name)
            for name in self.keys()
        )

    def row_number(self) -> Column:
        """The line of a file whose first line holds the headers."""
        at = F.lit(None) if self.position is None else self.position
        return (at + 2).cast("long")


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def combined_columns(sources: Sequence[Source]) -> list[str]:
    """The first table decides which attributes the combined table has."""
    return list(dict.fromkeys(sources[0].resolved().values()))


def combine(
    sources: Sequence[Source],
    clean_columns: Sequence[str] = config.COMBINE_TEXT_COLUMNS,
    keep_row_number: bool = False,
) -> DataFrame:
    """Rows that have both keys, under the first table's attributes, provenance last."""
    attributes = combined_columns(sources)

    def part(index: int, source: Source) -> DataFrame:
        table, mapping = source.table, source.resolved()
        crop, variety = source.key_cells()
        kept = table.where(~text.is_blank(crop) & ~text.is_blank(variety))
        cells = []
        for attribute in attributes:
            column = column_for(mapping, attribute, last=True)
            value = F.lit(None) if column is None else cell(table, column)
            cells.append(value.cast("string").alias(attribute))
        if keep_row_number:
            cells.append(source.row_number().alias("row_number"))
        return kept.select(
            *cells, F.lit(source.name).alias("source_file"), F.lit(index).alias("source_index")
        )

    parts = [part(index, source) for index, source in enumerate(sources, start=1)]
    return clean_text_columns(_union(parts), clean_columns)


def quarantine(sources: Sequence[Source]) -> DataFrame:
    """Rows lacking a key: where they stood, why they were left out, and the whole row."""
    def part(index: int, source: Source) -> DataFrame:
        table = source.table
        crop, variety = source.key_cells()
        row = F.struct(*[cell(table, c).alias(c) for c in table.columns])
        reason = text.skip_reason(crop, variety)
        return table.where(text.is_blank(crop) | text.is_blank(variety)).select(
            F.lit(source.name).alias("file_name"),
            F.lit(index).alias("file_index"),
            source.row_number().alias("row_number"),
            crop.alias("crop_value"),
            variety.alias("variety_value"),
            reason.alias("skip_reason"),
            F.to_json(row, {"ignoreNullFields": "false"}).alias("original_data"),
        )

    return _union([part(i, s) for i, s in enumerate(sources, start=1)])


def source_stats(sources: Sequence[Source]) -> DataFrame:
    """One row per table.  Each table is counted where it lies; nothing is shuffled but counts."""
    def part(index: int, source: Source) -> DataFrame:
        crop, variety = source.key_cells()
        crop_column, variety_column = source.keys()
        valid = ~text.is_blank(crop) & ~text.is_blank(variety)
        return source.table.agg(
            F.count(F.lit(1)).alias("record_count"), F.count_if(valid).alias("valid_records")
        ).select(
            F.lit(source.name).alias("filename"),
            F.lit(index).alias("source_index"),
            "record_count",
            F.lit(len(source.columns())).alias("columns_count"),
            F.lit(crop_column).cast("string").alias("crop_column"),
            F.lit(variety_column).cast("string").alias("variety_column"),
            "valid_records",
            (F.col("record_count") - F.col("valid_records")).alias("skipped_records"),
        )

    return _union([part(i, s) for i, s in enumerate(sources, start=1)])


def combine_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum("valid_records").alias("total_valid_records"),
        F.sum("skipped_records").alias("total_skipped_records"),
    )


def filled_cells(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    columns = df.columns if columns is None else columns
    return total([text.is_scored(cell_text(df, c)).cast("int") for c in columns])


def with_completeness(df: DataFrame, output: str = "completeness") -> DataFrame:
    """Share of a row's cells that hold something, in percent."""
    return df.withColumn(output, filled_cells(df) * 100.0 / F.lit(len(df.columns)))


def dedup_most_complete(
    df: DataFrame,
    keys: Sequence[str] = config.KEY_COLUMNS,
    order: Sequence[str | Column] = (),
    score_columns: Sequence[str] | None = None,
) -> DataFrame:
    """Keep the fullest row per key; ``order`` settles ties.  Null keys count as equal.

    The rank limit is applied before the shuffle as well, so a key with any number of
    copies sends at most one row per map task.
    """
    keys = present(df, keys)
    if not keys:
        return df
    ranked = Window.partitionBy(*[quoted(k) for k in keys]).orderBy(
        F.col("__filled").desc(), *order
    )
    return (
        df.withColumn("__filled", filled_cells(df, score_columns))
        .withColumn("__rank", F.row_number().over(ranked))
        .where(F.col("__rank") == 1)
        .drop("__filled", "__rank")
    )


def sort_result(df: DataFrame, keys: Sequence[str] = config.KEY_COLUMNS) -> DataFrame:
    keys = present(df, keys)
    return df.fillna("", subset=keys).orderBy(*[quoted(k) for k in keys]) if keys else df


def duplicate_stats(df: DataFrame, keys: Sequence[str] = config.KEY_COLUMNS) -> DataFrame:
    """Rows before and after deduplication, and by how much completeness really rose."""
    keys = present(df, keys)
    named = F.lit(bool(keys))
    for key in keys:
        named = named & quoted(key).isNotNull()
    width = float(len(df.columns))
    # Every row is its own group when no key column exists: nothing is removed.
    grouping = [quoted(k) for k in keys] or [F.monotonically_increasing_id().alias("__row")]
    groups = (
        df.withColumn("__filled", filled_cells(df))
        .groupBy(*grouping)
        .agg(F.count(F.lit(1)).alias("__n"), F.sum("__filled").alias("__sum"),
             F.max("__filled").alias("__max"))
        .withColumn("__named", named if keys else F.lit(False))
    )
    before, after = F.sum("__n"), F.count(F.lit(1))
    return groups.agg(
        F.coalesce(before, F.lit(0)).alias("original_count"),
        after.alias("cleaned_count"),
        F.coalesce(before - after, F.lit(0)).alias("duplicates_removed"),
        F.count_if(F.col("__named") & (F.col("__n") > 1)).alias("duplicate_groups"),
        F.round(
            percent(F.sum("__max"), after * width, None)
            - percent(F.sum("__sum"), before * width, None), 4,
        ).alias("completeness_improvement"),
    )


def parse_columns(listing: str) -> list[str]:
    """Column names from a comma-separated parameter."""
    return [name for name in (part.strip() for part in listing.split(",")) if name]
