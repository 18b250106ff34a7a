"""Search, filters, lookups, pages and suggestions over a catalogue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill import config
from gristmill.functions.frames import any_of, materialised, present, quoted
from gristmill.functions.text import contains_ci, is_blank


def _hits(df: DataFrame, columns: Sequence[str], query: str, wildcards: bool) -> Column:
    return any_of([contains_ci(quoted(c), query, wildcards) for c in present(df, columns)])


def field_filters(
    df: DataFrame, filters: Mapping[str, str] | None, wildcards: bool = False
) -> DataFrame:
    """Rows that contain every given value in its column; empty values do not filter."""
    for column, value in (filters or {}).items():
        if value:
            df = df.where(contains_ci(quoted(column), value, wildcards))
    return df


def cascading_search(
    df: DataFrame,
    query: str,
    filters: Mapping[str, str] | None = None,
    levels: Sequence[Sequence[str]] = config.CASCADE_LEVELS,
    wildcards: bool = False,
) -> DataFrame:
    """Search the most telling column first and fall back only when it has no hit at all.

    One aggregation finds the first level with a hit; its single value comes back as a
    scalar subquery, and the second scan filters by that level.
    """
    if not query:
        return field_filters(df, filters, wildcards)
    tests = [_hits(df, level, query, wildcards) for level in levels]
    first = F.lit(None).cast("int")
    for number in reversed(range(len(tests))):
        first = F.when(tests[number], number).otherwise(first)
    level = df.agg(F.min(first)).scalar()
    chosen = any_of([(level == number) & test for number, test in enumerate(tests)])
    return field_filters(df.where(chosen), filters, wildcards)


def global_search(
    df: DataFrame,
    query: str,
    filters: Mapping[str, str] | None = None,
    columns: Sequence[str] = config.GLOBAL_SEARCH_COLUMNS,
    wildcards: bool = False,
) -> DataFrame:
    """Rows that contain the query in any of the columns."""
    if query:
        df = df.where(_hits(df, columns, query, wildcards))
    return field_filters(df, filters, wildcards)


def search(
    df: DataFrame, query: str, filters: Mapping[str, str] | None = None,
    mode: str = "cascading", **options,
) -> DataFrame:
    method = cascading_search if mode == "cascading" else global_search
    return method(df, query, filters, **options)


def lookup_search(
    df: DataFrame, query: str, columns: Sequence[str] = config.LOOKUP_COLUMNS
) -> DataFrame:
    return df.where(_hits(df, columns, query, False)) if query else df


def by_id(
    df: DataFrame, value: object, key: str = "id", columns: Sequence[str] = config.RECORD_COLUMNS
) -> DataFrame:
    """One record, projected; the equality reaches the file scan."""
    return df.where(quoted(key) == value).select(*[quoted(c) for c in present(df, columns)])


def page(
    df: DataFrame, order: Sequence[str | Column], number: int = 1, size: int = 50
) -> DataFrame:
    """One page of rows with the total row and page counts.

    An explicit order makes pages repeatable.  Spark keeps ``number * size`` rows while
    it selects them; far into a table :func:`search_after` and :func:`page_of_index` read less.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)
    return rows.select(
        "*",
        total.alias("total"),
        F.ceil(total / F.lit(size)).cast("long").alias("pages"),
        F.lit(number).alias("current_page"),
    )


def search_after(
    df: DataFrame, order: Sequence[str], after: Sequence[object] | None = None, size: int = 50
) -> DataFrame:
    """The ``size`` rows that follow the key ``after``, or the first ones.

    ``order`` names columns that tell rows apart and hold no nulls.  The key reaches the file scan
    as a range, so a page far into the table costs as much as the first one; tasks hand on ``size``
    rows each.
    """
    if after is not None:
        df = df.where(_behind(order, after, False))
    return df.orderBy(*order).limit(size)


def _behind(order: Sequence[str], key: Sequence[object], included: bool) -> Column:
    """Rows behind a key, or at it.  The first column by itself is a range that files are pruned by."""
    columns = [quoted(c) for c in order]
    last = len(columns) - 1

    def step(i: int) -> Column:
        return columns[i] >= key[i] if included and i == last else columns[i] > key[i]

    behind = any_of([reduce(lambda a, b: a & b, [columns[j] == key[j] for j in range(i)] + [step(i)])
                     for i in range(len(columns))]) if last else step(0)
    return (columns[0] >= key[0]) & behind if last else behind


def _before(order: Sequence[str], key: Sequence[object]) -> Column:
    columns = [quoted(c) for c in order]
    before = [reduce(lambda a, b: a & b, [columns[j] == key[j] for j in range(i)] + [columns[i] < key[i]])
              for i in range(len(columns))]
    return (columns[0] <= key[0]) & any_of(before) if len(columns) > 1 else before[0]


def page_index(df: DataFrame, order: Sequence[str], size: int = 50) -> DataFrame:
    """``page``, the first key of each page in the columns of ``order``, and ``rows``: one row a page.

    To be written beside a table (or a stored search) whose pages are asked for again.  Keys only
    are sorted, in ranges; a row's place follows from the counts of the ranges before its own.
    """
    keys = df.select(*[quoted(c) for c in order]).orderBy(*order)
    at = materialised(keys.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    parts = at.groupBy(part.alias("__part")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    # One row a task: few enough for one window.
    before = F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")
    shift = parts.select("__part", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(
        Window.partitionBy()).alias("__total"))
    placed = at.withColumn("__part", part).join(shift, "__part").withColumn("__place", F.col("__at") + F.col("__shift"))
    return placed.where(F.col("__place") % size == 0).select(
        (F.expr(f"__place DIV {size}") + 1).alias("page"), *[quoted(c) for c in order],
        F.least(F.lit(size), F.col("__total") - F.col("__place")).cast("long").alias("rows"))


def page_of_index(df: DataFrame, index: DataFrame, order: Sequence[str], number: int) -> DataFrame:
    """One page, read as one range of keys by a :func:`page_index`; empty where there is no such page."""
    edges = {r["page"]: r for r in index.where(F.col("page").isin(number, number + 1)).collect()}  # two rows at most
    if number not in edges:
        return df.limit(0)
    rows = df.where(_behind(order, [edges[number][c] for c in order], True))
    if number + 1 in edges:
        rows = rows.where(_before(order, [edges[number + 1][c] for c in order]))
    return rows.orderBy(*order).limit(edges[number]["rows"])


def page_info(df: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """Total, pages and the range of items that a page shows."""
    total = F.col("total")
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.ceil(total / F.lit(size)).cast("long").alias("pages"),
        F.lit(number).alias("current_page"),
        F.lit(size).alias("per_page"),
        F.lit((number - 1) * size + 1).cast("long").alias("start_item"),
        F.least(F.lit(number * size).cast("long"), total).alias("end_item"),
    )


def suggest(
    df: DataFrame, query: str, column: str,
    allowed: Sequence[str] = config.SUGGEST_COLUMNS, limit: int = 10,
) -> DataFrame:
    """Up to ``limit`` distinct values that contain the query (two letters at least)."""
    value = quoted(column) if column in df.columns else F.lit(None)
    if len(query) < 2 or column not in allowed:
        return df.select(value.cast("string").alias("suggestion")).where(F.lit(False))
    hits = df.where(contains_ci(value, query)).select(value.cast("string").alias("suggestion"))
    return hits.distinct().orderBy("suggestion").limit(limit).where(~is_blank("suggestion"))


def distinct_values(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Distinct non-null values for a filter list."""
    values = df.where(quoted(column).isNotNull()).select(quoted(column).alias("value")).distinct()
    return values.orderBy(F.col("value").desc()) if descending else values


def preview(df: DataFrame, order: Sequence[str | Column], rows: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(rows)
