"""Completeness, column profiles, distributions and the quality dashboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill import config
from gristmill.functions.frames import cell_text, long_form, percent, present, quoted, total
from gristmill.functions.text import is_blank

def cell_quality(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Filled, empty and all cells of a table, and the filled share.

    Null, NaN and white space all count as empty.
    """
    columns = list(df.columns if columns is None else columns)
    filled = total([(~is_blank(cell_text(df, c))).cast("long") for c in columns])
    counted = df.agg(
        F.coalesce(F.sum(filled), F.lit(0)).alias("filled_fields"),
        (F.count(F.lit(1)) * F.lit(len(columns))).alias("total_fields"),
    )
    return counted.select(
        percent(F.col("filled_fields"), F.col("total_fields")).alias("completion_rate"),
        "filled_fields", "total_fields",
        (F.col("total_fields") - F.col("filled_fields")).alias("empty_fields"),
    )


def _value_counts(df: DataFrame, columns: Sequence[str], order: str | None) -> DataFrame:
    ids = [] if order is None else [order]
    narrow = df if order is None else df.withColumn("__at", quoted(order))
    cells = long_form(narrow, columns, [] if order is None else ["__at"])
    first = [] if not ids else [F.min("__at").alias("first_at")]
    return cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), *first)


def _profile(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    filled = F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0))
    position = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (c, i)])
    return counts.groupBy("column").agg(
        F.count("value").alias("unique_values"),
        filled.alias("non_null"),
        F.sum("n").alias("total_rows"),
    ).select(
        "column", "unique_values", "non_null", "total_rows",
        percent(F.col("non_null"), F.col("total_rows")).alias("completeness"),
        F.element_at(position, F.col("column")).alias("position"),
    )


def _in_profile_order(profile: DataFrame) -> DataFrame:
    return profile.orderBy(F.col("completeness").desc(), "unique_values", "position")


def column_profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    order: str | None = None,
    samples: int = 3,
) -> DataFrame:
    """Distinct values, completeness and, given a row order, the first non-null values.

    Distinct values are counted exactly by grouping (column, value) with map-side
    combining, then per column; a frequent value is one row by the time it is shuffled.
    """
    columns = list(columns or df.columns)
    profile = _profile(_value_counts(df, columns, None), columns)
    if order is not None:
        ranked = Window.partitionBy("column").orderBy("__at")
        first = (
            long_form(df.withColumn("__at", quoted(order)), columns, ["__at"])
            .where(F.col("value").isNotNull())
            .withColumn("__rank", F.row_number().over(ranked))
            .where(F.col("__rank") <= samples)
            .groupBy("column")
            .agg(F.array_sort(F.collect_list(F.struct("__rank", "value"))).alias("taken"))
            .select("column", F.col("taken.value").alias("sample_values"))
        )
        profile = profile.join(first, "column", "left")
    return _in_profile_order(profile)


def approximate_profile(
    df: DataFrame, columns: Sequence[str] | None = None, error: float = 0.02
) -> DataFrame:
    """:func:`column_profile` with sketched distinct counts: one pass, no shuffle of values."""
    columns = list(columns or df.columns)
    measured = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count(cell_text(df, c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.approx_count_distinct(cell_text(df, c), error).alias(f"d{i}")
          for i, c in enumerate(columns)],
    )
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("unique_values"),
                 F.col(f"n{i}").alias("non_null"), F.lit(i).alias("position"))
        for i, c in enumerate(columns)
    ]
    rows = measured.select("total_rows", F.inline(F.array(*entries)))
    return _in_profile_order(rows.select(
        "column", "unique_values", "non_null", "total_rows",
        percent(F.col("non_null"), F.col("total_rows")).alias("completeness"), "position",
    ))


#: Registers of a stored sketch (2 to this power) and three standard errors of its count.
SKETCH_BITS, SKETCH_ERROR = 14, 3 * 1.04 / 2 ** (14 / 2)


def profile_sketches(df: DataFrame, load: str, columns: Sequence[str] | None = None) -> DataFrame:
    """What one load adds to a stored profile: for each column counts and a sketch of its values.

    One pass over the load, one row a column; append it to the sketches of earlier loads.
    """
    columns = list(columns or df.columns)
    measured = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count(cell_text(df, c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.hll_sketch_agg(cell_text(df, c), F.lit(SKETCH_BITS)).alias(f"s{i}") for i, c in enumerate(columns)],
    )
    entries = [
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.col(f"n{i}").alias("non_null"),
                 F.col(f"s{i}").alias("sketch"))
        for i, c in enumerate(columns)
    ]
    return measured.select(F.lit(load).alias("load"), "total_rows", F.inline(F.array(*entries)))


def stored_profile(sketches: DataFrame) -> DataFrame:
    """:func:`column_profile` of all loads together from their :func:`profile_sketches` alone.

    Distinct values are within SKETCH_ERROR of the exact count, 999 times in 1000; a load that was
    stored twice counts once.  Columns that a load lacks are empty in its rows.
    """
    once = sketches.dropDuplicates(["load", "column"])
    rows = once.groupBy("load").agg(F.max("total_rows").alias("rows")).agg(F.sum("rows")).scalar()
    merged = once.groupBy("column").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_values"),
        F.sum("non_null").alias("non_null"), F.min("position").alias("position"),
    ).withColumn("total_rows", rows)
    return _in_profile_order(merged.select(
        "column", "unique_values", "non_null", "total_rows",
        percent(F.col("non_null"), F.col("total_rows")).alias("completeness"), "position"))


def split_suggestions(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    order: str | None = None,
    fewest: int = 2, most: int = 50, samples: int = 5, limit: int = 10,
) -> DataFrame:
    """Columns with a handful of distinct values, best filled first."""
    columns = list(columns or df.columns)
    counts = _value_counts(df, columns, order)
    chosen = _profile(counts, columns).where(F.col("unique_values").between(fewest, most))
    if order is not None:
        ranked = Window.partitionBy("column").orderBy("first_at", "value")
        first = (
            counts.where(F.col("value").isNotNull())
            .withColumn("__rank", F.row_number().over(ranked))
            .where(F.col("__rank") <= samples)
            .groupBy("column")
            .agg(F.array_sort(F.collect_list(F.struct("__rank", "value"))).alias("taken"))
            .select("column", F.col("taken.value").alias("sample_values"))
        )
        chosen = chosen.join(first, "column", "left")
    return _in_profile_order(chosen).limit(limit)


# --- dashboard ------------------------------------------------------------------------


def field_grade(share: Column) -> Column:
    return F.when(share >= 90, "good").when(share >= 70, "mid").otherwise("low")


def health_grade(share: Column) -> Column:
    return (
        F.when(share >= 70, "Excellent").when(share >= 50, "Good")
        .when(share >= 30, "Fair").otherwise("Needs Work")
    )


def accuracy_grade(share: Column) -> Column:
    return F.when(share >= 90, "good").when(share >= 75, "mid").otherwise("low")


def field_completeness(
    df: DataFrame, fields: Sequence[str] = config.QUALITY_FIELDS
) -> DataFrame:
    """Per field: cells that are neither null, empty nor the default ``NO``, and their share.

    All fields are counted in one scan.
    """
    fields = present(df, fields)
    def informative(name: str) -> Column:
        value = cell_text(df, name)
        return value.isNotNull() & ~value.isin("", "NO")

    measured = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(informative(c)).alias(f"n{i}") for i, c in enumerate(fields)],
    )
    entries = [
        F.struct(F.lit(c).alias("field"), F.lit(i).alias("position"), F.col(f"n{i}").alias("count"))
        for i, c in enumerate(fields)
    ]
    share = percent(F.col("count"), F.col("rows"))
    return (
        measured.select("rows", F.inline(F.array(*entries)))
        .select("field", "position", "count", share.alias("percentage"))
        .withColumn("grade", field_grade(F.col("percentage")))
    )


def overall_quality(completeness: DataFrame) -> DataFrame:
    """Mean completeness with its verdict."""
    mean = F.coalesce(F.avg("percentage"), F.lit(0.0))
    level = F.when(F.col("mean") < 30, "critical").when(F.col("mean") < 60, "warning")
    message = (
        F.when(F.col("mean") < 30, config.VERDICTS["critical"])
        .when(F.col("mean") < 60, config.VERDICTS["warning"])
        .otherwise(config.VERDICTS["success"])
    )
    return completeness.agg(mean.alias("mean")).select(
        F.round("mean", 1).alias("avg_completeness"),
        level.otherwise("success").alias("level"),
        message.alias("message"),
        health_grade(F.round("mean", 1)).alias("health"),
    )


def lowest_fields(completeness: DataFrame, fields: int = 5, below: float = 50.0) -> DataFrame:
    """The least filled fields, as far as they are under ``below`` percent."""
    worst = completeness.orderBy("percentage", "position").limit(fields)
    return worst.where(F.col("percentage") < below)


def lowest_message(completeness: DataFrame, named: int = 3) -> DataFrame:
    """One line naming the least filled fields; no row when every field is fine."""
    entry = F.struct("percentage", "position", "field")
    worst = lowest_fields(completeness).agg(
        F.slice(F.array_sort(F.collect_list(entry)), 1, named).alias("worst")
    )
    names = F.array_join(F.col("worst.field"), ", ")
    return worst.where(F.size("worst") > 0).select(
        F.lit("info").alias("level"), F.concat(F.lit("Low completeness in: "), names).alias("message")
    )


def distribution(
    df: DataFrame, column: str, limit: int = 10, by: str = "count"
) -> DataFrame:
    """The most frequent (``by="count"``) or the latest (``by="value"``) values."""
    value = quoted(column).cast("string")
    counted = (
        df.where(value.isNotNull() & (value != ""))
        .groupBy(value.alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    order = [F.col("value").desc()] if by == "value" else [F.col("count").desc(), F.col("value")]
    return counted.orderBy(*order).limit(limit)


def with_relative_bar(shown: DataFrame) -> DataFrame:
    """Each count in percent of the largest one.  Meant for the few rows of a report."""
    largest = shown.agg(F.max("count")).scalar()
    return shown.withColumn("relative", percent(F.col("count"), largest))


def total_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))
