"""Facets: which values a column offers, how often, and filtering by a choice of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.frames import cell_text, long_form
from gristmill.functions.text import is_scored
from gristmill.operators.headers import map_headers


def _counted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every value of every column with its count; cells are counted on the map side first."""
    return (
        long_form(df, columns, name="column_name")
        .where(is_scored("value") & (F.col("value") != "NaN"))
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("record_count"))
    )


def _first(counted: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` values of each column; Spark ranks on the map side too."""
    if limit is None:
        return counted
    in_column = Window.partitionBy("column_name").orderBy("value")
    ranked = counted.withColumn("__rank", F.row_number().over(in_column))
    return ranked.where(F.col("__rank") <= limit).drop("__rank")


def facet_table(
    df: DataFrame, columns: Sequence[str] | None = None, limit: int | None = None
) -> DataFrame:
    """Every value of every column with its exact count, or the first ``limit`` in sort order."""
    return _first(_counted(df, list(columns or df.columns)), limit)


def facet_view(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    mapping: Mapping[str, str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Per column: friendly name, its facet values, how many it has, and the row total.

    ``limit`` shortens the list of values, not their number.
    """
    columns = list(columns or df.columns)
    mapping = map_headers(columns) if mapping is None else mapping
    friendly = F.create_map(*[F.lit(x) for c in columns for x in (c, mapping.get(c, c))])
    total = df.agg(F.count(F.lit(1))).scalar()
    counted = _counted(df, columns)
    number = counted.groupBy("column_name").agg(F.count(F.lit(1)).cast("int").alias("total_values"))
    listed = _first(counted, limit).groupBy("column_name").agg(
        F.array_sort(F.collect_list("value")).alias("facet_values"))
    return listed.join(number, "column_name").select(
        "column_name",
        F.element_at(friendly, F.col("column_name")).alias("friendly_name"),
        "facet_values", "total_values", total.alias("total_records"),
    )


def _choice(df: DataFrame, values: Sequence[object] | None) -> DataFrame | None:
    """The chosen values as a table of one row each; none when nothing is chosen."""
    chosen = sorted({str(v) for v in values or ()})
    if not chosen:
        return None
    return df.sparkSession.createDataFrame([(v,) for v in chosen], "__choice string")


def facet_filter(df: DataFrame, choices: Mapping[str, Sequence[object]]) -> DataFrame:
    """Rows whose cell, as text, is among the chosen values of every chosen column."""
    for column, values in choices.items():
        table = _choice(df, values)
        if table is not None:
            df = df.join(table, cell_text(df, column) == table["__choice"], "left_semi")
    return df


def facet_counts(df: DataFrame, choices: Mapping[str, Sequence[object]]) -> DataFrame:
    """Matching rows, all rows and the number of active filters."""
    everything = df.agg(F.count(F.lit(1))).scalar()
    return facet_filter(df, choices).agg(F.count(F.lit(1)).alias("total_matching")).select(
        "total_matching",
        everything.alias("total_original"),
        F.lit(sum(1 for v in choices.values() if v)).alias("filters_applied"),
    )
