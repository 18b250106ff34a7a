"""Splitting a table by the values of one column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.frames import cell, cell_text, lookup_join, percent, total
from gristmill.functions.text import safe_file_name, safe_sheet_name

UNKNOWN = "Unknown"


def group_value(df: DataFrame, column: str) -> Column:
    return F.coalesce(cell_text(df, column), F.lit(UNKNOWN))


def group_label(value: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(f"{prefix}_"), value) if prefix else value


def split_groups(df: DataFrame, column: str, min_records: int = 1) -> DataFrame:
    """Groups and their sizes, without those below ``min_records``."""
    sizes = df.groupBy(group_value(df, column).alias("group_value")).agg(
        F.count(F.lit(1)).alias("record_count")
    )
    return sizes.where(F.col("record_count") >= min_records)


def split_stats(df: DataFrame, column: str, min_records: int = 1) -> DataFrame:
    """How many groups are written, and how many rows the table has."""
    sizes = split_groups(df, column)
    return sizes.agg(
        F.count_if(F.col("record_count") >= min_records).alias("total_groups"),
        F.coalesce(F.sum("record_count"), F.lit(0)).alias("total_records"),
    )


def split_summary(
    df: DataFrame, column: str, prefix: str = "", min_records: int = 1
) -> DataFrame:
    """Per group: rows, cells, filled cells, completeness and fully filled columns."""
    columns = df.columns
    values = {
        c: group_value(df, column) if c == column else cell(df, c) for c in columns
    }
    counted = df.groupBy(group_value(df, column).alias("group_value")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(values[c]).alias(f"n{i}") for i, c in enumerate(columns)],
    ).where(F.col("rows") >= min_records)
    filled = total([F.col(f"n{i}") for i in range(len(columns))])
    full = total([(F.col(f"n{i}") == F.col("rows")).cast("int") for i in range(len(columns))])
    cells = F.col("rows") * F.lit(len(columns))
    return counted.select(
        group_label(F.col("group_value"), prefix).alias("group_name"),
        F.col("rows").alias("record_count"),
        cells.alias("total_cells"),
        filled.alias("filled_cells"),
        percent(filled, cells).alias("completeness"),
        full.alias("full_columns"),
        F.lit(column).alias("split_column"),
        F.lit(prefix or "None").alias("file_prefix"),
    )


def split_manifest(
    df: DataFrame, column: str, prefix: str = "", min_records: int = 1
) -> DataFrame:
    """Safe sheet and file name per group; groups that would share a file get a number."""
    label = group_label(F.col("group_value"), prefix)
    named = split_groups(df, column, min_records).select(
        "group_value", "record_count",
        safe_sheet_name(label).alias("sheet_name"),
        safe_file_name(label).alias("file_name"),
    )
    same_name = Window.partitionBy(F.lower("file_name")).orderBy("group_value")
    number = F.row_number().over(same_name)
    return named.withColumn("__number", number).select(
        "group_value", "record_count", "sheet_name",
        F.when(F.col("__number") == 1, F.col("file_name"))
        .otherwise(F.concat("file_name", F.lit("_"), F.col("__number").cast("string")))
        .alias("file_name"),
        (F.col("__number") > 1).alias("renamed"),
    )


def splittable(df: DataFrame, column: str, min_records: int = 1) -> DataFrame:
    """The rows of groups that are large enough, with their group in ``split_value``."""
    marked = df.withColumn("split_value", group_value(df, column))
    if min_records <= 1:
        return marked
    kept = split_groups(df, column, min_records).select(
        F.col("group_value").alias("split_value")
    )
    return lookup_join(marked, kept, ["split_value"], "left_semi")


def write_split(
    df: DataFrame,
    column: str,
    path: str,
    min_records: int = 1,
    format: str = "parquet",
    mode: str = "overwrite",
    rows_per_file: int = 5_000_000,
    options: dict[str, str] | None = None,
) -> None:
    """One directory per group.

    Rows are rebalanced by group: small groups share a task, and a group that holds a
    large part of the table is cut into several tasks and files.
    """
    rows = splittable(df, column, min_records).hint("rebalance", "split_value")
    writer = rows.write.mode(mode).format(format).options(**(options or {}))
    writer.option("maxRecordsPerFile", rows_per_file).partitionBy("split_value").save(path)


def write_split_with_summary(
    df: DataFrame, column: str, path: str, prefix: str = "", min_records: int = 1, **options
) -> None:
    """The groups under ``path/groups``, their summary and manifest beside them."""
    write_split(df, column, f"{path}/groups", min_records, **options)
    split_summary(df, column, prefix, min_records).write.mode("overwrite").parquet(f"{path}/summary")
    split_manifest(df, column, prefix, min_records).write.mode("overwrite").parquet(f"{path}/manifest")
