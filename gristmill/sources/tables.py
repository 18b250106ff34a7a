"""Reading and writing tables, with where each row came from."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gristmill.functions.frames import lookup_join, quoted

FORMATS = {
    ".parquet": "parquet", ".orc": "orc", ".csv": "csv", ".tsv": "csv",
    ".json": "json", ".jsonl": "json", ".ndjson": "json",
}


def table_format(path: str) -> str:
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in FORMATS:
        raise ValueError(f"unsupported table file {path!r}")
    return FORMATS[suffix]


def is_supported(path: str) -> bool:
    return PurePosixPath(path).suffix.lower() in FORMATS


def read_table(
    spark: SparkSession, path: str, format: str | None = None,
    schema: StructType | str | None = None, **options: str,
) -> DataFrame:
    """One table.  Text formats are read with a header and, unless given, inferred types."""
    format = format or table_format(path)
    reader = spark.read.format(format)
    if format == "csv":
        reader = reader.option("header", "true")
        if schema is None:
            reader = reader.option("inferSchema", "true")
        if path.lower().endswith(".tsv"):
            reader = reader.option("sep", "\t")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**options).load(path)


def read_with_position(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """A table with each row's 0-based place in its file as ``row_position``.

    Parquet knows its rows' places.  Of other formats each part of a file that a task reads is
    counted first; a row's place is its place in its part and the rows of the parts before it.
    It does not depend on how files are cut into parts.  Blank lines and headers are no rows.
    """
    format = format or table_format(path)
    table = read_table(spark, path, format=format, **options)
    if format == "parquet":
        return table.select("*", F.col("_metadata.row_index").alias("row_position"))
    part = ["__file", "__start"]
    rows = table.select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__at"))
    counts = rows.groupBy(*part).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    in_file = Window.partitionBy("__file").orderBy("__start")
    # One row for each part of a file.
    shifts = counts.select(*part, (F.sum("__n").over(in_file) - F.col("__n") - F.col("__first")).alias("__shift"))
    placed = lookup_join(rows, shifts, part, "inner")
    return placed.select(*[quoted(c) for c in table.columns], (F.col("__at") + F.col("__shift")).alias("row_position"))


def read_folder(spark: SparkSession, path: str, format: str, **options) -> DataFrame:
    """Many files of one shape in one scan, each row with its file name."""
    table = read_table(spark, path, format=format, **options)
    return table.select("*", F.col("_metadata.file_name").alias("source_file"))


def write_table(
    df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite",
    files: int | None = None, **options: str,
) -> None:
    """Write a result.  ``files`` asks for a number of files; by default tasks decide."""
    out = df if files is None else df.coalesce(files)
    writer = out.write.format(format).mode(mode)
    if format == "csv":
        writer = writer.option("header", "true")
    writer.options(**options).save(path)
