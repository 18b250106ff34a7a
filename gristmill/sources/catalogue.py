"""The master catalogue and the log of runs."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.frames import any_of, cell, quoted
from gristmill.operators.headers import apply_mapping, column_for, missing_essentials
from gristmill.operators.traits import extract_traits

DEFAULT_SCORE = 4.5
RUN_LOG_SCHEMA = (
    "filename string, file_type string, record_count long, matching_accuracy double, "
    "processing_time double, uploaded_at timestamp"
)


def check_essentials(mapping: Mapping[str, str]) -> None:
    missing = missing_essentials(mapping)
    if missing:
        raise ValueError(f"no column is mapped to {', '.join(missing)}")


def _usable(df: DataFrame, mapping: Mapping[str, str]) -> Column:
    """Not an empty row, and a name or a crop is there."""
    def given(target: str) -> Column:
        column = column_for(mapping, target, last=True)
        if column not in df.columns:
            return F.lit(False)
        return F.coalesce(cell(df, column).cast("string") != "", F.lit(False))

    filled = any_of([cell(df, c).isNotNull() for c in df.columns])
    return filled & (given("variety_release_name") | given("crop"))


def catalogue_records(
    df: DataFrame,
    mapping: Mapping[str, str],
    with_traits: bool = False,
    loaded_at: datetime | None = None,
) -> DataFrame:
    """The rows that go into the catalogue, under its attribute names, all as text."""
    text_column = column_for(mapping, "special_attributes")
    kept = df.where(_usable(df, mapping))
    nulls_for_nan = kept.select(*[cell(kept, c).alias(c) for c in kept.columns])
    records = apply_mapping(nulls_for_nan, mapping, conflict="last")
    records = records.select(*[quoted(c).cast("string").alias(c) for c in records.columns])
    if with_traits and text_column in df.columns:
        records = extract_traits(records, "special_attributes")
    now = F.current_timestamp() if loaded_at is None else F.lit(loaded_at)
    return records.select(
        "*",
        F.lit(DEFAULT_SCORE).alias("data_quality_score"),
        F.lit(None).cast("timestamp").alias("last_verified"),
        now.alias("created_at"), now.alias("updated_at"),
    )


def load_stats(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Imported and skipped rows, in one pass."""
    usable = _usable(df, mapping)
    return df.agg(
        F.count_if(usable).alias("records_imported"),
        F.count_if(~usable).alias("records_skipped"),
    )


CURRENT = "CURRENT"


def _hadoop(spark: SparkSession, path: str):
    """Spark's own file system for a path, and the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _point_to(spark: SparkSession, path: str, version: str) -> None:
    """Name the version that readers take: a new pointer file takes the old one's place in one step."""
    fresh = f"{path}/.{CURRENT}-{version}"
    files, where = _hadoop(spark, fresh)
    out = files.create(where, True)
    try:
        out.write(version.encode())
    finally:
        out.close()
    jvm = spark._jvm
    renames = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    renames[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        files.makeQualified(where).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(where), files.makeQualified(_hadoop(spark, f"{path}/{CURRENT}")[1]), renames)


def current_version(spark: SparkSession, path: str) -> str | None:
    """The name of the stored version; none before the first load."""
    files, where = _hadoop(spark, f"{path}/{CURRENT}")
    return spark.read.text(f"{path}/{CURRENT}").first()[0] if files.exists(where) else None


def replace_catalogue(
    df: DataFrame, mapping: Mapping[str, str], path: str, **options
) -> str:
    """Replace the stored catalogue by a new upload; the name of its version.

    The upload becomes a version folder of its own.  Only once that is whole does the pointer move
    to it, so a job that fails leaves the old catalogue as it was, and readers never see half of
    one.  The version before it stays for those who still read it; older ones go.
    """
    check_essentials(mapping)
    spark = df.sparkSession
    old = current_version(spark, path)
    version = f"v{datetime.now():%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    catalogue_records(df, mapping, **options).write.parquet(f"{path}/{version}")
    _point_to(spark, path, version)
    files, where = _hadoop(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(where) if f.isDirectory()]
    for name in names:
        if old is not None and name < old:
            files.delete(_hadoop(spark, f"{path}/{name}")[1], True)
    return version


def read_catalogue(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The stored catalogue, or one of its versions."""
    version = version or current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no catalogue has been stored at {path}")
    return spark.read.parquet(f"{path}/{version}")


def log_run(
    spark: SparkSession, path: str, filename: str, file_type: str, record_count: int,
    matching_accuracy: float | None = None, processing_time: float | None = None,
    uploaded_at: datetime | None = None,
) -> None:
    """Append one line to the run log; readers see it once its file is whole, or not at all."""
    entry = (filename, file_type, record_count, matching_accuracy, processing_time,
             uploaded_at or datetime.now())
    spark.createDataFrame([entry], RUN_LOG_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def recent_runs(log: DataFrame, limit: int = 5, file_type: str | None = None) -> DataFrame:
    """The latest runs; the file name settles equal times."""
    if file_type is not None:
        log = log.where(F.col("file_type") == file_type)
    return log.orderBy(F.col("uploaded_at").desc(), "filename").limit(limit)


def average_accuracy(log: DataFrame, runs: int = 10) -> DataFrame:
    """Mean accuracy of the latest runs, leaving out runs without one (null or zero)."""
    return recent_runs(log, runs).agg(
        F.round(F.avg(F.nullif(F.col("matching_accuracy"), F.lit(0.0))), 4)
        .alias("average_accuracy")
    )
