"""Helpers of the operators: written intermediate tables, ranks without hot tasks, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


#: Temporary folders of local sessions that name none.
_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    A local session without the setting gets a temporary folder; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    name = spark.sparkContext.applicationId
    if name not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[name] = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    return _LOCAL_FOLDERS[name]


#: Spark's setting that removes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_WRITTEN: list[list[str]] = []


@contextmanager
def written() -> Iterator[list[str]]:
    """Collects the folders of the tables that are saved meanwhile."""
    folders: list[str] = []
    _WRITTEN.append(folders)
    try:
        yield folders
    finally:
        _WRITTEN[:] = [w for w in _WRITTEN if w is not folders]  # lists may be equal


def remove_unread(folders: list[str], keep: DataFrame) -> None:
    """Remove saved tables, but for those that ``keep`` reads, and take them off the list."""
    spark = session_of(keep)
    read = keep.inputFiles() if folders else []
    for folder in list(folders):
        if not any(f"/{folder.rsplit('/', 1)[1]}/" in file for file in read):
            where = spark._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            for names in [folders, *(w for w in _WRITTEN if w is not folders)]:
                if folder in names:
                    names.remove(folder)


def saved(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: a short lineage that outlives executors.

    What the table needed from shuffles is then of no use, so their files go at once.
    """
    spark = session_of(df)
    path = f"{shared_folder(spark)}/gristmill/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    for folders in _WRITTEN:
        folders.append(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns that an operator reads, whatever else the table holds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def spread_rank(df: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """``name``: the row's place, from 0 and gapless, among the rows with its ``key``.

    The rows of one key are dealt into buckets by a hash of the order columns; a bucket is
    numbered by itself, and the buckets' counts give where each begins.  So a key that holds a
    third of all rows is no single task.  Rows that agree in every order column are
    interchangeable.  ``df`` is read twice: it should be a written table.
    """
    buckets = max(8, partitions(session_of(df)))
    from pyspark.sql import Window as W

    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(key, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    first = sizes.select(
        F.col(key).alias("__key"), F.col("__bucket").alias("__b"),
        (F.sum("__n").over(W.partitionBy(key).orderBy("__bucket")) - F.col("__n")).alias("__first"),
    )
    own = F.row_number().over(W.partitionBy(key, "__bucket").orderBy(*order)) - 1
    numbered = dealt.withColumn("__own", own)
    on = (F.col(key) == F.col("__key")) & (F.col("__bucket") == F.col("__b"))
    return (
        numbered.join(first, on)
        .withColumn(name, (F.col("__own") + F.col("__first")).cast("long"))
        .drop("__bucket", "__own", "__key", "__b", "__first")
    )


def _unsettled(edges: DataFrame) -> bool:
    """Whether some node has two smaller neighbours, or one that has a smaller one itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("top")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    found = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("top").alias("top"))
    return bool(found.where("below > 1 or (below > 0 and top > 0)").head(1))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of the edges ``(u, v)``; the component is its smallest node.

    Alternating large-star and small-star steps (Kiveris et al. 2014): every step is an
    aggregation and a join, edges never grow beyond their first number, and each round is
    written to the shared folder.  They end when every node's only edge leads to its component.
    """
    edges = saved(edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while _unsettled(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(small.union(lower.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def crc_modulus(doc_id: Column, modulus: int) -> Column:
    """crc32 of the identifier as text, modulo; a missing identifier counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)
