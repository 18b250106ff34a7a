"""Small helpers shared by the operators: typed cells, long form, joins, percentages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def string_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind == "string" or kind.startswith(("varchar", "char"))]


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def cell(df: DataFrame, name: str) -> Column:
    """A cell with floating NaN read as null: an uploaded table has one kind of missing."""
    column = quoted(name)
    if dict(df.dtypes)[name] in ("double", "float"):
        return F.when(~F.isnan(column), column)
    return column


def cell_text(df: DataFrame, name: str) -> Column:
    return cell(df, name).cast("string")


def present(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    """The wanted columns that exist, in the order asked for."""
    known = set(df.columns)
    return [name for name in wanted if name in known]


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def total(counts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, counts, F.lit(0))


def percent(part: Column, whole: Column, digits: int | None = 1) -> Column:
    """``part`` in percent of ``whole``; 0 when there is nothing to divide by."""
    share = F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))
    return share if digits is None else F.round(share, digits)


def long_form(
    df: DataFrame, columns: Sequence[str], ids: Sequence[str] = (),
    name: str = "column", value: str = "value",
) -> DataFrame:
    """One row per cell, every value as text.  A map-side expansion, no shuffle."""
    texts = [cell_text(df, column).alias(column) for column in columns]
    wide = df.select(*[quoted(i) for i in ids], *texts)
    return wide.unpivot(list(ids), [quoted(c) for c in columns], name, value)


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join many rows against a side that holds each key at most once.

    The right side usually comes out of an aggregation and is already partitioned by the
    key.  Spark would then feed that aggregation straight into the join, and adaptive
    execution could not split a hot key on the left (it only splits joins of two plain
    shuffles).  Joining on a digest of the key as well makes both inputs plain shuffles:
    a key that holds a third of the left rows is spread over many tasks, and the right
    side stays small enough to broadcast whenever its measured size allows.

    ``how`` is inner, left, left_semi or left_anti.
    """
    digest = "__digest"
    on_key = F.xxhash64(*[quoted(k) for k in keys])
    # A row without a key matches nothing, so it may go anywhere: spread such rows by content.
    hashable = [quoted(name) for name, kind in left.dtypes if "map<" not in kind and kind != "variant"]
    no_key = any_of([quoted(k).isNull() for k in keys])
    spread = F.when(no_key, F.xxhash64(*hashable)).otherwise(on_key)
    left = left.withColumn(digest, on_key if how == "inner" else spread)
    right = right.withColumn(digest, on_key)
    return left.join(right, [digest, *keys], how).drop(digest)


#: Temporary folders of local sessions that name none.
_LOCAL_FOLDERS: dict[str, str] = {}


def _shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local session without it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    name = spark.sparkContext.applicationId
    if name not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[name] = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    return _LOCAL_FOLDERS[name]


def _own_folder(spark: SparkSession) -> str:
    return f"{_shared_folder(spark)}/gristmill/tables/{spark.sparkContext.applicationId}"


def materialised(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back: computed once, with a short lineage.

    For steps that need the result of the one before; it survives lost executors.  It stays until
    :func:`remove_materialised`, as results may still read it.
    """
    path = f"{_own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_materialised(spark: SparkSession) -> None:
    """Remove all tables that this application has materialised, once their results are written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
