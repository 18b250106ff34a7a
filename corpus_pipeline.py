"""From raw documents to packed sequences: five stages, each written and read again.

Toxic documents go; of similar documents one stays; words of passages that repeat are cut out;
documents that hold a benchmark item go; what is left is tokenised and packed.  Every stage works
on all rows that the one before it kept, and all but the last return the columns of documents.

A stage's result is written before the next stage begins.  That one then removes the tables which
the stage before it needed on the way, so the shared folder holds those of one stage at a time.
Python gets at most ``BATCH_ROWS`` rows at once: whole texts lie there and in Spark several times over.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import decontaminate, jaccard, packing, toxicity, windows_dedup
from gristmill.llm.queries import END_ID, LIMIT, table, tokenizer_path
from gristmill.llm.shared import CLEANUP, remove_unread, saved, written

#: Sequential fitting, similarity of sets and packing have no SQL form.
ORACLE_SQL = None
WINDOW, BATCH_ROWS = 20, 1000
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders of the tables that the last stage needed on the way.
_NEEDED: list[str] = []


def stage(work: Stage) -> Stage:
    """A stage that removes what the one before it needed; shuffle files go when the result is written."""
    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_unread(_NEEDED, docs)
        spark.conf.set(CLEANUP, "true")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        with written() as folders:
            result = work(spark, docs, sf_dir)
        if run_stage is not STAGES[-1][1]:  # nothing tells when the last result has been read
            _NEEDED.extend(folders)
        return result

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


@stage
def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


@stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = windows_dedup.remove_repeats(docs, WINDOW)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(), LIMIT, END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_similar),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, work in STAGES[:-1]:
        docs = saved(work(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
