import hashlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from test_decontaminate import WORD
from test_jaccard import brute as similar
from test_packing import brute as pieces, check_gapless
from test_windows_dedup import brute as cut

FOLDER = "/root/testdata/sf0.01"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark):
    """Every stage against a brute-force version on its own input; decisions take effect."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 400")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "best-fit packing"]
    columns = docs.columns
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.saved(stage(spark, docs, FOLDER))
        assert docs.columns == columns and dict(docs.dtypes) == dict(before.dtypes)
        kept.append((pairs(before), pairs(docs)))
    (raw, clean), (_, apart), (_, trimmed), (_, last) = kept
    gone = {i for i, _ in raw} - {i for i, _ in clean}
    assert gone and np.mean([labels[i] for i in gone if i in labels]) > 0.7
    assert np.mean([i in gone for i, _ in raw if labels.get(i) == 0]) < 0.05
    assert sorted(i for i, _ in apart) == sorted({c for _, _, c in similar(clean)})
    digests = {i: (removed, digest) for i, _, removed, digest in cut(apart, 20)}
    for i, text in trimmed:
        assert not digests[i][0] or hashlib.sha256(text.encode()).hexdigest() == digests[i][1]
    words = lambda t: f" {' '.join(WORD.findall((t or '').lower()))} "
    items = [words(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaks = {i for i, t in trimmed if any(b in words(t) for b in items)}
    dropped = {i for i, _ in trimmed} - {i for i, _ in last}
    assert leaks <= dropped and len(dropped) <= len(leaks) + 3
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert sorted(tuple(r)[:5] for r in packed) == sorted(pieces(last, 4096))
    check_gapless(packed, 4096)
    assert docs.where(F.col("n_chars") != F.length("text")).count() == 0


def test_odd_inputs(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars", F.col("id").alias("extra"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.saved(stage(spark, docs, FOLDER))
            assert docs.columns[-1] == "extra"
        assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() >= docs.count()


def test_a_stage_removes_the_tables_of_the_one_before(spark, odd_docs):
    from pathlib import Path

    docs = odd_docs.select("doc_id", "text")
    apart = corpus_pipeline.saved(corpus_pipeline.drop_similar(spark, docs, FOLDER))
    needed = [Path(f.removeprefix("file://")) for f in corpus_pipeline._NEEDED]
    assert len(needed) > 3 and all(f.exists() for f in needed)
    lazy = corpus_pipeline.cut_repeats(spark, apart, FOLDER)
    assert not any(f.exists() for f in needed) and lazy.count() == apart.count()
    # What a table still reads stays.
    unwritten = corpus_pipeline.drop_similar(spark, docs, FOLDER)
    assert corpus_pipeline.cut_repeats(spark, unwritten, FOLDER).count() == unwritten.count() == apart.count()


def test_batches_of_few_rows(spark, odd_docs):
    """Each stage's Python gets few whole texts at once."""
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, odd_docs.select("doc_id", "text"), FOLDER)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
