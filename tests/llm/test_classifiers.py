import zlib

import pytest

from gristmill.llm import quality, queries, toxicity


def auc(scored):
    """Share of pairs of unlike rows in the right order."""
    up, down = [s for s, y in scored if y], [s for s, y in scored if not y]
    return sum((a > b) + 0.5 * (a == b) for a in up for b in down) / (len(up) * len(down))


@pytest.mark.parametrize("name, label, fold, threshold", [
    ("op8_toxicity", "toxic", lambda c: c % 4 == 2, 0.3), ("op10_quality", "quality", lambda c: c % 3 == 1, 0.5)])
def test_query(spark, name, label, fold, threshold):
    folder = "/root/testdata/sf0.1"
    rows = queries.REGISTRY[name](spark, folder).collect()
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == fold(zlib.crc32(str(r["doc_id"]).encode()))
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert auc(held) > 0.97
    hits = sum((s >= threshold) == bool(y) for s, y in held)
    assert hits / len(held) > 0.95


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_odd_inputs(spark, odd_docs, odd_rows, no_docs, module, label):
    made = [(i, (i or 0) % 2) for i, _ in odd_rows] + [(4, None), (None, 1), (10**9, 1)]
    labels = spark.createDataFrame(made, f"doc_id long, {label} int")
    rows = module.report(odd_docs, labels).collect()
    assert sorted(r["doc_id"] or -1 for r in rows) == sorted(i or -1 for i, _ in odd_rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    by_text = {}
    texts = dict(odd_rows)
    for r in rows:
        if r["doc_id"] is not None:
            by_text.setdefault(texts[r["doc_id"]] or "", set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())  # a score comes from the text alone
    assert module.report(no_docs, labels).collect() == []
    unknown = module.report(odd_docs, labels.limit(0)).collect()
    assert {r["score"] for r in unknown} == ({0.5} if module is toxicity else {1.0})


def test_keep_clean_keeps_columns(spark, odd_docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    kept = toxicity.keep_clean(odd_docs, labels)
    assert kept.columns == odd_docs.columns


def test_paths():
    tree = "\n".join([
        "DecisionTreeClassificationModel: depth=2", "  If (feature 3 <= 0.5)", "   If (feature 1 > 2.0)",
        "    Predict: 0.0", "   Else (feature 1 <= 2.0)", "    Predict: 1.0", "  Else (feature 3 > 0.5)", "   Predict: 1.0"])
    assert quality.paths(tree) == [
        ((3, True, 0.5),), ((1, False, 2.0), (3, True, 0.5)), ((1, True, 2.0), (3, True, 0.5)), ((3, False, 0.5),)]
