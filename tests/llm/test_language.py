"""Language identification: subwords against plain slices, scores against plain sums, held-out accuracy."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from gristmill.llm import language, queries
from gristmill.llm import windows as win

TEXTS = ["", "a", "It's 3 o'clock!", "  two   blanks ", "Été à Ñandú", "日本語", "x" * 50, "12 + 34", "ends here ", "\n\n"]


def plain_subwords(text):
    raw = bytes(win.lower_ascii()[b] if b >= 128 or chr(b).isalpha() else 32 for b in text.encode())
    line = b" " + raw + b" "
    found = []
    for size in language.SIZES:
        for i in range(len(line) - size + 1):
            piece = line[i:i + size]
            if b" " not in piece[1:-1] and piece.strip():
                code = np.array([int.from_bytes(piece, "little")], dtype=np.uint64)
                found.append(int(win.mix(code, size)[0]) >> (64 - language.BITS))
    return sorted(found)


@pytest.mark.parametrize("slice_", [1 << 18, 7])
def test_subwords(monkeypatch, slice_):
    monkeypatch.setattr(language, "SLICE", slice_)
    raw, at = win.text_buffers(pa.array(TEXTS))
    found = [[] for _ in TEXTS]
    for rows, of in language.subwords(raw, at):
        for row, text in zip(rows.tolist(), of.tolist()):
            found[text].append(row)
    assert [sorted(f) for f in found] == [plain_subwords(t) for t in TEXTS]


@pytest.mark.parametrize("languages", [3, language.DIMENSIONS + 5])
def test_scores_are_the_softmax_of_a_mean(languages):
    rng = np.random.default_rng(1)
    model = language.Model(
        [f"l{i:02}" for i in range(languages)], rng.normal(size=(1 << language.BITS, language.DIMENSIONS)),
        rng.normal(size=(language.DIMENSIONS, languages)), rng.normal(size=languages), 0.7, 0.5)
    names, scores, rejected = model.predict(pa.array([*TEXTS, None]))
    for text, name, score, low in zip([*TEXTS, None], names, scores, rejected):
        if text is None or not any(c.isalpha() for c in text):
            assert (name, score, low) == ("und", 0, False)
            continue
        mean = model.embeddings[plain_subwords(text)].mean(axis=0)
        chance = language.softmax((mean @ model.weights + model.bias) / 0.7)
        assert name == model.languages[int(chance.argmax())]
        assert abs(score - chance.max()) < 1e-9 and low == (score < 0.5)


def test_gradient_steps_lower_the_loss():
    rng = np.random.default_rng(2)
    examples = []
    for i in range(60):
        rows = np.unique(rng.integers(0, 40, 12) + 40 * (i % 3))
        examples.append((rows, np.full(len(rows), 1 / len(rows)), i % 3))
    embeddings, weights, bias = language.train(examples, 3, 4)
    right = [int((s @ embeddings[r] @ weights + bias).argmax()) == y for r, s, y in examples]
    assert all(right)


def test_calibration():
    rng = np.random.default_rng(3)
    true = rng.integers(0, 2, 4000)
    sure = rng.normal(size=4000) * 3
    # Logits that are twice as sure as they may be.
    right = rng.random(4000) < 1 / (1 + np.exp(-np.abs(sure)))
    side = np.where(right, true, 1 - true)
    logits = np.zeros((4000, 2))
    logits[np.arange(4000), side] = 2 * np.abs(sure)
    temperature, least = language.calibrate(logits, true)
    assert 1.6 < temperature < 2.5
    score = language.softmax(logits / temperature).max(axis=1)
    assert right[score >= least].mean() >= language.PRECISION and 0.9 < least < 1
    assert language.calibrate(np.zeros((0, 2)), np.zeros(0, dtype=int)) == (1.0, 0.0)


def test_query(spark):
    folder = "/root/testdata/sf0.1"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.REGISTRY["op11_language_id"](spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in docs[r["doc_id"]]["text"] or ""))
    held = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in rows if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert sum(held) / len(held) > 0.98


def test_odd_inputs(spark, odd_docs, odd_rows, no_docs):
    rows = language.report(odd_docs).collect()
    assert sorted(r["doc_id"] or -1 for r in rows) == sorted(i or -1 for i, _ in odd_rows)
    for r in rows:
        text = next(t for i, t in odd_rows if i == r["doc_id"]) or ""
        assert r["lang_pred"] == ("en" if any(c.isalpha() for c in text) else "und")
    assert language.report(no_docs).collect() == []
    bare = odd_docs.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    unknown = language.report(bare).collect()
    assert {(r["lang_pred"], r["score"]) for r in unknown} == {("und", 0.0)}


def test_repeated_rows_are_learned_once(spark):
    rows = [(1, "same text again", "en")] * 500 + [(i, f"andere Worte hier {i}", "de") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, sample=30)
    assert model.languages == ["de", "en"]
    assert language.predict(docs, model).count() == len(rows)
