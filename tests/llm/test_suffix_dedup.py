import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from gristmill.llm import parts, suffix_dedup


def brute(rows, depth):
    first, split = {}, []
    for doc_id, text in rows:
        data = (text or "").encode()
        key = -1 if doc_id is None else doc_id
        split.append((doc_id, key, data))
        for i in range(len(data) - depth + 1):
            string = data[i:i + depth]
            first[string] = min(first.get(string, key), key)
    for doc_id, key, data in split:
        gone = [False] * len(data)
        for i in range(len(data) - depth + 1):
            if first[data[i:i + depth]] < key:
                gone[i:i + depth] = [True] * depth
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        yield doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def order(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def test_report(odd_docs, odd_rows):
    rows = [tuple(r) for r in suffix_dedup.dedup_report(odd_docs, 50).collect()]
    want = sorted(brute(odd_rows, 50), key=order)
    assert sorted(rows, key=order) == want
    assert sum(w[2] for w in want) > 3000


def test_whole_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = sorted(tuple(r) for r in suffix_dedup.dedup_report(docs.repartition(6), 50).collect())
    assert found == sorted(brute(rows, 50))


def test_empty(no_docs):
    assert suffix_dedup.dedup_report(no_docs).collect() == []


@pytest.fixture
def little_memory(monkeypatch):
    """Few records are held at once, so that they go through files, and those of common anchors through heaps."""
    monkeypatch.setattr(parts, "LIMIT", 2000)
    monkeypatch.setattr(parts, "BLOCK", 500)
    for name, value in (("CHUNK", 1000), ("PACK", 3000), ("PACKED_CONTEXTS", 50), ("FINDINGS", 40), ("ROWS", 2)):
        monkeypatch.setattr(suffix_dedup, name, value)


def common_rows():
    """Texts that share a short phrase, a passage, or nearly all, and some twice or without doc_id."""
    rng = random.Random(5)
    own = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    phrase, passage, whole = own(24), own(90), own(400)
    rows = []
    for i in range(160):
        middle = (phrase, passage, whole[:200 + i], whole[i:])[i % 4]
        rows.append((i * 7 % 160, own(rng.randint(0, 60)) + middle + own(rng.randint(0, 60))))
    rows += rows[::11]
    rows += [(None, passage + own(5)), (None, own(5) + passage), (200, "x" * 3000), (201, "x" * 2000)]
    return rows


def test_many_records_of_one_anchor(spark, little_memory):
    rows = common_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = [tuple(r) for r in suffix_dedup.dedup_report(docs, 50).collect()]
    assert sorted(found, key=order) == sorted(brute(rows, 50), key=order)


def test_odd_rows_through_files(odd_docs, odd_rows, little_memory):
    found = [tuple(r) for r in suffix_dedup.dedup_report(odd_docs, 50).collect()]
    assert sorted(found, key=order) == sorted(brute(odd_rows, 50), key=order)


def test_parts_keep_keys_together(little_memory):
    rng = np.random.default_rng(1)
    kind = np.dtype([("key", "u8"), ("n", "i4")])
    r = np.empty(6000, dtype=kind)
    r["key"], r["n"] = rng.integers(0, 2**64, 700, dtype=np.uint64)[rng.integers(0, 700, 6000)], np.arange(6000)
    r["key"][::3] = 12345
    seen, met, heaps = [], set(), 0
    for part in parts.parts(np.array_split(r, 60), lambda x: x["key"]):
        if isinstance(part, parts.Heap):
            heaps, part = heaps + 1, part.whole()
            assert part.nbytes > 2000 and (part["key"] == 12345).all()
        else:
            assert part.nbytes <= 2000
        keys = set(part["key"].tolist())
        assert not keys & met
        met |= keys
        seen += part["n"].tolist()
    assert heaps == 1 and sorted(seen) == list(range(6000))


def test_memory_does_not_grow_with_a_bucket(monkeypatch):
    monkeypatch.setattr(parts, "LIMIT", 1 << 20)
    monkeypatch.setattr(suffix_dedup, "FINDINGS", 1 << 15)
    rng = np.random.default_rng(2)
    count, kind = 10_000, suffix_dedup._context_kind(50)
    context = rng.integers(97, 123, (count, 84), dtype=np.uint8)

    def batches(n):
        for i in range(n):
            r = np.zeros(count, dtype=kind)
            r["id"], r["text"], r["start"], r["left"] = i, i, np.arange(count) * 200, 34
            r["bytes"] = context
            rows = [suffix_dedup._context_row(0, r)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), suffix_dedup.CONTEXT_ARROW.types)],
                schema=suffix_dedup.CONTEXT_ARROW)

    tracemalloc.start()
    found = sum(len(b) for b in suffix_dedup._late_windows(50, 1)(batches(20)))
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert found
    # The records are 21 MB, and the hashes of their windows 56 MB.
    assert most < 40e6
