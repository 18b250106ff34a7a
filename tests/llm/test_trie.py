"""The prefix trie against dictionaries of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gristmill.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, at long, n string"


def plain(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [(r, t) for _, _, r, t in sorted(found)] for c, found in turns.items()}
    whole = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(said.get(c - c % 5, [])[:h] + said[c][h:])
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(int)
    for key in members:
        if key:
            children[key[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for key, held in members.items():
        for d in range(len(key) + 1):
            saved[key[:d]] += (len(held) - 1) * len(key[-1][1].encode()) if key else 0
            leaves[key[:d]] += key not in children
    return sorted((
        min(held), len(key), min(members[key[:-1]]) if key else -1, len(held), children[key] if key in children else 0,
        leaves[key], saved[key],
        hashlib.sha256(",".join(str(c) for c in sorted(held) if len(whole[c]) == len(key)).encode()).hexdigest(),
    ) for key, held in members.items())


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                          "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def talk(rng, convs, longest, words=3):
    rows = []
    for c in convs:
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), "é" * rng.randint(0, words)))
    return rows


def frame(spark, rows):
    wide = [(*r, 7, 8, "x") for r in rows]
    return spark.createDataFrame(wide, SCHEMA).repartition(4)


def test_random_talks(spark):
    rng = random.Random(5)
    rows = talk(rng, rng.sample(range(200), 120), 12)
    rows += [(None, 0, "user", "nobody"), (301, None, None, None), (301, 3, "user", "late"), (301, 1, None, "x")]
    rows += [(302, 4, "user", "a"), (302, 4, "user", "a")]  # a repeated row: two turns
    rng.shuffle(rows)
    assert got(trie.prefix_trie(frame(spark, rows))) == plain(rows)


def test_many_copies_and_one_long_talk(spark, monkeypatch):
    """Copies, a talk of many segments and its near copy, with tiny blocks and batches."""
    monkeypatch.setattr(trie, "TURNS", 4)
    monkeypatch.setattr(trie, "SEGMENTS", 3)
    rng = random.Random(6)
    same = [("user", "hello"), ("assistant", "hi"), ("user", "bye")] * 4
    rows = [(c, i, *t) for c in range(1000, 1060) for i, t in enumerate(same)]
    long = [("user", str(rng.random())) for _ in range(200)]
    for c, cut in ((5, 200), (10, 150), (15, 200), (12, 199)):
        rows += [(c, i, *(t if i < cut else ("user", "else"))) for i, t in enumerate(long)]
    rows += talk(rng, range(400, 460), 9, 1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert got(trie.prefix_trie(frame(spark, rows))) == plain(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_talks_without_turns(spark):
    """A conversation whose base is absent and whose own turns all lie in the replaced part."""
    rows = [(7, 0, "user", "gone"), (8, 0, "user", "gone")]
    assert zlib.crc32(b"7") % 9 > 0 and zlib.crc32(b"8") % 9 > 0
    assert got(trie.prefix_trie(frame(spark, rows))) == plain(rows)
    assert len(plain(rows)) == 1


def test_empty_table(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("rows", [1, 2, 3, 64, 97])
def test_extents(rows):
    rng = np.random.default_rng(rows)
    shared = rng.integers(-1, 5, rows)
    shared[0] = -1
    row, depth = (a.ravel() for a in np.meshgrid(np.arange(rows), np.arange(0, 6)))
    left, right = trie.extents(trie.range_minima(shared), row, depth)
    for i, d, found in zip(row, depth, zip(left, right)):
        first = last = i
        while first > 0 and shared[first] >= d:
            first -= 1
        while last + 1 < rows and shared[last + 1] >= d:
            last += 1
        assert found == (first, last)
