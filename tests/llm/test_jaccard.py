import random
import re
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from gristmill.llm import jaccard

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall((text or "").encode().lower())
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """(doc_id, size, component) by comparing all pairs."""
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    home = {i: i for i in sets}

    def find(i):
        while home[i] != i:
            i = home[i]
        return i

    for i, j in combinations(sets, 2):
        if sets[i] and sets[j] and 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])):
            common = len(sets[i] & sets[j])
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                home[b] = a
    return [(i, len(shingle_set(t)), None if i is None else find(i)) for i, t in rows]


def order(r):
    return (r[0] is None, r[0] or 0, r[1])


def test_odd(odd_docs, odd_rows):
    found = sorted((tuple(r) for r in jaccard.similar(odd_docs).collect()), key=order)
    assert found == sorted(brute(odd_rows), key=order)


def test_empty(no_docs):
    assert jaccard.similar(no_docs).collect() == []


def test_whole_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in jaccard.similar(docs).collect()) == sorted(brute(rows))


@pytest.mark.parametrize("leaders", [0, 2])
def test_trees(spark, monkeypatch, leaders):
    """Chains of near copies and texts around one passage, with leaves of a few documents."""
    monkeypatch.setattr(jaccard, "LEAF", 4)
    monkeypatch.setattr(jaccard, "LEADERS", leaders)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    rows, text = [], [rng.choice(words) for _ in range(120)]
    for i in range(60):
        text = list(text)
        text[rng.randrange(120)] = rng.choice(words)
        rows.append((i, " ".join(text)))
    for i in range(60, 110):
        rows.append((i, " ".join(passage + [rng.choice(words) for _ in range(rng.randint(0, 12))])))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute(rows))
    assert len({c for _, _, c in want}) < 100
    assert sorted(tuple(r) for r in jaccard.similar(docs).collect()) == want


def test_keep_one(odd_docs, odd_rows):
    kept = jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {c for i, _, c in brute(odd_rows) if i is not None}
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert ids.count(None) == sum(i is None for i, _ in odd_rows)


def test_first_of_frequent_shingles_stays(spark):
    """Levels on both sides of 8: the root is the first shingle in unsigned order, with all that comes after it."""
    keys = np.array([(3 << 60) + 5, (9 << 60) + 1, (15 << 60) + 7], dtype=np.uint64)
    sets = spark.createDataFrame([(i, 10, 100 + i, 0, bytearray(keys.tobytes()), bytearray(128)) for i in (1, 2)], jaccard.SETS)
    roots = sorted(tuple(r) for r in jaccard._roots(sets).select("token", "alias", "rest").collect())
    assert roots == [((3 << 60) + 5, 101, 10), ((3 << 60) + 5, 102, 10)]


def test_pairs_of_a_leaf_grow_with_its_documents():
    """Of a group of near copies a forest is checked first, not all pairs; the whole list can be had."""
    count = 100
    rows = pd.DataFrame({
        "pair": [7] * count, "side": [0] * count, "node": range(count), "n": [50] * count, "rest": [50] * count,
        "component": [i // 2 for i in range(count)], "bits": [b"\x01" * 128] * count})
    found = list(jaccard._document_pairs(True)(iter([rows])))
    spared = pd.concat(found)
    assert len(spared) == count // 2 - 1 and spared["more"].all()
    assert len(pd.concat(list(jaccard._document_pairs(False)(iter([rows]))))) == count * (count - 2) // 2


@pytest.mark.parametrize("seed", range(3))
def test_forest(seed):
    rng = np.random.default_rng(seed)
    ends, cost = rng.integers(0, 40, (60, 2)), rng.random(60)
    ends, cost = ends[ends[:, 0] != ends[:, 1]], cost[ends[:, 0] != ends[:, 1]]

    def parts(edges):
        home = {i: i for i in range(40)}
        for _ in range(40):
            for u, v in edges.tolist():
                home[u] = home[v] = min(home[u], home[v])
        return home

    kept = jaccard._forest(ends, cost)
    assert parts(ends[kept]) == parts(ends)
    assert len(kept) == 40 - len(set(parts(ends).values()))


def test_long_texts_are_compared_with_all_their_bits():
    """A short text in the same leaves does not fill the bitmaps of long ones; every similar pair stays."""
    rng = np.random.default_rng(5)
    long = [np.sort(rng.integers(0, 2**64, 6000, dtype=np.uint64)) for _ in range(12)]
    copies = [np.concatenate([x[:5700], rng.integers(0, 2**64, 300, dtype=np.uint64)]) for x in long[:3]]
    sets = long + copies + [rng.integers(0, 2**64, 20, dtype=np.uint64)]
    n = np.array([len(s) for s in sets])
    bits = jaccard.bitmaps(np.concatenate(sets), n)
    for side in ([0] * 16, [0] * 12 + [1] * 4):
        rows = pd.DataFrame({
            "pair": [7] * 16, "side": side, "node": range(16), "n": n, "rest": n, "component": range(16), "bits": bits})
        for sparing in (True, False):
            found = pd.concat(list(jaccard._document_pairs(sparing)(iter([rows]))))
            assert sorted(zip(found["u"], found["v"])) == [(0, 12), (1, 13), (2, 14)] and not found["more"].any()


def test_components_end_with_the_last_change(spark, monkeypatch):
    """Stars need no round, a chain no round more than it takes; the smallest node names each component."""
    from gristmill.llm import shared

    rounds = []
    monkeypatch.setattr(shared, "saved", lambda df, save=shared.saved: rounds.append(1) or save(df))
    stars = [(1, 9), (1, 8), (7, 2), (3, 3)]
    edges = spark.createDataFrame(stars, "u long, v long")
    assert sorted(map(tuple, shared.components(edges).collect())) == [(1, 1), (2, 2), (7, 2), (8, 1), (9, 1)]
    assert len(rounds) == 1
    chain = [(i, i + 1) for i in range(20)] + [(30, 40), (40, 35)]
    found = dict(map(tuple, shared.components(spark.createDataFrame(chain, "u long, v long")).collect()))
    assert found == {i: 0 for i in range(21)} | {30: 30, 35: 30, 40: 30}
    assert shared.components(spark.createDataFrame([], "u long, v long")).collect() == []
