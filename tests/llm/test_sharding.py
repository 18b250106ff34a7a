import random
import zlib
from collections import defaultdict

from gristmill.llm import sharding


def test_shard(odd_docs, odd_rows):
    rows = sharding.shard(odd_docs, 4).collect()
    want = sorted((i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in odd_rows)
    assert sorted((r[0] is None, r[0] or 0, r["size"], r["text_crc32"]) for r in rows) == want
    slots, sums, homes = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sums[r["shard"]] += r["size"]
        homes[r["text_crc32"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    assert sorted(sums) == [0, 1, 2, 3]


def test_empty(no_docs):
    assert sharding.shard(no_docs).collect() == []


def test_difference_is_a_partition_and_tight():
    rng = random.Random(1)
    sizes = [rng.randint(16, 9000) for _ in range(3000)]
    parts = sharding.difference([(s, i) for i, s in enumerate(sizes)], 40)
    assert sorted(i for p in parts for i in p) == list(range(3000))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) <= 5


def test_levels(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 80)
    monkeypatch.setattr(sharding, "LAST", 400)
    rng = random.Random(4)
    sizes = {i: rng.randint(16, 900) for i in range(3000)} | {3000: 40_000, 3001: 9_000}
    groups = sharding.saved(spark.createDataFrame(list(sizes.items()), "item long, size long"))
    placed = {r["item"]: r["shard"] for r in sharding.shard_groups(groups, 8).collect()}
    assert set(placed) == set(sizes)
    sums = [sum(s for i, s in sizes.items() if placed[i] == k) for k in range(8)]
    assert max(sums) - min(sums) < 0.001 * sum(sums)
