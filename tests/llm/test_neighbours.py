import math
import random

import numpy as np
from pyspark.sql import functions as F

from gristmill.llm import neighbours, queries
from oracle import compare, connect


def brute(rows, k, asks):
    usable = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        usable[i] = min(usable.get(i, v), v)
    out = []
    for q in sorted(i for i in usable if asks(i)):
        scored = []
        for i, v in usable.items():
            if i != q and len(v) == len(usable[q]):
                score = 0.0
                for a, b in zip(usable[q], v):
                    score += float(np.float32(a)) * float(np.float32(b))
                scored.append((-score, i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def made(seed):
    rng = random.Random(seed)
    vector = lambda d: [float(np.float32(rng.gauss(0, 1))) for _ in range(d)]
    rows = [(i, vector(16)) for i in range(400)]
    rows += [(400 + i, list(rows[7][1])) for i in range(120)]  # one very common vector
    rows += [(600, None), (601, []), (602, [0.0] * 16), (603, [None] + [1.0] * 15), (604, [math.nan] * 16),
             (605, [math.inf] + [0.0] * 15), (None, vector(16)), (620, vector(8)), (621, vector(8)), rows[3],
             (640, [1e-30] * 16), (660, [1e30] + [0.0] * 15)]
    rng.shuffle(rows)
    return rows


def test_brute_force(spark, monkeypatch):
    rows = made(1)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, low string, rank int")
    for blocks in ((4096, 8192), (7, 50)):
        monkeypatch.setattr(neighbours, "QUERY_BLOCK", blocks[0])
        monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", blocks[1])
        for k in (1, 20):
            found = neighbours.nearest(df, F.pmod(F.col("vec_id"), F.lit(20)) == 0, k)
            assert sorted(tuple(r) for r in found.collect()) == brute(rows, k, lambda i: i % 20 == 0)


def test_few_candidates_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    rows = [(0, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    found = neighbours.nearest(spark.createDataFrame(rows, kind), F.col("vec_id") == 0)
    assert [tuple(r) for r in found.collect()] == [(0, 1, 2, 2.0), (0, 2, 1, 1.0)]
    assert neighbours.nearest(spark.createDataFrame([], kind), F.col("vec_id") == 0).collect() == []


def test_query(spark, small):
    found = queries.REGISTRY["op4_nearest_neighbours"](spark, small)
    assert compare(found, connect(small), queries.ORACLES["op4_nearest_neighbours"]) is None
