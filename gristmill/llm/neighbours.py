"""Nearest neighbours by a block matrix join: int8 tiles with error bounds, survivors in full precision.

1. Vectors that take part are quantised to a byte per component; each keeps its scale, its norm
   and the norm of what rounding lost.
2. Queries and candidates are dealt into blocks; a tile multiplies one block of queries with one
   of candidates.  The Cauchy-Schwarz inequality bounds what rounding can change, so a pair whose
   upper bound is below the k-th lower bound of its tile, and then of its query, cannot be among
   the nearest: no neighbour is lost.
3. Pairs that are left meet the original vectors, and each query's best k by the exact inner
   product are merged over all tiles.

Of many equal vectors only the ``k + 1`` with the smallest identifiers can be among the nearest of
any query, so no more of them are multiplied; this settles ties and very common vectors exactly.

Defined results: null, empty and zero vectors, vectors with a null or non-finite component and
rows without an identifier take no part; of rows that share an identifier, the least vector
counts; vectors of another length than the query's are no candidates; fewer than ``k``
candidates are all returned; ties go to the smaller identifier; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.llm.shared import saved

cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERY_BLOCK, CANDIDATE_BLOCK, SLICE = 4096, 8192, 256
CODES = "vec_id long, dim int, code binary, scale double, norm double, lost double"


def takes_part(vector: str) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce((~F.isnan(x)) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column("vector")
        rows = np.split(vectors.flatten().to_numpy(zero_copy_only=False).astype(float),
                        np.cumsum(vectors.value_lengths().to_numpy())[:-1]) if batch.num_rows else []
        out = []
        for v in rows:
            scale = np.abs(v).max() / 127.0
            code = np.rint(v / scale) if scale > 0 else np.zeros(len(v))
            # Rounding of these sums themselves is far below the added share.
            lost = np.linalg.norm(v - code * scale) + 1e-9 * np.linalg.norm(v)
            out.append((len(v), code.astype(np.int8).tobytes(), scale, np.linalg.norm(v), lost))
        columns = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()),
             *[pa.array(c, pa.float64()) for c in columns[2:]]],
            ["vec_id", "dim", "code", "scale", "norm", "lost"])


def _tile(k: int):
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(candidates):
            dim = int(queries["dim"].iloc[0])
            # Sums of products of bytes are whole numbers, exact below 2**24.
            kind = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64
            a, b = (np.frombuffer(b"".join(x["code"]), dtype=np.int8).reshape(-1, dim).astype(kind)
                    for x in (queries, candidates))
            scale, norm, lost, ids = (candidates[c].to_numpy() for c in ("scale", "norm", "lost", "vec_id"))
            for at in range(0, len(queries), SLICE):
                own = queries.iloc[at:at + SLICE]
                s, n, e, q = (own[c].to_numpy()[:, None] for c in ("scale", "norm", "lost", "vec_id"))
                near = (a[at:at + SLICE] @ b.T).astype(np.float64) * s * scale
                slack = e * norm + (n + e) * lost
                same = q == ids
                low = np.where(same, -np.inf, near - slack)
                high = np.where(same, -np.inf, near + slack)
                if low.shape[1] > k:
                    bound = np.partition(low, -k, axis=1)[:, -k]
                    row, column = np.nonzero((high >= bound[:, None]) & ~same)
                else:
                    row, column = np.nonzero(~same)
                out.append(pd.DataFrame({
                    "query_id": q[row, 0], "vec_id": ids[column], "low": low[row, column], "high": high[row, column]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "low": [], "high": []})

    return run


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, identifier: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest inner product for each query."""
    rows = vectors.select(
        F.col(identifier).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull() & takes_part("vector"))
    rows = saved(rows.groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks")))
    coded = rows.mapInArrow(_quantise, CODES)
    codes = saved(coded.join(rows.select("vec_id", "asks", F.xxhash64("vector").alias("a"),
                                         F.xxhash64(F.lit(1), "vector").alias("b")), "vec_id"))
    copy = F.row_number().over(W.partitionBy("a", "b").orderBy("vec_id"))
    columns = [c.split()[0] for c in CODES.split(", ")]
    candidates = saved(codes.withColumn("copy", copy).where(F.col("copy") <= k + 1).select(*columns))
    asked = codes.where("asks").select(*columns)
    # Enough blocks that a tile's two blocks fit into a task.
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    blocks = max(1, -(-candidates.count() // CANDIDATE_BLOCK))
    number = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tiles = (
        asked.withColumn("qb", number(query_blocks, 1)).withColumn("cb", every(blocks)).groupBy("dim", "qb", "cb")
        .cogroup(candidates.withColumn("cb", number(blocks, 2)).withColumn("qb", every(query_blocks))
                 .groupBy("dim", "qb", "cb"))
        .applyInPandas(_tile(k), "query_id long, vec_id long, low double, high double"))
    tiles = saved(tiles)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("low"), "vec_id"))
    bound = tiles.withColumn("place", place).where(F.col("place") <= k).groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("low")).otherwise(float("-inf")).alias("bound"))
    pairs = tiles.join(bound, "query_id").where("high >= bound").select("query_id", "vec_id")
    found = (
        pairs.join(rows.select("vec_id", F.col("vector").alias("v")), "vec_id")
        .join(rows.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q")), "query_id"))
    product = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (
        found.select("query_id", "vec_id", product.alias("score")).withColumn("rank", best)
        .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
