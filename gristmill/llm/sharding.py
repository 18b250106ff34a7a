"""Sharding by Karmarkar-Karp differencing: equal bytes although groups of equal texts stay whole.

Rows are grouped by their text first, so that copies weigh as one item.  Differencing then works
in levels: the items are dealt into blocks, each block is differenced into ``shards`` partial
partitions, and these partial sums are the items of the next level, until what is left is a
bounded number of items for one last differencing.  Items that are large against a shard, of
which there can only be a bounded number, skip the blocks.

Defined results: a null text is no text (size 16, checksum of no bytes) and forms a group with
empty texts; repeated rows are rows of their group; a group larger than a shard's share still
stays whole, and the other groups fill the other shards; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.shared import saved, session_of, spread_rank, without

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: An item above total / (shards * LARGE) is differenced at the last level itself.
LARGE = 200
#: Items of one block (a level leaves ``shards`` of them), blocks of one task, and the most items for the last level.
BLOCK, BLOCKS_OF_A_TASK, LAST = 1000, 50, 60_000


def difference(items: list[tuple[int, int]], ways: int) -> list[list[int]]:
    """Split ``(size, id)`` items into ``ways`` lists of nearly equal sums.

    Every item begins as a partition with one filled part.  The two partitions of largest spread
    are combined, the largest part of one with the smallest of the other, until one is left.
    Parts are kept as trees of ids, which are only written out at the end.
    """
    heap = []
    for size, item in items:
        heap.append((-size, item, [(0, None)] * (ways - 1) + [(size, item)]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, one = heapq.heappop(heap)
        _, other_tie, other = heapq.heappop(heap)
        joined = []
        for (a, x), (b, y) in zip(one, reversed(other)):
            joined.append((a + b, x if y is None else y if x is None else (x, y)))
        joined.sort(key=_size)
        base = joined[0][0]
        joined = [(a - base, x) for a, x in joined]  # only differences matter from here
        heapq.heappush(heap, (-joined[-1][0], min(tie, other_tie), joined))
    parts = []
    for _, tree in heap[0][2] if heap else [(0, None)] * ways:
        ids, stack = [], [tree] if tree is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += node
            else:
                ids.append(node)
        parts.append(ids)
    return parts


def _size(part: tuple) -> int:
    return part[0]


def _block(ways: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([b for b in batches] or [pd.DataFrame({"block": [], "item": [], "size": []})])
        for block, own in rows.groupby("block"):
            own = own.sort_values(["size", "item"])
            items = own["item"].to_numpy()
            parts = difference([(int(s), i) for i, s in enumerate(own["size"])], ways)
            for part, ids in enumerate(parts):
                if ids:
                    yield pd.DataFrame({
                        "item": items[ids], "bundle": int(block) * ways + part,
                        "size": own["size"].to_numpy()[ids],
                    })

    return run


def shard_groups(groups: DataFrame, shards: int) -> DataFrame:
    """``(item, shard)`` for a written table of ``(item long, size long)`` with distinct items."""
    spark = session_of(groups)
    whole = groups.agg(F.sum("size").alias("t")).first()["t"] or 0
    bound = whole // (shards * LARGE)
    levels, items = [], groups
    while (number := items.count()) > LAST:
        blocks = max(1, -(-number // BLOCK))
        small = items.where(F.col("size") <= bound).withColumn(
            "block", F.pmod(F.xxhash64("item", F.lit(len(levels))), F.lit(blocks)))
        if not small.head(1):
            break  # at most shards * LARGE large items
        tasks = max(1, blocks // BLOCKS_OF_A_TASK)
        bundled = saved(small.repartition(tasks, "block").mapInPandas(
            _block(shards), "item long, bundle long, size long"))
        levels.append(bundled)
        items = saved(
            bundled.groupBy("bundle").agg(F.sum("size").alias("size"))
            .select((-F.col("bundle") - 1 - (len(levels) << 50)).alias("item"), "size")
            .union(items.where(F.col("size") > bound).select("item", "size")))
    last = sorted((r["size"], r["item"]) for r in items.collect())  # LAST items at most
    placed = [(last[i][1], shard) for shard, ids in enumerate(
        difference([(s, i) for i, (s, _) in enumerate(last)], shards)) for i in ids]
    placed = spark.createDataFrame(placed or [], "item long, shard int")
    for depth in range(len(levels), 0, -1):
        bundles = levels[depth - 1]
        inner = bundles.withColumn("outer", -F.col("bundle") - 1 - (depth << 50))
        found = inner.join(placed.withColumnRenamed("item", "outer"), "outer").select("item", "shard")
        names = bundles.select((-F.col("bundle") - 1 - (depth << 50)).alias("item")).distinct()
        placed = saved(found.union(placed.join(names, "item", "left_anti")))
    return placed


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """Put every row into a shard; ``law`` is ``bytes``.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = saved(without(docs, "doc_id", "text").select(
        "doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("text_md5")))
    groups = rows.groupBy("text_md5").agg(F.sum("size").alias("size"))
    groups = saved(groups.withColumn("item", F.xxhash64("text_md5")))
    # Groups whose 64-bit names agree go to one shard together: an item is a name.
    placed = shard_groups(saved(groups.groupBy("item").agg(F.sum("size").alias("size"))), shards)
    located = saved(rows.withColumn("item", F.xxhash64("text_md5")).join(placed, "item")
                    .select("doc_id", "size", "text_crc32", "shard"))
    return spread_rank(located, "shard", ("doc_id", "text_crc32"), "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
