"""The trie of conversation prefixes, from sorted turn sequences.

1. A turn is 128 bits of a SHA-256 of its role and text, mixed with its place.  A conversation is a
   sequence of them, cut into segments of TURNS turns, so that no row grows with a conversation; a
   segment carries the exclusive or of all turns before it, which names the prefix that it continues.
2. Distinct segments are sorted.  Of each Arrow batch of them the common prefixes of neighbours go
   into a sparse table of range minima, and every prefix finds the first and last row that hold it
   by a binary search in that table, by itself and without a stack.  The interval gives its members.
3. A batch's intervals are partial nodes: Spark merges those of one prefix, which meet under the
   prefix's name.  So neither a batch nor a task needs the rows of another.
4. What a subtree adds up is first placed on each node's smallest member; the same intervals then
   sum, over their rows, what lies at their depth or below.

Defined results: rows without a conv_id belong to no conversation; a null role or text is empty;
turns of one number (or none) follow each other by role and digest, and repeated rows are turns of
their own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.frames import lookup_join
from gristmill.llm.shared import saved

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Turns of a segment, and segments whose running values are found in one task.
TURNS, SEGMENTS = 32, 4096
KEY = ["depth", "ka", "kb"]
SEGMENT = ["j", "pa", "pb", "turns"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _running(df: DataFrame, values: list[str], add, forward: bool) -> DataFrame:
    """``before_<value>``: the values of the conversation's segments before this one (or behind it).

    Blocks of segments first, then segments of a block: a conversation that holds a third of all
    turns is no single task.
    """
    step = (lambda c: F.col(c).asc()) if forward else (lambda c: F.col(c).desc())
    df = df.withColumn("block", F.expr(f"j DIV {SEGMENTS}"))
    rest = Window.unboundedPreceding, -1
    blocks = df.groupBy("conv_id", "block").agg(*[add(v).alias(f"block_{v}") for v in values])
    outer = Window.partitionBy("conv_id").orderBy(step("block")).rowsBetween(*rest)
    blocks = blocks.select("conv_id", "block", *[add(f"block_{v}").over(outer).alias(f"block_{v}") for v in values])
    inner = Window.partitionBy("conv_id", "block").orderBy(step("j")).rowsBetween(*rest)
    own = df.withColumns({f"before_{v}": add(v).over(inner) for v in values})
    joined = own.join(blocks, ["conv_id", "block"])
    zero = F.lit(0).cast("long")
    total = (lambda a, b: a.bitwiseXOR(b)) if forward else (lambda a, b: a + b)
    return joined.withColumns({
        f"before_{v}": total(F.coalesce(f"before_{v}", zero), F.coalesce(f"block_{v}", zero)) for v in values
    }).drop("block", *[f"block_{v}" for v in values])


def ordered(conversations: DataFrame) -> DataFrame:
    """``conv_id, place`` (from 1), the turn's digest ``a, b`` and the text's ``size``.

    One sort of all turns, also where a conversation holds a third of them; places follow from each
    partition's counts.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)

    def half(first: int) -> Column:
        return F.conv(F.substring("digest", first, 16), 16, -10).cast("long")

    turns = (
        conversations.where("conv_id IS NOT NULL")
        .select(F.col("conv_id").cast("long"), "turn", role.alias("role"), digest.alias("digest"),
                F.octet_length(text).cast("long").alias("size"))
        .select("conv_id", "turn", "role", "size", half(1).alias("a"), half(17).alias("b"))
        # Equal rows would share one range: their own number keeps them apart.
        .withColumn("row", F.monotonically_increasing_id())
    )
    numbered = saved(
        turns.orderBy("conv_id", F.asc_nulls_first("turn"), "role", "a", "b", "row")
        .select("conv_id", "a", "b", "size", F.monotonically_increasing_id().alias("at"))
        .withColumn("part", F.shiftright("at", 33))
    )
    parts = numbered.groupBy("conv_id", "part").agg(F.min("at").alias("head"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part")
    parts = parts.withColumn("before", F.sum("n").over(earlier) - F.col("n"))
    placed = lookup_join(numbered, parts.drop("n"), ["conv_id", "part"], "inner")
    return placed.select(
        "conv_id", (F.col("at") - F.col("head") + F.col("before") + 1).alias("place"), "a", "b", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' turns, and all conversations with their rebuilt length ``total``.

    The first h turns come from the conversation of the next lower multiple of five, h from 0 to 8.
    """
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(9))
    wanted = own.withColumns({"h": heads, "base": F.col("conv_id") - F.col("conv_id") % 5})
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    lead = F.least("h", F.coalesce("base_n", F.lit(0)))
    conversations = saved(wanted.join(bases, "base", "left").withColumn("lead", lead).withColumn(
        "total", F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    meta = conversations.select("conv_id", "h", "lead", "total")
    rest = lookup_join(turns, meta, ["conv_id"], "inner").where("place > h").select(
        "conv_id", (F.col("lead") + F.col("place") - F.col("h")).alias("place"), "a", "b", "size", "total")
    # At most eight turns of a base, for the at most five conversations that begin with it.
    first = turns.where("place <= 8 AND conv_id % 5 = 0").withColumnRenamed("conv_id", "base")
    begun = first.join(conversations.select("conv_id", "base", "lead", "total"), "base").where("place <= lead")
    return rest.unionByName(begun.select(*rest.columns)), conversations.select("conv_id", "total")


def segments(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """``conv_id, j``, the name ``pa, pb`` of what comes before, the ``turns``, and where the segment ends."""
    placed = turns.select(
        "conv_id", F.expr(f"CAST((place - 1) DIV {TURNS} AS INT)").alias("j"), "place", "size", "total",
        F.xxhash64("a", "place").alias("a"), F.xxhash64("b", "place").alias("b"))
    packed = placed.groupBy("conv_id", "j", "total").agg(
        F.array_sort(F.collect_list(F.struct("place", "a", "b", "size"))).alias("turns"),
        F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"),
    ).withColumn("turns", F.transform("turns", lambda t: F.struct(t["a"], t["b"], t["size"])))
    zero = F.lit(0).cast("long")
    short = packed.where(F.col("total") <= TURNS).withColumns({"before_xa": zero, "before_xb": zero})
    long = _running(packed.where(F.col("total") > TURNS), ["xa", "xb"], F.bit_xor, True)
    kind = packed.schema["turns"].dataType
    bare = conversations.where("total = 0").select(
        "conv_id", F.lit(0).alias("j"), "total", F.array().cast(kind).alias("turns"), zero.alias("xa"),
        zero.alias("xb"), zero.alias("before_xa"), zero.alias("before_xb"))
    every = short.unionByName(long).unionByName(bare)
    return saved(every.select(
        "conv_id", "j", F.col("before_xa").alias("pa"), F.col("before_xb").alias("pb"), "turns", "total",
        F.col("before_xa").bitwiseXOR(F.col("xa")).alias("ea"), F.col("before_xb").bitwiseXOR(F.col("xb")).alias("eb")))


def range_minima(values: np.ndarray) -> list[np.ndarray]:
    """A sparse table: entry i of level k is the least of ``values[i:i + 2**k]``."""
    levels, width = [values], 1
    while 2 * width <= len(values):
        last = levels[-1]
        levels.append(np.minimum(last[:-width], last[width:]))
        width *= 2
    return levels


def extents(levels: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row around ``row`` between which all neighbours share at least ``depth`` turns.

    Entry i of the table's values is what rows i - 1 and i share.  Both searches go from the widest
    power of two down, all prefixes at once.
    """
    rows = len(levels[0])
    left, right = row.copy(), row.copy()
    for k in range(len(levels) - 1, -1, -1):
        table, step = levels[k], 1 << k
        inside = right + step < rows
        near = table[np.where(inside, right + 1, 0)]
        right = np.where(inside & (near >= depth), right + step, right)
        inside = left - step >= 0
        near = table[np.where(inside, left - step + 1, 0)]
        left = np.where(inside & (near >= depth), left - step, left)
    return left, right


class Sorted:
    """A batch of segments: their prefixes' names and the interval of rows of every distinct prefix."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        rows = batch.num_rows
        self.j, self.pa, self.pb = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        lists = batch.column(3)
        flat, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        held = np.arange(TURNS) < lengths[:, None]
        a, b, self.size = (np.zeros((rows, TURNS), dtype=np.int64) for _ in range(3))
        for matrix, name in ((a, "a"), (b, "b"), (self.size, "size")):
            matrix[held] = pc.struct_field(flat, name).to_numpy(zero_copy_only=False)
        follows = (self.j[1:] == self.j[:-1]) & (self.pa[1:] == self.pa[:-1]) & (self.pb[1:] == self.pb[:-1])
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & held[1:] & held[:-1]
        shared = np.full(rows, -1)
        shared[1:] = np.where(follows, np.logical_and.accumulate(same, axis=1).sum(axis=1), -1)
        # Names of the prefixes of 0, 1, ... turns of the segment.
        self.ka = np.bitwise_xor.accumulate(np.column_stack([self.pa, a]), axis=1)
        self.kb = np.bitwise_xor.accumulate(np.column_stack([self.pb, b]), axis=1)
        # A prefix is looked for from the first row that holds it; the root only in first segments.
        at = np.arange(TURNS + 1)
        new = (at <= lengths[:, None]) & (at > shared[:, None]) & ((at > 0) | (self.j[:, None] == 0))
        self.row, self.at = np.nonzero(new)
        self.left, self.right = extents(range_minima(shared), self.row, self.at)

    def least(self, values: np.ndarray) -> np.ndarray:
        levels = range_minima(values)
        k = np.frexp(self.right - self.left + 1)[1] - 1
        done = np.empty(len(self.row), dtype=values.dtype)
        for level in np.unique(k):
            mine = k == level
            done[mine] = np.minimum(
                levels[level][self.left[mine]], levels[level][self.right[mine] - (1 << level) + 1])
        return done

    def total(self, values: np.ndarray) -> np.ndarray:
        """The sum over the interval of a value for each row, or for each row and depth."""
        if values.ndim == 1:
            sums = np.concatenate([[0], np.cumsum(values)])
            return sums[self.right + 1] - sums[self.left]
        sums = np.vstack([np.zeros((1, values.shape[1]), dtype=values.dtype), np.cumsum(values, axis=0)])
        return sums[self.right + 1, self.at] - sums[self.left, self.at]

    def key(self) -> dict[str, np.ndarray]:
        return {"depth": self.j[self.row].astype(np.int64) * TURNS + self.at, "ka": self.ka[self.row, self.at],
                "kb": self.kb[self.row, self.at]}


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        found = Sorted(batch)
        up = np.maximum(found.at - 1, 0)
        yield pa.RecordBatch.from_pydict({
            **found.key(), "up_a": found.ka[found.row, up], "up_b": found.kb[found.row, up],
            "size": np.where(found.at > 0, found.size[found.row, up], 0),
            "n": found.total(batch.column(4).to_numpy(zero_copy_only=False)),
            "conv_id": found.least(batch.column(5).to_numpy(zero_copy_only=False))})


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        found = Sorted(batch)
        lists = batch.column(4)
        of, flat = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), lists.flatten()
        place = pc.struct_field(flat, "at").to_numpy(zero_copy_only=False)
        sums = {}
        for column, name in ((5, "saved"), (6, "leaves")):
            values = np.zeros((batch.num_rows, TURNS + 1), dtype=np.int64)
            np.add.at(values, (of, place), pc.struct_field(flat, name).to_numpy(zero_copy_only=False))
            values = np.cumsum(values[:, ::-1], axis=1)[:, ::-1]
            below = batch.column(column).to_numpy(zero_copy_only=False)
            sums[name] = found.total(np.ascontiguousarray(values + below[:, None]))
        yield pa.RecordBatch.from_pydict({**found.key(), **sums})


def _sorted_segments(rows: DataFrame, *more: str) -> DataFrame:
    return rows.orderBy(*SEGMENT).select(*SEGMENT, *more)


def _nodes(rows: DataFrame) -> DataFrame:
    """``KEY``, the parent's name, the last text's ``size``, members ``n`` and the smallest, ``conv_id``."""
    partial = _sorted_segments(rows, "n", "conv_id").mapInArrow(
        _members, "depth long, ka long, kb long, up_a long, up_b long, size long, n long, conv_id long")
    nodes = partial.groupBy(*KEY).agg(
        *[F.min(c).alias(c) for c in ("up_a", "up_b", "size", "conv_id")], F.sum("n").alias("n"))
    children = nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("up_a").alias("ka"), F.col("up_b").alias("kb"),
    ).agg(F.count(F.lit(1)).alias("n_children"))
    return saved(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))


def _sums(pieces: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``KEY`` with the ``saved`` bytes and the ``leaves`` of every subtree."""
    own = nodes.select(
        "conv_id", F.expr(f"CAST(greatest(depth - 1, 0) DIV {TURNS} AS INT)").alias("j"), "depth",
        ((F.col("n") - 1) * F.col("size")).alias("saved"),
        (F.col("n_children") == 0).cast("long").alias("leaves"),
    ).where("saved <> 0 OR leaves <> 0").withColumn("at", (F.col("depth") - F.col("j") * TURNS).cast("int"))
    # At most a segment's turns are placed on one member and segment.
    placed = own.groupBy("conv_id", "j").agg(
        F.collect_list(F.struct("at", "saved", "leaves")).alias("placed"),
        F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    deep = pieces.where(F.col("total") > TURNS).select("conv_id", *SEGMENT)
    deep = deep.join(placed.drop("placed"), ["conv_id", "j"], "left").fillna(0, ["saved", "leaves"])
    behind = _running(deep, ["saved", "leaves"], F.sum, False).groupBy(*SEGMENT).agg(
        F.sum("before_saved").alias("saved_below"), F.sum("before_leaves").alias("leaves_below"))
    filled = (
        rows.join(placed.select("conv_id", "j", "placed"), ["conv_id", "j"], "left")
        .join(behind, SEGMENT, "left").fillna(0, ["saved_below", "leaves_below"])
        .withColumn("placed", F.coalesce("placed", F.array().cast(placed.schema["placed"].dataType)))
    )
    partial = _sorted_segments(filled, "placed", "saved_below", "leaves_below").mapInArrow(
        _subtrees, "depth long, ka long, kb long, saved long, leaves long")
    return partial.groupBy(*KEY).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ends of a batch: for each prefix in turn its members, written one after the other."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        heads = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
        ids = batch.column(3).to_numpy(zero_copy_only=False)
        texts = [",".join(map(str, ids[s:e].tolist())) for s, e in pairwise([*heads.tolist(), len(ids)])]
        yield pa.RecordBatch.from_arrays([
            *[pa.array(key[heads, i]) for i in range(3)], pa.array(ids[heads]), pa.array(texts)],
            [*KEY, "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of every prefix's lists in turn; only one of them is open at a time."""
    def done(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([f[0][i] for f in found], pa.int64()) for i in range(3)]
            + [pa.array([f[1].hexdigest() for f in found], pa.string())], [*KEY, "ends_sha256"])

    key, digest = None, None
    for batch in batches:
        found = []
        for *now, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
            if now == key:
                digest.update(b"," + ids.encode())
                continue
            if key is not None:
                found.append((key, digest))
            key, digest = now, hashlib.sha256(ids.encode())
        yield done(found)
    if key is not None:
        yield done([(key, digest)])


def _ends(pieces: DataFrame) -> DataFrame:
    """``KEY`` with the hash of the members that end there.

    The members of a prefix are sorted and written by many tasks; a hash is sequential, so the
    task of a prefix reads these lists, but never holds more than one.
    """
    last = pieces.where(f"j = greatest(total - 1, 0) DIV {TURNS}").select(
        F.col("total").cast("long").alias("depth"), F.col("ea").alias("ka"), F.col("eb").alias("kb"), "conv_id")
    listed = last.orderBy(*KEY, "conv_id").mapInArrow(_listed, "depth long, ka long, kb long, first long, ids string")
    return listed.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(
        _hashed, "depth long, ka long, kb long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for every distinct prefix of the rebuilt conversations, the empty one included."""
    turns, every = rebuilt(saved(ordered(conversations)))
    pieces = segments(turns, every)
    rows = saved(pieces.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")))
    nodes = _nodes(rows)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("up_a"),
                           F.col("kb").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    joined = nodes.join(_sums(pieces, rows, nodes), KEY, "left").join(_ends(pieces), KEY, "left")
    return lookup_join(joined, parents, ["depth", "up_a", "up_b"], "left").select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
