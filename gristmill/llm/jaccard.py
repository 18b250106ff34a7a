"""N-gram Jaccard join: documents whose sets of word shingles are similar, by signature trees.

The sets are the distinct shingles of ``SHINGLE`` words of the whole text (with fewer words: the
whole sequence); two documents are linked when ``PARTS * common >= SHARE * together``.

1. One scan counts, in a sketch of fixed size, how often shingles occur; it only fixes the order
   in which shingles are looked at, rare ones first, so its errors cost time and no link.
2. Linked sets share a shingle among their first ``n - ceil(share * n) + 1``.  These are dealt
   into buckets, packed in columns; shingles that one class of equal sets holds drop out, and of
   shingles with the same members only one stays.  What is left are the roots of the trees.
3. Each member meets one leader of its root; exact checks of these pairs, linear in number,
   already connect groups of near copies.
4. Roots whose members are not all connected yet become signature trees: root, bands of like
   sizes, leaves of about ``LEAF`` documents, each with the OR of its members' bitmaps, its range
   of sizes and of components, and the most shingles that a member has from the root's on.  Pairs
   of nodes are followed downwards from the root as long as their sizes, their components and the
   largest overlap that bitmaps and remaining shingles allow let them.  Documents met there are
   compared by their bitmaps again, each two with all the bits that both have.  What is left is
   checked exactly: all of it where that is a few pairs for each document, else the likeliest pairs
   that would connect them (a forest, so no more than documents), and again as long as links are
   found; then all pairs between what is still apart.
5. Components of the links by alternating stars.

Equal sets count as one until the end, so copies cost one lookup each.

Defined results: null and empty texts have empty sets and are linked with nothing; rows that share
a doc_id have the component of their own set each; rows without a doc_id have no component and
link nothing; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.functions.frames import lookup_join
from gristmill.llm import blobs
from gristmill.llm import windows as win
from gristmill.llm.shared import components, partitions, remove_unread, saved, session_of, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, SHARE, PARTS = 5, 80, 100
COUNTERS, COUNTER_BLOCK, LEVEL_BITS = 18, 4096, 4
#: Bits of a tree node's bitmap, and the fewest of a document's, which has 2 to 4 for each shingle.
BITS, LEAF, BAND, LEADERS = 1024, 256, 1.25, 2
#: Pairs of leaves hand on all that may be similar up to so many pairs for each document.
SPARED = 4
SETS = "doc_id long, n long, a long, b long, first binary, bits binary"
#: Up to so many identifiers are sent to all tasks that read texts; more meet the texts in a shuffle.
SENT_IDS = 500_000


def shingles(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, text by text and sorted within each; the text of each; sizes."""
    raw = win.lower_ascii()[raw]
    starts, ends, first = win.word_places(raw, at)
    words = win.word_hashes(raw, starts, ends)
    counts = np.diff(first)
    of = np.repeat(np.arange(len(counts)), counts)
    sums = win.Sums(words, win.WORD_BASE)
    long = np.flatnonzero(of[SHINGLE - 1:] == of[:max(0, len(of) - SHINGLE + 1)])
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    hashes = win.mix(np.concatenate([
        sums.every(SHINGLE)[long], sums.runs(first[short], first[short + 1]) + counts[short].astype(np.uint64)]), 3)
    of = np.concatenate([of[long], short])
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    hashes, of = hashes[new], of[new]
    return hashes, of, np.bincount(of, minlength=len(counts))


def _count(salts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(1 << COUNTERS, dtype=np.int64)
        for batch in batches:
            for _, _, raw, at in win.chunks(batch.column(0)):
                hashes, _, _ = shingles(raw, at)
                counts += np.bincount((hashes >> np.uint64(64 - COUNTERS)).astype(np.int64), minlength=len(counts))
        salt = TaskContext.get().partitionId() % salts
        if counts.any():
            parts = [c.tobytes() for c in counts.reshape(-1, COUNTER_BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([salt] * len(parts), pa.int32()), pa.array(parts)],
                ["block", "salt", "counts"])

    return run


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, dtype=np.int64) for c in rows["counts"])
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "salt": [0], "counts": [total.tobytes()]})


def frequency_levels(texts: DataFrame) -> np.ndarray:
    """For each counter 0, or how many times over four means the count doubles: rare shingles come first."""
    salts = max(1, math.isqrt(texts.rdd.getNumPartitions()))
    kind = "block int, salt int, counts binary"
    parts = texts.mapInArrow(_count(salts), kind)
    parts = parts.groupBy("block", "salt").applyInPandas(_summed, kind).groupBy("block").applyInPandas(_summed, kind)
    counts = np.zeros(1 << COUNTERS, dtype=np.int64)
    for r in parts.collect():  # 2**COUNTERS numbers, whatever the corpus
        counts[r["block"] * COUNTER_BLOCK:(r["block"] + 1) * COUNTER_BLOCK] = np.frombuffer(r["counts"], dtype=np.int64)
    usual = 4.0 * counts.mean() + 16.0
    return np.clip(np.floor(np.log2(np.maximum(counts, 1) / usual)) + 1, 0, (1 << LEVEL_BITS) - 1).astype(np.uint8)


def order_keys(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The global order of shingles: level of frequency, then hash."""
    level = levels[(hashes >> np.uint64(64 - COUNTERS)).astype(np.int64)].astype(np.uint64)
    return (level << np.uint64(64 - LEVEL_BITS)) | (win.mix(hashes, 1) >> np.uint64(LEVEL_BITS))


def _set_hashes(hashes: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each text's set; together they tell sets apart."""
    some, begin = np.flatnonzero(n), np.cumsum(n) - n
    out = []
    for seed in (4, 5):
        total = np.zeros(len(n), dtype=np.uint64)
        if len(some):
            total[some] = np.add.reduceat(win.mix(hashes, seed), begin[some])
        out.append(total.view(np.int64))
    return out


def bitmaps(hashes: np.ndarray, n: np.ndarray) -> list[bytes]:
    """A bitmap for each text, of a power of two of bits that grows with its set."""
    size = np.maximum(BITS, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    first = np.cumsum(size) - size
    grid = np.zeros(int(size.sum()), dtype=bool)
    place = (win.mix(hashes, 9) >> np.uint64(8)).astype(np.int64) % np.repeat(size, n)
    grid[np.repeat(first, n) + place] = True
    packed = np.packbits(grid)
    return [packed[a:b].tobytes() for a, b in zip((first // 8).tolist(), ((first + size) // 8).tolist())]


def folded(maps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps brought to ``size`` bytes, one row each: positions are taken modulo the fewer bits."""
    out = np.empty((len(maps), size), dtype=np.uint8)
    for i, x in enumerate(maps):
        row = np.frombuffer(x, dtype=np.uint8)
        out[i] = row if len(row) == size else np.bitwise_or.reduce(row.reshape(-1, size), axis=0)
    return out.view(np.uint64)


def _describe(levels: np.ndarray):
    """Per row: size of the set, two hashes of it, the first shingles in the global order, a bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, a, b, first, bits = [], [], [], [], []
            for _, _, raw, at in win.chunks(batch.column(1)):
                hashes, of, n = shingles(raw, at)
                begin = np.cumsum(n) - n
                for out, total in zip((a, b), _set_hashes(hashes, n)):
                    out.append(total)
                bits += bitmaps(hashes, n)
                keys = order_keys(hashes, levels)
                keys = keys[np.lexsort((keys, of))]
                length = np.where(n > 0, n - -(-n * SHARE // PARTS) + 1, 0)
                first += [keys[x:x + k].tobytes() for x, k in zip(begin.tolist(), length.tolist())]
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *[pa.array(np.concatenate(c) if c else [], pa.int64()) for c in (sizes, a, b)],
                pa.array(first, pa.binary()), pa.array(bits, pa.binary())],
                ["doc_id", "n", "a", "b", "first", "bits"])

    return run


def _first_shingles(buckets: int, hot: bool):
    """Deal out the first shingles: frequent ones as rows, the others packed by bucket."""
    limit = np.uint64(1 << (64 - LEVEL_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            _, once = np.unique(a, return_index=True)
            lists = [np.frombuffer(x, dtype=np.uint64) for x in batch.column(2).take(pa.array(once)).to_pylist()]
            if not lists:
                continue
            keys = np.concatenate(lists)
            which = np.repeat(once, [len(x) for x in lists])
            # How many shingles of the set come from this one on in the global order.
            left = np.concatenate([n[i] - np.arange(len(x)) for i, x in zip(once, lists)])
            chosen = (keys >= limit) if hot else (keys < limit)
            keys, which, left = keys[chosen], which[chosen], left[chosen]
            if hot:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(a[which]), pa.array(left)], ["token", "alias", "rest"])
                continue
            bucket = (win.mix(keys, 6) >> np.uint64(33)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            rows = []
            for x in range(buckets):
                own = order[edges[x]:edges[x + 1]]
                if len(own):
                    rows.append((x, keys[own].tobytes(), a[which[own]].tobytes(), blobs.planes(left[own].astype(np.uint32))))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                    ["bucket", "tokens", "aliases", "rests"])

    return run


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: shingles of several classes, one for each set of members."""
    tokens = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in rows["tokens"]])
    aliases = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in rows["aliases"]])
    rests = np.concatenate([blobs.unplaned(x, "u4") for x in rows["rests"]]).astype(np.int64)
    order = np.argsort(tokens)
    runs = blobs.runs(tokens[order])
    lengths = np.diff(np.append(runs, len(order)))
    order = order[np.repeat(lengths > 1, lengths)]
    order = order[np.lexsort((aliases[order], tokens[order]))]
    tokens, aliases, rests = tokens[order], aliases[order], rests[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (aliases[1:] != aliases[:-1])
    tokens, aliases, rests = tokens[new], aliases[new], rests[new]
    runs = blobs.runs(tokens)
    if not len(runs):
        return pd.DataFrame({"token": [], "members": [], "who": [], "alias": [], "rest": []})
    lengths = np.diff(np.append(runs, len(tokens)))
    who = np.bitwise_xor.reduceat(win.mix(aliases.view(np.uint64), 8), runs).view(np.int64)
    _, one = np.unique(np.column_stack([lengths, who]), axis=0, return_index=True)
    kept = np.zeros(len(runs), dtype=bool)
    kept[one] = lengths[one] > 1
    kept = np.repeat(kept, lengths)
    return pd.DataFrame({
        "token": tokens[kept].view(np.int64), "members": np.repeat(lengths, lengths)[kept],
        "who": np.repeat(who, lengths)[kept], "alias": aliases[kept], "rest": rests[kept]})


def _roots(sets: DataFrame) -> DataFrame:
    """``token, alias, rest``: one shingle for each set of classes that share one of their first shingles.

    The first shingle that two sets share, in the global order, is always among these, and there
    they have nothing in common before it: at most the lesser ``rest`` is common to both.
    """
    buckets = partitions(session_of(sets))
    usable = sets.where("n > 0 and doc_id is not null")
    packed = usable.select("a", "n", "first").mapInArrow(
        _first_shingles(buckets, False), "bucket int, tokens binary, aliases binary, rests binary")
    rare = packed.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(
        _shared, "token long, members long, who long, alias long, rest long")
    rows = usable.select("a", "n", "first").mapInArrow(_first_shingles(buckets, True), "token long, alias long, rest long")
    rows = saved(rows.groupBy("token", "alias").agg(F.max("rest").alias("rest")))
    often = rows.groupBy("token").agg(
        F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("alias")).alias("who")).where("members > 1")
    often = lookup_join(rows, often, ["token"], "inner").select("token", "members", "who", "alias", "rest")
    shared = saved(rare.union(often))
    # Many shingles have the same members: the first in the global order is enough.  Its numbers
    # have no sign, so the top bit is turned for the comparison.
    place = F.col("token").bitwiseXOR(F.lit(-(2**63)))
    one = shared.groupBy("members", "who").agg(F.min_by("token", place).alias("token"))
    return saved(lookup_join(shared, one.select("token").distinct(), ["token"], "left_semi").select("token", "alias", "rest"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the wanted texts; rows that repeat within a task are read once."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        ids, want_a, want_b = (batch.column(c).to_numpy() for c in ("doc_id", "a", "b"))
        nodes, sets = [], []
        for row, _, raw, at in win.chunks(batch.column("text")):
            hashes, _, n = shingles(raw, at)
            begin = np.cumsum(n) - n
            a, b = _set_hashes(hashes, n)
            for i in np.flatnonzero((a == want_a[row:row + len(n)]) & (b == want_b[row:row + len(n)])).tolist():
                key = (int(ids[row + i]), int(a[i]))
                if key not in seen:
                    seen.add(key)
                    nodes.append(key[0])
                    sets.append(hashes[begin[i]:begin[i] + n[i]].view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])


def _whole_sets(docs: DataFrame, signed: DataFrame, pairs: DataFrame) -> DataFrame:
    """``node, set`` of the nodes in the pairs."""
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    wanted = saved(signed.withColumnRenamed("node", "doc_id").join(nodes, "doc_id", "left_semi").select("doc_id", "a", "b"))
    small = wanted.count() <= SENT_IDS
    rows = docs.join(F.broadcast(wanted) if small else wanted, "doc_id")
    return saved(rows.select("doc_id", "text", "a", "b").mapInArrow(_sets, "node long, set array<long>"))


def _similar_sizes(n: str, m: str) -> str:
    return f"({PARTS} * least({n}, {m}) >= {SHARE} * greatest({n}, {m}))"


def _enough(common: str, both: str) -> str:
    """Whether so many common shingles can link two sets of so many together."""
    return f"({PARTS} * {common} >= {SHARE} * ({both} - {common}))"


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps allow the overlap that they need."""
    for batch in batches:
        n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
        x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
        size = np.array([min(len(a), len(b)) for a, b in zip(x, y)], dtype=np.int64)
        kept = np.zeros(len(n), dtype=bool)
        for k in np.unique(size).tolist():
            at = np.flatnonzero(size == k)
            for part in np.array_split(at, max(1, len(at) * k >> 24)):
                a, b = (folded([z[i] for i in part], k) for z in (x, y))
                kept[part] = _room(n[part], m[part], np.bitwise_count(a & ~b).sum(axis=1), np.bitwise_count(b & ~a).sum(axis=1))
        yield pa.RecordBatch.from_arrays(
            [batch.column("u").filter(pa.array(kept)), batch.column("v").filter(pa.array(kept))], ["u", "v"])


def _room(n, m, only_x, only_y):
    """Whether two sets can be similar when so many shingles of each are surely not in the other."""
    most = np.minimum(n - only_x, m - only_y)
    return PARTS * most >= SHARE * (n + m - most)


def _by_bitmaps(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` of nodes that their sizes and bitmaps leave possible."""
    short = signed.select("node", "n", "bits")
    both = (
        pairs.join(short.select(F.col("node").alias("u"), "n", F.col("bits").alias("x")), "u")
        .join(short.select(F.col("node").alias("v"), F.col("n").alias("m"), F.col("bits").alias("y")), "v")
        .where(_similar_sizes("n", "m")))
    return saved(both.select("u", "v", "n", "m", "x", "y").mapInArrow(_possible, "u long, v long").distinct())


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are similar, by their whole sets."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("p")), "u").join(
        sets.select(F.col("node").alias("v"), F.col("set").alias("q")), "v")
    common = F.size(F.array_intersect("p", "q"))
    return saved(both.withColumn("common", common).where(
        f"{PARTS} * common >= {SHARE} * (size(p) + size(q) - common)").select("u", "v"))


def _with_components(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members with the component that the links so far put them into."""
    return saved(members.drop("component").join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node")))


def _open_roots(members: DataFrame) -> DataFrame:
    """Members of roots whose members are not all connected."""
    mixed = members.groupBy("token").agg(
        F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
    return lookup_join(members, mixed, ["token"], "left_semi")


def _leader_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Each member with one leader of its root, unless they are connected."""
    leaders = members.groupBy("token").agg(
        F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("v"), F.col("n").alias("m"),
                       F.col("rest").alias("r"), F.col("component").alias("c"))).alias("first"))
    met = lookup_join(members, leaders, ["token"], "inner").where(
        "component <> first.c and " + _similar_sizes("n", "first.m")
        + " and " + _enough("least(rest, first.r)", "n + first.m"))
    return met.select(F.least("node", "first.v").alias("u"), F.greatest("node", "first.v").alias("v")).distinct()


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bitmaps as BITS bits in whole numbers."""
    for batch in batches:
        words = folded(batch.column("bits").to_pylist(), BITS // 8).view(np.int64)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(words.reshape(-1)), BITS // 64).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], lists], [*batch.schema.names[:-1], "w"])


def _leaves(members: DataFrame) -> DataFrame:
    """The leaves of the trees: sizes, components, fewest bits, OR of the bitmaps."""
    return members.groupBy("token", "band", "leaf").agg(
        F.min("n").alias("low_n"), F.max("n").alias("high_n"), F.max("rest").alias("most"),
        F.min("component").alias("low_c"), F.max("component").alias("high_c"),
        F.min(F.aggregate("w", F.lit(0), lambda s, x: s + F.bit_count(x))).alias("fewest"),
        F.array(*[F.bit_or(F.col("w")[i]) for i in range(BITS // 64)]).alias("or"))


def _node_pairs(nodes: DataFrame, keys: list[str], above: DataFrame | None) -> DataFrame:
    """Pairs of nodes below the pairs ``above`` that can still hold a link between components."""
    left = nodes.select(*[F.col(k).alias(f"x_{k}" if k != "token" else k) for k in keys],
                        *[F.col(c).alias(f"x_{c}") for c in nodes.columns if c not in keys])
    right = nodes.select(*[F.col(k).alias(f"y_{k}" if k != "token" else k) for k in keys],
                         *[F.col(c).alias(f"y_{c}") for c in nodes.columns if c not in keys])
    if above is None:
        pairs = left.join(right, "token")
    else:
        pairs = above.join(left, ["token", "x_band"]).join(right, ["token", "y_band"])
    names = [k for k in keys if k != "token"]
    order = F.struct(*[f"x_{k}" for k in names]) <= F.struct(*[f"y_{k}" for k in names])
    overlap = F.aggregate(F.zip_with("x_or", "y_or", lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda s, x: s + x)
    most = lambda a: F.col(f"{a}_high_n") - F.greatest(F.lit(0), F.col(f"{a}_fewest") - overlap)
    # common >= SHARE * together / PARTS, and together is at least the larger set
    room = F.least(most("x"), most("y")) * PARTS >= F.greatest("x_low_n", "y_low_n") * SHARE
    sizes = f"{PARTS} * least(x_high_n, y_high_n) >= {SHARE} * greatest(x_low_n, y_low_n)"
    apart = "not (x_low_c = x_high_c and y_low_c = y_high_c and x_low_c = y_low_c)"
    rest = _enough("least(x_most, y_most)", "x_low_n + y_low_n")
    return pairs.where(order).where(sizes).where(rest).where(apart).where(room).select(
        "token", *[f"{s}_{k}" for s in "xy" for k in names])


def _document_pairs(sparing: bool):
    """Pairs of documents of two leaves that bitmaps, sizes and components leave possible.

    A pair of leaves has its documents in neighbouring rows; the last one of a batch waits for the next.
    ``sparing``: only a forest of them where there are more than ``SPARED`` for each document; ``more``
    tells that a pair of leaves has others.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for rows in batches:
            rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
            pair = rows["pair"].to_numpy()
            edges = np.append(blobs.runs(pair), len(pair)) if len(pair) else np.zeros(1, dtype=int)
            rest = rows.iloc[edges[-2]:] if len(edges) > 1 else None
            yield _met(rows.iloc[:edges[-2]] if len(edges) > 1 else rows, edges[:-1], sparing)
        if rest is not None:
            yield _met(rest.reset_index(drop=True), np.array([0, len(rest)]), sparing)

    return run


def _met(rows: pd.DataFrame, edges: np.ndarray, sparing: bool) -> pd.DataFrame:
    found, more = [np.zeros((0, 3), dtype=np.int64)], [np.zeros(0, dtype=bool)]
    if len(rows):
        node, n, rest, component, side, pair = (
            rows[c].to_numpy() for c in ("node", "n", "rest", "component", "side", "pair"))
        maps = rows["bits"].tolist()
        for a, b in zip(edges[:-1], edges[1:]):
            x, y = np.flatnonzero(side[a:b] == 0), np.flatnonzero(side[a:b] == 1)
            met, differ = _near(maps[a:b], n[a:b], rest[a:b], component[a:b], x, y)
            kept = slice(None)
            if sparing and len(met) > SPARED * (b - a):
                kept = _forest(component[a:b][met], differ)
            ends = node[a:b][met[kept]]
            found.append(np.column_stack([np.full(len(ends), pair[a]), ends.min(axis=1, initial=2**63 - 1), ends.max(axis=1, initial=-2**63)]))
            more.append(np.full(len(ends), len(ends) < len(met)))
    found = np.concatenate(found)
    return pd.DataFrame({"pair": found[:, 0], "u": found[:, 1], "v": found[:, 2], "more": np.concatenate(more)}).drop_duplicates(["u", "v", "pair"])


def _near(maps: list[bytes], n: np.ndarray, rest: np.ndarray, component: np.ndarray, x: np.ndarray, y: np.ndarray):
    """Places of the documents of ``x`` and ``y`` that may be similar, and by what share they differ at least.

    Without ``y``, those of ``x`` among themselves.  Two bitmaps are compared with the bits of the
    shorter one of these two, whatever else lies in the leaves: in fewer, those of long texts are full.
    """
    alone = not len(y)
    y = x if alone else y
    least, both = np.minimum(n[x][:, None], n[y]), n[x][:, None] + n[y]
    most = np.minimum(np.minimum(rest[x][:, None], rest[y]), least)
    open_ = (component[x][:, None] != component[y]) & (PARTS * least >= SHARE * (both - least)) & (
        PARTS * most >= SHARE * (both - most))
    i, j = np.nonzero(np.triu(open_, 1) if alone else open_)
    i, j = x[i], y[j]
    size = np.array([len(m) for m in maps], dtype=np.int64)
    width = np.minimum(size[i], size[j])
    only = np.zeros((len(i), 2), dtype=np.int64)
    for k in np.unique(width).tolist():
        at = np.flatnonzero(width == k)
        used, place = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        bits = folded([maps[d] for d in used.tolist()], k)
        own = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        p, q = place[:len(at)], place[len(at):]
        for part in np.array_split(np.arange(len(at)), max(1, len(at) * k >> 22)):
            common = np.bitwise_count(bits[p[part]] & bits[q[part]]).sum(axis=1, dtype=np.int64)
            only[at[part], 0], only[at[part], 1] = own[p[part]] - common, own[q[part]] - common
    kept = _room(n[i], n[j], only[:, 0], only[:, 1])
    i, j = i[kept], j[kept]
    return np.column_stack([i, j]), only[kept].sum(axis=1) / (n[i] + n[j])


def _forest(ends: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Places of the cheapest edges that connect as much as all of them do (Kruskal)."""
    ends = np.sort(ends, axis=1)
    order = np.lexsort((ends[:, 1], ends[:, 0], cost))
    _, first = np.unique(ends[order], axis=0, return_index=True)
    order = order[np.sort(first)]
    home: dict[int, int] = {}

    def find(x: int) -> int:
        while home.setdefault(x, x) != x:
            home[x] = x = home[home[x]]
        return x

    kept = []
    for at, (x, y) in zip(order.tolist(), ends[order].tolist()):
        x, y = find(x), find(y)
        if x != y:
            home[x] = y
            kept.append(at)
    return np.array(kept, dtype=np.int64)


MEMBERS = ["token", "band", "leaf", "node", "n", "rest", "component"]


def _tree_leaves(members: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dual traversal: root, bands, leaves.  The members in their leaves, and the pairs of leaves that are left.

    Bitmaps are too large to go along with every member; they are looked up where they are compared.
    """
    members = members.withColumn("band", F.floor(F.log(F.col("n")) / math.log(BAND)).cast("int"))
    counts = members.groupBy("token", "band").agg(F.ceil(F.count(F.lit(1)) / LEAF).alias("leaves"))
    members = saved(lookup_join(members, counts, ["token", "band"], "inner").withColumn(
        "leaf", F.pmod(F.xxhash64("node"), F.col("leaves")).cast("int")).select(*MEMBERS))
    narrow = signed.select("node", "bits").mapInArrow(_narrow, "node long, w array<long>")
    leaves = saved(_leaves(members.join(narrow, "node")))
    bands = leaves.groupBy("token", "band").agg(
        F.min("low_n").alias("low_n"), F.max("high_n").alias("high_n"), F.max("most").alias("most"),
        F.min("low_c").alias("low_c"), F.max("high_c").alias("high_c"), F.min("fewest").alias("fewest"),
        F.array(*[F.bit_or(F.col("or")[i]) for i in range(BITS // 64)]).alias("or"))
    pairs = _node_pairs(saved(bands), ["token", "band"], None)
    pairs = saved(_node_pairs(leaves, ["token", "band", "leaf"], pairs))
    # The leaves of a small root are compared together, so that each of its documents is sent once.
    small = members.groupBy("token").agg(F.count(F.lit(1)).alias("members")).where(f"members <= {LEAF}").select(
        "token", F.lit(True).alias("small"))
    pairs = lookup_join(pairs, small, ["token"], "left").withColumn(
        "pair", F.when(F.col("small"), F.xxhash64("token")).otherwise(F.xxhash64(*pairs.columns)))
    x = pairs.select("pair", "token", F.col("x_band").alias("band"), F.col("x_leaf").alias("leaf"), F.lit(0).alias("side"))
    y = pairs.where("x_band <> y_band or x_leaf <> y_leaf").select(
        "pair", "token", F.col("y_band").alias("band"), F.col("y_leaf").alias("leaf"),
        F.when(F.col("small"), 0).otherwise(1).alias("side"))
    return members, saved(x.union(y).distinct())


def _leaf_pairs(members: DataFrame, places: DataFrame, signed: DataFrame, sparing: bool) -> DataFrame:
    """``pair, u, v, more``: documents of the pairs of leaves that may be similar."""
    placed = places.join(members, ["token", "band", "leaf"]).select("pair", "side", "node", "n", "rest", "component")
    placed = placed.join(signed.select("node", "bits"), "node")
    buckets = partitions(session_of(members))
    return saved(placed.repartition(buckets, "pair").sortWithinPartitions("pair").mapInPandas(
        _document_pairs(sparing), "pair long, u long, v long, more boolean"))


def similar(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    docs = docs.select("doc_id", "text")
    levels = frequency_levels(docs.select("text"))
    with written() as folders:
        sets = saved(docs.mapInArrow(_describe(levels), SETS))
        roots = _roots(sets)
        # Of each class of equal sets, the row with the smallest doc_id stands for it.
        classes = saved(sets.where("n > 0 and doc_id is not null").groupBy("a", "b").agg(
            F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bits").alias("bits")))
        sets = saved(sets.select("doc_id", "n", "a", "b"))
    # First shingles and what was made of them on the way to the roots are not read again.
    remove_unread(folders, sets.crossJoin(classes).crossJoin(roots))
    signed = saved(lookup_join(classes, roots.select(F.col("alias").alias("a")).distinct(), ["a"], "left_semi"))
    members = saved(roots.join(signed.select(F.col("a").alias("alias"), "node", "n"), "alias")
                    .select("token", "node", "n", "rest", F.col("node").alias("component")).distinct())
    links = session_of(docs).createDataFrame([], "u long, v long")
    read = session_of(docs).createDataFrame([], "node long, set array<long>")
    found = None  # components of the links, as long as there are no newer ones
    if LEADERS:
        pairs = reduce(DataFrame.union, [_leader_pairs(members, turn) for turn in range(LEADERS)])
        pairs = _by_bitmaps(pairs.distinct(), signed)
        read = _whole_sets(docs, signed, pairs)
        links = _links(pairs, read)
        found = components(links)
        members = _with_components(members, found)
    members, places = _tree_leaves(_open_roots(members), signed)
    tested, sparing = None, True
    while places.head(1):
        met = _leaf_pairs(members, places, signed, sparing)
        pairs = met.select("u", "v").distinct()
        pairs = saved(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"))
        linked = None
        if pairs.head(1):
            known = read.select(F.col("node").alias("known"))
            new = pairs.join(known, F.col("u") == F.col("known"), "left_anti").select("u", F.col("u").alias("v")).union(
                pairs.join(known, F.col("v") == F.col("known"), "left_anti").select("v", F.col("v").alias("u")))
            read = read.union(_whole_sets(docs, signed, new))
            linked = _links(pairs, read)
            links = links.union(linked)
        if not sparing:
            found = found if linked is None else None
            break
        # Where pairs were left out, what is still apart is met again; without new links, in all pairs.
        places = saved(lookup_join(places, met.where("more").select("pair").distinct(), ["pair"], "left_semi"))
        tested = pairs if tested is None else tested.union(pairs)
        if linked is None or not linked.head(1):
            sparing = False
        elif places.head(1):
            found = components(links)
            members = _with_components(members, found)
        else:
            found = None
    found = components(links) if found is None else found
    belongs = saved(classes.join(found, "node", "left").select(
        "a", "b", F.coalesce("component", "node").alias("component")))
    rows = lookup_join(sets.select("doc_id", F.col("n").alias("n_shingles"), "a", "b"), belongs, ["a", "b"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return rows.select("doc_id", "n_shingles", own.alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, that of its smallest doc_id, with all columns; rows without a doc_id stay."""
    kept = similar(docs).where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    first = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns)))
    rows = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col("__kept"), "left_semi")
    return rows.withColumn("__first", first).where("__first = 1").drop("__first").select(*docs.columns).union(
        docs.where("doc_id is null"))
