"""Byte dedup by a depth-limited radix sort of suffixes: remove strings of ``depth`` bytes seen in earlier texts.

Only the first ``depth`` bytes of a suffix matter, so suffixes are never ordered further than
that, and a group that holds one text leaves the sort at once.  The passes, most significant
digit first:

1. Every window of ``depth`` bytes is named by its anchor: the leftmost of its ``GRAM``-byte
   strings of least hash.  Equal windows have equal anchors at equal offsets, and an anchor stands
   for about 18 windows, so that the first pass deals out anchors instead of all suffixes, each with
   a hash of its context: all bytes of its windows.  Anchors that occur once drop out.  Of equal
   contexts only those of the least doc_id go on, and only if their anchor has other contexts too;
   the windows of the others are late as a whole.
2. The windows of the anchors that are left, ``GRAM + 2 * (depth - GRAM)`` bytes around each, are
   dealt by the anchor; within a bucket each offset is a further digit, and windows whose hashes
   of all ``depth`` bytes agree form one group.  A group is exactly a repeated window; those of
   its texts with a larger doc_id than its least lose it.

The first pass settles equal contexts within a run of texts before the shuffle, so a passage that a
third of all texts hold is a few rows per task.  Tasks read their buckets batch by batch; records
beyond ``parts.LIMIT`` go to temporary files by further digits, so memory grows neither with a
bucket nor with the places of one anchor.

Defined results: a null text has no bytes; shorter texts than ``depth`` stay whole; a null doc_id
comes before all others; rows of one doc_id never take from each other (rows that differ in their
text are told apart by a hash of it); an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import blobs, parts
from gristmill.llm import windows as win
from gristmill.llm.shared import partitions, saved, session_of
from gristmill.llm.windows_dedup import FIRST_ID, identified

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAM = 16
OTHER_BASE = 0xBF58476D1CE4E5B9 | 5
#: Bytes of text that are hashed at once, and that are packed together; contexts likewise.
CHUNK, PACK = 1 << 19, 1 << 23
CONTEXTS, PACKED_CONTEXTS = 10_000, 100_000
#: Packed rows that are opened at once, findings that are scattered together, and texts that are cut at once.
ROWS, FINDINGS, TEXTS = 64, 1 << 18, 500
NAMED = np.dtype([("context", "u8"), ("key", "u4")])
PLACE = np.dtype([("context", "u8"), ("id", "i8"), ("text", "i8"), ("key", "u4"), ("number", "u4")])
WINDOW = np.dtype([("hash", "u8"), ("id", "i8"), ("text", "i8"), ("begin", "u4")])
NUMBERS = np.dtype([("id", "i8"), ("text", "i8"), ("number", "u4")])
INTERVALS = np.dtype([("id", "i8"), ("text", "i8"), ("begin", "u4"), ("end", "u4")])
SCATTERED_ARROW = pa.schema([
    ("dest", pa.int32()), ("docs", pa.binary()), ("texts", pa.binary()), ("counts", pa.binary()), ("numbers", pa.binary())])
BY_TEXT_ARROW = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("numbers", pa.binary())])
#: Known rows hold late intervals: ``places`` their begins, ``rights`` their lengths.
CONTEXT_ROWS = "bucket int, contexts binary, lefts binary, rights binary, places binary, docs binary, texts binary, known boolean"
CONTEXT_ARROW = pa.schema([
    ("bucket", pa.int32()), ("contexts", pa.binary()), ("lefts", pa.binary()), ("rights", pa.binary()),
    ("places", pa.binary()), ("docs", pa.binary()), ("texts", pa.binary()), ("known", pa.bool_())])


def anchors(raw: np.ndarray, at: np.ndarray, depth: int):
    """Anchors in order: position, its text, the first and the last window that it names, gram hashes."""
    none = np.zeros(0, dtype=np.int64)
    if len(raw) < depth:
        return none, none, none, none, None
    values = win.byte_values()[raw]
    grams = win.Sums(values, win.BYTE_BASE).every(GRAM)
    place = np.arange(len(grams), dtype=np.uint64)
    least = (win.mix(grams) & np.uint64(0xFFFFFFFF00000000)) | place
    span, reach = depth - GRAM + 1, 1
    while 2 * reach <= span:
        least = np.minimum(least[:len(least) - reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[:len(least) - (span - reach)], least[span - reach:])
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    starts = np.flatnonzero(of[:len(of) - depth + 1] == of[depth - 1:])
    if not len(starts):
        return none, none, none, none, None
    named = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = blobs.runs(named)
    last = np.append(first[1:], len(named)) - 1
    return named[first], of[starts[first]], starts[first], starts[last], (values, grams)


def _context_hashes(values: np.ndarray, position, first, last, depth: int) -> np.ndarray:
    """64 bits of all that the windows of an anchor hold, and of where it lies in them."""
    full = win.Sums(values, win.BYTE_BASE).runs(first, last + depth)
    where = ((position - first) * depth + position - last).astype(np.uint64)
    return win.mix(full + win.mix(where, 3), 4)


def _anchor_hashes(values: np.ndarray, position) -> np.ndarray:
    return win.mix(win.Sums(values, OTHER_BASE).runs(position, position + GRAM), 2)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _deal_anchors(depth: int, buckets: int):
    """Deal out every anchor: 32 bits of its hash, its context's hash, and its number in its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids, all_texts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            held, begin, size = [], 0, 0
            for row, end, raw, at in win.chunks(batch.column(2), CHUNK):
                position, of, first, last, hashed = anchors(raw, at, depth)
                size += len(raw)
                if hashed is not None:
                    hashes = _anchor_hashes(hashed[0], position)
                    held.append((
                        _context_hashes(hashed[0], position, first, last, depth), hashes.astype(np.uint32),
                        _bucket(hashes, buckets).astype(np.int32), (of + row - begin).astype(np.int32)))
                if held and (size >= PACK or end == len(all_ids)):
                    yield _packs(*[np.concatenate(c) for c in zip(*held)], all_ids[begin:end], all_texts[begin:end], buckets)
                if size >= PACK:
                    held, begin, size = [], end, 0

    return run


def _packs(contexts, keys, bucket, of, ids, texts, buckets: int) -> pa.RecordBatch:
    """Of equal contexts within the run only those of the least id are dealt out; the others are known to be late."""
    counts = np.bincount(of, minlength=len(ids))
    order = np.argsort(contexts)
    runs = blobs.runs(contexts[order])
    late = np.zeros(len(order), dtype=bool)
    if len(runs) < len(order):
        several = np.repeat(np.diff(np.append(runs, len(order))) > 1, np.diff(np.append(runs, len(order))))
        order = order[several]
        late[order] = ~blobs.least_in_runs(blobs.runs(contexts[order]), ids[of[order]])
    rows = []
    if late.any():
        rows.append(blobs.packed(-1, keys[:0], np.flatnonzero(late), of, ids, texts, counts, True, buckets))
    named = np.empty(len(keys), dtype=NAMED)
    named["context"], named["key"] = contexts, keys
    kept = np.flatnonzero(~late)
    by_bucket = kept[np.argsort(bucket[kept], kind="stable")]
    edges = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
    for b in range(buckets):
        own = by_bucket[edges[b]:edges[b + 1]]
        if len(own):
            rows.append(blobs.packed(b, named[own], own, of, ids, texts, counts, False, buckets))
    return blobs.packs(rows)


def _rows(batch: pa.RecordBatch) -> Iterator:
    """The rows of a batch, few at once outside of Arrow."""
    for a in range(0, batch.num_rows, ROWS):
        yield from batch.slice(a, ROWS).to_pandas().itertuples()


def _scattered(found: Iterator[tuple], buckets: int, settle=lambda *columns: columns) -> Iterator[pa.RecordBatch]:
    """Findings ``ids, texts, numbers ...``, collected, settled and packed by bucket of texts."""
    def packed() -> pa.RecordBatch:
        columns = settle(*[np.concatenate(c) for c in zip(*held)])
        return pa.RecordBatch.from_pandas(blobs.scattered(buckets, *columns), SCATTERED_ARROW, preserve_index=False)

    held, size = [], 0
    for columns in found:
        if len(columns[0]):
            held.append(columns)
            size += len(columns[0])
        if size >= FINDINGS:
            yield packed()
            held, size = [], 0
    if held:
        yield packed()


def _filled(kind: np.dtype, *columns: np.ndarray) -> np.ndarray:
    """Records of these columns, in the order of their names."""
    records = np.empty(len(columns[0]), dtype=kind)
    for name, column in zip(kind.names, columns):
        records[name] = column
    return records


def _least(heap: parts.Heap) -> int:
    return min(int(block["id"].min()) for block in heap.blocks())


def _code(records: np.ndarray, late: bool) -> tuple:
    """An anchor's number in its text, twice, and one more if all its windows are late."""
    return records["id"], records["text"], records["number"].astype(np.int64) * 2 + late


def _judged(r: np.ndarray, several: bool = False) -> Iterator[tuple]:
    """Anchors whose context an earlier text holds, and the first of each context if its anchor has others (or ``several``)."""
    order = np.argsort(r["context"])
    context = r["context"][order]
    runs = blobs.runs(context)
    lengths = np.diff(np.append(runs, len(order)))
    least = np.ones(len(order), dtype=bool)
    if len(runs) < len(order):
        some = np.repeat(lengths > 1, lengths)
        least[some] = blobs.least_in_runs(blobs.runs(context[some]), r["id"][order[some]])
        yield _code(r[order[~least]], True)
    keys = r["key"][order[runs]]
    by_key = np.argsort(keys)
    same = blobs.runs(keys[by_key])
    sizes = np.diff(np.append(same, len(by_key)))
    others = np.empty(len(runs), dtype=bool)
    others[by_key] = np.repeat(sizes > 1, sizes) | several
    yield _code(r[order[least & np.repeat(others, lengths)]], False)


def _judged_heap(heap: parts.Heap) -> Iterator[tuple]:
    """The same of a single anchor that has too many places for memory."""
    contexts = [(b["context"].min(), b["context"].max()) for b in heap.blocks()]
    several = min(a for a, _ in contexts) < max(b for _, b in contexts)
    for part in parts.parts(heap.blocks(), lambda r: r["context"]):
        if isinstance(part, np.ndarray):
            yield from _judged(part, several)
            continue
        least = _least(part)
        for block in part.blocks():
            late = block["id"] > least
            yield _code(block[late], True)
            if several:
                yield _code(block[~late], False)


def _repeated_anchors(buckets: int):
    """Of one task's buckets: the anchors that are late, and those that need to be looked at byte by byte."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known = parts.Heap(NUMBERS)

        def fresh() -> Iterator[np.ndarray]:
            for batch in batches:
                for row in _rows(batch):
                    ids, texts, numbers = blobs.unpacked(row)
                    if row.known:
                        known.add(_filled(NUMBERS, ids, texts, numbers))
                    else:
                        named = np.frombuffer(row.keys, dtype=NAMED)
                        yield _filled(PLACE, named["context"], ids, texts, named["key"], numbers)

        for part in parts.parts(fresh(), lambda r: r["key"].astype(np.uint64) << np.uint64(32)):
            yield from _judged(part) if isinstance(part, np.ndarray) else _judged_heap(part)
        with known.file:
            for block in known.blocks():
                yield _code(block, True)

    return lambda batches: _scattered(found(batches), buckets)


def _by_text(kind: np.dtype, settle=lambda *columns: columns):
    """Of one task's buckets of texts: each text's settled numbers."""
    names = kind.names[2:]

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                yield _filled(kind, *blobs.gathered(batch.slice(a, ROWS).to_pandas(), len(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts.parts(gathered(batches), lambda r: win.mix(win.mix(
                r["id"].astype(np.uint64), 5) + r["text"].astype(np.uint64), 6)):
            part = part if isinstance(part, np.ndarray) else part.whole()
            columns = settle(part["id"], part["text"], *[part[n].astype(np.int64) for n in names])
            yield pa.RecordBatch.from_pandas(blobs.by_text(*columns), BY_TEXT_ARROW, preserve_index=False)

    return run


def _contexts(depth: int, buckets: int):
    """Late anchors become intervals; the bytes around the others that repeat are dealt out."""
    reach = depth - GRAM
    column = np.arange(reach + depth)

    def looked_at(raw, at, ids, texts, numbers):
        """Late intervals, and records with their buckets, of one run of texts."""
        position, of, first, last, hashed = anchors(raw, at, depth)
        if hashed is None:
            return None
        codes = [np.frombuffer(n.as_py(), dtype=np.uint32) for n in numbers]
        text = np.repeat(np.arange(len(ids)), [len(c) for c in codes])
        codes = np.concatenate(codes)
        chosen = np.searchsorted(of, text) + (codes >> 1).astype(np.int64)
        there = chosen < len(of)
        there[there] = of[chosen[there]] == text[there]  # else two texts of one hash
        late, chosen = (codes & 1).astype(bool)[there], chosen[there]
        begin, end = first[chosen] - at[of[chosen]], last[chosen] - at[of[chosen]] + depth
        gone = blobs.merged(ids[of[chosen[late]]], texts[of[chosen[late]]], begin[late], end[late])
        chosen = np.unique(chosen[~late])
        position, of, first, last = position[chosen], of[chosen], first[chosen], last[chosen]
        r = np.empty(len(chosen), dtype=_context_kind(depth))
        r["id"], r["text"], r["start"] = ids[of], texts[of], first - at[of]
        r["left"], r["right"] = position - first, position - last
        # Bytes outside of the anchor's windows are zero, so that equal windows are equal rows.
        padded = np.concatenate([np.zeros(reach, np.uint8), raw, np.zeros(depth, np.uint8)])
        for a in range(0, len(r), CONTEXTS):
            part = r[a:a + CONTEXTS]
            context = padded[position[a:a + CONTEXTS, None] + column]
            context[(column < reach - part["left"][:, None].astype(int))
                    | (column >= reach - part["right"][:, None].astype(int) + depth)] = 0
            part["bytes"] = context
        return gone, r, _bucket(_anchor_hashes(hashed[0], position), buckets)

    def rows(held) -> pa.RecordBatch | None:
        late = [np.concatenate(c) for c in zip(*[h[0] for h in held])]
        out = []
        if len(late[0]):
            ids, texts, begin, end = late
            out.append((int(ids[0]) % buckets, b"", b"", blobs.planes((end - begin).astype(np.uint32)),
                        blobs.planes(begin.astype(np.uint32)), blobs.planes(blobs.steps(ids)), texts.tobytes(), True))
        r, bucket = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        by_bucket = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
        for b in range(buckets):
            own = by_bucket[edges[b]:edges[b + 1]]
            if len(own):
                out.append(_context_row(b, r[own]))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), CONTEXT_ARROW.types)], schema=CONTEXT_ARROW) if out else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids, all_texts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            held, size = [], 0
            for row, end, raw, at in win.chunks(batch.column(2), CHUNK):
                found = looked_at(raw, at, all_ids[row:end], all_texts[row:end], batch.column(3).slice(row, end - row))
                if found is not None:
                    held.append(found)
                    size += len(found[1])
                if held and (size >= PACKED_CONTEXTS or end == len(all_ids)):
                    packed = rows(held)
                    if packed is not None:
                        yield packed
                    held, size = [], 0

    return run


def _context_kind(depth: int) -> np.dtype:
    return np.dtype([("id", "i8"), ("text", "i8"), ("start", "u4"), ("left", "u1"), ("right", "u1"),
                     ("bytes", "u1", (2 * depth - GRAM,))])


def _context_row(bucket: int, r: np.ndarray) -> tuple:
    import zstandard

    return (bucket, zstandard.ZstdCompressor(level=1).compress(r["bytes"].tobytes()), r["left"].tobytes(),
            r["right"].tobytes(), blobs.planes(r["start"]), blobs.planes(blobs.steps(r["id"])), r["text"].tobytes(), False)


def _records(row, depth: int) -> np.ndarray:
    """The records that ``_context_row`` has packed."""
    import zstandard

    r = np.empty(len(row.lefts), dtype=_context_kind(depth))
    r["bytes"] = np.frombuffer(
        zstandard.ZstdDecompressor().decompress(row.contexts), dtype=np.uint8).reshape(len(r), -1)
    r["left"], r["right"] = np.frombuffer(row.lefts, dtype=np.uint8), np.frombuffer(row.rights, dtype=np.uint8)
    r["start"], r["id"] = blobs.unplaned(row.places, "u4"), np.cumsum(blobs.unplaned(row.docs, "i8"))
    r["text"] = np.frombuffer(row.texts, dtype=np.int64)
    return r


def _late_in(r: np.ndarray, depth: int) -> Iterator[tuple]:
    """Windows of these contexts that an earlier text holds too."""
    width = 2 * depth - GRAM
    windows = np.empty((len(r), depth - GRAM + 1), dtype=np.uint64)
    # Column j: the window that begins j bytes before the last possible one.
    back = win.powers(win.inverse(win.BYTE_BASE), width + 1)[:width - depth + 1]
    for a in range(0, len(r), CONTEXTS):
        values = win.byte_values()[r["bytes"][a:a + CONTEXTS]] * win.powers(win.BYTE_BASE, width)
        sums = np.zeros((len(values), width + 1), dtype=np.uint64)
        np.cumsum(values, axis=1, out=sums[:, 1:])
        windows[a:a + CONTEXTS] = (sums[:, depth:] - sums[:, :width - depth + 1]) * back
    left, right, start = (r[n].astype(np.int64) for n in ("left", "right", "start"))
    # An offset is one digit: equal windows lie equally far before their anchor.
    for offset in range(depth - GRAM + 1):
        has = np.flatnonzero((right <= offset) & (offset <= left))
        if len(has) < 2:
            continue
        hashes = windows[has, depth - GRAM - offset]
        order = np.argsort(hashes)
        runs = blobs.runs(hashes[order])
        if len(runs) == len(order):
            continue
        late = has[order[~blobs.least_in_runs(runs, r["id"][has][order])]]
        begin = start[late] + left[late] - offset
        yield r["id"][late], r["text"][late], begin, begin + depth


def _late_in_heap(heap: parts.Heap, depth: int) -> Iterator[tuple]:
    """The same of a single anchor that has too many contexts for memory: one offset after the other."""
    powers = win.powers(win.BYTE_BASE, depth)

    def windows(offset: int) -> Iterator[np.ndarray]:
        for r in heap.blocks():
            r = r[(r["right"] <= offset) & (offset <= r["left"])]
            out = np.empty(len(r), dtype=WINDOW)
            a = depth - GRAM - offset
            out["hash"] = (win.byte_values()[r["bytes"][:, a:a + depth]] * powers).sum(axis=1, dtype=np.uint64)
            out["id"], out["text"] = r["id"], r["text"]
            out["begin"] = r["start"].astype(np.int64) + r["left"] - offset
            if len(out):
                yield out

    def found(r: np.ndarray, late: np.ndarray) -> tuple:
        begin = r["begin"][late].astype(np.int64)
        return r["id"][late], r["text"][late], begin, begin + depth

    for offset in range(depth - GRAM + 1):
        for part in parts.parts(windows(offset), lambda r: win.mix(r["hash"], 5)):
            if isinstance(part, np.ndarray):
                order = np.argsort(part["hash"])
                runs = blobs.runs(part["hash"][order])
                yield found(part, order[~blobs.least_in_runs(runs, part["id"][order])])
                continue
            least = _least(part)
            for block in part.blocks():
                yield found(block, block["id"] > least)


def _late_windows(depth: int, buckets: int):
    """Of one task's buckets: intervals of bytes covered by windows that an earlier text holds too."""
    reach = depth - GRAM

    def anchor(r: np.ndarray) -> np.ndarray:
        halves = np.ascontiguousarray(r["bytes"][:, reach:reach + GRAM]).view(np.uint64)
        return win.mix(win.mix(halves[:, 0], 5) + halves[:, 1], 6)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known = parts.Heap(INTERVALS)

        def fresh() -> Iterator[np.ndarray]:
            for batch in batches:
                for row in _rows(batch):
                    if row.known:
                        begin = blobs.unplaned(row.places, "u4")
                        known.add(_filled(
                            INTERVALS, np.cumsum(blobs.unplaned(row.docs, "i8")), np.frombuffer(row.texts, dtype=np.int64),
                            begin, begin + blobs.unplaned(row.rights, "u4")))
                    else:
                        yield _records(row, depth)

        for part in parts.parts(fresh(), anchor):
            yield from _late_in(part, depth) if isinstance(part, np.ndarray) else _late_in_heap(part, depth)
        with known.file:
            for block in known.blocks():
                yield block["id"], block["text"], block["begin"].astype(np.int64), block["end"].astype(np.int64)

    return lambda batches: _scattered(found(batches), buckets, blobs.merged)


def repeated_bytes(docs: DataFrame, depth: int = 50) -> DataFrame:
    """``id, text_hash, numbers``: packed (begin, end) pairs of bytes that an earlier text holds too."""
    buckets = partitions(session_of(docs))
    rows = identified(docs)
    dealt = rows.mapInArrow(_deal_anchors(depth, buckets), blobs.PACKED_COLUMNS)
    often = dealt.repartition(buckets, "bucket").mapInArrow(_repeated_anchors(buckets), blobs.SCATTERED)
    often = saved(often.repartition(buckets, "dest").mapInArrow(_by_text(NUMBERS), blobs.BY_TEXT))
    found = rows.join(often, ["id", "text_hash"]).select("id", "text_hash", "text", "numbers")
    around = found.mapInArrow(_contexts(depth, buckets), CONTEXT_ROWS)
    late = around.repartition(buckets, "bucket").mapInArrow(_late_windows(depth, buckets), blobs.SCATTERED)
    return saved(late.repartition(buckets, "dest").mapInArrow(_by_text(INTERVALS, blobs.merged), blobs.BY_TEXT))


def _cut(text: bytes, spans: bytes | None) -> tuple[bytes, int, int]:
    """The bytes that stay, how many go, and in how many runs."""
    if spans is None or not text:
        return text, 0, 0
    gone = blobs.covered(len(text), spans)
    kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
    return kept, int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


def dedup_report(docs: DataFrame, depth: int = 50) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, count, digests = [], [], [], []
            for a in range(0, batch.num_rows, TEXTS):
                some = batch.slice(a, TEXTS)
                texts = some.column("text").cast(pa.large_binary()).to_pylist()
                for text, spans in zip(texts, some.column("numbers").to_pylist()):
                    text = text or b""
                    kept, gone, n = _cut(text, spans)
                    sizes.append(len(text))
                    removed.append(gone)
                    count.append(n)
                    digests.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(count, pa.int64()), pa.array(digests, pa.string()),
            ], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    docs = docs.select("doc_id", "text")
    marked = docs.withColumns({"id": F.coalesce("doc_id", F.lit(FIRST_ID)), "text_hash": F.xxhash64("text")})
    found = marked.join(repeated_bytes(docs, depth), ["id", "text_hash"], "left")
    return found.select("doc_id", "text", "numbers").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
