"""Best-fit packing of tokenised documents into sequences of bounded length.

1. Tokenise every text and cut it into pieces of at most ``limit`` tokens; the pieces' lengths
   are written to the shared folder, the tokens are not kept.
2. Count the pieces of each length: a histogram of at most ``limit`` rows, whatever the corpus.
3. On the histogram, Martello and Toth's dominance reduction fixes sets of pieces that no other
   set holding the piece can beat; what is left is packed by best fit, largest first.  Both work
   on counts, so that the plan's size depends on ``limit`` alone.
4. A piece finds its sequence from its length and its rank among the pieces of that length.

Defined results: a null or empty text is the end token alone; texts longer than ``limit`` give
several pieces, the last of which may be shorter; rows that repeat are packed each for itself;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.shared import saved, session_of, spread_rank, without

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words whose tokens a worker remembers before it starts afresh.
REMEMBERED_WORDS = 1_000_000

Pattern = tuple[int, list[tuple[int, int]]]  # how many sequences, of (length, pieces of it)


class WordTokens(dict):
    """The packed tokens of a word, found once and remembered; a worker keeps it from task to task.

    White space never joins two words' tokens.  A word of letters alone is one unit of the
    tokenizer's own splitting, so it goes to the model without the steps that split texts, and so
    does one with a full stop or comma after it; all other words take the whole way.
    """

    def __init__(self, tokenizer_json: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.source = hash(tokenizer_json)
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        # Byte-level models write a byte as a character: the printable ones as themselves, the
        # others as characters from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        settings = json.loads(tokenizer_json)
        steps = settings["normalizer"] or {}
        kinds = [n["type"] for n in steps.get("normalizers", [steps])]
        self.shortcut = kinds == ["NFC", "Replace", "Lowercase"] and "[\\p{L}]+" in json.dumps(
            settings["pre_tokenizer"]).replace("\\\\", "\\")

    def _encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        text = word.decode()
        if not self.shortcut:
            found = self._encoded(text)
        elif text.isalpha():
            if text.isascii():
                text = text.lower()
            elif "\u03a3" in text or "\u0130" in text or not unicodedata.is_normalized("NFC", text):
                text = ""
            else:
                text = "".join(map(self.letters.__getitem__, text.lower().encode()))
            found = (np.array([t.id for t in self.model.tokenize(text)], dtype="<u4").tobytes() if text
                     else self._encoded(word.decode()))
        elif text[-1] in ".," and text[:-1].isalpha():
            found = self[word[:-1]] + self[word[-1:]]
        else:
            found = self._encoded(text)
        self[word] = found
        return found


_WORDS: list[WordTokens] = []


def _words(tokenizer_json: str) -> WordTokens:
    if not _WORDS or _WORDS[0].source != hash(tokenizer_json):
        _WORDS[:] = [WordTokens(tokenizer_json)]
    return _WORDS[0]


def _tokenise(tokenizer_json: str, limit: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens_of = _words(tokenizer_json).__getitem__
        end, step = end_id.to_bytes(4, "little"), 4 * limit
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            ids, pieces, starts, lengths, sums = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                blob = b"".join(map(tokens_of, (text or b"").split())) + end
                for piece, at in enumerate(range(0, len(blob), step)):
                    part = blob[at:at + step]
                    ids.append(doc_id)
                    pieces.append(piece)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()),
            ], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer_path: str, limit: int = 4096, end_id: int = 1) -> DataFrame:
    """The pieces of every text: ``doc_id, piece, start, length, ids_crc32``."""
    run = _tokenise(Path(tokenizer_path).read_text(encoding="utf-8"), limit, end_id)
    return without(docs, "doc_id", "text").mapInArrow(run, PIECES)


class _Sizes:
    """Counts by length, with the lengths that still have pieces in order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.left = {s: n for s, n in counts.items() if n > 0}
        self.order = sorted(self.left)

    def take(self, size: int, count: int) -> None:
        self.left[size] -= count
        if not self.left[size]:
            del self.left[size]
            self.order.pop(bisect.bisect_left(self.order, size))

    def smallest_without(self, size: int, count: int) -> list[int]:
        """The ``count`` smallest lengths, one piece of ``size`` left out."""
        out: list[int] = []
        for s in self.order:
            out += [s] * min(count - len(out), self.left[s] - (s == size))
            if len(out) == count:
                break
        return out

    def largest_within(self, room: int, used: tuple[int, ...]) -> int | None:
        """The largest length up to ``room`` of which a piece is left besides ``used``."""
        at = bisect.bisect_right(self.order, room) - 1
        while at >= 0:
            s = self.order[at]
            if self.left[s] > used.count(s):
                return s
            at -= 1
        return None


def _dominating(sizes: _Sizes, s: int, limit: int) -> tuple[int, ...] | None:
    """Partners that, with a piece of length ``s``, dominate every other set holding it."""
    least = sizes.smallest_without(s, 3)
    if not least or s + least[0] > limit:
        return ()
    one = sizes.largest_within(limit - s, (s,))
    if s + one == limit or len(least) < 2 or s + least[0] + least[1] > limit:
        return (one,)
    if len(least) < 3 or s + sum(least) > limit:
        # At most two partners fit.  (one, two) dominates if two is also the largest that could
        # ever be the smaller of two partners.
        two = sizes.largest_within(limit - s - one, (s, one))
        half = sizes.largest_within((limit - s) // 2, (s,))
        if two is not None and two == half:
            return (one, two)
    return None


def reduce_by_dominance(counts: dict[int, int], limit: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fixed sequences, and the counts that remain (Martello and Toth's reduction on counts)."""
    sizes, fixed, changed = _Sizes(counts), [], True
    while changed:
        changed = False
        for s in sorted(sizes.left, reverse=True):
            while s in sizes.left:
                partners = _dominating(sizes, s, limit)
                if partners is None:
                    break
                used: dict[int, int] = {}
                for size in (s, *partners):
                    used[size] = used.get(size, 0) + 1
                # What dominates once does so as long as there are such pieces.
                times = min(sizes.left[size] // k for size, k in used.items())
                for size, k in used.items():
                    sizes.take(size, k * times)
                fixed.append((times, sorted(used.items(), reverse=True)))
                changed = True
    return fixed, sizes.left


def best_fit(counts: dict[int, int], limit: int) -> list[Pattern]:
    """Best fit, largest first, on counts: equal pieces fill equal sequences together."""
    open_: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []

    def put(room: int, times: int, content: tuple) -> None:
        if room not in open_:
            bisect.insort(rooms, room)
            open_[room] = []
        open_[room].append((times, content))

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            at = bisect.bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                times, content = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                room, content = limit, ()
                times = max(1, left // (limit // s))
            k = room // s
            full = min(times, left // k)
            if full:
                put(room - k * s, full, (*content, (s, k)))
                left -= full * k
            rest = times - full
            if rest and left and left < k:
                put(room - left * s, 1, (*content, (s, left)))
                rest, left = rest - 1, 0
            if rest and content:
                put(room, rest, content)
    return [(times, list(content)) for groups in open_.values() for times, content in groups]


def plan(counts: dict[int, int], limit: int) -> list[Pattern]:
    fixed, rest = reduce_by_dominance(counts, limit)
    return fixed + best_fit(rest, limit)


def _places(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, pieces in each sequence, first sequence, offset), by the first two."""
    rows, ranks, sequence = [], {}, 0
    for times, content in patterns:
        offset = 0
        for size, k in content:
            first = ranks.get(size, 0)
            ranks[size] = first + times * k
            rows.append((size, first, k, sequence, offset))
            offset += size * k
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _assign(places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        keys = (table[:, 0] << 44) | table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            row = table[np.searchsorted(keys, (length << 44) | rank, side="right") - 1]
            in_order = rank - row[:, 1]
            columns = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([
                *columns, pa.array(row[:, 3] + in_order // row[:, 2]),
                pa.array(row[:, 4] + in_order % row[:, 2] * length),
            ], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_pieces(cut: DataFrame, limit: int = 4096) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces."""
    spark = session_of(cut)
    # At most ``limit`` rows come to the driver, whatever the corpus.
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # The plan has at most 4 patterns per length, and each at most sqrt(2 * limit) lengths.
    places = spark.sparkContext.broadcast(_places(plan(counts, limit)))
    ranked = spread_rank(cut, "length", ("doc_id", "piece", "ids_crc32"), "rank")
    return ranked.mapInArrow(_assign(places), PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, limit: int = 4096, end_id: int = 1) -> DataFrame:
    return pack_pieces(saved(pieces(docs, tokenizer_path, limit, end_id)), limit)
