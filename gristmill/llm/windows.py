"""Words and hashed windows of a column of texts, over whole Arrow batches at once.

A batch's string column is read as one array of bytes.  Prefix sums of ``value * r**position``
modulo 2**64 give the Rabin-Karp hash of any run of bytes or words by one subtraction and one
multiplication with the inverse power, so no loop runs over words or texts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# The functions travel with the plan, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text that are worked on at once; a longer text is worked on whole.
CHUNK = 1 << 21
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Splitmix finaliser: spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def byte_values() -> np.ndarray:
    return mix(np.arange(256, dtype=np.uint64), 7)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """base**0 .. base**(count - 1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < count:
        steps = np.full(max(count, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if count <= 2 * CHUNK:
            _POWERS[base] = have
    return have[:count]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Sums:
    """Hashes of runs of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: int) -> None:
        self.base = base
        self.total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * powers(base, len(values)), out=self.total[1:])
        self.back = powers(inverse(base), len(values) + 1)

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.back[start]

    def every(self, width: int) -> np.ndarray:
        """The hash of each run of ``width`` values, by its start."""
        count = len(self.total) - width
        if count <= 0:
            return np.zeros(0, dtype=np.uint64)
        return (self.total[width:] - self.total[:count]) * self.back[:count]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each text begins; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1] if len(column) \
        else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def chunks(column: pa.Array, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` (CHUNK) bytes: first row, end row, bytes, starts (and the end)."""
    size = size or CHUNK
    raw, at = text_buffers(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, side="right")) - 1)
        yield row, end, raw[at[row]:at[end]], at[row:end + 1] - at[row]
        row = end


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def white_space() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


def no_letters() -> np.ndarray:
    """Every byte but ASCII letters and those of other characters."""
    table = np.ones(256, dtype=bool)
    table[65:91] = table[97:123] = table[128:] = False
    return table


def word_places(
    raw: np.ndarray, at: np.ndarray, space: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text where its words begin (and the end).

    Words are maximal runs of bytes other than those that ``space`` marks: by default the six
    ASCII white-space characters.
    """
    if not len(raw):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(at), dtype=np.int64)
    blank = (white_space() if space is None else space)[raw]
    before = np.ones(len(raw) + 1, dtype=bool)
    before[1:] = blank
    after = before[1:].copy()
    after[:-1] = blank[1:]
    after[-1] = True
    inner = at[(at > 0) & (at < len(raw))]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(~blank & before[:-1])
    ends = np.flatnonzero(~blank & after) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sums = Sums(byte_values()[raw], BYTE_BASE)
    with np.errstate(over="ignore"):
        return mix(sums.runs(starts, ends) + (ends - starts).astype(np.uint64))
