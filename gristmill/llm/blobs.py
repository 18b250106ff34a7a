"""Packed columns of numbers: what tasks send each other instead of one row per window."""

from __future__ import annotations

import sys
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

from gristmill.llm import windows as win

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def planes(values: np.ndarray) -> bytes:
    """Integers with equal bytes of all values side by side, so that small values compress to little."""
    width = values.dtype.itemsize
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes()


def unplaned(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(data, dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind)


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of neighbours, from 0."""
    return np.diff(values, prepend=values.dtype.type(0))


def least_in_runs(first: np.ndarray, *orders: np.ndarray) -> np.ndarray:
    """Which rows hold the least tuple of ``orders`` in their run; runs begin at ``first``."""
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(orders[0]))))
    least = np.ones(len(orders[0]), dtype=bool)
    for values in orders:
        top = np.iinfo(values.dtype).max
        masked = np.where(least, values, top)
        least &= masked == np.minimum.reduceat(masked, first)[run]
    return least


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    change = np.ones(len(sorted_keys), dtype=bool)
    change[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(change)


#: Places in texts, packed for one bucket: keys, numbers of places counted through all texts of
#: the pack, and each text's id, hash and number of places.  ``known``: no answer is needed.
PACKED_COLUMNS = "bucket int, keys binary, places binary, docs binary, texts binary, counts binary, known boolean"
PACKED = pa.schema([
    ("bucket", pa.int32()), ("keys", pa.binary()), ("places", pa.binary()), ("docs", pa.binary()),
    ("texts", pa.binary()), ("counts", pa.binary()), ("known", pa.bool_())])
#: Places by text: packed unsigned 32-bit numbers.
BY_TEXT = "id long, text_hash long, numbers binary"


def packed(bucket, keys, places, of, ids, texts, counts, known, buckets) -> tuple:
    """Pack places with the texts that they come from, and no others.

    ``places`` count through all texts of the run, ``of`` names each place's text, ``counts`` has
    the number of places of each.  A bucket below 0 is chosen by the first text.
    """
    docs = np.unique(of[places])
    new_first = np.zeros(len(docs), dtype=np.int64)
    np.cumsum(counts[docs][:-1], out=new_first[1:])
    old_first = np.cumsum(counts) - counts
    at = np.searchsorted(docs, of[places])
    places = places - old_first[docs][at] + new_first[at]
    bucket = int(ids[docs[0]]) % buckets if bucket < 0 else bucket
    return (bucket, keys.tobytes(), planes(steps(places.astype(np.uint32))), planes(steps(ids[docs])),
            texts[docs].tobytes(), planes(counts[docs].astype(np.uint32)), known)


def packs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), PACKED.types)], schema=PACKED)


def unpacked(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """id, text hash and place within its text of each packed place."""
    places = np.cumsum(unplaned(row.places, "u4"), dtype=np.uint32).astype(np.int64)
    ids = np.cumsum(unplaned(row.docs, "i8"))
    texts = np.frombuffer(row.texts, dtype=np.int64)
    counts = unplaned(row.counts, "u4").astype(np.int64)
    first = np.cumsum(counts) - counts
    doc = np.searchsorted(first, places, side="right") - 1
    return ids[doc], texts[doc], places - first[doc]


def by_text(ids: np.ndarray, texts: np.ndarray, *numbers: np.ndarray) -> pd.DataFrame:
    """One row for each text with its numbers, side by side when there are several, packed in order."""
    order = np.lexsort((*reversed(numbers), texts, ids))
    ids, texts = ids[order], texts[order]
    table = np.column_stack([n[order] for n in numbers]).astype(np.uint32)
    change = np.ones(len(ids), dtype=bool)
    change[1:] = (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1])
    edges = np.flatnonzero(change)
    bounds = np.append(edges, len(ids))
    return pd.DataFrame({
        "id": ids[edges], "text_hash": texts[edges],
        "numbers": [table[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]})


#: Numbers by text, packed for the bucket of the text.
SCATTERED = "dest int, docs binary, texts binary, counts binary, numbers binary"


def scattered(buckets: int, ids: np.ndarray, texts: np.ndarray, *numbers: np.ndarray) -> pd.DataFrame:
    """One row for each bucket of texts, however many texts it holds."""
    rows = []
    if len(ids):
        dest = (win.mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((*reversed(numbers), texts, ids, dest))
        dest, ids, texts = dest[order], ids[order], texts[order]
        table = np.column_stack([n[order] for n in numbers]).astype(np.uint32)
        for a, b in pairwise(np.append(runs(dest), len(dest)).tolist()):
            new = np.ones(b - a, dtype=bool)
            new[1:] = (ids[a + 1:b] != ids[a:b - 1]) | (texts[a + 1:b] != texts[a:b - 1])
            first = np.flatnonzero(new)
            rows.append((
                int(dest[a]), planes(steps(ids[a:b][first])), texts[a:b][first].tobytes(),
                planes(np.diff(np.append(first, b - a)).astype(np.uint32)),
                b"".join(planes(steps(c)) for c in table[a:b].T)))
    return pd.DataFrame(rows, columns=["dest", "docs", "texts", "counts", "numbers"])


def gathered(rows: pd.DataFrame, width: int) -> list[np.ndarray]:
    """ids, texts and ``width`` columns of numbers of packed rows."""
    out = []
    for r in rows.itertuples():
        counts = unplaned(r.counts, "u4").astype(np.int64)
        size = 4 * int(counts.sum())
        out.append((
            np.repeat(np.cumsum(unplaned(r.docs, "i8")), counts),
            np.repeat(np.frombuffer(r.texts, dtype=np.int64), counts),
            *[np.cumsum(unplaned(r.numbers[i * size:(i + 1) * size], "u4"), dtype=np.uint32).astype(np.int64)
              for i in range(width)]))
    return [np.concatenate(c) for c in zip(*out)]


def merged(ids, texts, begin, end):
    """Intervals of the same text that touch or overlap become one."""
    if not len(ids):
        return ids, texts, begin, end
    order = np.lexsort((begin, texts, ids))
    ids, texts, begin, end = ids[order], texts[order], begin[order], end[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1])
    # Ends grow within a text once each text is moved past the one before it.
    shift = np.cumsum(new) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    new[1:] |= (begin + shift)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ids)) - 1
    return ids[first], texts[first], begin[first], reach[last] - shift[last]


def merged_by_text(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket of texts: each text's maximal intervals."""
    return by_text(*merged(*gathered(rows, 2)))


def numbers_by_text(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket of texts: each text's numbers."""
    return by_text(*gathered(rows, 1))


def covered(size: int, spans: bytes) -> np.ndarray:
    """Which of ``size`` places lie in the packed (begin, end) pairs."""
    pairs = np.minimum(np.frombuffer(spans, dtype=np.uint32).reshape(-1, 2).astype(np.int64), size)
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, pairs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0
