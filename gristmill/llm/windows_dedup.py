"""Substring dedup: remove words covered by a window of ``width`` words that starts earlier too.

1. A task hashes every window of its texts (Rabin-Karp, by prefix sums) and settles repeats
   within a run of texts itself; the first of each window goes to the bucket of its hash, packed
   in columns.  A passage that a third of all texts share is thus a few rows per task.
2. A bucket sorts its windows and counts them; of equal ones, only the first (smallest doc_id,
   then earliest start) stays.
3. Repeated windows merge into intervals, return packed by bucket of texts, and merge into the
   maximal intervals of each text.

Two windows are taken as equal when 64 bits of one hash and the bucket, taken from a second
hash, agree.

Defined results: a null text has no words; texts shorter than a window keep all words; a null
doc_id comes before all others; repeated rows are not earlier than each other; rows that share a
doc_id but not their text are told apart by a hash of the text; an empty table gives an empty
table; other columns are kept by ``remove_repeats`` and ignored by ``repeats``.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import blobs
from gristmill.llm import windows as win
from gristmill.llm.shared import partitions, session_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FIRST_ID = -(2**63)
OTHER_BASE = 0xBF58476D1CE4E5B9 | 5


def identified(docs: DataFrame) -> DataFrame:
    """``id, text_hash, text``: what tells rows apart."""
    return docs.select(
        F.coalesce("doc_id", F.lit(FIRST_ID)).alias("id"),
        F.xxhash64("text").alias("text_hash"), "text")


def _hash_windows(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids, all_texts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, end, raw, at in win.chunks(batch.column(2)):
                ids, texts = all_ids[row:end], all_texts[row:end]
                starts, ends, first = win.word_places(raw, at)
                if len(starts) < width:
                    continue
                words = win.word_hashes(raw, starts, ends)
                counts = np.diff(first)
                of = np.repeat(np.arange(len(ids)), counts)
                whole = np.flatnonzero(of[width - 1:] == of[:len(of) - width + 1])
                if not len(whole):
                    continue
                keys = win.mix(win.Sums(words, win.WORD_BASE).every(width)[whole], 1)
                bucket = (win.mix(win.Sums(words, OTHER_BASE).every(width)[whole], 2) >> np.uint64(33)) % np.uint64(buckets)
                order = np.argsort(keys)
                sorted_keys = keys[order]
                doc = of[whole]
                least = np.zeros(len(whole), dtype=bool)
                runs = blobs.runs(sorted_keys)
                if len(runs) == len(order):
                    least[:] = True
                else:
                    start = whole - first[doc]
                    least[order] = blobs.least_in_runs(runs, ids[doc][order], start[order])
                rows = []
                late = whole[~least]
                if len(late):
                    rows.append(blobs.packed(-1, keys[:0], late, of, ids, texts, counts, True, buckets))
                kept = np.flatnonzero(least)
                by_bucket = kept[np.argsort(bucket[kept], kind="stable")]
                edges = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1, dtype=np.uint64))
                for b in range(buckets):
                    own = by_bucket[edges[b]:edges[b + 1]]
                    if len(own):
                        rows.append(blobs.packed(b, keys[own], whole[own], of, ids, texts, counts, False, buckets))
                yield blobs.packs(rows)

    return run


def _late_windows(width: int, buckets: int):
    """Of one bucket: intervals of words under windows that are not the first of their hash, by text."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = [blobs.unpacked(r) for r in rows[rows["known"]].itertuples()]
        fresh = list(rows[~rows["known"]].itertuples())
        if fresh:
            keys = np.concatenate([np.frombuffer(r.keys, dtype=np.uint64) for r in fresh])
            order = np.argsort(keys)
            runs = blobs.runs(keys[order])
            if len(runs) < len(order):
                # Only windows of runs of two and more are looked at.
                lengths = np.diff(np.append(runs, len(order)))
                order = order[np.repeat(lengths > 1, lengths)]
                runs = blobs.runs(keys[order])
                ids, texts, starts = [np.concatenate(x) for x in zip(*map(blobs.unpacked, fresh))]
                late = order[~blobs.least_in_runs(runs, ids[order], starts[order])]
                found.append((ids[late], texts[late], starts[late]))
        if not found:
            return blobs.scattered(buckets, np.zeros(0, np.int64), np.zeros(0, np.int64))
        ids, texts, starts = [np.concatenate(x) for x in zip(*found)]
        return blobs.scattered(buckets, *blobs.merged(ids, texts, starts, starts + width))

    return run


def repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """``id, text_hash, numbers``: (begin, end) pairs of words that a window starting earlier covers."""
    buckets = partitions(session_of(docs))
    hashed = identified(docs).mapInArrow(_hash_windows(width, buckets), blobs.PACKED_COLUMNS)
    late = hashed.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(
        _late_windows(width, buckets), blobs.SCATTERED)
    return late.repartition(buckets, "dest").groupBy("dest").applyInPandas(blobs.merged_by_text, blobs.BY_TEXT)


def _kept(text: bytes | None, spans: bytes | None) -> tuple[list[bytes], int]:
    words = (text or b"").split()
    if spans is None:
        return words, 0
    gone = blobs.covered(len(words), spans)
    return [w for w, g in zip(words, gone) if not g], int(gone.sum())


def with_repeats(docs: DataFrame, width: int) -> DataFrame:
    marked = docs.withColumns({
        "__id": F.coalesce("doc_id", F.lit(FIRST_ID)), "__hash": F.xxhash64("text")})
    found = repeats(docs, width).select(
        F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("numbers").alias("__spans"))
    return marked.join(found, ["__id", "__hash"], "left").drop("__id", "__hash")


def dedup_report(docs: DataFrame, width: int = 20) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            words, removed, digests = [], [], []
            for text, spans in zip(texts, batch.column("__spans").to_pylist()):
                kept, gone = _kept(text, spans)
                words.append(len(kept) + gone)
                removed.append(gone)
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    found = with_repeats(docs.select("doc_id", "text"), width)
    return found.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """The rows with their repeated words removed; other columns stay as they are.

    A text without removed words stays byte by byte; otherwise the kept words are joined by spaces.
    """
    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([b" ".join(_kept((t or "").encode(), s)[0]).decode() for t, s in zip(texts, spans)])

    found = with_repeats(docs, width)
    text = F.when(F.col("__spans").isNotNull(), cut("text", "__spans")).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*docs.columns)
