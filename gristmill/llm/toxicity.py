"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashes of its words, of its pairs of neighbours and of its
pairs with one word between, letters only and in lower case.  The model is fitted in one task on
a bounded sample of labelled rows (``sample``, those whose identifiers hash lowest): every
coordinate has a learning rate of its own, and the L1 term leaves most weights at zero.  What is
left, at most ``2**bits`` weights, is broadcast, and all documents are scored in one scan without
a shuffle.

Defined results: null and empty texts are scored by the bias alone; labels of missing documents
and rows with a null label are not learned from; repeated label rows count each; without any
labelled rows every score is 0.5; other columns are ignored by ``score`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import windows as win
from gristmill.llm.shared import crc_modulus, session_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS, SAMPLE, EPOCHS = 20, 20_000, 3
ALPHA, BETA, L1, L2 = 0.4, 1.0, 12.0, 0.1
#: Documents with at least this probability are toxic.
THRESHOLD = 0.3


def grams(raw: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all texts and the text of each, with repeats; 0 is the bias."""
    raw = win.lower_ascii()[raw]
    starts, ends, first = win.word_places(raw, at, win.no_letters())
    words = win.word_hashes(raw, starts, ends)
    of = np.repeat(np.arange(len(at) - 1), np.diff(first))
    found, where = [np.zeros(len(at) - 1, dtype=np.uint64)], [np.arange(len(at) - 1)]
    keep = np.uint64(64 - bits)
    for step, seed in ((0, 11), (1, 12), (2, 13)):
        if len(words) <= step:
            continue
        other = words[step:] if step else np.uint64(0)
        own = words[:len(words) - step]
        inside = of[:len(words) - step] == of[step:]
        hashed = win.mix(own * np.uint64(win.WORD_BASE) + other, seed) >> keep
        found.append(np.maximum(hashed[inside], np.uint64(1)))
        where.append(of[step:][inside])
    return np.concatenate(found), np.concatenate(where)


def distinct(coordinates: np.ndarray, of: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The same without repeats within a text, one text after the other."""
    pairs = np.unique((of.astype(np.uint64) << np.uint64(bits)) | coordinates)
    return (pairs & np.uint64((1 << bits) - 1)).astype(np.int64), (pairs >> np.uint64(bits)).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal (McMahan et al. 2013) with binary features."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        w = -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return w

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        root = np.sqrt(n + g * g)
        self.z[at] += g - (root - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _examples(bits: int):
    """The label and the coordinates of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for row, end, raw, at in win.chunks(batch.column(2)):
                found, of = distinct(*grams(raw, at, bits), bits)
                edges = np.searchsorted(of, np.arange(end - row + 1))
                packed += [found[a:b].astype(np.int32).tobytes() for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["id", "label", "features"])

    return run


def _fit(bits: int, epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = [
            (i, y, np.frombuffer(x, dtype=np.int32)) for batch in batches
            for i, y, x in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "features")))]
        # A fixed, well-mixed order, whichever way the rows came.
        keys = win.mix(np.array([e[0] for e in examples], dtype=np.int64).view(np.uint64), 5)
        order = np.lexsort(([e[1] for e in examples], keys)) if examples else []
        model = Ftrl(1 << bits)
        for _ in range(epochs):
            for i in order:
                model.learn(examples[i][2], examples[i][1])
        w = model.weights()
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(w[at])], ["coordinate", "weight"])

    return run


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", bits: int = BITS,
    sample: int = SAMPLE, epochs: int = EPOCHS,
) -> DataFrame:
    """The weights that are not zero: ``coordinate, weight``."""
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    usable = usable.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label"))
    # At most ``sample`` rows of two numbers.
    chosen = usable.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    examples = rows.select("id", "label", "text").mapInArrow(_examples(bits), "id long, label int, features binary")
    # Texts are read in parallel; the features of the bounded sample meet in one task.
    return examples.repartition(1).mapInArrow(_fit(bits, epochs), "coordinate int, weight double")


def score(docs: DataFrame, weights: DataFrame, bits: int = BITS) -> DataFrame:
    """``doc_id, score`` of every row, by weights of :func:`fit`."""
    shared = session_of(docs).sparkContext.broadcast(_dense(weights, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_scores(batch.column(1), shared.value, bits))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def _dense(weights: DataFrame, bits: int) -> np.ndarray:
    dense = np.zeros(1 << bits, dtype=np.float32)
    for row in weights.collect():  # at most 2**bits rows, and few of them with L1
        dense[row["coordinate"]] = row["weight"]
    return dense


def _scores(texts: pa.Array, dense: np.ndarray, bits: int) -> np.ndarray:
    sums = np.zeros(len(texts))
    for row, end, raw, at in win.chunks(texts):
        found, of = grams(raw, at, bits)
        weighty = np.flatnonzero(dense[found])  # few: the others need not be told apart
        found, of = distinct(found[weighty], of[weighty], bits)
        sums[row:end] = np.bincount(of, weights=dense[found], minlength=end - row)
    return 1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35)))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; rows of the fold 2 of 4 are not learned from."""
    weights = fit(docs, labels.where(crc_modulus(F.col("doc_id"), 4) != 2))
    return score(docs, weights).select(
        "doc_id", (crc_modulus(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The rows that are not predicted to be toxic, with all their columns.

    The model is fitted on the labelled rows of ``labelled``, by default those of ``docs``.
    """
    dense = _dense(fit(docs if labelled is None else labelled, labels.where(crc_modulus(F.col("doc_id"), 4) != 2)), BITS)
    shared = session_of(docs).sparkContext.broadcast(dense)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(_scores(pa.array(texts, pa.string(), from_pandas=True), shared.value, BITS))

    return docs.where(scored("text") < THRESHOLD)
