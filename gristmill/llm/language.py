"""Language of a text: averaged embeddings of hashed subwords under a linear softmax.

1. Subwords are the runs of 2 to 5 bytes within a word, the blank on either side included, in lower
   case; whatever is no letter is a blank.  Each is hashed to one of ``2**BITS`` rows of a table.
2. The mean of a text's rows goes through a linear softmax.  Both are trained by stochastic gradient
   descent on a bounded sample: of every language documents drawn by a hash, SAMPLE in all, at
   most FEATURES of the commonest subwords of each.
3. A fifth of the sample is kept back.  On it a temperature is fitted, so that the score is an honest
   probability, and the least score from which on PRECISION of the predictions are right; lower ones
   are rejected.
4. A text is scored in slices, so memory does not grow with its length.

Defined results: a text that is null or holds no letter is ``und`` with a score of 0; rows without
text, language or identifier are not learned from; repeated rows are learned once and predicted
each; with one language known all other texts are that; with none they are ``und``; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.frames import lookup_join
from gristmill.llm import windows as win
from gristmill.llm.shared import crc_modulus, session_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIZES, BITS, DIMENSIONS = (2, 3, 4, 5), 16, 16
SAMPLE, FEATURES, EPOCHS, RATE, PRECISION, SEED = 4_000, 4_096, 8, 1.0, 0.99, 11
SLICE = 1 << 18
UNKNOWN = "und"
FOLDS, HELD, CALIBRATED = 5, 0, 1


def blanked() -> np.ndarray:
    """Every byte's letter in lower case, or a blank; bytes of other characters stay."""
    table = np.where(win.no_letters(), 32, win.lower_ascii()).astype(np.uint8)
    return table


def subwords(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows of the table, texts they belong to)``, a slice and a size at a time."""
    texts = len(at) - 1
    line = np.full(len(raw) + texts + 1, 32, dtype=np.uint8)
    # A blank stands before every text and behind the last.
    line[np.arange(len(raw)) + 1 + np.repeat(np.arange(texts), np.diff(at))] = blanked()[raw]
    first = at[:-1] + np.arange(texts)
    for start in range(0, len(line) - 1, SLICE):
        piece = line[start:start + SLICE + max(SIZES) - 1]
        starts = min(SLICE, len(line) - start)
        of = np.searchsorted(first, np.arange(start, start + starts), side="right") - 1
        blank = np.concatenate([[0], np.cumsum(piece == 32)])
        code = piece.astype(np.uint64)
        for size in range(2, max(SIZES) + 1):
            places = max(min(starts, len(piece) - size + 1), 0)
            code = code[:places] | (piece[size - 1:size - 1 + places].astype(np.uint64) << np.uint64(8 * size - 8))
            if size not in SIZES:
                continue
            inner = blank[size - 1:size - 1 + places] - blank[1:1 + places]
            whole = blank[size:size + places] - blank[:places]
            kept = (inner == 0) & (whole < size)
            hashed = win.mix(code[kept], size) >> np.uint64(64 - BITS)
            yield hashed.astype(np.int64), of[:places][kept]


def sums(raw: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sum over its subwords' rows of a table, and how many there are."""
    total, count = np.zeros((len(at) - 1, table.shape[1])), np.zeros(len(at) - 1)
    columns = np.ascontiguousarray(table.T)
    for rows, of in subwords(raw, at):
        if not len(of):
            continue
        low, high = int(of[0]), int(of[-1]) + 1
        near = of - low
        count[low:high] += np.bincount(near, minlength=high - low)
        for c, column in enumerate(columns):
            total[low:high, c] += np.bincount(near, weights=column[rows], minlength=high - low)
    return total, count


def softmax(logits: np.ndarray) -> np.ndarray:
    grown = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return grown / grown.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    embeddings: np.ndarray  # 2**BITS x DIMENSIONS
    weights: np.ndarray  # DIMENSIONS x languages
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The mean goes through the weights; with few languages the table goes through them first."""
        early = len(self.languages) <= DIMENSIONS
        total, count = sums(raw, at, self.embeddings @ self.weights if early else self.embeddings)
        mean = total / np.maximum(count, 1)[:, None]
        return (mean if early else mean @ self.weights) + self.bias

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of every text."""
        best, score = np.zeros(len(texts), dtype=int), np.zeros(len(texts))
        for row, end, raw, at in win.chunks(texts):
            chance = softmax(self.logits(raw, at) / self.temperature)
            best[row:end] = chance.argmax(axis=1)
            score[row:end] = chance.max(axis=1)
        lettered = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
        names = [self.languages[b] if told else UNKNOWN for b, told in zip(best, lettered)]
        score[~lettered] = 0.0
        return names, score, lettered & (score < self.least)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], languages: int, epochs: int) -> tuple:
    """Gradient steps, one document at a time, in a fixed order that each epoch mixes anew."""
    rng = np.random.default_rng(SEED)
    embeddings = rng.uniform(-0.5, 0.5, (1 << BITS, DIMENSIONS)) / np.sqrt(DIMENSIONS)
    weights, bias = np.zeros((DIMENSIONS, languages)), np.zeros(languages)
    steps, step = max(1, epochs * len(examples)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            rows, shares, language = examples[i]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = shares @ embeddings[rows]
            slope = softmax(mean @ weights + bias)
            slope[language] -= 1
            back = weights @ slope
            weights -= rate * np.outer(mean, slope)
            bias -= 0.1 * rate * slope
            # A row's share is small: steps of the table are larger in proportion.
            embeddings[rows] -= rate * np.sqrt(len(rows)) * shares[:, None] * back
    return embeddings, weights, bias


def calibrate(logits: np.ndarray, language: np.ndarray) -> tuple[float, float]:
    """The temperature of least loss, and the least score from which on PRECISION are right."""
    if not len(language):
        return 1.0, 0.0
    tried = np.geomspace(0.01, 10, 61)
    losses = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(language)), language], 1e-12)).mean()
              for t in tried]
    temperature = float(tried[int(np.argmin(losses))])
    chance = softmax(logits / temperature)
    score, right = chance.max(axis=1), chance.argmax(axis=1) == language
    order = np.argsort(-score, kind="stable")
    precise = np.cumsum(right[order]) >= PRECISION * np.arange(1, len(order) + 1)
    # Scores that tie stand or fall together.
    edge = np.append(score[order][1:] != score[order][:-1], True)
    good = np.flatnonzero(precise & edge)
    return temperature, float(score[order][good[-1]]) if len(good) else 1.0


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The commonest subwords of each text: rows of the table and their counts."""
    for batch in batches:
        packed = []
        raw, at = win.text_buffers(batch.column(2))
        for s, e in zip(at, at[1:]):
            counts = np.zeros(1 << BITS, dtype=np.int64)
            for rows, _ in subwords(raw[s:e], np.array([0, e - s])):
                np.add.at(counts, rows, 1)
            rows = np.flatnonzero(counts)
            rows = np.sort(rows[np.argsort(-counts[rows], kind="stable")[:FEATURES]])
            packed.append(np.column_stack([rows, counts[rows]]).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["id", "lang", "features"])


def _train(epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        languages = sorted({lang for _, lang, _, _ in found})
        parts: tuple[list, list] = [], []
        for _, lang, kept_back, features in found:
            rows, counts = np.frombuffer(features, dtype=np.int32).reshape(-1, 2).T
            if len(rows):
                parts[kept_back].append((rows, counts / counts.sum(), languages.index(lang)))
        embeddings, weights, bias = train(parts[False], len(languages), epochs)
        held = np.array([shares @ embeddings[rows] @ weights + bias for rows, shares, _ in parts[True]])
        temperature, least = calibrate(held, np.array([language for _, _, language in parts[True]], dtype=int))
        yield pa.RecordBatch.from_pydict({
            "languages": pa.array([languages], pa.list_(pa.string())),
            "embeddings": [embeddings.astype(np.float32).tobytes()], "weights": [weights.tobytes()],
            "bias": [bias.tobytes()], "temperature": [temperature], "least": [least]})

    return run


def fit(docs: DataFrame, lang: str = "lang", sample: int = SAMPLE, epochs: int = EPOCHS) -> Model:
    """A model of the languages that the column names; rows of the fold HELD are not learned from."""
    usable = docs.select(F.col("doc_id").alias("id"), F.col(lang).cast("string").alias("lang"), "text").where(
        (crc_modulus(F.col("id"), FOLDS) != HELD) & F.col("id").isNotNull() & F.col("lang").isNotNull()
        & F.col("text").rlike(r"\p{L}")
    ).withColumn("hash", F.xxhash64("id", "text"))
    # By its hash about twice the sample of a language goes on, however large the language is and
    # however often a row repeats, so that ranking within a language is no large task.
    sizes = usable.groupBy("lang").agg(F.approx_count_distinct("hash").alias("size"))
    drawn = lookup_join(usable.select("id", "lang", "hash"), sizes, ["lang"], "inner").where(
        F.pmod("hash", F.lit(1 << 20)) * F.col("size") < (2 * sample) << 20
    ).select("id", "lang", "hash").distinct()
    spread = Window.partitionBy("lang").orderBy("hash", "id")
    chosen = (
        drawn.withColumn("place", F.row_number().over(spread))
        .where(F.col("place") <= sample).orderBy("place", "lang").limit(sample)
        .select("id", "lang", "hash")
    )
    # At most ``sample`` rows of three values; of rows that repeat one text goes on.
    texts = usable.join(F.broadcast(chosen), ["id", "lang", "hash"]).groupBy("id", "lang", "hash").agg(
        F.min("text").alias("text"))
    examples = texts.select("id", "lang", "text").mapInArrow(_features, "id long, lang string, features binary")
    back = crc_modulus(F.col("id"), FOLDS) == CALIBRATED
    # The features of the bounded sample meet in one task, where the steps are taken in turn.
    trained = examples.select("id", "lang", back.alias("back"), "features").repartition(1).mapInArrow(
        _train(epochs), "languages array<string>, embeddings binary, weights binary, bias binary, "
        "temperature double, least double").first()
    if trained is None or not trained["languages"]:
        return Model([], np.zeros((1 << BITS, DIMENSIONS)), np.zeros((DIMENSIONS, 0)), np.zeros(0))
    return Model(
        trained["languages"], np.frombuffer(trained["embeddings"], dtype=np.float32).reshape(-1, DIMENSIONS),
        np.frombuffer(trained["weights"]).reshape(DIMENSIONS, -1), np.frombuffer(trained["bias"]),
        trained["temperature"], trained["least"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every row."""
    if not model.languages:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(False).alias("rejected"))
    shared = session_of(docs).sparkContext.broadcast(model)  # four megabytes and 128 bytes a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, shared.value.predict(batch.column(1)))],
                ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every row; held-out rows are not learned from."""
    return predict(docs, fit(docs)).select(
        "doc_id", (crc_modulus(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "lang_pred", "score", "rejected")
