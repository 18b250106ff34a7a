"""Quality: a sparse ensemble of rules over text statistics, compiled into Spark column expressions.

1. Statistics of a text (shares of kinds of bytes, repetition, lengths) come from one Arrow pass.
2. A small random forest is fitted on the labelled rows of a bounded sample; every path from a
   root to a node is a rule, a conjunction of comparisons.
3. Lasso-penalised logistic regression over the rules' truth values keeps few of them.
4. The rules that are left are one column expression over the statistics, which scores all rows in
   one scan without a shuffle.

Defined results: null and empty texts have statistics of zero; rows with a null label or a null
doc_id are not learned from; repeated label rows count each; with labels of one kind only, or
none, every score is that kind's share (1 without labels); other columns are ignored.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm import windows as win
from gristmill.llm.shared import crc_modulus, saved

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATISTICS = (
    "bytes", "words", "word_bytes", "upper", "digits", "points", "symbols", "marks", "bars", "spaces",
    "breaks", "beyond_ascii", "distinct_words", "top_word", "repeated_neighbours", "short_words", "symbol_words",
)
SAMPLE, TREES, DEPTH, PENALTY, SEED = 40_000, 16, 3, 0.0005, 7
Rule = tuple[tuple[int, bool, float], ...]  # (statistic, at most?, threshold)


def _kinds() -> np.ndarray:
    """A bit for each kind that a byte belongs to."""
    table = np.zeros((8, 256), dtype=bool)
    for row, kind in enumerate((
        range(65, 91), range(48, 58), b".,;:?'\"()-", b"$%*#&@^~<>{}[]\\/=+_", b"!", b"|", (32, 9, 11, 12, 13), (10,),
    )):
        table[row, list(kind)] = True
    return table


def text_statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text."""
    texts = len(at) - 1
    size = np.diff(at).astype(float)
    of = np.repeat(np.arange(texts), np.diff(at))
    counts = np.bincount(of * 256 + raw, minlength=texts * 256).reshape(texts, 256)
    starts, ends, first = win.word_places(raw, at)
    words = np.diff(first).astype(float)
    word_of = np.repeat(np.arange(texts), np.diff(first))
    hashes = win.word_hashes(raw, starts, ends)
    per_byte, per_word = np.maximum(size, 1.0), np.maximum(words, 1.0)
    lengths = ends - starts
    by_text = lambda w: np.bincount(word_of, weights=w, minlength=texts)
    order = np.lexsort((hashes, word_of))
    change = np.ones(len(order), dtype=bool)
    change[1:] = (hashes[order][1:] != hashes[order][:-1]) | (word_of[order][1:] != word_of[order][:-1])
    heads = np.flatnonzero(change)
    top = np.zeros(texts)
    np.maximum.at(top, word_of[order][heads], np.diff(np.append(heads, len(order))))
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (word_of[1:] == word_of[:-1])
    kinds = counts @ _kinds().T.astype(np.int64) / per_byte[:, None]
    letter = ~win.no_letters()
    last = raw[ends - 1] if len(ends) else raw[:0]
    odd = ~(letter[last] | np.isin(last, np.frombuffer(b".,;:?'\"()-0123456789", dtype=np.uint8)))
    return np.column_stack([
        size, words, by_text(lengths) / per_word, kinds, counts[:, 128:].sum(axis=1) / per_byte,
        np.bincount(word_of[order][heads], minlength=texts) / per_word, top / per_word, by_text(again) / per_word,
        by_text(lengths <= 3) / per_word, by_text(odd) / per_word,
    ])


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and the statistics of ``text``, a double each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((batch.num_rows, len(STATISTICS)))
            for row, end, raw, at in win.chunks(batch.column(len(keep))):
                rows[row:end] = text_statistics(raw, at)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], *[pa.array(np.ascontiguousarray(c)) for c in rows.T]],
                [*keep, *STATISTICS])

    docs = docs.select(*keep, "text")
    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keep), *(f"{s} double" for s in STATISTICS)]))


def paths(tree: str) -> list[Rule]:
    """Every path from the root to a node of a tree, as Spark prints it."""
    rules, above = [], []
    for line in tree.splitlines():
        found = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if found:
            depth = len(found[1])
            above = [x for x in above if x[0] < depth]
            above.append((depth, (int(found[3]), found[4] == "<=", float(found[5]))))
            rules.append(tuple(sorted(x[1] for x in above)))
    return rules


def condition(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [
        F.col(STATISTICS[s]) <= t if at_most else F.col(STATISTICS[s]) > t for s, at_most, t in rule])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Column:
    """The score of a text, as a column expression over its statistics."""
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    usable = usable.select(F.col("doc_id").alias("id"), F.col(label).cast("double").alias("label"))
    # At most ``sample`` rows of two numbers.
    chosen = usable.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    rows = saved(statistics(rows.select("label", "text"), "label").repartition(8))
    shares = rows.agg(F.avg("label"), F.min("label"), F.max("label")).first()
    if shares[1] == shares[2]:
        return F.lit(1.0 if shares[0] is None else float(shares[0]))
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="f", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="0.4",
        minInstancesPerNode=5, subsamplingRate=0.7, seed=SEED)
    inputs = rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("f"), *STATISTICS).cache()
    rules = list(dict.fromkeys(r for t in forest.fit(inputs).trees for r in paths(t.toDebugString)))
    if not rules:
        inputs.unpersist()
        return F.lit(float(shares[0]))
    truth = F.array(*[condition(r).cast("double") for r in rules])
    lasso = LogisticRegression(
        labelCol="label", featuresCol="r", elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False)
    told = inputs.select("label", array_to_vector(truth).alias("r")).cache()
    model = lasso.fit(told)
    told.unpersist()
    inputs.unpersist()
    terms = [F.when(condition(r), float(w)).otherwise(0.0)
             for r, w in zip(rules, model.coefficients.toArray()) if w]
    logit = reduce(lambda a, b: a + b, terms, F.lit(float(model.intercept)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def score(docs: DataFrame, expression: Column) -> DataFrame:
    """``doc_id, score`` of every row."""
    return statistics(docs, "doc_id").select("doc_id", expression.alias("score"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; rows of the fold 1 of 3 are not learned from."""
    expression = fit(docs, labels.where(crc_modulus(F.col("doc_id"), 3) != 1))
    return score(docs, expression).select(
        "doc_id", (crc_modulus(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
