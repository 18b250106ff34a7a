"""Hybrid name matching: TF-IDF cosine over character n-grams plus edit similarity.

A score is a weighted sum of both parts, and edit similarity is at most one.  A pair that
reaches a score therefore has a known minimum cosine, and only pairs that can have it are
compared:

* queries and names are dealt into parts, and a task compares one part of both in memory;
* the rare grams of a query are summed up for the names that hold them, and the lengths of
  what both have in common grams bound the rest;
* only for names that can still reach the minimum are the common grams multiplied, and only
  pairs that reach it are written.

Every part of the queries meets every part of the names, so time grows with the product of both
tables; each vector is copied once for every part of the other side, and no table of pairs is
shuffled to be counted.

The best name of a query needs no threshold: the minimum falls from level to level, and a
query leaves as soon as no name below the level could beat the best that it has.  All cuts
are exact.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions.frames import lookup_join, materialised, percent, quoted
from gristmill.functions.similarity import Masks, best_similarity, characters, similarity_bound, squeezed_length
from gristmill.functions.text import clean_text, is_blank

# The functions travel with the plan, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAM_SIZES = (2, 3, 4)
SHORT_QUERY = 5
SLACK = 1e-9
#: What single precision can take from a cosine.
ROUNDING = 1e-5
#: The most rows of a part of the vectors, and the fewest that are worth a task.
PART_ROWS, LEAST_ROWS = 32_768, 256
#: Grams in more than this share of a part's names are common, so many at most.
COMMON, COMMON_SHARE = 512, 0.02
#: The cosines down to which the best names are looked for, one after the other.
LEVELS = (0.7, 0.3, 0.0)


def word_grams(clean: Column) -> Column:
    """Character n-grams inside words, each word padded with a space on both sides."""
    words = F.filter(F.split(F.lower(clean), " +"), lambda word: word != "")

    def grams(word: Column, size: int) -> Column:
        last = F.length(word) - size + 1
        spots = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda at: F.substring(word, at, size))

    def all_sizes(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        return F.concat(*[grams(padded, size) for size in GRAM_SIZES])

    return F.flatten(F.transform(words, all_sizes))


def _gram_counts(names: DataFrame, *carried: str) -> DataFrame:
    """Term counts.  The names are already partitioned by ``clean``: no further shuffle."""
    grams = names.select("clean", *carried, F.explode(word_grams(F.col("clean"))).alias("gram"))
    return grams.groupBy("clean", "gram", *carried).agg(F.count(F.lit(1)).alias("tf"))


def _vectors(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """Unit vectors as arrays, rarest gram first, with the length of what remains."""
    weighted = lookup_join(counts, weights, ["gram"], "inner").select(
        "clean", "gram", "df", (F.col("tf") * F.col("idf")).alias("weight")
    )
    # Running squared length from the back: entry i covers the grams from i to the end.
    to_the_end = Window.partitionBy("clean").orderBy(F.desc("df"), F.desc("gram")).rowsBetween(
        Window.unboundedPreceding, 0)
    gathered = (
        weighted.withColumn("rest", F.sum(F.col("weight") * F.col("weight")).over(to_the_end))
        .groupBy("clean")
        .agg(F.array_sort(F.collect_list(F.struct("df", "gram", "weight", "rest"))).alias("terms"))
        .withColumn("length", F.sqrt(F.try_element_at("terms", F.lit(1))["rest"]))
    )
    return gathered.select(
        "clean",
        F.transform("terms", lambda t: F.struct(
            t["gram"].alias("gram"), (t["weight"] / F.col("length")).alias("weight"))).alias("unit"),
        F.transform("terms", lambda t: F.sqrt(t["rest"]) / F.col("length")).alias("remainder"),
    )


@dataclass(frozen=True)
class NameIndex:
    """A fitted set of names.

    ``names``: clean name, how it was first written, its position.  ``weights``: gram,
    document count, inverse document frequency.  ``vectors``: unit vector per clean name,
    under a number of its own.
    """

    names: DataFrame
    weights: DataFrame
    vectors: DataFrame

    def write(self, path: str, mode: str = "overwrite") -> None:
        """Store the index, so that later batches neither refit nor carry its lineage."""
        for part in ("names", "weights", "vectors"):
            getattr(self, part).write.mode(mode).parquet(f"{path}/{part}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> NameIndex:
        return cls(*[spark.read.parquet(f"{path}/{p}") for p in ("names", "weights", "vectors")])


def fit_names(df: DataFrame, name: str, position: str | Column) -> NameIndex:
    """Index the distinct clean names; copies only raise the document counts.

    The three tables are written to the shared folder once, whatever asks them later.
    """
    position = quoted(position) if isinstance(position, str) else position
    names = materialised(
        df.where(~is_blank(quoted(name)))
        .select(quoted(name).cast("string").alias("name"), position.alias("position"))
        .withColumn("clean", clean_text("name"))
        .where(F.length("clean") >= 2)
        .groupBy("clean")
        .agg(F.min(F.struct("position", "name")).alias("first"),
             F.count(F.lit(1)).alias("copies"))
        .select("clean", F.col("first.name").alias("name"),
                F.col("first.position").alias("position"), "copies")
    )
    counts = _gram_counts(names, "copies")
    documents = names.agg(F.sum("copies")).scalar().cast("double")
    frequency = F.col("df").cast("double")
    weights = materialised(
        counts.groupBy("gram").agg(F.sum("copies").alias("df"))
        .withColumn("idf", F.ln((documents + 1.0) / (frequency + 1.0)) + 1.0)
    )
    return NameIndex(names.select("clean", "name", "position"), weights, _numbered(_vectors(counts, weights)))


def _numbered(vectors: DataFrame) -> DataFrame:
    """The vectors written, under numbers that stand for their names in tables of pairs."""
    return materialised(vectors.withColumn("id", F.monotonically_increasing_id()))


def _cosine(left: Column, right: Column) -> Column:
    products = F.map_zip_with(
        F.map_from_entries(left), F.map_from_entries(right), lambda _, a, b: a * b
    )
    shared = F.filter(F.map_values(products), lambda p: p.isNotNull())
    return F.aggregate(shared, F.lit(0.0), lambda acc, p: acc + p)


def _parts(spark: SparkSession, rows: int) -> int:
    """Into how many parts a table of vectors is dealt: small enough for a task, and enough for all tasks."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(math.ceil(rows / PART_ROWS), math.ceil(math.sqrt(2 * min(tasks, math.ceil(rows / LEAST_ROWS)))), 1)


def _met(batches: Iterator[pa.RecordBatch], top: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs of a part of the queries and a part of the names whose cosine may reach the query's need."""
    held = list(batches)
    if not held:
        return
    rows = pa.Table.from_batches(held)
    ours, theirs = (rows.filter(pc.equal(rows["asked"], asked)).combine_chunks() for asked in (False, True))
    if not len(ours) or not len(theirs):
        return
    names, queries = Part(ours), Part(theirs)
    index = PartIndex(names)
    for begin in range(0, len(theirs), 256):
        found = [index.near(queries, at, top) for at in range(begin, min(begin + 256, len(theirs)))]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(queries.ids[begin:begin + 256], [len(f) for f in found])),
            pa.array(names.ids[np.concatenate(found)]),
            pa.array(np.repeat(queries.needs[begin:begin + 256], [len(f) for f in found]))],
            ["query", "candidate", "need"])


class Part:
    """Vectors as flat arrays: row ``i`` has the entries from ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, rows: pa.Table) -> None:
        def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
            lists = rows[name].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            return lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])

        self.ids, self.needs = rows["id"].to_numpy(), rows["need"].to_numpy()
        self.grams, self.first = flat("grams")
        self.weights, _ = flat("weights")

    def __len__(self) -> int:
        return len(self.ids)


class PartIndex:
    """A part of the names: lists of the names that hold a rare gram, a dense table of the common grams.

    The rare grams of a query are summed up for all names; the lengths of both remainders bound what
    common grams add, and only for names that can still reach the need are these multiplied.
    """

    def __init__(self, names: Part) -> None:
        self.size = len(names)
        row = np.repeat(np.arange(self.size), np.diff(names.first))
        order = np.argsort(names.grams, kind="stable")
        self.grams, begin, count = np.unique(names.grams[order], return_index=True, return_counts=True)
        self.begin, self.end = begin.tolist(), (begin + count).tolist()
        self.rows, self.weights = row[order], names.weights[order]
        # The most frequent grams, as far as a dense table stays small.
        often = np.argsort(-count, kind="stable")[:COMMON]
        often = often[count[often] > COMMON_SHARE * self.size]
        self.column = np.full(len(self.grams), -1)
        self.column[often] = np.arange(len(often))
        self.dense = np.zeros((self.size, len(often)), dtype=np.float32)
        for column, gram in enumerate(often.tolist()):
            here = slice(self.begin[gram], self.end[gram])
            np.add.at(self.dense[:, column], self.rows[here], self.weights[here])
        self.rest = np.sqrt(np.einsum("ij,ij->i", self.dense, self.dense))

    def near(self, queries: Part, at: int, top: int | None) -> np.ndarray:
        """The names whose cosine with the query may reach its need; if asked for, only the ``top`` nearest and equal ones."""
        here = slice(queries.first[at], queries.first[at + 1])
        grams, weights = queries.grams[here], queries.weights[here]
        place = np.searchsorted(self.grams, grams)
        known = place < len(self.grams)
        known[known] = self.grams[place[known]] == grams[known]
        place, weights = place[known], weights[known]
        column = self.column[place]
        rare, common = np.flatnonzero(column < 0).tolist(), column >= 0
        wanted = np.zeros(self.dense.shape[1], dtype=np.float32)
        np.add.at(wanted, column[common], weights[common])
        lists = [slice(self.begin[p], self.end[p]) for p in place[rare].tolist()]
        seen = np.zeros(self.size)
        if lists:
            shares = np.repeat(weights[rare], [s.stop - s.start for s in lists])
            seen = np.bincount(np.concatenate([self.rows[s] for s in lists]),
                               np.concatenate([self.weights[s] for s in lists]) * shares, self.size)
        need = queries.needs[at] - ROUNDING
        left = np.flatnonzero(seen + np.sqrt(wanted @ wanted) * self.rest >= need)
        cosine = seen[left] + self.dense[left] @ wanted
        good = (cosine >= need) & (cosine > 0)
        left, cosine = left[good], cosine[good]
        if top is not None and len(left) > top:
            left = left[cosine >= np.partition(cosine, -top)[-top] - 2 * ROUNDING]
        return left


def candidates(names: DataFrame, asked: DataFrame, lowest: float, top: int | None = None) -> DataFrame:
    """``query, candidate, need``: numbers of the pairs whose cosine may reach the query's ``need``.

    Queries and names are dealt into parts, and each task compares one part of both, so that pairs
    are met in memory and only those that count are written.  Weights travel as single precision and
    grams as hashes; equal hashes of two grams can only add to a cosine.  With ``top``, a query keeps
    its nearest names of each part, and those as near within rounding.
    """
    spark = names.sparkSession
    ours, theirs = _parts(spark, names.count()), _parts(spark, asked.count())

    def dealt(vectors: DataFrame, is_query: bool) -> DataFrame:
        part = F.pmod(F.xxhash64("id"), F.lit(theirs if is_query else ours)).cast("int")
        cells = (F.transform(F.sequence(F.lit(0), F.lit(ours - 1)), lambda other: part * ours + other) if is_query
                 else F.transform(F.sequence(F.lit(0), F.lit(theirs - 1)), lambda other: other * ours + part))
        return vectors.where(F.size("unit") > 0).select(
            F.explode(cells).alias("cell"), F.lit(is_query).alias("asked"), "id",
            (F.col("need") if is_query else F.lit(lowest)).cast("double").alias("need"),
            F.transform("unit", lambda t: F.hash(t["gram"])).alias("grams"),
            F.transform("unit", lambda t: t["weight"].cast("float")).alias("weights"))

    cells = dealt(names, False).union(dealt(asked, True)).repartitionById(ours * theirs, "cell")
    return cells.drop("cell").mapInArrow(
        lambda batches: _met(batches, top), "query long, candidate long, need double")


def _pairs(names: DataFrame, asked: DataFrame, lowest: float, top: int | None = None) -> DataFrame:
    """``query, candidate, cosine`` of the pairs with ``cosine >= need``, both as clean names.

    ``names`` and ``asked`` are tables of vectors; ``asked`` has a ``need`` for each query.
    """
    hopeful = materialised(candidates(names, asked, lowest, top))
    known = names.select(F.col("id").alias("candidate"), F.col("clean").alias("candidate_clean"),
                         F.col("unit").alias("candidate_unit"))
    wanted = asked.select(F.col("id").alias("query"), F.col("clean").alias("query_clean"),
                          F.col("unit").alias("query_unit"))
    return (
        hopeful.join(known, "candidate").join(wanted, "query")
        .withColumn("cosine", _cosine(F.col("query_unit"), F.col("candidate_unit")))
        .where(F.col("cosine") >= F.col("need") - SLACK)
        .select(F.col("query_clean").alias("query"), F.col("candidate_clean").alias("candidate"), "cosine")
    )


def _asked(df: DataFrame, query: str, index: NameIndex) -> DataFrame:
    """The vectors of the distinct clean queries."""
    return _numbered(_vectors(_gram_counts(_distinct_queries(df, query)), index.weights))


def _distinct_queries(df: DataFrame, query: str) -> DataFrame:
    return (
        df.select(clean_text(quoted(query)).alias("clean"))
        .where(F.length("clean") >= 2)
        .groupBy("clean").agg(F.count(F.lit(1)).alias("copies"))
        .select("clean")
    )


def top_cosine(
    df: DataFrame, query: str, index: NameIndex, at_least: float = 0.5, top: int = 1
) -> DataFrame:
    """Per distinct query the ``top`` names by TF-IDF cosine, as far as they reach ``at_least``."""
    if not 0 < at_least <= 1:
        raise ValueError("at_least must lie above 0: names without a shared gram score 0")
    asked = _asked(df, query, index).withColumn("need", F.lit(float(at_least)))
    pairs = _pairs(index.vectors, asked, at_least, top)
    named = lookup_join(pairs.withColumnRenamed("candidate", "clean"), index.names, ["clean"], "inner")
    # Scores that differ by rounding only count as equal; the first name then wins.
    best = Window.partitionBy("query").orderBy(F.round("cosine", 9).desc(), "position")
    return (
        named.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
        .select("query", "rank", F.col("name").alias("matched_name"), "cosine")
    )


def _cosine_share(clean: Column) -> Column:
    """How much of the score the cosine makes up; short queries lean on edit similarity."""
    return F.when(F.length(clean) < SHORT_QUERY, 0.4).otherwise(0.6)


def _texts(clean: DataFrame, side: str, *carried: str) -> DataFrame:
    """What the bound of the similarity needs of each name."""
    text = F.col("clean")
    return clean.select(text.alias(side), *carried, characters(text).alias(f"{side}_characters"),
                        squeezed_length(text).alias(f"{side}_length"))


def bounded(pairs: DataFrame, names: DataFrame, asked: DataFrame) -> DataFrame:
    """The pairs with the ``best`` so far of the query, of ``asked``, and ``most``, the score that
    they reach if all common characters lie well."""
    share = _cosine_share(F.col("query"))
    known = lookup_join(pairs, _texts(names, "candidate"), ["candidate"], "inner")
    both = lookup_join(known, _texts(asked, "query", "best"), ["query"], "inner")
    similar = similarity_bound(*[F.col(f"{side}_{part}") for part in ("characters", "length")
                                 for side in ("query", "candidate")])
    return both.select("query", "candidate", "cosine", share.alias("share"), "best",
                       (share * F.col("cosine") + (1 - share) * similar).alias("most"))


def _score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Scores of the pairs that can be their query's best, nearest names first."""
    query, best, masks = None, 0.0, Masks()
    for batch in batches:
        scored = []
        for asked, candidate, cosine, share, known, most in batch.itertuples(index=False, name=None):
            if asked != query:
                query, best = asked, known
                masks.clear()
            if most < best - SLACK:
                continue
            least = (best - share * cosine) / (1 - share) - 1e-6
            score = round(share * cosine + (1 - share) * best_similarity(asked, candidate, least, masks), 12)
            if score >= best - SLACK:
                scored.append((asked, candidate, score))
                best = max(best, score)
        yield pd.DataFrame(scored, columns=["query", "candidate", "score"])


def scores(pairs: DataFrame, names: DataFrame, asked: DataFrame) -> DataFrame:
    """``query, candidate, score`` of the pairs that can be their query's best name.

    ``pairs`` has ``query, candidate, cosine``, and ``asked`` the ``best`` score of each query so far.
    The names of a query come nearest first, so that the similarity of most others need not be found;
    a query with very many names is worked on in several tasks.
    """
    dealt = bounded(pairs, names, asked).where(F.col("most") >= F.col("best") - SLACK).repartition(
        "query", F.pmod(F.xxhash64("candidate"), F.lit(4)))
    return dealt.sortWithinPartitions("query", F.desc("cosine"), "candidate").mapInPandas(
        _score, "query string, candidate string, score double")


def best_names(index: NameIndex, asked: DataFrame) -> DataFrame:
    """``query, name, score``: the best name of every query that shares a gram with any name.

    ``asked`` is a table of vectors.  On each level the open queries meet the names with a cosine
    from there on; a query is done once even full similarity would not lift a name below the level
    above its best.  The first name wins a tie.
    """
    found = []
    open_ = asked.withColumn("best", F.lit(0.0))
    share = _cosine_share(F.col("clean"))
    for level in LEVELS:
        need = F.greatest(F.lit(level), (F.col("best") - (1 - share)) / share)
        pairs = _pairs(index.vectors, open_.withColumn("need", need), level)
        found.append(materialised(scores(pairs, index.names, open_)))
        if level <= 0:
            break
        now = found[-1].groupBy(F.col("query").alias("clean")).agg(F.max("score").alias("now"))
        open_ = materialised(
            lookup_join(open_, now, ["clean"], "left")
            .withColumn("best", F.greatest("best", "now")).drop("now")
            .where(F.col("best") < share * level + (1 - share) + SLACK))
        if open_.isEmpty():
            break
    named = lookup_join(
        reduce(DataFrame.unionByName, found).withColumnRenamed("candidate", "clean"), index.names, ["clean"], "inner")
    first = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "position")
    return named.withColumn("__rank", F.row_number().over(first)).where("__rank = 1").select("query", "name", "score")


def fuzzy_match(df: DataFrame, query: str, index: NameIndex, threshold: float = 0.7) -> DataFrame:
    """The best name for every row, or none when it stays below ``threshold``.

    Adds ``cleaned_input``, ``matched_name``, ``confidence_score`` and ``is_match``.  The score is
    that of the best name, also below the threshold.  Names that share no gram with a query are no
    candidates (edit similarity alone gives them at most 0.4, or 0.6 for short queries); the score
    is null where there is no other name, and 0 for queries of fewer than two characters.
    """
    chosen = best_names(index, _asked(df, query, index)).select(
        F.col("query").alias("cleaned_input"), F.col("name").alias("__name"), F.col("score").alias("__score"))
    rows = df.withColumn("cleaned_input", clean_text(quoted(query)))
    joined = lookup_join(rows, chosen, ["cleaned_input"], "left")
    is_match = F.coalesce(F.col("__score") >= threshold - SLACK, F.lit(False))
    too_short = F.length("cleaned_input") < 2
    return joined.select(
        *[quoted(c) for c in df.columns if c != "cleaned_input"],
        "cleaned_input",
        F.when(is_match, F.col("__name")).alias("matched_name"),
        F.when(too_short, 0.0).otherwise(F.col("__score")).alias("confidence_score"),
        is_match.alias("is_match"),
    )


def match_names(
    spark: SparkSession, names: Sequence[str], index: NameIndex, threshold: float = 0.7
) -> DataFrame:
    """Match a handful of names given by hand."""
    asked = spark.createDataFrame([(n,) for n in names], "input string")
    return fuzzy_match(asked, "input", index, threshold)


def fuzzy_stats(result: DataFrame) -> DataFrame:
    """Queries, matches, match rate and the mean confidence of the matches."""
    matched = F.col("is_match")
    return result.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if(matched).alias("matches_found"),
        F.coalesce(F.avg(F.when(matched, F.col("confidence_score"))), F.lit(0.0))
        .alias("average_confidence"),
    ).select(
        "total_queries", "matches_found",
        percent(F.col("matches_found"), F.col("total_queries"), 4).alias("match_rate"),
        F.round("average_confidence", 6).alias("average_confidence"),
    )
