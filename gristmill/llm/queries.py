"""Registered queries of the training-data operators, with their SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LIMIT, END_ID = 4096, 1


def query(sql: str | None = None) -> Callable:
    def register(plan: Callable[[SparkSession, str], DataFrame]) -> Callable:
        REGISTRY[plan.__name__] = plan
        if sql is not None:
            ORACLES[plan.__name__] = sql
        return plan

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from gristmill.llm.packing import pack

    return pack(table(spark, folder, "documents"), tokenizer_path(), LIMIT, END_ID)


@query()
def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    from gristmill.llm.sharding import shard

    return shard(table(spark, folder, "documents"), 40)


@query()
def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from gristmill.llm.windows_dedup import dedup_report

    return dedup_report(table(spark, folder, "documents"), 20)


@query()
def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from gristmill.llm.suffix_dedup import dedup_report

    return dedup_report(table(spark, folder, "documents"), 50)


@query()
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from gristmill.llm.toxicity import report

    return report(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    from gristmill.llm.quality import report

    return report(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("""
WITH part AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
    FROM part q JOIN part c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM near)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM placed WHERE place <= 20
""")
def op4_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    from gristmill.llm.neighbours import nearest

    return nearest(table(spark, folder, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0, 20)


@query()
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from gristmill.llm.decontaminate import contaminated

    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op6_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    from gristmill.llm.chat import EXAMPLE_SCHEMAS, example_messages, format_chats

    return format_chats(example_messages(table(spark, folder, "conversations")), EXAMPLE_SCHEMAS)


@query()
def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from gristmill.llm.jaccard import similar

    return similar(table(spark, folder, "documents"))


@query()
def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from gristmill.llm.alignment import align

    return align(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                 public_tokenizers.path("piece_bpe_32k.model"))


@query("""
WITH RECURSIVE steps AS (
    SELECT range AS byte, range::BIGINT AS v, 0 AS step FROM range(256)
    UNION ALL
    SELECT byte, xor(v >> 1, 3988292384 * (v & 1)), step + 1 FROM steps WHERE step < 8),
crc AS (SELECT list(v ORDER BY byte) AS entry FROM steps WHERE step = 8),
turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
    SELECT conv_id, xor(list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
               lambda acc, c: xor(acc >> 8, entry[xor(acc & 255, c) + 1])), 4294967295) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM turns), crc),
rebuilt AS (
    SELECT c.conv_id, 0 AS part, t.place, t.role, t.text
    FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.place <= c.h
    UNION ALL
    SELECT c.conv_id, 1, t.place, t.role, t.text
    FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h),
lists AS (
    SELECT c.conv_id, coalesce(list([r.role, r.text] ORDER BY part, place) FILTER (place IS NOT NULL), []) AS said
    FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
prefixes AS (
    SELECT conv_id, len(said) AS total, depth, said[1:depth] AS key, coalesce(strlen(said[depth][2]), 0) AS size
    FROM (SELECT *, unnest(range(0, len(said) + 1)) AS depth FROM lists)),
nodes AS (
    SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
           coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (total = depth), '') AS ends
    FROM prefixes GROUP BY depth, key),
children AS (
    SELECT depth - 1 AS depth, key[1:depth - 1] AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
counted AS (
    SELECT n.*, coalesce(c.n_children, 0) AS n_children
    FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.key = n.key),
subtrees AS (
    SELECT above AS depth, key[1:above] AS key, sum((n_convs - 1) * size) AS saved, count_if(n_children = 0) AS leaves
    FROM (SELECT *, unnest(range(0, depth + 1)) AS above FROM counted) GROUP BY 1, 2)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM counted n JOIN subtrees s ON s.depth = n.depth AND s.key = n.key
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.key[1:n.depth - 1]
""")
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    from gristmill.llm.trie import prefix_trie

    return prefix_trie(table(spark, folder, "conversations"))


@query()
def op11_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from gristmill.llm.language import report

    return report(table(spark, folder, "documents"))
