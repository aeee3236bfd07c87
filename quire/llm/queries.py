"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe_codec, chat_format, decontaminate, embedding, line_dedup, minhash, quality, suffixes, token_counts, warc
from quire.llm.common import read, vocabulary_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(read(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_multi_50k.tiktoken"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), width=2).drop("body")


def op3_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_vectors(read(spark, sf_dir, "embeddings"), cosine=0.98)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"), quality.graded())
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id",
        "expected_grade",
        F.element_at("tails", 1).alias("p_at_least_1"),
        F.element_at("tails", 2).alias("p_at_least_2"),
        quality.accepted().alias("accepted"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.captured(spark, read(spark, sf_dir, "pages"))
    return index.select(
        F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").alias("refers_to")
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = "\\### Assistant: </turn> ok"
    extra = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role").withColumn("text", F.lit(both))
    chats = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digests(chat_format.format_chats(chats))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(read(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
    return token_counts.with_limit(counts, 1024)


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.dedup_substrings(read(spark, sf_dir, "documents"), length=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_minhash": op2_minhash,
    "op3_embedding": op3_embedding,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_warc": op6_warc,
    "op7_chat_format": op7_chat_format,
    "op8_quality": op8_quality,
    "op9_token_counts": op9_token_counts,
    "op10_suffixes": op10_suffixes,
}

OP7_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
    SELECT *, length(role) + length(text) + 4 + 2 + 8
        + (length(role || chr(9) || text) - length(replace(role || chr(9) || text, '\', '')))
        + (length(role || chr(9) || text) - length(replace(role || chr(9) || text, ':', '')))
        + (length(role || chr(9) || text) - length(replace(role || chr(9) || text, '###', ''))) // 3
        + (length(role || chr(9) || text) - length(replace(role || chr(9) || text, '</turn>', ''))) // 7 AS chars
    FROM rows
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars, false AS rewritten
FROM sized GROUP BY conv_id
"""

OP5_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id,
        coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w
    FROM documents
), b AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
    FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k:k + 12], ' ') AS s
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM b WHERE len(w) > 0)
), places AS (
    SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM windows)
), hits AS (
    SELECT row, k, windows.n AS n, item_id FROM places JOIN windows ON windows.n = places.n AND s = array_to_string(w[k:k + places.n - 1], ' ')
), covered AS (
    SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT row, unnest(range(k, k + n)) AS p FROM hits) GROUP BY row
), named AS (
    SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row, item_id FROM hits) GROUP BY row
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (row) LEFT JOIN named USING (row)
"""

OP3_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
    SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_sum([x * x for x in e]) > 0
        AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
    SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), lows AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN lows ON lows.a = vec_id
"""

OP6_SQL = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages WHERE page_id IS NOT NULL
), r AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS original FROM p)
SELECT page_id, payload_bytes,
    list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (((instr('0123456789abcdef', hex[5 * i // 4 + 1]) - 1) * 16
          + greatest(instr('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 2 AS BIGINT), 1)) - 1, 0)) >> (3 - 5 * i % 4)) % 32 + 1, 1)
        for i in range(32)], 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
FROM r
"""

ORACLE_SQL: dict[str, str] = {"op6_warc": OP6_SQL, "op3_embedding": OP3_SQL, "op5_decontaminate": OP5_SQL, "op7_chat_format": OP7_SQL}
