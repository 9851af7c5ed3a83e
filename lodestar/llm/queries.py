"""The registered queries of the text operators: thin calls with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import chat, ctw, decontam, embed_dedup, html_extract, lang_id, packing, token_store, warc
from lodestar.llm.common import id_bucket, table
from lodestar.llm.simhash import exact, simhash_components


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    held_out = id_bucket("doc_id", 3) == 1
    model = lang_id.fit(docs.filter(~held_out))
    return lang_id.classify(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles, linked at 3 differing bits or fewer."""
    return simhash_components(table(spark, sf_dir, "documents"), shingle=3, scheme=exact(3))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to shards with a shared dictionary and read back."""
    return token_store.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1).read()


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 512 to 8192 tokens (its words and an end)."""
    return packing.pack(packing.word_lengths(table(spark, sf_dir, "documents")))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings linked at a cosine of 0.9 or more."""
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message, tool call and result of the conversations as canonical JSON, in order; calls are checked against the tools' schemas."""
    tools = spark.createDataFrame(_TOOLS, "name string, parameter string, type string, required boolean")
    return chat.formatted(table(spark, sf_dir, "conversations"), tools)


#: The schemas of the tools: all that a call may be of.
_TOOLS = [("search", "query", "string", True), ("search", "place", "object", True), ("search", "place.turn", "integer", True)]


def planted_calls(conversations: DataFrame) -> DataFrame:
    """Messages made of a table of conversations: each user turn as a call of a tool, with its result.

    The result stands behind its call for even turns and before it for odd ones;
    it is lacking for every fifth turn, and the arguments are wrong for every seventh.
    """
    user = conversations.filter("role = 'user' and turn is not null and conv_id is not null").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    call_id = F.concat(F.lit("t"), F.col("turn").cast("string"))
    right, wrong = F.to_json(F.struct(F.struct("turn").alias("place"), F.col("text").alias("query"))), F.to_json(F.struct(F.struct(F.col("text").alias("turn")).alias("place")))
    call = F.concat(F.lit('{"tool_calls":[{"id":"'), call_id, F.lit('","name":"search","arguments":'), F.when(F.col("turn") % 7 == 3, wrong).otherwise(right), F.lit("}]}"))
    calls = user.select("conv_id", (3 * F.col("turn")).alias("turn"), F.lit("assistant").alias("role"), call.alias("text"))
    said = F.to_json(F.struct(F.col("text").alias("content"), call_id.alias("tool_call_id")))
    results = user.filter("turn % 5 <> 4").select("conv_id", (3 * F.col("turn") + F.when(F.col("turn") % 2 == 0, 1).otherwise(-1)).alias("turn"), F.lit("tool").alias("role"), said.alias("text"))
    return calls.unionAll(results)


def chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls linked to their results, ordered and checked, over messages made of all conversations."""
    tools = spark.createDataFrame(_TOOLS, "name string, parameter string, type string, required boolean")
    return chat.formatted(planted_calls(table(spark, sf_dir, "conversations")), tools)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context-tree and word-count scores of every document, learned from those outside the held-out fifth."""
    return ctw.scores(table(spark, sf_dir, "documents"), id_bucket("doc_id", 5) == 1)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of every document with windows of 13 words of the benchmark's items."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, share=20)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A content-addressed archive of every page, written and read back."""
    return warc.write_archive(table(spark, sf_dir, "pages")).read()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_simhash_near_dedup, op3_token_ids, op4_best_fit_packing, op5_embedding_near_dedup, op6_chat_formatting, op7_html_extraction, op8_lm_scoring, op9_benchmark_decontamination, op10_warc, chat_tool_calls)}


def oracle_sql() -> dict[str, str]:
    return {"op5_embedding_near_dedup": _OP5, "op6_chat_formatting": _OP6, "op9_benchmark_decontamination": _OP9, "op10_warc": _OP10, "chat_tool_calls": _CALLS}


_OP9 = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS k
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS s FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS k
         FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, lens WHERE len(w) >= n)),
occ AS (SELECT r, s, win.n, item_id FROM dwin JOIN win ON dwin.n = win.n AND dwin.k = win.k),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM occ) GROUP BY r),
met AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hits USING (r) LEFT JOIN met USING (r)
"""

_OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
h AS (SELECT *, sha1(body) AS hex FROM p)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
         1 + ((CAST('0x' || hex[1 + (k // 8) * 10 : 10 + (k // 8) * 10] AS BIGINT) >> (35 - 5 * (k % 8))) & 31)]), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM h
"""

_OP6 = """
SELECT conv_id, turn, CAST(0 AS INTEGER) AS item, 'message' AS kind, role, CAST(NULL AS VARCHAR) AS call_id, CAST(NULL AS BIGINT) AS call_turn, turn AS order_turn,
       CAST(0 AS INTEGER) AS order_step, TRUE AS valid, CAST(NULL AS VARCHAR) AS error, CAST(json_object('content', text, 'role', role) AS VARCHAR) AS json
FROM conversations
"""

_CALLS = """
WITH u AS (SELECT conv_id, turn, coalesce(text, '') AS text, 't' || turn AS id FROM conversations WHERE role = 'user' AND turn IS NOT NULL AND conv_id IS NOT NULL),
c AS (SELECT *, 3 * turn AS place, count(*) OVER (PARTITION BY conv_id, id) AS n, turn % 7 = 3 AS bad, turn % 5 <> 4 AS answered FROM u),
r AS (SELECT *, 3 * turn + CASE WHEN turn % 2 = 0 THEN 1 ELSE -1 END AS place FROM u WHERE turn % 5 <> 4),
e AS (SELECT *, CASE WHEN n > 1 THEN 'repeated identifier' WHEN bad THEN 'missing: query; wrong type: place.turn' WHEN NOT answered THEN 'call without a result' END AS error FROM c)
SELECT conv_id, place AS turn, CAST(0 AS INTEGER) AS item, 'message' AS kind, 'assistant' AS role, CAST(NULL AS VARCHAR) AS call_id, CAST(NULL AS BIGINT) AS call_turn, place AS order_turn, CAST(0 AS INTEGER) AS order_step,
       TRUE AS valid, CAST(NULL AS VARCHAR) AS error, '{"content":null,"role":"assistant"}' AS json FROM c
UNION ALL
SELECT conv_id, place, 1, 'call', 'assistant', id, place, place, 1, error IS NULL, error,
       '{"arguments":' || CASE WHEN bad THEN CAST(json_object('place', json_object('turn', text)) AS VARCHAR) ELSE CAST(json_object('place', json_object('turn', turn), 'query', text) AS VARCHAR) END
       || ',"id":"' || id || '","name":"search","type":"tool_call"}' FROM e
UNION ALL
SELECT conv_id, place, 0, 'result', 'tool', id, 3 * turn, CASE WHEN place < 3 * turn THEN 3 * turn ELSE place END, CASE WHEN place < 3 * turn THEN 2 ELSE 0 END, TRUE, NULL,
       CAST(json_object('content', text, 'role', 'tool', 'tool_call_id', id) AS VARCHAR) FROM r
"""

_OP5 = """
WITH RECURSIVE v AS (SELECT vec_id AS id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS x FROM embeddings),
g AS (SELECT row_number() OVER (ORDER BY id) AS r, id, x, sqrt(list_dot_product(x, x)) AS size FROM v
      WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND list_dot_product(x, x) > 0),
pairs AS (SELECT a.r, a.id, b.r AS s, b.id AS other FROM g a JOIN g b ON a.r <> b.r AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / (a.size * b.size) >= 0.9),
reach AS (SELECT r, r AS s, id AS other FROM g UNION SELECT reach.r, pairs.s, pairs.other FROM reach JOIN pairs ON pairs.r = reach.s),
comp AS (SELECT r, min(other) AS component_id FROM reach GROUP BY r), n AS (SELECT r, count(*) AS n FROM pairs GROUP BY r)
SELECT g.id AS vec_id, coalesce(n.n, 0) AS n_links, component_id, g.id = component_id AS kept FROM g JOIN comp USING (r) LEFT JOIN n USING (r)
UNION ALL SELECT id, 0, id, true FROM v WHERE NOT (x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND list_dot_product(x, x) > 0) OR x IS NULL
"""
