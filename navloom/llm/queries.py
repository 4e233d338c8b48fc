"""The registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navloom.llm import alignment, bpe, chat, embed_dedup, exact_dedup, mixing, ngram_join, pii, prefix_trie, quality, sharding, token_counts, winnow
from navloom.llm.common import table


PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_classes(table(spark, sf_dir, "documents"), words=3, percent=90)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).drop("source")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Fixed value: the added conversation, whose texts look like markup.
    tricky = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(added)
    return chat.read_back(chat.format_conversations(rows, BYTE_BPE))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), WORD_BPE, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_virtual_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    return found.select(
        "doc_id", *(count(n).alias(f"n_{kind}") for n, kind in enumerate(pii.KINDS)),
        F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.concat("base", "added")).alias("spans"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_classes(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), WORD_BPE)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_winnow_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op13_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_sums(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_mix_sources, op3_quality_rules, op4_embedding_near_dedup, op5_chat_format, op6_bpe_round_trip, op7_virtual_slot_shards, op8_personal_data, op9_exact_dedup, op10_token_counts, op11_conversation_trie, op12_winnow_benchmark, op13_align_tokenizers)}


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((rank - 1) % 3 + 1)::INT] AS weight, source_size * 2 AS cap FROM r),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size,
         [6.0::DOUBLE, 1.5::DOUBLE, 0.5::DOUBLE][((rank - 1) % 3 + 1)::INT] AS w0,
         [4.0::DOUBLE, 2.5::DOUBLE, 1.5::DOUBLE][((rank - 1) % 3 + 1)::INT] AS w1,
         CASE WHEN level * weight >= cap THEN cap::DOUBLE
              ELSE max(CASE WHEN level * weight < cap THEN level END) OVER () * weight END AS target
  FROM l),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.w0, t.w1, floor(t.target + 0.5)::BIGINT AS demand,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN demand // greatest(source_size, 1) ELSE 0 END AS turns,
         least(before::DOUBLE / greatest(demand, 1)::DOUBLE, 1.0::DOUBLE) * ((w0 + w1) / 2.0::DOUBLE) AS area
  FROM c),
f AS (
  SELECT *, (size * turns + greatest(0, least(size, demand - turns * source_size - before)))::BIGINT AS taken,
         w0 + sqrt(w0 * w0 + 2.0::DOUBLE * (w1 - w0) * area) AS root
  FROM e)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN CASE WHEN root > 0 THEN 2.0::DOUBLE * area / root ELSE 0.0::DOUBLE END END AS position
FROM f
"""

OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(role) * 3 - length(replace(role, '\', '')) - length(replace(role, '<', '')) AS role_chars,
         length(text) * 3 - length(replace(text, '\', '')) - length(replace(text, '<', '')) AS text_chars
  FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       sum(length('<turn><say></turn>') + 1 + role_chars + text_chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM d)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256)::BIGINT AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM h
"""

#: The digest of a short list of bits is worked out step by step: DuckDB has no CRC-32.
OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS source, t.place, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL SELECT c.conv_id, 1, t.place, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.place > c.h),
s AS (SELECT conv_id, sha256(len(role)::VARCHAR || ' ' || role || text) AS token, strlen(text)::BIGINT AS bytes,
             row_number() OVER (PARTITION BY conv_id ORDER BY source, place) AS depth FROM r),
p AS (
  SELECT conv_id, depth, bytes, string_agg(token, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM s
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT conv_id, max(depth) AS length FROM p GROUP BY conv_id),
n AS (
  SELECT key, depth, min(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
  FROM p JOIN l USING (conv_id) GROUP BY key, depth),
k AS (SELECT n.*, up.key AS parent_key FROM n LEFT JOIN p AS up ON up.conv_id = n.conv_id AND up.depth = n.depth - 1),
f AS (SELECT parent_key AS key, count(*) AS n_children FROM k WHERE parent_key IS NOT NULL GROUP BY parent_key),
u AS (
  SELECT top.key, sum((k.n_convs - 1) * k.bytes) AS saved_tokens, count(*) FILTER (f.key IS NULL) AS n_leaves
  FROM k JOIN p AS top ON top.conv_id = k.conv_id AND top.depth <= k.depth LEFT JOIN f ON f.key = k.key GROUP BY top.key)
SELECT k.conv_id, k.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, k.n_convs::BIGINT AS n_convs, coalesce(f.n_children, 0)::BIGINT AS n_children,
       u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM k JOIN u ON u.key = k.key LEFT JOIN f ON f.key = k.key LEFT JOIN n AS up ON up.key = k.parent_key
"""

OP12_SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS row,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT item_id, least(len(words), 10) AS size, words FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark) WHERE len(words) > 0),
i AS (
  SELECT DISTINCT item_id, size, array_to_string(words[b0 : b0 + size - 1], ' ') AS window_words
  FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS b0 FROM b)),
d AS (
  SELECT row, b0, size, array_to_string(words[b0 : b0 + size - 1], ' ') AS window_words
  FROM (SELECT row, words, size, unnest(range(1, len(words) - size + 2)) AS b0 FROM w, (SELECT DISTINCT size FROM i))),
h AS (SELECT row, b0, d.size, item_id FROM d JOIN i USING (window_words)),
n AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(b0, b0 + size)) AS p FROM h) GROUP BY row),
l AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (row) LEFT JOIN l USING (row)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": OP2_SQL, "op5_chat_format": OP5_SQL, "op9_exact_dedup": OP9_SQL, "op11_conversation_trie": OP11_SQL, "op12_winnow_benchmark": OP12_SQL}
