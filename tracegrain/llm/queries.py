"""The operators' queries over the synthetic tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_extract, importance, language_id, line_dedup, mixing, packing, prefix_trie, sharding, simhash, token_counts, toxicity, vector_search
from .common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SHARD_COUNT = 40


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain is low quality, then toxicity, the two categories that the labels have."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    categories = ["low_quality", "toxic"]
    scored = toxicity.classify(docs, toxicity.train(docs, labels, categories), categories)
    return scored.select("doc_id", (F.col("p_toxic") >= toxicity.THRESHOLD).alias("toxic"), "p_toxic", "p_low_quality")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.line_dedup(table(spark, sf_dir, "documents")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARD_COUNT)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector_search.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("row_key")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs)).drop("row_key")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("row_key")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), TOKENIZER)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_toxicity,
        op2_line_dedup,
        op3_sharding,
        op4_packing,
        op5_vector_search,
        op6_simhash,
        op7_mixing,
        op8_language_id,
        op9_html_extract,
        op10_exact_dedup,
        op11_token_counts,
        op12_prefix_trie,
        op13_importance_resampling,
    ]
    return {f.__name__: f for f in found}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Each row is a document of its own, as in the operator; a null doc_id ranks below all others.
OP2_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT row_no, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM docs),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM lines),
shared AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT row_no) >= 3),
judged AS (
  SELECT keyed.*, last_doc IS NOT NULL AND keyed.doc_id IS DISTINCT FROM last_doc AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY row_no
"""

#: The table of the CRC is made from its polynomial; the walk is that of the generator in sharding.MULTIPLIER.
OP3_SQL = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
sized AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) + 16 AS size FROM documents),
checked AS (
  SELECT doc_id, size, xor(list_reduce(list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM sized, crc_table),
walked AS (
  SELECT *, list_reduce(range(42), lambda w, _: CASE WHEN w.j > 40 THEN w ELSE {
      'key': (w.key * 2862933555777941757 + 1) % 18446744073709551616,
      'j': floor((w.j + 1)::DOUBLE * (2147483648::DOUBLE / (((w.key * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 + 1)::DOUBLE))::BIGINT,
      'n40': CASE WHEN w.j < 40 THEN w.j ELSE w.n40 END, 'n41': w.j} END,
    {'key': (CASE WHEN coalesce(doc_id, 0) < 0 THEN coalesce(doc_id, 0)::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END)::UHUGEINT, 'j': 0::BIGINT, 'n40': 0::BIGINT, 'n41': 0::BIGINT}) AS w
  FROM checked)
SELECT doc_id, size, text_crc32, 'key' AS law, w.n40::INTEGER AS shard,
       row_number() OVER (PARTITION BY w.n40 ORDER BY md5(coalesce(doc_id, 0) || '|' || text_crc32 || '|' || size), doc_id, text_crc32, size) - 1 AS slot,
       CASE WHEN w.j > 40 THEN w.n41 END::INTEGER AS grown_shard
FROM walked
"""

OP10_SQL = f"""
WITH normal AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
groups AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM normal GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM normal JOIN groups USING (t)
"""

#: Nodes by what their members have said; subtrees by the prefixes of what was said.
OP12_SQL = """
WITH placed AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS i,
         sha256(coalesce(role, '')) || sha256(coalesce(text, '')) AS said, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, i)) AS t),
convs AS (
  SELECT c, n, xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda x, b: xor(x // 256, t[xor(x % 256, b) + 1]), 4294967295::BIGINT), 4294967295) % 6 AS h
  FROM (SELECT c, count(*) AS n FROM placed GROUP BY c), bits),
sized AS (SELECT convs.*, least(h, coalesce(b.n, 0)) AS k FROM convs LEFT JOIN (SELECT c AS base, n FROM convs) b ON base = convs.c - convs.c % 100),
turns AS (
  SELECT s.c, p.i AS d, said, chars FROM sized s JOIN placed p ON p.c = s.c - s.c % 100 AND p.i <= s.h
  UNION ALL SELECT s.c, p.i - s.h + s.k, said, chars FROM sized s JOIN placed p ON p.c = s.c AND p.i > s.h),
path AS (
  SELECT c, d, string_agg(said, '') OVER (PARTITION BY c ORDER BY d) AS prefix, chars FROM turns
  UNION ALL SELECT c, 0, '', 0 FROM sized),
lens AS (SELECT c, max(d) AS len FROM path GROUP BY c),
nodes AS (
  SELECT prefix, d, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, max(len) = d AS leaf,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len = d), '')) AS ends_sha256
  FROM path JOIN lens USING (c) GROUP BY prefix, d),
up AS (SELECT n.*, left(n.prefix, 128 * a::INTEGER) AS above, a FROM (SELECT *, unnest(range(d + 1)) AS a FROM nodes) n),
below AS (
  SELECT above AS prefix, sum(leaf::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens, count(*) FILTER (WHERE d = a + 1) AS n_children
  FROM up GROUP BY above)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, b.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (prefix) LEFT JOIN nodes p ON n.d > 0 AND p.prefix = left(n.prefix, 128 * (n.d - 1)::INTEGER)
"""

#: The CRC is taken of distinct words.
OP13_SQL = f"""
WITH texts AS (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), item_id, text FROM benchmark),
said AS (SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
each AS (SELECT side, r, unnest(ws) AS w FROM said),
bits AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, i)) AS t),
hashed AS (
  SELECT w, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda x: ('0x' || x)::BIGINT), lambda x, b: xor(x // 256, t[xor(x % 256, b) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM each), bits),
counts AS (SELECT bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM each JOIN hashed USING (w) GROUP BY bucket),
sums AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counts),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM counts, sums),
summed AS (SELECT r, sum(gain)::BIGINT AS total FROM each JOIN hashed USING (w) JOIN gains USING (bucket) WHERE side = 0 GROUP BY r),
weighed AS (
  SELECT r, doc_id, len(ws) AS n_features, coalesce(floor(total::DOUBLE / nullif(len(ws), 0)), 0)::BIGINT AS weight,
         ('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT AS h
  FROM said LEFT JOIN summed USING (r) WHERE side = 0),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
placed AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (r)
"""

ORACLE_SQL = {"op12_prefix_trie": OP12_SQL, "op13_importance_resampling": OP13_SQL, "op2_line_dedup": OP2_SQL, "op3_sharding": OP3_SQL, "op10_exact_dedup": OP10_SQL}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
