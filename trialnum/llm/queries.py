"""Registered queries of the operators over the driver tables, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialnum.llm.brown import score_texts
from trialnum.llm.damage import damaged_turns, misspelt_words
from trialnum.llm.dialogue import audit_conversations, repaired_digests
from trialnum.llm.exact_dedup import duplicate_classes
from trialnum.llm.html_text import main_texts
from trialnum.llm.language import identify_languages
from trialnum.llm.licenses import scan_licenses
from trialnum.llm.mixing import mix_sources
from trialnum.llm.packing import pack
from trialnum.llm.quality import quality_scores
from trialnum.llm.search import top_k
from trialnum.llm.simhash import near_duplicate_classes
from trialnum.llm.spelling import variant_groups
from trialnum.llm.toxicity import toxicity_scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


@query
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix_sources(table(spark, folder, "documents"), weights=(3, 1, 2), share=(3, 2), most=2)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLES["op2_mixing"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
  [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
f AS (SELECT *, 2 * source_size AS cap,
  3 * sum(source_size) OVER () - 2 * coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight FROM s),
g AS (SELECT *, weight * rest >= 2 * cap * rest_weight AS is_full FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE
  CAST(weight * (SELECT rest FROM g WHERE NOT is_full ORDER BY 2 * source_size / weight, source NULLS LAST LIMIT 1) AS DOUBLE)
  / CAST(2 * (SELECT rest_weight FROM g WHERE NOT is_full ORDER BY 2 * source_size / weight, source NULLS LAST LIMIT 1) AS DOUBLE) END AS target FROM g),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) - 1 AS rank,
  ('0x' || substr(md5('42/' || CASE WHEN d.source IS NULL THEN 'n' ELSE 's' || d.source END), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(rate * (rank + 1) + u) - floor(rate * rank + u)) * size AS BIGINT) AS taken FROM r
"""


@query
def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return duplicate_classes(table(spark, folder, "documents"), keep="largest").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


ORACLES["op5_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
  count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


@query
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"), "quality", threshold=0.7)
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


@query
def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    classes = near_duplicate_classes(table(spark, folder, "documents"), shingle=3, budget=3)
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return classes.select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), "component_id")


@query
def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    found = identify_languages(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"), "toxic", threshold=0.3)
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted", "evidence")


@query
def op9_html(spark: SparkSession, folder: str) -> DataFrame:
    found = main_texts(table(spark, folder, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", "n_chars")


@query
def op10_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    scored = score_texts(table(spark, folder, "documents"))
    return scored.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


@query
def op3_search(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose doc_id is divisible by 100, as queries against all documents."""
    docs = table(spark, folder, "documents")
    found = top_k(docs, docs.where("doc_id % 100 = 0"), k=10)
    return found.select("query_id", "rank", F.col("id").alias("doc_id"), "score")


@query
def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return variant_groups(misspelt_words(table(spark, folder, "documents")))


# CRC-32 by its table; a word's near words share it without one point, or are it without one
CRC = """
crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8),
  lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT)) AS crc_at)
"""


def crc_sql(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(4294967295, list_reduce({octets}, lambda c, b: xor(c >> 8, crc_at[1 + (xor(c, b) & 255)]), 4294967295))"


ORACLES["op11_spelling"] = rf"""
WITH RECURSIVE {CRC},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
h AS (SELECT run, c, {crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h
  FROM (SELECT doc_id, run, count(*) AS c FROM r GROUP BY ALL), crc_table),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT c, CASE WHEN h % 31 = 0
    THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, 2 + (h % length(run))::BIGINT) ELSE run END AS word FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w),
d AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM p),
pairs AS (SELECT a.word, b.word AS near, b.n FROM d a JOIN d b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM pairs GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form,
  CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM w LEFT JOIN best ON best.word = w.word),
chain AS (SELECT word, word AS root, 0 AS steps FROM f
  UNION ALL SELECT chain.word, f.form, steps + 1 FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f
JOIN (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word) c ON c.word = f.word
"""


@query
def op12_conversations(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    turns = damaged_turns(conversations)
    audits = audit_conversations(turns)
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    every = ids.join(audits, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    none = F.col("audit").isNull()
    counts = [F.when(none, 0).otherwise(F.col(c)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return repaired_digests(turns, every.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit")))


ORACLES["op12_conversations"] = rf"""
WITH RECURSIVE {CRC},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fault FROM conversations, crc_table),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
  CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE fault <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM d),
f AS (SELECT conv_id, turn, role, text, i, NOT regexp_matches(text, '[^ 	-
]') AS blank,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
  NOT regexp_matches(text, '[.!?][ 	-
]*\z') AS cut,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
r AS (SELECT *, blank OR again AS gone, cut AND NOT blank AND NOT again AS open FROM f),
before(a, b, letters, lines, cost) AS (VALUES (0, 0, '', [], 0), (0, 2, 'I', ['user:'], 2), (0, 3, 'II', ['user:', 'assistant:'], 4),
  (1, 1, '', [], 0), (1, 2, 'I', ['user:'], 2), (1, 3, 'II', ['user:', 'assistant:'], 4),
  (2, 2, '', [], 0), (2, 3, 'I', ['assistant:'], 2), (3, 3, '', [], 0), (3, 2, 'I', ['user:'], 2)),
edit(b, initial, letter, z, role, cost) AS (VALUES (0, 's', 'K', 1, NULL, 0), (0, 'u', 'K', 2, NULL, 0), (1, 'u', 'K', 2, NULL, 0), (3, 'u', 'K', 2, NULL, 0),
  (2, 'a', 'K', 3, NULL, 0), (0, NULL, 'R', 2, 'user', 2), (1, NULL, 'R', 2, 'user', 2), (3, NULL, 'R', 2, 'user', 2), (2, NULL, 'R', 3, 'assistant', 2),
  (0, NULL, 'D', 0, NULL, 3), (1, NULL, 'D', 1, NULL, 3), (2, NULL, 'D', 2, NULL, 3), (3, NULL, 'D', 3, NULL, 3)),
move AS (SELECT a, z, initial, letter, role, letters || letter AS letters, lines, before.cost + edit.cost AS cost FROM before JOIN edit ON before.b = edit.b),
dp AS (SELECT conv_id, 0::BIGINT AS i, 0 AS state, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS best FROM r WHERE i = 1
  UNION ALL SELECT r.conv_id, r.i, move.z, min({{'cost': best.cost + move.cost + CASE WHEN open AND letter <> 'D' THEN 1 ELSE 0 END,
    'audit': best.audit || letters, 'lines': list_concat(best.lines, move.lines::VARCHAR[],
      CASE WHEN letter = 'D' THEN []::VARCHAR[] ELSE [coalesce(move.role, r.role) || ':' || text] END)}})
  FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1 JOIN move ON move.a = dp.state
    AND (letter = 'D' OR NOT gone) AND (initial IS NULL OR initial = left(r.role, 1))
  GROUP BY r.conv_id, r.i, move.z),
tail(state, letters, lines, cost) AS (VALUES (0, '', [], 0), (1, 'II', ['user:', 'assistant:'], 4), (2, 'I', ['assistant:'], 2), (3, '', [], 0)),
ends AS (SELECT conv_id, min({{'cost': best.cost + tail.cost, 'audit': best.audit || letters, 'lines': list_concat(best.lines, tail.lines::VARCHAR[])}}) AS best
  FROM dp JOIN tail ON tail.state = dp.state
  WHERE EXISTS (SELECT 1 FROM (SELECT conv_id, max(i) AS n FROM r GROUP BY conv_id) m WHERE m.conv_id IS NOT DISTINCT FROM dp.conv_id AND m.n = dp.i)
  GROUP BY conv_id),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
  count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (open) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
  sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@query
def op13_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_licenses(table(spark, folder, "documents"), BASE_PHRASES)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
