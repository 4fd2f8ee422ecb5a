"""The queries op1 to op10 of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import bpe, decontaminate, html_wrappers, language_id, license_scan, line_dedup, media_chunks, near_dedup, url_filter, wavelet
from glyphmill.llm.common import table

BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_VOCABULARY = "word_bpe_49k.json"
#: The rules of the URL contract.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract_text(table(spark, sf_dir, "pages"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_wavelet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = wavelet.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY), end_id=1)
    return wavelet.read_documents(shards)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    names = F.sort_array(F.transform("items", lambda i: i.cast("string")))
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs)
    rows = docs.select("doc_id", "text", language_id.held_out("doc_id").alias("held_out"))
    return language_id.identify(rows, model).select("doc_id", "held_out", "lang_pred", "score", "phrase_len")


def op9_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.media_features(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_report(table(spark, sf_dir, "documents"))


def queries() -> dict:
    named = (op1_byte_bpe, op2_html_text, op3_url_filter, op4_wavelet_ids, op5_decontaminate, op6_near_dedup, op7_license_scan, op8_language_id, op9_media_chunks, op10_line_dedup)
    return {f.__name__: f for f in named}


_WORDS = r"list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda w: w <> '')"

OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS m, array_to_string(list_slice(ws, i, i + least(10, len(ws)) - 1), ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
),
lens AS (SELECT DISTINCT m FROM wins),
pos AS (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, lens WHERE len(ws) >= m),
occ AS (
  SELECT p.doc_id, p.i, p.m, x.item_id FROM pos p
  JOIN wins x ON x.m = p.m AND x.w = array_to_string(list_slice(p.ws, p.i, p.i + p.m - 1), ' ')
),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM occ) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + least(4, len(ws)) - 1), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(4, len(ws)) + 2)) AS i FROM w WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_id AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(m, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_id ON least_id.a = w.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate": OP5_SQL, "op6_near_dedup": OP6_SQL}
