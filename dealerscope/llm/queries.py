"""The registered queries of this subpackage and their SQL.

Each query applies one operator to its whole table and derives the digest columns from its output.
"""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealerscope.llm import (
    decontamination, hard_negatives, language_id, line_dedup, minhash, nearest, packing, quality, shingle_join, token_counts, token_files, url_filters, whitening,
)
from dealerscope.llm.common import read_table, remainder
from dealerscope.sources.durable import fresh_path

Query = Callable[[SparkSession, str], DataFrame]

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_nearest(spark: SparkSession, folder: str) -> DataFrame:
    embeddings = read_table(spark, folder, "embeddings")
    return nearest.nearest(embeddings, embeddings.filter("vec_id % 20 = 0"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    documents, items = read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark")
    return decontamination.find_leaks(documents, items, whole=decontamination.WHOLE)


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, folder, "documents"), WORD_BPE)


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark)
    token_files.write_token_files(read_table(spark, folder, "documents"), path, BYTE_BPE)
    return token_files.read_token_files(spark, path, digest=True)


# E-mail addresses and runs of digits such as card or telephone numbers.
PERSONAL = r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+|[0-9]{6,}|[+][0-9][0-9() -]{8,}[0-9]"


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.recount_masked(read_table(spark, folder, "documents"), BYTE_BPE, PERSONAL, "[hidden]")


def op6_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    members = shingle_join.join_similar(read_table(spark, folder, "documents")).members
    return members.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.dedup_lines(read_table(spark, folder, "documents"))
    return kept.select("doc_id", F.col("lines_removed").cast("long").alias("lines_removed"), F.md5("text").alias("text_md5"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    model = quality.learn_quality(documents, labels.filter(remainder("doc_id", 4) != 2))
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    predicted = F.when(F.col("score") >= 0.7, 1).otherwise(0)
    return quality.score_quality(documents, model).select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    profiles = language_id.learn_profiles(documents, ~held_out)
    scored = language_id.predict_language(documents, profiles, ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_filters.judge_urls(read_table(spark, folder, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_minhash(spark: SparkSession, folder: str) -> DataFrame:
    members = minhash.near_duplicates(read_table(spark, folder, "documents"))
    return members.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", "kept")


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read_table(spark, folder, "embeddings"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read_table(spark, folder, "embeddings").withColumn("label", noisy)
    return hard_negatives.mine_hard_negatives(rows, rows.filter("vec_id % 100 = 0"))


def queries() -> dict[str, Query]:
    return {
        "op1_nearest": op1_nearest,
        "op2_decontamination": op2_decontamination,
        "op3_packing": op3_packing,
        "op4_token_files": op4_token_files,
        "op5_token_counts": op5_token_counts,
        "op6_ngram_jaccard": op6_ngram_jaccard,
        "op7_line_dedup": op7_line_dedup,
        "op8_quality": op8_quality,
        "op9_language_id": op9_language_id,
        "op10_url_filters": op10_url_filters,
        "op11_minhash": op11_minhash,
        "op12_whitening": op12_whitening,
        "op13_hard_negatives": op13_hard_negatives,
        "pipeline": corpus_pipeline.run,
    }


def _similar_sql(words: int, least: int, more: str = "") -> str:
    """Two documents link at 100 * shared >= least * all; the least id reached by links is found by recursion."""
    return rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [w] ELSE
    list_transform(range(1, len(w) - {words - 2}), lambda i: w[i:i + {words - 1}]) END) AS s FROM worded),
sets AS (SELECT DISTINCT doc_id, s FROM shingled),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS many FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * many >= {least} * (x.n + y.n - many)),
reach AS (SELECT DISTINCT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(d.doc_id, m), d.doc_id) AS component_id{more}
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = d.doc_id
"""

# Windows forward and back of at least 25 words, compared as lists of lines.
_LINES_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
every AS (SELECT doc_id, unnest(ls) AS raw, unnest(range(len(ls))) AS spot FROM split),
lines AS (
  SELECT doc_id, spot, line, len(regexp_split_to_array(line, '\s+')) AS words,
    row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS k
  FROM (SELECT doc_id, spot, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM every) WHERE line <> ''),
summed AS (
  SELECT *, CAST(sum(words) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS until FROM lines),
spans AS (
  SELECT a.doc_id, false AS back, a.k AS i, b.k AS j FROM (SELECT *, until - words + 25 AS need FROM summed) a
    ASOF JOIN summed b ON a.doc_id = b.doc_id AND a.need <= b.until
  UNION ALL
  SELECT b.doc_id, true, a.k, b.k FROM (SELECT *, until - 25 AS need FROM summed) b
    ASOF JOIN (SELECT *, until - words AS before FROM summed) a ON a.doc_id = b.doc_id AND b.need >= a.before),
lists AS (SELECT doc_id, list(line ORDER BY k) AS ls, list(spot ORDER BY k) AS places FROM lines GROUP BY doc_id),
windows AS (
  SELECT doc_id, back, i, places[i] AS f, places[j] AS l, ls[i:j] AS content FROM spans JOIN lists USING (doc_id)),
later AS (
  SELECT doc_id, f, l FROM (SELECT *, row_number() OVER (PARTITION BY back, content ORDER BY doc_id, i) AS r FROM windows)
  WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(f, l + 1)) AS spot FROM later),
kept AS (
  SELECT doc_id, string_agg(raw, chr(10) ORDER BY spot) FILTER (g.spot IS NULL) AS text, count(g.spot) AS many
  FROM every LEFT JOIN gone g USING (doc_id, spot) GROUP BY doc_id)
SELECT doc_id, coalesce(many, 0) AS lines_removed, CASE WHEN d.text IS NOT NULL THEN md5(coalesce(k.text, '')) END AS text_md5
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

_HOST = "translate(regexp_extract({0}, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract({0}, '^.*?://[^/?#]*([^?#]*)', 1, 's')"
_NODE = (
    "CASE WHEN contains({0}, '://') THEN lower(regexp_extract({0}, '^(.*?)://', 1, 's')) || '://' || "
    + _HOST + " || " + _PATH + r" || regexp_extract({0}, '^.*?://[^?#]*(\?[^#]*)', 1, 's') END"
)


def _urls_sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    attribute = r"""'\b{0}\s*=\s*["'']?([^"''\s>]+)', 1, 'is'"""
    scheme = "regexp_extract(url, '^(.*?)://', 1, 's')"
    root = f"{scheme} || '://' || " + _HOST.format("url")
    return rf"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES {rules}),
tags AS (
  SELECT url, unnest(regexp_extract_all(html, '<(?:link|meta)\b[^>]*>', 0, 'is')) AS tag FROM pages WHERE html IS NOT NULL),
targets AS (
  SELECT url, replace(CASE
    WHEN regexp_matches(tag, '^<link\b.*\brel\s*=\s*["'']?canonical\b', 'is') THEN regexp_extract(tag, {attribute.format('href')})
    WHEN regexp_matches(tag, '^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b', 'is') THEN regexp_extract(tag, {attribute.format('url')})
    END, '&amp;', '&') AS dest FROM tags),
full_targets AS (
  SELECT url, CASE WHEN regexp_matches(dest, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN dest
    WHEN starts_with(dest, '//') THEN {scheme} || ':' || dest
    WHEN starts_with(dest, '/') THEN {root} || dest
    ELSE {root} || coalesce(nullif(regexp_extract({_PATH.format('url')}, '^(.*/)', 1, 's'), ''), '/') || dest END AS dest
  FROM targets WHERE dest <> ''),
edges AS (SELECT DISTINCT {_NODE.format('url')} AS a, {_NODE.format('dest')} AS b FROM full_targets),
links AS (
  SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach AS (SELECT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
judged_nodes AS (
  SELECT DISTINCT n.b, first(r.verdict ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) OVER (PARTITION BY n.b) AS verdict
  FROM (SELECT DISTINCT b FROM reach) n JOIN rules r ON ({_HOST.format('n.b')} = r.host OR ends_with({_HOST.format('n.b')}, '.' || r.host))
    AND starts_with({_PATH.format('n.b')}, r.path)),
blocked AS (SELECT DISTINCT reach.a AS node FROM reach JOIN judged_nodes USING (b) WHERE verdict = 'block'),
located AS (
  SELECT row_number() OVER () AS row_id, page_id, coalesce({_HOST.format('url')}, '') AS host, coalesce({_PATH.format('url')}, '') AS path,
    {_NODE.format('url')} AS node FROM pages),
matched AS (
  SELECT row_id, r.host || r.path AS rule, verdict,
    row_number() OVER (PARTITION BY row_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS place
  FROM located l JOIN rules r ON (l.host = r.host OR ends_with(l.host, '.' || r.host)) AND starts_with(l.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN b.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM located l LEFT JOIN (SELECT * FROM matched WHERE place = 1) m USING (row_id) LEFT JOIN blocked b ON b.node = l.node
"""


# Every anchor against all rows, in whole numbers.
_NEGATIVES_SQL = """
WITH rows AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_hard_negatives": _NEGATIVES_SQL, "op6_ngram_jaccard": _similar_sql(5, 75), "op11_minhash": _similar_sql(2, 80, ", d.doc_id = component_id AS kept"), "op7_line_dedup": _LINES_SQL, "op10_url_filters": _urls_sql()}
