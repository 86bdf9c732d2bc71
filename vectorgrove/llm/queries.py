"""Named queries of the corpus operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from vectorgrove.llm import language_model, mpeg_audio, neardup, packing, quality, sentencepiece_bpe, sharding, topk, toxicity, warc
from vectorgrove.llm.common import documents, labels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.read(mpeg_audio.store(documents(spark, sf_dir)))


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


@query
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.exact_top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


ORACLES["op9_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings),
p AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(CAST(q.c AS DOUBLE[]), CAST(x.c AS DOUBLE[])) AS BIGINT) AS score
  FROM v q, v x WHERE q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score_documents(docs, quality.fit(docs, labels(spark, sf_dir)))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.fit_and_score(documents(spark, sf_dir), labels(spark, sf_dir))


@query
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(documents(spark, sf_dir))


@query
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


ORACLES["op4_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS whole FROM s GROUP BY doc_id),
c AS (SELECT whole, min(doc_id) AS cls, any_value(n) AS n FROM n GROUP BY whole),
t AS (SELECT s.doc_id AS cls, shingle, n FROM s JOIN c ON s.doc_id = c.cls),
l AS (
  SELECT a.cls AS a, b.cls AS b FROM t a JOIN t b ON a.shingle = b.shingle AND a.cls < b.cls
  GROUP BY a.cls, b.cls, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT cls AS node, cls AS reached FROM c UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached),
m AS (SELECT node, min(reached) AS component FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component, d.doc_id) AS component_id, coalesce(m.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON n.whole = c.whole LEFT JOIN m ON c.cls = m.node
"""


def captures(pages: DataFrame) -> DataFrame:
    """Archive records of pages: a full response of each, and a revisit later with one of four kinds of validators."""
    t = F.expr("page_id * 7919 % 1000003")
    modified = F.concat(F.lit("t"), (t - F.col("page_id") % 86400).cast("string"))
    tag = F.concat(F.lit('"'), F.md5(F.col("html").cast("binary")), F.lit('"'))
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", t.alias("date"), F.lit("response").alias("kind"), F.lit(200).alias("status"), F.md5(F.col("html").cast("binary")).alias("digest"),
        F.create_map(F.lit("etag"), tag, F.lit("last-modified"), modified, F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-type"), F.lit("text/html")).alias("headers"),
    )
    age = F.concat(F.lit("max-age="), (F.col("page_id") % 100).cast("string"))
    extra = (F.lit("cache-control"), age, F.lit("content-type"), F.lit("text/plain"))
    validators = (
        F.when(F.col("page_id") % 4 == 0, F.create_map(F.lit("etag"), tag, *extra))
        .when(F.col("page_id") % 4 == 1, F.create_map(F.lit("last-modified"), modified, *extra))
        .when(F.col("page_id") % 4 == 2, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), *extra))
        .otherwise(F.create_map(*extra))
    )
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", (t + 1 + F.col("page_id") % 5 * 100000).alias("date"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), F.lit(None).cast("string").alias("digest"), validators.alias("headers"),
    )
    return full.unionByName(again)


@query
def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return found.withColumn("headers", warc.headers_text(F.col("headers")))


ORACLES["op10_warc_revisits"] = r"""
WITH p AS (
  SELECT page_id, md5(html) AS h, page_id * 7919 % 1000003 AS t, 't' || CAST(page_id * 7919 % 1000003 - page_id % 86400 AS VARCHAR) AS lm,
    regexp_replace(trim(url), '#.*$', '') AS bare FROM pages),
u AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^www[0-9]*\.', '') AS host,
    regexp_replace(bare, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*', '') AS rest FROM p),
q AS (
  SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') AS params FROM u),
s AS (
  SELECT *, host || regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/+$', '') || CASE WHEN params <> '' THEN '?' || params ELSE '' END AS site FROM q),
m AS (
  SELECT v.page_id AS vid, r.page_id AS rid, v.h AS vh, r.h AS rh, v.lm AS vlm, r.lm AS rlm,
    row_number() OVER (PARTITION BY v.page_id ORDER BY r.t DESC NULLS LAST, r.page_id DESC) AS n
  FROM s v LEFT JOIN s r ON v.site = r.site AND r.t < v.t + 1 + v.page_id % 5 * 100000),
o AS (
  SELECT *, CASE WHEN rid IS NULL THEN 'missing'
    WHEN vid % 4 IN (0, 2) THEN CASE WHEN vh = rh THEN 'resolved' ELSE 'mismatch' END
    WHEN vid % 4 = 1 THEN CASE WHEN vlm = rlm THEN 'resolved' ELSE 'mismatch' END ELSE 'unvalidated' END AS outcome FROM m WHERE n = 1)
SELECT vid * 2 + 1 AS record_id, outcome,
  CASE WHEN outcome IN ('resolved', 'unvalidated') THEN rid * 2 END AS refers_to,
  CASE WHEN outcome IN ('resolved', 'unvalidated') THEN rh END AS digest,
  CASE WHEN outcome IN ('resolved', 'unvalidated') THEN
    'cache-control: max-age=' || CAST(vid % 100 AS VARCHAR) || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || CASE WHEN vid % 4 = 2 THEN 'W/' ELSE '' END || '"' || CASE WHEN vid % 4 IN (0, 2) THEN vh ELSE rh END || '"' || chr(10) || 'last-modified: ' || rlm END AS headers
FROM o
"""
