"""The corpus operators' queries, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, collocations, htmltext, langid, media, mixing, packing, quality, simhash, tokencount, topk, urlfilter, warc
from .common import fold, read

#: The same vocabulary as byte_bpe_50k.json, as ranks; the ids are equal and made four times as fast.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_features(read(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), VOCABULARY)


def language_model(documents: DataFrame) -> langid.Prototypes:
    return langid.learn(documents.where(F.coalesce(fold("doc_id", 5), F.lit(0)) != 0))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    found = langid.predict(documents, language_model(documents))
    return found.select("doc_id", (F.coalesce(fold("doc_id", 5), F.lit(0)) == 0).alias("held_out"), "lang_pred", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def quality_model(documents: DataFrame, labels: DataFrame) -> quality.Model:
    labelled = labels.where(F.coalesce(fold("doc_id", 4), F.lit(2)) != 2).select("doc_id", "quality")
    return quality.learn(documents.select("doc_id", "text", F.length("text").alias("size")).join(labelled, "doc_id"), size="size")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    found = quality.predict(documents, quality_model(documents, read(spark, sf_dir, "labels")))
    return found.select("doc_id", (F.coalesce(fold("doc_id", 4), F.lit(2)) == 2).alias("held_out"), "score", "predicted")


def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(read(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.response_records(read(spark, sf_dir, "pages")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op10_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read(spark, sf_dir, "pages"))


def op11_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read(spark, sf_dir, "documents"), PIECES)


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(read(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_media, op2_packing, op3_langid, op4_topk, op5_quality, op6_urlfilter, op7_mixing, op8_warc, op9_simhash, op10_htmltext, op11_tokencount, op12_clustering, op13_collocations)
    return {f.__name__: f for f in made}


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP6_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^([^?#]*)', 1, 's') ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(rest, length(regexp_extract(rest, '^([^/]*)', 1, 's')) + 1) AS path FROM cut
), rules(r_host, r_path, says) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), keyed AS (SELECT row_number() OVER () AS id, * FROM named
), fits AS (
  SELECT k.id, r_host || r_path AS rule, says, row_number() OVER (PARTITION BY k.id ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) AS n
  FROM keyed k JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT page_id, host, path, rule, coalesce(says, 'allow') AS verdict FROM keyed LEFT JOIN (SELECT * FROM fits WHERE n = 1) f ON keyed.id = f.id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_topk": OP4_SQL, "op6_urlfilter": OP6_SQL, "op8_warc": warc.DERIVE_SQL, "op12_clustering": clustering.CLUSTER_SQL, "op13_collocations": collocations.COLLOCATIONS_SQL}
