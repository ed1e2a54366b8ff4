"""The registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelgrid.llm import knn, language_id, licenses, lm_scoring, minhash, mixing, packing, pii, quality, simhash
from ravelgrid.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(sf_dir, "documents", spark))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(sf_dir, "documents", spark))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_pairs(table(sf_dir, "documents", spark))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(sf_dir, "documents", spark)
    return language_id.identify(docs, language_id.fit_documents(docs))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(sf_dir, "documents", spark))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(sf_dir, "documents", spark))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(sf_dir, "documents", spark))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(sf_dir, "embeddings", spark))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(sf_dir, "documents", spark)
    return quality.score_documents(docs, quality.fit_documents(docs, table(sf_dir, "labels", spark)))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(sf_dir, "documents", spark)
    narrow = docs.select("doc_id", "source", F.xxhash64(*docs.columns).alias("row_hash"))  # the schedule needs no more
    return mixing.interleave(narrow).select(
        "doc_id", "source", F.col("__block").alias("block"), F.col("__slot").alias("slot"), F.col("__position").alias("position")
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    found = [
        op1_lm_scoring, op2_simhash, op3_minhash, op4_language_id, op5_packing, op6_pii, op7_licenses, op8_top_k, op9_quality,
        op10_mixing, pipeline,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    out = {"op7_licenses": licenses.oracle_sql(), "op8_top_k": TOP_K_SQL}
    return out


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * d.e[i])) AS BIGINT) AS score
  FROM v q, v d WHERE q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id
),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
