"""The registered queries of this subpackage: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, filter_audit, language, license_scan, neighbours, ngram_join, packing, personal_data
from . import secret_scan, token_counts, topk_search, toxicity, vector_codes
from .common import load


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(load(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(load(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(load(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(load(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(load(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(load(spark, sf_dir, "documents"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = topk_search.search(docs, docs.where("doc_id % 100 = 0"), k=10)
    return found.withColumn("score", F.round("score", 6))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.license_scan(load(spark, sf_dir, "documents")))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = neighbours.usable(load(spark, sf_dir, "embeddings"))
    return neighbours.nearest(vectors, vectors.where("id % 50 = 0"), k=5)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(load(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_bpe, op2_token_counts, op3_ngram_join, op4_secret_scan, op5_language_id, op6_toxicity, op7_packing,
    op8_topk_search, op9_license_scan, op10_neighbours,
    op11_vector_codes, op12_filter_audit, op13_personal_data)}
