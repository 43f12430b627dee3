"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import (
    bpe, centroids, decontaminate, hard_negatives, html_extract, knn, language_id, near_dedup, pii, quality_cnn, secrets, suffix_dedup, url_filter,
)
from assayer.llm._common import documents


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(documents(spark, sf_dir)))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.digest(decontaminate.decontaminate(documents(spark, sf_dir), benchmark))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    texts = html_extract.extract(pages, html_extract.fit(spark))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(documents(spark, sf_dir), digest_only=True)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digest(bpe.encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN, decoded=True))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan_pii(documents(spark, sf_dir)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    models = language_id.fit(docs, "lang", "text")
    judged = language_id.identify_documents(docs, models, keep=("doc_id",))
    return judged.select("doc_id", "language", "confidence", language_id.accepted().alias("accepted"))


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fusion with all four kinds of evidence, on pages."""
    models = language_id.fit(documents(spark, sf_dir), "lang", "text")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return language_id.identify_pages(pages, models, keep=("page_id",)).select("page_id", "language", "confidence")


def weighted_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates by the weighted similarity of shingle counts."""
    return near_dedup.near_duplicates(documents(spark, sf_dir), weighted=True)


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return knn.top_k(embeddings, 5, F.col("vec_id") % 50 == 0)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.filter_urls(pages, url_filter.rule_table(spark), url_filter.listed_table(spark))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    network = quality_cnn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_cnn.judged(quality_cnn.quality(docs, network))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(embeddings, F.col("vec_id") % 100 == 0, label)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_decontamination": op2_decontamination,
        "op3_html_extract": op3_html_extract,
        "op4_minhash_near_dedup": op4_minhash_near_dedup,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_bpe": op6_bpe,
        "op7_pii": op7_pii,
        "op8_language_id": op8_language_id,
        "op9_top_k": op9_top_k,
        "op10_url_filter": op10_url_filter,
        "op11_centroids": op11_centroids,
        "op12_quality": op12_quality,
        "op13_hard_negatives": op13_hard_negatives,
        "pages_language_id": pages_language_id,
        "weighted_near_dedup": weighted_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_top_k": knn.oracle(), "op10_url_filter": url_filter.oracle(), "op11_centroids": centroids.oracle(), "op13_hard_negatives": hard_negatives.oracle()}
