"""The corpus pipeline over ``documents``.

Five stages, each a function of (spark, docs, sf_dir) whose result is written as
Parquet and read again as the next one's input. All but the last return the
columns of ``documents``; the last returns the token ids of what is left.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import bpe, decontaminate, language_id, near_dedup, secrets
from assayer.llm._common import Scratch, documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in one of the languages; ``lang`` becomes the identified one."""
    models = language_id.fit(docs, "lang", "text")
    judged = language_id.identify_documents(docs, models).where(language_id.accepted())
    return judged.withColumn("lang", F.col("language")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class, that of the least id.

    Where ids are null or repeat, rows are told apart by id and text instead, null ids
    last; then different texts of one id are judged on their own and equal rows are one.
    """
    ids = docs.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if ids["rows"] == ids["ids"]:
        classes = near_dedup.near_duplicates(docs)
        return docs.join(classes.where("doc_id != class_id").select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text"))
    keyed = docs.withColumn("__key", key)
    classes = near_dedup.near_duplicates(keyed, "__key")
    left = keyed.join(classes.where("__key != class_id").select("__key").distinct(), "__key", "left_anti")
    return left.dropDuplicates(["__key"]).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without any benchmark window; each row is judged by its own text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, benchmark, keep=tuple(COLUMNS)).where("n_hit = 0").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; ``n_chars`` follows the text."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each kept text (little-endian 32-bit integers), its language and source, and the digests of ids and decoded bytes."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN, keep=("lang", "source"), decoded=True, remember=100_000)
    return bpe.digest(encoded, keep=("lang", "source", "ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("bpe", tokenize),
]

ORACLE_SQL = None  # the stages are classifiers, sketches and automata; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the folder that the cluster shares and read again.

    A stage's table goes when the next one is written; only the last one's input stays, as the
    result is computed from it when it is asked for.
    """
    docs, tables = documents(spark, sf_dir), Scratch(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        docs = tables.put(stage(spark, docs, sf_dir))
        if number:
            tables.drop(number - 1)
    return STAGES[-1][1](spark, docs, sf_dir)
