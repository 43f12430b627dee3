"""Task detection, class profiles and label encoding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer import core
from assayer.functions import stats
from assayer.operators.profile import quoted


@dataclass(frozen=True)
class TargetProfile:
    task: str
    classes: int | None
    positive: str | None
    minority_ratio: float | None
    imbalance: float | None
    numeric: dict[str, float | None] | None = None  # of a regression target: minimum, maximum, mean, std, quartiles and iqr


def facts(df: DataFrame, target: str) -> DataFrame:
    """One row: rows, valid, distinct, whether all are whole numbers, and whether the target is numeric."""
    c = F.col(target)
    numeric = core.kind_of(df.schema[target].dataType) == core.NUMERIC
    x = core.finite(c) if numeric else F.lit(None).cast("double")
    return core.normalize(df).agg(
        F.count("*").alias("rows"), F.count(c).alias("valid"), F.count_distinct(c).alias("distinct"),
        F.coalesce(F.bool_and(x == F.floor(x)), F.lit(False)).alias("integral"), F.lit(numeric).alias("numeric"),
    )


def task_rule(config: core.Config = core.Config()) -> Column:
    """The task as an expression over ``facts``; ambiguous where values do not decide."""
    ratio = F.col("distinct") / F.nullif(F.col("valid"), F.lit(0))
    text = F.when((F.col("distinct") == F.col("valid")) & (F.col("distinct") > config.max_classes), "ambiguous").otherwise("classification")
    number = (
        F.when(F.col("distinct") <= 2, "classification")
        .when(~F.col("integral"), "regression")
        .when(F.col("distinct") > config.max_classes, "regression")
        .when(ratio <= config.class_unique_ratio, "classification")
        .otherwise("ambiguous")
    )
    return F.when(F.col("valid") == 0, "empty").when(F.col("numeric"), number).otherwise(text)


def detect(df: DataFrame, target: str, hint: str | None = None, config: core.Config = core.Config()) -> TargetProfile:
    row = facts(df, target).withColumn("task", task_rule(config)).first()
    if row["task"] == "empty":
        raise core.EmptyDataError("the target has no values")
    if hint not in (None, "classification", "regression"):
        raise core.UnsupportedTaskError(str(hint))
    if hint == "regression" and not row["numeric"]:
        raise core.UnsupportedTaskError("regression needs a numeric target")
    task = hint or row["task"]
    if task == "ambiguous":
        raise core.AmbiguousTaskError("name the task of this target")
    if task == "regression":
        x = core.finite(quoted(target))
        quarters = stats.quantiles_of(df, {target: x}, [0.25, 0.5, 0.75])[target]
        side = df.agg(F.min(x).alias("minimum"), F.max(x).alias("maximum"), stats.mean(x).alias("mean"), F.when(F.count(x) > 1, stats.std(x)).alias("std")).first().asDict()
        wide = None if quarters[0] is None else quarters[2] - quarters[0]
        numeric = side | dict(zip(("q25", "median", "q75", "iqr"), (*quarters, wide), strict=True))
        return TargetProfile(task, None, None, None, None, numeric)
    counts = class_counts(df, target)
    side = counts.agg(F.count("*").alias("n"), F.min("count").alias("a"), F.max("count").alias("b"), F.sum("count").alias("s")).first()
    positive = None
    if side["n"] == 2:
        names = {r[0] for r in counts.select(F.lower("class")).collect()}
        positive = next((p for p in ("true", "1", "1.0") if p in names), None)
    return TargetProfile(task, side["n"], positive, side["a"] / side["s"], side["b"] / side["a"])


def class_counts(df: DataFrame, target: str) -> DataFrame:
    kept = df.where(F.col(target).isNotNull())
    counts = kept.groupBy(F.col(target).cast("string").alias("class")).agg(F.count("*").alias("count"))
    return counts.join(F.broadcast(counts.agg(F.sum("count").alias("__t")))).select("class", "count", (F.col("count") / F.col("__t")).alias("ratio"))


def fit_labels(df: DataFrame, target: str, most: int = 10_000) -> DataFrame:
    """Codes 0.. of the sorted labels: ``label``, ``code``; continuous targets are refused by their number."""
    labels = df.select(F.col(target).alias("label")).distinct()
    size = labels.count()
    if size > most:
        raise core.DomainError(f"{size} labels; at most {most} are encoded")
    if df.where(F.col(target).isNull()).limit(1).count():
        raise core.DomainError("the target has missing values")
    return labels.withColumn("code", F.dense_rank().over(Window.orderBy("label")) - 1)


def encode(df: DataFrame, target: str, labels: DataFrame) -> DataFrame:
    """Add ``code``; a label that was not fitted has NULL."""
    return df.join(F.broadcast(labels), F.col(target) == F.col("label"), "left").drop("label")


def decode(df: DataFrame, code: str, labels: DataFrame) -> DataFrame:
    return df.join(F.broadcast(labels.withColumnRenamed("code", "__c")), F.col(code) == F.col("__c"), "left").drop("__c")
