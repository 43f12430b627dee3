"""Frequency tables and value counts with a fixed order of ties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer import core
from assayer.functions import stats
from assayer.operators.profile import quoted


def value_counts(df: DataFrame, column: str, order: str, dropna: bool = True) -> DataFrame:
    """``value``, ``count`` and ``first`` (least ``order`` among its rows): ties go to the earliest. NaN is missing."""
    rows = core.normalize(df.select(quoted(column).alias("value"), quoted(order).alias("__order")))
    kept = rows.where(F.col("value").isNotNull()) if dropna else rows
    return kept.groupBy("value").agg(F.count("*").alias("count"), F.min("__order").alias("first"))


def frequency_table(df: DataFrame, column: str, missing: str = "omit") -> DataFrame:
    """value, count, relative, percentage, cumulative and cumulative_relative, by value.

    ``missing`` is ``omit`` or ``include`` (NULL is then a value, sorted first); NaN is missing. The
    table has a row a distinct value; its running sums are taken over ranges of values.
    """
    rows = core.normalize(df.select(quoted(column).alias("value")))
    kept = rows if missing == "include" else rows.where(F.col("value").isNotNull())
    counts = kept.groupBy("value").agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("total"))
    return (
        stats.running(counts, ["value"], "count")
        .join(F.broadcast(total))
        .withColumnRenamed("upto_count", "cumulative")
        .select(
            "value",
            "count",
            (F.col("count") / F.col("total")).alias("relative"),
            (100 * F.col("count") / F.col("total")).alias("percentage"),
            "cumulative",
            (F.col("cumulative") / F.col("total")).alias("cumulative_relative"),
        )
    )


def grouped_tally(df: DataFrame, feature: str, target: str) -> DataFrame:
    both = core.normalize(df.select(quoted(feature).alias(feature), quoted(target).alias(target)))
    return both.groupBy(quoted(feature), quoted(target)).agg(F.count("*").alias("count"))


def top_k_other(df: DataFrame, column: str, k: int, other: str = "Other") -> DataFrame:
    """The k commonest values (ties by value) and the rest as one; its name avoids the values."""
    rows = core.normalize(df.select(quoted(column).alias("value"))).where(F.col("value").isNotNull())
    counts = rows.groupBy(F.col("value").cast("string").alias("label")).agg(F.count("*").alias("count"))
    top = counts.orderBy(F.desc("count"), "label").limit(k)
    taken = {r["label"] for r in top.collect()}  # k rows
    while other in taken:
        other += "_"
    rest = counts.where(~F.col("label").isin(sorted(taken))) if taken else counts
    tail = rest.agg(F.sum("count").alias("count")).where("count IS NOT NULL").select(F.lit(other).alias("label"), "count")
    return top.unionByName(tail)
