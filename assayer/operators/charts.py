"""Chart data: small tables that a renderer draws as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer import core
from assayer.functions import stats
from assayer.operators import frequency
from assayer.operators.profile import quoted


def bin_count(n: int) -> int:
    """A readable number of bins: Sturges' rule within 5 and 50."""
    return max(5, min(50, (max(1, n) - 1).bit_length() + 1))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin, low, high and count over the finite values; empty bins are absent."""
    x = core.finite(quoted(column))
    values = df.select(x.alias("x")).where("x IS NOT NULL")
    ends = values.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    wide = F.col("b") / bins - F.col("a") / bins  # the whole range may be no double
    near = F.col("b") - F.col("a") < float("inf")
    wide = F.when(near, (F.col("b") - F.col("a")) / bins).otherwise(wide)
    reached = F.when(near, (F.col("x") - F.col("a")) / F.nullif(wide, F.lit(0.0))).otherwise((F.col("x") / 2 - F.col("a") / 2) / F.nullif(wide / 2, F.lit(0.0)))
    place = F.when(F.col("b") > F.col("a"), F.least(F.lit(bins - 1), F.floor(reached))).otherwise(0)
    binned = values.join(F.broadcast(ends)).withColumn("bin", place.cast("int"))
    edge = lambda k: F.when(near, F.col("a") + k * wide).otherwise(F.col("a") * ((bins - k) / bins) + F.col("b") * (k / bins))
    return binned.groupBy("bin").agg(F.count("*").alias("count"), F.first("a").alias("a"), F.first("b").alias("b")).select(
        "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), "count"
    )


def box(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """Five-number summary, of each group if one is named."""
    x = core.finite(quoted(column))
    q = stats.percentile(x, [25.0, 50.0, 75.0])
    parts = [F.count(x).alias("count"), F.min(x).alias("low"), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), F.max(x).alias("high")]
    return df.groupBy(quoted(group).alias("group")).agg(*parts) if group else df.agg(*parts)


def bars(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    return frequency.top_k_other(df, column, k)


def missing_view(df: DataFrame) -> DataFrame:
    """Percent missing of each column, worst first, ties by name."""
    df = core.normalize(df)
    parts = [F.struct(F.lit(c).alias("column"), (100 * F.count_if(quoted(c).isNull()) / F.count("*")).alias("percent")) for c in df.columns]
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a")).orderBy(F.desc("percent"), "column")


def heatmap(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlations of all pairs of columns from one aggregate, both ways round and 1 on the diagonal."""
    x = stats.measured(df, {c: core.finite(quoted(c)) for c in columns})
    parts = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), (F.lit(1.0) if a == b else stats.correlated(x[a], x[b])).alias("r"))
        for i, a in enumerate(columns)
        for b in columns[i:]
    ]
    one = df.agg(F.array(*parts).alias("a")).select(F.inline("a"))
    return one.unionByName(one.where("x != y").select(F.col("y").alias("x"), F.col("x").alias("y"), "r"))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by least hash of their key: the same whatever the partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def stratified_sample(df: DataFrame, key: str, group: str, n: int, seed: int = 42) -> DataFrame:
    """A proportional share of each group, at least one row, by least hash."""
    sizes = df.groupBy(group).agg(F.count("*").alias("__n"))
    total = sizes.agg(F.sum("__n").alias("__t"))
    share = F.greatest(F.lit(1), F.round(n * F.col("__n") / F.col("__t")))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key))
    want = F.broadcast(sizes.join(F.broadcast(total)).select(group, share.alias("__want")))
    return df.withColumn("__at", place).where(F.col("__at") <= n).join(want, group).where("__at <= __want").drop("__at", "__want")


def scatter(df: DataFrame, x: str, y: str, key: str, n: int = 2_000) -> DataFrame:
    both = df.select(key, core.finite(quoted(x)).alias("x"), core.finite(quoted(y)).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return sample(both, key, n).select("x", "y")


def target_associations(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    x = stats.measured(df, {c: core.finite(quoted(c)) for c in {*columns, target}})
    parts = [F.struct(F.lit(c).alias("column"), F.abs(stats.correlated(x[c], x[target])).alias("r")) for c in columns]
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a")).orderBy(F.desc_nulls_last("r"), "column")
