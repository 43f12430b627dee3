"""Column profiles: one row a column, from aggregations of the whole table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer import core
from assayer.functions import stats

ID_NAME = r"(?i)(^|[^a-z])(id|uuid|guid|key|identifier|index)($|[^a-z])|(?i)id$"
ID_VALUE = r"^([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9a-fA-F]{16,}|[A-Za-z]{2,6}[-_]?[0-9]{3,})$"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def basic(df: DataFrame, config: core.Config = core.Config()) -> DataFrame:
    """Counts and numeric summaries: one wide aggregate over the table, turned to one row a column.

    Quartiles belong to it on tables of up to ``stats.DIRECT`` rows; on larger ones they
    are bracketed first, for all columns at once.
    """
    df = core.normalize(df)
    kinds = core.kinds(df)
    quarters = [0.25, 0.5, 0.75]
    known = None
    if df.count() > stats.DIRECT:
        known = stats.quantiles_of(df, {c: core.finite(quoted(c)) for c, k in kinds.items() if k == core.NUMERIC}, quarters)
    parts = []
    for name, kind in kinds.items():
        c = quoted(name)
        x = core.finite(c) if kind == core.NUMERIC else F.lit(None).cast("double")
        inf = F.count_if(F.abs(c.cast("double")) == float("inf")) if kind == core.NUMERIC else F.lit(0).cast("long")
        if kind == core.NUMERIC and known is None:
            q = F.percentile(x, quarters)
        else:
            q = F.array(*[F.lit(v).cast("double") for v in (known or {}).get(name, [None] * 3)])
        parts.append(
            F.struct(
                F.lit(name).alias("column"), F.lit(kind).alias("kind"), F.count("*").alias("rows"), F.count(c).alias("count"),
                (F.count("*") - F.count(c)).alias("missing"), inf.alias("infinite"), F.min(x).alias("min"), F.max(x).alias("max"),
                stats.mean(x).alias("mean"), stats.std(x).alias("std"), q.getItem(0).alias("q25"), q.getItem(1).alias("median"),
                q.getItem(2).alias("q75"),
            )
        )
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def dominant(df: DataFrame, order: str) -> DataFrame:
    """Of each column its distinct count and most frequent value, ties by least ``order``.

    One unpivot of all columns and two aggregations, the first by value: a hot value
    is combined where it is read.
    """
    df = core.normalize(df)
    rows = df.select(
        quoted(order).alias("__order"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in df.columns])).alias("cell"),
    ).select("__order", "cell.*")
    by_value = rows.where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"), F.min("__order").alias("first"))
    # struct order: more rows first, then the earlier row
    by_first = F.struct((-F.col("n")).alias("n"), F.col("first"), F.col("value"))
    return by_value.groupBy("column").agg(F.count("*").alias("unique"), F.max("n").alias("dominant_count"), F.min(by_first).getField("value").alias("dominant"))


def profile(df: DataFrame, order: str, config: core.Config = core.Config()) -> DataFrame:
    """Full profile: measurements, ratios and flags of each column.

    ``order`` is a key of the rows; it decides which of two equally frequent
    values counts as the first.
    """
    kinds = core.kinds(df)
    cells = basic(df, config).join(dominant(df, order), "column", "left")
    count, unique = F.col("count"), F.coalesce("unique", F.lit(0))
    ratio = unique / F.nullif(count, F.lit(0))
    counter = (F.col("kind") == core.NUMERIC) & (count / F.nullif(F.col("max") - F.col("min") + 1, F.lit(0.0)) >= 0.99)
    named = F.col("column").rlike(ID_NAME)
    shaped = id_values(df, [c for c, k in kinds.items() if k == core.CATEGORICAL], order)
    cells = cells.join(F.broadcast(shaped), "column", "left") if shaped is not None else cells.withColumn("id_shape", F.lit(False))
    id_like = (
        ~F.col("kind").isin(core.BOOLEAN, core.DATETIME, core.OTHER)
        & (F.col("missing") == 0)
        & (ratio >= config.id_uniqueness)
        & (named | F.coalesce("id_shape", F.lit(False)) | F.coalesce(counter & integral(), F.lit(False)))
    )
    constant = unique == 1
    return cells.select(
        "column", "kind", "rows", "count", "missing", (F.col("missing") / F.nullif(F.col("rows"), F.lit(0))).alias("missing_ratio"),
        unique.alias("unique"), ratio.alias("unique_ratio"), "dominant",
        (F.col("dominant_count") / F.nullif(count, F.lit(0))).alias("dominant_ratio"), "infinite", "min", "max", "mean", "median",
        "std", "q25", "q75", stats.within_doubles(F.col("q75") - F.col("q25")).alias("iqr"), constant.alias("constant"),
        (~constant & (F.coalesce(F.col("dominant_count") / F.nullif(count, F.lit(0)), F.lit(0.0)) >= config.near_constant)).alias("near_constant"),
        ((F.col("kind") == core.CATEGORICAL) & (unique > config.high_cardinality)).alias("high_cardinality"),
        id_like.alias("id_like"),
    )


def integral() -> Column:
    return (F.col("min") == F.floor("min")) & (F.col("max") == F.floor("max"))


def heads(df: DataFrame, columns: list[str], order: str, n: int) -> DataFrame:
    """``column`` and ``v``: the first n values of each text column by ``order``, from one scan; a task passes on n rows a column."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).alias("v")) for c in columns])
    rows = df.select(quoted(order).alias("o"), F.explode(cells).alias("cell")).select("o", "cell.*").where("v IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("column").orderBy("o"))
    return rows.withColumn("at", place).where(F.col("at") <= n).select("column", "v")


def id_values(df: DataFrame, columns: list[str], order: str) -> DataFrame | None:
    """Whether the first 200 values of a text column all look like identifiers."""
    if not columns:
        return None
    return heads(df, columns, order, 200).groupBy("column").agg(F.bool_and(F.col("v").rlike(ID_VALUE)).alias("id_shape"))


SAMPLE = 10_000  # rows of a sampled profile


def sampled_quartiles(df: DataFrame, columns: list[str], key: str, k: int = SAMPLE, seed: int = 42) -> DataFrame:
    """Quartiles from the k rows of least hash: ``column``, ``q25``, ``median``, ``q75``, ``sampled``, ``rows``, ``approximate``, ``rank_error``.

    The bottom k of two parts are among the bottom k of each, so the sample is one whatever the partitions,
    and a task passes on k rows. ``approximate`` says that rows were left out; then a quartile's share of values lies within
    ``rank_error`` of what is asked with a chance of 99 % (Dvoretzky, Kiefer and Wolfowitz). Keys must tell rows apart.
    """
    x = {c: core.finite(quoted(c)).alias(f"x{i}") for i, c in enumerate(columns)}
    rows = df.count()
    low = df.select(F.xxhash64(F.lit(seed), quoted(key)).alias("h"), quoted(key).alias("k"), *x.values()).orderBy("h", "k").limit(k)
    parts = []
    for i, c in enumerate(columns):
        v, n = F.col(f"x{i}"), F.count(f"x{i}")
        q = F.percentile(v, [0.25, 0.5, 0.75])
        error = F.when(F.lit(rows > k), F.sqrt(F.lit(math.log(200.0)) / (2 * F.nullif(n, F.lit(0))))).otherwise(0.0)
        parts.append(F.struct(
            F.lit(c).alias("column"), q[0].alias("q25"), q[1].alias("median"), q[2].alias("q75"), n.alias("sampled"),
            F.lit(rows).cast("long").alias("rows"), F.lit(rows > k).alias("approximate"), error.alias("rank_error"),
        ))
    return low.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row; missing equals missing. Grouped by the row's own values."""
    df = core.normalize(df)
    groups = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count("*").alias("__n"))
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))


def size_estimate(df: DataFrame) -> int:
    """Bytes as the optimizer estimates them: not the memory a local frame would take."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
