"""Registered queries of the library and the DuckDB SQL they are compared with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer import core
from assayer.functions import stats
from assayer.operators import advisor, birch, charts, datetimes, evaluate, frequency, neighbours, pairs, prepare, profile, quality, spanning, target
from assayer.operators.graph import shared_folder
from assayer.plans import audit, models, publication

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- descriptive statistics: one aggregate over orders.o_totalprice ----

ONE: dict[str, tuple[Callable[[Column], Column], str]] = {
    "d01_mean": (lambda x: stats.mean(x), "avg(x)"),
    "d02_median": (lambda x: stats.percentile(x, 50.0), "quantile_cont(x, 0.5)"),
    "d04_min": (lambda x: F.min(x), "min(x)"),
    "d05_max": (lambda x: F.max(x), "max(x)"),
    "d06_range": (lambda x: stats.spread(x), "max(x) - min(x)"),
    "d07_sum": (lambda x: F.sum(x.cast("decimal(20,2)")).cast("double"), "sum(x::DECIMAL(20,2))::DOUBLE"),
    "d08_sum_of_squares": (lambda x: stats.sum_of_squares(x / 1000), "sum(x / 1000 * x / 1000)"),
    "d09_variance": (lambda x: stats.variance(x / 1000), "var_samp(x / 1000)"),
    "d09_variance_ddof2": (lambda x: stats.variance(x / 1000, 2), "var_pop(x / 1000) * count(x) / (count(x) - 2)"),
    "d10_std": (lambda x: stats.std(x), "stddev_samp(x)"),
    "d12_geometric_mean": (lambda x: stats.geometric_mean(x), "exp(avg(ln(x)))"),
    "d13_harmonic_mean": (lambda x: stats.harmonic_mean(x), "count(x) / sum(1 / x)"),
    "d14_rms": (lambda x: stats.rms(x), "sqrt(avg(x * x))"),
    "d15_percentile_90": (lambda x: stats.percentile(x, 90.0), "quantile_cont(x, 0.9)"),
    "d17_iqr": (lambda x: stats.percentile(x, 75.0) - stats.percentile(x, 25.0), "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)"),
    "d19_skewness": (lambda x: stats.skewness(x), "skewness(x)"),
    "d20_kurtosis": (lambda x: stats.kurtosis(x), "kurtosis(x)"),
    "d20_kurtosis_pearson": (lambda x: stats.kurtosis(x, bias=True, fisher=False), "kurtosis_pop(x) + 3"),
    "d21_raw_moment": (lambda x: stats.raw_moment(x / 1000, 3), "avg(pow(x / 1000, 3))"),
    "d23_moment_about": (lambda x: stats.moment_about(x / 1000, 2, 100), "avg(pow(x / 1000 - 100, 2))"),
    "d26_counts": (lambda x: stats.n(x) + stats.omitted(x), "count(*)"),
}
for _name, (_column, _sql) in ONE.items():
    add(
        _name,
        lambda spark, d, c=_column: rounded(table(spark, d, "orders").agg(c(F.col("o_totalprice")).alias("value")), 4),
        f"SELECT round(v, 4) AS value FROM (SELECT {_sql} AS v FROM (SELECT o_totalprice AS x FROM orders))"
        if _name != "d26_counts"
        else "SELECT count(*) AS value FROM orders",
    )

add(
    "d03_mode",
    lambda s, d: stats.modes(table(s, d, "part"), "p_size"),
    """WITH c AS (SELECT p_size AS value, count(*) AS count FROM part GROUP BY 1)
       SELECT value, count FROM c WHERE count = (SELECT max(count) FROM c) AND count > 1""",
)
add(
    "d11_mean_absolute_deviation",
    lambda s, d: rounded(stats.mean_absolute_deviation(table(s, d, "orders"), "o_totalprice"), 4),
    """SELECT round(avg(abs(o_totalprice - m)), 4) AS mean_absolute_deviation
       FROM orders, (SELECT avg(o_totalprice) AS m FROM orders)""",
)
add(
    "d18_z_scores",
    lambda s, d: rounded(stats.z_scores(table(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", "z")),
    """SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS z FROM customer""",
)
add(
    "d22_central_moment",
    lambda s, d: rounded(stats.central_moment(table(s, d, "customer").select((F.col("c_acctbal") / 1000).alias("x")), "x", 4), 4),
    """SELECT round(avg(pow(c_acctbal / 1000 - m, 4)), 4) AS central_moment
       FROM customer, (SELECT avg(c_acctbal / 1000) AS m FROM customer)""",
)
add(
    "d16_quartiles_exact_at_scale",
    lambda s, d: s.createDataFrame(
        list(zip([0.25, 0.5, 0.75], stats.exact_quantiles(table(s, d, "lineitem"), "l_extendedprice", [0.25, 0.5, 0.75], direct=2_000), strict=True)),
        "q double, value double",
    ),
    """SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS q, unnest([quantile_cont(l_extendedprice, 0.25), quantile_cont(l_extendedprice, 0.5),
       quantile_cont(l_extendedprice, 0.75)]) AS value FROM lineitem""",
)
add(
    "d24_describe",
    lambda s, d: rounded(table(s, d, "events").agg(*stats.describe(F.col("value"))), 4),
    """SELECT count(v) AS count, count(*) - count(v) AS omitted, round(min(v), 4) AS min, round(max(v), 4) AS max,
       round(max(v) - min(v), 4) AS range, round(avg(v), 4) AS mean, round(var_samp(v), 4) AS variance,
       round(stddev_samp(v), 4) AS std, round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.5), 4) AS median,
       round(quantile_cont(v, 0.75), 4) AS q3, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 4) AS iqr,
       round(skewness(v), 4) AS skewness, round(kurtosis(v), 4) AS kurtosis FROM (SELECT value AS v FROM events)""",
)

# ---- bivariate ----

def pair() -> tuple[Column, Column]:
    return F.col("l_quantity"), F.col("l_extendedprice") / 1000


add(
    "b1_covariance",
    lambda s, d: rounded(table(s, d, "lineitem").agg(stats.covariance(*pair()).alias("value")), 4),
    "SELECT round(covar_samp(l_quantity, l_extendedprice / 1000), 4) AS value FROM lineitem",
)
add(
    "b2_pearson",
    lambda s, d: rounded(table(s, d, "lineitem").agg(stats.pearson(*pair()).alias("value"))),
    "SELECT round(corr(l_quantity, l_extendedprice / 1000), 6) AS value FROM lineitem",
)
add(
    "b3_spearman",
    lambda s, d: rounded(stats.spearman(table(s, d, "part"), "p_size", "p_retailprice")),
    """WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a,
       rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part)
       SELECT round(corr(a, b), 6) AS spearman FROM r""",
)
add(
    "b4_kendall",
    lambda s, d: rounded(stats.kendall(table(s, d, "supplier"), "s_nationkey", "s_acctbal")),
    """WITH p AS (SELECT s_suppkey AS k, s_nationkey AS x, s_acctbal AS y FROM supplier),
       c AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, sum((a.x <> b.x)::INT) AS nx, sum((a.y <> b.y)::INT) AS ny
             FROM p a JOIN p b ON a.k < b.k)
       SELECT round(s / sqrt(nx::DOUBLE * ny), 6) AS kendall FROM c""",
)

# ---- frequency ----

add(
    "f_frequency_table",
    lambda s, d: rounded(frequency.frequency_table(table(s, d, "events"), "event_type")),
    """WITH c AS (SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1), t AS (SELECT sum(count) AS n FROM c)
       SELECT value, count, round(count / n, 6) AS relative, round(100 * count / n, 6) AS percentage,
       (sum(count) OVER (ORDER BY value))::BIGINT AS cumulative, round(sum(count) OVER (ORDER BY value) / n, 6) AS cumulative_relative FROM c, t""",
)
add(
    "f6_weighted_mean",
    lambda s, d: rounded(table(s, d, "lineitem").agg(stats.weighted_mean(F.col("l_discount"), F.col("l_quantity")).alias("value"))),
    "SELECT round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS value FROM lineitem",
)
add(
    "f8_frequency_with_missing",
    lambda s, d: rounded(
        frequency.frequency_table(table(s, d, "events").withColumn("t", F.nullif("event_type", F.lit("view"))), "t", "include")
    ),
    """WITH c AS (SELECT nullif(event_type, 'view') AS value, count(*) AS count FROM events GROUP BY 1), t AS (SELECT sum(count) AS n FROM c)
       SELECT value, count, round(count / n, 6) AS relative, round(100 * count / n, 6) AS percentage,
       (sum(count) OVER w)::BIGINT AS cumulative, round(sum(count) OVER w / n, 6) AS cumulative_relative FROM c, t
       WINDOW w AS (ORDER BY value NULLS FIRST)""",
)
add(
    "f9_grouped_tally",
    lambda s, d: frequency.grouped_tally(table(s, d, "lineitem"), "l_returnflag", "l_linestatus"),
    "SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY 1, 2",
)
add(
    "f10_top_k_other",
    lambda s, d: frequency.top_k_other(table(s, d, "customer"), "c_nationkey", 5),
    """WITH c AS (SELECT c_nationkey::VARCHAR AS label, count(*) AS count FROM customer GROUP BY 1),
       r AS (SELECT *, row_number() OVER (ORDER BY count DESC, label) AS k FROM c)
       SELECT label, count FROM r WHERE k <= 5 UNION ALL SELECT 'Other', sum(count)::BIGINT FROM r WHERE k > 5 HAVING count(*) > 0""",
)
add(
    "a7_value_counts",
    lambda s, d: frequency.value_counts(table(s, d, "orders"), "o_orderpriority", "o_orderkey"),
    "SELECT o_orderpriority AS value, count(*) AS count, min(o_orderkey) AS first FROM orders GROUP BY 1",
)

# ---- profile ----


def profile_sql(name: str, key: str, columns: dict[str, str]) -> str:
    """The core of a profile, a SELECT a column: kind by the given type."""
    parts = []
    for c, kind in columns.items():
        num = kind == "numeric"
        f = lambda e, n=num: e if n else "NULL::DOUBLE"
        parts.append(
            f"""SELECT '{c}' AS "column", '{kind}' AS kind, count(*) AS rows, count({c}) AS count, count(*) - count({c}) AS missing,
            count(DISTINCT {c}) AS "unique", {f(f'round(min({c})::DOUBLE, 4)')} AS min, {f(f'round(max({c})::DOUBLE, 4)')} AS max,
            {f(f'round(avg({c}), 4)')} AS mean, {f(f'round(quantile_cont({c}::DOUBLE, 0.5), 4)')} AS median,
            {f(f'round(stddev_samp({c}), 4)')} AS std, {f(f'round(quantile_cont({c}::DOUBLE, 0.25), 4)')} AS q25,
            {f(f'round(quantile_cont({c}::DOUBLE, 0.75), 4)')} AS q75,
            (SELECT count(*) FROM {name} GROUP BY {c} ORDER BY 1 DESC LIMIT 1) / count(*) AS share,
            count(DISTINCT {c}) = 1 AS constant FROM {name}"""
        )
    return "SELECT * REPLACE (round(share, 6) AS share) FROM (" + " UNION ALL ".join(parts) + ")"


def profile_core(s: SparkSession, d: str, name: str, key: str) -> DataFrame:
    p = profile.profile(table(s, d, name), key)
    return p.select(
        "column", "kind", "rows", "count", "missing", "unique", *[F.round(c, 4).alias(c) for c in ("min", "max", "mean", "median", "std", "q25", "q75")],
        F.round("dominant_ratio", 6).alias("share"), "constant",
    )


N, W, D = "numeric", "categorical", "datetime"
PROFILES = {
    "orders": ("o_orderkey", {"o_orderkey": N, "o_custkey": N, "o_orderstatus": W, "o_totalprice": N, "o_orderdate": D, "o_orderpriority": W}),
    "customer": ("c_custkey", {"c_custkey": N, "c_name": W, "c_nationkey": N, "c_acctbal": N, "c_mktsegment": W}),
    "part": ("p_partkey", {"p_partkey": N, "p_name": W, "p_brand": W, "p_type": W, "p_size": N, "p_retailprice": N}),
}
for _table, (_key, _columns) in PROFILES.items():
    add(f"a1_profile_{_table}", lambda s, d, t=_table, k=_key: profile_core(s, d, t, k), profile_sql(_table, _key, _columns))
add("profile_lineitem", lambda s, d: profile.profile(table(s, d, "lineitem"), "l_orderkey"))
add(
    "a5_duplicate_rows",
    lambda s, d: profile.duplicate_rows(table(s, d, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag")),
    "SELECT (sum(n) - count(*))::BIGINT AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, l_quantity, l_returnflag)",
)
add(
    "a6_dominant_value",
    lambda s, d: profile.dominant(table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey"), "o_orderkey").where("column != 'o_orderkey'"),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS "unique", max(n) AS dominant_count, arg_max(v, (n, -f)) AS dominant
        FROM (SELECT {c}::VARCHAR AS v, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1)"""
        for c in ("o_orderpriority", "o_custkey")
    ),
)
add(
    "a10_infinite",
    lambda s, d: table(s, d, "events").select(F.when(F.col("event_id") % 7 == 0, float("inf")).otherwise(F.col("value")).alias("x")).agg(
        F.count_if(F.abs("x") == float("inf")).alias("infinite"), F.round(F.avg(core.finite(F.col("x"))), 4).alias("mean")
    ),
    """SELECT count(*) FILTER (WHERE event_id % 7 = 0) AS infinite, round(avg(value) FILTER (WHERE event_id % 7 <> 0), 4) AS mean FROM events""",
)

# ---- quality ----


def dirty(s: SparkSession, d: str) -> DataFrame:
    """orders with planted gaps and outliers."""
    x = F.when(F.col("o_orderkey") % 4 == 0, None).otherwise(F.col("o_totalprice"))
    return table(s, d, "orders").select(
        "o_orderkey", x.alias("gappy"), F.when(F.col("o_orderkey") % 97 == 0, F.col("o_totalprice") * 100).otherwise(F.col("o_totalprice")).alias("wild"),
        F.lit("same").alias("constant"), F.col("o_orderstatus").alias("status"), (F.col("o_orderstatus") == "F").alias("target"),
    )


DIRTY = """(SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS gappy,
    CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 100 ELSE o_totalprice END AS wild, 'same' AS constant,
    o_orderstatus AS status, o_orderstatus = 'F' AS target FROM orders)"""

add(
    "q1_missing_values",
    lambda s, d: rounded(
        quality.from_profile(profile.profile(dirty(s, d), "o_orderkey"), "target").where("code = 'missing_values'").select("column", "severity", "value")
    ),
    f"""SELECT 'gappy' AS "column", CASE WHEN m > 0.2 THEN 'WARNING' ELSE 'INFO' END AS severity, round(m, 6) AS value
        FROM (SELECT 1 - count(gappy) / count(*) AS m FROM {DIRTY}) WHERE m > 0""",
)
add(
    "q3_constant_column",
    lambda s, d: quality.from_profile(profile.profile(dirty(s, d), "o_orderkey"), "target").where("code = 'constant_column'").select("column", "severity"),
    """SELECT 'constant' AS "column", 'WARNING' AS severity""",
)
add(
    "q9_outliers",
    lambda s, d: rounded(quality.outliers(dirty(s, d), ["gappy", "wild"]), 3),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(lo, 3) AS low, round(hi, 3) AS high, count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS outliers
        FROM {DIRTY}, (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo,
        quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {DIRTY}) GROUP BY lo, hi"""
        for c in ("gappy", "wild")
    ),
)
add(
    "q10_vif",
    lambda s, d: rounded(quality.vif(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"])),
    """SELECT unnest(['l_quantity', 'l_extendedprice']) AS "column", round(1 / (1 - r * r), 6) AS vif
       FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)""",
)
add(
    "q13_class_imbalance",
    lambda s, d: rounded(quality.imbalance(table(s, d, "orders"), "o_orderstatus")),
    """SELECT count(*) AS classes, round(min(n) / sum(n), 6) AS minority, count(*) > 1 AND min(n) / sum(n) < 0.2 AS imbalanced
       FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)""",
)
add(
    "q14_target_leakage",
    lambda s, d: rounded(quality.leakage(dirty(s, d).withColumn("copy_of_target", F.col("target")), "target")),
    f"""WITH t AS (SELECT *, target AS copy_of_target FROM {DIRTY}), m AS (SELECT max(k) = 1 AS maps, count(*) AS u, sum(n) AS r
        FROM (SELECT status, count(DISTINCT target) AS k, count(*) AS n FROM t GROUP BY status))
        SELECT c.*, round(c.r, 6) AS correlation FROM (
          SELECT 'o_orderkey' AS "column", false AS copy, false AS deterministic, false AS extreme, false AS suspicious_name, corr(o_orderkey, target::INT) AS r FROM t
          UNION ALL SELECT 'gappy', false, false, false, false, corr(gappy, target::INT) FROM t
          UNION ALL SELECT 'wild', false, false, false, false, corr(wild, target::INT) FROM t
          UNION ALL SELECT 'constant', false, false, false, false, NULL
          UNION ALL SELECT 'status', false, (SELECT maps AND u BETWEEN 2 AND greatest(2, r // 2) FROM m), false, false, NULL
          UNION ALL SELECT 'copy_of_target', true, true, true, true, 1.0) c""".replace("c.*,", "c.* EXCLUDE (r),"),
)
add("q18_inspect", lambda s, d: quality.inspect(dirty(s, d), "o_orderkey", "target"))

# ---- datetimes ----

add(
    "t1_datetime_summary",
    lambda s, d: datetimes.summarize(table(s, d, "events"), "ts"),
    """WITH d AS (SELECT DISTINCT ts FROM events), s AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS delta FROM d),
       e AS (SELECT count(*) AS rows, count(ts) AS valid, count(*) - count(ts) AS missing, min(epoch_us(ts)) AS first_micros, max(epoch_us(ts)) AS last_micros FROM events)
       SELECT e.*, (SELECT count(*) FROM d) AS "distinct", min(delta) AS min_spacing, max(delta) AS max_spacing,
       min(delta) = max(delta) AS regular, count(DISTINCT delta) AS distinct_spacings, valid - (SELECT count(*) FROM d) AS duplicates
       FROM s, e GROUP BY ALL""",
)
add(
    "t5_datetime_gaps",
    lambda s, d: datetimes.grid_gaps(table(s, d, "orders"), "o_orderdate", "P1D"),
    """WITH a AS (SELECT DISTINCT o_orderdate AS t FROM orders), o AS (SELECT min(t) AS f, max(t) AS l FROM a),
       g AS (SELECT t, (epoch_us(t) - epoch_us(f)) AS p, f, l FROM a, o),
       on_grid AS (SELECT p, p - lag(p) OVER (ORDER BY p) AS delta FROM g WHERE p % 86400000000 = 0)
       SELECT (SELECT count(*) FROM g WHERE p % 86400000000 <> 0) AS off_grid,
       (SELECT max(p) // 86400000000 + 1 FROM g) - count(*) AS missing_points,
       count(*) FILTER (WHERE delta > 86400000000) + (CASE WHEN (SELECT max(p) FROM g) // 86400000000 > max(p) // 86400000000 THEN 1 ELSE 0 END) AS gap_runs,
       (SELECT max(p) FROM g) // 86400000000 - max(p) // 86400000000 AS trailing_missing FROM on_grid""",
)
add(
    "t8_iso_recognition",
    lambda s, d: datetimes.recognize_iso(
        table(s, d, "orders").select(
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("stamp"),
            F.when(F.col("o_orderkey") % 2 == 0, "2024-02-30").otherwise("2024-02-29").alias("broken"),
        ),
        ["day", "stamp", "broken"],
    ),
    """SELECT unnest(['day', 'stamp', 'broken']) AS "column", count(*) AS seen, 0::BIGINT AS blank, unnest(['date', 'utc_z', NULL]) AS policy FROM orders""",
)

# ---- targets ----

add(
    "g3_task_detection",
    lambda s, d: target.facts(table(s, d, "orders"), "o_totalprice").withColumn("task", target.task_rule()).select("rows", "distinct", "task"),
    """SELECT count(*) AS rows, count(DISTINCT o_totalprice) AS "distinct", 'regression' AS task FROM orders""",
)
add(
    "g4_class_counts",
    lambda s, d: rounded(target.class_counts(table(s, d, "orders"), "o_orderstatus")),
    """SELECT o_orderstatus AS class, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS ratio FROM orders GROUP BY 1""",
)
add(
    "g8_label_encode",
    lambda s, d: target.encode(t := table(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", target.fit_labels(t, "o_orderpriority")),
    "SELECT o_orderkey, o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders",
)

# ---- preparation ----


def prepared(s: SparkSession, d: str, step: prepare.Step) -> DataFrame:
    t = table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("x"), F.col("c_mktsegment").alias("w"))
    return rounded(prepare.fit(t, [step]).transform(t, ["c_custkey"]))


HOLES = "(SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS x, c_mktsegment AS w FROM customer)"
SCALED = {
    "r13_standard_scale": ("standard", "avg(x)", "stddev_pop(x)"),
    "r14_minmax_scale": ("minmax", "min(x)", "max(x) - min(x)"),
    "r15_robust_scale": ("robust", "quantile_cont(x, 0.5)", "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)"),
    "r12_impute_median": ("none", "0", "1"),
}
for _name, (_scale, _shift, _unit) in SCALED.items():
    add(
        _name,
        lambda s, d, k=_scale: prepared(s, d, prepare.Step("x", "numeric", scale=k)),
        f"""SELECT c_custkey, round((coalesce(x, m) - a) / b, 6) AS x FROM {HOLES},
        (SELECT quantile_cont(x, 0.5) AS m, {_shift} AS a, {_unit} AS b FROM {HOLES})""",
    )
add(
    "r18_one_hot",
    lambda s, d: prepared(s, d, prepare.Step("w", "categorical", impute="most_frequent", encode="onehot")).unpivot(["c_custkey"], None, "level", "value").where("value = 1"),
    "SELECT c_custkey, 'w=' || w AS level, 1.0::DOUBLE AS value FROM " + HOLES,
)
add(
    "r19_ordinal",
    lambda s, d: prepared(s, d, prepare.Step("w", "ordinal", order=("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE"))),
    f"SELECT c_custkey, (list_position(['BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD', 'FURNITURE'], w) - 1)::DOUBLE AS w FROM {HOLES}",
)

# ---- evaluation ----


def scored(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(
        (F.col("l_quantity") > 25).cast("int").alias("y"), (F.col("l_extendedprice") > 30_000).cast("int").alias("p"), F.col("l_extendedprice").alias("score"),
        F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1500).alias("b"),
    )


SCORED = """(SELECT (l_quantity > 25)::INT AS y, (l_extendedprice > 30000)::INT AS p, l_extendedprice AS score,
    l_quantity AS a, l_extendedprice / 1500 AS b FROM lineitem)"""
add(
    "e10_classification_metrics",
    lambda s, d: rounded(evaluate.classification(scored(s, d), "y", "p")),
    f"""WITH c AS (SELECT * FROM {SCORED}), k AS (SELECT k, count(*) FILTER (WHERE y = k AND p = k) AS tp, count(*) FILTER (WHERE y = k) AS n,
        count(*) FILTER (WHERE p = k) AS said FROM c, (SELECT unnest([0, 1]) AS k) GROUP BY k)
        SELECT (SELECT round(avg((y = p)::INT), 6) FROM c) AS accuracy, round(avg(coalesce(tp / nullif(said, 0), 0)), 6) AS precision,
        round(avg(coalesce(tp / nullif(n, 0), 0)), 6) AS recall, round(avg(coalesce(2 * tp / nullif(said + n, 0), 0)), 6) AS f1 FROM k""",
)
add(
    "e13_roc_auc",
    lambda s, d: rounded(evaluate.roc_auc(scored(s, d), F.col("y") == 1, "score")),
    f"""WITH r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM {SCORED})
        SELECT round((sum(k) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
        / (count(*) FILTER (WHERE y = 1)::DOUBLE * count(*) FILTER (WHERE y = 0)), 6) AS roc_auc FROM r""",
)
add(
    "e14_regression_metrics",
    lambda s, d: rounded(evaluate.regression(scored(s, d), "a", "b"), 4),
    f"""SELECT round(avg(abs(a - b)), 4) AS mae, round(avg((a - b) * (a - b)), 4) AS mse, round(sqrt(avg((a - b) * (a - b))), 4) AS rmse,
        round(1 - avg((a - b) * (a - b)) / var_pop(a), 4) AS r2 FROM {SCORED}""",
)


def clustered(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 3).alias("l"), (F.col("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("y"))


CLUSTERED = "(SELECT s_suppkey AS k, s_nationkey % 3 AS l, s_acctbal / 1000 AS x, s_nationkey::DOUBLE AS y FROM supplier)"
add(
    "e17_silhouette",
    lambda s, d: rounded(evaluate.silhouette(clustered(s, d), "s_suppkey", "l", ["x", "y"])),
    f"""WITH c AS (SELECT * FROM {CLUSTERED}), m AS (SELECT a.k, a.l, b.l AS o, avg(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d
        FROM c a JOIN c b ON a.k <> b.k GROUP BY 1, 2, 3), s AS (SELECT k, max(d) FILTER (WHERE l = o) AS a, min(d) FILTER (WHERE l <> o) AS b FROM m GROUP BY k)
        SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""",
)
add(
    "e18_cluster_metrics",
    lambda s, d: rounded(evaluate.cluster_metrics(clustered(s, d), "l", ["x", "y"])),
    f"""WITH t AS (SELECT * FROM {CLUSTERED}), c AS (SELECT l, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM t GROUP BY l),
        d AS (SELECT t.l, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS d FROM t JOIN c ON t.l = c.l),
        s AS (SELECT c.*, (SELECT avg(d) FROM d WHERE d.l = c.l) AS s FROM c),
        r AS (SELECT a.l, max((a.s + b.s) / nullif(sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)), 0)) AS r FROM s a JOIN s b ON a.l <> b.l GROUP BY a.l),
        m AS (SELECT avg(x) AS mx, avg(y) AS my, count(*) AS n FROM t),
        b AS (SELECT sum(c.n * (pow(cx - mx, 2) + pow(cy - my, 2))) AS b, count(*) AS k, max(m.n) AS n FROM c, m)
        SELECT (SELECT round(avg(r), 6) FROM r) AS davies_bouldin,
        round((b / (k - 1)) / nullif((SELECT sum(d * d) FROM d) / (n - k), 0), 6) AS calinski_harabasz FROM b""",
)
add(
    "e21_cluster_sizes",
    lambda s, d: rounded(evaluate.centroids(clustered(s, d), "l", ["x", "y"])),
    f"SELECT l AS cluster, count(*) AS size, round(avg(x), 6) AS c_x, round(avg(y), 6) AS c_y FROM {CLUSTERED} GROUP BY l",
)

# ---- charts ----

add(
    "c7_histogram",
    lambda s, d: rounded(charts.histogram(table(s, d, "orders"), "o_totalprice", 20), 3),
    """WITH e AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders)
       SELECT bin, round(a + bin * (b - a) / 20, 3) AS low, round(a + (bin + 1) * (b - a) / 20, 3) AS high, count(*) AS count
       FROM (SELECT a, b, least(19, floor((o_totalprice - a) / ((b - a) / 20)))::INT AS bin FROM orders, e) GROUP BY bin, a, b""",
)
add(
    "c8_box",
    lambda s, d: rounded(charts.box(table(s, d, "lineitem"), "l_quantity", "l_returnflag")),
    """SELECT l_returnflag AS "group", count(l_quantity) AS count, min(l_quantity) AS low, quantile_cont(l_quantity, 0.25) AS q1,
       quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS high FROM lineitem GROUP BY 1""",
)
add(
    "c10_missing_view",
    lambda s, d: rounded(charts.missing_view(dirty(s, d))),
    f"""SELECT unnest(['o_orderkey', 'gappy', 'wild', 'constant', 'status', 'target']) AS "column",
        unnest([0.0, round(100 * (1 - count(gappy) / count(*)), 6), 0, 0, 0, 0])::DOUBLE AS percent FROM {DIRTY}""",
)
add(
    "c11_heatmap",
    lambda s, d: rounded(charts.heatmap(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])),
    " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM lineitem"
        if a != b
        else f"SELECT '{a}' AS x, '{b}' AS y, 1.0::DOUBLE AS r"
        for a in ("l_quantity", "l_extendedprice", "l_discount")
        for b in ("l_quantity", "l_extendedprice", "l_discount")
    ),
)
add("c13_scatter", lambda s, d: charts.scatter(table(s, d, "lineitem").withColumn("k", F.col("l_orderkey") * 8 + F.col("l_linenumber")), "l_quantity", "l_extendedprice", "k"))
add("c17_stratified_sample", lambda s, d: charts.stratified_sample(table(s, d, "orders"), "o_orderkey", "o_orderstatus", 100))
def chart_plan(s: SparkSession, d: str, name: str, key: str, target: str | None) -> DataFrame:
    plan = advisor.recommend(dirty(s, d) if name == "dirty" else table(s, d, name), key, target)
    return plan.select("rank", "chart", F.concat_ws(",", "columns").alias("columns"), "code", F.round("score", 4).alias("score"), "requires_review")


add("c1_chart_candidates", lambda s, d: chart_plan(s, d, "orders", "o_orderkey", None))
add(
    "c5_chart_plan",
    lambda s, d: chart_plan(s, d, "dirty", "o_orderkey", "target"),
    f"""WITH f AS (SELECT 1 - count(gappy) / count(*) AS gaps, abs(corr(gappy, target::INT)) AS r_gappy, abs(corr(wild, target::INT)) AS r_wild,
          abs(corr(gappy, wild)) AS r_pair, count(DISTINCT status) AS labels, count(*) AS n,
          quantile_cont(gappy, 0.25) AS g1, quantile_cont(gappy, 0.75) AS g3, quantile_cont(wild, 0.25) AS w1, quantile_cont(wild, 0.75) AS w3,
          least(avg(target::INT), 1 - avg(target::INT)) < 0.2 AS imbalanced FROM {DIRTY}),
        o AS (SELECT coalesce(bool_or(gappy < g1 - 1.5 * (g3 - g1) OR gappy > g3 + 1.5 * (g3 - g1)), false) AS gappy,
          coalesce(bool_or(wild < w1 - 1.5 * (w3 - w1) OR wild > w3 + 1.5 * (w3 - w1)), false) AS wild FROM {DIRTY}, f),
        c(chart, columns, code, score, requires_review) AS (
          SELECT 'missing_values', 'gappy', 'dataset_has_missing_values', 0.75 + 0.2, false
          UNION ALL SELECT 'target_distribution', 'target', 'target_distribution', 0.9 + 0.3 + CASE WHEN imbalanced THEN 0.2 ELSE 0 END, false FROM f
          UNION ALL SELECT 'histogram', 'gappy', 'numeric_distribution', 0.5 - 0.2 * gaps, false FROM f
          UNION ALL SELECT 'histogram', 'wild', 'numeric_distribution', 0.5, false
          UNION ALL SELECT 'box_plot', 'gappy', CASE WHEN o.gappy THEN 'flagged_outlier_candidates' ELSE 'numeric_spread' END,
            0.4 - 0.2 * gaps + CASE WHEN o.gappy THEN 0.2 ELSE 0 END, o.gappy FROM f, o
          UNION ALL SELECT 'box_plot', 'wild', CASE WHEN o.wild THEN 'flagged_outlier_candidates' ELSE 'numeric_spread' END,
            0.4 + CASE WHEN o.wild THEN 0.2 ELSE 0 END, o.wild FROM o
          UNION ALL SELECT 'bar', 'status', 'categorical_frequency', 0.45, false
          UNION ALL SELECT 'grouped_box', 'gappy,target', 'numeric_against_target', 0.6 + 0.3 + 0.25 * r_gappy - 0.2 * gaps, false FROM f
          UNION ALL SELECT 'grouped_box', 'wild,target', 'numeric_against_target', 0.6 + 0.3 + 0.25 * r_wild, false FROM f
          UNION ALL SELECT 'grouped_bar', 'status,target', 'possible_target_leakage_review', 0.6 + 0.3 + 0.15, true
          UNION ALL SELECT 'scatter', 'gappy,wild', 'numeric_pair_association', 0.55 + 0.25 * r_pair - 0.2 * gaps, false FROM f),
        k AS (SELECT *, row_number() OVER (ORDER BY round(score, 6) DESC, chart, columns) AS place FROM c WHERE code <> 'numeric_spread')
        SELECT CASE WHEN place <= 10 THEN place END::INT AS rank, chart, columns, CASE WHEN place <= 10 THEN code ELSE 'over_max_charts' END AS code,
          round(score::DOUBLE, 4) AS score, requires_review FROM k
        UNION ALL SELECT NULL, chart, columns, 'redundant_distribution_view', round(score::DOUBLE, 4), requires_review FROM c WHERE code = 'numeric_spread'
        UNION ALL SELECT NULL, 'correlation_heatmap', 'gappy,wild', 'too_few_numeric_columns', NULL, false
        UNION ALL SELECT NULL, 'histogram', 'o_orderkey', 'possible_id_like', NULL, false
        UNION ALL SELECT NULL, 'bar', 'constant', 'constant_column', NULL, false""",
)
add(
    "c12_target_distribution",
    lambda s, d: advisor.data_of(table(s, d, "orders"), "o_orderkey", "target_distribution", ["o_orderpriority"], "classification"),
    "SELECT o_orderpriority AS label, count(*) AS count FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1",
)
add(
    "c14_grouped_box_of_largest",
    lambda s, d: rounded(advisor.data_of(table(s, d, "part"), "p_partkey", "grouped_box", ["p_brand", "p_retailprice"], budget=advisor.Budget(categories=5))),
    """SELECT p_brand AS "group", count(p_retailprice) AS count, min(p_retailprice) AS low, round(quantile_cont(p_retailprice, 0.25), 6) AS q1,
       round(quantile_cont(p_retailprice, 0.5), 6) AS median, round(quantile_cont(p_retailprice, 0.75), 6) AS q3, max(p_retailprice) AS high
       FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5) GROUP BY 1""",
)

# ---- evidence, models ----

add("v5_fingerprint", lambda s, d: audit.fingerprint(table(s, d, "nation")))


def model_comparison(s: SparkSession, d: str) -> DataFrame:
    """Two regressions and the baseline on part, ranked by rmse."""
    t = table(s, d, "part").select("p_partkey", "p_size", "p_brand", "p_retailprice")
    trained = models.train(t, "p_partkey", "p_retailprice", ["ridge_regression", "decision_tree_regressor", "dummy_regressor"], "regression")
    return models.compare(trained, s)


def clustering(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return models.cluster(t, "c_custkey", k=4)


def neighbour_mean(s: SparkSession, d: str) -> DataFrame:
    """Mean quantity of the three nearest even suppliers of each odd one, by balance and nation."""
    t = table(s, d, "supplier").select("s_suppkey", F.array(F.col("s_acctbal") / 1000, F.col("s_nationkey").cast("double")).alias("v"))
    near = neighbours.nearest_labels(
        t.where("s_suppkey % 2 = 0").select("v", F.col("s_suppkey").alias("label")), t.where("s_suppkey % 2 = 1").select(F.col("s_suppkey").alias("q"), "v"), 3
    )
    return rounded(near.groupBy("q").agg(F.avg("label").alias("mean_label")))


add(
    "m3_nearest_neighbours",
    neighbour_mean,
    """WITH t AS (SELECT s_suppkey AS k, s_acctbal / 1000 AS x, s_nationkey::DOUBLE AS y FROM supplier),
       r AS (SELECT a.k AS q, b.k AS label, row_number() OVER (PARTITION BY a.k ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.k) AS n
             FROM t a JOIN t b ON a.k % 2 = 1 AND b.k % 2 = 0)
       SELECT q, round(avg(label), 6) AS mean_label FROM r WHERE n <= 3 GROUP BY q""",
)
add(
    "m21_dbscan",
    lambda s, d: neighbours.dbscan(
        table(s, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("y")), "s_suppkey", ["x", "y"], 1.1, 4
    ),
    """WITH RECURSIVE t AS (SELECT s_suppkey AS k, s_acctbal / 1000 AS x, s_nationkey::DOUBLE AS y FROM supplier),
       p AS (SELECT a.k AS a, b.k AS b FROM t a JOIN t b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 1.1 * 1.1),
       c AS (SELECT a AS k FROM p GROUP BY a HAVING count(*) >= 4),
       r(k, m) AS (SELECT k, k FROM c UNION SELECT p.b, r.m FROM r JOIN p ON p.a = r.k JOIN c ON c.k = p.b),
       l AS (SELECT k, min(m) AS m FROM r GROUP BY k)
       SELECT t.k AS s_suppkey, coalesce((SELECT m FROM l WHERE l.k = t.k), (SELECT min(l.m) FROM p JOIN l ON l.k = p.b WHERE p.a = t.k), -1) AS cluster FROM t""",
)


def balances(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as points: balance in thousands and nation."""
    return table(s, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("y"))


POINTS = "t AS (SELECT s_suppkey AS k, s_acctbal / 1000 AS x, s_nationkey::DOUBLE AS y FROM supplier), q AS (SELECT a.k AS a, b.k AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM t a JOIN t b ON true)"
add(
    "m23_single_linkage",
    lambda s, d: spanning.single_linkage(balances(s, d), "s_suppkey", ["x", "y"], k=None, height=1.05),
    f"""WITH RECURSIVE {POINTS}, r(k, m) AS (SELECT k, k FROM t UNION SELECT q.b, r.m FROM r JOIN q ON q.a = r.k AND q.d <= 1.05)
       SELECT k AS s_suppkey, min(m) AS cluster FROM r GROUP BY k""",
)
add("m23_ward", lambda s, d: birch.agglomerative(balances(s, d), "s_suppkey", ["x", "y"], 5))


def density_order(s: SparkSession, d: str) -> DataFrame:
    """DBSCAN's dense rows and noise, cut from the density order of suppliers; the core distance of each."""
    order = spanning.optics(balances(s, d), "s_suppkey", ["x", "y"], 4)
    cut = spanning.density_cut(order, "s_suppkey", 1.1)
    joined = order.select("s_suppkey", "core").join(cut, "s_suppkey")
    dense = F.col("core") <= 1.1
    return rounded(joined.select("s_suppkey", "core", F.when(dense, F.col("cluster")).alias("cluster"), (F.col("cluster") == -1).alias("noise")))


add(
    "m22_optics_cut",
    density_order,
    f"""WITH RECURSIVE {POINTS}, n AS (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS i FROM q),
       c AS (SELECT a AS k, d AS core FROM n WHERE i = 4), e AS (SELECT k FROM c WHERE core <= 1.1),
       r(k, m) AS (SELECT k, k FROM e UNION SELECT q.b, r.m FROM r JOIN q ON q.a = r.k AND q.d <= 1.1 JOIN e ON e.k = q.b),
       l AS (SELECT k, min(m) AS m FROM r GROUP BY k)
       SELECT t.k AS s_suppkey, round(coalesce(c.core, 'inf'::DOUBLE), 6) AS core, l.m AS cluster,
         NOT EXISTS (SELECT 1 FROM q JOIN e ON e.k = q.b WHERE q.a = t.k AND q.d <= 1.1) AS noise
       FROM t LEFT JOIN c USING (k) LEFT JOIN l USING (k)""",
)
add(
    "m24_birch_sums",
    lambda s, d: birch.feature_sums(table(s, d, "customer"), ["c_acctbal", "c_nationkey"], 500.0).select("column", "n", F.round("total", 2).alias("total")),
    """SELECT 'c_acctbal' AS "column", count(c_acctbal) AS n, round(sum(c_acctbal), 2) AS total FROM customer
       UNION ALL SELECT 'c_nationkey', count(c_nationkey), round(sum(c_nationkey)::DOUBLE, 2) FROM customer""",
)
add("m24_birch", lambda s, d: models.cluster(table(s, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), "c_custkey", "birch", 3))


def split_sizes(s: SparkSession, d: str) -> DataFrame:
    """Rows of each status on each side of an exact stratified split of orders."""
    rows = evaluate.split_exact(table(s, d, "orders"), "o_orderkey", 0.3, 7, "o_orderstatus").rows
    return rows.groupBy("o_orderstatus", "split").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"))


add(
    "e1_exact_split",
    split_sizes,
    """WITH c AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT sum(n) AS total, sum(n) - ceil(0.3 * sum(n) - 1e-9) AS train FROM c),
       e AS (SELECT s, n, train, (n * train) // total AS low, (n * train) % total AS rest FROM c, t),
       k AS (SELECT *, low + CASE WHEN row_number() OVER (ORDER BY rest DESC, s) <= train - sum(low) OVER () THEN 1 ELSE 0 END AS kept FROM e)
       SELECT s AS o_orderstatus, 'train' AS split, kept::BIGINT AS n, kept::BIGINT AS keys FROM k
       UNION ALL SELECT s, 'evaluation', (n - kept)::BIGINT, (n - kept)::BIGINT FROM k""",
)
SHARED = ["l_quantity", "l_discount", "l_returnflag", "l_linestatus"]


def shared_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows of every fifth order that some other order's rows repeat, on four columns, one of them with gaps."""
    t = table(s, d, "lineitem").withColumn("l_discount", F.when(F.col("l_discount") != 0.05, F.col("l_discount"))).select("l_orderkey", *SHARED)
    fifth = F.col("l_orderkey") % 5 == 0
    return rounded(evaluate.overlap(t.where(~fifth & (F.col("l_quantity") != 17)).drop("l_orderkey"), t.where(fifth).drop("l_orderkey")))


add(
    "j1_train_test_overlap",
    shared_rows,
    """WITH t AS (SELECT l_orderkey % 5 = 0 AS test, l_quantity AS q, CASE WHEN l_discount <> 0.05 THEN l_discount END AS d, l_returnflag AS r, l_linestatus AS s FROM lineitem),
       a AS (SELECT DISTINCT q, d, r, s FROM t WHERE NOT test AND q <> 17)
       SELECT count(*) AS test_rows, count(a.q) AS shared_rows, round(count(a.q) / count(*), 6) AS shared_ratio
       FROM t LEFT JOIN a ON t.q = a.q AND t.d IS NOT DISTINCT FROM a.d AND t.r = a.r AND t.s = a.s WHERE test""",
)
MEASURES = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r FROM lineitem" for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :])
add(
    "o4_top_pairs",
    lambda s, d: rounded(pairs.top_pairs(table(s, d, "lineitem"), MEASURES, 5, 4)),
    f"SELECT row_number() OVER (ORDER BY abs(r) DESC, x, y)::INTEGER AS rank, x, y, round(r, 6) AS r FROM ({PAIRS}) QUALIFY rank <= 5",
)
add("c6_redundant_columns", lambda s, d: pairs.without_redundant(table(s, d, "lineitem").withColumn("gross", F.col("l_extendedprice") * 1.1), [*MEASURES, "gross"], 0.9))
add("z3_sampled_quartiles", lambda s, d: rounded(profile.sampled_quartiles(table(s, d, "lineitem").withColumn("k", F.struct("l_orderkey", "l_linenumber")), MEASURES, "k")))


def regression_target(s: SparkSession, d: str) -> DataFrame:
    seen = target.detect(table(s, d, "orders"), "o_totalprice", "regression").numeric or {}
    return rounded(s.createDataFrame([tuple(seen.values())], ", ".join(f"{k} double" for k in seen)), 3)


add(
    "g6_regression_profile",
    regression_target,
    """SELECT round(min(x), 3) AS minimum, round(max(x), 3) AS maximum, round(avg(x), 3) AS mean, round(stddev_samp(x), 3) AS std, round(quantile_cont(x, 0.25), 3) AS q25,
       round(median(x), 3) AS median, round(quantile_cont(x, 0.75), 3) AS q75, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 3) AS iqr
       FROM (SELECT o_totalprice AS x FROM orders)""",
)


def published(s: SparkSession, d: str) -> DataFrame:
    """Orders by status, published as the current run of a folder and read back verified."""
    folder = f"{shared_folder(s)}/published-{uuid.uuid4().hex}"
    sizes = table(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))
    publication.publish(s, folder, {"sizes": sizes}, {"policy": {"share": 0.2}}, fit={"policy": "sizes"})
    return publication.read_current(s, folder).table(s, "sizes")


add("k5_published_run", published, "SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY 1")
add(
    "e12_degenerate_metrics",
    lambda s, d: rounded(
        evaluate.binary(table(s, d, "orders").select(F.col("o_orderstatus").alias("y"), F.when(F.col("o_orderkey") % 3 == 0, "F").otherwise("O").alias("p")), "y", "p", F.lit("P"))
    ),
    """WITH c AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS actual FROM orders)
       SELECT unnest(['precision', 'recall', 'f1']) AS metric, 0.0::DOUBLE AS value, unnest([true, actual = 0, actual = 0]) AS degenerate FROM c""",
)
# Dirty values: magnitudes whose squares are no doubles, zeros of either sign, NaN.
add(
    "b2_pearson_extreme",
    lambda s, d: rounded(table(s, d, "lineitem").agg(stats.pearson(F.col("l_quantity") * 1e200, F.col("l_extendedprice") * 1e-200).alias("value"))),
    "SELECT round(corr(l_quantity, l_extendedprice), 6) AS value FROM lineitem",
)
add(
    "a4_signed_zeros",
    lambda s, d: profile.dominant(
        table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, 0.0).when(F.col("c_custkey") % 3 == 1, -0.0).otherwise(F.col("c_nationkey").cast("double")).alias("z")), "c_custkey"
    ).where(F.col("column") == "z").select("column", "unique", "dominant_count", "dominant"),
    """SELECT 'z' AS "column", (SELECT count(DISTINCT CASE WHEN c_custkey % 3 = 2 THEN c_nationkey ELSE 0 END) FROM customer) AS "unique",
       count(*) AS dominant_count, '0.0' AS dominant FROM customer WHERE c_custkey % 3 <> 2 OR c_nationkey = 0""",
)
add(
    "f8_nan_is_missing",
    lambda s, d: rounded(
        frequency.frequency_table(
            table(s, d, "customer").select(F.when(F.col("c_nationkey") < 5, float("nan")).when(F.col("c_nationkey") < 9, F.lit(None)).otherwise(F.col("c_nationkey").cast("double")).alias("a.b")), "a.b"
        ).select("value", "count", "relative", "cumulative")
    ),
    """WITH c AS (SELECT c_nationkey::DOUBLE AS value, count(*) AS count FROM customer WHERE c_nationkey >= 9 GROUP BY 1)
       SELECT value, count, round(count / sum(count) OVER (), 6) AS relative, (sum(count) OVER (ORDER BY value))::BIGINT AS cumulative FROM c""",
)
add("e8_model_comparison", model_comparison)
add("e20_clustering", clustering)

# ---- further checks, predicates, preparation and charts ----


def finding(code: str) -> Query:
    return lambda s, d: rounded(
        quality.from_profile(profile.profile(odd(s, d), "c_custkey"), "y").where(F.col("code") == code).select("column", "severity", "value")
    )


def odd(s: SparkSession, d: str) -> DataFrame:
    """customer with a near-constant, an infinite and a numeric-text column."""
    return table(s, d, "customer").select(
        "c_custkey", "c_name", F.when(F.col("c_custkey") % 100 == 1, "rare").otherwise("usual").alias("mostly"),
        F.when(F.col("c_custkey") % 50 == 2, float("inf")).otherwise(F.col("c_acctbal")).alias("endless"),
        F.when(F.col("c_custkey") % 10 == 3, "unknown").otherwise(F.col("c_nationkey").cast("string")).alias("coded"), (F.col("c_acctbal") > 0).alias("y"),
    )


add("q2_duplicate_rows", lambda s, d: quality.duplicates(table(s, d, "lineitem").select("l_suppkey", "l_quantity")).select("code", "value"),
    "SELECT 'duplicate_rows' AS code, (sum(n) - count(*))::DOUBLE AS value FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, l_quantity)")
add("q4_near_constant", finding("near_constant_column"),
    """SELECT 'mostly' AS "column", 'WARNING' AS severity, round(avg((c_custkey % 100 <> 1)::INT), 6) AS value FROM customer""")  # fmt: skip
add("q5_high_cardinality", finding("high_cardinality"),
    """SELECT 'c_name' AS "column", 'WARNING' AS severity, count(DISTINCT c_name)::DOUBLE AS value FROM customer""")  # fmt: skip
add("q6_id_like", finding("possible_id_like"),
    """SELECT 'c_custkey' AS "column", 'WARNING' AS severity, round(count(DISTINCT c_custkey) / count(*), 6) AS value FROM customer""")  # fmt: skip
add("q8_infinite_values", finding("infinite_values"),
    """SELECT 'endless' AS "column", 'ERROR' AS severity, count(*)::DOUBLE AS value FROM customer WHERE c_custkey % 50 = 2""")  # fmt: skip
add("q7_numeric_text", lambda s, d: rounded(quality.numeric_text(odd(s, d), ["coded", "mostly"], "c_custkey")),
    """SELECT 'coded' AS "column", round(avg((c_custkey % 10 <> 3)::INT), 6) AS share, false AS leading_zeros, true AS numeric_text
       FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 1000) UNION ALL SELECT 'mostly', 0, false, false""")  # fmt: skip
add("q20_verdict", lambda s, d: s.createDataFrame([(quality.verdict(quality.from_profile(profile.profile(odd(s, d), "c_custkey"))),)], "verdict string"),
    "SELECT 'BLOCKED' AS verdict")
add("p2_pairwise_complete", lambda s, d: dirty(s, d).where("gappy IS NOT NULL AND wild IS NOT NULL").agg(F.count("*").alias("pairs")),
    f"SELECT count(*) AS pairs FROM {DIRTY} WHERE gappy IS NOT NULL AND wild IS NOT NULL")
add("p9_finite_values", lambda s, d: odd(s, d).agg(F.count(core.finite(F.col("endless"))).alias("finite"), F.count("endless").alias("present")),
    "SELECT count(*) FILTER (WHERE c_custkey % 50 <> 2) AS finite, count(*) AS present FROM customer")
add("a3_missing_by_column", lambda s, d: profile.basic(dirty(s, d)).select("column", "missing"),
    f"""SELECT unnest(['o_orderkey', 'gappy', 'wild', 'constant', 'status', 'target']) AS "column",
        unnest([0, count(*) - count(gappy), 0, 0, 0, 0])::BIGINT AS missing FROM {DIRTY}""")  # fmt: skip
add("q11_not_assessed", lambda s, d: quality.inspect(
        table(s, d, "nation").select("n_nationkey", *[(F.col("n_regionkey") + i).alias(f"x{i}") for i in range(51)]), "n_nationkey"
    ).where("code = 'multicollinearity_not_assessed'").select("code", "severity", "value"),
    "SELECT 'multicollinearity_not_assessed' AS code, 'INFO' AS severity, 52.0::DOUBLE AS value")
add("d28_extreme_values", lambda s, d: rounded(table(s, d, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, 1e308).otherwise(-1e308).alias("x")).agg(
        (stats.std(F.col("x")) / 1e308).alias("std"), stats.variance(F.col("x")).alias("variance"), (stats.rms(F.col("x")) / 1e308).alias("rms"),
        stats.kurtosis(F.col("x"), bias=True).alias("kurtosis"),
    )),
    """SELECT round(stddev_samp(x), 6) AS std, NULL::DOUBLE AS variance, round(sqrt(avg(x * x)), 6) AS rms, round(kurtosis_pop(x), 6) AS kurtosis
       FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS x FROM orders)""")  # fmt: skip
add("a12_dominant_digest", lambda s, d: audit.redacted(profile.profile(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey"))
    .where("column = 'o_orderpriority'").select("column", "dominant"),
    """SELECT 'o_orderpriority' AS "column", sha256(strlen(v)::VARCHAR || ':' || v) AS dominant FROM
       (SELECT o_orderpriority AS v FROM orders GROUP BY 1 ORDER BY count(*) DESC, min(o_orderkey) LIMIT 1)""")  # fmt: skip
add("f7_totals", lambda s, d: frequency.frequency_table(table(s, d, "part"), "p_brand").agg(F.sum("count").alias("total"), F.count("*").alias("n_distinct")),
    "SELECT count(p_brand) AS total, count(DISTINCT p_brand) AS n_distinct FROM part")
add("t3_spacings", lambda s, d: datetimes.spacings(table(s, d, "orders"), "o_orderdate").select("at", "delta"),
    """SELECT epoch_us(t) AS at, epoch_us(t) - lag(epoch_us(t)) OVER (ORDER BY t) AS delta FROM (SELECT DISTINCT o_orderdate AS t FROM orders)""")  # fmt: skip
add("r17_impute_most_frequent", lambda s, d: prepare.fit(
        t := table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("w")), [prepare.Step("w", "categorical", impute="most_frequent")]
    ).transform(t, ["c_custkey"]),
    """WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS w FROM customer)
       SELECT c_custkey, coalesce(w, (SELECT w FROM t WHERE w IS NOT NULL GROUP BY w ORDER BY count(*) DESC, w LIMIT 1)) AS w FROM t""")  # fmt: skip
add("r21_mapping", lambda s, d: prepare.fit(
        t := table(s, d, "orders").select("o_orderkey", "o_orderstatus"), [prepare.Step("o_orderstatus", "mapped", mapping={"F": 1.5, "O": 2.5}, default=0.0)]
    ).transform(t, ["o_orderkey"]),
    "SELECT o_orderkey, (CASE o_orderstatus WHEN 'F' THEN 1.5 WHEN 'O' THEN 2.5 ELSE 0 END)::DOUBLE AS o_orderstatus FROM orders")
add("r22_numeric_text_parse", lambda s, d: prepare.fit(t := odd(s, d).select("c_custkey", "coded"), [prepare.Step("coded", "numeric_text", impute="mean")])
    .transform(t, ["c_custkey"]).agg(F.round(F.avg("coded"), 6).alias("mean"), F.count("*").alias("rows")),
    "SELECT round(avg(c_nationkey) FILTER (WHERE c_custkey % 10 <> 3), 6) AS mean, count(*) AS rows FROM customer")
add("e1_split", lambda s, d: evaluate.split_digest(evaluate.split_rows(table(s, d, "orders"), "o_orderkey", stratify="o_orderstatus"), "o_orderkey"))
add("e5_split_is_complete", lambda s, d: evaluate.split_rows(table(s, d, "orders"), "o_orderkey").groupBy("o_orderkey").agg(F.count_distinct("split").alias("sides")).groupBy("sides").count(),
    "SELECT 1::BIGINT AS sides, count(DISTINCT o_orderkey) AS count FROM orders")
add("e9_ranking", lambda s, d: evaluate.leaderboard(
        table(s, d, "nation").select(F.col("n_name").alias("model"), F.nullif(F.col("n_regionkey"), F.lit(2)).alias("score")), "score"
    ),
    """SELECT n_name AS model, nullif(n_regionkey, 2) AS score, CASE WHEN n_regionkey <> 2 THEN
       row_number() OVER (ORDER BY nullif(n_regionkey, 2) DESC NULLS LAST, n_name) END::INT AS rank FROM nation""")  # fmt: skip
add("c4_target_associations", lambda s, d: rounded(charts.target_associations(table(s, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_tax"])),
    """SELECT 'l_quantity' AS "column", round(abs(corr(l_quantity, l_extendedprice)), 6) AS r FROM lineitem
       UNION ALL SELECT 'l_tax', round(abs(corr(l_tax, l_extendedprice)), 6) FROM lineitem""")  # fmt: skip
add("c9_bars", lambda s, d: charts.bars(table(s, d, "part"), "p_brand", 8),
    """WITH r AS (SELECT p_brand AS label, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS k FROM part GROUP BY 1)
       SELECT label, count FROM r WHERE k <= 8 UNION ALL SELECT 'Other', sum(count)::BIGINT FROM r WHERE k > 8 HAVING count(*) > 0""")  # fmt: skip
add("c15_grouped_bars", lambda s, d: frequency.grouped_tally(table(s, d, "orders"), "o_orderpriority", "o_orderstatus"),
    "SELECT o_orderpriority, o_orderstatus, count(*) AS count FROM orders GROUP BY 1, 2")
add("c16_sample", lambda s, d: charts.sample(table(s, d, "orders"), "o_orderkey", 50))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
