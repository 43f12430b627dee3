"""Quality checks: findings as rows, computed from a profile and a few shared aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer import core
from assayer.functions import stats
from assayer.operators import profile as profiles
from assayer.operators import target as targets
from assayer.operators.profile import quoted

FINDING = "code string, severity string, column string, value double, requires_review boolean"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
#: A check of one's own: the table and the name of its key, to findings.
Check = Callable[[DataFrame, str], DataFrame]
# Words of a name that say a column is known only after the outcome, and endings of the time of an event.
AFTER_OUTCOME = (
    "outcome", "result", "resolution", "final", "closed", "cancel", "cancelled", "cancellation", "churn", "churned", "converted", "conversion",
    "repaid", "refund", "refunded", "settled", "label", "target", "groundtruth", "ground_truth", "probability", "prediction", "predicted",
)
EVENT_TIME = ("_at", "_date", "_time", "_timestamp", "_ts")


def name_signal(column: Column, target: str) -> Column:
    """What a column's name alone says against it: that it holds the target's name, or a word for what comes after the outcome; else NULL."""
    low = F.lower(column)
    after = column.rlike(rf"(?i)(^|[^a-z])({'|'.join(AFTER_OUTCOME)})([^a-z]|$)")
    timed = low.rlike(rf"({'|'.join(EVENT_TIME)})$")
    holds = (low != target.lower()) & low.contains(target.lower())
    return F.when(holds, "name_contains_target").when(after & timed, "post_outcome_timestamp_name").when(after, "post_outcome_name")


def from_profile(profile: DataFrame, target: str | None = None, config: core.Config = core.Config()) -> DataFrame:
    """Findings that one row of the profile decides: no further pass over the table."""
    feature = F.lit(True) if target is None else F.col("column") != target
    rules = [
        ("missing_values", F.when(F.col("missing_ratio") > config.missing_warning, "WARNING").otherwise("INFO"), F.col("missing") > 0, "missing_ratio", False),
        ("constant_column", F.lit("WARNING"), F.col("constant"), "dominant_ratio", False),
        ("near_constant_column", F.lit("WARNING"), F.col("near_constant"), "dominant_ratio", False),
        ("high_cardinality", F.lit("WARNING"), F.col("high_cardinality") & feature, "unique", False),
        ("possible_id_like", F.lit("WARNING"), F.col("id_like") & feature, "unique_ratio", True),
        ("infinite_values", F.lit("ERROR"), F.col("infinite") > 0, "infinite", False),
    ]
    entries = F.array(
        *[
            F.when(
                when,
                F.struct(
                    F.lit(code).alias("code"), severity.alias("severity"), F.col("column"), F.col(value).cast("double").alias("value"),
                    F.lit(review).alias("requires_review"),
                ),
            )
            for code, severity, when, value, review in rules
        ]
    )
    return profile.select(F.inline(F.filter(entries, lambda e: e.isNotNull())))


def duplicates(df: DataFrame) -> DataFrame:
    n = F.col("duplicate_rows")
    return profiles.duplicate_rows(df).where(n > 0).select(
        F.lit("duplicate_rows").alias("code"), F.lit("WARNING").alias("severity"), F.lit(None).cast("string").alias("column"),
        n.cast("double").alias("value"), F.lit(False).alias("requires_review"),
    )


def outliers(df: DataFrame, columns: list[str], config: core.Config = core.Config()) -> DataFrame:
    """Values beyond the Tukey fences of each column: ``column``, ``low``, ``high``, ``outliers``.

    Fences come from quartiles that the columns find together and counts from one
    aggregate. A column of fewer than four values or without spread has no count.
    """
    df = core.normalize(df)
    x = {c: core.finite(quoted(c)) for c in columns}
    quarters = stats.quantiles_of(df, x, [0.25, 0.75])
    parts = []
    for c in columns:
        low, high = quarters[c]
        wide = None if low is None else high - low
        reach = None if wide is None else config.iqr_multiplier * wide
        fences = [F.lit(None if reach is None else v).cast("double") for v in ((low or 0) - (reach or 0), (high or 0) + (reach or 0))]
        beyond = F.count_if((x[c] < fences[0]) | (x[c] > fences[1]))
        counted = F.when(F.count(x[c]) >= 4, beyond) if wide else F.lit(None).cast("long")
        parts.append(F.struct(F.lit(c).alias("column"), fences[0].alias("low"), fences[1].alias("high"), counted.alias("outliers")))
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def numeric_text(df: DataFrame, columns: list[str], order: str, config: core.Config = core.Config()) -> DataFrame:
    """Share of numbers among the first 1,000 values of text columns; leading zeros exempt a column."""
    head = profiles.heads(df, columns, order, 1000)
    shares = head.groupBy("column").agg(F.avg(F.col("v").rlike(NUMBER).cast("double")).alias("share"))
    zero = [F.struct(F.lit(c).alias("column"), F.coalesce(F.bool_or(quoted(c).rlike(r"^\s*[+-]?0\d")), F.lit(False)).alias("leading_zeros")) for c in columns]
    exempt = df.agg(F.array(*zero).alias("a")).select(F.inline("a"))
    out = exempt.join(shares, "column", "left").select("column", "share", "leading_zeros")
    return out.withColumn("numeric_text", ~F.col("leading_zeros") & (F.coalesce("share", F.lit(0.0)) >= config.numeric_text_ratio))


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation of each column from one Gram matrix of the complete, centred rows.

    A task multiplies its batches as matrices and emits one sum a pair of columns; what reaches the
    driver is these sums. At most 50 columns are assessed. A constant column, and every column of a
    table without complete rows, has NULL.
    """
    if len(columns) > 50:
        raise core.DomainError("more than 50 columns are not assessed")
    k = len(columns)
    x = core.normalize(df).select(*[core.finite(quoted(c)).alias(f"x{i}") for i, c in enumerate(columns)])

    def whole(batch: pa.RecordBatch) -> np.ndarray:
        a = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns], float).reshape(k, batch.num_rows)
        return a[:, np.isfinite(a).all(axis=0)]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, total = 0, np.full(k, np.inf), np.full(k, -np.inf), np.zeros(k)
        for a in map(whole, batches):
            if a.shape[1]:
                n, low, high = n + a.shape[1], np.minimum(low, a.min(axis=1)), np.maximum(high, a.max(axis=1))
                with np.errstate(over="ignore", invalid="ignore"):  # such a sum is no number, and its column is centred otherwise
                    total += a.sum(axis=1)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(np.full(k, n)), *map(pa.array, (low, high, total))], names=["i", "n", "low", "high", "total"])

    sides = x.mapInArrow(ends, "i long, n long, low double, high double, total double")
    facts = sides.groupBy("i").agg(F.sum("n"), F.min("low"), F.max("high"), F.sum("total")).orderBy("i").collect()
    middle, size = np.zeros(k), np.ones(k)
    for i, n, low, high, total in facts:
        mean = total / n if np.isfinite(total) else low / 2 + high / 2
        middle[i], size[i] = (low, 1.0) if low == high else (mean, max(high / 2 - mean / 2, mean / 2 - low / 2))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k + 1, k + 1))  # the last place holds ones, so the first powers are summed too
        for a in map(whole, batches):
            z = np.vstack([(a / 2 - middle[:, None] / 2) / size[:, None], np.ones(a.shape[1])])
            sums += z @ z.T
        i, j = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(sums[i, j])], names=["i", "j", "g"])

    gram = np.zeros((k + 1, k + 1))
    if facts:
        for i, j, g in x.mapInArrow(products, "i long, j long, g double").groupBy("i", "j").agg(F.sum("g")).collect():
            gram[i, j] = gram[j, i] = g
        gram = gram[:k, :k] - np.outer(gram[k, :k], gram[k, :k]) / gram[k, k]
        spread = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
        gram /= np.outer(spread, spread)
    out = []
    for i, c in enumerate(columns):
        rest = [j for j in range(k) if j != i and gram[j, j] > 0]
        if gram[i, i] <= 0 or not rest:
            out.append((c, None))
            continue
        b, *_ = np.linalg.lstsq(gram[np.ix_(rest, rest)], gram[rest, i], rcond=None)
        free = float(1 - (b @ gram[rest, i]) / gram[i, i])
        out.append((c, 1 / free if free > 1e-12 else float("inf")))
    return df.sparkSession.createDataFrame(out, "column string, vif double")


def leakage(df: DataFrame, target: str, config: core.Config = core.Config()) -> DataFrame:
    """Of each feature: exact copy of the target, deterministic mapping, extreme association, suspicious name.

    Copies and correlations are one aggregate; mappings are one unpivot grouped by
    feature value, so a hot value is combined before it is shuffled.
    """
    df = core.normalize(df)
    kinds = core.kinds(df)
    features = [c for c in df.columns if c != target]
    t = quoted(target)
    numeric = (core.NUMERIC, core.BOOLEAN)
    as_number = {c: core.finite(quoted(c)) if kinds[c] == core.NUMERIC else quoted(c).cast("double") for c in df.columns if kinds[c] in numeric}
    x = stats.measured(df, as_number) if target in as_number else {}
    one = [
        F.struct(
            F.lit(c).alias("column"),
            F.coalesce(F.bool_and(quoted(c).cast("string").eqNullSafe(t.cast("string")) & t.isNotNull()), F.lit(False)).alias("copy"),
            (stats.correlated(x[c], x[target]) if c in x else F.lit(None).cast("double")).alias("correlation"),
        )
        for c in features
    ]
    sides = df.agg(F.array(*one).alias("a")).select(F.inline("a"))
    cells = df.select(
        t.cast("string").alias("t"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("v")) for c in features])).alias("cell"),
    ).select("t", "cell.*").where("v IS NOT NULL AND t IS NOT NULL")
    mapped = (
        cells.groupBy("column", "v").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n"))
        .groupBy("column").agg(F.bool_and(F.col("a") == F.col("b")).alias("maps"), F.count("*").alias("unique"), F.sum("n").alias("rows"))
    )
    signal = name_signal(F.col("column"), target)
    return sides.join(mapped, "column", "left").select(
        "column", "copy",
        (F.coalesce("maps", F.lit(False)) & F.col("unique").between(F.lit(2), F.greatest(F.lit(2), F.floor(F.col("rows") / 2)))).alias("deterministic"),
        (F.coalesce(F.abs("correlation"), F.lit(0.0)) >= config.leakage_correlation).alias("extreme"), signal.isNotNull().alias("suspicious_name"), "correlation",
    )


def imbalance(df: DataFrame, target: str, config: core.Config = core.Config()) -> DataFrame:
    """``classes``, ``minority`` (share of the rarest) and ``imbalanced``, which only a target of a classification can be."""
    t = quoted(target)
    numeric = core.kind_of(df.select(t).schema[0].dataType) == core.NUMERIC
    counts = core.normalize(df.select(t.alias("t"))).where("t IS NOT NULL").groupBy("t").count()
    x = core.finite(F.col("t")) if numeric else F.lit(None).cast("double")
    sides = counts.agg(
        F.count("*").alias("classes"), (F.min("count") / F.sum("count")).alias("minority"), F.count("*").alias("distinct"), F.sum("count").alias("valid"),
        F.coalesce(F.bool_and(x == F.floor(x)), F.lit(False)).alias("integral"), F.lit(numeric).alias("numeric"),
    )
    named = targets.task_rule(config) == "classification"
    return sides.select("classes", "minority", (named & (F.col("classes") > 1) & (F.col("minority") < config.imbalance)).alias("imbalanced"))


def inspect(df: DataFrame, order: str, target: str | None = None, config: core.Config = core.Config(), checks: Sequence[Check] = ()) -> DataFrame:
    """All findings of a table, one row each; ``checks`` add findings of their own in the columns of ``FINDING``."""
    kinds = core.kinds(df)
    profile = profiles.profile(df, order, config)
    numeric = [c for c, k in kinds.items() if k == core.NUMERIC and c != target]
    text = [c for c, k in kinds.items() if k == core.CATEGORICAL and c != target]
    make = lambda code, severity, value, review=False: [
        F.lit(code).alias("code"), severity.alias("severity"), F.col("column"), value.cast("double").alias("value"), F.lit(review).alias("requires_review")
    ]
    found = [from_profile(profile, target, config), duplicates(df)]
    if numeric:
        found.append(outliers(df, numeric, config).where("outliers > 0").select(*make("possible_outliers", F.lit("INFO"), F.col("outliers"))))
        if 1 < len(numeric) <= 50:
            found.append(vif(df, numeric).where(F.col("vif") >= config.vif).select(*make("possible_multicollinearity", F.lit("WARNING"), F.col("vif"))))
        elif len(numeric) > 50:
            skipped = df.sparkSession.range(1).withColumn("column", F.lit(None).cast("string"))
            found.append(skipped.select(*make("multicollinearity_not_assessed", F.lit("INFO"), F.lit(len(numeric)))))
    if text:
        found.append(numeric_text(df, text, order, config).where("numeric_text").select(*make("possible_numeric_stored_as_text", F.lit("WARNING"), F.col("share"))))
    if target is not None:
        hints = leakage(df, target, config)
        found.append(hints.where("copy").select(*make("target_leakage_exact_duplicate", F.lit("ERROR"), F.lit(1.0))))
        found.append(hints.where("NOT copy AND (deterministic OR extreme OR suspicious_name)").select(*make("possible_target_leakage", F.lit("WARNING"), F.coalesce("correlation", F.lit(1.0)), True)))
        unequal = imbalance(df, target, config).where("imbalanced").withColumn("column", F.lit(target))
        found.append(unequal.select(*make("class_imbalance", F.lit("WARNING"), F.col("minority"))))
    names = [part.split()[0] for part in FINDING.split(", ")]
    for check in checks:
        more = check(df, order)
        if missing := [n for n in names if n not in more.columns]:
            raise core.ConfigurationError(f"a check gives no {missing}")
        found.append(more.select(*names))
    return reduce(DataFrame.unionByName, found)


def verdict(findings: DataFrame) -> str:
    """BLOCKED by an error, else REVIEW_REQUIRED, READY_WITH_WARNINGS or READY."""
    row = findings.agg(
        F.count_if(F.col("severity") == "ERROR"), F.count_if("requires_review"), F.count_if(F.col("severity") == "WARNING")
    ).first()
    return next((v for n, v in zip(row, ("BLOCKED", "REVIEW_REQUIRED", "READY_WITH_WARNINGS"), strict=True) if n), "READY")


VERDICTS = ("READY", "READY_WITH_WARNINGS", "REVIEW_REQUIRED", "BLOCKED")


def exit_code(verdict: str, fail_on: str) -> int:
    """0, or 2 (review and warnings) or 3 (blocked), by the policy never, warning, review or error."""
    least = {"never": 9, "warning": 1, "review": 2, "error": 3}[fail_on]
    at = VERDICTS.index(verdict)
    return 0 if at < least else 3 if at == 3 else 2
