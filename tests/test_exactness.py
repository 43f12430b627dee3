"""Exact splits, overlaps, correlated pairs, samples and leakage by name; dirty values of every measurement."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer import core
from assayer.functions import stats
from assayer.operators import charts, evaluate, frequency, pairs, profile, quality, target

NAN, INF = float("nan"), float("inf")


def numbers(spark, n, classes=("a", "b", "c"), weights=(0.6, 0.3, 0.1)):
    r = np.random.default_rng(n)
    return spark.createDataFrame([(i, str(r.choice(classes, p=weights))) for i in range(n)], "k long, y string")


# ---- exact split ----


def plain_sizes(counts, share):
    """Training rows by largest remainder, ties to the lesser class."""
    total = sum(counts.values())
    train = total - math.ceil(round(share * total, 9))
    low = {c: n * train // total for c, n in counts.items()}
    order = sorted(counts, key=lambda c: (-((counts[c] * train) % total), c))
    for c in order[: train - sum(low.values())]:
        low[c] += 1
    return {c: (low[c], n - low[c]) for c, n in counts.items()}


@pytest.mark.parametrize(("n", "share"), [(500, 0.2), (37, 0.31), (1000, 0.001), (9, 0.5)])
def test_split_sizes_are_exact_on_any_partitions(spark, n, share):
    df = numbers(spark, n)
    counts = {r["y"]: r["n"] for r in df.groupBy("y").agg(F.count("*").alias("n")).collect()}
    sides = []
    for parts in (1, 8):
        split = evaluate.split_exact(df.repartition(parts), "k", share, 3, "y")
        rows = split.rows.collect()
        assert sorted(r["k"] for r in rows) == list(range(n))
        got = {c: tuple(sum(r["split"] == s and (r["y"] == c or not split.stratified) for r in rows) for s in ("train", "evaluation")) for c in counts}
        if split.stratified:
            assert got == plain_sizes(counts, share) == split.sizes
        else:
            assert "not stratified" in split.note or any(0 in v for v in split.sizes.values())
        assert sum(r["split"] == "evaluation" for r in rows) == math.ceil(round(share * n, 9))
        sides.append({r["k"] for r in rows if r["split"] == "evaluation"})
    assert sides[0] == sides[1]
    other = evaluate.split_exact(df, "k", share, 4, "y").rows.where("split = 'evaluation'").collect()
    assert n < 100 or share < 0.01 or {r["k"] for r in other} != sides[0]


def test_split_of_rare_classes_missing_targets_and_repeated_keys(spark):
    one = spark.createDataFrame([(i, "x" if i else "rare") for i in range(20)], "k long, y string")
    split = evaluate.split_exact(one, "k", 0.25, 1, "y")
    assert (split.stratified, split.sizes) == (False, {None: (15, 5)})
    assert "rare" in split.note
    many = spark.createDataFrame([(i, str(i // 2)) for i in range(20)], "k long, y string")
    assert "do not fit" in evaluate.split_exact(many, "k", 0.25, 1, "y").note
    same = spark.createDataFrame([(1, "x")] * 10, "k long, y string")
    assert evaluate.split_exact(same, "k", 0.3, 1, "y").rows.where("split = 'evaluation'").count() == 3
    with pytest.raises(core.DomainError):
        evaluate.split_exact(spark.createDataFrame([(1, None), (2, "a")], "k long, y string"), "k", 0.5, 1, "y")
    for rows, share in (([(1, "a")], 0.5), ([], 0.5)):
        with pytest.raises(core.EmptyDataError):
            evaluate.split_exact(spark.createDataFrame(rows, "k long, y string"), "k", share)
    with pytest.raises(core.ConfigurationError):
        evaluate.split_exact(same, "k", 1.0)
    clash = same.withColumnsRenamed({"k": "want", "y": "n"})
    assert evaluate.split_exact(clash, "want", 0.3, 1, "n").rows.columns == ["want", "n", "split"]


# ---- overlap ----


def test_overlap_counts_missing_as_equal(spark):
    train = spark.createDataFrame([(1, None, NAN), (2, "b", -0.0), (2, "b", 0.0), (9, "z", 1.0)], "a long, b string, c double")
    test = spark.createDataFrame([(0.0, 2, "b"), (None, 1, None), (1.0, 9, "y"), (-0.0, 2, "b")], "c double, a long, b string").withColumn("only_here", F.lit(1))
    assert tuple(evaluate.overlap(train, test).first()) == (4, 3, 0.75)
    assert tuple(evaluate.overlap(train, test.limit(0)).first()) == (0, 0, None)
    assert tuple(evaluate.overlap(train.limit(0), test).first()) == (4, 0, 0.0)
    with pytest.raises(core.SchemaError):
        evaluate.overlap(train, test.select("only_here"))


# ---- correlated pairs ----


@pytest.mark.parametrize("block", [2, 3, 64])
def test_blocked_correlations_against_a_loop(spark, block):
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 5))
    x[:, 1] = x[:, 0] * 2 + r.normal(size=200) * 0.01
    x[:, 2] *= 1e200
    x[:, 3] = x[:, 3] * 1e-200 + 0
    rows = [[None if r.random() < 0.1 else float(v) for v in row] + [5.0, NAN if i % 2 else INF] for i, row in enumerate(x)]
    names = [f"c.{i}" for i in range(7)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(3)
    got = {(r["x"], r["y"]): (r["n"], r["r"]) for r in pairs.correlations(df, names, block).collect()}
    assert len(got) == 21
    for (a, b), (n, value) in got.items():
        i, j = names.index(a), names.index(b)
        assert i < j
        both = [(row[i], row[j]) for row in rows if all(row[k] is not None and math.isfinite(row[k]) for k in (i, j))]
        assert n == len(both)
        if 5 in (i, j) or 6 in (i, j):
            assert value is None
        else:
            p, q = np.array(both).T / np.abs(np.array(both).T).max(axis=1)[:, None]
            assert abs(value - np.corrcoef(p, q)[0, 1]) < 1e-9
    first = pairs.top_pairs(df, names, 3, block).collect()
    assert [r["rank"] for r in first] == [1, 2, 3]
    assert (first[0]["x"], first[0]["y"]) == ("c.0", "c.1")


def test_redundant_columns_fall_to_the_first_kept_one(spark):
    r = np.random.default_rng(2)
    a, noise = r.normal(size=300), r.normal(size=(300, 4)) * 0.05
    df = spark.createDataFrame([(float(u), float(u + v[0]), float(-u + v[1]), float(v[2]), float(v[2] * 3)) for u, v in zip(a, noise, strict=True)], "a double, b double, c double, d double, e double")
    rows = {r["column"]: (r["kept"], r["because"]) for r in pairs.without_redundant(df, ["e", "b", "a", "d", "c"], 0.9, 2).collect()}
    assert rows == {"e": (True, None), "b": (True, None), "a": (False, "b"), "d": (False, "e"), "c": (False, "b")}
    assert [r["kept"] for r in pairs.without_redundant(df, ["a"]).collect()] == [True]


# ---- bottom-k sample ----


def test_sampled_quartiles_do_not_depend_on_partitions(spark):
    df = spark.range(20_000).select("id", F.pmod(F.col("id") * 7919, F.lit(20_000)).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, 1.0).alias("half"))
    seen = [sorted(tuple(r) for r in profile.sampled_quartiles(df.repartition(n), ["x", "half"], "id", 2_000).collect()) for n in (1, 7)]
    assert seen[0] == seen[1]
    _, row = seen[0]
    name, q25, median, q75, sampled, rows, approximate, error = row
    assert (name, sampled, rows, approximate) == ("x", 2_000, 20_000, True)
    for want, got in ((0.25, q25), (0.5, median), (0.75, q75)):
        assert abs(got / 20_000 - want) <= error
    exact = profile.sampled_quartiles(df, ["x"], "id", 30_000).first()
    assert (exact["median"], exact["approximate"], exact["rank_error"]) == (9999.5, False, 0.0)


# ---- leakage by name ----


@pytest.mark.parametrize(
    ("name", "goal", "signal"),
    [
        ("cancellation_date", "y", "post_outcome_timestamp_name"), ("churn_bucket", "Churn", "name_contains_target"), ("Predicted", "y_true", "post_outcome_name"),
        ("refund", "sold", "post_outcome_name"), ("groundTruth", "sold", "post_outcome_name"), ("unresolved", "sold", None), ("finally", "sold", None),
        ("credit_score", "sold", None), ("created_at", "sold", None), ("sold", "sold", None), ("closed_at", "sold", "post_outcome_timestamp_name"),
    ],
)
def test_names_that_tell_the_outcome(spark, name, goal, signal):
    column = spark.createDataFrame([(name,)], "column string")
    assert column.select(quality.name_signal(F.col("column"), goal)).first()[0] == signal


def test_a_name_alone_is_a_finding(spark):
    df = spark.createDataFrame([(i, i * 7 % 20, i % 2) for i in range(20)], "k long, cancellation_date long, y long")
    found = {(r["code"], r["column"]): r["requires_review"] for r in quality.inspect(df, "k", "y").collect()}
    assert found["possible_target_leakage", "cancellation_date"] is True


# ---- dirty values ----


def test_correlation_of_extreme_and_infinite_values(spark):
    rows = [(i * 1e200, float(i), i * 1e-200, INF if i == 3 else float(i), 7.0) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "big double, one double, small double, endless double, flat double")
    value = lambda a, b: df.agg(stats.pearson(F.col(a), F.col(b))).first()[0]
    for a, b in (("big", "one"), ("one", "big"), ("big", "big"), ("big", "small"), ("small", "small"), ("one", "small")):
        assert math.isclose(value(a, b), 1.0)
    assert value("one", "endless") is None
    assert value("big", "flat") is None
    seen = {(r["x"], r["y"]): r["r"] for r in charts.heatmap(df, ["big", "one", "small", "flat"]).collect()}
    assert math.isclose(seen["big", "small"], 1.0)
    assert seen["one", "flat"] is None
    said = {r["column"]: r["r"] for r in charts.target_associations(df, "big", ["one", "flat"]).collect()}
    assert math.isclose(said["one"], 1.0)
    assert said["flat"] is None


def test_signed_zeros_are_one_value(spark):
    df = spark.createDataFrame([(1, 0.0), (2, -0.0), (3, 1.0), (4, NAN)], "k long, x double")
    row = profile.dominant(df, "k").where("column = 'x'").first()
    assert (row["unique"], row["dominant_count"], row["dominant"]) == (2, 2, "0.0")
    assert [r["count"] for r in frequency.value_counts(df, "x", "k").orderBy("value").collect()] == [2, 1]


def test_ties_of_the_dominant_value_beyond_doubles(spark):
    df = spark.createDataFrame([(2**53 + 1, "later"), (2**53, "first")], "k long, x string")
    assert profile.dominant(df, "k").where("column = 'x'").first()["dominant"] == "first"


def test_frequencies_of_nan_and_dotted_names(spark):
    df = spark.createDataFrame([(1, NAN, "a"), (2, 1.0, "a"), (3, None, "b"), (4, 1.0, None)], ["k", "x.y", "g`h"])
    omitted = frequency.frequency_table(df, "x.y").collect()
    assert [(r["value"], r["count"], r["relative"]) for r in omitted] == [(1.0, 2, 1.0)]
    included = frequency.frequency_table(df, "x.y", "include").collect()
    assert sorted(((r["value"], r["count"]) for r in included), key=repr) == [(1.0, 2), (None, 2)]
    assert {tuple(r) for r in frequency.value_counts(df, "x.y", "k", dropna=False).collect()} == {(1.0, 2, 2), (None, 2, 1)}
    assert frequency.grouped_tally(df, "g`h", "x.y").count() == 4
    assert {tuple(r) for r in frequency.top_k_other(df, "g`h", 1).collect()} == {("a", 2), ("Other", 1)}


def test_histogram_of_the_widest_range(spark):
    df = spark.createDataFrame([(-1.7e308,), (0.0,), (1.7e308,), (1.7e308,)], "x double")
    rows = sorted(tuple(r) for r in charts.histogram(df, "x", 4).collect())
    assert [(b, n) for b, _, _, n in rows] == [(0, 1), (2, 1), (3, 2)]
    assert all(math.isfinite(low) and math.isfinite(high) and low < high for _, low, high, _ in rows)
    assert (rows[0][1], rows[-1][2]) == (-1.7e308, 1.7e308)


def test_profile_of_a_regression_target(spark):
    df = spark.createDataFrame([(float(i),) for i in range(40)] + [(NAN,), (None,)], "y double")
    seen = target.detect(df, "y", "regression").numeric
    assert (seen["minimum"], seen["maximum"], seen["mean"], seen["median"], seen["iqr"]) == (0.0, 39.0, 19.5, 19.5, 19.5)


# ---- metrics ----


def test_degenerate_metrics_and_blocked_partitions(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "a"), ("c", None)], "y string, p string")
    got = {c: {r["metric"]: (r["value"], r["degenerate"]) for r in evaluate.binary(df, "y", "p", F.lit(c)).collect()} for c in ("a", "c", "z")}
    assert got["a"] == {"precision": (0.5, False), "recall": (0.5, False), "f1": (0.5, False)}
    assert got["c"] == {"precision": (0.0, True), "recall": (0.0, False), "f1": (0.0, False)}
    assert got["z"] == {"precision": (0.0, True), "recall": (0.0, True), "f1": (0.0, True)}
    row = evaluate.classification(df, "y", "p").first()
    assert math.isclose(row["accuracy"], 0.25)
    assert math.isclose(row["precision"], 0.5 / 3)
    label = lambda *v: evaluate.partition_blocker(spark.createDataFrame([(x,) for x in v], "l int"), "l")
    assert label(0, 0, 1, -1) is None
    assert "noise" in label(-1, -1)
    assert "one cluster" in label(0, 0, -1)
    assert "of its own" in label(0, 1, 2)


def test_a_day_with_all_events_is_ranged(spark):
    from assayer.operators import datetimes

    df = spark.range(2_000).select(F.timestamp_micros(F.col("id") * F.col("id") * 1000).alias("t"))
    rows = sorted((r["at"], r["delta"]) for r in datetimes.spacings(df.union(df), "t").collect())
    assert rows[0] == (0, None)
    assert all(b - a == d for (a, _), (b, d) in zip(rows, rows[1:], strict=False))
    assert len(rows) == 2_000


def test_first_values_of_text_columns_take_one_scan(spark):
    df = spark.createDataFrame([(i, f"AB-{i:04d}", "007" if i % 2 else None, "x") for i in range(500)], "k long, code string, zero string, word string")
    shapes = {r["column"]: r["id_shape"] for r in profile.id_values(df, ["code", "zero", "word"], "k").collect()}
    assert shapes == {"code": True, "zero": False, "word": False}
    numeric = {r["column"]: (r["share"], r["numeric_text"]) for r in quality.numeric_text(df, ["code", "zero", "word"], "k").collect()}
    assert numeric == {"code": (0.0, False), "zero": (1.0, False), "word": (0.0, False)}
    assert profile.id_values(df, [], "k") is None


def test_a_continuous_target_is_no_stratum(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "MOST_CLASSES", 5)
    with pytest.raises(core.DomainError, match="classes"):
        evaluate.split_exact(spark.range(20), "id", 0.5, 1, "id")


def test_inflation_of_many_columns_equals_the_inverse_correlation(spark):
    import numpy as np

    from assayer.operators import quality

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 24)) @ np.diag(np.logspace(-3, 6, 24)) + 1e5
    x[:, 3] = x[:, 1] * 2 + rng.normal(size=300) * 1e-4
    x[:, 7] = 4.5
    rows = [tuple(None if rng.random() < 0.002 else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(24))).repartition(5)
    kept = np.array([r for r in rows if None not in r])
    free = [i for i in range(24) if i != 7]
    want = np.diag(np.linalg.inv(np.corrcoef(kept[:, free].T)))
    said = {r["column"]: r["vif"] for r in quality.vif(df, [f"c{i}" for i in range(24)]).collect()}
    assert said["c7"] is None and len(kept) < 300
    np.testing.assert_allclose([said[f"c{i}"] for i in free], want, rtol=1e-6)
    copied = {r["column"]: r["vif"] for r in quality.vif(df.select("c0", F.col("c0").alias("again"), "c2"), ["c0", "again", "c2"]).collect()}
    assert copied["c0"] == copied["again"] == float("inf") and copied["c2"] < 1.2
    assert all(r["vif"] is None for r in quality.vif(df.limit(0), ["c0", "c1"]).collect())
