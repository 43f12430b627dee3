"""Chart plans: rules on small tables worked out by hand, bounds on wide ones, and the data of each chart."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assayer import core
from assayer.operators import advisor


def plan_of(df, *args, **kwargs):
    return {(r["chart"], tuple(r["columns"])): r for r in advisor.recommend(df, "k", *args, **kwargs).collect()}


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.range(200).select(
        F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") * 3 % 200 + F.col("id") % 2 * 0.5).alias("y"),
        F.when(F.col("id") % 4 > 0, F.col("id") % 5 * 1.5).alias("gap"), F.concat(F.lit("c"), (F.col("id") % 15).cast("string")).alias("many"),
        (F.col("id") % 3).cast("string").alias("three"), F.lit("one").alias("same"), F.current_timestamp().alias("t"),
    )
    return rows.withColumn("goal", F.col("y") * 2 + F.col("x") / 100).withColumn("days", F.expr("date'2024-01-01' + cast(k as int)"))


def test_plan_of_a_regression_target(table):
    plan = plan_of(table, "goal", "k", budget=advisor.Budget(charts=50))
    assert ("histogram", ("k",)) not in plan  # the identifier is no feature
    for chart, column, code in (("bar", "same", "constant_column"), ("bar", "days", "unsupported_column_kind")):
        row = plan[chart, (column,)]
        assert (row["code"], row["rank"], row["score"]) == (code, None, None)
    assert plan["box_plot", ("x",)]["code"] == "redundant_distribution_view"
    assert plan["target_distribution", ("goal",)]["score"] == pytest.approx(1.2)
    assert plan["missing_values", ("gap",)]["score"] == pytest.approx(0.95)
    assert plan["correlation_heatmap", ("x", "y", "gap")]["score"] == pytest.approx(0.65)
    assert plan["histogram", ("gap",)]["score"] == pytest.approx(0.5 - 0.2 * 0.25)
    assert plan["bar", ("many",)]["score"] == pytest.approx(0.45 - 0.1 * 15 / 20)
    assert plan["bar", ("three",)]["score"] == pytest.approx(0.45)
    near = plan["scatter", ("y", "goal")]
    assert near["code"] == "possible_target_leakage_review" and near["requires_review"] and near["strength"] > 0.99
    assert near["score"] == pytest.approx(0.55 + 0.3 + 0.25 * near["strength"] + 0.15, abs=1e-5)
    assert plan["grouped_box", ("three", "goal")]["score"] == pytest.approx(0.9)
    assert plan["grouped_box", ("many", "goal")]["score"] == pytest.approx(0.9)
    assert len([1 for c, cols in plan if c == "scatter" and "goal" not in cols]) == 3
    ranks = sorted(r["rank"] for r in plan.values() if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1))
    by_rank = sorted((r for r in plan.values() if r["rank"]), key=lambda r: r["rank"])
    assert [(-r["score"], r["chart"], r["columns"]) for r in by_rank] == sorted((-r["score"], r["chart"], r["columns"]) for r in by_rank)


def test_names_of_three_classes_or_more_have_no_correlation(table):
    coded = table.withColumn("class", (F.col("k") % 3).cast("int")).drop("three")
    plan = plan_of(coded, "class", "k", budget=advisor.Budget(charts=50))
    assert all(r["strength"] is None for (c, cols), r in plan.items() if "class" in cols)
    assert plan["grouped_box", ("x", "class")]["score"] == pytest.approx(0.9)
    two = table.withColumn("class", F.col("y") > 100).drop("goal", "three")
    assert plan_of(two, "class", "k", budget=advisor.Budget(charts=50))["grouped_box", ("y", "class")]["strength"] > 0.8


def test_budgets_and_outliers(spark, table):
    plan = plan_of(table, "goal", "k", budget=advisor.Budget(charts=3))
    assert sorted(r["rank"] for r in plan.values() if r["rank"]) == [1, 2, 3]
    assert plan["histogram", ("x",)]["code"] == "over_max_charts" and plan["histogram", ("x",)]["score"] == pytest.approx(0.5)
    far = table.withColumn("x", F.when(F.col("k") == 5, 1e6).otherwise(F.col("x"))).select("k", "x", "y")
    plan = plan_of(far, identifier="k", budget=advisor.Budget(pair_charts=0))
    box = plan["box_plot", ("x",)]
    assert (box["code"], box["requires_review"], box["score"]) == ("flagged_outlier_candidates", True, pytest.approx(0.6))
    assert plan["correlation_heatmap", ("x", "y")]["code"] == "too_few_numeric_columns" and plan["missing_values", ()]["code"] == "no_missing_values"
    assert not any(c == "scatter" for c, _ in plan)
    wide = spark.range(60).select(F.col("id").alias("k"), *[(F.col("id") % (i + 2) * 1.0).alias(f"v{i:02d}") for i in range(20)])
    plan = plan_of(wide, identifier="k", budget=advisor.Budget(charts=100))
    [heat] = [cols for c, cols in plan if c == "correlation_heatmap"]
    assert heat == tuple(f"v{i:02d}" for i in range(19, 4, -1))  # most distinct values first
    assert sum(c == "scatter" for c, _ in plan) == 3


def test_empty_tables_clashing_names_and_refusals(spark, table):
    plan = plan_of(table.limit(0), identifier="k")
    assert all(r["rank"] is None for r in plan.values()) and plan["histogram", ("x",)]["code"] == "too_few_observations"
    odd = spark.range(30).select(F.col("id").alias("k"), (F.col("id") % 9 * 1.0).alias("a.b"), (F.col("id") % 4 * 1.0).alias("rank"), F.lit(None).cast("double").alias("chart"))
    plan = plan_of(odd, identifier="k", budget=advisor.Budget(least_heatmap=2))
    assert plan["correlation_heatmap", ("a.b", "rank")]["rank"] and plan["missing_values", ("chart",)]["rank"] == 1
    with pytest.raises(core.SchemaError):
        advisor.recommend(table, "k", "absent")
    for bad in ({"charts": 0}, {"least_heatmap": 1}, {"least_heatmap": 9, "most_heatmap": 8}):
        with pytest.raises(core.ConfigurationError):
            advisor.Budget(**bad)
    with pytest.raises(core.ConfigurationError):
        advisor.Weights(missing_penalty=-1.0)


def test_data_of_every_chart_of_a_plan(table):
    seen = set()
    for goal, task in (("goal", "regression"), ("three", "classification")):
        for (chart, columns), row in plan_of(table, goal, "k", budget=advisor.Budget(charts=50)).items():
            if row["rank"] and (chart, task) not in seen:
                seen.add((chart, task))
                assert not advisor.data_of(table, "k", chart, list(columns), task).isEmpty(), (chart, columns)
    assert {c for c, _ in seen} == set(advisor.BASE) - {"box_plot"}
    data = advisor.data_of(table, "k", "grouped_box", ["many", "y"], budget=advisor.Budget(categories=5)).collect()
    assert {r["group"] for r in data} == {"c0", "c1", "c2", "c3", "c4"}  # the five of 14 rows, by value
    tall = advisor.data_of(table, "k", "histogram", ["y"]).collect()
    assert sum(r["count"] for r in tall) == 200


def test_requests_that_columns_cannot_carry(table):
    for chart, columns in (
        ("histogram", ["many"]), ("box_plot", ["days"]), ("bar", ["x"]), ("scatter", ["x", "x"]), ("scatter", ["x", "many"]), ("scatter", ["x"]),
        ("correlation_heatmap", ["x"]), ("correlation_heatmap", ["x", "many"]), ("missing_values", ["x"]), ("grouped_box", ["many", "three"]), ("pie", ["x"]),
    ):
        with pytest.raises(advisor.ChartRequestError):
            advisor.data_of(table, "k", chart, columns)
    with pytest.raises(core.SchemaError):
        advisor.data_of(table, "k", "bar", ["absent"])


def test_cautions(table):
    from assayer.operators import profile

    said = {(r["column"], r["code"]) for r in advisor.cautions(profile.profile(table, "k"), ["same", "gap", "k", "many"], advisor.Budget(categories=10)).collect()}
    assert said >= {("same", "constant_column"), ("gap", "missing_values_excluded"), ("k", "possible_id_like"), ("many", "categories_truncated")}


def test_only_classes_are_imbalanced(spark, table):
    from assayer.operators import quality

    rare = table.select("k", F.when(F.col("k") < 5, "a").otherwise("b").alias("label"), F.when(F.col("k") < 5, float("nan")).otherwise(F.col("k") % 2 * 1.0).alias("code"), "goal")
    said = {c: quality.imbalance(rare, c).first() for c in ("label", "code", "goal")}
    assert [said[c]["imbalanced"] for c in ("label", "code", "goal")] == [True, False, False]
    assert said["label"]["minority"] == 0.025 and said["code"]["classes"] == 2
