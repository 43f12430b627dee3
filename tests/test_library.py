"""Operators on small tables with known answers."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from assayer import cli, core, sources, streaming
from assayer.functions import stats
from assayer.operators import datetimes, evaluate, frequency, prepare, profile, quality, target
from assayer.plans import audit, models
from assayer.plans.session import Session, SessionOrderError


def numbers(spark, values):
    return spark.createDataFrame([(i, float(v) if v is not None else None) for i, v in enumerate(values)], "k long, x double")


def test_textbook_sample(spark):
    row = numbers(spark, [2, 4, 4, 4, 5, 5, 7, 9, None]).agg(*stats.describe(F.col("x")), stats.variance(F.col("x"), 0).alias("v0")).first()
    assert (row["mean"], row["v0"], row["count"], row["omitted"], row["median"]) == (5, 4, 8, 1, 4.5)


@pytest.mark.parametrize(("values", "expected"), [([1, 1, 2, 2, 3], [1, 2]), ([1, 2, 3], []), ([7, 7, 7], [7])])
def test_modes(spark, values, expected):
    assert sorted(r["value"] for r in stats.modes(numbers(spark, values), "x").collect()) == expected


def test_undefined_statistics_are_null(spark):
    one = numbers(spark, [3, 3]).agg(stats.skewness(F.col("x")), stats.kurtosis(F.col("x")), stats.pearson(F.col("x"), F.col("k")), stats.geometric_mean(-F.col("x"))).first()
    assert list(one) == [None] * 4


@pytest.mark.parametrize("direct", [10, 50, 10_000])
def test_quantiles_narrow_to_the_exact_value(spark, direct):
    draw = random.Random(1)
    values = [draw.choice([draw.random(), 0.5, round(draw.random(), 1)]) for _ in range(1500)]
    df = numbers(spark, values)
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    expected = list(df.agg(F.percentile("x", qs)).first()[0])
    assert stats.exact_quantiles(df, "x", qs, direct) == pytest.approx(expected, abs=1e-12)


def test_kendall_against_all_pairs(spark):
    draw = random.Random(2)
    rows = [(draw.randint(0, 20), draw.randint(0, 30)) for _ in range(150)]
    sign = lambda v: (v > 0) - (v < 0)
    s = nx = ny = 0
    for i, (a, b) in enumerate(rows):
        for c, d in rows[:i]:
            s += sign(a - c) * sign(b - d)
            nx += a != c
            ny += b != d
    df = spark.createDataFrame(rows, "x long, y long")
    assert stats.kendall(df, "x", "y").first()[0] == pytest.approx(s / (nx * ny) ** 0.5)
    assert stats.kendall(df.where("x < 0"), "x", "y").first()[0] is None
    assert stats.kendall(df.withColumn("y", F.lit(1)), "x", "y").first()[0] is None


def test_partitions_do_not_change_results(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("w"), F.sin("id").alias("x"))
    seen = {str(profile.profile(df.repartition(n), "k").orderBy("column").select("column", "unique", "dominant", "missing").collect()) for n in (1, 3, 17)}
    assert len(seen) == 1
    assert len({str(audit.fingerprint(df.repartition(n)).first()) for n in (1, 3, 17)}) == 1


def planted(spark):
    rows = []
    for i in range(200):
        churn = int(i % 10 == 0)
        rows.append(
            (i, f"CUST-{i:05d}", 900 if i == 5 else 950 if i == 105 else 20 + i % 41, None if i % 4 == 0 else 50_000.0 + i * 37 % 9000, "SA",
             "pro" if i == 199 else "basic", f"city_{i % 61}", ["10", "20", "30", "40", "unknown"][i % 5], ["02134", "90210", "01002", "10001"][i % 4],
             float("inf") if i == 7 else 1.0 + i % 13 * 0.01, 15 + i * 0.137, "price" if churn else "none", churn, churn)
        )
    names = "k long, customer_id string, age long, income double, country string, plan string, city string, income_text string, zip string, ratio double, temperature double, churn_reason string, churn_flag long, Churn long"
    return spark.createDataFrame(rows, names)


def test_planted_problems_are_found_and_nothing_else(spark):
    findings = quality.inspect(planted(spark), "k", "Churn")
    seen = {(r["code"], r["column"]) for r in findings.collect()}
    assert {
        ("missing_values", "income"), ("possible_outliers", "age"), ("constant_column", "country"), ("near_constant_column", "plan"),
        ("high_cardinality", "city"), ("high_cardinality", "customer_id"), ("possible_id_like", "customer_id"), ("possible_numeric_stored_as_text", "income_text"),
        ("infinite_values", "ratio"), ("possible_target_leakage", "churn_reason"), ("target_leakage_exact_duplicate", "churn_flag"), ("class_imbalance", "Churn"),
    } <= seen
    assert not {("possible_id_like", "temperature"), ("possible_numeric_stored_as_text", "zip"), ("possible_id_like", "city")} & seen
    assert quality.verdict(findings) == "BLOCKED"
    assert [quality.exit_code(v, "review") for v in quality.VERDICTS] == [0, 0, 2, 3]


def test_duplicate_rows_count_missing_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, float("nan")), (2, None), (3, 1.0)], "a long, b double")
    assert profile.duplicate_rows(df).first()[0] == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "k long, x double, w string")
    rows = profile.profile(df, "k").collect()
    assert {r["count"] for r in rows} == {0}
    assert quality.verdict(quality.inspect(df, "k")) == "READY"


def test_nested_and_clashing_columns_are_refused(spark):
    with pytest.raises(core.SchemaError):
        core.kinds(spark.sql("SELECT array(1) AS a"))
    with pytest.raises(core.SchemaError):
        core.kinds(spark.sql("SELECT 1 AS a, 2 AS A"))


def test_cadence_and_gaps(spark):
    start = datetime(2024, 1, 1)
    hours = [0, 1, 2, 5, 6, 9, 30]
    df = spark.createDataFrame([(start + timedelta(hours=h),) for h in hours] + [(start + timedelta(minutes=30),), (None,)], "t timestamp")
    row = datetimes.summarize(df, "t", "PT1H").first()
    assert (row["off_grid"], row["missing_points"], row["gap_runs"], row["trailing_missing"], row["missing"]) == (1, 24, 3, 0, 1)
    assert datetimes.format_duration(datetimes.parse_cadence("P1DT2H3M4.5S")) == "P1DT2H3M4.5S"
    with pytest.raises(core.ConfigurationError):
        datetimes.parse_cadence("P1M")


@pytest.mark.parametrize(
    ("text", "kind"),
    [("2024-01-31", "date"), ("2024-01-31T13:45:00", "naive"), ("2024-01-31T13:45:00Z", "utc_z"), ("2024-01-31T13:45:00-05:30", "explicit_offset"),
     ("2024-02-29", "date"), ("2023-02-29", None), ("2024-1-3", None), ("0000-01-01", None), ("2024-01-01T24:00:00", None), (" 2024-01-01", None)],
)
def test_strict_iso(spark, text, kind):
    assert spark.createDataFrame([(text,)], "s string").select(datetimes.iso_kind(F.col("s"))).first()[0] == kind


def test_task_detection(spark):
    df = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 2).alias("b"), F.sin("id").alias("r"), F.col("id").cast("string").alias("t"), (F.col("id") % 15).alias("c"))
    assert target.detect(df, "b").positive == "1"
    assert target.detect(df, "r").task == "regression"
    assert target.detect(df, "c").classes == 15
    with pytest.raises(core.AmbiguousTaskError):
        target.detect(df, "t")


def test_preparation_learns_from_training_rows_only(spark):
    train = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "a"), (10.0, None), (None, "a")], "x double, w string")
    fitted = prepare.fit(train, [prepare.Step("x", "numeric", scale="standard"), prepare.Step("w", "categorical", impute="most_frequent", encode="onehot")])
    test = spark.createDataFrame([(None, "new"), (2.5, None)], "x double, w string")
    rows = [tuple(round(v, 6) for v in r) for r in fitted.transform(test).collect()]
    assert rows[0][0] == rows[1][0]  # the median of the training rows, 2.5
    assert rows[0][1:] == (0, 0)
    assert rows[1][1:] == (1, 0)
    with pytest.raises(core.NonFiniteValueError):
        prepare.fit(spark.createDataFrame([(float("inf"),)], "x double"), [prepare.Step("x", "numeric")])


def test_training_beats_the_baseline(spark):
    draw = random.Random(4)
    rows = [(i, x := draw.gauss(0, 1), draw.choice("pq"), "yes" if x + draw.gauss(0, 0.3) > 0 else "no") for i in range(400)]
    df = spark.createDataFrame(rows, "k long, x double, w string, y string")
    board = models.compare(trained := models.train(df, "k", "y", ["logistic_regression", "dummy_classifier"]), spark).collect()
    assert {r["rank"]: r["model"] for r in board}[1] == "logistic_regression"
    assert {r["prediction"] for r in models.predict(trained[0], df, "k").collect()} == {"yes", "no"}
    with pytest.raises(core.IncompatibleModelError):
        models.resolve("ridge", "classification")


def test_split_is_stable(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    a = evaluate.split_rows(df, "k")
    share = a.where("split = 'evaluation'").count() / 2000
    assert 0.17 < share < 0.23
    b = evaluate.split_rows(df.repartition(13), "k")
    assert a.exceptAll(b).count() == 0


def test_frequency_ties_and_other(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate("bbaacOther".split() * 1 + list("bbaac"))], "k long, v string")
    top = {r["label"]: r["count"] for r in frequency.top_k_other(df, "v", 2).collect()}
    assert set(top) == {"a", "b", "Other"}


def test_audit_document_round_trip(spark, tmp_path):
    document = audit.audit(planted(spark), "k", "Churn")
    assert document["verdict"] == "BLOCKED"
    place = audit.publish(spark, document, str(tmp_path))
    assert audit.differences(audit.read(spark, place), document) == []
    with pytest.raises(core.PublicationError):
        audit.canonical({"a": float("inf")})


# ---- sources ----


def test_csv_types_and_refusals(spark, tmp_path):
    (tmp_path / "p.csv").write_text('age;city;score;flag;long\n1;"a;b";1.5;true;12345678901234567890\n2;NA;;false;1\n')
    loaded = sources.load_table(spark, str(tmp_path / "p.csv"))
    assert loaded.notes["delimiter"] == ";"
    assert [t for _, t in loaded.df.dtypes] == ["bigint", "string", "double", "boolean", "decimal(38,0)"]
    assert [tuple(r) for r in loaded.df.select("age", "city").collect()] == [(1, "a;b"), (2, None)]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(core.IngestionError):
        sources.load_table(spark, str(tmp_path / "bad.csv"), sources.Options(delimiter=","))
    with pytest.raises(core.LimitExceededError):
        sources.load_table(spark, str(tmp_path / "p.csv"), limits=sources.Limits(max_rows=1))


def test_other_sources(spark, tmp_path):
    import sqlite3

    import pyarrow as pa

    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n{"a": 2}\n')
    assert sources.load_table(spark, str(tmp_path / "a.jsonl")).df.count() == 2
    (tmp_path / "n.json").write_text('[{"a": {"b": 1}}]')
    with pytest.raises(core.SchemaError):
        sources.load_table(spark, str(tmp_path / "n.json"))
    data = pa.table({"x": [1, 2, 3]})
    with pa.ipc.new_file(str(tmp_path / "t.arrow"), data.schema) as f:
        f.write_table(data)
    assert sources.load_table(spark, str(tmp_path / "t.arrow")).df.agg(F.sum("x")).first()[0] == 6
    with sqlite3.connect(tmp_path / "d.sqlite") as base:
        base.execute("CREATE TABLE t (n INTEGER, label TEXT, amount REAL)")
        base.execute("INSERT INTO t VALUES (1, 'a', 1.5), (NULL, NULL, NULL)")
    assert sources.load_table(spark, str(tmp_path / "d.sqlite")).df.count() == 2
    records = sources.load_table(spark, iter([{"a": 1}, {"b": "x", "a": 2}]))
    assert records.df.columns == ["a", "b"]
    assert records.notes["incomplete"] == 1
    with pytest.raises(core.IngestionError):
        sources.load_table(spark, b"bytes")


def test_streamed_profile(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, h), float(h)) for h in range(3)]
    spark.createDataFrame(rows, "t timestamp, x double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, x double").parquet(str(tmp_path / "in"))
    query = streaming.windowed_profile(stream, "t", ["x"]).writeStream.format("memory").outputMode("complete").queryName("profiled").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("profiled").count() == 3


# ---- neighbours, session and command line ----


def test_session_order_and_final_evaluation(spark):
    draw = random.Random(11)
    rows = [(i, x := draw.gauss(0, 1), draw.gauss(0, 1), int(x > 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, x double, z double, y long")
    session = Session(spark).load(df, "k", "y")
    with pytest.raises(SessionOrderError):
        session.select("knn")
    board = session.compare_models(["knn_classifier", "dummy_classifier"])
    assert board.where("rank = 1").first()["model"] == "knn_classifier"
    session.select("knn_classifier")
    fresh = spark.createDataFrame([(1000 + i, x := draw.gauss(0, 1), 0.0, int(x > 0)) for i in range(60)], df.schema)
    assert session.evaluate_final(fresh)["accuracy"] > 0.8
    with pytest.raises(SessionOrderError):
        session.evaluate_final(fresh)


def test_command_line(spark, tmp_path, capsys):
    planted(spark).write.parquet(str(tmp_path / "t.parquet"))
    assert cli.main(["audit", str(tmp_path / "t.parquet"), "--key", "k", "--target", "Churn", "--out", str(tmp_path / "out")], spark) == 3
    assert "BLOCKED" in capsys.readouterr().out
    assert cli.main(["audit", str(tmp_path / "t.xlsx"), "--key", "k"], spark) == 1


def test_statistics_of_extreme_values(spark):
    x = F.col("x")
    row = numbers(spark, [1e308, -1e308] * 20).agg(
        stats.std(x).alias("std"), stats.variance(x).alias("variance"), stats.rms(x).alias("rms"), stats.kurtosis(x, True).alias("kurtosis"),
        stats.skewness(x, True).alias("skewness"), stats.sum_of_squares(x).alias("squares"), stats.covariance(x, x).alias("covariance"), *stats.describe(x)[11:12],
    ).first()
    assert row["std"] == pytest.approx(1e308 * (40 / 39) ** 0.5) and row["rms"] == pytest.approx(1e308)
    assert row["kurtosis"] == pytest.approx(-2) and row["skewness"] == pytest.approx(0, abs=1e-9)
    assert (row["variance"], row["squares"], row["covariance"], row["iqr"]) == (None,) * 4


def test_quantiles_of_columns_share_their_passes(spark):
    draw = random.Random(5)
    df = spark.createDataFrame([(draw.random(), draw.choice([1.0, 2.0, None]), None) for _ in range(900)], "a double, b double, c double")
    found = stats.quantiles_of(df, {c: F.col(c) for c in "abc"}, [0.25, 0.5], direct=20)
    for c in "ab":
        assert found[c] == pytest.approx(list(df.agg(F.percentile(c, [0.25, 0.5])).first()[0]), abs=1e-12)
    assert found["c"] == [None, None]


def test_frequency_table_counts_up_in_order(spark):
    from assayer.operators import frequency

    rows = frequency.frequency_table(spark.createDataFrame([(v,) for v in "abbcccd"] + [(None,)], "v string"), "v", "include").orderBy("cumulative").collect()
    assert [(r["value"], r["cumulative"]) for r in rows] == [(None, 1), ("a", 2), ("b", 4), ("c", 7), ("d", 8)]
    assert frequency.frequency_table(spark.createDataFrame([], "v string"), "v").count() == 0


def test_nearest_labels_in_blocks_on_both_sides(spark, monkeypatch):
    from assayer.operators import neighbours

    monkeypatch.setattr(neighbours, "BLOCK", 7)
    draw = random.Random(6)
    rows = [([float(draw.randint(0, 3)), float(draw.randint(0, 3))], float(draw.randint(0, 2))) for _ in range(40)]
    asked = [(i, [draw.random() * 3, draw.random() * 3]) for i in range(20)]
    got = neighbours.nearest_labels(spark.createDataFrame(rows, "v array<double>, label double"), spark.createDataFrame(asked, "q long, v array<double>"), 5)
    found = {q: [] for q, _ in asked}
    for r in got.collect():
        found[r["q"]].append((r["distance"], r["label"]))
    for q, v in asked:
        expected = sorted((((a[0] - v[0]) ** 2 + (a[1] - v[1]) ** 2) ** 0.5, label) for a, label in rows)[:5]
        assert [m[0] for m in sorted(found[q])] == pytest.approx([e[0] for e in expected])
        assert [m[1] for m in sorted(found[q])] == [e[1] for e in expected]


def test_checks_of_ones_own_join_the_findings(spark):
    from assayer import core
    from assayer.operators import quality

    df = spark.createDataFrame([(i, float(i % 7)) for i in range(50)], "k long, x double")
    mine = lambda t, key: t.agg(F.lit("mine").alias("code"), F.lit("ERROR").alias("severity"), F.lit("x").alias("column"), F.max("x").alias("value"), F.lit(False).alias("requires_review"))
    found = quality.inspect(df, "k", checks=[mine])
    assert found.where("code = 'mine'").first()["value"] == 6 and quality.verdict(found) == "BLOCKED"
    with pytest.raises(core.ConfigurationError):
        quality.inspect(df, "k", checks=[lambda t, key: t.select("x")])


def test_ridge_equals_its_closed_form(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from assayer.plans import models

    draw = np.random.default_rng(1)
    x = draw.normal(size=(60, 2)) * [1, 5]
    y = x @ [2, -1] + draw.normal(size=60) * 3 + 4
    df = spark.createDataFrame([(Vectors.dense(a.tolist()), float(b)) for a, b in zip(x, y, strict=True)], ["features", "label"])
    fitted = models.resolve("ridge").make(models.Facts(60, 0, float(y.std()))).fit(df)
    c = x - x.mean(0)
    assert list(fitted.coefficients) == pytest.approx(list(np.linalg.solve(c.T @ c + np.eye(2), c.T @ (y - y.mean()))), rel=1e-6)


def test_boosting_of_three_classes(spark):
    from assayer.plans import models

    df = spark.createDataFrame([(i, float(i % 30), "abc"[i % 30 // 10]) for i in range(240)], "k long, x double, y string")
    trained = models.train(df, "k", "y", ["gradient_boosting_classifier", "dummy_classifier"], "classification")
    assert trained[0].metrics["accuracy"] > 0.95 > trained[1].metrics["accuracy"]
    assert {r["prediction"] for r in models.predict(trained[0], df, "k").collect()} == {"a", "b", "c"}


@pytest.mark.parametrize("name", ["kmeans", "minibatch_kmeans"])
def test_k_means_finds_separate_groups(spark, name, monkeypatch):
    from assayer.plans import models

    df = spark.createDataFrame([(i, 100.0 * (i % 3) + i / 1000, -50.0 * (i % 3)) for i in range(300)], "k long, x double, y double")
    if name == "minibatch_kmeans":
        monkeypatch.setattr(models.MiniBatchKMeans.__init__, "__defaults__", (8, 60, 10))
    said = {r["k"]: r["cluster"] for r in models.cluster(df, "k", name, 3).collect()}
    assert len({(k % 3, c) for k, c in said.items()}) == 3 and len(set(said.values())) == 3


def test_an_audit_holds_no_value_of_the_table(spark):
    from assayer.plans import audit

    document = audit.audit(spark.createDataFrame([(i, "ann@example.org") for i in range(20)], "k long, who string"), "k")
    assert "ann@example.org" not in audit.canonical_json(document)
