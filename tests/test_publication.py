"""Published runs: one point of commit, verification, lineage."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from assayer import core
from assayer.plans import publication

SF = "/root/testdata/sf0.001"


@pytest.fixture
def customers(spark):
    return spark.read.parquet(f"{SF}/customer.parquet")


def test_a_run_is_read_back_with_its_lineage(spark, tmp_path, customers):
    folder = str(tmp_path / "out")
    with pytest.raises(publication.NoRunError):
        publication.read_current(spark, folder)
    train = customers.where("c_custkey % 5 != 0")
    awkward = customers.limit(3).select("c_custkey", F.lit(None).cast("double").alias("x"), F.array("c_nationkey").alias("l"), F.lit(float("nan")).alias("y"))
    run = publication.publish(spark, folder, {"train": train, "awkward": awkward}, {"model": {"k": 3}}, fit={"model": "train"})
    got = publication.read_current(spark, folder)
    assert (got.run_id, got.generation) == (run.run_id, 1)
    assert got.table(spark, "train").count() == train.count()
    assert got.document(spark, "model") == {"k": 3}
    seen = got.manifest["outputs"]
    assert seen["train"]["content"]["rows"] == train.count()
    assert seen["train"]["inputs"]["files"] == 1
    assert seen["train"]["inputs"]["folders"][0].endswith("sf0.001")
    assert seen["model"]["fitted_on"] == {"output": "train", "rows": train.count()}
    assert got.manifest["environment"]["spark"] == spark.version
    assert {"python", "pyspark", "pyarrow"} <= set(got.manifest["environment"])
    with pytest.raises(core.PublicationError):
        got.table(spark, "model")


def test_the_second_of_two_writers_loses(spark, tmp_path, customers):
    folder = str(tmp_path)
    first = publication.publish(spark, folder, {"t": customers})
    winner = publication.publish(spark, folder, documents={"d": 1}, expected=first.generation)
    with pytest.raises(publication.ConflictError):
        publication.publish(spark, folder, documents={"d": 2}, expected=first.generation)
    assert publication.read_current(spark, folder).run_id == winner.run_id
    files = publication.Files(spark, folder)
    files.write(f"{folder}/drafts/x.json", "{}")
    assert not files.claim(f"{folder}/drafts/x.json", f"{folder}/commits/{2:012d}.json")
    assert publication.read_current(spark, folder).run_id == winner.run_id
    third = publication.publish(spark, folder, documents={"d": 3})
    assert publication.read_current(spark, folder).generation == third.generation == 3
    assert (Path(folder) / "runs" / first.run_id).exists()


def test_a_failed_write_leaves_the_run_before_current(spark, tmp_path, customers):
    folder = str(tmp_path)
    first = publication.publish(spark, folder, {"t": customers})
    with pytest.raises(Exception, match="boom"):
        publication.publish(spark, folder, {"t": customers.select(F.raise_error(F.lit("boom")).cast("long").alias("x"))})
    assert publication.read_current(spark, folder).run_id == first.run_id


@pytest.mark.parametrize("name", ["", "a/b", "..", "manifest", "x.y"])
def test_names_are_plain(spark, tmp_path, name):
    with pytest.raises(core.PublicationError):
        publication.publish(spark, str(tmp_path), documents={name: 1})
    with pytest.raises(core.PublicationError):
        publication.publish(spark, str(tmp_path))


def test_altered_runs_are_refused(spark, tmp_path, customers):
    def fresh(name):
        run = publication.publish(spark, str(tmp_path / name), {"t": customers.limit(5)}, {"d": {"a": 1}})
        return str(tmp_path / name), Path(run.place)

    def refused(folder, match):
        with pytest.raises(core.PublicationError, match=match):
            publication.read_current(spark, folder)

    folder, place = fresh("document")
    (place / ".d.json.crc").unlink(missing_ok=True)
    (place / "d.json").write_text('{"a": 2}')
    refused(folder, "altered")
    folder, place = fresh("extra")
    (place / "more.json").write_text("{}")
    refused(folder, "not listed")
    folder, place = fresh("missing")
    (place / "d.json").unlink()
    refused(folder, "missing")
    folder, place = fresh("table")
    spark.read.parquet(f"{SF}/customer.parquet").limit(6).write.mode("overwrite").parquet(str(place / "t"))
    refused(folder, "altered")
    folder, place = fresh("manifest")
    (place / ".manifest.json.crc").unlink(missing_ok=True)
    (place / "manifest.json").write_text((place / "manifest.json").read_text() + " ")
    refused(folder, "pointer")
    folder, place = fresh("pointer")
    commit = next((Path(folder) / "commits").glob("0*.json"))
    for text in ("no json", "[]", json.dumps({"generation": 1, "run_id": "../x"})):
        (commit.parent / f".{commit.name}.crc").unlink(missing_ok=True)
        commit.write_text(text)
        refused(folder, "pointer")


def test_leftovers_are_ignored(spark, tmp_path, customers):
    folder = str(tmp_path)
    run = publication.publish(spark, folder, {"t": customers})
    (tmp_path / "commits" / "draft.tmp").write_text("half")
    (tmp_path / "runs" / "0123").mkdir()
    assert publication.read_current(spark, folder).run_id == run.run_id
