"""Runs of several outputs, made current at one point, with what each was computed from.

A run is a folder of tables and documents under ``runs/`` with a manifest. Digests and row
counts of the tables are observed while they are written, so they cost no further job. The
folder ``commits/`` has one small file a generation; a run becomes current when its
file is renamed into place, which fails where another writer's file of that generation is there
already. Readers take the highest generation, so they see a whole run or the one before it.
"""

from __future__ import annotations

import hashlib
import json
import platform
import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from importlib import metadata
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer import core
from assayer.operators.profile import quoted
from assayer.plans.audit import canonical_json

SCHEMA = "1"
NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]{0,99}")
PACKAGES = ("pyspark", "pyarrow", "pandas", "numpy")
MOST_INPUTS = 1_000  # folders that a lineage names; the number of files is always whole


class ConflictError(core.PublicationError):
    """Another run became current first."""


class NoRunError(core.PublicationError):
    """Nothing has been published yet."""


@dataclass(frozen=True)
class Run:
    run_id: str
    generation: int
    place: str
    manifest: dict[str, Any]

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        if self.manifest["outputs"].get(name, {}).get("kind") != "table":
            raise core.PublicationError(f"the run has no table {name}")
        return spark.read.parquet(f"{self.place}/{name}")

    def document(self, spark: SparkSession, name: str) -> Any:
        if self.manifest["outputs"].get(name, {}).get("kind") != "document":
            raise core.PublicationError(f"the run has no document {name}")
        return json.loads(Files(spark, self.place).read(f"{self.place}/{name}.json"))


class Files:
    """Small files of any file system that Spark reads, by the session's Hadoop configuration."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        self.gateway = spark.sparkContext._gateway

    def write(self, path: str, text: str) -> None:
        out = self.fs.create(self.path(path), False)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, path: str) -> str:
        place = self.path(path)
        size = self.fs.getFileStatus(place).getLen()
        stream = self.fs.open(place)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)).decode()
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        place = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(place)) if self.fs.exists(place) else []

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def claim(self, source: str, goal: str) -> bool:
        """Rename unless the goal is there; whether this writer did it."""
        none = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self.context.rename(self.path(source), self.path(goal), none)
        except Exception as e:  # the gateway's error holds the Java one
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def drop(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


def text_of(name: str, kind: T.DataType) -> Column:
    """A column as text, the same before it is written and after it is read; nested values by their hash."""
    nested = isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.BinaryType))
    c = quoted(name)
    return F.coalesce((F.xxhash64(c) if nested else c).cast("string"), F.lit("\x00null"))


def content(df: DataFrame) -> list[Column]:
    """Aggregates that no order or partitioning changes: rows, and sum and xor of row hashes."""
    row = F.xxhash64(*[text_of(f.name, f.dataType) for f in df.schema.fields]) if df.columns else F.lit(0)
    return [F.count(F.lit(1)).alias("rows"), F.bit_xor(row).alias("xor"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("sum")]


def inputs_of(df: DataFrame) -> dict[str, Any]:
    """What a table is read from, by its plan: folders and the number of files, and whether anything else goes in."""
    files = df.inputFiles()
    folders = sorted({f.rpartition("/")[0] for f in files})
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    kinds = sorted({leaves.apply(i).nodeName() for i in range(leaves.size())})
    return {"files": len(files), "folders": folders[:MOST_INPUTS], "more_folders": max(0, len(folders) - MOST_INPUTS), "leaves": kinds}


def environment() -> dict[str, str]:
    """Versions that a result may depend on."""
    out = {"python": platform.python_version()}
    for package in PACKAGES:
        try:
            out[package] = metadata.version(package)
        except metadata.PackageNotFoundError:
            out[package] = "absent"
    return out


def current_generation(files: Files, folder: str) -> int:
    found = [int(n[:-5]) for n in files.names(f"{folder}/commits") if re.fullmatch(r"\d{12}\.json", n)]
    return max(found, default=0)


def publish(
    spark: SparkSession,
    folder: str,
    tables: Mapping[str, DataFrame] | None = None,
    documents: Mapping[str, Any] | None = None,
    fit: Mapping[str, str] | None = None,
    expected: int | None = None,
) -> Run:
    """Write a run and make it current; ``fit`` names, for an output, the output that it was fitted on.

    ``expected`` is the generation that the caller has seen as current (0: none); by default the one that is current at
    the start. A writer that comes second gets a ``ConflictError``, its run stays unpublished and the other one
    current. Names are plain; a run needs an output.
    """
    tables, documents, fit = dict(tables or {}), dict(documents or {}), dict(fit or {})
    names = [*tables, *documents]
    if not names or len(set(names)) < len(names):
        raise core.PublicationError("a run has at least one output, each of its own name")
    for name in names:
        if not NAME.fullmatch(name) or name == "manifest":
            raise core.PublicationError(f"{name!r} is no name of an output")
    if unknown := {*fit, *fit.values()} - {*names}:
        raise core.PublicationError(f"fit names no output {sorted(unknown)}")
    folder = folder.rstrip("/")
    files = Files(spark, folder)
    seen = current_generation(files, folder) if expected is None else expected
    run_id = uuid.uuid4().hex
    place = f"{folder}/runs/{run_id}"
    outputs: dict[str, Any] = {}
    for name, df in tables.items():
        observed = Observation()
        df.observe(observed, *content(df)).write.mode("error").parquet(f"{place}/{name}")
        facts = observed.get
        digest = {"rows": facts["rows"], "xor": facts["xor"], "sum": facts["sum"]}
        outputs[name] = {"kind": "table", "content": digest, "schema": df.schema.simpleString(), "inputs": inputs_of(df)}
    for name, value in documents.items():
        text = canonical_json(value)
        files.write(f"{place}/{name}.json", text)
        outputs[name] = {"kind": "document", "sha256": hashlib.sha256(text.encode()).hexdigest()}
    for name, source in fit.items():
        outputs[name]["fitted_on"] = {"output": source, "rows": outputs[source].get("content", {}).get("rows")}
    manifest = {"schema_version": SCHEMA, "run_id": run_id, "outputs": outputs, "environment": environment() | {"spark": spark.version}}
    text = canonical_json(manifest)
    files.write(f"{place}/manifest.json", text)
    pointer = canonical_json({"schema_version": SCHEMA, "generation": seen + 1, "run_id": run_id, "manifest_sha256": hashlib.sha256(text.encode()).hexdigest()})
    draft = f"{folder}/drafts/{run_id}.json"
    files.write(draft, pointer)
    files.fs.mkdirs(files.path(f"{folder}/commits"))
    if current_generation(files, folder) != seen or not files.claim(draft, f"{folder}/commits/{seen + 1:012d}.json"):
        files.drop(draft)
        raise ConflictError(f"generation {seen + 1} is taken: another run became current first")
    return Run(run_id, seen + 1, place, manifest)


def read_current(spark: SparkSession, folder: str, verify: bool = True) -> Run:
    """The current run. Its manifest must be the one that the pointer names; with ``verify`` every output must be as it was written."""
    folder = folder.rstrip("/")
    files = Files(spark, folder)
    generation = current_generation(files, folder)
    if not generation:
        raise NoRunError(f"{folder} holds no published run")
    pointer = _parsed(files.read(f"{folder}/commits/{generation:012d}.json"), "the pointer")
    run_id = pointer.get("run_id")
    if pointer.get("generation") != generation or not isinstance(run_id, str) or not re.fullmatch(r"[0-9a-f]{32}", run_id):
        raise core.PublicationError("the pointer names no run of its generation")
    place = f"{folder}/runs/{run_id}"
    if not files.exists(f"{place}/manifest.json"):
        raise core.PublicationError(f"run {run_id} has no manifest")
    text = files.read(f"{place}/manifest.json")
    if hashlib.sha256(text.encode()).hexdigest() != pointer.get("manifest_sha256"):
        raise core.PublicationError(f"the manifest of run {run_id} is not the one the pointer names")
    manifest = _parsed(text, "the manifest")
    if manifest.get("run_id") != run_id:
        raise core.PublicationError("the manifest is that of another run")
    run = Run(run_id, generation, place, manifest)
    if verify:
        verify_run(spark, run)
    return run


def verify_run(spark: SparkSession, run: Run) -> None:
    """Refuse a run whose outputs are missing, altered or more than its manifest lists. Tables are read once each."""
    files = Files(spark, run.place)
    outputs = run.manifest["outputs"]
    want = {"manifest.json", *(n if o["kind"] == "table" else f"{n}.json" for n, o in outputs.items())}
    have = {n for n in files.names(run.place) if not n.startswith(".")}
    if want != have:
        raise core.PublicationError(f"missing: {sorted(want - have)}, not listed: {sorted(have - want)}")
    for name, o in outputs.items():
        if o["kind"] == "document":
            if hashlib.sha256(files.read(f"{run.place}/{name}.json").encode()).hexdigest() != o["sha256"]:
                raise core.PublicationError(f"the document {name} was altered")
            continue
        df = spark.read.parquet(f"{run.place}/{name}")
        seen = df.agg(*content(df)).first().asDict()
        if seen != o["content"]:
            raise core.PublicationError(f"the table {name} was altered: {o['content']['rows']} rows were written, {seen['rows']} are there")


def _parsed(text: str, what: str) -> dict[str, Any]:
    try:
        value = json.loads(text)
    except json.JSONDecodeError:
        raise core.PublicationError(f"{what} is no JSON") from None
    if not isinstance(value, dict):
        raise core.PublicationError(f"{what} is no object")
    return value
