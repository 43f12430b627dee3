"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.graph import shared_folder

ROWS_AT_ONCE = 1_000  # texts and results that a Python worker holds at once,
BYTES_AT_ONCE = 4 << 20  # and bytes of these texts; a longer text is held alone

STATE: dict[str, Any] = {}


def worker_state(owner: str) -> dict[str, Any]:
    """What this Python worker remembers for one operator between tasks.

    Workers outlive tasks and stages; the memory of another operator is dropped first.
    """
    if STATE.get("owner") != owner:
        STATE.clear()
        STATE["owner"] = owner
        gc.collect()
        pa.default_memory_pool().release_unused()
    return STATE


def bounded(batches: Iterator[pa.RecordBatch], *texts: int, most: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches cut to ``ROWS_AT_ONCE`` rows and ``most`` bytes of the text columns."""
    for batch in batches:
        size = sum(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in texts)
        total, at = np.cumsum(size), 0
        while at < batch.num_rows:
            room = int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right"))
            end = min(max(room, at + 1), at + ROWS_AT_ONCE, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def map_rows(
    df: DataFrame,
    keep: list[str],
    text: str,
    setup: Callable[[], Callable[[list[str]], dict[str, pa.Array]]],
    schema: str,
) -> DataFrame:
    """Apply a batch function to one text column, row by row and without a shuffle.

    ``keep`` are passed through untouched, so ids stay exact whatever their type
    and nulls included. ``setup`` runs once a task and returns a function from
    the texts of a batch (null read as empty) to the arrays of ``schema``.
    """
    plain = df.schema[text].dataType.simpleString() == "string"
    at = keep.index(text) if plain and text in keep else len(keep)  # a kept text travels once
    own = [F.col(f"`{text}`").cast("string").alias("__text")] if at == len(keep) else []
    source = df.select(*[F.col(f"`{c}`") for c in keep], *own)
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(setup.__module__)
        work = setup()
        for batch in bounded(batches, at):
            made = work([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *made.values()], names=[*keep, *made])

    return source.mapInArrow(run, f"{kept}, {schema}" if kept else schema)


def sha(column: Column) -> Column:
    """Lower-case hexadecimal SHA-256."""
    return F.sha2(column, 256)


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of each span in order, joined by commas."""
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    )


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
)
SPANS_SQL = "spans array<struct<kind:string,start:int,end:int,score:double>>"


def spans_array(rows: list[list[tuple[str, int, int, float | None]]]) -> pa.Array:
    return pa.array(
        [[{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in row] for row in rows], type=SPANS
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def total_bytes(df: DataFrame, text: str) -> int:
    """Bytes of a text column, by one aggregation."""
    row: Any = df.select(F.sum(F.octet_length(F.col(f"`{text}`"))).alias("n")).first()
    return int(row["n"] or 0)


class Scratch:
    """Tables between the steps of one operator, in the folder that the cluster shares.

    Unlike a checkpoint a table is columnar and compressed, and goes as soon as it is dropped.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, table: int | None = None) -> None:
        """Delete one table by its number, or all."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder if table is None else f"{self.folder}/{table}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
