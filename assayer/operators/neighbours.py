"""Nearest neighbours and density clustering, in blocks of rows."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer import core
from assayer.operators.graph import components, stored

BLOCK = 20_000


def nearest_labels(train: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest training rows of each query: ``q``, ``distance``, ``label``.

    ``train`` has v (array of doubles) and label, ``queries`` q and v. Equal training
    rows are one with their number. Both sides are dealt to blocks by hash, and every
    block of rows meets every block of queries in a task of its own; the k best of
    each go on to the last ranking.
    """
    rows = train.select("v", F.col("label").cast("double").alias("label")).groupBy("v", "label").agg(F.count("*").alias("n"))
    here_blocks, there_blocks = (-(-max(1, side.count()) // BLOCK) for side in (train, queries))
    deal = lambda blocks, *by: F.pmod(F.xxhash64(*by), F.lit(blocks).cast("long"))
    each = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    here = rows.select("v", "label", F.least("n", F.lit(k)).alias("n"), deal(here_blocks, "v", "label").alias("block"), each(there_blocks).alias("other"))
    there = queries.select("q", "v", each(here_blocks).alias("block"), deal(there_blocks, "q").alias("other"))

    def solve(a: pa.Table, b: pa.Table) -> pa.Table:
        matrix = lambda t: np.array(t.column("v").to_pylist(), float).reshape(t.num_rows, -1)
        x, y, label, copies = matrix(a), matrix(b), a.column("label").to_numpy(), a.column("n").to_numpy()
        q = b.column("q").to_numpy()
        out: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64)]
        if len(x):
            order = np.argsort(label, kind="stable")  # equal distances go to the smaller label
            x, label, copies = x[order], label[order], copies[order]
            for at in range(0, len(y), 256):
                d = np.sqrt(((y[at : at + 256, None, :] - x[None]) ** 2).sum(2)) if x.size < 2_000_000 else np.array([np.sqrt(((x - r) ** 2).sum(1)) for r in y[at : at + 256]])
                best = np.argsort(d, axis=1, kind="stable")[:, :k]
                rows = np.repeat(np.arange(len(d)), best.shape[1])
                for i, part in enumerate((q[at + rows], d[rows, best.ravel()], label[best.ravel()], copies[best.ravel()])):
                    out[i] = np.concatenate((out[i], part))
        return pa.table({"q": pa.array(out[0], pa.int64()), "distance": out[1], "label": out[2], "n": pa.array(out[3], pa.int64())})

    met = here.groupBy("block", "other").cogroup(there.groupBy("block", "other")).applyInArrow(solve, "q long, distance double, label double, n long")
    found = met.select("q", "distance", "label", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")).drop("copy")
    place = F.row_number().over(Window.partitionBy("q").orderBy("distance", "label"))
    return found.withColumn("k", place).where(F.col("k") <= k).drop("k")


class Knn:
    """k nearest neighbours over ``features`` and ``label``: majority (ties to the smaller label) or mean."""

    def __init__(self, task: str, k: int = 5) -> None:
        self.task, self.k = task, k

    def fit(self, df: DataFrame) -> Knn:
        from pyspark.ml.functions import vector_to_array

        self.rows = df.select(vector_to_array("features").alias("v"), "label")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        numbered = stored(df.withColumn("__q", F.monotonically_increasing_id()))
        near = nearest_labels(self.rows, numbered.select(F.col("__q").alias("q"), vector_to_array("features").alias("v")), self.k)
        if self.task == "regression":
            said = near.groupBy("q").agg(F.avg("label").alias("prediction"))
        else:
            votes = near.groupBy("q", "label").agg(F.count("*").alias("n"))
            said = votes.groupBy("q").agg(F.max(F.struct("n", (-F.col("label")).alias("m"))).alias("t")).select("q", (-F.col("t.m")).alias("prediction"))
        return numbered.join(said, F.col("__q") == F.col("q"), "left").drop("__q", "q")


def dbscan(df: DataFrame, key: str, columns: list[str], eps: float, least: int = 5) -> DataFrame:
    """``key`` and ``cluster`` (its least core point's number, -1 for noise) by density.

    Equal points count once with their number. Points meet only in neighbouring
    cells of a grid of side ``eps``; at most four columns, as a cell has 3**d of them.
    """
    if len(columns) > 4:
        raise core.DomainError("density clustering takes at most four columns")
    x = [F.col(f"x{i}") for i in range(len(columns))]
    rows = df.select(F.col(key).alias("k"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).dropna()
    names = [f"x{i}" for i in range(len(columns))]
    points = stored(rows.groupBy(*names).agg(F.min("k").alias("p"), F.count("*").alias("n")))
    cell = F.array(*[F.floor(c / eps) for c in x])
    offsets = F.array(*[F.array(*map(F.lit, o)) for o in itertools.product((-1, 0, 1), repeat=len(columns))])
    a = points.select("p", *names, F.explode(F.transform(offsets, lambda o: F.zip_with(cell, o, lambda u, v: u + v))).alias("cell"))
    b = points.select(F.col("p").alias("p2"), F.col("n").alias("n2"), *[F.col(c).alias(f"{c}_") for c in names], cell.alias("cell"))
    square = sum(((F.col(c) - F.col(f"{c}_")) ** 2 for c in names), F.lit(0.0))
    pairs = stored(a.join(b, "cell").where(square <= eps * eps).select("p", "p2", "n2"))
    core_points = stored(pairs.groupBy("p").agg(F.sum("n2").alias("s")).where(F.col("s") >= least).select("p"))
    reached = pairs.join(core_points.withColumnRenamed("p", "p2"), "p2").select("p", "p2")
    links = reached.join(core_points, "p").select(F.col("p").alias("a"), F.col("p2").alias("b"))
    classes = components(links)
    border = reached.join(classes, F.col("p2") == F.col("id")).groupBy("p").agg(F.min("class").alias("c"))
    own = classes.select(F.col("id").alias("p"), F.col("class").alias("own"))
    labelled = points.join(border, "p", "left").join(own, "p", "left").select(*names, F.coalesce("own", "c", F.lit(-1)).alias("cluster"))
    return rows.join(labelled, names).select(F.col("k").alias(key), "cluster")
