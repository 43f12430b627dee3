"""Connected components of a table of links."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.core import ConfigurationError


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, one of its own in local mode; on a cluster that is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ConfigurationError("spark.checkpoint.dir names no shared folder; a cluster needs one")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def fresh(df: DataFrame) -> DataFrame:
    """``stored`` without the size estimate, which each join multiplies: in a loop its digits double every turn."""
    done, spark = stored(df), df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)


def components(links: DataFrame) -> DataFrame:
    """Least id of each linked id's component: ``id``, ``class``, from links (a, b).

    Each round every class that still has links picks the least class among its
    neighbours. Picks form trees, as a pick's lesser end never grows along them;
    the lesser of the two that pick each other is the root and least id of its tree.
    Trees become one class each by pointer doubling, and links move to the roots.
    No class with links is alone in its tree, so each round at least halves them:
    rounds, and doublings in a round, grow with the logarithm of the number of ids,
    whatever the order of ids along a chain.
    """
    links = fresh(links.where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = links.select(F.col("a").alias("id")).union(links.select("b")).distinct().select("id", F.col("id").alias("class"))
    edges = links.where("a != b")
    while edges.limit(1).count():
        root = roots(edges)
        state = fresh(state.join(root.withColumnRenamed("id", "class"), "class", "left").select("id", F.coalesce("root", "class").alias("class")))
        for side in ("a", "b"):
            edges = edges.join(root.withColumnRenamed("id", side), side).drop(side).withColumnRenamed("root", side)
        edges = fresh(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return state


LINKS_AT_ONCE = 200_000  # links whose classes one task settles


def linked(links: DataFrame, at_once: int = LINKS_AT_ONCE) -> DataFrame:
    """``components`` of links between whole numbers; as many as a task can hold, by count, are settled in one, without rounds."""
    links = stored(links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct())
    if links.limit(at_once + 1).count() > at_once:
        return components(links)

    def settle(t: pa.Table) -> pa.Table:
        up: dict[int, int] = {}

        def find(v: int) -> int:
            root = v
            while up.setdefault(root, root) != root:
                root = up[root]
            while up[v] != root:
                up[v], v = root, up[v]
            return root

        for a, b in zip(t.column("a").to_pylist(), t.column("b").to_pylist(), strict=True):
            low, high = sorted((find(a), find(b)))
            up[high] = low
        ids = list(up)
        return pa.table({"id": pa.array(ids, pa.int64()), "class": pa.array([find(v) for v in ids], pa.int64())})

    whole = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.lit(0).alias("one"))
    return stored(whole.groupBy("one").applyInArrow(settle, "id long, class long"))


def roots(edges: DataFrame) -> DataFrame:
    """Root of the tree of picks of each end of ``edges`` (a, b): ``id``, ``root``."""
    pick = fresh(edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root")))
    other = pick.select(F.col("id").alias("root"), F.col("root").alias("back"))
    up = pick.join(other, "root").select("id", F.when((F.col("back") == F.col("id")) & (F.col("id") < F.col("root")), F.col("id")).otherwise(F.col("root")).alias("root"))
    up = fresh(up)
    while True:
        over = up.select(F.col("id").alias("root"), F.col("root").alias("over"))
        jumped = fresh(up.join(over, "root").select("id", F.col("over").alias("root"), (F.col("root") != F.col("over")).alias("moved")))
        up = jumped.select("id", "root")
        if not jumped.where("moved").limit(1).count():
            return up
