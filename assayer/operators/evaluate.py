"""Splits, metrics and clustering geometry."""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer import core
from assayer.operators.graph import stored
from assayer.operators.profile import quoted


def split_rows(df: DataFrame, key: str, share: float = 0.2, seed: int = 42, stratify: str | None = None) -> DataFrame:
    """Add ``split``: ``evaluation`` for the rows of least hash, of each class if stratified.

    The hash decides by itself, without ordering the rows: a row's place does not
    depend on the others, so the split is stable when rows are added. A class's
    share is met on average; a class with rows on one side only is left to the caller.
    """
    parts = [F.lit(seed), F.col(key)] + ([F.col(stratify)] if stratify else [])
    u = F.pmod(F.xxhash64(*parts), F.lit(1_000_000)) / 1_000_000
    return df.withColumn("split", F.when(u < share, "evaluation").otherwise("train"))


@dataclass(frozen=True)
class Split:
    """Rows with ``split``, and what was done: sizes by class, whether every class is on both sides, and why."""

    rows: DataFrame
    sizes: dict[str | None, tuple[int, int]]  # class: train, evaluation
    stratified: bool
    note: str


MOST_CLASSES = 10_000


def allocate(counts: dict[str | None, int], share: float) -> dict[str | None, int]:
    """Evaluation rows of each class: ``ceil(share * rows)`` in all.

    Training rows are dealt in proportion, the last ones by largest remainder, ties to the lesser class.
    """
    total = sum(counts.values())
    train = total - math.ceil(share * total - 1e-9)
    exact = {c: Fraction(n * train, total) for c, n in counts.items()}
    out = {c: int(x) for c, x in exact.items()}
    order = sorted(counts, key=lambda c: (out[c] - exact[c], c or ""))
    for c in order[: train - sum(out.values())]:
        out[c] += 1
    return {c: n - out[c] for c, n in counts.items()}


def split_exact(df: DataFrame, key: str, share: float = 0.2, seed: int = 42, stratify: str | None = None) -> Split:
    """Split whose sizes are exact: the rows of least hash of key and seed are for evaluation, in each class if stratified.

    No side is sorted as a whole. Counts of hash ranges say which range of a class holds the cut, and
    only that range's rows are ranked. The split depends on keys and seed, not on partitions. A class of one
    row, or more classes than a side has rows, is split without strata, as the note says. Refused are
    fewer than two rows, missing classes, over ``MOST_CLASSES`` of them, and sides that would be empty.
    """
    if not 0 < share < 1:
        raise core.ConfigurationError("the share lies between 0 and 1")
    named = quoted(stratify).cast("string") if stratify else F.lit(None).cast("string")
    classes = df.groupBy(named.alias("c")).agg(F.count("*").alias("n")).limit(MOST_CLASSES + 1).collect()
    if len(classes) > MOST_CLASSES:
        raise core.DomainError(f"more than {MOST_CLASSES} classes: no target to stratify by")
    counts = {r["c"]: r["n"] for r in classes}
    total = sum(counts.values())
    if total < 2:
        raise core.EmptyDataError(f"a split needs two rows, the table has {total}")
    if stratify and None in counts:
        raise core.DomainError(f"the target is missing in {counts[None]} rows")
    evaluation = math.ceil(share * total - 1e-9)
    if not 0 < evaluation < total:
        raise core.DomainError("one side of the split would be empty")
    note = "rows divided by hash without strata"
    if stratify:
        rarest = min(counts, key=lambda c: (counts[c], c))
        asked = round(total * share)
        if counts[rarest] < 2:
            stratify, note = None, f"not stratified: the class {rarest} has one row, and each side needs one"
        elif asked < len(counts) or total - asked < len(counts):
            stratify, note = None, f"not stratified: {len(counts)} classes do not fit into {min(asked, total - asked)} rows"
        else:
            note = f"the shares of {len(counts)} classes are kept"
    if stratify is None:
        named, counts = F.lit(None).cast("string"), {None: total}
    want = allocate(counts, share)
    spark = df.sparkSession
    hashed = df.withColumns({"__class": named, "__h": F.xxhash64(F.lit(seed), quoted(key))})
    hashed = hashed.withColumn("__range", F.shiftright("__h", 52))  # 4,096 ranges, -2048 to 2047, in the order of hashes
    order = Window.partitionBy("__class").orderBy("__range")
    ranges = hashed.groupBy("__class", "__range").agg(F.count("*").alias("n"))
    seen = ranges.withColumn("upto", F.sum("n").over(order))
    asked_of = spark.createDataFrame([(c, n) for c, n in want.items()], "c string, want long")
    cuts = seen.join(F.broadcast(asked_of), F.col("__class").eqNullSafe(F.col("c"))).where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want")))
    cuts = cuts.select(F.col("c").alias("__c"), F.col("__range").alias("__cut"), (F.col("want") - F.col("upto") + F.col("n")).alias("__want"))
    placed = hashed.join(F.broadcast(cuts), F.col("__class").eqNullSafe(F.col("__c")), "left")
    clear = placed.where(F.col("__cut").isNull() | (F.col("__range") != F.col("__cut")))
    clear = clear.withColumn("split", F.when(F.col("__range") < F.col("__cut"), "evaluation").otherwise("train"))
    ties = F.xxhash64(*[quoted(c) for c in df.columns])
    rank = F.row_number().over(Window.partitionBy("__class").orderBy("__h", quoted(key), ties))
    edge = placed.where(F.col("__range") == F.col("__cut")).withColumn("split", F.when(rank <= F.col("__want"), "evaluation").otherwise("train"))
    rows = clear.unionByName(edge).select(*[quoted(c) for c in df.columns], "split")
    sizes = {c: (counts[c] - want[c], want[c]) for c in counts}
    return Split(rows, sizes, stratify is not None and all(a and b for a, b in sizes.values()), note)


def overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """``test_rows``, ``shared_rows`` (test rows equal to some training row, on the columns both have) and ``shared_ratio``.

    Missing equals missing. Rows that repeat are counted before they are joined, so a
    hot row is one row on either side; the join is by a digest and then by the values.
    """
    shared = [c for c in train.columns if c in test.columns]
    if not shared:
        raise core.SchemaError("the tables have no column in common")
    side = lambda df: core.normalize(df.select(*[quoted(c) for c in shared])).toDF(*[f"c{i}" for i in range(len(shared))])
    names = [f"c{i}" for i in range(len(shared))]
    mine = side(test).groupBy(*names).agg(F.count("*").alias("n")).withColumn("h", F.xxhash64(*names))
    seen = side(train).distinct().withColumn("h", F.xxhash64(*names)).toDF(*[f"{c}_" for c in names], "h_")
    same = F.col("h") == F.col("h_")
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    met = mine.join(seen.withColumn("met", F.lit(True)), same, "left")
    both = F.coalesce(F.sum(F.when(F.col("met"), F.col("n"))), F.lit(0))
    rows = F.coalesce(F.sum("n"), F.lit(0))
    return met.agg(rows.alias("test_rows"), both.alias("shared_rows"), (both / F.nullif(rows, F.lit(0))).alias("shared_ratio"))


def split_digest(df: DataFrame, key: str) -> DataFrame:
    """Order-free digest of each side."""
    return df.groupBy("split").agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(key)).alias("digest"))


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))


def classification(df: DataFrame, y: str, p: str) -> DataFrame:
    """accuracy and macro precision, recall, f1 over the classes of y; 0 for 0/0."""
    n, same = F.col("n"), F.col("y").eqNullSafe(F.col("p"))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("y").alias("k"), n.alias("actual"), zero.alias("said"), F.when(same, n).otherwise(zero).alias("tp")),
        F.struct(F.col("p").alias("k"), zero.alias("actual"), n.alias("said"), zero.alias("tp")),
    )
    each = confusion(df, y, p).select(F.inline(sides)).groupBy("k").agg(*[F.sum(v).alias(v) for v in ("actual", "said", "tp")])
    own = F.col("actual") > 0
    ratio = lambda u, v: F.coalesce(u / F.nullif(v, F.lit(0)), F.lit(0.0))
    mean = lambda v: F.avg(F.when(own, v))
    return each.agg(
        (F.sum("tp") / F.nullif(F.sum("actual"), F.lit(0))).alias("accuracy"), mean(ratio(F.col("tp"), F.col("said"))).alias("precision"),
        mean(ratio(F.col("tp"), F.col("actual"))).alias("recall"), mean(ratio(2 * F.col("tp"), F.col("said") + F.col("actual"))).alias("f1"),
    )


def binary(df: DataFrame, y: str, p: str, positive: Column) -> DataFrame:
    """``metric``, ``value`` and ``degenerate`` of one class: precision, recall and f1, 0 for 0/0.

    A degenerate 0 is a convention, not a measurement: no row was given the class
    (precision), or none has it (recall, f1).
    """
    is_y, is_p = quoted(y).eqNullSafe(positive), quoted(p).eqNullSafe(positive)
    counts = df.agg(F.count_if(is_y & is_p).alias("tp"), F.count_if(is_y).alias("actual"), F.count_if(is_p).alias("said"))
    ratio = lambda u, v: F.coalesce(u / F.nullif(v, F.lit(0)), F.lit(0.0))
    row = lambda name, value, empty: F.struct(F.lit(name).alias("metric"), value.alias("value"), empty.alias("degenerate"))
    none, unsaid = F.col("actual") == 0, F.col("said") == 0
    return counts.select(F.inline(F.array(
        row("precision", ratio(F.col("tp"), F.col("said")), unsaid), row("recall", ratio(F.col("tp"), F.col("actual")), none),
        row("f1", ratio(2 * F.col("tp"), F.col("said") + F.col("actual")), none),
    )))


def partition_blocker(df: DataFrame, label: str) -> str | None:
    """Why no metric of a clustering can be computed, or None: noise alone, one cluster, or a cluster a row."""
    clusters = df.where(quoted(label) >= 0).groupBy(quoted(label)).agg(F.count("*").alias("n")).agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    noise = df.where(quoted(label) < 0).count()
    k, rows = clusters["k"], clusters["rows"]
    if rows == 0:
        return f"all {noise} rows are noise, so there is no cluster to measure"
    if k < 2:
        return f"there is one cluster beside {noise} rows of noise, and each metric compares two or more"
    if k >= rows:
        return f"each of the {rows} rows is a cluster of its own, so there is no distance within clusters"
    return None


def roc_auc(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """Rank-sum area with ties averaged, from counts of each distinct score."""
    from assayer.functions.stats import ranked

    x = df.where(F.col(score).isNotNull()).select(positive.cast("int").alias("y"), F.col(score).alias("s"))
    each = x.groupBy("s").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    ranks = ranked(x, "s").select(F.col("value").alias("s"), "rank")
    pos, neg = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return each.join(ranks, "s").agg(
        ((F.sum(F.col("rank") * F.col("pos")) - pos * (pos + 1) / 2) / F.nullif(pos * neg, F.lit(0))).alias("roc_auc")
    )


def regression(df: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(y) - F.col(p)
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).agg(
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.avg(e * e) / F.nullif(F.var_pop(y), F.lit(0.0))).alias("r2"),
    )


def leaderboard(scores: DataFrame, metric: str, higher: bool = True) -> DataFrame:
    """Ranked models first, ties by name, then those without the metric; a table of models is small."""
    order = F.desc_nulls_last(metric) if higher else F.asc_nulls_last(metric)
    return scores.withColumn("rank", F.when(F.col(metric).isNotNull(), F.row_number().over(Window.orderBy(order, "model"))))


def centroids(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Centroid and size of each cluster; noise (-1) is left out."""
    return df.where(F.col(label) >= 0).groupBy(F.col(label).alias("cluster")).agg(
        F.count("*").alias("size"), *[F.avg(c).alias(f"c_{c}") for c in columns]
    )


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def cluster_metrics(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """davies_bouldin and calinski_harabasz from centroids: no distances between rows.

    Clusters are few; their pairs are joined, rows are not.
    """
    c = centroids(df, label, columns)
    here, there = [F.col(x) for x in columns], [F.col(f"c_{x}") for x in columns]
    near = df.where(F.col(label) >= 0).join(c, F.col(label) == F.col("cluster")).withColumn("__d", distance(here, there))
    inner = near.groupBy("cluster", "size", *[f"c_{x}" for x in columns]).agg(F.avg("__d").alias("s"), F.sum(F.col("__d") * F.col("__d")).alias("w"))
    whole = df.where(F.col(label) >= 0).agg(F.count("*").alias("n"), *[F.avg(x).alias(f"m_{x}") for x in columns])
    k = inner.join(F.broadcast(whole)).agg(
        F.count("*").alias("k"), F.first("n").alias("n"), F.sum("w").alias("w"),
        F.sum(F.col("size") * F.pow(distance(there, [F.col(f"m_{x}") for x in columns]), F.lit(2))).alias("b"),
    ).select(((F.col("b") / (F.col("k") - 1)) / F.nullif(F.col("w") / (F.col("n") - F.col("k")), F.lit(0.0))).alias("calinski_harabasz"))
    other = inner.select(F.col("cluster").alias("o"), F.col("s").alias("s2"), *[F.col(f"c_{x}").alias(f"o_{x}") for x in columns])
    pairs = inner.join(other, F.col("cluster") != F.col("o"))
    worst = pairs.groupBy("cluster").agg(
        F.max((F.col("s") + F.col("s2")) / F.nullif(distance(there, [F.col(f"o_{x}") for x in columns]), F.lit(0.0))).alias("r")
    )
    return worst.agg(F.avg("r").alias("davies_bouldin")).join(F.broadcast(k))


SILHOUETTE_BLOCK = 4096  # different rows a block, on average
SILHOUETTE_CHUNK = 64  # rows of a block whose distances are measured at once


def silhouette(df: DataFrame, key: str, label: str, columns: list[str]) -> DataFrame:
    """Exact Euclidean mean silhouette; every pair of different rows is measured.

    Rows are dealt to blocks by hash, and each two blocks meet in a task of their own, which adds up
    the distances of a row to every cluster; no table of pairs of rows exists. Equal rows
    of a cluster are one with their number. A row with a missing coordinate counts as 0 and for no other.
    """
    names = [f"x{i}" for i in range(len(columns))]
    rows = df.where((quoted(label) >= 0) & quoted(key).isNotNull()).select(quoted(label).alias("l"), *[quoted(c).cast("double").alias(x) for c, x in zip(columns, names, strict=True)])
    each = stored(rows.groupBy("l", *names).agg(F.count("*").alias("n")))
    whole = each.dropna(subset=names)
    blocks = -(-max(1, whole.count()) // SILHOUETTE_BLOCK)
    placed = stored(whole.withColumn("p", F.monotonically_increasing_id()).withColumn("at", F.pmod(F.xxhash64("l", *names), F.lit(blocks).cast("long"))))
    meets = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    here = placed.select("p", "l", "n", *names, F.col("at").alias("block"), meets.alias("other"))
    there = placed.select("l", "n", *names, meets.alias("block"), F.col("at").alias("other"))

    def solve(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("l")
        kind = a.schema.field("l").type
        if not a.num_rows or not b.num_rows:
            return pa.table({"p": pa.array([], pa.int64()), "l": pa.array([], kind), "n": pa.array([], pa.int64()), "l2": pa.array([], kind), "s": pa.array([], pa.float64())})
        x, y = (np.column_stack([t.column(c).to_numpy() for c in names]) for t in (a, b))
        labels, copies = b.column("l").to_numpy(), b.column("n").to_numpy().astype(float)
        starts = np.flatnonzero(np.append(True, labels[1:] != labels[:-1]))
        sums = []
        for i in range(0, len(x), SILHOUETTE_CHUNK):
            d = np.zeros((len(x[i : i + SILHOUETTE_CHUNK]), len(y)))
            for j in range(len(names)):
                apart = x[i : i + SILHOUETTE_CHUNK, j, None] - y[None, :, j]
                apart *= apart
                d += apart
            np.sqrt(d, out=d)
            d *= copies
            sums.append(np.add.reduceat(d, starts, axis=1).ravel())
        of = pa.array(np.repeat(np.arange(len(x)), len(starts)))
        to = pa.array(np.tile(starts, len(x)))
        return pa.table({"p": a.column("p").take(of), "l": a.column("l").take(of), "n": a.column("n").take(of), "l2": b.column("l").take(to), "s": np.concatenate(sums)})

    kind = placed.schema["l"].dataType.simpleString()
    met = here.groupBy("block", "other").cogroup(there.groupBy("block", "other")).applyInArrow(solve, f"p long, l {kind}, n long, l2 {kind}, s double")
    sizes = placed.groupBy(F.col("l").alias("l2")).agg(F.sum("n").alias("size"))
    far = met.groupBy("p", "l", "n", "l2").agg(F.sum("s").alias("s")).join(sizes, "l2")
    own = F.col("l") == F.col("l2")
    ab = far.groupBy("p", "n").agg(F.max(F.when(own, F.col("s") / F.nullif(F.col("size") - 1, F.lit(0)))).alias("a"), F.min(F.when(~own, F.col("s") / F.col("size"))).alias("b"))
    s = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)))
    total = ab.agg(F.sum(F.coalesce(s, F.lit(0.0)) * F.col("n")).alias("total"))
    rows_in_all = each.agg(F.sum("n").alias("n"))
    return rows_in_all.join(F.broadcast(total)).select(F.when(F.col("n") > 1, F.coalesce("total", F.lit(0.0)) / F.col("n")).alias("silhouette"))
