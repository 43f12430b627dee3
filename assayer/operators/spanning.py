"""Least spanning trees of points, and the clusterings that are read off them.

Points are ordered along a Z-curve and cut into blocks with their bounding boxes. In each
round of Borůvka's method every class looks for its least edge to another class: inside
the blocks first, which bounds how far it can be, and then only among pairs of blocks
whose boxes are near enough. Classes at least halve from round to round. Distances are
measured between blocks, in tasks; no table of pairs of rows exists.

Single linkage cuts the tree of distances; the order of density clustering (OPTICS) comes
from the tree of mutual reachability, max(core(p), core(q), |p - q|).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer import core
from assayer.functions import stats
from assayer.operators.graph import components, fresh, linked

BLOCK = 1024  # points in a block; more, where a table would have over
MOST_BLOCKS = 1024  # blocks (and one more a partition): their boxes are known to the driver
CHUNK = 256  # points of a block whose distances are measured at once
TREE_AT_ONCE = 200_000  # edges whose merges one task puts in order
EDGE = "class long, w double, lo long, hi long, other long"


@dataclass(frozen=True)
class Cloud:
    """Different points in blocks: ``rows`` has each row's key ``k`` and point ``p``; ``boxes`` is known to the driver."""

    rows: DataFrame
    points: DataFrame  # p, block, copies
    blocks: DataFrame  # block, ids, xs, copies
    names: list[int]
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray  # first point of each block
    first_id: list[int]
    dim: int
    size: int


def z_order(x: Column, low: list[float], high: list[float]) -> Column:
    """Place on a Z-curve over the box: the leading bits of all coordinates in turn."""
    used = min(len(low), 62)
    bits = min(16, 62 // used)
    parts = []
    for i in range(used):
        reach = high[i] / 2 - low[i] / 2
        cell = F.floor((x[i] / 2 - low[i] / 2) / reach * (2**bits - 1)).cast("long") if reach > 0 else F.lit(0).cast("long")
        parts += [F.shiftleft(F.shiftright(cell, b).bitwiseAND(F.lit(1).cast("long")), b * used + i) for b in range(bits)]
    total = parts[0]
    for p in parts[1:]:
        total = total.bitwiseOR(p)
    return total


def cloud(df: DataFrame, key: str, columns: list[str], block: int = BLOCK) -> Cloud:
    """Blocks of the different points of ``columns``; rows with a null or non-finite coordinate, or a null key, are left out."""
    x = [core.finite(F.col(f"`{c}`")) + 0.0 for c in columns]  # -0.0 is 0.0
    rows = df.select(F.col(f"`{key}`").alias("k"), F.array(*x).alias("x")).where(F.col("k").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    different = fresh(rows.groupBy("x").agg(F.count("*").alias("copies")))
    dim = len(columns)
    facts = different.agg(F.count("*").alias("n"), *[f(F.col("x")[i]).alias(f"{f.__name__}{i}") for i in range(dim) for f in (F.min, F.max)]).first()
    n = facts["n"]
    low, high = ([facts[f"{f}{i}"] for i in range(dim)] for f in ("min", "max"))
    placed = different.withColumn("z", z_order(F.col("x"), low, high) if n else F.lit(0))
    ranged = fresh(placed.repartitionByRange("z", "x").sortWithinPartitions("z", "x").select(F.spark_partition_id().alias("part"), "x", "copies"))
    most = max(block, -(-n // MOST_BLOCKS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        held = made = part = 0

        def put(x: np.ndarray, copies: np.ndarray) -> pa.RecordBatch:
            ids = (part << 40) + made + np.arange(len(x))
            row = [ids[0], ids.tobytes(), x.tobytes(), copies.astype("<i8").tobytes(), x.min(axis=0).tolist(), x.max(axis=0).tolist(), x[0].tolist()]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), *[pa.list_(pa.float64())] * 3]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["block", "ids", "xs", "copies", "low", "high", "first"])

        for batch in batches:
            if batch.num_rows:
                part = batch.column(0)[0].as_py()
                waiting.append((batch.column(1).flatten().to_numpy().reshape(-1, dim), batch.column(2).to_numpy()))
                held += batch.num_rows
            while held >= most:
                x, copies = (np.concatenate(v) for v in zip(*waiting, strict=True))
                yield put(x[:most], copies[:most])
                made, held, waiting = made + most, held - most, [(x[most:], copies[most:])]
        if held:
            yield put(*(np.concatenate(v) for v in zip(*waiting, strict=True)))

    blocks = fresh(ranged.mapInArrow(pack, "block long, ids binary, xs binary, copies binary, low array<double>, high array<double>, first array<double>"))
    boxes = blocks.select("block", "low", "high", "first").orderBy("block").collect()  # MOST_BLOCKS and one a partition

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, ids, xs, copies in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                p = np.frombuffer(ids, np.int64)
                x = pa.ListArray.from_arrays(pa.array(np.arange(0, len(p) * dim + 1, dim, dtype=np.int32)), pa.array(np.frombuffer(xs)))
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(np.full(len(p), name)), x, pa.array(np.frombuffer(copies, "<i8"))], names=["p", "block", "x", "copies"])

    points = blocks.select("block", "ids", "xs", "copies").mapInArrow(unpack, "p long, block long, x array<double>, copies long")
    table = lambda c: np.array([r[c] for r in boxes], float).reshape(len(boxes), dim)
    names = [r["block"] for r in boxes]
    return Cloud(
        rows.join(points.select("x", "p"), "x").select("k", "p"), points.drop("x"), blocks.select("block", "ids", "xs", "copies"),
        names, table("low"), table("high"), table("first"), names, dim, n,
    )


class Side:
    """One block in a task: points in ascending order of id."""

    def __init__(self, row: dict, dim: int) -> None:
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.x = np.frombuffer(row["xs"]).reshape(-1, dim)
        self.copies = np.frombuffer(row["copies"], "<i8")
        self.classes = np.array(row["classes"], np.int64) if row.get("classes") is not None else self.ids
        self.core = np.array(row["core"], float) if row.get("core") is not None else np.zeros(len(self.ids))

    def parts(self) -> list[slice]:
        return [slice(i, i + CHUNK) for i in range(0, len(self.ids), CHUNK)]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean; the same number from either side."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        apart = a[:, i, None] - b[None, :, i]
        total += apart * apart
    return np.sqrt(total)


def apart(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> np.ndarray:
    """Least distance between boxes, a little less for rounding."""
    gap = np.maximum(0, np.maximum(low2 - high, low - high2))
    return np.sqrt((gap * gap).sum(axis=-1)) * (1 - 1e-12)


def least_edges(a: Side, b: Side, attach: bool, reach: float = math.inf) -> list[np.ndarray]:
    """Of each class in ``a`` its least edge to another class in ``b``, by weight and then by ids: the columns of EDGE.

    ``attach`` weighs an edge by the far end's core distance only, and classes are then single points.
    """
    classes, own = np.unique(a.classes, return_inverse=True)
    of_class = np.full(len(classes), reach)
    best, to, kind = np.full(len(a.ids), np.inf), np.full(len(a.ids), -1), np.full(len(a.ids), -1)
    there = [(s, b.x[s].min(axis=0), b.x[s].max(axis=0)) for s in b.parts()]
    for s in a.parts():
        low, high = a.x[s].min(axis=0), a.x[s].max(axis=0)
        for gap, j in sorted((float(apart(low, high, u, v)), j) for j, (_, u, v) in enumerate(there)):
            if gap > of_class[own[s]].max():
                break
            t = there[j][0]
            d = distances(a.x[s], b.x[t])
            np.maximum(d, b.core[None, t], out=d)
            if not attach:
                np.maximum(d, a.core[s, None], out=d)
            d[a.classes[s, None] == b.classes[None, t]] = np.inf
            k = d.argmin(axis=1)
            w, q = d[np.arange(len(d)), k], b.ids[t][k]
            better = (w < best[s]) | ((w == best[s]) & np.isfinite(w) & (q < to[s]))
            best[s], to[s], kind[s] = np.where(better, w, best[s]), np.where(better, q, to[s]), np.where(better, b.classes[t][k], kind[s])
            np.minimum.at(of_class, own[s], best[s])
    lo, hi = np.minimum(a.ids, to), np.maximum(a.ids, to)
    order = np.lexsort((hi, lo, best, own))
    order = order[np.isfinite(best[order])]
    first = order[np.unique(own[order], return_index=True)[1]]
    return [a.classes[first], best[first], lo[first], hi[first], kind[first]]


def edge_table(columns: list[list[np.ndarray]]) -> pa.Table:
    joined = [np.concatenate(c) for c in zip(*columns, strict=True)] if columns else [[]] * 5
    kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table({n: pa.array(v, t) for n, v, t in zip(("class", "w", "lo", "hi", "other"), joined, kinds, strict=True)})


def pairs_within(c: Cloud, reach: np.ndarray, single: list[int | None]) -> DataFrame:
    """Pairs of blocks whose boxes are within reach of either, but for those of one and the same class: ``a``, ``b``, ``reach``."""
    out: list[tuple[int, int, float]] = []
    for i in range(len(c.names)):
        gap = apart(c.low[i], c.high[i], c.low[i + 1 :], c.high[i + 1 :])
        limit = np.maximum(reach[i], reach[i + 1 :])
        for j in (np.flatnonzero(gap <= limit) + i + 1).tolist():
            if single[i] is None or single[i] != single[j]:
                out.append((c.names[i], c.names[j], float(max(reach[i], reach[j]))))
    return c.blocks.sparkSession.createDataFrame(out, "a long, b long, reach double")


def meet(pairs: DataFrame, blocks: DataFrame, solve: Callable[[dict, dict], pa.Table], schema: str) -> DataFrame:
    """``solve`` on both blocks of every pair, each in a group of its own."""
    here = pairs.join(blocks.withColumnRenamed("block", "a"), "a")
    renamed = blocks.toDF(*[f"{c}_" for c in blocks.columns])  # both sides come from one table
    there = pairs.toDF("a_", "b_", "reach_").join(renamed.withColumnRenamed("block_", "b_"), "b_")
    one = lambda t: {c.removesuffix("_"): v for c, v in t.slice(0, 1).to_pylist()[0].items()}
    run = lambda a, b: solve(one(a), one(b))
    return here.groupBy("a", "b").cogroup(there.groupBy("a_", "b_")).applyInArrow(run, schema)


def by_block(values: DataFrame, column: str, alias: str) -> DataFrame:
    """Values of points (p, block, column) as one array a block, in the order of its points."""
    listed = F.sort_array(F.collect_list(F.struct("p", column)))
    return values.groupBy("block").agg(listed.alias("l")).select("block", F.transform("l", lambda e: e[column]).alias(alias))


def core_distances(c: Cloud, least: int) -> DataFrame:
    """``p``, ``block``, ``core``: the distance within which ``least`` rows lie, the point's own included; infinite where there are fewer."""
    dim = c.dim

    def nearest(a: Side, b: Side, reach: float) -> tuple[list, list, list]:
        of, far, copies = [], [], []
        for s in a.parts():
            d = distances(a.x[s], b.x)
            k = np.argsort(d, axis=1, kind="stable")[:, :least] if d.shape[1] > least else np.broadcast_to(np.arange(d.shape[1]), d.shape)
            w = np.take_along_axis(d, k, axis=1)
            row, col = np.nonzero(w <= reach)
            of.append(a.ids[s][row])
            far.append(w[row, col])
            copies.append(b.copies[k[row, col]])
        return of, far, copies

    def table(parts: list[tuple[list, list, list]]) -> pa.Table:
        cat = lambda i, t: np.concatenate([v for p in parts for v in p[i]] or [np.zeros(0, t)])
        return pa.table({"p": pa.array(cat(0, np.int64)), "d": pa.array(cat(1, float)), "n": pa.array(cat(2, np.int64))})

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Side(row, dim)
                yield from table([nearest(s, s, math.inf)]).to_batches()

    def across(one: dict, two: dict) -> pa.Table:
        a, b = Side(one, dim), Side(two, dim)
        return table([nearest(a, b, one["reach"]), nearest(b, a, one["reach"])])

    def kth(found: DataFrame) -> DataFrame:
        """Copies are counted from the nearest on until there are enough."""
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(float("inf")).alias("d"))
        seen = F.sort_array(F.collect_list(F.struct("d", "n")))
        step = lambda s, e: F.when(s["n"] >= least, s).otherwise(F.struct((s["n"] + e["n"]).alias("n"), e["d"].alias("d")))
        total = found.groupBy("p").agg(F.aggregate(seen, start, step).alias("s"))
        return total.select("p", F.when(F.col("s.n") >= least, F.col("s.d")).otherwise(float("inf")).alias("core"))

    near = fresh(c.blocks.mapInArrow(inside, "p long, d double, n long"))
    where = c.points.select("p", "block")
    reach = {r["block"]: r["r"] for r in kth(near).join(where, "p").groupBy("block").agg(F.max("core").alias("r")).collect()}
    pairs = pairs_within(c, np.array([reach[b] for b in c.names]), [None] * len(c.names))
    return fresh(kth(near.union(meet(pairs, c.blocks, across, "p long, d double, n long"))).join(where, "p").select("p", "block", "core"))


def least_outgoing(c: Cloud, blocks: DataFrame, state: DataFrame, attach: bool) -> DataFrame:
    """The least edge of every class to another one. ``blocks`` hold the classes (and core distances), ``state`` the class of each point.

    Somewhere along the curve a class has a neighbour of another class, in its block or as the first
    point of the next one; so each class gets a bound before blocks meet.
    """
    dim = c.dim
    has_core = "core" in blocks.columns
    facts = blocks.select(
        "block", F.element_at("classes", 1).alias("c"), F.array_min("classes").alias("lo"), F.array_max("classes").alias("hi"),
        (F.element_at("core", 1) if has_core else F.lit(0.0)).alias("core"),
    ).collect()
    known = {r["block"]: r for r in facts}
    following = [(a, c.first_id[i + 1], c.first[i + 1].tolist(), known[c.names[i + 1]]["c"], known[c.names[i + 1]]["core"]) for i, a in enumerate(c.names[:-1])]
    after = c.blocks.sparkSession.createDataFrame(following, "block long, np long, nx array<double>, nc long, ncore double")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a = Side(row, dim)
                found = [least_edges(a, a, attach)]
                if row["np"] is not None:
                    packed = {"ids": np.array([row["np"]]).tobytes(), "xs": np.array(row["nx"]).tobytes(), "copies": b"\1" + bytes(7)}
                    b = Side(packed | {"classes": [row["nc"]], "core": [row["ncore"]]}, dim)
                    found += [least_edges(a, b, attach), least_edges(b, a, attach)]
                yield from edge_table(found).to_batches()

    def across(one: dict, two: dict) -> pa.Table:
        a, b = Side(one, dim), Side(two, dim)
        return edge_table([least_edges(a, b, attach, one["reach"]), least_edges(b, a, attach, one["reach"])])

    least = lambda edges: edges.groupBy("class").agg(F.min(F.struct("w", "lo", "hi", "other")).alias("e")).select("class", "e.*")
    bound = fresh(least(blocks.join(F.broadcast(after), "block", "left").mapInArrow(inside, EDGE)))
    reach = {r["block"]: r["r"] for r in state.join(bound, "class", "left").groupBy("block").agg(F.max(F.coalesce("w", F.lit(float("inf")))).alias("r")).collect()}
    single = [r["lo"] if (r := known[b])["lo"] == r["hi"] else None for b in c.names]
    pairs = pairs_within(c, np.array([reach[b] for b in c.names]), single)
    return fresh(least(bound.union(meet(pairs, blocks, across, EDGE))))


def spanning_tree(c: Cloud, cores: DataFrame | None = None) -> DataFrame:
    """Edges ``lo``, ``hi``, ``w`` of the least spanning tree, of distances or, given core distances, of mutual reachability.

    Equal weights are ordered by the ids of their ends, so the tree is one. Points that no finite edge
    reaches stay apart.
    """
    state = fresh(c.points.select("p", "block", F.col("p").alias("class")))
    held = c.blocks if cores is None else fresh(c.blocks.join(by_block(cores, "core", "core"), "block"))
    tree = None
    while state.select("class").distinct().limit(2).count() > 1:
        blocks = fresh(held.join(by_block(state, "class", "classes"), "block"))
        picks = least_outgoing(c, blocks, state, False)
        if not picks.limit(1).count():
            break
        edges = picks.select("lo", "hi", "w").distinct()
        tree = edges if tree is None else tree.union(edges)
        root = linked(picks.select(F.col("class").alias("a"), F.col("other").alias("b"))).select(F.col("id").alias("class"), F.col("class").alias("root"))
        state = fresh(state.join(root, "class", "left").select("p", "block", F.coalesce("root", "class").alias("class")))
    return fresh(tree) if tree is not None else c.points.select(F.col("p").alias("lo"), F.col("p").alias("hi"), F.lit(0.0).alias("w")).limit(0)


def classes_of(c: Cloud, edges: DataFrame) -> DataFrame:
    """``k`` and ``cluster``, the least key among the rows that edges (lo, hi) connect."""
    joined = linked(edges.select(F.col("lo").alias("a"), F.col("hi").alias("b"))).select(F.col("id").alias("p"), "class")
    rows = fresh(c.rows.join(joined, "p", "left").select("k", F.coalesce("class", "p").alias("class")))
    named = rows.groupBy("class").agg(F.min("k").alias("cluster"))
    return rows.join(named, "class").select("k", "cluster")


def single_linkage(df: DataFrame, key: str, columns: list[str], k: int | None = 2, height: float | None = None, block: int = BLOCK) -> DataFrame:
    """``key`` and ``cluster`` (its least key) after merging down to k clusters, or all that lie within ``height``.

    The k - 1 longest edges of the spanning tree are cut; equal ones by the ids of their ends. Rows with a
    missing or non-finite coordinate get none. Fewer different points than k are a cluster each.
    """
    if (k is None) == (height is None) or (k is not None and k < 1):
        raise core.ConfigurationError("name either a number of clusters or a height")
    c = cloud(df, key, columns, block)
    tree = spanning_tree(c)
    if height is not None:
        left = tree.where(F.col("w") <= height)
    else:
        cut = tree.orderBy(F.desc("w"), F.desc("lo"), F.desc("hi")).limit(k - 1)
        left = tree.join(cut, ["lo", "hi"], "left_anti")
    return classes_of(c, left).withColumnRenamed("k", key)


def merges(tree: DataFrame, at_once: int = TREE_AT_ONCE) -> DataFrame:
    """The dendrogram of a spanning tree: ``rank``, ``w``, ``left``, ``right``, ``left_size``, ``size``, by ascending weight.

    A child is a point's id or, of an earlier merge, -1 - rank; the left one holds the smaller id. Ranges of
    ranks are halved until each has few enough edges for a task: the lighter half keeps its
    vertices, and the heavier one sees the classes that the lighter half leaves as its vertices.
    """
    ranked = stats.running(tree.withColumn("one", F.lit(1).cast("long")), ["w", "lo", "hi"], "one")
    one = F.lit(1).cast("long")
    edges = fresh(ranked.select(
        F.lit(1).cast("long").alias("part"), (F.col("upto_one") - 1).alias("rank"), "w", F.col("lo").alias("a"), F.col("hi").alias("b"),
        F.col("lo").alias("an"), F.col("hi").alias("bn"), one.alias("asize"), one.alias("bsize"),
    ))
    while True:
        parts = edges.groupBy("part").agg(F.count("*").alias("n"), F.min("rank").alias("first"), F.max("rank").alias("last"))
        wide = [r["part"] for r in parts.where(F.col("n") > at_once).select("part").collect()]  # edges / at_once of them at most
        if not wide:
            break
        big = edges.join(F.broadcast(parts.where(F.col("n") > at_once)), "part").withColumn("light", F.col("rank") * 2 <= F.col("first") + F.col("last"))
        light, heavy = big.where("light"), big.where("NOT light")
        at = lambda v: F.struct("part", F.col(v).alias("v"))
        met = components(light.select(at("a").alias("a"), at("b").alias("b"))).select("id.part", "id.v", F.col("class.v").alias("c"))
        ends = light.select("part", F.col("a").alias("v"), F.col("asize").alias("size"), "rank").union(light.select("part", "b", "bsize", "rank"))
        each = ends.groupBy("part", "v").agg(F.first("size").alias("size"), F.max("rank").alias("rank")).join(met, ["part", "v"])
        whole = each.groupBy("part", "c").agg(F.sum("size").alias("csize"), (-1 - F.max("rank")).alias("cn"))
        seen = fresh(met.join(whole, ["part", "c"]))
        for s in ("a", "b"):
            heavy = heavy.join(seen.withColumnRenamed("v", s), ["part", s], "left").withColumns(
                {s: F.coalesce("c", s), f"{s}n": F.coalesce("cn", f"{s}n"), f"{s}size": F.coalesce("csize", f"{s}size")}
            ).drop("c", "cn", "csize")
        rest = edges.join(F.broadcast(parts.where(F.col("n") > at_once)), "part", "left_anti")
        names = edges.columns
        edges = fresh(rest.union(light.withColumn("part", F.col("part") * 2).select(*names)).union(heavy.withColumn("part", F.col("part") * 2 + 1).select(*names)))

    def settle(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        up: dict[int, int] = {}
        known: dict[int, tuple[int, int]] = {}
        out: list[tuple] = []

        def find(v: int) -> int:
            root = v
            while up.get(root, root) != root:
                root = up[root]
            while up.get(v, v) != root:
                up[v], v = root, up[v]
            return root

        for rank, w, a, b, an, bn, sa, sb in zip(*(t.column(c).to_pylist() for c in ("rank", "w", "a", "b", "an", "bn", "asize", "bsize")), strict=True):
            known.setdefault(a, (an, sa))
            known.setdefault(b, (bn, sb))
            u, v = sorted((find(a), find(b)))
            (left, n), (right, m) = known[u], known[v]
            up[v], known[u] = u, (-1 - rank, n + m)
            out.append((rank, w, left, right, n, n + m))
        kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["rank", "w", "left", "right", "left_size", "size"]
        return pa.table({n: pa.array(v, k) for n, v, k in zip(names, zip(*out, strict=True), kinds, strict=True)})

    return edges.groupBy("part").applyInArrow(settle, "rank long, w double, left long, right long, left_size long, size long")


def leaf_order(c: Cloud, tree: DataFrame, at_once: int = TREE_AT_ONCE) -> DataFrame:
    """``p``, ``place`` (from 0) and ``reachability``: the points from left to right of the dendrogram, with the height that joins each to those before it.

    A node's place is the sum of what lies left of it on its way up, added up by pointer doubling.
    The first point has no reachability.
    """
    if not tree.limit(1).count():
        only = stats.running(c.points.select("p", F.lit(1).cast("long").alias("one")), ["p"], "one")
        return only.select("p", (F.col("upto_one") - 1).alias("place"), F.lit(None).cast("double").alias("reachability"))
    table = fresh(merges(tree, at_once))
    parent = (-1 - F.col("rank")).alias("up")
    way = fresh(table.select(F.col("left").alias("node"), parent, F.lit(0).cast("long").alias("add")).union(table.select("right", parent, F.col("left_size"))))
    while True:
        over = way.select(F.col("node").alias("up"), F.col("up").alias("over"), F.col("add").alias("more"))
        jumped = fresh(way.join(over, "up", "left").select("node", F.coalesce("over", "up").alias("up"), (F.col("add") + F.coalesce("more", F.lit(0))).alias("add"), F.col("over").isNotNull().alias("moved")))
        way = jumped.drop("moved")
        if not jumped.where("moved").limit(1).count():
            break
    own = table.select((-1 - F.col("rank")).alias("node"), "left_size", "w").join(way.select("node", "add"), "node", "left")
    heights = own.select((F.coalesce("add", F.lit(0)) + F.col("left_size")).alias("place"), F.col("w").alias("reachability"))
    return fresh(way.where("node >= 0").select(F.col("node").alias("p"), F.col("add").alias("place")).join(heights, "place", "left").select("p", "place", "reachability"))


def optics(df: DataFrame, key: str, columns: list[str], least: int = 5, block: int = BLOCK, at_once: int = TREE_AT_ONCE) -> DataFrame:
    """Density order of rows: ``key``, ``place``, ``reachability``, ``core``, ``attach`` and ``attached``.

    Places follow the dendrogram of mutual reachability, so at any height the clusters are runs of
    places; ``reachability`` joins a place to those before it (none: the first, or no other point is in
    reach). ``core`` is the distance within which ``least`` rows lie, infinite where there are fewer.
    ``attach`` is the least max(core(q), |p - q|) over other points q, ``attached`` the
    place of that q: it says which cluster a sparse row borders on. Equal rows share a place.
    Rows with a missing or non-finite coordinate are left out.
    """
    if least < 1:
        raise core.ConfigurationError("least must be at least 1")
    c = cloud(df, key, columns, block)
    cores = core_distances(c, least)
    state = fresh(c.points.select("p", "block", F.col("p").alias("class")))
    blocks = fresh(c.blocks.join(by_block(cores, "core", "core"), "block").join(by_block(state, "class", "classes"), "block"))
    order = leaf_order(c, spanning_tree(c, cores), at_once)
    other = F.when(F.col("lo") == F.col("class"), F.col("hi")).otherwise(F.col("lo"))
    near = least_outgoing(c, blocks, state, True).select(F.col("class").alias("p"), F.col("w").alias("attach"), other.alias("q"))
    placed = order.join(cores.select("p", "core"), "p").join(near, "p", "left")
    placed = placed.join(order.select(F.col("p").alias("q"), F.col("place").alias("attached")), "q", "left")
    rows = c.rows.join(placed, "p")
    return rows.select(F.col("k").alias(key), "place", "reachability", "core", "attach", "attached")


def dbscan(df: DataFrame, key: str, columns: list[str], eps: float, least: int = 5, block: int = BLOCK) -> DataFrame:
    """DBSCAN through the density order: for any number of columns and for dense data, as no table of neighbours is made."""
    return density_cut(optics(df, key, columns, least, block), key, eps)


def density_cut(ordered: DataFrame, key: str, eps: float) -> DataFrame:
    """DBSCAN clusters of radius ``eps`` from a density order: ``key`` and ``cluster`` (the least key of its dense rows, -1 for noise).

    A row on the border of several clusters goes to that of the point it attaches to.
    """
    place = ordered.groupBy("place").agg(F.first("reachability").alias("r"), F.first("core").alias("core"))
    starts = place.select("place", (F.col("core") <= eps).alias("dense"), F.when(F.col("r") <= eps, 0).otherwise(1).cast("long").alias("start"))
    runs = stats.running(starts, ["place"], "start").where("dense").select("place", F.col("upto_start").alias("run"))
    named = fresh(ordered.join(runs, "place").groupBy("run").agg(F.min(key).alias("cluster")).join(runs, "run").select("place", "cluster"))
    border = named.select(F.col("place").alias("attached"), F.col("cluster").alias("beside"))
    joined = ordered.join(named, "place", "left").join(border, "attached", "left")
    return joined.select(key, F.coalesce("cluster", F.when(F.col("attach") <= eps, F.col("beside")), F.lit(-1)).alias("cluster"))
