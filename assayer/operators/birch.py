"""BIRCH: clustering features as mergeable summaries, and Ward's method over them.

A clustering feature is a number of rows, their sum and the sum of their squared lengths.
Each task grows a tree of such features over its rows and passes on the leaves, at most
``MOST_LEAVES`` of them: where there are more, the threshold grows and the leaves are put
into a new tree, as sums lose no row. The leaves of tasks are merged sixteen tasks at a
time. What reaches the driver are the leaves of the last tree; Ward's method joins these.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer import core
from assayer.operators.graph import stored

MOST_LEAVES = 2_000
FAN_IN = 16
LEAVES = "turn long, threshold double, n long, total array<double>, squares double"


class Node:
    """Features of up to ``branching`` children; a leaf's children are the summaries themselves."""

    __slots__ = ("children", "n", "size", "squares", "total")

    def __init__(self, dim: int, branching: int, leaf: bool) -> None:
        self.n, self.total, self.squares = np.zeros(branching + 1), np.zeros((branching + 1, dim)), np.zeros(branching + 1)
        self.size = 0
        self.children: list[Node] | None = None if leaf else []

    def nearest(self, x: np.ndarray) -> int:
        """Child of nearest centroid, ties to the first."""
        c = self.total[: self.size] / self.n[: self.size, None]
        return int(((c - x) ** 2).sum(axis=1).argmin())

    def put(self, n: float, total: np.ndarray, squares: float, child: Node | None = None) -> None:
        i = self.size
        self.n[i], self.total[i], self.squares[i] = n, total, squares
        self.size += 1
        if self.children is not None:
            self.children.append(child)

    def sums(self) -> tuple[float, np.ndarray, float]:
        k = self.size
        return self.n[:k].sum(), self.total[:k].sum(axis=0), self.squares[:k].sum()


class Tree:
    """A tree of clustering features. A summary takes in a row while its radius stays within the threshold."""

    def __init__(self, dim: int, threshold: float, branching: int, most: int) -> None:
        self.dim, self.threshold, self.branching, self.most = dim, threshold, branching, most
        self.root, self.leaves = Node(dim, branching, True), 0

    def add(self, n: float, total: np.ndarray, squares: float) -> None:
        split = self._insert(self.root, n, total, squares)
        if split:
            self.root = Node(self.dim, self.branching, False)
            for part in split:
                self.root.put(*part.sums(), part)
        if self.leaves > self.most:
            self._rebuild()

    def _insert(self, node: Node, n: float, total: np.ndarray, squares: float) -> tuple[Node, Node] | None:
        if node.size:
            i = node.nearest(total / n)
            if node.children is not None:
                parts = self._insert(node.children[i], n, total, squares)
                if not parts:
                    node.n[i] += n
                    node.total[i] += total
                    node.squares[i] += squares
                    return None
                node.children[i] = parts[0]
                node.n[i], node.total[i], node.squares[i] = parts[0].sums()
                node.put(*parts[1].sums(), parts[1])
                return self._split(node) if node.size > self.branching else None
            m, t, s = node.n[i] + n, node.total[i] + total, node.squares[i] + squares
            if s / m - (t @ t) / (m * m) <= self.threshold**2:
                node.n[i], node.total[i], node.squares[i] = m, t, s
                return None
        node.put(n, total, squares)
        self.leaves += 1
        return self._split(node) if node.size > self.branching else None

    def _split(self, node: Node) -> tuple[Node, Node]:
        """The two children farthest apart draw the others, each to the nearer one."""
        k = node.size
        c = node.total[:k] / node.n[:k, None]
        d = ((c[:, None] - c[None]) ** 2).sum(axis=2)
        a, b = divmod(int(d.argmax()), k)
        parts = tuple(Node(self.dim, self.branching, node.children is None) for _ in range(2))
        for i in range(k):
            side = parts[0 if i == a or (i != b and d[i, a] < d[i, b]) else 1]
            side.put(node.n[i], node.total[i], node.squares[i], node.children[i] if node.children is not None else None)
        return parts

    def entries(self, node: Node | None = None) -> list[tuple[float, np.ndarray, float]]:
        """The leaves from left to right."""
        node = node or self.root
        if node.children is not None:
            return [e for c in node.children for e in self.entries(c)]
        return [(node.n[i], node.total[i], node.squares[i]) for i in range(node.size)]

    def _rebuild(self) -> None:
        """Twice the threshold, or what joins the closest two leaves of a neighbourhood, until few enough leaves are left."""
        while self.leaves > self.most:
            old = self.entries()
            c = np.array([t / n for n, t, _ in old])
            near = np.sqrt(((c[1:] - c[:-1]) ** 2).sum(axis=1))
            self.threshold = max(self.threshold * 2, float(np.median(near)) / 2, np.nextafter(0, 1))
            self.root, self.leaves = Node(self.dim, self.branching, True), 0
            limit, self.most = self.most, len(old) + 1
            for e in old:
                self.add(*e)
            self.most = limit


@dataclass(frozen=True)
class Summary:
    """Leaves on the driver: rows, centroids and squared sums, and the threshold they were made with."""

    n: np.ndarray
    total: np.ndarray
    squares: np.ndarray
    threshold: float

    @property
    def centres(self) -> np.ndarray:
        return self.total / np.maximum(1, self.n)[:, None]


def summarise(rows: DataFrame, dim: int, threshold: float = 0.5, branching: int = 50, most: int = MOST_LEAVES) -> Summary:
    """Leaves over ``x`` (array of doubles); rows whose x is null or holds null or non-finite numbers are left out.

    Leaves depend on the order in which tasks read their rows, as in any such tree; the sums over all leaves
    do not. At most ``most`` leaves come back, whatever the number of rows; with few different rows and a threshold of
    0 each different row is a leaf.
    """
    if threshold < 0 or branching < 2 or most < 2:
        raise core.ConfigurationError("threshold must not be negative, branching and most at least 2")

    def listed(tree: Tree, turn: int) -> pa.RecordBatch:
        found = tree.entries()
        columns = [[turn] * len(found), [tree.threshold] * len(found), [int(n) for n, _, _ in found], [t.tolist() for _, t, _ in found], [float(s) for _, _, s in found]]
        kinds = [pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.float64()]
        names = ["turn", "threshold", "n", "total", "squares"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, turn = Tree(dim, threshold, branching, most), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            turn = batch.column(1)[0].as_py()
            for x in batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim):
                tree.add(1.0, x, float(x @ x))
        yield listed(tree, turn)

    def merge(t: pa.Table) -> pa.Table:
        tree = Tree(dim, max(t.column("threshold").to_pylist()), branching, most)
        order = sorted(zip(*(t.column(c).to_pylist() for c in ("turn", "n", "total", "squares")), strict=True))
        for _, n, total, squares in order:
            tree.add(float(n), np.array(total, float), squares)
        return pa.Table.from_batches([listed(tree, min(t.column("turn").to_pylist()) // FAN_IN)])

    good = rows.select(F.col("x").cast("array<double>").alias("x")).where(
        F.col("x").isNotNull() & (F.size("x") == dim) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    )
    leaves = stored(good.select("x", F.spark_partition_id().cast("long").alias("turn")).mapInArrow(grow, LEAVES))
    while (leaves.agg(F.max("turn")).first()[0] or 0) > 0:
        leaves = stored(leaves.groupBy(F.expr(f"turn div {FAN_IN}").alias("g")).applyInArrow(merge, LEAVES))
    last = leaves.collect()  # MOST_LEAVES rows
    pick = lambda c: np.array([r[c] for r in last], float)
    return Summary(pick("n"), pick("total").reshape(len(last), dim), pick("squares"), max((r["threshold"] for r in last), default=threshold))


def ward(centres: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Number of each centre's cluster after merging down to k by least growth of the squared error.

    All pairs of centres are held: for the bounded leaves of a tree, not for rows. Equal
    growths go to the pair of lowest numbers. Clusters are numbered by their first centre.
    """
    m = len(centres)
    if m == 0:
        return np.zeros(0, np.int64)
    d = ((centres[:, None] - centres[None]) ** 2).sum(axis=2) if m * m * centres.shape[1] < 50_000_000 else np.array([((centres - c) ** 2).sum(axis=1) for c in centres])
    size = sizes.astype(float).copy()
    d *= np.multiply.outer(size, size) / np.add.outer(size, size)
    np.fill_diagonal(d, np.inf)
    label = np.arange(m)
    nearest = d.argmin(axis=1)
    cost = d[np.arange(m), nearest]
    for _ in range(m - min(k, m)):
        i = int(cost.argmin())
        i, j = sorted((i, int(nearest[i])))
        a, b = size[i], size[j]
        with np.errstate(invalid="ignore"):
            d[i] = ((a + size) * d[i] + (b + size) * d[j] - size * d[i, j]) / (a + b + size)  # Lance and Williams
        d[i, i] = np.inf
        d[:, i] = d[i]
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        cost[j] = np.inf
        open_ = np.isfinite(cost)
        stale = np.flatnonzero(open_ & ((nearest == i) | (nearest == j)))
        for r in {i, *stale.tolist()}:
            nearest[r] = d[r].argmin()
            cost[r] = d[r, nearest[r]]
        closer = np.flatnonzero(np.isfinite(d[i]) & (d[i] < cost))
        nearest[closer], cost[closer] = i, d[i, closer]
    return np.unique(label, return_inverse=True)[1]


@dataclass(frozen=True)
class Assigner:
    """Gives each row the cluster of the nearest leaf, ties to the first leaf; rows that cannot be measured get none."""

    centres: np.ndarray
    labels: np.ndarray

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Add ``prediction``. ``features`` is a vector or an array of doubles."""
        held = df.sparkSession.sparkContext.broadcast((self.centres, self.labels))
        dim = self.centres.shape[1]

        @F.pandas_udf("int")
        def nearest(x):  # noqa: ANN001, ANN202
            import pandas as pd

            centres, labels = held.value
            half = (centres**2).sum(axis=1) / 2
            good = np.array([v is not None and len(v) == dim and np.isfinite(np.array(v, float)).all() for v in x], bool)
            out = np.full(len(x), np.nan)
            if good.any() and len(centres):
                rows = np.array(x[good].tolist(), float)
                out[good] = np.concatenate([labels[(rows[i : i + 2048] @ centres.T - half).argmax(axis=1)] for i in range(0, len(rows), 2048)])
            return pd.Series(out).astype("Int32")

        kind = df.schema[features].dataType.simpleString()
        return df.withColumn("prediction", nearest(F.col(features) if kind.startswith("array") else vector_to_array(features)))


class Birch:
    """Ward's clusters of the leaves' centroids, each counted once; assigns rows that it has not seen."""

    def __init__(self, k: int = 3, threshold: float = 0.5, branching: int = 50, most: int = MOST_LEAVES, weighted: bool = False) -> None:
        self.k, self.threshold, self.branching, self.most, self.weighted = k, threshold, branching, most, weighted

    def setK(self, k: int) -> Birch:
        return Birch(k, self.threshold, self.branching, self.most, self.weighted)

    def fit(self, df: DataFrame, features: str = "features") -> Assigner:
        kind = df.schema[features].dataType.simpleString()
        x = F.col(features) if kind.startswith("array") else vector_to_array(features)
        rows = df.select(x.alias("x"))
        one = rows.where("x IS NOT NULL").select(F.size("x").alias("d")).first()
        if one is None:
            raise core.EmptyDataError("no rows to summarise")
        leaves = summarise(rows, one["d"], self.threshold, self.branching, self.most)
        sizes = leaves.n if self.weighted else np.ones(len(leaves.n))
        return Assigner(leaves.centres, ward(leaves.centres, sizes, self.k))


class WardOverLeaves(Birch):
    """Agglomerative clustering under Ward's criterion over summaries of rows, weighted by their rows.

    Exact where the different rows are at most ``most``, since then each is a leaf of its own; beyond that the
    tree's threshold grows until so many leaves are left.
    """

    def __init__(self, k: int = 2, most: int = MOST_LEAVES) -> None:
        super().__init__(k, 0.0, 50, most, True)

    def setK(self, k: int) -> WardOverLeaves:
        return WardOverLeaves(k, self.most)


def birch(df: DataFrame, key: str, columns: list[str], k: int = 3, threshold: float = 0.5, branching: int = 50) -> DataFrame:
    """``key`` and ``cluster`` of each row with finite coordinates; null for others."""
    return _clusters(df, key, columns, Birch(k, threshold, branching))


def agglomerative(df: DataFrame, key: str, columns: list[str], k: int = 2, most: int = MOST_LEAVES) -> DataFrame:
    """Ward's clusters, over leaves beyond ``most`` different rows: ``key`` and ``cluster``; see ``WardOverLeaves``."""
    return _clusters(df, key, columns, WardOverLeaves(k, most))


def _clusters(df: DataFrame, key: str, columns: list[str], model: Birch) -> DataFrame:
    x = F.array(*[core.finite(F.col(f"`{c}`")) + 0.0 for c in columns])
    rows = df.select(F.col(f"`{key}`").alias(key), x.alias("features"))
    if rows.limit(1).count() == 0:
        return rows.select(key, F.lit(None).cast("int").alias("cluster"))
    return model.fit(rows).transform(rows).select(key, F.col("prediction").alias("cluster"))


def feature_sums(df: DataFrame, columns: list[str], threshold: float = 0.5) -> DataFrame:
    """The leaves' sums put together, one row a column: ``column``, ``n``, ``total``; equal to plain sums of the rows."""
    x = F.array(*[core.finite(F.col(f"`{c}`")) for c in columns])
    s = summarise(df.select(x.alias("x")), len(columns), threshold)
    rows = [(c, int(s.n.sum()), float(t)) for c, t in zip(columns, s.total.sum(axis=0), strict=True)]
    return df.sparkSession.createDataFrame(rows, "column string, n long, total double")
