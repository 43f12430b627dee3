"""Spanning-tree, Ward and BIRCH clustering against plain loops over all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.core import ConfigurationError
from assayer.operators import birch, evaluate, neighbours, spanning
from assayer.plans import models


def points(spark, x):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "k long, a double, b double")


@pytest.fixture(scope="module")
def scattered():
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(0, 1, (100, 2)), r.normal(5, 0.5, (100, 2)), r.uniform(-8, 12, (60, 2))])
    return np.concatenate([x, x[:40]])  # some rows repeat


def far(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))


def plain_single(x, k):
    """Least index of each row's cluster after merging the closest pairs down to k, and the heights of the merges."""
    d, up, left, heights = far(x), list(range(len(x))), len(x), []

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for w, i, j in sorted((d[i, j], i, j) for i in range(len(x)) for j in range(i)):
        a, b = find(i), find(j)
        if a != b and left > k:
            up[max(a, b)], left = min(a, b), left - 1
            heights.append(w)
    return [find(i) for i in range(len(x))], heights


def named(labels):
    """Labels by first place, so that two numberings compare."""
    first = {}
    return [first.setdefault(v, i) for i, v in enumerate(labels)]


@pytest.mark.parametrize("k", [1, 5, 40])
def test_single_linkage_against_all_pairs(spark, scattered, k):
    got = {r["k"]: r["cluster"] for r in spanning.single_linkage(points(spark, scattered), "k", ["a", "b"], k, block=64).collect()}
    assert [got[i] for i in range(len(scattered))] == plain_single(scattered, k)[0]


@pytest.mark.parametrize("at_once", [40, 1000])
def test_merges_have_the_heights_of_a_plain_loop(spark, scattered, at_once):
    x = np.unique(scattered, axis=0)[:100]
    c = spanning.cloud(points(spark, x), "k", ["a", "b"], block=50)
    rows = sorted(spanning.merges(spanning.spanning_tree(c), at_once).collect(), key=lambda r: r["rank"])
    assert np.allclose([r["w"] for r in rows], plain_single(x, 1)[1])
    members = {r["p"]: {r["k"]} for r in c.rows.collect()}
    labels, parents = {i: i for i in range(len(x))}, plain_single
    for r in rows:
        left, right = members[r["left"]], members[r["right"]]
        assert (len(left), len(left) + len(right)) == (r["left_size"], r["size"])
        assert not left & right
        members[-1 - r["rank"]] = left | right
    assert members[-len(rows)] == set(labels)
    half = parents(x, 60)[0]
    assert {frozenset(i for i in range(len(x)) if half[i] == c) for c in set(half)} <= {frozenset(m) for m in members.values()}


def test_density_order_cuts_to_dbscan(spark, scattered):
    df = points(spark, scattered)
    order = spanning.optics(df, "k", ["a", "b"], 5, block=64, at_once=200).persist()
    rows = {r["k"]: r for r in order.collect()}
    d = far(scattered)
    cores = np.sort(d, axis=1)[:, 4]
    assert np.allclose([rows[i]["core"] for i in range(len(d))], cores)
    assert sorted({r["place"] for r in rows.values()}) == list(range(260))
    distinct = len(np.unique(scattered, axis=0))
    assert sum(r["reachability"] is None for r in {r["place"]: r for r in rows.values()}.values()) == 1
    assert distinct == 260
    for eps in (0.3, 1.0):
        got = {r["k"]: r["cluster"] for r in spanning.density_cut(order, "k", eps).collect()}
        want = {r["k"]: r["cluster"] for r in neighbours.dbscan(df, "k", ["a", "b"], eps, 5).collect()}
        dense = cores <= eps
        for i in got:
            reached = {want[j] for j in np.flatnonzero(dense & (d[i] <= eps)).tolist()}
            assert got[i] == want[i] if dense[i] else got[i] in (reached or {-1})


def test_size_estimates_do_not_grow_with_the_rounds_of_the_density_order(spark, scattered):
    order = spanning.optics(points(spark, scattered[:120]), "k", ["a", "b"], 4)
    size = order._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert size.bit_length() < 10_000  # each join multiplies the estimates of its sides; squared in every round they had thousands of digits


def test_silhouette_of_many_rows_with_copies_and_gaps(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "SILHOUETTE_BLOCK", 40)
    rng = np.random.default_rng(5)
    x, label = rng.integers(0, 12, (150, 2)).astype(float), rng.integers(0, 3, 150)
    label[0] = 7  # alone
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i in range(150):
        mean = {c: far[i][(label == c) & (np.arange(150) != i)].mean() for c in set(label.tolist()) if c != label[i] or (label == c).sum() > 1}
        a, b = mean.pop(int(label[i]), None), min(mean[c] for c in mean if c != label[i])
        want.append(0.0 if a is None else (b - a) / max(a, b))
    rows = [(i, int(c), float(p), float(q)) for i, (c, (p, q)) in enumerate(zip(label, x, strict=True))]
    df = spark.createDataFrame([*rows, (150, 1, None, 1.0), (151, -1, 0.0, 0.0), (152, None, 0.0, 0.0)], "k long, l long, a double, b double")
    assert abs(evaluate.silhouette(df, "k", "l", ["a", "b"]).first()[0] - sum(want) / 151) < 1e-12
    assert evaluate.silhouette(df.where("k = 3"), "k", "l", ["a", "b"]).first()[0] is None
    assert evaluate.silhouette(df.where("k < 0"), "k", "l", ["a", "b"]).first()[0] is None
    # 12,000 rows on two places: over the 10,000 that were the most
    many = spark.range(12_000).select("id", (F.col("id") % 2).alias("l"), (F.col("id") % 2).cast("double").alias("a"))
    assert evaluate.silhouette(many, "id", "l", ["a"]).first()[0] == 1.0


def test_few_and_awkward_points(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, -0.0, 1.0), (3, nan, 1.0), (4, None, 1.0), (5, inf, 1.0), (None, 0.0, 0.0)], "k long, a double, b double")
    got = sorted(tuple(r) for r in spanning.single_linkage(df, "k", ["a", "b"], 3).collect())
    assert got == [(1, 1), (2, 1)]
    alone = spanning.optics(df, "k", ["a", "b"], 5).collect()
    assert [(r["place"], r["reachability"], r["core"]) for r in alone] == [(0, None, inf)] * 2
    assert {r["cluster"] for r in spanning.density_cut(spanning.optics(df, "k", ["a", "b"], 2), "k", 0.0).collect()} == {1}
    none = df.where(F.lit(False))
    assert spanning.single_linkage(none, "k", ["a", "b"], 2).count() == 0
    assert spanning.optics(none, "k", ["a", "b"]).count() == 0
    assert birch.birch(none, "k", ["a", "b"]).count() == 0
    assert {r["k"]: r["cluster"] for r in birch.birch(df.where("k IS NOT NULL"), "k", ["a", "b"], 2).collect()} == {1: 0, 2: 0, 3: None, 4: None, 5: None}
    with pytest.raises(ConfigurationError):
        spanning.single_linkage(df, "k", ["a", "b"], None)


def plain_ward(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        c, n = np.array([x[g].mean(axis=0) for g in groups]), np.array([len(g) for g in groups], float)
        grow = ((c[:, None] - c[None]) ** 2).sum(axis=2) * np.multiply.outer(n, n) / np.add.outer(n, n)
        np.fill_diagonal(grow, np.inf)
        i, j = sorted(divmod(int(grow.argmin()), len(groups)))
        groups[i] += groups.pop(j)
    label = np.zeros(len(x), int)
    for g in groups:
        label[g] = min(g)
    return label.tolist()


def test_ward_against_a_plain_loop(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(0, 1, (60, 2)), r.normal(6, 0.5, (60, 2)), r.normal((-6, 5), 1, (60, 2))])
    for k in (3, 8):
        got = {r["k"]: r["cluster"] for r in birch.agglomerative(points(spark, x).repartition(3), "k", ["a", "b"], k).collect()}
        assert named([got[i] for i in range(len(x))]) == plain_ward(x, k)


def plain_leaves(x, threshold):
    """Leaf summaries of a tree that never splits: each row joins the nearest one if its radius allows."""
    leaves = []
    for row in x:
        if leaves:
            i = min(range(len(leaves)), key=lambda j: (((leaves[j][1] / leaves[j][0] - row) ** 2).sum(), j))
            n, total, squares = leaves[i][0] + 1, leaves[i][1] + row, leaves[i][2] + row @ row
            if squares / n - (total @ total) / n**2 <= threshold**2:
                leaves[i] = (n, total, squares)
                continue
        leaves.append((1, row, row @ row))
    return leaves


def test_birch_leaves_equal_a_plain_loop_on_one_partition(spark):
    x = np.random.default_rng(8).normal(0, 2, (200, 2))
    df = points(spark, x).coalesce(1).select(F.array("a", "b").alias("x"))
    got = birch.summarise(df, 2, 1.0, 200)
    want = plain_leaves(x, 1.0)
    assert got.n.tolist() == [n for n, _, _ in want]
    assert np.allclose(got.total, [t for _, t, _ in want])
    deep = birch.summarise(df, 2, 1.0, 4)
    assert deep.n.sum() == 200
    radius = deep.squares / deep.n - ((deep.total / deep.n[:, None]) ** 2).sum(axis=1)
    assert (radius <= 1.0 + 1e-9).all()


@pytest.mark.parametrize(("parts", "most"), [(1, 2000), (8, 2000), (40, 30), (1, 30)])
def test_birch_sums_do_not_depend_on_partitions(spark, parts, most):
    x = np.random.default_rng(9).normal(0, 2, (400, 2))
    got = birch.summarise(points(spark, x).repartition(parts).select(F.array("a", "b").alias("x")), 2, 0.3, 6, most)
    assert len(got.n) <= most
    assert got.n.sum() == 400
    assert np.allclose(got.total.sum(axis=0), x.sum(axis=0))
    assert np.isclose(got.squares.sum(), (x * x).sum())


def test_registered_hierarchical_models_separate_groups(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(0, 0.2, (50, 2)), r.normal(5, 0.2, (50, 2))])
    for name in ("birch", "agglomerative"):
        got = {r["k"]: r["cluster"] for r in models.cluster(points(spark, x), "k", name, 2).collect()}
        assert named([got[i] for i in range(100)]) == [0] * 50 + [50] * 50
    with pytest.raises(ConfigurationError):
        birch.Birch(threshold=-1.0).fit(points(spark, x).select(F.array("a", "b").alias("features")))


@pytest.mark.parametrize("at_once", [0, 1000])
def test_linked_equals_components(spark, at_once):
    from assayer.operators import graph

    r = np.random.default_rng(4)
    links = spark.createDataFrame([(int(a), int(b)) for a, b in r.integers(0, 150, (90, 2))] + [(7, None)], "a long, b long")
    want = {(x["id"], x["class"]) for x in graph.components(links).collect()}
    assert {(x["id"], x["class"]) for x in graph.linked(links, at_once).collect()} == want
