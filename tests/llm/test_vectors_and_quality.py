"""Centroids, hard negatives and text quality: plain loops, bounds, held-out labels and awkward rows."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.core import ConfigurationError
from assayer.llm import centroids, hard_negatives, quality_cnn, queries

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, label int, v string, id string, cluster int, score double, rank int"


def table(spark, rows):
    """(id, vector, label), with extra columns whose names the operators also use."""
    return spark.createDataFrame([(i, v, y, "x", "y", 7, 0.5, 3) for i, v, y in rows], VECTORS)


def drawn(n, dim, seed=0, spread=0.2):
    r = np.random.default_rng(seed)
    return [(i, [float(x) for x in r.normal(0, spread, dim).astype(np.float32)], int(r.integers(0, 3))) for i in range(n)]


# ---- centroids ----


def plain_clusters(rows, k, rounds, dim, scale, salt="3:"):
    """The contract in whole numbers, one row at a time."""
    kept = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, v, _ in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{salt}{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in order[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min(range(len(c)), key=lambda j: (square(v, c[j]), j))
    for _ in range(rounds):
        of = [near(v) for _, v in kept]
        c = [[sum(x) // len(own) for x in zip(*own, strict=True)] if (own := [v for (_, v), o in zip(kept, of, strict=True) if o == j]) else c[j] for j in range(len(c))]
    return sorted((i, near(v), min(square(v, c[near(v)]), 2**63 - 1)) for i, v in kept)


@pytest.mark.parametrize(("n", "k", "seed"), [(60, 8, 1), (5, 8, 2), (40, 1, 3)])
def test_centroids_against_a_loop(spark, n, k, seed):
    rows = drawn(n, 6, seed)
    rows += [(n + i, rows[i][1], 0) for i in range(3)]  # copies
    got = centroids.cluster(table(spark, rows), k=k, rounds=4, dim=6)
    found = sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got.collect())
    assert found == plain_clusters(rows, k, 4, 6, 1024)
    each = got.groupBy("cluster").agg(F.sum("distance").alias("s"), F.min("cluster_inertia").alias("a"), F.max("cluster_inertia").alias("b"), F.first("inertia").alias("t")).collect()
    assert all(r["s"] == r["a"] == r["b"] for r in each)
    assert {r["t"] for r in each} == {sum(r["s"] for r in each)}


def test_centroids_of_awkward_rows(spark):
    big = [3e38, -3e38, 1e30, 0.0, 1.0, -1.0]
    rows = [
        (1, None, 0), (2, [], 0), (3, [1.0] * 5, 0), (4, [1.0] * 7, 0), (5, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (6, [float("nan")] * 6, 0),
        (7, [float("inf")] * 6, 0), (8, [0.5] * 6, 0), (8, [0.5] * 6, 0), (9, big, 0), (10, [-x for x in big], 0), (11, [0.5] * 6, None),
    ]
    got = centroids.cluster(table(spark, rows), k=3, rounds=3, dim=6).collect()
    assert sorted(r["vec_id"] for r in got) == [8, 8, 9, 10, 11]
    assert all(0 <= r["distance"] < 2**63 and 0 <= r["inertia"] < 2**63 for r in got)
    assert len({r["cluster"] for r in got if r["vec_id"] in (8, 11)}) == 1
    none = [(None, [0.1] * 6, 0), (None, [0.9] * 6, 0)]
    assert [r["vec_id"] for r in centroids.cluster(table(spark, none), dim=6).collect()] == [None, None]
    empty = centroids.cluster(table(spark, []), dim=6)
    assert (empty.count(), empty.columns) == (0, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])
    with pytest.raises(ConfigurationError):
        centroids.cluster(table(spark, []), k=1 << 20)


@pytest.mark.parametrize("top", [3, 300, 1 << 15, 1 << 40, 1 << 62])
def test_intervals_hold_the_exact_value_and_ties_go_to_the_lowest_number(top):
    r = np.random.default_rng(top % 1000)
    x, c = r.integers(-top, top + 1, (200, 64)), r.integers(-top, top + 1, (9, 64))
    c[4] = c[2]
    x[:20] = c[2]
    low, high = centroids.intervals(x, c)
    exact = [[sum(int(b) ** 2 for b in q) - 2 * sum(int(a) * int(b) for a, b in zip(p, q, strict=True)) for q in c] for p in x]
    for i in range(len(x)):
        for j in range(len(c)):
            assert not (low[i, j] > exact[i][j] + 0.0 and low[i, j] != -np.inf), (i, j)
            assert int(low[i, j] // 1 if np.isfinite(low[i, j]) else -(10**60)) <= exact[i][j] <= (int(-(-high[i, j] // 1)) if np.isfinite(high[i, j]) else 10**60)
    want = [min(range(9), key=lambda j: (row[j], j)) for row in exact]
    assert centroids.assign(x, c).tolist() == want


# ---- hard negatives ----


def plain_negatives(rows, anchor, hundredths=(30, 90), positives=5, negatives=10):
    kept = [(i, [int(np.floor(float(np.float32(x)) * 256)) for x in v], y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v, y in kept:
        if not anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, w, z in kept if j != i and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scored if x[2] == y)[:positives]:
            inside = sorted(x for x in scored if x[2] != y and hundredths[0] * -s <= 100 * -x[0] <= hundredths[1] * -s)
            out += [(i, p, n, j, -s, -t) for n, (t, j, _) in enumerate(inside[:negatives], 1)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize(("cells", "block", "anchors"), [(64, 8192, 512), (4, 37, 5), (1, 50, 3), (256, 1000, 2)])
def test_hard_negatives_against_a_loop(spark, cells, block, anchors):
    rows = drawn(150, 5, 4, 0.6)
    rows += [(200 + i, rows[7][1], i % 3) for i in range(25)]  # many copies tie
    rows += [(300, [0.1] * 4, 1), (310, [0.1] * 4, 1), (320, [0.1] * 4, 2), (330, [0.0] * 5, 0)]
    got = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0, F.col("label"), block=block, anchor_block=anchors, cells=cells)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_hard_negatives_of_awkward_rows(spark):
    rows = [
        (10, None, 1), (20, [], 1), (30, [None, 1.0], 1), (40, [float("nan"), 1.0], 1), (50, [1.0, 1.0], None), (None, [1.0, 1.0], 1),
        (60, [1.0, 1.0], 1), (60, [1.0, 1.0], 1), (61, [1.0, 0.9], 1), (62, [0.5, 0.5], 2), (63, [0.5, 0.5], 2), (70, [3e38, 3e38], 1), (80, [-3e38, 1.0], 2),
    ]
    got = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0, F.col("label"), block=4, anchor_block=2)
    pairs = [(r["anchor_id"], r["positive_id"], r["negative_id"]) for r in got.collect()]
    assert pairs.count((60, 61, 62)) == 2  # the anchor is there twice
    assert all(a != p for a, p, _ in pairs)
    none = hard_negatives.mine(table(spark, []), F.lit(True), F.col("label"))
    assert (none.count(), none.columns) == (0, COLUMNS)
    lone = hard_negatives.mine(table(spark, [(1, [1.0], 1), (2, [1.0], 2)]), F.lit(True), F.col("label"))
    assert lone.count() == 0


def test_table_bounds_hold_the_score():
    r = np.random.default_rng(0)
    x, q = r.integers(-100, 100, (300, 8)), r.integers(-100, 100, (20, 8))
    edges = [np.array([-100, -20, 0, 5, 60, 100], object) for _ in range(8)]
    codes = np.array([np.searchsorted(e[1:-1].astype(int), x[:, j], side="right") for j, e in enumerate(edges)], np.uint8)
    low, high = hard_negatives.Approximation(q, edges, np.int32).bounds(codes)
    exact = q @ x.T
    assert (low <= exact).all()
    assert (exact <= high).all()
    for windows in ([(None, None)], [(100, 900), (-50, 400)]):
        may = set(hard_negatives.candidates(low[0], high[0], windows, 5).tolist())
        for least, most in windows:
            inside = [i for i in range(300) if (least is None or exact[0, i] >= least) and (most is None or exact[0, i] <= most)]
            assert set(sorted(inside, key=lambda i: (-exact[0, i], i))[:5]) <= may
    assert len(hard_negatives.candidates(low[0], high[0], [(None, None)], 5)) < 300


# ---- quality ----


def test_responses_cover_every_window_of_the_text():
    net = quality_cnn.Network.drawn(3)
    texts = [b"", b"a", b"abc " * 200, bytes(range(256)) * 5, "é".encode() * 400]
    symbols, starts, of = quality_cnn.laid_out(texts)
    top, _ = quality_cnn.chunk_maxima(net, symbols, starts)
    features, _, _ = quality_cnn.pooled(top, of, len(texts))
    for i, t in enumerate(texts):
        padded = np.concatenate((np.frombuffer(t, np.uint8), np.full(quality_cnn.WIDTH, quality_cnn.PAD)))
        seen = [net.weights["bytes"][padded[j : j + quality_cnn.WIDTH]].reshape(-1) @ net.weights["filters"] for j in range(len(t))]
        want = np.maximum(np.max(seen, axis=0), 0) if seen else np.zeros(quality_cnn.FILTERS)
        assert np.allclose(features[i, : quality_cnn.FILTERS], want, atol=1e-4)


def test_gradients_equal_differences():
    net = quality_cnn.Network.drawn(5)
    texts, y = [b"hello world " * 40, b"#### ### ##", b"abc"], np.array([1, 0, 1], np.float32)

    def loss():
        s = quality_cnn.scores(net, texts)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    made = quality_cnn.gradients(net, texts, y)
    for name, place in [("out", 3), ("hidden", (40, 2)), ("filters", (10, 4)), ("out_start", 0), ("hidden_start", 1)]:
        w = net.weights[name]
        before = w[place]
        w[place] = before + 1e-2
        up = loss()
        w[place] = before - 1e-2
        down = loss()
        w[place] = before
        assert abs((up - down) / 2e-2 - made[name][place]) < 2e-3 + 0.05 * abs(made[name][place]), name


def test_quality_of_held_out_documents(spark):
    rows = {r["doc_id"]: r for r in queries.op12_quality(spark, SF).collect()}
    docs = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert set(rows) == docs
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for i, r in rows.items())
    known = [(r["quality"], rows[r["doc_id"]]["score"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    good, bad = [s for y, s in known if y], [s for y, s in known if not y]
    area = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert area > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.97


def test_quality_of_awkward_rows(spark):
    docs = [(1, None), (2, ""), (3, "x"), (None, "ab"), (4, "é" * 40_000), (4, "other"), (5, "\x00\U0001f600")]
    frame = spark.createDataFrame([(i, t, 1, "a") for i, t in docs], "doc_id long, text string, score int, y string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for given in (none, labels.where("quality = 1")):
        net = quality_cnn.fit(frame, given)
        got = quality_cnn.judged(quality_cnn.quality(frame, net)).collect()
        assert len(got) == len(docs)
        assert len({r["score"] for r in got}) == 1
    net = quality_cnn.Network.drawn(1)
    scores = {(r["doc_id"], r["held_out"]): r["score"] for r in quality_cnn.judged(quality_cnn.quality(frame, net)).collect()}
    assert scores[1, zlib.crc32(b"1") % 5 == 0] == scores[2, zlib.crc32(b"2") % 5 == 0]
    assert (None, False) in scores
    assert quality_cnn.quality(frame.limit(0), net).count() == 0
    whole = quality_cnn.scores(net, ["é".encode() * 40_000])[0]
    assert scores[3, zlib.crc32(b"3") % 5 == 0] != whole
