"""Hard-negative mining through a vector-approximation file.

Every dimension is cut into cells of about equally many rows, and a row's approximation
is one byte a dimension. For an anchor the least and greatest product of its component
with each cell make two small tables; adding up looked-up entries bounds a row's score
from below and above. Only rows that may still be among the first of some window are
scored exactly. Anchors and rows are dealt to blocks; every block of anchors meets every
block of rows in a task of its own, and only the first few of each pair of blocks go on.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.core import ConfigurationError
from assayer.llm._common import Scratch
from assayer.llm.knn import quantise, usable

CELLS = 64  # in a dimension, 256 at most
BLOCK = 8192  # rows in a block
ANCHORS = 512  # anchors in a block
AT_ONCE = 64  # anchors and
ROWS_AT_ONCE = 1024  # rows whose bounds are added up together
HUNDREDTHS = (30, 90)  # of a positive's score: the window of its negatives


def cell_edges(rows: DataFrame, dim: int, cells: int) -> tuple[int, int, list[np.ndarray]]:
    """Number of rows, largest magnitude, and the least value of each cell of each dimension (with one past the greatest).

    One aggregate over all components; the edges only decide how tight bounds are.
    """
    shares = [i / cells for i in range(1, cells)] or [0.5]
    facts = (
        rows.select(F.posexplode("v").alias("place", "x")).groupBy("place")
        .agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.percentile_approx("x", shares, 1000).alias("inner"))
        .collect()
    )
    edges: list[np.ndarray] = [np.zeros(0)] * dim
    for r in facts:
        inner = {int(e) for e in r["inner"]} if cells > 1 else set()
        bounds = sorted({int(r["least"]), *inner}) + [int(r["most"]) + 1]
        edges[r["place"]] = np.array(bounds, object)
    top = max((max(abs(int(r["least"])), abs(int(r["most"]))) for r in facts), default=0)
    return (facts[0]["n"] if facts else 0), top, edges


def number_type(most: int) -> type:
    return np.int32 if most < 2**31 else np.int64 if most < 2**62 else object


def narrow(top: int) -> str:
    return "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8"


def blocks_of(rows: DataFrame, n: int, block: int, name: str, dtype: str, edges: list[np.ndarray] | None) -> DataFrame:
    """Pack rows into blocks, ordered by id: ``name``, ``ids``, ``labels``, ``vectors`` and, given edges, ``codes``.

    A row's block is its place in its partition, so blocks are even whatever repeats.
    """
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    inner = [e[1:-1].astype(np.int64) for e in edges] if edges is not None else None

    def pack(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table.column("id")))
        listed = lambda c: pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table.column(c).combine_chunks())
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        made = {name: table.column(name)[:1], "ids": listed("id"), "labels": listed("label"), "vectors": pa.array([x.astype(dtype).tobytes()], pa.binary())}
        if inner is not None:
            codes = np.array([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(inner)], np.uint8)
            made["codes"] = pa.array([codes.tobytes()], pa.binary())
        return pa.table(made)

    dealt = rows.select("id", "label", "v", F.pmod(F.monotonically_increasing_id(), F.lit(max(1, -(-n // block)))).cast("int").alias(name))
    schema = f"{name} int, ids array<{kind['id']}>, labels array<{kind['label']}>, vectors binary" + (", codes binary" if inner is not None else "")
    return dealt.groupBy(name).applyInArrow(pack, schema)


class Approximation:
    """Score bounds of rows, given by their cells, for a few anchors."""

    def __init__(self, anchors: np.ndarray, edges: list[np.ndarray], kind: type) -> None:
        self.low, self.high, self.kind = [], [], kind
        for j, e in enumerate(edges):
            q = anchors[:, j].astype(kind)
            ends = np.stack([np.multiply.outer(side.astype(kind), q) for side in (e[:-1], e[1:] - 1)])
            self.low.append(ends.min(axis=0))
            self.high.append(ends.max(axis=0))

    def bounds(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score, anchors by rows, of rows given as dimensions by rows of codes."""
        n = codes.shape[1]
        out = np.empty((2, self.low[0].shape[1], n), self.kind)
        for at in range(0, n, ROWS_AT_ONCE):
            part = codes[:, at : at + ROWS_AT_ONCE].astype(np.intp)
            for side, tables in enumerate((self.low, self.high)):
                total = tables[0].take(part[0], axis=0)
                for table, code in zip(tables[1:], part[1:], strict=True):
                    total += table.take(code, axis=0)
                out[side, :, at : at + ROWS_AT_ONCE] = total.T
        return out[0], out[1]


def candidates(low: np.ndarray, high: np.ndarray, windows: list[tuple[int | None, int | None]], k: int) -> np.ndarray:
    """Places that may be among the k highest scores inside one of the windows (both ends included, None is open)."""
    may = np.zeros(len(low), bool)
    for least, most in windows:
        inside, sure = np.ones(len(low), bool), np.ones(len(low), bool)
        if least is not None:
            inside &= high >= least
            sure &= low >= least
        if most is not None:
            inside &= low <= most
            sure &= high <= most
        reached = low[sure]
        if len(reached) > k:  # k rows inside score this much at least
            inside &= high >= np.sort(reached)[len(reached) - k]
        may |= inside
    return np.flatnonzero(may)


def first_of(x: np.ndarray, q: np.ndarray, places: np.ndarray, windows: list[tuple[int | None, int | None]], k: int, wide: bool) -> list[tuple[int, np.ndarray, list[int]]]:
    """Of each window the k best of the candidates, scored exactly: window, places, scores. Equal scores go to the lower place."""
    scores = x[places].astype(object) @ q.astype(object) if wide else x[places].astype(np.int64) @ q.astype(np.int64)
    out = []
    for number, (least, most) in enumerate(windows):
        inside = np.ones(len(places), bool)
        if least is not None:
            inside &= scores >= least
        if most is not None:
            inside &= scores <= most
        left = np.flatnonzero(inside)
        best = left[np.argsort(-scores[left], kind="stable")[:k]]
        if len(best):
            out.append((number, places[best], [int(s) for s in scores[best]]))
    return out


def meet(anchors: DataFrame, data: DataFrame, edges: list[np.ndarray], sizes: tuple[int, int], dim: int, dtype: str, top: int, k: int, same: bool, hundredths: tuple[int, int]) -> DataFrame:
    """Every block of anchors with every block of rows.

    ``same``: the k best of the anchor's own label, ``anchor``, ``found`` and ``score``. Else ``anchors``
    hold their positives, and of each the k best rows of other labels inside its window are returned.
    ``group`` and ``part`` number the anchor and its positive.
    """
    fields = {f.name: f.dataType for f in anchors.schema.fields}
    kind = fields["ids"].elementType.simpleString()
    most = 2 * dim * top * top
    number, wide = number_type(most), most >= 2**62
    score_type = "decimal(38,0)" if wide else "long"

    def solve(a: pa.Table, b: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("group", "part", "anchor", "found", "score", "positive", "positive_score")}
        if len(a) and len(b):
            a, b = a.slice(0, 1).combine_chunks(), b.slice(0, 1).combine_chunks()
            block = a.column("abl")[0].as_py()
            ai, di = (t.column("ids").combine_chunks().flatten() for t in (a, b))
            al, dl = (t.column("labels").combine_chunks().flatten() for t in (a, b))
            label = pa.chunked_array([al, dl]).combine_chunks().dictionary_encode().indices.to_numpy()
            own = pa.chunked_array([ai, di]).combine_chunks().dictionary_encode().indices.to_numpy()
            q = np.frombuffer(a.column("vectors")[0].as_py(), dtype).reshape(-1, dim)
            x = np.frombuffer(b.column("vectors")[0].as_py(), dtype).reshape(-1, dim)
            codes = np.frombuffer(b.column("codes")[0].as_py(), np.uint8).reshape(dim, -1)
            la, lb, oa, ob = label[: len(q)], label[len(q) :], own[: len(q)], own[len(q) :]
            ids_a, ids_b = ai.to_pylist(), di
            goals: list[list] = [[(None, None)]] * len(q)
            of: list[list] = [[None]] * len(q)
            if not same:
                goals, of = [[] for _ in q], [[] for _ in q]
                for p in a.column("positives")[0].as_py() or []:
                    s = int(p["score"])
                    goals[p["place"]].append((-(-hundredths[0] * s // 100), hundredths[1] * s // 100))
                    of[p["place"]].append((p["found"], p["score"]))
            order = np.argsort(la, kind="stable")
            groups = np.split(order, np.flatnonzero(np.diff(la[order])) + 1) if same else [order]
            for members in groups:
                rows = np.flatnonzero(lb == la[members[0]]) if same else np.arange(len(x))
                for at in range(0, len(members), AT_ONCE):
                    few = members[at : at + AT_ONCE]
                    few = few[[bool(goals[i]) for i in few]]
                    if not len(few) or not len(rows):
                        continue
                    low, high = Approximation(q[few], edges, number).bounds(codes[:, rows])
                    for n, i in enumerate(few):
                        allowed = ob[rows] != oa[i] if same else (lb != la[i]) & (ob != oa[i])
                        if not same:
                            allowed &= (high[n] >= min(g[0] for g in goals[i])) & (low[n] <= max(g[1] for g in goals[i]))
                        left = np.flatnonzero(allowed)
                        places = rows[left[candidates(low[n][left], high[n][left], goals[i], k)]]
                        for part, best, scores in first_of(x, q[i], places, goals[i], k, wide):
                            out["group"] += [block * (1 << 32) + int(i)] * len(best)
                            out["part"] += [part] * len(best)
                            out["anchor"] += [ids_a[i]] * len(best)
                            out["found"] += ids_b.take(pa.array(best)).to_pylist()
                            out["score"] += [Decimal(s) for s in scores] if wide else scores
                            if not same:
                                out["positive"] += [of[i][part][0]] * len(best)
                                out["positive_score"] += [of[i][part][1]] * len(best)
        ids, scores = fields["ids"], pa.decimal128(38) if wide else pa.int64()
        from pyspark.sql.pandas.types import to_arrow_type

        id_type = to_arrow_type(ids.elementType)
        types = {"group": pa.int64(), "part": pa.int32(), "anchor": id_type, "found": id_type, "score": scores, "positive": id_type, "positive_score": scores}
        return pa.table({c: pa.array(v, types[c]) for c, v in out.items() if not same or c not in ("positive", "positive_score")})

    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("blk", each(sizes[1]))
    right = data.withColumn("abl", each(sizes[0]))
    schema = f"group long, part int, anchor {kind}, found {kind}, score {score_type}" + ("" if same else f", positive {kind}, positive_score {score_type}")
    found = left.groupBy("abl", "blk").cogroup(right.groupBy("abl", "blk")).applyInArrow(solve, schema)
    place = F.row_number().over(Window.partitionBy("group", "part").orderBy(F.desc("score"), "found"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def mine_length(rows: DataFrame, dim: int, positives: int, negatives: int, hundredths: tuple[int, int], block: int, anchor_block: int, cells: int, tables: Scratch) -> DataFrame:
    """mine for vectors of one length."""
    n, top, edges = cell_edges(rows, dim, cells)
    asked = rows.where("a")
    some = asked.count()
    dtype = narrow(top)
    data = tables.put(blocks_of(rows, n, block, "blk", dtype, edges))
    anchors = tables.put(blocks_of(asked, some, anchor_block, "abl", dtype, None))
    sizes = (max(1, -(-some // anchor_block)), max(1, -(-n // block)))
    known = tables.put(meet(anchors, data, edges, sizes, dim, dtype, top, positives, True, hundredths))
    by_block = known.select(F.shiftright("group", 32).cast("int").alias("abl"), F.struct(F.expr("group & 4294967295").cast("int").alias("place"), "rank", "found", "score").alias("p"))
    held = by_block.groupBy("abl").agg(F.sort_array(F.collect_list("p")).alias("positives"))  # at most anchors of a block times positives
    found = meet(anchors.join(held, "abl"), data, edges, sizes, dim, dtype, top, negatives, False, hundredths)
    clip = lambda c: F.least(F.lit(2**63 - 1).cast("decimal(38,0)"), F.greatest(F.lit(-(2**63)).cast("decimal(38,0)"), F.col(c))).cast("long")
    exact = found.schema["score"].dataType.simpleString() == "bigint"
    score = (lambda c: F.col(c)) if exact else clip
    return found.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("found").alias("negative_id"), score("positive_score").alias("positive_score"), score("score").alias("negative_score"),
    )


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 10,
    hundredths: tuple[int, int] = HUNDREDTHS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block: int = BLOCK,
    anchor_block: int = ANCHORS,
    cells: int = CELLS,
) -> DataFrame:
    """Hard negatives of each anchor and positive, by integer inner products of floor(256 x).

    An anchor's positives are its best other rows of the same label. Of the rows of other labels whose
    hundredfold score lies between the two ``hundredths`` of the positive's score, both included, the best
    ``negatives`` are returned: ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``,
    ``positive_score`` and ``negative_score``; equal scores go to the smaller id, and a window with fewer
    rows gives all. Rows with a null id or label, or a vector that is null, empty or holds null or non-finite
    components, take no part; vectors are compared with those of their own length. A row that repeats
    counts each time, but rows of the anchor's own id are neither positives nor negatives. Scores
    beyond 64 bits are clipped after ranking. No rows, and anchors without positives, give no rows.
    """
    if not 1 <= cells <= 256 or positives < 1 or negatives < 1:
        raise ConfigurationError("cells must lie between 1 and 256, positives and negatives be at least 1")
    rows = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & usable(F.col(vector_col)) & (F.size(vector_col) > 0)).select(
        F.col(id_col).alias("id"), label.alias("label"), quantise(F.col(vector_col)).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("a")
    )
    dims = [r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect()]  # the lengths in use, commonly one
    tables = Scratch(vectors.sparkSession, "hard-negatives")
    parts = [mine_length(rows.where(F.size("v") == d), d, positives, negatives, hundredths, block, anchor_block, cells, tables) for d in sorted(dims)]
    if not parts:
        kind = rows.schema["id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, parts)


def oracle() -> str:
    """DuckDB SQL for the query over ``embeddings``."""
    return """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS same, list_dot_product(a.v, d.v)::BIGINT AS score
  FROM usable a JOIN usable d ON a.vec_id <> d.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), negatives AS (
  SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id
  WHERE NOT n.same AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""
