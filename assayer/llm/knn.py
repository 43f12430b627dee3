"""Exact top-k search by a Voronoi kNN join on integer inner products.

Vectors are dealt to the nearest of a bounded number of pivots. Of each cell one
row of summaries is kept: count, largest distance from the pivot, and the lengths
that bound its scores. From the summaries every group of queries gets a score that
its k-th best must reach, and only the cells whose upper bound reaches it are
replicated to the group. Groups and cells are cut into blocks of bounded size, so
a hot cell is many tasks; equal vectors count once, with the smallest ids that
could ever be returned.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm._common import Scratch
from assayer.operators.graph import stored

SCALE = 256
BLOCK = 8192  # vectors in a block at most
MIN_PIVOTS, MAX_PIVOTS = 16, 256
CELL = 2048


def quantise(embedding: Column) -> Column:
    """floor(256 x) of each component, x as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def usable(embedding: Column) -> Column:
    return embedding.isNotNull() & ~F.exists(
        embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    )


def pivot_count(rows: int) -> int:
    """One for ``CELL`` vectors, between the two bounds: smaller cells cost more in pairs of blocks than their bounds save."""
    return max(MIN_PIVOTS, min(MAX_PIVOTS, rows // CELL))


def choose_pivots(data: DataFrame, n: int) -> np.ndarray:
    """n of the vectors, those of the lowest hash; at most MAX_PIVOTS, so they may be collected."""
    rows = data.select("v").orderBy(F.xxhash64("v"), "v").limit(min(n, MAX_PIVOTS)).collect()
    return np.unique(np.array([r["v"] for r in rows], dtype=np.float64), axis=0)


def deal(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add each vector's nearest pivot, ``cell``, and its distance from it."""
    held = rows.sparkSession.sparkContext.broadcast(pivots)
    kind = rows.schema["id"].dataType.simpleString()

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        half = (p * p).sum(1) / 2
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, p.shape[1]).astype(np.float64)
            cell = np.argmax(x @ p.T - half, axis=1) if len(x) else np.zeros(0, np.int64)
            far = np.sqrt(((x - p[cell]) ** 2).sum(1)) * (1 + 1e-9)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=["id", "v", "cell", "far"]
            )

    return rows.select("id", "v").mapInArrow(nearest, f"id {kind}, v array<bigint>, cell int, far double")


def blocks_of(dealt: DataFrame, sizes: dict[int, int], block: int) -> DataFrame:
    """Pack a cell's rows into blocks: ``cell``, ``salt``, ``ids`` and ``vectors`` (bytes).

    The salt is a hash of the row's id and vector, over as many values as the
    cell has blocks, so no group outgrows its block by much whatever its cell holds.
    """
    salts = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, -(-n // block))])
    kind = dealt.schema["id"].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table(
            {
                "cell": table.column("cell")[:1],
                "salt": table.column("salt")[:1],
                "ids": pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table.column("id").combine_chunks()),
                "vectors": pa.array([v.astype("<i8").tobytes()], pa.binary()),
            }
        )

    salted = dealt.select("id", "v", "cell", F.pmod(F.xxhash64("id", "v"), salts[F.col("cell")]).cast("int").alias("salt"))
    return salted.groupBy("cell", "salt").applyInArrow(pack, f"cell int, salt int, ids array<{kind}>, vectors binary")


def needed(pivots: np.ndarray, queries: dict[int, float], data: dict[int, tuple[int, float]], k: int) -> dict[int, list[int]]:
    """The data cells that each query cell has to see, from the summaries alone.

    With pivots p, q and radii r, s an inner product lies within
    r |q| + s |p| + r s of p.q; the cells of highest lower bound that together
    hold k + 1 rows give the score that a k-th best reaches.
    """
    norm = np.sqrt((pivots * pivots).sum(1))
    cells = sorted(data)
    count = np.array([data[c][0] for c in cells])
    radius = np.array([data[c][1] for c in cells])
    out = {}
    for g, r in queries.items():
        middle = pivots[cells] @ pivots[g]
        slack = r * norm[cells] + radius * norm[g] + r * radius
        low = middle - slack
        order = np.argsort(-low)
        enough = np.searchsorted(np.cumsum(count[order]), k + 1)
        reach = low[order[enough]] if enough < len(order) else -math.inf
        margin = 1e-6 * (1 + abs(reach)) if math.isfinite(reach) else 0
        out[g] = [c for c, m, e in zip(cells, middle, slack, strict=True) if m + e >= reach - margin]
    return out


def best_in_block(qi: pa.Array, q: np.ndarray, di: pa.Array, d: np.ndarray, k: int, exact: bool) -> tuple[np.ndarray, np.ndarray, list | np.ndarray]:
    """The k best of one data block for every query of a block: rows of q, rows of d and scores."""
    order = pc.sort_indices(di).to_numpy()  # ties go to the first
    coded = di.take(pa.array(order)).dictionary_encode()
    codes = coded.indices.to_numpy()
    own = pc.fill_null(pc.index_in(qi, coded.dictionary), -1).to_numpy()
    first, end = np.searchsorted(codes, own), np.searchsorted(codes, own, side="right")  # the query's own rows, if any
    if not exact:
        return best_of_wide(q, d[order], first, end, order, k)
    d = d[order].astype(np.float64)
    step = max(1, 4_000_000 // max(1, len(d)))
    found = []
    for at in range(0, len(q), step):
        scores = q[at : at + step].astype(np.float64) @ d.T
        for i in np.flatnonzero(end[at : at + step] > first[at : at + step]):
            scores[i, first[at + i] : end[at + i]] = -np.inf
        if len(d) > k:
            place = np.sort(np.argpartition(scores, len(d) - k, axis=1)[:, len(d) - k :], axis=1)
            cut = np.take_along_axis(scores, place, axis=1).min(axis=1)
            for i in np.flatnonzero((scores >= cut[:, None]).sum(axis=1) > k):  # ties at the cut
                near = np.flatnonzero(scores[i] >= cut[i])
                place[i] = np.sort(near[np.argsort(-scores[i, near], kind="stable")[:k]])
        else:
            place = np.broadcast_to(np.arange(len(d)), scores.shape)
        kept = np.take_along_axis(scores, place, axis=1)
        row, column = np.nonzero(np.isfinite(kept))
        found.append((at + row, order[place[row, column]], kept[row, column].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def best_of_wide(q: np.ndarray, d: np.ndarray, first: np.ndarray, end: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list]:
    """The same for components too long for doubles, in Python's whole numbers."""
    rows, places, out = [], [], []
    d = d.astype(object)
    for i, x in enumerate(q.astype(object)):
        scores = d @ x
        others = [j for j in range(len(d)) if not first[i] <= j < end[i]]
        for j in heapq.nsmallest(k, others, key=lambda j: (-scores[j], j)):
            rows.append(i)
            places.append(order[j])
            out.append(int(scores[j]))
    return np.array(rows, np.int64), np.array(places, np.int64), out


WIDEST = Decimal(10**38 - 1)


def bound(score: int, most: Decimal) -> Decimal:
    return max(-most, min(most, Decimal(score)))


def vector_hash(v: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(v.tobytes(), digest_size=8).digest(), "little", signed=True)


def search(rows: DataFrame, dim: int, k: int, block: int, tables: Scratch) -> DataFrame:
    """top_k for vectors of one length; ``rows`` has id, v and the flag q.

    The different vectors are stored, for they are read four times.
    """
    # Equal vectors score alike, so of each only the k + 1 smallest ids can be returned.
    by_id = Window.partitionBy("v").orderBy("id")
    data = rows.select("id", "v", F.dense_rank().over(by_id).alias("n")).where(F.col("n") <= k + 1)
    data = tables.put(data.select("id", "v").dropDuplicates(["v", "id"]))
    queries = rows.where("q").select("id", "v").dropDuplicates(["v", "id"])
    facts = data.agg(
        F.count("*").alias("n"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("top")
    ).first()
    exact = dim * int(facts["top"]) ** 2 < 2**53  # whole numbers are exact in doubles up to here
    pivots = choose_pivots(data, pivot_count(facts["n"]))
    data, queries = deal(data, pivots), deal(queries, pivots)
    summary = lambda df: {  # noqa: E731  at most MAX_PIVOTS rows
        r["cell"]: (r["n"], r["r"]) for r in df.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect()
    }
    of_data, of_queries = summary(data), summary(queries)
    pairs = needed(pivots, {c: r for c, (_, r) in of_queries.items()}, of_data, k)
    links = [(g, c, s) for g, cells in pairs.items() for c in cells for s in [-(-of_data[c][0] // block)]]
    spark = rows.sparkSession
    kind = rows.schema["id"].dataType.simpleString()
    left = blocks_of(queries, {c: n for c, (n, _) in of_queries.items()} or {0: 1}, block).select(
        F.col("cell").alias("from"), F.col("ids").alias("qi"), F.col("vectors").alias("qv")
    )
    link = spark.createDataFrame(links, "from int, cell int, salts int")  # at most MAX_PIVOTS squared
    right = blocks_of(data, {c: n for c, (n, _) in of_data.items()}, block)
    joined = (
        left.join(F.broadcast(link), "from")
        .select("qi", "qv", "cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        .join(right, ["cell", "salt"])
        .select("qi", "qv", "ids", "vectors")
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                qi, di = batch.column(0)[r].values, batch.column(2)[r].values
                q = np.frombuffer(batch.column(1)[r].as_py(), "<i8").reshape(-1, dim)
                d = np.frombuffer(batch.column(3)[r].as_py(), "<i8").reshape(-1, dim)
                of, at, scores = best_in_block(qi, q, di, d, k, exact)
                names = np.array([vector_hash(x) for x in q], np.int64)
                made = pa.array(scores, pa.int64()) if exact else pa.array([bound(x, WIDEST) for x in scores], pa.decimal128(38))
                yield pa.RecordBatch.from_arrays(
                    [qi.take(pa.array(of)), pa.array(names[of]), di.take(pa.array(at)), made],
                    names=["query_id", "qv", "vec_id", "score"],
                )

    number = "long" if exact else "decimal(38,0)"
    found = joined.mapInArrow(solve, f"query_id {kind}, qv long, vec_id {kind}, score {number}")
    ranked = Window.partitionBy("query_id", "qv").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).drop("qv")
    if exact:
        return best
    top, low = (F.lit(x).cast("decimal(38,0)") for x in (2**63 - 1, -(2**63)))
    return best.withColumn("score", F.least(top, F.greatest(low, "score")).cast("long"))  # ranked before it is clipped


def top_k(
    vectors: DataFrame,
    k: int,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block: int = BLOCK,
) -> DataFrame:
    """The k best scores of each query among all other rows.

    Returns ``query_id``, ``rank`` (int, from 1), the candidate's ``vec_id`` and
    the ``score`` (integer inner product of quantised vectors); ties go to the
    smaller id, and a query with fewer than k candidates gets all. Rows with a null
    id, or a vector that is null, empty or holds null or non-finite components,
    take no part; vectors are compared with those of their own length. Rows that
    repeat both id and vector count once; rows of a query's own id are never its
    candidates. Scores beyond 64 bits are clipped after ranking (38 digits count). No rows give no rows.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)) & (F.size(vector_col) > 0)).select(
        F.col(id_col).alias("id"), quantise(F.col(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    dims = [r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect()]  # the lengths in use, commonly one
    tables = Scratch(vectors.sparkSession, "top-k")
    parts = [search(rows.where(F.size("v") == d), d, k, block, tables) for d in sorted(dims)]
    if not parts:
        kind = rows.schema["id"].dataType.simpleString()
        parts = [vectors.sparkSession.createDataFrame([], f"query_id {kind}, vec_id {kind}, score long, rank int")]
    found = reduce(DataFrame.unionByName, parts).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    result = stored(found)
    tables.drop()
    return result


def oracle() -> str:
    """DuckDB SQL for the query over ``embeddings``."""
    return """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score
  FROM usable q JOIN usable d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
