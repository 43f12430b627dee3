"""Centroid clustering on whole-number vectors, exact at any size.

Lloyd's rounds over vectors whose components are floor(scale x). A round is one pass
without a shuffle of vectors: each task assigns its rows and sums them by cluster, and
one row a cluster and component reaches the driver. Assignment is screened by one
float32 matrix product; a rigorous bound on its rounding error gives every distance an
interval. A row whose lowest interval overlaps no other is settled; for the rest the
overlapping centroids are measured again in whole numbers, ties to the lowest number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.core import ConfigurationError
from assayer.llm._common import Scratch

SCALE = 1024
UNIT = 2.0**-24  # half the distance of neighbouring float32 numbers around 1
WIDEST = 2**63 - 1024  # components beyond are cut to it; the largest double below 2**63
MOST_NUMBERS = 1 << 24  # centroids times components: what the driver and each task hold


def packed(vectors: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """``id`` and ``v`` of the rows with exactly ``dim`` components, all finite: floor(scale x) as 64-bit whole numbers."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(1)), -1).to_numpy(zero_copy_only=False)
            fit = np.flatnonzero(lengths == dim)
            x = batch.column(1).take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fit), dim)
            good = np.isfinite(x).all(axis=1)  # nulls are NaN here
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(x[good] * scale), -float(WIDEST), float(WIDEST)).astype("<i8")
            ends = pa.py_buffer(np.arange(len(whole) + 1, dtype=np.int32) * (dim * 8))
            v = pa.Array.from_buffers(pa.binary(), len(whole), [None, ends, pa.py_buffer(whole.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(fit[good])), v], names=["id", "v"])

    source = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    return source.mapInArrow(pack, f"id {kind}, v binary")


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a batch of packed rows."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dim)


def largest(x: np.ndarray) -> int:
    return int(np.abs(x).max(initial=0))


def square_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows; Python's whole numbers where 64 bits do not hold them."""
    if x.shape[1] * (largest(x) + largest(c)) ** 2 >= 2**63:
        x, c = x.astype(object), c.astype(object)
    apart = x - c
    return (apart * apart).sum(axis=1)


def intervals(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of |c|^2 - 2 x.c, the squared distance without |x|^2, from one float32 product.

    With d terms in any order, each factor rounded once, |fl(x.c) - x.c| <= g |x| |c| for
    g = (d + 2) u / (1 - (d + 2) u); whole numbers do not underflow. The sums around
    it are in doubles, whose error the last term covers. Overflow gives infinite bounds.
    """
    d = x.shape[1]
    g = (d + 4) * UNIT / (1 - (d + 4) * UNIT)
    with np.errstate(over="ignore", invalid="ignore"):
        product = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    long = [np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9) for v in (x, c)]
    square = np.array([float(sum(int(i) ** 2 for i in row)) for row in c])
    slack = 2 * g * np.outer(long[0], long[1]) + 2.0**-50 * (square + 2 * np.abs(np.where(np.isfinite(product), product, 0.0)))
    known = np.isfinite(product)
    middle = square - 2 * np.where(known, product, 0.0)
    return np.where(known, middle - slack, -np.inf), np.where(known, middle + slack, np.inf)


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each row, ties to the lowest number."""
    if not len(x):
        return np.zeros(0, np.int64)
    low, high = intervals(x, c)
    near = low <= high.min(axis=1)[:, None]
    best = near.argmax(axis=1)
    open_rows = np.flatnonzero(near.sum(axis=1) > 1)
    if len(open_rows):
        row, number = np.nonzero(near[open_rows])  # by row, then by number
        exact = square_distances(x[open_rows[row]], c[number])
        first = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(exact, first)
        ties = np.flatnonzero(exact == np.repeat(least, np.diff(first, append=len(row))))
        best[open_rows] = number[ties[np.unique(row[ties], return_index=True)[1]]]
    return best


def summed(rows: DataFrame, c: np.ndarray) -> DataFrame:
    """``cluster``, ``place``, ``total`` and ``n``: component sums of the assigned rows, one row a task, cluster and component."""
    held, dim = rows.sparkSession.sparkContext.broadcast(c), c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        total, n = np.zeros(c.shape, object), np.zeros(len(c), np.int64)
        for batch in batches:
            x = rows_of(batch.column(0), dim)
            best = assign(x, c)
            order = np.argsort(best, kind="stable")
            met, first, count = np.unique(best[order], return_index=True, return_counts=True)
            if len(met):
                wide = len(x) * largest(x) >= 2**63
                total[met] += np.add.reduceat((x.astype(object) if wide else x)[order], first, axis=0).astype(object)
                n[met] += count
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(met, dim).astype(np.int32)),
                pa.array(np.tile(np.arange(dim, dtype=np.int32), len(met))),
                pa.array([Decimal(int(t)) for t in total[met].ravel()], pa.decimal128(38)),
                pa.array(np.repeat(n[met], dim)),
            ],
            names=["cluster", "place", "total", "n"],
        )

    parts = rows.select("v").mapInArrow(run, "cluster int, place int, total decimal(38,0), n long")
    return parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def assigned(rows: DataFrame, c: np.ndarray) -> DataFrame:
    """``id``, ``cluster`` and ``distance`` (squared, cut to 64 bits) of each packed row."""
    held, dim = rows.sparkSession.sparkContext.broadcast(c), c.shape[1]
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for batch in batches:
            x = rows_of(batch.column(1), dim)
            best = assign(x, c)
            far = square_distances(x, c[best])
            far = np.minimum(far, 2**63 - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best.astype(np.int32)), pa.array(far)], names=["id", "cluster", "distance"]
            )

    return rows.select("id", "v").mapInArrow(run, f"id {kind}, cluster int, distance long")


def seeds(rows: DataFrame, k: int, salt: str, dim: int) -> np.ndarray:
    """The k rows of least SHA-256 of salt and id, in its order; null ids last, equal ids by their bytes."""
    by_hash = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).asc_nulls_last()
    picked = rows.orderBy(by_hash, "v").limit(k).collect()
    return rows_of(pa.array([bytes(r["v"]) for r in picked], pa.binary()), dim)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    dim: int = 64,
    scale: int = SCALE,
    salt: str = "3:",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Cluster of each vector after so many rounds, with the centroids it belongs to.

    Returns the id, ``cluster`` (int), ``distance`` (long, squared), ``cluster_inertia`` and
    ``inertia`` (long, sums of distances) and ``centroid_sha256``. Vectors that are null, of
    another length, or hold null or non-finite components take no part. Rows that repeat an id
    or a vector each count; a null id is kept and seeds a centroid only after all others. With
    fewer than k rows there are as many centroids; a centroid without rows stays where it is. No rows give no
    rows. Components beyond 64 bits are cut to +-(2**63 - 1024), distances and their sums to 2**63 - 1.
    The packed rows and the result are tables in the shared folder; the former go when the latter is written.
    """
    if k < 1 or dim < 1 or k * dim > MOST_NUMBERS:
        raise ConfigurationError(f"k and dim must be positive, and k * dim at most {MOST_NUMBERS}")
    tables = Scratch(vectors.sparkSession, "centroids")
    rows = tables.put(packed(vectors, id_col, vector_col, dim, scale))
    centroids = seeds(rows, k, salt, dim)
    for _ in range(rounds if len(centroids) else 0):
        moved = centroids.copy()
        for r in summed(rows, centroids).collect():  # k * dim numbers at most
            moved[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
        if (moved == centroids).all():
            break  # no later round would move them
        centroids = moved
    found = tables.put(assigned(rows, centroids) if len(centroids) else rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")))
    tables.drop(0)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    most = 2**63 - 1
    facts = [(c, min(s, most), min(sum(sums.values()), most), digest(centroids[c])) for c, s in sums.items()]
    of_cluster = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of_cluster), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def oracle(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """DuckDB SQL for the query over ``embeddings``."""
    distance = f"list_sum(list_transform(range(1, {dim + 1}), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))"
    nearest = f"""SELECT vec_id, v, c, d FROM (
    SELECT x.vec_id, x.v, c.c, {distance} AS d, row_number() OVER (PARTITION BY x.vec_id ORDER BY d, c.c) AS r FROM kept x, {{of}} c
  ) WHERE r = 1"""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v, sha256('3:' || vec_id) AS h FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT * FROM kept ORDER BY h LIMIT {k}))",
    ]
    for i in range(1, rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED ({nearest.format(of=f'c{i - 1}')})")
        steps.append(f"""c{i} AS MATERIALIZED (
  SELECT c, list(m ORDER BY i) AS v FROM (
    SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS m FROM (
      SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, {dim + 1})) AS i FROM a{i}) GROUP BY c, i
    )
  ) GROUP BY c
  UNION ALL SELECT c, v FROM c{i - 1} WHERE c NOT IN (SELECT c FROM a{i})
)""")
    last = f"c{rounds}"
    return (
        "WITH "
        + ",\n".join([*steps, f"done AS MATERIALIZED ({nearest.format(of=last)})"])
        + f"""
SELECT d.vec_id, d.c::INTEGER AS cluster, d.d::BIGINT AS distance, (sum(d.d) OVER (PARTITION BY d.c))::BIGINT AS cluster_inertia,
  (sum(d.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM done d JOIN {last} k ON d.c = k.c
"""
    )
