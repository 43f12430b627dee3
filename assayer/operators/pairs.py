"""Correlations of many columns from a blocked Gram matrix, and what is read off them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer import core
from assayer.functions import stats
from assayer.operators.profile import quoted

BLOCK = 64  # columns of a block
MOST = 5_000  # columns of a redundancy filter: their pairs above the threshold are known to the driver one column at a time
SUMS = "a int, b int, n long, x double, y double, xx double, yy double, xy double"


def correlations(df: DataFrame, columns: list[str], block: int = BLOCK) -> DataFrame:
    """``x``, ``y``, ``n`` and ``r`` of each pair of columns, the earlier one first, over the rows where both are finite.

    The columns are cut into blocks, and each pair of blocks reads its own columns only. A task
    multiplies batches of rows as matrices and emits the sums of its pairs once, so an aggregate never
    holds more than a pair of blocks. Columns are centred and put in units of their spread
    first. ``r`` is NULL where a side is constant or fewer than two rows are complete.
    """
    if len(set(columns)) < len(columns):
        raise core.SchemaError("columns repeat")
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "x string, y string, n long, r double")
    unit = stats.measured(df, {c: core.finite(quoted(c)) for c in columns})
    facts = df.agg(*[F.struct(stats.within_doubles(F.avg(unit[c])), stats.within_doubles(F.stddev_pop(unit[c])), F.min(unit[c]), F.max(unit[c])).alias(f"f{i}") for i, c in enumerate(columns)]).first()
    ends = [(low, 1.0) if low == high else (m, s) for m, s, low, high in facts]  # one value is exactly its own centre
    scaled = {c: (unit[c] - F.lit(m or 0.0)) / F.lit(s or 1.0) for c, (m, s) in zip(columns, ends, strict=True)}
    blocks = [list(range(i, min(i + block, len(columns)))) for i in range(0, len(columns), block)]

    def of(first: list[int], second: list[int]) -> DataFrame:
        used = first + [i for i in second if i not in first]
        left, right = [used.index(i) for i in first], [used.index(i) for i in second]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((6, len(left), len(right)))
            for batch in batches:
                x = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns], float).reshape(len(used), batch.num_rows)
                known = np.isfinite(x).astype(float)
                x = np.where(known > 0, x, 0.0)
                a, b, ka, kb = x[left], x[right], known[left], known[right]
                total += np.array([ka @ kb.T, a @ kb.T, ka @ b.T, (a * a) @ kb.T, ka @ (b * b).T, a @ b.T])
            i, j = (v.ravel() for v in np.meshgrid(first, second, indexing="ij"))
            keep = i < j
            flat = total.reshape(6, -1)[:, keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(i[keep].astype(np.int32)), pa.array(j[keep].astype(np.int32)), pa.array(flat[0].astype(np.int64)), *[pa.array(v) for v in flat[1:]]],
                names=["a", "b", "n", "x", "y", "xx", "yy", "xy"],
            )

        return df.select(*[scaled[columns[i]].alias(f"x{i}") for i in used]).mapInArrow(run, SUMS)

    parts = [of(blocks[i], blocks[j]) for i in range(len(blocks)) for j in range(i, len(blocks))]
    sums = reduce(DataFrame.unionByName, parts).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    n = F.nullif(F.col("n"), F.lit(0))
    spread = lambda s, ss: F.col(ss) / n - (F.col(s) / n) * (F.col(s) / n)
    wide = lambda s, ss: F.when(spread(s, ss) > 1e-14 * F.greatest(F.lit(1e-300), F.col(ss) / n), spread(s, ss))
    r = (F.col("xy") / n - (F.col("x") / n) * (F.col("y") / n)) / F.sqrt(wide("x", "xx")) / F.sqrt(wide("y", "yy"))
    name = lambda c: F.element_at(F.array(*map(F.lit, columns)), F.col(c) + 1)
    return sums.select(name("a").alias("x"), name("b").alias("y"), F.col("n"), F.when((n >= 2) & r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))


def top_pairs(df: DataFrame, columns: list[str], k: int, block: int = BLOCK) -> DataFrame:
    """The k most correlated pairs: ``rank``, ``x``, ``y``, ``r``, by magnitude, then by names; pairs without a correlation are left out."""
    if k < 1:
        raise core.ConfigurationError("k must be at least 1")
    best = correlations(df, columns, block).where("r IS NOT NULL").orderBy(F.desc(F.round(F.abs("r"), 12)), "x", "y").limit(k)
    place = F.row_number().over(Window.orderBy(F.desc(F.round(F.abs("r"), 12)), "x", "y"))  # k rows
    return best.select(place.alias("rank"), "x", "y", "r")


def without_redundant(df: DataFrame, columns: list[str], threshold: float = 0.95, block: int = BLOCK) -> DataFrame:
    """``column``, ``kept`` and ``because``: columns in order of priority, each dropped if its correlation with a kept one reaches the threshold.

    ``because`` names the first kept column that says the same. Only pairs that reach the threshold leave the
    cluster, for at most ``MOST`` columns.
    """
    if not 0 < threshold <= 1:
        raise core.ConfigurationError("the threshold lies in (0, 1]")
    if len(columns) > MOST:
        raise core.LimitExceededError("columns", MOST, len(columns))
    place = {c: i for i, c in enumerate(columns)}
    close: dict[str, set[str]] = {}
    for r in correlations(df, columns, block).where(F.abs("r") >= threshold).select("x", "y").toLocalIterator():
        close.setdefault(r["x"], set()).add(r["y"])
        close.setdefault(r["y"], set()).add(r["x"])
    kept: list[str] = []
    rows = []
    for c in columns:
        why = min(close.get(c, set()) & set(kept), key=place.__getitem__, default=None)
        if why is None:
            kept.append(c)
        rows.append((c, why is None, why))
    return df.sparkSession.createDataFrame(rows, "column string, kept boolean, because string")
