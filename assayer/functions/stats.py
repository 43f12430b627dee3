"""Descriptive and bivariate statistics as aggregate expressions.

Every function takes columns of doubles without NaN and returns one aggregate
column; an undefined statistic is NULL. All are one pass and partially
aggregated unless their text says otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.core import DomainError
from assayer.operators.graph import stored

#: Units in which values are measured again where their powers leave the doubles.
UNITS = (2.0**300, 2.0**550, 2.0**800)
LARGER = UNITS[-1]


def within_doubles(c: Column) -> Column:
    """The number, or NULL if it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def scale_free(x: Column, f: Callable[[Column], Column]) -> Column:
    """A statistic that no unit changes, in the first unit that keeps its powers finite; what is tiny in a larger unit is 0 there."""
    measured = [x, *[F.when(F.abs(x) < F.lit(u * 1e-30), 0.0).otherwise(x / F.lit(u)) for u in UNITS]]
    return F.coalesce(*[within_doubles(f(v)) for v in measured])


def n(x: Column) -> Column:
    return F.count(x)


def omitted(x: Column) -> Column:
    return F.count_if(x.isNull())


def mean(x: Column) -> Column:
    """Mean that does not overflow: a sum beyond doubles is taken in quarters of the largest value."""
    top = F.max(F.abs(x))
    return F.when(F.abs(F.sum(x)) != float("inf"), F.avg(x)).otherwise(F.avg(x / F.lit(2.0**600)) * F.lit(2.0**600) + top * 0)


def spread(x: Column) -> Column:
    """max - min; NULL if it is no finite number."""
    return within_doubles(F.max(x) - F.min(x))


def sum_of_squares(x: Column) -> Column:
    """NULL if it is no finite number."""
    return within_doubles(F.sum(x * x))


def variance(x: Column, ddof: int = 1) -> Column:
    """NULL if it is no finite number."""
    count = F.count(x)
    return within_doubles(F.when(count > ddof, F.var_pop(x) * count / F.nullif(count - ddof, F.lit(0))))


def std(x: Column, ddof: int = 1) -> Column:
    """Finite also where the variance is not."""
    count = F.count(x)
    wide = F.stddev_pop(x / F.lit(LARGER)) * F.lit(LARGER) * F.sqrt(count / F.nullif(count - ddof, F.lit(0)))
    return F.coalesce(F.sqrt(variance(x, ddof)), within_doubles(F.when(count > ddof, wide)))


def geometric_mean(x: Column) -> Column:
    return F.when(F.min(x) > 0, F.exp(F.avg(F.when(x > 0, F.log(x)))))


def harmonic_mean(x: Column) -> Column:
    return F.when(F.min(x) > 0, F.count(x) / F.sum(F.when(x > 0, 1 / x)))


def rms(x: Column) -> Column:
    return F.coalesce(within_doubles(F.sqrt(F.avg(x * x))), within_doubles(F.sqrt(F.avg(F.pow(x / F.lit(LARGER), F.lit(2)))) * F.lit(LARGER)))


def percentile(x: Column, q: float | list[float]) -> Column:
    """Exact, linearly interpolated; its state is the distinct values, so see exact_quantiles for large tables."""
    return F.percentile(x, [v / 100 for v in q] if isinstance(q, list) else q / 100)


def skewness(x: Column, bias: bool = False) -> Column:
    count = F.count(x)
    varied = F.when((F.min(x) != F.max(x)) & (count >= (2 if bias else 3)), scale_free(x, F.skewness))
    return varied if bias else varied * F.sqrt(count * (count - 1)) / F.nullif(count - 2, F.lit(0))


def kurtosis(x: Column, bias: bool = False, fisher: bool = True) -> Column:
    c = F.count(x).cast("double")
    g2 = F.when((F.min(x) != F.max(x)) & (c >= (2 if bias else 4)), scale_free(x, F.kurtosis))
    k = g2 if bias else (c - 1) / F.nullif((c - 2) * (c - 3), F.lit(0.0)) * ((c + 1) * g2 + 6)
    return k if fisher else k + 3


def raw_moment(x: Column, k: int) -> Column:
    return F.avg(F.pow(x, F.lit(k)))


def moment_about(x: Column, k: int, origin: float) -> Column:
    return F.avg(F.pow(x - F.lit(float(origin)), F.lit(k)))


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(x * w) / F.nullif(F.sum(F.when(x.isNotNull(), w)), F.lit(0.0))


def covariance(x: Column, y: Column, ddof: int = 1) -> Column:
    """Over the rows where both are present; NULL if it is no finite number."""
    count = F.count_if(x.isNotNull() & y.isNotNull())
    return within_doubles(F.when(count > ddof, F.covar_pop(x, y) * count / F.nullif(count - ddof, F.lit(0))))


def pearson(x: Column, y: Column) -> Column:
    """NULL if either side is constant, fewer than two pairs are complete or a value is infinite.

    A correlation has no unit, so where squares leave the doubles a side is measured in a larger or a smaller one.
    """
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    plain = lambda u, v: within_doubles(F.covar_pop(u, v) / F.nullif(F.stddev_pop(u) * F.stddev_pop(v), F.lit(0.0)))
    big, small = F.lit(2.0**550), F.lit(2.0**-550)
    return F.coalesce(*[plain(a / u if u is not None else a, b / v if v is not None else b) for u in (None, big, small) for v in (None, big, small)])


def correlated(x: Column, y: Column) -> Column:
    """``pearson`` of columns that ``measured`` has put near 1: one unit serves."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return within_doubles(F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def measured(df: DataFrame, columns: dict[str, Column]) -> dict[str, Column]:
    """The columns in units of their largest magnitude where squares of that would leave the doubles; one aggregate of maxima decides.

    Units are powers of two, so no digit changes.
    """
    if not columns:
        return {}
    tops = df.agg(*[F.max(F.abs(c)).alias(f"t{i}") for i, c in enumerate(columns.values())]).first()
    out = {}
    for (name, c), top in zip(columns.items(), tops, strict=True):
        e = math.frexp(top)[1] if top and math.isfinite(top) else 0
        out[name] = c / F.lit(2.0 ** (e // 2)) / F.lit(2.0 ** (e - e // 2)) if abs(e) > 300 else c
    return out


def describe(x: Column) -> list[Column]:
    """Summary of one column; undefined entries are NULL."""
    quarter = percentile(x, [25.0, 50.0, 75.0])
    return [
        n(x).alias("count"), omitted(x).alias("omitted"), F.min(x).alias("min"), F.max(x).alias("max"), spread(x).alias("range"),
        mean(x).alias("mean"), variance(x).alias("variance"), std(x).alias("std"), quarter[0].alias("q1"), quarter[1].alias("median"),
        quarter[2].alias("q3"), within_doubles(quarter[2] - quarter[0]).alias("iqr"), skewness(x).alias("skewness"), kurtosis(x).alias("kurtosis"),
    ]


#: Rows up to which a quantile is one exact aggregate.
DIRECT = 1_000_000


def exact_quantiles(df: DataFrame, column: str, qs: list[float], direct: int = DIRECT) -> list[float | None]:
    """Exact interpolated quantiles (0 to 1) of one column at any size; see ``quantiles_of``."""
    return quantiles_of(df, {column: F.col(column).cast("double")}, qs, direct)[column]


def quantiles_of(df: DataFrame, columns: dict[str, Column], qs: list[float], direct: int = DIRECT) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles (0 to 1) of several columns at any size.

    Of a large table mergeable sketches bracket the two order statistics around each
    quantile, one aggregate counts what lies below and inside, and the brackets are
    narrowed until each is small enough for the exact aggregate. The columns share
    every pass. A column without values has NULLs.
    """
    if not columns:
        return {}
    x = df.select(*[c.alias(f"x{i}") for i, c in enumerate(columns.values())])
    totals = x.agg(*[F.count(f"x{i}") for i in range(len(columns))]).first()
    open_ = [Bracket(f"x{i}", q, q * (n - 1), None, None, 0, n) for i, n in enumerate(totals) if n for q in qs]
    everything = list(open_)
    while wide := [b for b in open_ if b.inside > direct]:
        narrow(x, wide)
        open_ = [b for b in wide if b.low != b.high and not b.settled]
    last = [b for b in everything if b.low is None or b.low != b.high]
    found = x.agg(*[F.percentile(b.values(), min(1.0, (b.want - b.below) / max(1, b.inside - 1))) for b in last]).first() if last else ()
    said = {(b.column, b.q): v for b, v in zip(last, found, strict=True)}
    said |= {(b.column, b.q): b.low for b in everything if (b.column, b.q) not in said}
    return {name: [said.get((f"x{i}", q)) for q in qs] for i, name in enumerate(columns)}


@dataclass
class Bracket:
    """Values of a column between low and high, among which the quantile's order statistics lie."""

    column: str
    q: float
    want: float
    low: float | None
    high: float | None
    below: int
    inside: int
    settled: bool = False

    def values(self) -> Column:
        c = F.col(self.column)
        return c if self.low is None else F.when(c.between(self.low, self.high), c)


def narrow(x: DataFrame, brackets: list[Bracket]) -> None:
    """One turn for all brackets: sketch, count, and take in the next value where interpolation needs it."""
    near = [[min(1.0, max(0.0, (b.want - b.below) / max(1, b.inside - 1) + d)) for d in (-0.001, 0.001)] for b in brackets]
    cuts = x.agg(*[F.percentile_approx(b.values(), n, 20_000) for b, n in zip(brackets, near, strict=True)]).first()
    parts = []
    for b, (low, high) in zip(brackets, cuts, strict=True):
        c = F.col(b.column)
        above = F.when(c > high, c)
        parts.append(F.struct(F.count_if(c < low), F.count_if(c.between(low, high)), F.min(above)))
    extra = []
    for b, (low, high), (under, within, following) in zip(brackets, cuts, x.agg(*parts).first(), strict=True):
        if not under <= b.want <= under + within:
            raise DomainError("the bracket lost its quantile")
        b.settled = (low, high) == (b.low, b.high)  # few values, often repeated: the exact aggregate is small
        b.low, b.high, b.below, b.inside = low, high, under, within
        if b.want > under + within - 1 and following is not None:  # the next order statistic lies outside
            b.high = following
            extra.append(b)
    if extra:
        for b, within in zip(extra, x.agg(*[F.count(b.values()) for b in extra]).first(), strict=True):
            b.inside = within


def mean_absolute_deviation(df: DataFrame, column: str, center: str = "mean") -> DataFrame:
    """Two passes: the centre is one row, joined to the rows."""
    x = F.col(column)
    middle = df.agg((F.avg(x) if center == "mean" else F.percentile(x, 0.5)).alias("__c"))
    return df.join(F.broadcast(middle)).agg(F.avg(F.abs(x - F.col("__c"))).alias("mean_absolute_deviation"))


def central_moment(df: DataFrame, column: str, k: int) -> DataFrame:
    x = F.col(column)
    return df.join(F.broadcast(df.agg(F.avg(x).alias("__c")))).agg(F.avg(F.pow(x - F.col("__c"), F.lit(k))).alias("central_moment"))


def z_scores(df: DataFrame, column: str, ddof: int = 0) -> DataFrame:
    """Add ``z``; NULL on a constant column."""
    x = F.col(column)
    one = df.agg(F.avg(x).alias("__m"), std(x, ddof).alias("__s"))
    return df.join(F.broadcast(one)).withColumn("z", (x - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0))).drop("__m", "__s")


def modes(df: DataFrame, column: str) -> DataFrame:
    """All modal values, ascending; none if every value occurs once."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    top = counts.agg(F.max("count").alias("top"))
    return counts.join(F.broadcast(top), F.col("count") == F.col("top")).where("top > 1").select("value", "count")


def running(df: DataFrame, by: list[str], *sums: str) -> DataFrame:
    """Add ``upto_<c>``: the sum of each column c over the rows up to this one by ``by``, NULLs first.

    Rows are ranged and stored, each range is summed on its own and shifted by what
    lies below it: only a row a range is ordered in one task.
    """
    parts = stored(df.repartitionByRange(*by).withColumn("__p", F.spark_partition_id()))
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("__p").agg(*[F.sum(c).alias(c) for c in sums])
    before = sizes.select("__p", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__b_{c}") for c in sums])
    inside = Window.partitionBy("__p").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    summed = parts.withColumns({f"upto_{c}": F.sum(c).over(inside) for c in sums}).join(F.broadcast(before), "__p")
    return summed.withColumns({f"upto_{c}": F.col(f"upto_{c}") + F.col(f"__b_{c}") for c in sums}).drop("__p", *[f"__b_{c}" for c in sums])


def ranked(df: DataFrame, column: str) -> DataFrame:
    """Average rank of each distinct value: ``value`` and ``rank``; no task sorts all values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return running(counts, ["value"], "n").select("value", (F.col("upto_n") - (F.col("n") - 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks over complete pairs."""
    both = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    rx, ry = ranked(both, "x"), ranked(both, "y")
    joined = (
        both.join(rx.select(F.col("value").alias("x"), F.col("rank").alias("a")), "x")
        .join(ry.select(F.col("value").alias("y"), F.col("rank").alias("b")), "y")
    )
    return joined.agg(correlated(F.col("a"), F.col("b")).alias("spearman"))


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Tau-b over complete pairs, exact and without joining rows to rows; NULL if a side is constant.

    The places of the distinct y are read as binary numbers. Two rows of different y
    part at one bit, so each pair is met once: at that bit, among the rows whose
    higher bits agree, where running counts by x say how many lie before. A row takes
    part once a bit, and the running counts are ranged.
    """
    pairs = stored(
        df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        .where("x IS NOT NULL AND y IS NOT NULL")
        .groupBy("x", "y")
        .agg(F.count("*").alias("n"))
    )
    none = df.sparkSession.createDataFrame([(None,)], "kendall double")
    total = pairs.agg(F.sum("n")).first()[0] or 0
    tie = lambda c: pairs.groupBy(c).agg(F.sum("n").cast("double").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2)).first()[0]
    if not total:
        return none
    places = running(pairs.select("y").distinct().withColumn("one", F.lit(1).cast("long")), ["y"], "one").select("y", (F.col("upto_one") - 1).alias("place"))
    bits = places.agg(F.max("place")).first()[0].bit_length()
    if not bits:
        return none
    split = pairs.join(places, "y").select("x", "n", "place", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    upper = F.expr("shiftright(place, bit) % 2 = 1")
    cells = split.groupBy("bit", F.expr("shiftright(place, bit + 1)").alias("prefix"), "x").agg(
        F.sum(F.when(upper, 0).otherwise(F.col("n"))).alias("low"), F.sum(F.when(upper, F.col("n")).otherwise(0)).alias("high")
    )
    before = lambda c: (F.col(f"upto_{c}") - F.col(c)).cast("double")
    ahead = lambda a, b: F.sum(F.col(b) * before(a)) - F.sum(b) * F.min(before(a))
    each = running(cells, ["bit", "prefix", "x"], "low", "high").groupBy("bit", "prefix").agg((ahead("low", "high") - ahead("high", "low")).alias("s"))
    score, all_pairs = each.agg(F.sum("s")).first()[0], total * (total - 1) / 2
    scale = ((all_pairs - tie("x")) * (all_pairs - tie("y"))) ** 0.5
    return df.sparkSession.createDataFrame([(score / scale if scale else None,)], "kendall double")
