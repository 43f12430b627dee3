"""Feature preparation: fitted steps as column expressions over literals learned from training rows."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer import core
from assayer.functions import stats
from assayer.operators.profile import quoted
from assayer.operators.quality import NUMBER

SENTINEL = "__missing__"
LEVELS = 1_000  # one-hot levels of a column


@dataclass(frozen=True)
class Step:
    """What to do with one column: impute, then scale or encode."""

    column: str
    role: str  # numeric, categorical, ordinal, mapped, numeric_text, drop
    impute: str = "median"  # median, mean, most_frequent, sentinel or a constant
    scale: str = "none"  # none, standard, minmax, robust
    encode: str = "none"  # none, onehot
    order: tuple[str, ...] = ()
    mapping: dict[str, float] = field(default_factory=dict)
    default: float | None = None


def plan(df: DataFrame, target: str | None = None, profile: DataFrame | None = None, config: core.Config = core.Config()) -> list[Step]:
    """One step a feature; columns that a profile marks as constant, id-like or empty are dropped."""
    blocked: set[str] = set()
    if profile is not None:
        rows = profile.where("constant OR id_like OR count = 0 OR infinite > 0 OR high_cardinality").select("column").collect()
        blocked = {r[0] for r in rows}
    steps = []
    for c, k in core.kinds(df).items():
        if c == target:
            continue
        if c in blocked or k in (core.DATETIME, core.OTHER):
            steps.append(Step(c, "drop"))
        elif k in (core.NUMERIC, core.BOOLEAN):
            steps.append(Step(c, "numeric", scale="standard"))
        else:
            steps.append(Step(c, "categorical", impute="sentinel", encode="onehot"))
    return steps


def fingerprint(steps: list[Step]) -> str:
    return hashlib.sha256(json.dumps([vars(s) for s in steps], sort_keys=True).encode()).hexdigest()[:32]


@dataclass(frozen=True)
class Fitted:
    """Column expressions by output name, and the outputs of each input."""

    outputs: dict[str, Column]
    lineage: dict[str, list[str]]

    def transform(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        return df.select(*[quoted(c) for c in keep], *[e.alias(n) for n, e in self.outputs.items()])


def number(step: Step, df: DataFrame) -> Column:
    c = quoted(step.column)
    if step.role == "numeric_text":
        return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))
    if step.role == "ordinal":
        return F.nullif(F.array_position(F.array(*map(F.lit, step.order)), c.cast("string")) - 1, F.lit(-1)).cast("double")
    if step.role == "mapped":
        table = F.create_map(*[F.lit(x) for kv in step.mapping.items() for x in kv])
        return F.coalesce(F.try_element_at(table, c.cast("string")), F.lit(step.default)).cast("double")
    return F.nanvl(c.cast("double"), F.lit(None))


def fit(df: DataFrame, steps: list[Step]) -> Fitted:
    """Learn all numeric statistics in one aggregate, quartiles in shared passes and all levels in one grouped pass."""
    numeric = [s for s in steps if s.role in ("numeric", "numeric_text", "ordinal", "mapped")]
    words = [s for s in steps if s.role == "categorical"]
    learned: dict[str, tuple] = {}
    if numeric:
        quarters = stats.quantiles_of(df, {s.column: number(s, df) for s in numeric}, [0.25, 0.5, 0.75])
        row = df.agg(
            *[
                F.struct(
                    F.count(x := number(s, df)), F.array(*[F.lit(q).cast("double") for q in quarters[s.column]]), F.avg(x), F.stddev_pop(x), F.min(x), F.max(x),
                    F.count_if(F.abs(x) == float("inf")), F.count_if(x.isNull() & quoted(s.column).isNotNull()),
                ).alias(f"s{i}")
                for i, s in enumerate(numeric)
            ]
        ).first()
        learned = {s.column: tuple(row[i]) for i, s in enumerate(numeric)}
    levels: dict[str, list[tuple[str, int]]] = {}
    if words:
        cells = df.select(F.explode(F.array(*[F.struct(F.lit(s.column).alias("c"), quoted(s.column).cast("string").alias("v")) for s in words])).alias("x")).select("x.*")
        counts = cells.where("v IS NOT NULL").groupBy("c", "v").count()
        over = counts.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") > LEVELS).collect()
        if over:
            raise core.PreprocessingError(f"more than {LEVELS} levels: {sorted(r['c'] for r in over)}")
        for r in counts.collect():  # at most LEVELS rows a column
            levels.setdefault(r["c"], []).append((r["v"], r["count"]))
    outputs: dict[str, Column] = {}
    lineage: dict[str, list[str]] = {s.column: [] for s in steps}

    def put(source: str, name: str, value: Column) -> None:
        while name in outputs:
            name += "_"
        outputs[name] = value
        lineage[source].append(name)

    for s in steps:
        if s.role == "drop":
            continue
        if s.role == "categorical":
            found = sorted(levels.get(s.column, []))
            if not found:
                raise core.PreprocessingError(f"{s.column} has no values")
            sentinel = SENTINEL
            while any(v == sentinel for v, _ in found):
                sentinel += "_"
            common = min(found, key=lambda x: (-x[1], x[0]))[0]
            fill = common if s.impute == "most_frequent" else sentinel if s.impute == "sentinel" else s.impute
            value = F.coalesce(quoted(s.column).cast("string"), F.lit(fill))
            if s.encode != "onehot":
                put(s.column, s.column, value)
                continue
            for v in sorted({v for v, _ in found} | ({sentinel} if s.impute == "sentinel" else set())):
                put(s.column, f"{s.column}={v}", (value == v).cast("double"))
            continue
        count, (q1, q2, q3), mean, sigma, low, high, infinite, unread = learned[s.column]
        if infinite:
            raise core.NonFiniteValueError(s.column)
        if not count:
            raise core.PreprocessingError(f"{s.column} has no values")
        if s.role in ("ordinal", "mapped") and unread and s.default is None:
            raise core.PreprocessingError(f"{s.column} has {unread} values outside its order or mapping")
        fill = {"median": q2, "mean": mean}.get(s.impute, None)
        x = F.coalesce(number(s, df), F.lit(float(s.impute) if fill is None else fill))
        shift, scale = {"standard": (mean, sigma), "minmax": (low, high - low), "robust": (q2, q3 - q1)}.get(s.scale, (0.0, 1.0))
        put(s.column, s.column, (x - F.lit(shift)) / F.lit(scale or 1.0))
    return Fitted(outputs, lineage)
