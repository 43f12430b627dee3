"""Which charts of a table are worth drawing, why, in which order, and the data of each.

A plan is a table of its own: charts are rows that rules over the profile and the findings
make, scored and thinned by expressions. The table itself is read for the profile, the
findings and at most two aggregates of correlations, whose columns are shortlisted from the
profile first. So the plan's size follows from the number of columns, not of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer import core
from assayer.operators import charts, frequency, pairs, quality
from assayer.operators import profile as profiles
from assayer.operators import target as targets
from assayer.operators.graph import stored
from assayer.operators.profile import quoted

# The priority of each chart before anything is known of its columns.
BASE = {
    "target_distribution": 0.90,
    "missing_values": 0.75,
    "correlation_heatmap": 0.65,
    "grouped_box": 0.60,
    "grouped_bar": 0.60,
    "scatter": 0.55,
    "histogram": 0.50,
    "bar": 0.45,
    "box_plot": 0.40,
}
WHOLE_TABLE = ("missing_values", "correlation_heatmap")
PLAN = "chart string, columns array<string>, code string, strength double, requires_review boolean, kept boolean"


class ChartRequestError(core.AssayError): ...


@dataclass(frozen=True)
class Weights:
    """What is added to, or taken from, a chart's priority."""

    target_relevance: float = 0.30
    statistical_evidence: float = 0.25
    quality_relevance: float = 0.20
    leakage_review: float = 0.15
    near_constant_penalty: float = 0.35
    high_cardinality_penalty: float = 0.15
    missing_penalty: float = 0.20
    readability_penalty: float = 0.10

    def __post_init__(self) -> None:
        if bad := [f.name for f in fields(self) if not getattr(self, f.name) >= 0]:
            raise core.ConfigurationError(f"{bad[0]} must not be negative")


@dataclass(frozen=True)
class Budget:
    """How much a plan may hold; all but the last two numbers are at least 1."""

    charts: int = 10
    points: int = 10_000
    categories: int = 20
    pair_columns: int = 8
    target_columns: int = 50
    least_heatmap: int = 3
    most_heatmap: int = 15
    pair_charts: int = 3
    least_rows: int = 10
    weights: Weights = field(default_factory=Weights)

    def __post_init__(self) -> None:
        for f in fields(self)[:-1]:
            if getattr(self, f.name) < (0 if f.name in ("pair_charts", "least_rows") else 1):
                raise core.ConfigurationError(f"{f.name} is too small")
        if not 2 <= self.least_heatmap <= self.most_heatmap:
            raise core.ConfigurationError("a heatmap has at least 2 columns, and no fewer at most")


def blocked(budget: Budget) -> Column:
    """Why a column of the profile gets no chart by itself; NULL if it does."""
    return (
        F.when(F.col("constant"), "constant_column")
        .when(F.col("id_like"), "possible_id_like")
        .when(F.col("count") < budget.least_rows, "too_few_observations")
        .when(F.col("kind").isin(core.DATETIME, core.OTHER), "unsupported_column_kind")
    )


def entry(chart: str | Column, columns: Column, code: str | Column, kept: bool = True, review: bool | Column = False, strength: Column | None = None) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_column(chart).alias("chart"), columns.alias("columns"), as_column(code).alias("code"),
        (F.lit(None) if strength is None else strength).cast("double").alias("strength"), as_column(review).alias("requires_review"), F.lit(kept).alias("kept"),
    )


def by_column(cells: DataFrame, budget: Budget) -> DataFrame:
    """Charts of single columns, and what keeps a column from having them."""
    own = F.array("column")
    numeric = F.col("kind") == core.NUMERIC
    free = F.col("blocked").isNull()
    spread = ~F.col("near_constant") & (F.coalesce("iqr", F.lit(0.0)) > 0)
    box = (
        F.when(F.col("outliers"), entry("box_plot", own, "flagged_outlier_candidates", review=True))
        .when(spread, entry("box_plot", own, "numeric_spread"))
        .otherwise(entry("box_plot", own, "no_meaningful_spread", kept=False))
    )
    made = F.array(
        F.when(~free, entry(F.when(numeric, "histogram").otherwise("bar"), own, F.col("blocked"), kept=False)),
        F.when(free & numeric, entry("histogram", own, "numeric_distribution")),
        F.when(free & numeric, box),
        F.when(free & ~numeric, entry("bar", own, "categorical_frequency")),
    )
    return cells.where("feature").select(F.inline(F.filter(made, lambda e: e.isNotNull())))


def shortlist(cells: DataFrame, most: int) -> list[str]:
    """Names of at most ``most`` columns: those with more distinct and fewer missing values; in the table's order if all fit."""
    best = cells.orderBy(F.desc("unique"), "missing_ratio", "column").limit(most + 1).select("column", "place").collect()
    return [r["column"] for r in (best[:most] if len(best) > most else sorted(best, key=lambda r: r["place"]))]


def whole_table(cells: DataFrame, numeric: DataFrame, budget: Budget) -> DataFrame:
    """The view of missing values and the heatmap, or why there is none."""
    gaps = F.sort_array(F.collect_list(F.when(F.col("missing") > 0, F.struct("place", "column")))).getField("column")
    found = F.when(F.size("gaps") > 0, entry("missing_values", F.col("gaps"), "dataset_has_missing_values")).otherwise(
        entry("missing_values", F.col("gaps"), "no_missing_values", kept=False)
    )
    names = shortlist(numeric, budget.most_heatmap)
    enough = len(names) >= budget.least_heatmap
    matrix = entry("correlation_heatmap", F.array(*map(F.lit, names)).cast("array<string>"), "numeric_correlation_overview" if enough else "too_few_numeric_columns", kept=enough)
    return cells.agg(gaps.alias("gaps")).select(F.inline(F.array(found, matrix)))


def against_target(df: DataFrame, cells: DataFrame, goal: str, facts: targets.TargetProfile, budget: Budget) -> DataFrame:
    """The target's own chart, and a bounded number of features beside it: the most correlated numbers, labels under suspicion first."""
    classes = facts.task == "classification"
    usable = cells.where("feature AND blocked IS NULL")
    numbers = shortlist(usable.where(F.col("kind") == core.NUMERIC), budget.target_columns)
    orderable = not classes or (facts.classes == 2 and core.kinds(df)[goal] in (core.NUMERIC, core.BOOLEAN))
    # Codes of three classes or more are names: a correlation with them says nothing.
    r = charts.target_associations(df, goal, numbers) if numbers and orderable else df.sparkSession.createDataFrame([], "column string, r double")
    names = df.sparkSession.createDataFrame([(n,) for n in numbers], "column string")
    near = names.join(r, "column", "left").orderBy(F.desc(F.round(F.coalesce("r", F.lit(0.0)), 12)), "column").limit(budget.pair_columns)
    labels = usable.where(F.col("kind").isin(core.CATEGORICAL, core.BOOLEAN) & (F.col("unique") <= budget.categories))
    labels = labels.orderBy(F.desc("leaks"), "missing_ratio", "column").limit(budget.pair_columns)
    both = F.array(F.col("column"), F.lit(goal))
    said = lambda code: F.when(F.col("leaks"), "possible_target_leakage_review").otherwise(code)
    number = entry("grouped_box" if classes else "scatter", both, said("numeric_against_target"), review=F.col("leaks"), strength=F.col("r"))
    label = entry("grouped_bar" if classes else "grouped_box", both, said("categorical_against_target"), review=F.col("leaks"))
    own = df.sparkSession.range(1).select(F.inline(F.array(entry("target_distribution", F.array(F.lit(goal)), "target_distribution"))))
    return own.unionByName(near.join(cells.select("column", "leaks"), "column").select(F.inline(F.array(number)))).unionByName(labels.select(F.inline(F.array(label))))


def feature_pairs(df: DataFrame, numeric: DataFrame, budget: Budget) -> DataFrame | None:
    """Scatter charts of the most correlated pairs among the shortlisted numbers."""
    names = shortlist(numeric, budget.pair_columns)
    if budget.pair_charts == 0 or len(names) < 2:
        return None
    r = pairs.correlations(df, names).where("r IS NOT NULL").select("x", "y", F.abs("r").alias("r"))
    best = r.orderBy(F.desc(F.round("r", 12)), "x", "y").limit(budget.pair_charts)
    return best.select(F.inline(F.array(entry("scatter", F.array("x", "y"), "numeric_pair_association", strength=F.col("r")))))


def score(cells: DataFrame, goal: str | None, budget: Budget) -> Column:
    """Priority of a chart beside ``one`` and ``two``, the cells of its first two columns."""
    w = budget.weights
    chart, code = F.col("chart"), F.col("code")
    given = lambda when, value: F.when(when, value).otherwise(0.0)
    base = F.element_at(F.create_map(*[F.lit(v) for kv in BASE.items() for v in kv]), chart)
    quality_says = (chart == "missing_values") | (code == "flagged_outlier_candidates") | ((chart == "target_distribution") & F.coalesce("one.imbalanced", F.lit(False)))
    penalties = F.lit(0.0)
    for c in ("one", "two"):
        feature = F.col(f"{c}.column").isNotNull() & (F.lit(True) if goal is None else F.col(f"{c}.column") != goal)
        of_column = (
            given(F.col(f"{c}.near_constant"), w.near_constant_penalty) + given(F.col(f"{c}.high_cardinality"), w.high_cardinality_penalty)
            + w.missing_penalty * F.coalesce(f"{c}.missing_ratio", F.lit(0.0))
        )
        penalties += given(feature & ~chart.isin(*WHOLE_TABLE), of_column)
    crowd = F.least(F.lit(1.0), F.col("one.unique") / budget.categories)
    crowded = chart.isin("bar", "grouped_bar") & (F.col("one.unique") > 1) & (crowd > 0.5)
    return F.round(
        base + (F.lit(0.0) if goal is None else given(F.array_contains("columns", goal), w.target_relevance))
        + w.statistical_evidence * F.coalesce("strength", F.lit(0.0)) + given(quality_says, w.quality_relevance)
        + given(code == "possible_target_leakage_review", w.leakage_review) - penalties - given(crowded, w.readability_penalty * crowd),
        6,
    )


def thinned(scored: DataFrame, most: int) -> DataFrame:
    """Ranks the charts and sets aside what repeats another or exceeds ``most``.

    A chart repeats one of its kind over the same columns (of a scatter in any order). A box of a column
    whose distribution is shown already is kept only for flagged outliers.
    """
    order = [F.desc("score"), F.col("chart"), F.col("columns")]
    same = F.when(F.col("chart") == "scatter", F.array_sort("columns")).otherwise(F.col("columns"))
    repeats = F.row_number().over(Window.partitionBy("chart", same).orderBy(*order)) > 1
    view = F.col("chart").isin("histogram", "box_plot")
    later = F.row_number().over(Window.partitionBy(view, F.col("columns")[0]).orderBy(*order)) > 1
    seen = (F.col("chart") == "box_plot") & (F.col("code") != "flagged_outlier_candidates") & later
    why = F.when(repeats, "duplicate_chart").when(seen, "redundant_distribution_view")
    judged = scored.withColumn("why", why)
    # Charts are some for each column of the table, so one task orders them.
    ranked = judged.where("why IS NULL").withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    over = F.col("rank") > most
    kept = ranked.withColumn("why", F.when(over, "over_max_charts")).withColumn("rank", F.when(~over, F.col("rank")))
    return kept.unionByName(judged.where("why IS NOT NULL").withColumn("rank", F.lit(None).cast("int")))


def recommend(
    df: DataFrame,
    order: str,
    target: str | None = None,
    identifier: str | None = None,
    config: core.Config = core.Config(),
    budget: Budget = Budget(),
    profile: DataFrame | None = None,
    findings: DataFrame | None = None,
) -> DataFrame:
    """The plan: ``rank`` (NULL if set aside), ``chart``, ``columns``, ``code``, ``score``, ``strength`` and ``requires_review``.

    ``code`` says why a chart was chosen, or of those set aside why not (these have a score only if they were
    candidates). ``strength`` is an absolute correlation where one was measured; no other chart earns evidence.
    ``profile`` and ``findings`` of the same table are computed if not given. An empty table gives reasons only;
    a target without values, or whose task its values do not tell, is refused.
    """
    df = core.normalize(df)
    for name in (target, identifier):
        if name is not None and name not in df.columns:
            raise core.SchemaError(f"there is no column {name}")
    profile = profiles.profile(df, order, config) if profile is None else profile
    findings = quality.inspect(df, order, target, config) if findings is None else findings
    flags = findings.where("column IS NOT NULL").groupBy("column").agg(
        F.bool_or(F.col("code") == "possible_outliers").alias("outliers"), F.bool_or(F.col("code") == "possible_target_leakage").alias("leaks"),
        F.bool_or(F.col("code") == "class_imbalance").alias("imbalanced"),
    )
    off = F.lit(False)
    place = F.element_at(F.create_map(*[F.lit(v) for i, c in enumerate(df.columns) for v in (c, i)]), F.col("column"))
    flag = lambda c: F.coalesce(c, off)
    cells = stored(
        profile.join(flags, "column", "left").select(
            "column", "kind", "count", "missing", "unique", "iqr", F.coalesce("missing_ratio", F.lit(0.0)).alias("missing_ratio"),
            *[flag(c).alias(c) for c in ("constant", "near_constant", "high_cardinality", "id_like", "outliers", "leaks", "imbalanced")],
            (~F.col("column").isin([c for c in (target, identifier) if c is not None])).alias("feature"), place.alias("place"),
        ).withColumn("blocked", blocked(budget))
    )
    numeric = cells.where((F.col("kind") == core.NUMERIC) & F.col("blocked").isNull() & ~F.col("near_constant"))
    in_matrix = numeric if target is None else numeric.where(F.col("column") != target)
    made = [whole_table(cells, in_matrix, budget), by_column(cells, budget)]
    if target is not None:
        made.append(against_target(df, cells, target, targets.detect(df, target, config=config), budget))
    if (more := feature_pairs(df, numeric.where("feature"), budget)) is not None:
        made.append(more)
    plan = made[0]
    for part in made[1:]:
        plan = plan.unionByName(part)
    side = cells.select("column", F.struct("column", "near_constant", "high_cardinality", "missing_ratio", "unique", "imbalanced").alias("cell"))
    beside = stored(plan)
    for i, name in enumerate(("one", "two")):
        of = side.select(F.col("column").alias("__c"), F.col("cell").alias(name))
        beside = beside.join(of, F.get("columns", F.lit(i)) == F.col("__c"), "left").drop("__c")
    scored = beside.where("kept").withColumn("score", score(cells, target, budget))
    shown = [F.col("rank"), F.col("chart"), F.col("columns"), F.coalesce("why", "code").alias("code"), F.col("score"), F.col("strength"), F.col("requires_review")]
    dropped = beside.where("NOT kept").select(
        F.lit(None).cast("int").alias("rank"), "chart", "columns", "code", F.lit(None).cast("double").alias("score"), "strength", "requires_review"
    )
    return thinned(scored, budget.charts).select(*shown).unionByName(dropped)


def wanted(df: DataFrame, chart: str, columns: list[str]) -> None:
    """Refuses a chart whose columns cannot carry it."""
    kinds = core.kinds(df)
    if absent := [c for c in columns if c not in kinds]:
        raise core.SchemaError(f"there is no column {absent[0]}")
    number = lambda c: kinds[c] == core.NUMERIC
    label = lambda c: kinds[c] in (core.CATEGORICAL, core.BOOLEAN)
    rules = {
        "histogram": (1, [number]), "box_plot": (1, [number]), "bar": (1, [label]), "scatter": (2, [number, number]),
        "grouped_bar": (2, []), "grouped_box": (2, []), "target_distribution": (1, []), "missing_values": (None, []), "correlation_heatmap": (None, []),
    }
    if chart not in rules:
        raise ChartRequestError(f"there is no chart {chart}")
    size, checks = rules[chart]
    if size is not None and len(columns) != size:
        raise ChartRequestError(f"a {chart} has {size} column(s)")
    for check, c in zip(checks, columns, strict=False):
        if not check(c):
            raise ChartRequestError(f"a {chart} cannot show {c}, which is {kinds[c]}")
    if chart == "scatter" and columns[0] == columns[1]:
        raise ChartRequestError("a scatter needs two different columns")
    if chart == "grouped_box" and not any(map(number, columns)):
        raise ChartRequestError("a grouped box needs a numeric column")
    if chart == "correlation_heatmap" and (len(set(columns)) < 2 or not all(map(number, columns))):
        raise ChartRequestError("a heatmap needs two numeric columns or more")


def matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """``x``, ``y`` and ``r`` of all pairs both ways round, 1 of each column with itself; from the blocked Gram matrix."""
    half = pairs.correlations(df, columns).select("x", "y", "r")
    own = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "x string, y string, r double")
    return half.unionByName(half.select(F.col("y").alias("x"), F.col("x").alias("y"), "r")).unionByName(own)


def largest_groups(df: DataFrame, group: str, k: int) -> DataFrame:
    """The rows of the k most frequent values of ``group``, ties by value."""
    top = df.where(quoted(group).isNotNull()).groupBy(quoted(group).alias("__g")).count().orderBy(F.desc("count"), "__g").limit(k).select("__g")
    return df.join(F.broadcast(top), quoted(group) == F.col("__g"), "left_semi")


def data_of(df: DataFrame, key: str, chart: str, columns: list[str], task: str | None = None, budget: Budget = Budget()) -> DataFrame:
    """The data of one chart, of a plan or by request; ``key`` decides which points a scatter shows.

    Histograms, boxes and bars are aggregates of all rows, so only a scatter is sampled (``budget.points``). A
    grouped box shows its numeric column by the other one (by the second where both are numeric) and keeps the
    ``budget.categories`` largest groups; a target is shown by bars unless ``task`` is regression.
    """
    df = core.normalize(df)
    wanted(df, chart, columns)
    kinds = core.kinds(df)
    if chart == "missing_values":
        view = charts.missing_view(df.select(*map(quoted, columns)) if columns else df).where("percent > 0")
        if view.isEmpty():
            raise ChartRequestError("no column has missing values")
        return view
    if chart == "correlation_heatmap":
        return matrix(df, columns)
    if chart == "scatter":
        return charts.scatter(df, *columns, key, budget.points)
    if chart == "grouped_bar":
        return frequency.grouped_tally(df, *columns)
    if chart == "grouped_box":
        value, group = columns if kinds[columns[0]] == core.NUMERIC else reversed(columns)
        return charts.box(largest_groups(df, group, budget.categories), value, group)
    [column] = columns
    if chart == "box_plot":
        return charts.box(df, column)
    if chart == "histogram" or (chart == "target_distribution" and task == "regression"):
        known = df.agg(F.count(core.finite(quoted(column)))).first()[0]
        return charts.histogram(df, column, charts.bin_count(known))
    return charts.bars(df, column, budget.categories)


def cautions(profile: DataFrame, columns: list[str], budget: Budget = Budget()) -> DataFrame:
    """``column`` and ``code`` of what to know about columns that are charted by request; never a refusal."""
    say = F.array(
        F.when(F.col("constant"), "constant_column").when(F.col("near_constant"), "near_constant_column"), F.when(F.col("id_like"), "possible_id_like"),
        F.when(F.col("unique") > budget.categories, "categories_truncated"), F.when(F.col("missing") > 0, "missing_values_excluded"),
        F.when(F.col("infinite") > 0, "infinite_values_excluded"),
    )
    return profile.where(F.col("column").isin(columns)).select("column", F.explode(F.array_compact(say)).alias("code"))
