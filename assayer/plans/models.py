"""Models by name, over ``pyspark.ml``, and training on one shared split."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import regression as R
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer import core
from assayer.operators import evaluate, prepare, target
from assayer.operators.birch import Birch, WardOverLeaves
from assayer.operators.neighbours import Knn


@dataclass(frozen=True)
class Facts:
    """What an estimator's settings depend on: rows, classes and the target's spread."""

    rows: int = 1
    classes: int = 2
    spread: float = 1.0


@dataclass(frozen=True)
class Model:
    name: str
    task: str
    make: Callable[[Facts], Any]
    aliases: tuple[str, ...] = ()


def boosted(facts: Facts, **settings: Any) -> Any:
    """Boosted trees; of more than two classes one against the rest for each."""
    trees = C.GBTClassifier(maxIter=100, stepSize=0.1, seed=42, **settings)
    return trees if facts.classes <= 2 else C.OneVsRest(classifier=trees)


class RestartedKMeans:
    """k-means of the least cost among ``restarts`` seeds."""

    def __init__(self, k: int = 8, restarts: int = 10) -> None:
        self.k, self.restarts = k, restarts

    def setK(self, k: int) -> RestartedKMeans:
        return RestartedKMeans(k, self.restarts)

    def fit(self, df: DataFrame) -> Any:
        tried = (K.KMeans(k=self.k, seed=42 + i).fit(df) for i in range(self.restarts))
        return min(tried, key=lambda m: m.summary.trainingCost)


@dataclass(frozen=True)
class Centres:
    """Assigns rows to the nearest of fixed centres, ties to the first."""

    centres: tuple[tuple[float, ...], ...]

    def transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array("features")
        far = [F.aggregate(F.zip_with(x, F.lit(list(c)), lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, d: s + d) for c in self.centres]
        return df.withColumn("__far", F.array(*far)).withColumn("prediction", F.expr("int(array_position(__far, array_min(__far)) - 1)")).drop("__far")


class MiniBatchKMeans:
    """k-means on batches: in each turn the rows of one hash class move the centres by their running means.

    A batch has some ``batch`` rows and is one aggregate to a row a centre; the table is
    cut by the hash of its features, so a run is repeatable. A table of one batch is plain k-means.
    """

    def __init__(self, k: int = 8, batch: int = 100_000, turns: int = 20) -> None:
        self.k, self.batch, self.turns = k, batch, turns

    def setK(self, k: int) -> MiniBatchKMeans:
        return MiniBatchKMeans(k, self.batch, self.turns)

    def fit(self, df: DataFrame) -> Centres:
        parts = max(1, df.count() // self.batch)
        rows = df.select("features", F.pmod(F.xxhash64(vector_to_array("features")), F.lit(parts)).alias("part"))
        centres = np.array(RestartedKMeans(self.k).fit(rows.where("part = 0")).clusterCenters())
        seen = np.zeros(len(centres))
        for turn in range(1, self.turns + 1 if parts > 1 else 1):
            said = Centres(tuple(map(tuple, centres.tolist()))).transform(rows.where(F.col("part") == turn % parts))
            for row in said.groupBy("prediction").agg(Summarizer.mean(F.col("features")).alias("mean"), F.count("*").alias("n")).collect():  # k rows
                i = row["prediction"]
                seen[i] += row["n"]
                centres[i] += (row["mean"].toArray() - centres[i]) * row["n"] / seen[i]
        return Centres(tuple(map(tuple, centres.tolist())))


class Baseline:
    """Class of highest prior, or the mean, whatever the features."""

    def __init__(self, task: str) -> None:
        self.task = task

    def fit(self, df: DataFrame) -> Baseline:
        if self.task == "regression":
            self.value = float(df.agg(F.avg("label")).first()[0])
        else:
            self.value = float(df.groupBy("label").count().orderBy(F.desc("count"), "label").first()[0])
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.lit(self.value))


REGISTRY: dict[str, Model] = {}


def register(model: Model) -> None:
    for n in (model.name, *model.aliases):
        if n in REGISTRY and REGISTRY[n].name != model.name:
            raise core.ConfigurationError(f"{n} is taken")
        REGISTRY[n] = model


for _m in (
    Model("logistic_regression", "classification", lambda f: C.LogisticRegression(maxIter=1000, regParam=1 / f.rows, standardization=False), ("logistic", "logreg")),
    Model("gaussian_nb", "classification", lambda f: C.NaiveBayes(modelType="gaussian"), ("gnb",)),
    Model("decision_tree_classifier", "classification", lambda f: C.DecisionTreeClassifier(maxDepth=30, seed=42)),
    Model("random_forest_classifier", "classification", lambda f: C.RandomForestClassifier(numTrees=100, seed=42)),
    Model("extra_trees_classifier", "classification", lambda f: C.RandomForestClassifier(numTrees=100, bootstrap=False, maxBins=8, seed=42)),
    Model("gradient_boosting_classifier", "classification", lambda f: boosted(f, maxDepth=3)),
    Model("hist_gradient_boosting_classifier", "classification", lambda f: boosted(f, maxBins=255)),
    Model("knn_classifier", "classification", lambda f: Knn("classification"), ("knn",)),
    Model("dummy_classifier", "classification", lambda f: Baseline("classification"), ("dummy_class",)),
    Model("linear_regression", "regression", lambda f: R.LinearRegression(solver="normal"), ("linear",)),
    Model("ridge_regression", "regression", lambda f: R.LinearRegression(solver="normal", regParam=f.spread / f.rows, standardization=False), ("ridge",)),
    Model("decision_tree_regressor", "regression", lambda f: R.DecisionTreeRegressor(maxDepth=30, seed=42)),
    Model("random_forest_regressor", "regression", lambda f: R.RandomForestRegressor(numTrees=100, seed=42)),
    Model("extra_trees_regressor", "regression", lambda f: R.RandomForestRegressor(numTrees=100, bootstrap=False, maxBins=8, seed=42)),
    Model("gradient_boosting_regressor", "regression", lambda f: R.GBTRegressor(maxIter=100, maxDepth=3, stepSize=0.1, seed=42)),
    Model("hist_gradient_boosting_regressor", "regression", lambda f: R.GBTRegressor(maxIter=100, maxBins=255, stepSize=0.1, seed=42)),
    Model("knn_regressor", "regression", lambda f: Knn("regression"), ("knn_mean",)),
    Model("dummy_regressor", "regression", lambda f: Baseline("regression"), ("dummy_mean",)),
    Model("kmeans_clustering", "clustering", lambda f: RestartedKMeans(), ("kmeans",)),
    Model("minibatch_kmeans_clustering", "clustering", lambda f: MiniBatchKMeans(), ("minibatch_kmeans",)),
    Model("bisecting_kmeans_clustering", "clustering", lambda f: K.BisectingKMeans(k=8, seed=42)),
    Model("birch_clustering", "clustering", lambda f: Birch(), ("birch",)),
    Model("agglomerative_clustering", "clustering", lambda f: WardOverLeaves(), ("agglomerative", "hierarchical")),
):
    register(_m)


def resolve(name: str, task: str | None = None) -> Model:
    model = REGISTRY.get(name)
    if model is None:
        raise core.ConfigurationError(f"no model {name}; there are {sorted({m.name for m in REGISTRY.values()})}")
    if task is not None and model.task != task:
        raise core.IncompatibleModelError(f"{model.name} is for {model.task}")
    return model


@dataclass(frozen=True)
class Trained:
    model: str
    fitted: Any
    prepared: prepare.Fitted
    labels: DataFrame | None
    metrics: dict[str, float | None]


def assemble(df: DataFrame, prepared: prepare.Fitted, keep: list[str]) -> DataFrame:
    names = list(prepared.outputs)
    flat = prepared.transform(df, keep)
    renamed = flat.toDF(*keep, *[f"f{i}" for i in range(len(names))])
    return VectorAssembler(inputCols=[f"f{i}" for i in range(len(names))], outputCol="features").transform(renamed).select(*keep, "features")


def train(df: DataFrame, key: str, goal: str, names: list[str], task: str | None = None, config: core.Config = core.Config()) -> list[Trained]:
    """Fit models on one split; features are prepared on training rows only, and once for all models."""
    task = task or target.detect(df, goal, config=config).task
    models = [resolve(n, task) for n in names]
    labels = target.fit_labels(df, goal) if task == "classification" else None
    rows = target.encode(df, goal, labels) if labels is not None else df.withColumn("code", F.col(goal).cast("double"))
    rows = evaluate.split_exact(rows, key, config.validation_size, config.random_state, goal if labels is not None else None).rows
    rows = rows.withColumnRenamed("code", "label").withColumn("label", F.col("label").cast("double"))
    side = lambda s: rows.where(F.col("split") == s)
    features = [c for c in df.columns if c not in (key, goal)]
    prepared = prepare.fit(side("train").select(*features), prepare.plan(df.select(*features), None, None, config))
    learn, test = (assemble(side(s), prepared, [key, "label"]).persist() for s in ("train", "evaluation"))
    one = learn.agg(F.count("*"), F.stddev_pop("label")).first()
    facts = Facts(one[0], labels.count() if labels is not None else 0, one[1] or 1.0)
    out = []
    for m in models:
        fitted = m.make(facts).fit(learn)
        said = fitted.transform(test)
        scores = (evaluate.classification if labels is not None else evaluate.regression)(said, "label", "prediction").first().asDict()
        out.append(Trained(m.name, fitted, prepared, labels, scores))
    learn.unpersist()
    test.unpersist()
    return out


def compare(trained: list[Trained], spark: Any) -> DataFrame:
    """Leaderboard by f1 or, for regression, by rmse."""
    metric = "f1" if "f1" in trained[0].metrics else "rmse"
    names = sorted(trained[0].metrics)
    rows = [(t.model, *[t.metrics[n] for n in names]) for t in trained]
    frame = spark.createDataFrame(rows, "model string, " + ", ".join(f"{n} double" for n in names))
    return evaluate.leaderboard(frame, metric, metric == "f1")


def predict(trained: Trained, df: DataFrame, key: str) -> DataFrame:
    """key and prediction, in the original labels."""
    said = trained.fitted.transform(assemble(df, trained.prepared, [key])).select(key, "prediction")
    if trained.labels is None:
        return said
    named = target.decode(said.withColumn("__p", F.col("prediction").cast("int")), "__p", trained.labels)
    return named.select(key, F.col("label").alias("prediction"))


def cluster(df: DataFrame, key: str, name: str = "kmeans_clustering", k: int = 8, config: core.Config = core.Config()) -> DataFrame:
    """key and cluster of each row, on standardised features."""
    features = [c for c in df.columns if c != key]
    prepared = prepare.fit(df.select(*features), prepare.plan(df.select(*features)))
    rows = assemble(df, prepared, [key])
    return resolve(name, "clustering").make(Facts()).setK(k).fit(rows).transform(rows).select(key, F.col("prediction").alias("cluster"))
