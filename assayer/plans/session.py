"""A guided session: each call keeps what later calls need, and a new table discards it."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer import core, sources
from assayer.operators import advisor, evaluate, profile, quality, target
from assayer.plans import audit, models


class SessionOrderError(core.AssayError): ...


class Session:
    def __init__(self, spark: SparkSession, config: core.Config = core.Config()) -> None:
        self.spark, self.config = spark, config
        self.kept: dict[str, Any] = {}

    def load(self, source: Any, key: str, goal: str | None = None, **options: Any) -> Session:
        """A table, the numeric key that orders its rows, and its target."""
        self.kept = {"df": core.normalize(sources.load_table(self.spark, source, **options).df), "key": key, "goal": goal}
        return self

    def need(self, name: str) -> Any:
        if name not in self.kept:
            raise SessionOrderError(f"{name} is not there yet")
        return self.kept[name]

    def cached(self, name: str, make: Any) -> Any:
        if name not in self.kept:
            self.kept[name] = make()
        return self.kept[name]

    def profile(self) -> DataFrame:
        df, key = self.need("df"), self.need("key")
        return self.cached("profile", lambda: profile.profile(df, key, self.config).persist())

    def check_quality(self) -> DataFrame:
        df, key = self.need("df"), self.need("key")
        return self.cached("findings", lambda: quality.inspect(df, key, self.need("goal"), self.config).persist())

    def verdict(self) -> str:
        return self.cached("verdict", lambda: quality.verdict(self.check_quality()))

    def charts(self) -> DataFrame:
        """The plan of charts; ``chart_data`` gives the data of one of its rows."""
        df, key, goal = self.need("df"), self.need("key"), self.need("goal")
        return self.cached("charts", lambda: advisor.recommend(df, key, goal, key, self.config, profile=self.profile(), findings=self.check_quality()))

    def chart_data(self, chart: str, columns: list[str]) -> DataFrame:
        df, goal = self.need("df"), self.need("goal")
        task = target.detect(df, goal, config=self.config).task if chart == "target_distribution" and columns == [goal] else None
        return advisor.data_of(df, self.need("key"), chart, columns, task)

    def compare_models(self, names: list[str]) -> DataFrame:
        """Refused on blocked data and after the final evaluation."""
        if self.verdict() == "BLOCKED":
            raise core.IncompatibleModelError("the data are blocked by an error finding")
        if "final" in self.kept:
            raise SessionOrderError("the final evaluation has been made")
        task = target.detect(self.need("df"), self.need("goal"), config=self.config).task
        self.kept["trained"] = models.train(self.need("df"), self.need("key"), self.need("goal"), names, task, self.config)
        return models.compare(self.kept["trained"], self.spark)

    def select(self, name: str) -> models.Trained:
        wanted = models.resolve(name).name
        chosen = next((t for t in self.need("trained") if t.model == wanted), None)
        if chosen is None:
            raise SessionOrderError(f"{name} has not been trained")
        self.kept["chosen"] = chosen
        return chosen

    def predict(self, df: DataFrame) -> DataFrame:
        return models.predict(self.need("chosen"), core.normalize(df), self.need("key"))

    def evaluate_final(self, df: DataFrame) -> dict[str, Any]:
        """Once, on rows that were held back; it freezes comparison."""
        if "final" in self.kept:
            raise SessionOrderError("the final evaluation has been made")
        goal, key = self.need("goal"), self.need("key")
        said = self.predict(df).join(df.select(key, F.col(goal).alias("__y")), key)
        metric = evaluate.classification if self.need("chosen").labels is not None else evaluate.regression
        self.kept["final"] = metric(said, "__y", "prediction").first().asDict()
        return self.kept["final"]

    def audit(self) -> dict[str, Any]:
        return audit.audit(self.need("df"), self.need("key"), self.need("goal"), self.config)
