"""Baselines that ignore the series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.functions.draws import share_of_case
from undula.learn.base import ConstantModel, PredictingModel, class_at
from undula.operators.base import SeriesEstimator, register
from undula.series import Capabilities, as_series, validate

#: Ranges of ids in which cases are numbered, less one.
RANGES = 500
_ANYTHING = Capabilities(equal_length_only=False, allow_nan=True, requires_y=True, min_length=1, validates=False, non_deterministic=True)


class RandomClassModel(PredictingModel):
    """Classes drawn by probability, from a hash of the case and the seed: a case keeps its draw wherever it is read."""

    def __init__(self, p: list[float], classes: list, seed: int, one_hot: bool):
        super().__init__()
        self.p, self.classes, self.seed, self.one_hot = p, classes, seed, one_hot

    def _transform(self, df: DataFrame) -> DataFrame:
        u = share_of_case("case_id", self.seed)
        steps = [sum(self.p[: i + 1]) for i in range(len(self.p) - 1)]
        index = sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))
        p = F.array(*(F.when(index == i, 1.0).otherwise(0.0) for i in range(len(self.p)))) if self.one_hot else F.array(*map(F.lit, self.p))
        return df.withColumn("probability", p).withColumn("prediction", class_at(index, self.classes))


class PriorModel(PredictingModel):
    def __init__(self, p: list[float], classes: list):
        super().__init__()
        self.p, self.classes = p, classes

    def _transform(self, df: DataFrame) -> DataFrame:
        best = self.classes[self.p.index(max(self.p))]
        return df.withColumn("probability", F.array(*map(F.lit, self.p))).withColumn("prediction", F.lit(best))


@register("classifier")
class DummyClassifier(SeriesEstimator):
    """strategy: most_frequent, prior, stratified, uniform or constant."""

    needs = _ANYTHING

    def __init__(self, strategy="prior", constant=None, validate=False, random_state=None):
        super().__init__()
        if strategy not in ("most_frequent", "prior", "stratified", "uniform", "constant"):
            raise ValueError(f"unknown strategy {strategy!r}")
        self.strategy, self.constant, self.validate, self.random_state = strategy, constant, validate, random_state

    def _fit(self, df: DataFrame) -> PredictingModel:
        if self.validate:
            validate(as_series(df), Capabilities(equal_length_only=False, allow_nan=True, min_length=1), y=self.label_col)
        counts = {r[0]: r["count"] for r in df.where(F.col(self.label_col).isNotNull()).groupBy(self.label_col).count().collect()}  # a row a class
        classes = sorted(counts)
        if not classes:
            raise ValueError("there are no labels")
        p = [counts[c] / sum(counts.values()) for c in classes]
        if self.strategy == "prior":
            return PriorModel(p, classes)
        if self.strategy == "most_frequent":
            return ConstantModel(classes[p.index(max(p))], classes)
        if self.strategy == "constant":
            if self.constant not in counts:
                raise ValueError("the constant must be one of the classes")
            return ConstantModel(self.constant, classes)
        if self.strategy == "uniform":
            return RandomClassModel([1 / len(classes)] * len(classes), classes, self.random_state or 0, one_hot=False)
        return RandomClassModel(p, classes, self.random_state or 0, one_hot=True)


@register("regressor")
class DummyRegressor(SeriesEstimator):
    """strategy: mean, median, quantile or constant."""

    needs = _ANYTHING

    def __init__(self, strategy="mean", constant=None, quantile=None, validate=False):
        super().__init__()
        if strategy not in ("mean", "median", "quantile", "constant"):
            raise ValueError(f"unknown strategy {strategy!r}")
        if strategy == "quantile" and (quantile is None or not 0 <= quantile <= 1):
            raise ValueError("quantile must be in the range 0 to 1")
        if strategy == "constant" and constant is None:
            raise ValueError("constant must be given")
        self.strategy, self.constant, self.quantile, self.validate = strategy, constant, quantile, validate

    def _fit(self, df: DataFrame) -> PredictingModel:
        if self.validate:
            validate(as_series(df), Capabilities(equal_length_only=False, allow_nan=True, min_length=1), y=self.label_col)
        if self.strategy == "constant":
            return ConstantModel(float(self.constant))
        y = F.col(self.label_col)
        value = F.avg(y) if self.strategy == "mean" else F.percentile(y, F.lit(0.5 if self.strategy == "median" else float(self.quantile)))
        found = df.agg(value).first()[0]
        if found is None:
            raise ValueError("there are no targets")
        return ConstantModel(float(found))


class DummyClusterModel(PredictingModel):
    def __init__(self, strategy: str, n_clusters: int, seed: int):
        super().__init__()
        self.strategy, self.n_clusters, self.seed = strategy, n_clusters, seed

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.strategy == "single":
            return df.withColumn("cluster", F.lit(0))
        if self.strategy == "random":
            return df.withColumn("cluster", F.floor(share_of_case("case_id", self.seed) * self.n_clusters).cast("int"))
        # places of cases: within ranges of ids between fixed bounds, after the counts of the ranges before
        ids = df.select("case_id").where("case_id is not null")
        bounds = sorted(r[0] for r in ids.orderBy(F.xxhash64("case_id")).limit(RANGES).collect())
        part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("case_id"))) if bounds else F.lit(0)
        ranged = df.withColumn("__part", part).withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy("case_id")) - 1)
        sizes = df.groupBy(part.alias("__part")).count()  # RANGES + 1 rows at most
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
        return ranged.join(F.broadcast(starts), "__part").withColumn("cluster", (F.col("__start") + F.col("__n")).cast("int")).select(*df.columns, "cluster")


@register("clusterer")
class DummyClusterer(SeriesEstimator):
    """strategy: single (all in one), unique (each its own) or random."""

    needs = Capabilities(equal_length_only=False, allow_nan=True, min_length=1, validates=False, non_deterministic=True)

    def __init__(self, strategy="single", n_clusters=2, validate=False, random_state=None):
        super().__init__()
        if strategy not in ("single", "unique", "random"):
            raise ValueError(f"unknown strategy {strategy!r}")
        self.strategy, self.n_clusters, self.validate, self.random_state = strategy, n_clusters, validate, random_state

    def _fit(self, df: DataFrame) -> DummyClusterModel:
        if self.validate:
            validate(as_series(df), Capabilities(equal_length_only=False, allow_nan=True, min_length=1))
        return DummyClusterModel(self.strategy, self.n_clusters, self.random_state or 0)
