"""What learners share: classes, heads from MLlib, models that predict."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.operators.base import SeriesEstimator
from undula.series import SeriesMeta, as_series, validate

#: Adds ``features`` (an array) to a collection.
Featuriser = Callable[[DataFrame], DataFrame]


def classes_of(df: DataFrame, y: str) -> list:
    """Distinct labels in order: as numbers if they are numbers."""
    return sorted(r[0] for r in df.select(y).distinct().collect())  # a row a class


def class_index(y: Column, classes: Sequence) -> Column:
    return (F.array_position(F.array(*map(F.lit, classes)), y) - 1).cast("double")


def class_at(index: Column, classes: Sequence) -> Column:
    return F.element_at(F.array(*map(F.lit, classes)), index.cast("int") + 1)


def first_maximum(p: Column) -> Column:
    """Position of the largest entry, the first of equal ones."""
    return F.array_position(p, F.array_max(p)) - 1


class PredictingModel(Model):
    """``transform`` adds ``prediction`` and, for classifiers, ``probability`` (an array in the order of ``classes``)."""

    classes: list | None = None
    meta: SeriesMeta | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        return self.transform(df)

    predict_proba = predict


class ConstantModel(PredictingModel):
    """Predicts one class, or number."""

    def __init__(self, value, classes: list | None = None):
        super().__init__()
        self.value, self.classes = value, classes

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.classes is not None:
            df = df.withColumn("probability", F.array(*(F.lit(float(c == self.value)) for c in self.classes)))
        return df.withColumn("prediction", F.lit(self.value))


class HeadModel(PredictingModel):
    """A featuriser, then a fitted MLlib model."""

    def __init__(self, features: Featuriser, head: Model, classes: list | None, meta: SeriesMeta | None = None):
        super().__init__()
        self.features, self.head, self.classes, self.meta = features, head, classes, meta

    def _transform(self, df: DataFrame) -> DataFrame:
        own = df.columns
        rows = self.features(df).withColumn("__v", array_to_vector("features"))
        out = self.head.transform(rows.select(*own, F.col("__v").alias("__features")))
        found = out.columns
        if self.classes is None:
            return out.select(*own, F.col("__prediction").cast("double").alias("prediction"))
        index = F.col("__prediction")
        if "__probability" in found:
            p = vector_to_array("__probability")
            p = F.concat(p, F.array_repeat(F.lit(0.0), F.lit(len(self.classes)) - F.size(p)))
        else:  # no probabilities: one for the class predicted
            p = F.array(*(F.when(index == i, 1.0).otherwise(0.0) for i in range(len(self.classes))))
        out = out.withColumn("__p", p)
        best = first_maximum(F.col("__p")) if "__probability" in found else index
        return out.select(*own, F.col("__p").alias("probability"), class_at(best, self.classes).alias("prediction"))


def seeded(head: Estimator, random_state: int | None) -> Estimator:
    """The learner with the seed that is given, if it takes one."""
    return head.copy({head.getParam("seed"): random_state}) if random_state is not None and head.hasParam("seed") else head


def fit_head(df: DataFrame, features: Featuriser, head: Estimator, y: str, classes: list | None, meta: SeriesMeta | None = None, class_weight: str | dict | None = None) -> HeadModel:
    """Train an MLlib estimator on the features; they are computed once.

    ``class_weight``: "balanced" (cases / (classes x cases of the class)) or a weight for each class.
    """
    target = class_index(F.col(y), classes) if classes is not None else F.col(y).cast("double")
    rows = features(df).select(array_to_vector("features").alias("__features"), target.alias("__label"))
    head = head.copy({})
    if class_weight is not None:
        if class_weight == "balanced":
            counts = {r[0]: r["count"] for r in df.groupBy(y).count().collect()}  # a row a class
            class_weight = {c: sum(counts.values()) / (len(counts) * n) for c, n in counts.items()}
        weights = F.array(*(F.lit(float(class_weight.get(c, 1.0))) for c in classes))
        rows = rows.withColumn("__weight", F.element_at(weights, F.col("__label").cast("int") + 1))
        head._set(weightCol="__weight")
    for name, column in (("featuresCol", "__features"), ("labelCol", "__label"), ("predictionCol", "__prediction"), ("probabilityCol", "__probability")):
        if head.hasParam(name):
            head._set(**{name: column})
    rows.cache()
    fitted = head.fit(rows)
    rows.unpersist()
    return HeadModel(features, fitted, classes, meta)


class SeriesClassifier(SeriesEstimator):
    """Fits the classes; one class alone is predicted without learning."""

    def _fit(self, df: DataFrame) -> PredictingModel:
        df = as_series(df, self.input_col)
        meta = validate(df, self.needs, self.input_col, self.label_col)
        classes = classes_of(df, self.label_col)
        if len(classes) == 1:
            return ConstantModel(classes[0], classes)
        return self.learn(df, meta, classes)

    def learn(self, df: DataFrame, meta: SeriesMeta, classes: list) -> PredictingModel:
        raise NotImplementedError


class SeriesRegressor(SeriesEstimator):
    def _fit(self, df: DataFrame) -> PredictingModel:
        df = as_series(df, self.input_col)
        return self.learn(df, validate(df, self.needs, self.input_col, self.label_col))

    def learn(self, df: DataFrame, meta: SeriesMeta) -> PredictingModel:
        raise NotImplementedError
