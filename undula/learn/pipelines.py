"""Interval and FPCA pipelines: features, then a learner from MLlib."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.learn.base import Featuriser, PredictingModel, SeriesClassifier, SeriesRegressor, fit_head
from undula.operators.base import SeriesTransformer, register
from undula.operators.fpca import FPCATransformer
from undula.operators.intervals import RandomIntervalTransformer, SupervisedIntervalTransformer
from undula.series import Capabilities, SeriesMeta, as_series, guarded, meta_of

#: Trees of a default forest.
TREES = 200
_NEEDS = Capabilities(requires_y=True, min_length=3)


def forest(kind: type, seed: int | None) -> Estimator:
    return kind(numTrees=TREES, maxDepth=10, seed=seed or 0)


def interval_featuriser(df: DataFrame, meta: SeriesMeta, representations: Sequence[SeriesTransformer | None], intervals: RandomIntervalTransformer) -> Featuriser:
    """Intervals of every representation (None: the series), each drawn by its own seed."""
    parts = []
    if intervals.min_interval_length > meta.min_length:
        raise ValueError(f"min_interval_length is {intervals.min_interval_length}, the series have a length of {meta.min_length}")
    for i, transform in enumerate(representations):
        bound = transform.bound(meta) if transform else None
        seed = None if intervals.random_state is None else intervals.random_state + i
        # the collection has been validated; a representation has the sizes of its first case
        own = meta_of(bound.transform(df.limit(1))) if bound else meta
        parts.append((bound, intervals.clone(seed).drawn_for(SeriesMeta(meta.n_cases, own.n_channels, own.min_length, own.max_length))))

    def features(rows: DataFrame) -> DataFrame:
        rows = guarded(as_series(rows), Capabilities(), meta)
        for j, (t, _) in enumerate(parts):
            rows = rows.withColumn(f"__r{j}", t.expression(F.col("x")) if t else F.col("x"))
        out = F.concat(*(m.expression(F.col(f"__r{j}")) for j, (_, m) in enumerate(parts)))
        # a feature that isn't a number counts as 0
        clean = F.transform(out, lambda v: F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v))
        return rows.withColumn("features", clean).drop(*(f"__r{j}" for j in range(len(parts))))

    return features


class _RandomIntervals:
    def _features(self, df: DataFrame, meta: SeriesMeta) -> Featuriser:
        given = self.series_transformers
        representations = [None] if given is None else given if isinstance(given, list) else [given]
        draw = RandomIntervalTransformer(self.n_intervals, self.min_interval_length, self.max_interval_length, self.features, self.dilation, self.random_state)
        return interval_featuriser(df, meta, representations, draw)


@register("classifier")
class RandomIntervalClassifier(_RandomIntervals, SeriesClassifier):
    """Features of random intervals of one or several representations, then a forest or any MLlib classifier."""

    needs = _NEEDS

    def __init__(self, n_intervals=100, min_interval_length=3, max_interval_length=float("inf"), features=None, series_transformers=None, dilation=None, estimator=None, random_state=None):
        super().__init__()
        self.n_intervals, self.min_interval_length, self.max_interval_length, self.features = n_intervals, min_interval_length, max_interval_length, features
        self.series_transformers, self.dilation, self.estimator, self.random_state = series_transformers, dilation, estimator, random_state

    @classmethod
    def test_params(cls) -> dict:
        return {"n_intervals": 2, "estimator": RandomForestClassifier(numTrees=3, seed=0), "random_state": 0}

    def learn(self, df: DataFrame, meta: SeriesMeta, classes: list) -> PredictingModel:
        return fit_head(df, self._features(df, meta), self.estimator or forest(RandomForestClassifier, self.random_state), self.label_col, classes, meta)


@register("regressor")
class RandomIntervalRegressor(_RandomIntervals, SeriesRegressor):
    """As the classifier, for a number."""

    needs = _NEEDS

    def __init__(self, n_intervals=100, min_interval_length=3, max_interval_length=float("inf"), features=None, series_transformers=None, dilation=None, estimator=None, random_state=None):
        super().__init__()
        self.n_intervals, self.min_interval_length, self.max_interval_length, self.features = n_intervals, min_interval_length, max_interval_length, features
        self.series_transformers, self.dilation, self.estimator, self.random_state = series_transformers, dilation, estimator, random_state

    @classmethod
    def test_params(cls) -> dict:
        return {"n_intervals": 2, "estimator": RandomForestRegressor(numTrees=3, seed=0), "random_state": 0}

    def learn(self, df: DataFrame, meta: SeriesMeta) -> PredictingModel:
        return fit_head(df, self._features(df, meta), self.estimator or forest(RandomForestRegressor, self.random_state), self.label_col, None, meta)


@register("classifier")
class SupervisedIntervalClassifier(SeriesClassifier):
    """Features of intervals found by supervised search, then a forest or any MLlib classifier."""

    needs = Capabilities(requires_y=True, min_cases=2, min_length=7)

    def __init__(self, n_intervals=50, min_interval_length=3, features=None, metric="fisher", randomised_split_point=True, normalise_for_search=True, estimator=None, random_state=None, mode="lockstep"):
        super().__init__()
        self.n_intervals, self.min_interval_length, self.features, self.metric = n_intervals, min_interval_length, features, metric
        self.randomised_split_point, self.normalise_for_search, self.estimator, self.random_state, self.mode = randomised_split_point, normalise_for_search, estimator, random_state, mode

    @classmethod
    def test_params(cls) -> dict:
        return {"n_intervals": 1, "estimator": RandomForestClassifier(numTrees=3, seed=0), "random_state": 0}

    def learn(self, df: DataFrame, meta: SeriesMeta, classes: list) -> PredictingModel:
        search = SupervisedIntervalTransformer(self.n_intervals, self.min_interval_length, self.features, self.metric, self.randomised_split_point, self.normalise_for_search, self.random_state, self.mode)
        search.label_col = self.label_col
        found = search.fit(df)

        def features(rows: DataFrame) -> DataFrame:
            out = found.transform(rows)
            return out if found.pairs else out.withColumn("features", F.array(F.lit(0.0)))

        return fit_head(df, features, self.estimator or forest(RandomForestClassifier, self.random_state), self.label_col, classes, meta)


class _FPCA:
    def _features(self, df: DataFrame) -> Featuriser:
        fitted = FPCATransformer(self.n_components, True, self.bspline, self.n_basis, self.order).fit(df)
        return lambda rows: fitted.transform(rows).drop("scores")


@register("classifier")
class FPCAClassifier(_FPCA, SeriesClassifier):
    """Functional principal component scores, then logistic regression or any MLlib classifier."""

    needs = Capabilities(requires_y=True, min_cases=2)

    def __init__(self, n_components=10, bspline=False, n_basis=None, order=None, estimator=None):
        super().__init__()
        self.n_components, self.bspline, self.n_basis, self.order, self.estimator = n_components, bspline, n_basis, order, estimator

    @classmethod
    def test_params(cls) -> dict:
        return {"n_components": 2}

    def learn(self, df: DataFrame, meta: SeriesMeta, classes: list) -> PredictingModel:
        return fit_head(df, self._features(df), self.estimator or LogisticRegression(), self.label_col, classes, meta)


@register("regressor")
class FPCARegressor(_FPCA, SeriesRegressor):
    """Functional principal component scores, then linear regression or any MLlib regressor."""

    needs = Capabilities(requires_y=True, min_cases=2)

    def __init__(self, n_components=10, bspline=False, n_basis=None, order=None, estimator=None):
        super().__init__()
        self.n_components, self.bspline, self.n_basis, self.order, self.estimator = n_components, bspline, n_basis, order, estimator

    @classmethod
    def test_params(cls) -> dict:
        return {"n_components": 2}

    def learn(self, df: DataFrame, meta: SeriesMeta) -> PredictingModel:
        return fit_head(df, self._features(df), self.estimator or LinearRegression(), self.label_col, None, meta)
