"""Random shapelet forests: distances to random subsequences, then a forest.

Shapelets are drawn from training cases on the driver by a seed; only the cases that
are drawn from reach it. Each case's distances are computed where the case is read, over
Arrow batches. After Karlsson et al., "Generalized random shapelet forests" (2016),
with the shapelets of all trees drawn at once.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.functions import arrow
from undula.learn.base import Featuriser, PredictingModel, SeriesClassifier, SeriesRegressor, fit_head
from undula.operators.base import check_n_jobs, register
from undula.series import Capabilities, SeriesMeta, as_series, guarded


def _normed(m: np.ndarray) -> np.ndarray:
    return (m - m.mean(-1, keepdims=True)) / np.maximum(m.std(-1, keepdims=True), 1e-12)


def nearest(series: np.ndarray, shapelet: np.ndarray, metric: str = "euclidean") -> float:
    """Least distance of a shapelet to a window of a series (the shapelet slides inside the longer of the two)."""
    if len(shapelet) > len(series):
        series, shapelet = shapelet, series
    windows = np.lib.stride_tricks.sliding_window_view(series, len(shapelet))
    if metric == "scaled_euclidean":
        windows, shapelet = _normed(windows), _normed(shapelet)
    return float(np.sqrt(((windows - shapelet) ** 2).sum(-1).min()))


def batch_distances(m: np.ndarray, shapelets: list[tuple[int, np.ndarray]], metric: str = "euclidean") -> np.ndarray:
    """``nearest`` of all cases (cases x channels x length) and shapelets: one product a channel and shapelet length.

    The product finds the nearest window; its distance is computed directly.
    """
    out = np.zeros((len(m), len(shapelets)))
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (channel, s) in enumerate(shapelets):
        groups.setdefault((channel, len(s)), []).append(i)
    for (channel, size), own in groups.items():
        if size > m.shape[2]:
            out[:, own] = [[nearest(c, shapelets[i][1], metric) for i in own] for c in m[:, channel]]
            continue
        windows = np.lib.stride_tricks.sliding_window_view(m[:, channel], size, axis=1)  # cases x places x size
        s = np.stack([shapelets[i][1] for i in own])
        if metric == "scaled_euclidean":
            windows, s = _normed(windows), _normed(s)
        flat = np.ascontiguousarray(windows).reshape(-1, size)
        apart = (flat**2).sum(1)[:, None] - 2 * flat @ s.T  # less the shapelet's own square, the same at all places
        at = apart.reshape(len(m), -1, len(own)).argmin(1)
        best = windows[np.arange(len(m))[:, None], at]
        out[:, own] = np.sqrt(((best - s[None]) ** 2).sum(2))
    return out


def distances(x: Column, shapelets: list[tuple[int, np.ndarray]], metric: str) -> Column:
    return arrow.per_batch(x, lambda m: batch_distances(m, shapelets, metric))


class _Shapelets:
    needs = Capabilities(requires_y=True)

    def _init(self, values: dict) -> None:
        if values["metric"] not in ("euclidean", "scaled_euclidean"):
            raise ValueError("metric is 'euclidean' or 'scaled_euclidean'")
        if not 0 <= values["min_shapelet_size"] <= values["max_shapelet_size"] <= 1:
            raise ValueError("shapelet sizes are shares of the length, the smallest first")
        check_n_jobs(values["n_jobs"])
        # MLlib's trees have no such settings: another value is refused, not ignored
        for name, only in (("min_samples_split", 2), ("alpha", None), ("metric_params", None), ("oob_score", False), ("warm_start", False)):
            if values[name] != only:
                raise ValueError(f"{name}: only {only!r} is supported, not {values[name]!r}")
        if values["criterion"] not in self.criteria:
            raise ValueError(f"criterion is one of {self.criteria}")
        for k, v in values.items():
            if k not in ("self", "__class__"):
                setattr(self, k, v)

    def _draw(self, df: DataFrame, meta: SeriesMeta) -> list[tuple[int, np.ndarray]]:
        rng = np.random.RandomState(self.random_state)
        wanted = self.n_estimators * self.n_shapelets
        lo = max(2, int(np.ceil(self.min_shapelet_size * meta.min_length)))
        hi = max(lo, int(self.max_shapelet_size * meta.min_length))
        order = F.xxhash64("x", F.lit(self.random_state or 0))
        cases = [np.array(r[0]) for r in df.select("x", order.alias("o")).orderBy("o").limit(wanted).select("x").collect()]  # a case a shapelet at most
        out = []
        for _ in range(wanted):
            case = cases[rng.randint(len(cases))]
            channel, size = rng.randint(len(case)), rng.randint(lo, hi + 1)
            start = rng.randint(case.shape[1] - size + 1)
            out.append((channel, case[channel, start : start + size]))
        return out

    def _featuriser(self, df: DataFrame, meta: SeriesMeta) -> Featuriser:
        shapelets, metric = self._draw(df, meta), self.metric

        def features(rows: DataFrame) -> DataFrame:
            rows = guarded(as_series(rows), Capabilities(), meta)
            return rows.withColumn("features", distances(F.col("x"), shapelets, metric))

        return features

    def _forest(self, kind: type, **more):
        return kind(numTrees=self.n_estimators, maxDepth=30 if self.max_depth is None else min(30, self.max_depth), minInstancesPerNode=self.min_samples_leaf, minInfoGain=self.min_impurity_decrease, bootstrap=self.bootstrap, seed=self.random_state or 0, **more)

    @classmethod
    def test_params(cls) -> dict:
        return {"n_estimators": 3, "n_shapelets": 2, "random_state": 0}


@register("classifier")
class RandomShapeletForestClassifier(_Shapelets, SeriesClassifier):
    """Distances to random shapelets, then a forest; ``max_depth`` None means MLlib's greatest depth, 30.

    ``class_weight``: None, "balanced" or weights by class.
    """

    criteria = ("entropy", "gini")

    def __init__(self, n_estimators=100, n_shapelets=10, max_depth=None, min_samples_split=2, min_samples_leaf=1, min_impurity_decrease=0.0, min_shapelet_size=0.0, max_shapelet_size=1.0, alpha=None, metric="euclidean", metric_params=None, criterion="entropy", oob_score=False, bootstrap=True, warm_start=False, class_weight=None, n_jobs=None, random_state=None):
        super().__init__()
        self._init({k: v for k, v in locals().items()})

    def learn(self, df: DataFrame, meta: SeriesMeta, classes: list) -> PredictingModel:
        return fit_head(df, self._featuriser(df, meta), self._forest(RandomForestClassifier, impurity=self.criterion), self.label_col, classes, meta, self.class_weight)


@register("regressor")
class RandomShapeletForestRegressor(_Shapelets, SeriesRegressor):
    """As the classifier, for a number."""

    criteria = ("squared_error",)

    def __init__(self, n_estimators=100, n_shapelets=10, max_depth=None, min_samples_split=2, min_samples_leaf=1, min_impurity_decrease=0.0, min_shapelet_size=0.0, max_shapelet_size=1.0, alpha=None, metric="euclidean", metric_params=None, criterion="squared_error", oob_score=False, bootstrap=True, warm_start=False, n_jobs=None, random_state=None):
        super().__init__()
        self._init({k: v for k, v in locals().items()})

    def learn(self, df: DataFrame, meta: SeriesMeta) -> PredictingModel:
        return fit_head(df, self._featuriser(df, meta), self._forest(RandomForestRegressor), self.label_col, None, meta)
