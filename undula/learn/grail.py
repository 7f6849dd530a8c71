"""GRAIL: series as inner products with a few landmark series, then a linear model or neighbours.

After Paparrizos and Franklin, "GRAIL: efficient time-series representation learning"
(2019), and Paparrizos and Gravano, "k-Shape" (2015). Landmarks come from a bounded
sample; the representation of every case is computed where it is read. The dictionary
has 100 series at most, so matrices over it fit the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.functions import arrow
from undula.learn.base import Featuriser, PredictingModel, SeriesClassifier, class_at, class_index, first_maximum, fit_head
from undula.operators.base import register
from undula.series import Capabilities, SeriesMeta, as_series, guarded

GAMMAS = range(1, 21)
NEIGHBOURS = 5


def z(m: np.ndarray) -> np.ndarray:
    return (m - m.mean(-1, keepdims=True)) / np.maximum(m.std(-1, keepdims=True), 1e-12)


def cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised cross-correlations at all shifts: (len a, len b, shifts)."""
    n = a.shape[1]
    size = arrow.next_power(2 * n - 1)
    f = np.fft.irfft(np.fft.rfft(a, size)[:, None, :] * np.conj(np.fft.rfft(b, size))[None, :, :], size)
    f = np.concatenate([f[..., -(n - 1) :], f[..., :n]], -1) if n > 1 else f[..., :1]
    return f / np.maximum(np.linalg.norm(a, axis=1)[:, None, None] * np.linalg.norm(b, axis=1)[None, :, None], 1e-12)


def own_kernel(a: np.ndarray, gamma: float) -> np.ndarray:
    """Each series' kernel with itself, before normalisation."""
    n = a.shape[1]
    size = arrow.next_power(2 * n - 1)
    f = np.fft.irfft(np.abs(np.fft.rfft(a, size)) ** 2, size)
    f = np.concatenate([f[:, -(n - 1) :], f[:, :n]], 1) if n > 1 else f[:, :1]
    return np.exp(gamma * f / np.maximum((a**2).sum(1, keepdims=True), 1e-12)).sum(1)


def sink(a: np.ndarray, b: np.ndarray, gamma: float, own_b: np.ndarray | None = None) -> np.ndarray:
    """Shift-invariant kernel: sums of exponentials of the cross-correlations, normalised by the series' own."""
    own_b = own_kernel(b, gamma) if own_b is None else own_b
    return np.exp(gamma * cross(a, b)).sum(2) / np.sqrt(own_kernel(a, gamma)[:, None] * own_b[None, :])


def shapes(m: np.ndarray, k: int, rng: np.random.RandomState, rounds: int = 10) -> np.ndarray:
    """k-Shape centroids, the first ones spread out as k-means++ does."""
    first = [m[rng.randint(len(m))]]
    while len(first) < k:
        far = np.maximum(1 - cross(m, np.array(first)).max(2).max(1), 0) ** 2
        first.append(m[rng.choice(len(m), p=far / far.sum())] if far.sum() > 0 else m[rng.randint(len(m))])
    centers, n = np.array(first), m.shape[1]
    flat = np.eye(n) - 1 / n
    group = None
    for _ in range(rounds):
        c = cross(m, centers)
        new, shift = c.max(2).argmax(1), c.argmax(2) - (n - 1)
        if group is not None and (new == group).all():
            break
        group = new
        for j in range(k):
            own = np.flatnonzero(group == j)
            if not len(own):
                centers[j] = m[rng.randint(len(m))]
                continue
            aligned = np.zeros((len(own), n))
            for row, i in enumerate(own):
                s = shift[i, j]
                aligned[row, : n - s if s >= 0 else n] = m[i, s:] if s >= 0 else np.concatenate([np.zeros(-s), m[i, :s]])
            axis = np.linalg.eigh(flat @ (aligned.T @ aligned) @ flat)[1][:, -1]
            centers[j] = z(axis if ((aligned[0] - axis) ** 2).sum() <= ((aligned[0] + axis) ** 2).sum() else -axis)
    return centers


class NeighbourModel(PredictingModel):
    """Votes of the k nearest training cases; training representations are broadcast below a bound, joined by blocks beyond it."""

    def __init__(self, features: Featuriser, train: DataFrame, classes: list, k: int):
        super().__init__()
        self.features, self.train, self.classes, self.k = features, train, classes, k

    def _transform(self, df: DataFrame) -> DataFrame:
        from undula.operators.neighbours import nearest_neighbours

        rows = self.features(df)
        near = nearest_neighbours(rows.select("case_id", "features"), self.train.select("case_id", "features"), self.k)
        labels = self.train.select(F.col("case_id").alias("neighbour_id"), "__index")
        votes = near.join(labels, "neighbour_id").groupBy("case_id").agg(*(F.avg((F.col("__index") == i).cast("double")).alias(f"__p{i}") for i in range(len(self.classes))))
        out = df.join(votes, "case_id").withColumn("probability", F.array(*(F.col(f"__p{i}") for i in range(len(self.classes)))))
        return out.withColumn("prediction", class_at(first_maximum(F.col("probability")), self.classes)).select(*df.columns, "probability", "prediction")


@register("classifier")
class GRAILClassifier(SeriesClassifier):
    """classifier: "svm" (linear, cost by cross-validation), "logistic" (with probabilities) or "knn".

    ``sample``: cases from which landmarks and the kernel's width are learned, at most.
    ``costs``: those tried by cross-validation; without it every ``cost_step``-th of the
    squares of -10 to 20 in steps of 0.11 (1: all of them).
    """

    needs = Capabilities(requires_y=True, univariate_only=True, min_cases=2)

    def __init__(self, classifier="svm", random_state=None, costs=None, cost_step=27, sample=1000):
        super().__init__()
        if classifier not in ("svm", "logistic", "knn"):
            raise ValueError("classifier is 'svm', 'logistic' or 'knn'")
        self.classifier, self.random_state, self.costs, self.cost_step, self.sample = classifier, random_state, costs, cost_step, sample

    @classmethod
    def test_params(cls) -> dict:
        return {"classifier": "logistic", "random_state": 0}

    def _featuriser(self, df: DataFrame, meta: SeriesMeta) -> Featuriser:
        rng = np.random.RandomState(self.random_state)
        sample = df.select("x", F.xxhash64("x", F.lit(self.random_state or 0)).alias("o")).orderBy("o").limit(self.sample).collect()  # bounded
        m = z(np.array([r.x[0] for r in sample]))
        d = int(np.clip(int(0.4 * meta.n_cases), 3, 100))
        centers = shapes(m, min(d, len(m)), rng)

        def quality(gamma: float) -> float:  # spread of similarities times the share of the leading components
            w = sink(centers, centers, gamma)
            values = np.sort(np.maximum(np.linalg.eigvalsh(w), 0))[::-1]
            return float(w.var() * values[: min(20, len(values))].sum() / max(values.sum(), 1e-12))

        gamma = float(max(GAMMAS, key=quality))
        values, vectors = np.linalg.eigh(sink(centers, centers, gamma))
        keep = values > 1e-10 * values.max()
        project = vectors[:, keep] / np.sqrt(values[keep])
        own = own_kernel(centers, gamma)

        def features(rows: DataFrame) -> DataFrame:
            rows = guarded(as_series(rows), Capabilities(univariate_only=True), meta)
            return rows.withColumn("features", arrow.per_batch(F.col("x"), lambda c: sink(z(c[:, 0]), centers, gamma, own) @ project, rows=64))

        return features

    def learn(self, df: DataFrame, meta: SeriesMeta, classes: list) -> PredictingModel:
        features = self._featuriser(df, meta)
        if self.classifier == "logistic":
            return fit_head(df, features, LogisticRegression(regParam=0.001), self.label_col, classes, meta)
        index = class_index(F.col(self.label_col), classes)
        if self.classifier == "knn":
            return NeighbourModel(features, features(df).withColumn("__index", index).cache(), classes, min(NEIGHBOURS, meta.n_cases))
        counts = [r["count"] for r in df.groupBy(self.label_col).count().collect()]  # a row a class
        folds = min(5, *counts)
        svm = LinearSVC(featuresCol="__features", labelCol="__label")
        costs = self.costs or [float(i * i) for i in np.arange(-10, 20, 0.11) if abs(i) > 0.05][:: self.cost_step]
        if folds > 1 and len(costs) > 1:
            rows = features(df).select(array_to_vector("features").alias("features"), index.alias("label")).cache()
            one = OneVsRest(classifier=LinearSVC())
            grid = ParamGridBuilder().addGrid(one.classifier, [LinearSVC(regParam=1 / (c * meta.n_cases)) for c in costs]).build()
            found = CrossValidator(estimator=one, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=folds, seed=self.random_state or 0).fit(rows)
            cost = costs[int(np.argmax(found.avgMetrics))]
            rows.unpersist()
        else:
            cost = costs[0]
        svm = svm.setRegParam(1 / (cost * meta.n_cases))
        return fit_head(df, features, OneVsRest(classifier=svm), self.label_col, classes, meta)
