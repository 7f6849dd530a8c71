"""Functional principal components of each channel."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.functions.stats import total
from undula.operators.base import SeriesEstimator, SeriesModel, register
from undula.series import Capabilities, as_series, guarded, validate


def trapezoid(n: int) -> np.ndarray:
    """Quadrature weights of the unit grid."""
    w = np.ones(n)
    w[[0, -1]] = 0.5
    return w


def bspline_basis(n: int, n_basis: int, order: int) -> np.ndarray:
    """(n, n_basis) values on 0..n-1 of B-splines of an order, by Cox and de Boor's recursion."""
    inner = np.linspace(0, n - 1, n_basis - order + 2)
    knots = np.concatenate([[inner[0]] * (order - 1), inner, [inner[-1]] * (order - 1)])
    t = np.arange(n, dtype=float)
    b = np.array([(t >= lo) & (t < hi) for lo, hi in zip(knots, knots[1:], strict=False)], float)
    b[np.flatnonzero(knots[1:] > knots[:-1])[-1], -1] = 1.0  # the last point belongs to the last span
    for k in range(2, order + 1):
        up = []
        for i in range(len(knots) - k):
            wide, far = knots[i + k - 1] - knots[i], knots[i + k] - knots[i + 1]
            up.append((t - knots[i]) / wide * b[i] if wide else np.zeros(n))
            if far:
                up[-1] = up[-1] + (knots[i + k] - t) / far * b[i + 1]
        b = np.array(up)
    return b.T


def _inner(c: Column):
    return lambda p: total(F.zip_with(c, p["w"], lambda u, v: u * v)) - p["o"]


class FPCAModel(SeriesModel):
    """Scores are inner products with the components, by quadrature; ``loadings[channel]`` includes the weights."""

    def __init__(self, loadings: list[np.ndarray], offsets: list[np.ndarray], meta):
        super().__init__()
        self.loadings, self.offsets, self.meta = loadings, offsets, meta

    def expression(self, x: Column) -> Column:
        channels = []
        for k, (load, offset) in enumerate(zip(self.loadings, self.offsets, strict=True)):
            c = F.element_at(x, k + 1)
            parts = F.array(*(F.struct(F.lit([float(v) for v in one]).alias("w"), F.lit(float(o)).alias("o")) for one, o in zip(load, offset, strict=True)))
            channels.append(F.transform(parts, _inner(c)))
        return F.array(*channels)

    @property
    def output_col(self) -> str:
        return "scores"

    def _transform(self, df: DataFrame) -> DataFrame:
        df = guarded(as_series(df, self.input_col), Capabilities(), self.meta, self.input_col)
        out = df.withColumn("scores", self.expression(F.col(self.input_col)))
        return out.withColumn("features", F.flatten("scores"))


@register("transformer")
class FPCATransformer(SeriesEstimator):
    """Scores on the leading functional components, per channel.

    A component's sign is such that its largest value is positive. With ``bspline``,
    series are first projected on ``n_basis`` splines of an order.
    """

    needs = Capabilities(min_cases=2)

    def __init__(self, n_components: int = 10, centering: bool = True, bspline: bool = False, n_basis: int | None = None, order: int | None = None):
        super().__init__()
        if bspline and (not n_basis or not order):
            raise ValueError("bspline needs n_basis and order")
        self.n_components, self.centering, self.bspline, self.n_basis, self.order = n_components, centering, bspline, n_basis, order

    @classmethod
    def test_params(cls) -> dict:
        return {"n_components": 2}

    def _fit(self, df: DataFrame) -> FPCAModel:
        df = as_series(df, self.input_col)
        meta = validate(df, self.needs, self.input_col)
        n, project = meta.min_length, None
        wanted = min(self.n_components, n)
        if self.bspline:
            n_basis = max(self.n_basis, self.order)
            basis = bspline_basis(n, n_basis, self.order)
            project = basis @ np.linalg.pinv(basis)  # series length squared, whatever the number of cases
            wanted = min(wanted, n_basis)
        w = np.sqrt(trapezoid(n))
        loadings, offsets = [], []
        for k in range(meta.n_channels):
            weighted = F.transform(F.element_at(self.input_col, k + 1), lambda v, i: v * F.element_at(F.lit([float(z) for z in w]), i + 1))
            rows = df.select(array_to_vector(weighted).alias("v"))
            mean = np.asarray(rows.select(Summarizer.mean(F.col("v"))).first()[0]) if self.centering else np.zeros(n)
            if project is None and self.centering:
                axes = PCA(k=wanted, inputCol="v", outputCol="s").fit(rows).pc.toArray()
            else:  # second moments by one aggregate of n^2 numbers
                axes = _axes(rows, mean, project, w, wanted)
            axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
            load = (axes * w[:, None]).T
            if project is not None:
                load = load @ project
            loadings.append(load)
            offsets.append(load @ (mean / w))
        return FPCAModel(loadings, offsets, meta)


def _axes(rows: DataFrame, mean: np.ndarray, project: np.ndarray | None, w: np.ndarray, k: int) -> np.ndarray:
    from pyspark.ml.functions import vector_to_array

    def moments(batches):
        import pandas as pd

        gram = 0.0
        for pdf in batches:
            m = np.stack(pdf["v"].map(np.asarray)) - mean
            gram = gram + m.T @ m
        if not np.isscalar(gram):
            i, j = np.indices(gram.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "g": gram.ravel()})

    summed = rows.select(vector_to_array("v").alias("v")).mapInPandas(moments, "i long, j long, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toPandas()
    gram = np.zeros((len(mean),) * 2)
    gram[summed["i"], summed["j"]] = summed["g"]
    if project is not None:
        p = w[:, None] * project / w[None, :]
        gram = p @ gram @ p.T
    values, vectors = np.linalg.eigh(gram)
    return vectors[:, np.argsort(-values)[:k]]
