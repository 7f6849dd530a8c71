"""Transforms without learned state: each a projection of the series column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from undula.functions import arrow, stats, windows
from undula.operators.base import SeriesTransformer, clamp_order, register
from undula.series import Capabilities, SeriesMeta, let

#: The quantiles of each summary, after its first statistics.
SUMMARIES: dict[str, tuple[tuple[str, ...], tuple[float, ...]]] = {
    "default": (("mean", "std", "min", "max"), (0.25, 0.5, 0.75)),
    "percentiles": ((), (0.2, 0.9, 0.25, 0.5, 0.75, 0.91, 0.98)),
    "bowley": (("min", "max"), (0.1, 0.25, 0.5, 0.75, 0.9)),
    "tukey": (("min", "max"), (0.125, 0.25, 0.5, 0.75, 0.875)),
}


@register("transformer")
class SevenNumberSummaryTransformer(SeriesTransformer):
    """Seven statistics a channel, statistic by statistic over all channels."""

    needs = Capabilities(equal_length_only=False, requires_fit=False)

    def __init__(self, summary_stats: str = "default"):
        super().__init__()
        if summary_stats not in SUMMARIES:
            raise ValueError(f"summary_stats must be one of {sorted(SUMMARIES)}")
        self.summary_stats = summary_stats

    def expression(self, x: Column) -> Column:
        names, qs = SUMMARIES[self.summary_stats]
        per_channel = F.transform(x, lambda c: let(F.sort_array(c), lambda s: F.array(*(stats.STATS[n](c) for n in names), *(stats.quantile_of_sorted(s, q) for q in qs))))
        return let(per_channel, lambda all_: F.flatten(F.transform(F.sequence(F.lit(1), F.lit(len(names) + len(qs))), lambda k: F.transform(all_, lambda c: F.element_at(c, k)))))


@register("transformer")
class AutocorrelationFunctionTransformer(SeriesTransformer):
    """Autocorrelation of each channel at lags 1 to n_lags."""

    gives_series = True

    def __init__(self, n_lags: int | Callable[[SeriesMeta], int] = 100, min_values: int = 0, clamp: bool = False):
        super().__init__()
        self.n_lags, self.min_values, self.clamp = n_lags, min_values, clamp

    @classmethod
    def test_params(cls) -> dict:
        return {"n_lags": 4}

    def bound(self, meta: SeriesMeta) -> AutocorrelationFunctionTransformer:
        return AutocorrelationFunctionTransformer(clamp_order(self.n_lags, self.min_values, meta, self.clamp), self.min_values)

    def expression(self, x: Column) -> Column:
        if callable(self.n_lags):
            raise ValueError("fit it first: n_lags depends on the data")
        n = self.n_lags
        return F.transform(x, lambda c: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: windows.autocorrelation(c, k)))


@register("transformer")
class PeriodogramTransformer(SeriesTransformer):
    """Magnitudes of the first half of each channel's Fourier transform, padded to a power of two."""

    gives_series = True
    needs = Capabilities(equal_length_only=False, requires_fit=False)

    def __init__(self, pad_series: bool = True, pad_with: str = "constant", constant_value: float = 0.0):
        super().__init__()
        self.pad_series, self.pad_with, self.constant_value = pad_series, pad_with, constant_value

    def expression(self, x: Column) -> Column:
        pad, mode, value = self.pad_series, self.pad_with, self.constant_value
        return arrow.per_batch(x, lambda m: arrow.magnitudes(m, pad, mode, value), "array<array<double>>")


@register("transformer")
class ARCoefficientTransformer(SeriesTransformer):
    """Burg's autoregressive coefficients of each channel."""

    gives_series = True

    def __init__(self, order: int | Callable[[SeriesMeta], int] = 100, min_values: int = 0, replace_nan: bool = False, clamp: bool = False):
        super().__init__()
        self.order, self.min_values, self.replace_nan, self.clamp = order, min_values, replace_nan, clamp

    @classmethod
    def test_params(cls) -> dict:
        return {"order": 4}

    def bound(self, meta: SeriesMeta) -> ARCoefficientTransformer:
        return ARCoefficientTransformer(clamp_order(self.order, self.min_values, meta, self.clamp), self.min_values, self.replace_nan)

    def expression(self, x: Column) -> Column:
        if callable(self.order):
            raise ValueError("fit it first: order depends on the data")
        order, replace = self.order, self.replace_nan

        def coefficients(m):
            import numpy as np

            out = arrow.burg(m, order)
            return np.nan_to_num(out, nan=0.0) if replace else out

        return arrow.per_batch(x, coefficients, "array<array<double>>")


@register("transformer")
class FunctionTransformer(SeriesTransformer):
    """Any function of the series column; None is the identity.

    ``func`` maps a Column to a Column. For NumPy code wrap it by
    ``undula.functions.arrow.per_case``.
    """

    needs = Capabilities(equal_length_only=False, requires_fit=False)

    def __init__(self, func: Callable[..., Column] | None = None, validate: bool = True, kw_args: dict | None = None, gives_series: bool = True):
        super().__init__()
        self.func, self.validate, self.kw_args, self.gives_series = func, validate, kw_args, gives_series

    def fit(self, df, params=None):
        return super().fit(df) if self.validate else self

    def expression(self, x: Column) -> Column:
        return x if self.func is None else self.func(x, **(self.kw_args or {}))


@register("transformer")
class TransformerConcatenator(SeriesTransformer):
    """Outputs of several transforms side by side: features one after another, or series joined channel by channel."""

    needs = Capabilities(equal_length_only=False, requires_fit=False)

    def __init__(self, transformers: Sequence[SeriesTransformer], validate: bool = True):
        super().__init__()
        kinds = {t.gives_series for t in transformers}
        if len(kinds) != 1:
            raise ValueError("transformers must all give features, or all give series")
        self.transformers, self.validate, self.gives_series = list(transformers), validate, kinds.pop()

    @classmethod
    def test_params(cls) -> dict:
        return {"transformers": [SevenNumberSummaryTransformer(), SevenNumberSummaryTransformer("tukey")]}

    def bound(self, meta: SeriesMeta) -> TransformerConcatenator:
        return TransformerConcatenator([t.bound(meta) for t in self.transformers], self.validate)

    def expression(self, x: Column) -> Column:
        parts = [t.expression(x) for t in self.transformers]
        if not self.gives_series:
            return F.concat(*parts)
        out = parts[0]
        for more in parts[1:]:
            out = F.zip_with(out, more, lambda p, q: F.concat(p, q))
        return out
