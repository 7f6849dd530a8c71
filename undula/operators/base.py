"""What all operators share: a registry, and the form of MLlib stages.

Transformers and estimators are MLlib stages, so ``Pipeline`` composes them. A
transform without state needs no fitting; ``fit`` then validates and returns it.
"""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable

from pyspark.ml import Estimator, Model, Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.series import Capabilities, SeriesMeta, as_series, validate

TYPES = ("classifier", "clusterer", "regressor", "transformer")
#: Modules that register operators.
MODULES = [f"undula.{m}" for m in ("operators.transforms", "operators.intervals", "operators.fpca", "learn.compose", "learn.dummy", "learn.grail", "learn.pipelines", "learn.shapelets", "learn.symbolic")]
_registry: dict[str, tuple[str, type]] = {}


def register(kind: str) -> Callable[[type], type]:
    """Class decorator: list an operator under its name and type."""

    def add(cls: type) -> type:
        _registry[cls.__name__] = (kind, cls)
        return cls

    return add


def all_operators(type_filter: str | list[str] | None = None) -> list[tuple[str, type]]:
    """(name, class) of every operator, or of some types, sorted by name."""
    wanted = TYPES if type_filter is None else (type_filter,) if isinstance(type_filter, str) else tuple(type_filter)
    if set(wanted) - set(TYPES):
        raise ValueError(f"type_filter must be among {TYPES} or None, got {type_filter!r}")
    for module in MODULES:
        importlib.import_module(module)
    return sorted((name, cls) for name, (kind, cls) in _registry.items() if kind in wanted)


def is_transformer(operator: object) -> bool:
    return _registry.get(type(operator).__name__, ("",))[0] == "transformer" or isinstance(operator, Transformer)


def is_clusterer(operator: object) -> bool:
    return _registry.get(type(operator).__name__, ("",))[0] == "clusterer"


class Configured:
    """Constructor arguments as attributes; ``test_params`` is a small configuration."""

    needs = Capabilities()

    @classmethod
    def test_params(cls) -> dict:
        return {}

    def clone(self, random_state: int | None = None):
        """A fresh operator of the same configuration, with another seed if one is given."""
        new = type(self)(**{k: getattr(self, k) for k in self._names()})
        if random_state is not None and hasattr(new, "random_state"):
            new.random_state = random_state
        return new

    def _names(self) -> list[str]:
        code = type(self).__init__.__code__
        return [*code.co_varnames[1 : code.co_argcount + code.co_kwonlyargcount]]


class SeriesTransformer(Transformer, Configured):
    """A projection of ``x``: to a feature array (``features``), or to series (``x``)."""

    needs = Capabilities(requires_fit=False)
    input_col = "x"
    #: Whether the result is a series (array of arrays), which then replaces the input.
    gives_series = False

    @property
    def output_col(self) -> str:
        return self.input_col if self.gives_series else "features"

    def expression(self, x: Column) -> Column:
        raise NotImplementedError

    def bound(self, meta: SeriesMeta) -> SeriesTransformer:
        """This transform with settings that depend on a collection resolved."""
        return self

    def fit(self, df: DataFrame, params=None) -> SeriesTransformer:
        return self.bound(validate(as_series(df, self.input_col), self.needs, self.input_col))

    def _transform(self, df: DataFrame) -> DataFrame:
        return as_series(df, self.input_col).withColumn(self.output_col, self.expression(F.col(self.input_col)))

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class SeriesEstimator(Estimator, Configured):
    """An operator that learns; ``_fit`` gives the model."""

    input_col = "x"
    label_col = "y"

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class SeriesModel(Model):
    """A fitted operator: ``expression`` of ``x`` unless ``_transform`` says otherwise."""

    input_col = "x"
    output_col = "features"

    def expression(self, x: Column) -> Column:
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        return as_series(df, self.input_col).withColumn(self.output_col, self.expression(F.col(self.input_col)))


def clamp_order(wanted: int | Callable[[SeriesMeta], int], least: int, meta: SeriesMeta, clamp: bool = False) -> int:
    """Number of lags or coefficients: at most n - ``least``, at least 1, and less than n.

    ``clamp``: take n - 1 where the number would be too large, instead of an error.
    """
    order = wanted(meta) if callable(wanted) else wanted
    order = min(order, meta.min_length - least)
    order = 1 if order < 0 else order
    if order > meta.min_length - 1:
        if clamp:
            return meta.min_length - 1
        raise ValueError(f"the number of lags ({order}) exceeds the series length less one ({meta.min_length - 1})")
    return order


def check_n_jobs(n_jobs: int | None) -> int:
    """Threads that a number of jobs stands for: none or 0 is 1, negative ones count from all cores.

    Spark schedules tasks itself, so operators don't take the number; this serves code that does.
    """
    if n_jobs is not None and (not isinstance(n_jobs, int) or isinstance(n_jobs, bool)):
        raise ValueError(f"n_jobs must be None or an integer, not {n_jobs!r}")
    if not n_jobs:
        return 1
    return n_jobs if n_jobs > 0 else max(1, (os.cpu_count() or 1) + 1 + n_jobs)
