"""The interval compiler: a catalogue of intervals becomes one projection.

Intervals live in the plan as a literal array of structs, so the plan doesn't grow
with their number. For each, the slice, its sort and its mean are evaluated once, and
only the features that are wanted are built.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from undula.functions import stats
from undula.operators.select import interval
from undula.series import let

#: A feature: the name of a statistic, a function of the values, or a transform of them.
Feature = str | Callable[[Column], Column]


@dataclass(frozen=True)
class Interval:
    start: int
    end: int
    dim: int = 0
    dilation: int = 1


def feature_expression(feature: Feature, values: Column) -> Column:
    """Array of the feature's values (one, unless it is a transform of several)."""
    if isinstance(feature, str):
        return F.array(stats.STATS[feature](values))
    if hasattr(feature, "expression"):
        out = feature.expression(F.array(values))
        return F.flatten(out) if feature.gives_series else out
    return F.array(feature(values).cast("double"))


def _sorted_feature(name: str, s: Column) -> Column | None:
    """Features that a sort has done the work for."""
    if name in ("median", "quantile25", "quantile75"):
        return stats.quantile_of_sorted(s, {"median": 0.5, "quantile25": 0.25, "quantile75": 0.75}[name])
    if name in ("min", "max"):
        return F.get(s, F.lit(0)) if name == "min" else F.get(s, F.size(s) - 1)
    return stats.quantile_of_sorted(s, 0.75) - stats.quantile_of_sorted(s, 0.25) if name == "iqr" else None


def catalogue(intervals: Sequence[Interval]) -> Column:
    return F.array(*(F.struct(F.lit(i.start).alias("a"), F.lit(i.end).alias("b"), F.lit(i.dim).alias("k"), F.lit(i.dilation).alias("d")) for i in intervals))


def interval_features(x: Column, intervals: Sequence[Interval], features: Sequence[Feature], mask: Sequence[bool] | None = None) -> Column:
    """Features of every interval: interval by interval, features within. Masked ones are 0 and not computed."""
    n = len(features)
    if not intervals:
        return F.array().cast("array<double>")
    if mask is None:
        wanted, groups = [[True] * n], [list(intervals)]
    else:  # runs of intervals that share a mask
        wanted, groups = [], []
        for i, one in enumerate(intervals):
            own = list(mask[i * n : (i + 1) * n])
            if wanted and wanted[-1] == own:
                groups[-1].append(one)
            else:
                wanted.append(own)
                groups.append([one])
    parts = [F.flatten(F.transform(catalogue(group), _features_of(x, features, own, any(i.dilation != 1 for i in group)))) for own, group in zip(wanted, groups, strict=True)]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _features_of(x: Column, features: Sequence[Feature], own: Sequence[bool], dilated: bool) -> Callable[[Column], Column]:
    """The features of one catalogue entry, as a lambda over it."""

    def values(i: Column) -> Column:
        return let(interval(F.element_at(x, i["k"] + 1), i["a"], i["b"], i["d"] if dilated else 1), compute)

    def compute(v: Column) -> Column:
        names = [f for f, m in zip(features, own, strict=True) if m and isinstance(f, str)]
        if any(_sorted_feature(f, F.lit(None)) is not None for f in names):
            return let(F.sort_array(v), lambda s: build(v, s))
        return build(v, None)

    def build(v: Column, s: Column | None) -> Column:
        pieces = []
        for f, m in zip(features, own, strict=True):
            if not m:
                pieces.append(F.array(F.lit(0.0)))
            elif s is not None and isinstance(f, str) and (e := _sorted_feature(f, s)) is not None:
                pieces.append(F.array(e))
            else:
                pieces.append(feature_expression(f, v))
        return F.concat(*pieces)

    return values
