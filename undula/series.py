"""Collections of series as DataFrames.

Canonical form: ``case_id``, ``x ARRAY<ARRAY<DOUBLE>>`` (outer: channels, inner: values in
order of time), optionally ``y``. Every operator is a projection of ``x``, so series stay
in the partition that reads them; the long form (case_id, ch, t, v) is made on demand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

X = "x"
CASE = "case_id"


@dataclass(frozen=True)
class SeriesMeta:
    """What one aggregate tells about a collection."""

    n_cases: int
    n_channels: int
    min_length: int
    max_length: int

    @property
    def equal_length(self) -> bool:
        return self.min_length == self.max_length

    def __iter__(self):
        return iter((self.n_channels, self.min_length, self.max_length))


@dataclass(frozen=True)
class Capabilities:
    """What an operator accepts; the defaults are the strictest ones."""

    equal_length_only: bool = True
    univariate_only: bool = False
    allow_nan: bool = False
    requires_fit: bool = True
    requires_y: bool = False
    validates: bool = True
    non_deterministic: bool = False
    min_cases: int = 1
    min_length: int = 2


def depth(kind: T.DataType) -> int:
    return 1 + depth(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def as_series(df: DataFrame, x: str = X) -> DataFrame:
    """``df`` with ``x`` in canonical form; one array of numbers is a single channel."""
    kind = df.schema[x].dataType
    if depth(kind) not in (1, 2):
        raise ValueError(f"{x} must be an array of numbers or of channels, not {kind.simpleString()}. Reshape your data")
    return df.withColumn(x, canonical(F.col(x), depth(kind)))


def canonical(x: Column, levels: int = 2) -> Column:
    return x.cast("array<array<double>>") if levels == 2 else F.array(x.cast("array<double>"))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _non_finite(x: Column) -> Column:
    return F.exists(x, lambda c: F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))))


def meta_of(df: DataFrame, x: str = X) -> SeriesMeta:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(x)).alias("c"), F.min(F.array_min(F.transform(x, F.size))).alias("lo"), F.max(F.array_max(F.transform(x, F.size))).alias("hi")).first()
    return SeriesMeta(row.n, row.c or 0, row.lo or 0, row.hi or 0)


def validate(df: DataFrame, needs: Capabilities = Capabilities(), x: str = X, y: str | None = None, like: SeriesMeta | None = None) -> SeriesMeta:
    """Check a collection in one aggregate, and against the one an operator was fitted on."""
    lengths = F.transform(x, F.size)
    checks = [
        F.count(F.lit(1)).alias("n"),
        F.min(F.size(x)).alias("c_lo"),
        F.max(F.size(x)).alias("c_hi"),
        F.min(F.array_min(lengths)).alias("lo"),
        F.max(F.array_max(lengths)).alias("hi"),
        F.max(F.array_min(lengths) != F.array_max(lengths)).alias("ragged"),
        F.max(F.col(x).isNull() | F.coalesce(F.exists(x, lambda c: c.isNull()), F.lit(False))).alias("nulls"),
        F.max(_non_finite(F.col(x))).alias("odd"),
    ]
    if y:
        checks.append(F.max(F.col(y).isNull()).alias("no_y"))
    r = df.agg(*checks).first()
    if r.n < needs.min_cases:
        raise ValueError(f"Found {r.n} cases, a minimum of {needs.min_cases} is required")
    if r.nulls:
        raise ValueError("a series or a channel is null")
    if r.c_lo != r.c_hi:
        raise ValueError("the number of channels is not consistent across cases")
    if not r.c_lo:
        raise ValueError("Found 0 channels, a minimum of 1 is required")
    if r.ragged:
        raise ValueError("channels of a case differ in length")
    if needs.univariate_only and r.c_hi > 1:
        raise ValueError("the data is multivariate, a univariate series is required")
    if needs.equal_length_only and r.lo != r.hi:
        raise ValueError("not all arrays have the same series length")
    if r.lo < needs.min_length:
        raise ValueError(f"Found a series length of {r.lo}, a minimum of {needs.min_length} is required")
    if not needs.allow_nan and r.odd:
        raise ValueError("Input contains NaN, infinity or null values")
    if y and r.no_y:
        raise ValueError("y contains null values")
    if like and like.n_channels != r.c_hi:
        raise ValueError(f"X has {r.c_hi} channels, but {like.n_channels} are expected")
    if like and needs.equal_length_only and like.min_length != r.lo:
        raise ValueError(f"X has a series length of {r.lo}, but {like.min_length} is expected")
    return SeriesMeta(r.n, r.c_hi, r.lo, r.hi)


def guarded(df: DataFrame, needs: Capabilities, like: SeriesMeta, x: str = X) -> DataFrame:
    """``df`` with ``x`` checked row by row where it is used: the same rules as ``validate``, inside the plan.

    Nothing is read for it, so a fitted operator is a projection, on a stream too. A row
    that breaks a rule fails the query with the rule's message.
    """
    c, sizes = F.col(x), F.transform(x, F.size)
    rules = [
        (c.isNull() | F.coalesce(F.exists(x, lambda v: v.isNull()), F.lit(False)), F.lit("a series or a channel is null")),
        (F.size(x) != like.n_channels, F.format_string(f"X has %d channels, but {like.n_channels} are expected", F.size(x))),
        (F.array_min(sizes) != F.array_max(sizes), F.lit("channels of a case differ in length")),
        (F.array_min(sizes) < needs.min_length, F.format_string(f"Found a series length of %d, a minimum of {needs.min_length} is required", F.array_min(sizes))),
    ]
    if needs.equal_length_only:
        rules.append((F.array_min(sizes) != like.min_length, F.format_string(f"X has a series length of %d, but {like.min_length} is expected", F.array_min(sizes))))
    if not needs.allow_nan:
        rules.append((_non_finite(c), F.lit("Input contains NaN, infinity or null values")))
    kind = df.schema[x].dataType
    checked = F.when(rules[0][0], F.raise_error(rules[0][1]).cast(kind))
    for broken, message in rules[1:]:
        checked = checked.when(broken, F.raise_error(message).cast(kind))
    return df.withColumn(x, checked.otherwise(c))


def pad(x: Column, length: int | Column) -> Column:
    """Channels with zeros at the end up to ``length``; a longer series is an error of the caller's."""
    return F.transform(x, lambda c: F.concat(c, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(length) - F.size(c) if isinstance(length, int) else length - F.size(c)))))


def flatten(x: Column) -> Column:
    """Channels one after another."""
    return F.flatten(x)


def to_long(df: DataFrame, x: str = X, keep: tuple[str, ...] = (CASE,)) -> DataFrame:
    """(keep..., ch, t, v); empty channels have no rows."""
    channels = df.select(*keep, F.posexplode(x).alias("ch", "c"))
    return channels.select(*keep, "ch", F.posexplode("c").alias("t", "v"))


def from_long(df: DataFrame, keep: tuple[str, ...] = (CASE,)) -> DataFrame:
    """Canonical form from (keep..., ch, t, v): one shuffle by case; order comes from t and ch."""
    channels = df.groupBy(*keep, "ch").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("c"))
    cases = channels.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("ch", "c"))).alias("x"))
    return cases.withColumn("x", F.transform("x", lambda ch: F.transform(ch["c"], lambda p: p["v"].cast("double"))))
