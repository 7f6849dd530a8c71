"""Sliding and offset computations over an array of numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from undula.functions.stats import mean, std2, total
from undula.series import let


def first_order_differences(a: Column) -> Column:
    """x[t+1] - x[t]; one value fewer."""
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.zip_with(F.slice(a, 2, n), F.slice(a, 1, n), lambda p, q: p - q)


def z_normalise_with(a: Column, m: Column, sd: Column) -> Column:
    return F.transform(a, lambda v: F.when(sd > 0, (v - m) / F.when(sd > 0, sd)).otherwise(v - m))


def z_normalise_with_mean(a: Column, about: Column) -> Column:
    return let(F.struct(about.alias("m"), std2(a, about).alias("s")), lambda p: z_normalise_with(a, p["m"], p["s"]))


def z_normalise(a: Column) -> Column:
    """(x - mean) / deviation; a constant series becomes zeros."""
    return z_normalise_with_mean(a, mean(a))


def subsequence(x: Column, start: int | Column, length: int, dilation: int = 1) -> Column:
    """``length`` values of every channel from ``start``, ``dilation`` apart."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.transform(x, lambda c: F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda j: F.element_at(c, start + j * dilation + 1)))


def subsequence_moments(x: Column, start: int | Column, length: int, dilation: int = 1) -> Column:
    """Per channel (values, mean, std) of a subsequence; a variance below 0 counts as 0."""
    return F.transform(subsequence(x, start, length, dilation), lambda s: F.struct(s.alias("values"), mean(s).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), total(F.transform(s, lambda v: v * v)) / F.size(s) - mean(s) * mean(s))).alias("std")))


def _starts(a: Column, length: int, dilation: int) -> Column:
    last = F.size(a) - 1 - (length - 1) * dilation
    return F.sequence(F.lit(0), F.when(last >= 0, last).otherwise(F.raise_error(F.lit("no window of this length and dilation fits"))))


def _window(a: Column, s: Column, length: int, dilation: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda j: F.get(a, s + j * dilation))


def sliding_mean_std(a: Column, length: int, dilation: int = 1) -> Column:
    """Array of (mean, std) of each dilated window."""
    return F.transform(_starts(a, length, dilation), lambda s: let(_window(a, s, length, dilation), lambda w: let(mean(w), lambda m: F.struct(m.alias("mean"), std2(w, m).alias("std")))))


def sliding_dot_product(a: Column, values: Column, length: int, dilation: int = 1) -> Column:
    """Dot product of ``values`` with each dilated window."""
    return F.transform(_starts(a, length, dilation), lambda s: total(F.zip_with(_window(a, s, length, dilation), values, lambda p, q: p * q)))


def autocorrelation(a: Column, lag: Column) -> Column:
    """Pearson correlation of x[:-lag] and x[lag:].

    Squared deviations that sum to 1e-9 at most count as none: 1 if neither side
    varies, 0 if one doesn't.
    """
    n = F.size(a) - lag
    pair = F.struct(F.slice(a, F.lit(1), n).alias("p"), F.slice(a, lag + 1, n).alias("q"))

    def correlate(w: Column) -> Column:
        p, q = w["p"], w["q"]

        def moments(m: Column) -> Column:
            dp, dq = F.transform(p, lambda v: v - m["p"]), F.transform(q, lambda v: v - m["q"])
            return F.struct(total(F.zip_with(dp, dp, lambda u, v: u * v)).alias("pp"), total(F.zip_with(dq, dq, lambda u, v: u * v)).alias("qq"), total(F.zip_with(dp, dq, lambda u, v: u * v)).alias("pq"))

        def ratio(s: Column) -> Column:
            flat_p, flat_q = s["pp"] <= 1e-9, s["qq"] <= 1e-9
            fine = ~flat_p & ~flat_q
            return F.when(flat_p & flat_q, 1.0).when(flat_p | flat_q, 0.0).otherwise(s["pq"] / F.when(fine, F.sqrt(s["pp"]) * F.sqrt(s["qq"])))

        return let(let(F.struct(mean(p).alias("p"), mean(q).alias("q")), moments), ratio)

    return let(pair, correlate)
