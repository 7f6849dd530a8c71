"""Statistics of an array of numbers, as column expressions.

``a`` is an ARRAY<DOUBLE>; ``rows(f)`` maps a statistic over the channels of a case.
Nothing here shuffles. Standard deviations divide by n.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.series import let

Stat = Callable[[Column], Column]


def rows(stat: Stat) -> Stat:
    """The statistic of each inner array."""
    return lambda x: F.transform(x, stat)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def mean_rounded_once(a: Column) -> Column:
    """The mean as one rounding of the exact one gives it, in whatever order the values are.

    What each addition rounds off is summed too (Knuth), and so is what the division leaves
    (Dekker's product). NaN, infinite sums and means beyond 1e300 are as in ``mean``.
    """

    def add(s: Column, v: Column) -> Column:
        t = s["hi"] + v
        u = t - s["hi"]
        return F.struct(t.alias("hi"), (s["lo"] + ((s["hi"] - (t - u)) + (v - u))).alias("lo"))

    def divide(s: Column, n: Column) -> Column:
        def refine(q: Column) -> Column:
            c = q * F.lit(float(2**27 + 1))
            high = c - (c - q)
            m = q + (((s["hi"] - high * n) - (q - high) * n) + s["lo"]) / n
            return F.when(F.isnan(m), q).otherwise(m)

        return let(s["hi"] / n, refine)

    return let(F.aggregate(a, F.struct(F.lit(0.0).alias("hi"), F.lit(0.0).alias("lo")), add), lambda s: divide(s, F.size(a)))


def std2(a: Column, about: Column) -> Column:
    """Deviation about a given mean."""
    return let(about, lambda m: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.size(a)))


def std(a: Column) -> Column:
    return std2(a, mean(a))


def minimum(a: Column) -> Column:
    return F.array_min(a)


def maximum(a: Column) -> Column:
    return F.array_max(a)


def quantile_of_sorted(s: Column, q: float) -> Column:
    """Linear interpolation at q * (n - 1)."""
    place = F.lit(float(q)) * (F.size(s) - 1)
    low = F.floor(place).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
    return a + (b - a) * (place - low)


def quantile(a: Column, q: float) -> Column:
    return let(F.sort_array(a), lambda s: quantile_of_sorted(s, q))


def quantiles(a: Column, qs: Sequence[float]) -> Column:
    """Several quantiles after one sort."""
    return let(F.sort_array(a), lambda s: F.array(*(quantile_of_sorted(s, q) for q in qs)))


def median(a: Column) -> Column:
    return quantile(a, 0.5)


def quantile25(a: Column) -> Column:
    return quantile(a, 0.25)


def quantile75(a: Column) -> Column:
    return quantile(a, 0.75)


def iqr(a: Column) -> Column:
    return let(F.sort_array(a), lambda s: quantile_of_sorted(s, 0.75) - quantile_of_sorted(s, 0.25))


def _index_rule(s: Column, q: float) -> Column:
    n = F.size(s)
    i = F.floor(n * F.lit(float(q))).cast("int")
    fault = F.raise_error(F.lit("the quantile is undefined at this end of the series"))
    odd = F.when(i < n, F.get(s, i)).otherwise(fault)
    even = F.when((i >= 1) & (i < n), (F.get(s, i - 1) + F.get(s, i)) / 2).otherwise(fault)
    return F.when(n % 2 == 1, odd).otherwise(even)


def index_quantile(a: Column, q: float) -> Column:
    """The rule without interpolation: element floor(n q), for even n its mean with the one before."""
    if not 0 <= q <= 1:
        raise ValueError("q must be in the range 0 to 1")
    return let(F.sort_array(a), lambda s: _index_rule(s, q))


def index_quantiles(a: Column, qs: Sequence[float]) -> Column:
    if any(not 0 <= q <= 1 for q in qs):
        raise ValueError("q must be in the range 0 to 1")
    return let(F.sort_array(a), lambda s: F.array(*(_index_rule(s, q) for q in qs)))


def index_median(a: Column) -> Column:
    return index_quantile(a, 0.5)


def index_quantile25(a: Column) -> Column:
    return index_quantile(a, 0.25)


def index_quantile75(a: Column) -> Column:
    return index_quantile(a, 0.75)


def _dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: p * q))


def slope(a: Column) -> Column:
    """Least-squares slope over positions 0 to n-1; 0 for a single value."""
    n = F.size(a).cast("double")
    spread = n * (n * n - 1) / 12
    moment = total(F.transform(a, lambda v, i: v * (i - (n - 1) / 2)))
    return F.when(n > 1, moment / F.when(n > 1, spread)).otherwise(0.0)


def ppv(a: Column) -> Column:
    """Share of values above 0."""
    return F.size(F.filter(a, lambda v: v > 0)) / F.size(a)


def count_above_mean(a: Column) -> Column:
    """How many values are above the mean, rounded once: one that equals it isn't, in any order."""
    return let(mean_rounded_once(a), lambda m: F.size(F.filter(a, lambda v: v > m))).cast("double")


def count_mean_crossing(a: Column) -> Column:
    """How often neighbours lie on different sides of the mean (above it, or not)."""
    above = let(mean(a), lambda m: F.transform(a, lambda v: v > m))
    return let(above, lambda f: F.size(F.filter(F.zip_with(F.slice(f, 1, F.size(f) - 1), F.slice(f, 2, F.size(f) - 1), lambda p, q: p != q), lambda d: d))).cast("double")


def unique_count(a: Column) -> Column:
    """Array of (value, count) in order of value; empty for an empty array."""
    return F.transform(F.array_sort(F.array_distinct(a)), lambda u: F.struct(u.alias("value"), F.size(F.filter(a, lambda v: v == u)).alias("count")))


def combinations_1d(x: Column, y: Column) -> Column:
    """Distinct pairs (x[i], y[i]) as integers, in the order of their first appearance."""
    return F.array_distinct(F.zip_with(x, y, lambda p, q: F.struct(p.cast("int").alias("x"), q.cast("int").alias("y"))))


#: Names by which interval features and summaries can be given.
STATS: dict[str, Stat] = {
    "mean": mean, "std": std, "min": minimum, "max": maximum, "median": median, "quantile25": quantile25, "quantile75": quantile75,
    "slope": slope, "iqr": iqr, "ppv": ppv, "count_above_mean": count_above_mean, "count_mean_crossing": count_mean_crossing,
}


def fisher_score(df: DataFrame, value: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., score): between-class over within-class spread of a feature.

    Class deviations are at least 1e-6. Two levels of partial aggregates: what is
    shuffled is a row a class and task.
    """
    per_class = df.groupBy(*by, label).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.sum(value).alias("t"))
    floor = F.greatest(F.col("s"), F.lit(1e-6))
    sums = per_class.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.collect_list(F.struct("n", "m", (F.col("n") * floor * floor).alias("within"))).alias("c"))
    overall = F.col("t") / F.col("n")
    between = F.aggregate("c", F.lit(0.0), lambda acc, c: acc + c["n"] * (c["m"] - overall) * (c["m"] - overall))
    within = F.aggregate("c", F.lit(0.0), lambda acc, c: acc + c["within"])
    return sums.select(*by, F.when(within == 0, 0.0).otherwise(between / F.when(within != 0, within)).alias("score"))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def prime_up_to(n: int) -> list[int]:
    """Primes not above n."""
    return [k for k in range(2, n + 1) if is_prime(k)]
