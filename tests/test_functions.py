"""Column expressions against NumPy."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.functions import arrow, stats, windows

SERIES = {"plain": [3.0, -1.0, 4.0, 1.5, -5.0, 9.0, 2.0, 6.0], "odd": [2.0, 7.0, 1.0, 8.0, 2.5], "constant": [4.0] * 6, "single": [5.0], "pair": [1.0, -2.0], "half": [1.0, 1.0, 1.0, 1.0, 2.0, 5.0, 3.0]}


def evaluate(spark, a, *columns):
    df = spark.createDataFrame([(a,)], "a array<double>")
    return df.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


@pytest.mark.parametrize("name", SERIES)
def test_statistics(spark, name):
    a = np.array(SERIES[name])
    m, n = a.mean(), len(a)
    t = np.arange(n)
    above = a > m
    want = {
        "mean": m, "std": a.std(), "min": a.min(), "max": a.max(), "median": np.median(a), "quantile25": np.quantile(a, 0.25), "quantile75": np.quantile(a, 0.75),
        "slope": np.polyfit(t, a, 1)[0] if n > 1 else 0.0, "iqr": np.quantile(a, 0.75) - np.quantile(a, 0.25), "ppv": (a > 0).mean(), "count_above_mean": above.sum(),
        "count_mean_crossing": (above[1:] != above[:-1]).sum(),
    }
    got = evaluate(spark, SERIES[name], *(f(F.col("a")) for f in stats.STATS.values()))
    for value, key in zip(got, stats.STATS, strict=True):
        assert value == pytest.approx(float(want[key]), abs=1e-9), key


def test_mean_is_rounded_once(spark):
    rng = np.random.default_rng(0)
    series = [[1e16, 1.0, -1e16, 1.0], [5e-324, 0.0, 1e-323], [0.1] * 1001, *(rng.exponential(50, n).round(2).tolist() for n in (1, 2, 3, 66, 67, 500) for _ in range(20))]
    odd = [([math.inf, 1.0], math.inf), ([math.nan, 1.0], math.nan), ([-math.inf, math.inf], math.nan), ([1e301, 3e301], 2e301)]
    df = spark.createDataFrame([*((a, float(sum(map(Fraction, a)) / len(a))) for a in series), *odd], "a array<double>, want double")
    got = df.select(stats.mean_rounded_once(F.col("a")).alias("got"), "want").collect()
    assert len(got) == len(series) + len(odd)
    assert all(x.got == x.want or math.isnan(x.got) and math.isnan(x.want) for x in got)


@pytest.mark.parametrize("order", [1, -1])
@pytest.mark.parametrize("cents", [[10] * 10, [7391, 4113, 3573, 2774, 1310, 5517], [1271, 4659, 3959, 3369, 2511, 7985]])
def test_a_value_at_the_mean_is_not_above_it(spark, cents, order):
    a = [k / 100 for k in cents[::order]]
    assert sum(cents) % len(cents) == 0 and sum(cents) // len(cents) in cents
    assert evaluate(spark, a, stats.count_above_mean(F.col("a")))[0] == sum(k * len(cents) > sum(cents) for k in cents)


def test_index_rule(spark):
    s = sorted(SERIES["plain"])
    got = evaluate(spark, SERIES["plain"], stats.index_median(F.col("a")), stats.index_quantiles(F.col("a"), [0.25, 0.75]))
    assert got[0] == (s[3] + s[4]) / 2
    assert got[1] == [(s[1] + s[2]) / 2, (s[5] + s[6]) / 2]
    assert evaluate(spark, SERIES["odd"], stats.index_quantile75(F.col("a")))[0] == sorted(SERIES["odd"])[3]
    with pytest.raises(ValueError, match="range"):
        stats.index_quantile(F.col("a"), 1.5)
    with pytest.raises(Exception, match="undefined"):
        evaluate(spark, SERIES["plain"], stats.index_quantile(F.col("a"), 1.0))


def test_counts_and_pairs(spark):
    got = evaluate(spark, [2.0, 1.0, 2.0], stats.unique_count(F.col("a")), stats.combinations_1d(F.col("a"), F.col("a")), stats.unique_count(F.array().cast("array<double>")))
    assert [tuple(x) for x in got[0]] == [(1.0, 1), (2.0, 2)]
    assert [tuple(x) for x in got[1]] == [(2, 2), (1, 1)]
    assert got[2] == []
    assert stats.prime_up_to(20) == [2, 3, 5, 7, 11, 13, 17, 19] and stats.is_prime(2) and not stats.is_prime(1)


def test_fisher(spark):
    rows = [(0, 1.0), (0, 1.0), (1, 3.0), (1, 5.0), (1, 4.0)]
    df = spark.createDataFrame(rows, "y int, v double")
    v, y = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    top = sum((y == k).sum() * (v[y == k].mean() - v.mean()) ** 2 for k in (0, 1))
    low = sum((y == k).sum() * max(v[y == k].std(), 1e-6) ** 2 for k in (0, 1))
    assert stats.fisher_score(df, "v", "y").first().score == pytest.approx(top / low)


@pytest.mark.parametrize("name", ["plain", "constant", "half"])
def test_windows(spark, name):
    a = np.array(SERIES[name])
    col = F.col("a")
    got = evaluate(spark, SERIES[name], windows.first_order_differences(col), windows.z_normalise(col), windows.sliding_mean_std(col, 3, 2), windows.sliding_dot_product(col, F.array(F.lit(1.0), F.lit(-2.0)), 2, 3), F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: windows.autocorrelation(col, k)))
    assert np.allclose(got[0], np.diff(a))
    assert np.allclose(got[1], (a - a.mean()) / (a.std() or 1.0))
    strided = [a[s : s + 5 : 2] for s in range(len(a) - 4)]
    assert np.allclose([w.mean for w in got[2]], [w.mean() for w in strided])
    assert np.allclose([w["std"] for w in got[2]], [w.std() for w in strided])
    assert np.allclose(got[3], [a[s] - 2 * a[s + 3] for s in range(len(a) - 3)])
    for k, value in enumerate(got[4], 1):
        p, q = a[:-k], a[k:]
        flat = [((x - x.mean()) ** 2).sum() <= 1e-9 for x in (p, q)]
        assert value == pytest.approx(1.0 if all(flat) else 0.0 if any(flat) else np.corrcoef(p, q)[0, 1])
    with pytest.raises(Exception, match="window"):
        evaluate(spark, SERIES["pair"], windows.sliding_mean_std(col, 3))


def test_subsequence(spark):
    df = spark.createDataFrame([([SERIES["plain"], SERIES["plain"][::-1]],)], "x array<array<double>>")
    got = df.select(windows.subsequence_moments(F.col("x"), 1, 3, 2).alias("s")).first().s
    for c, a in zip(got, (np.array(SERIES["plain"]), np.array(SERIES["plain"][::-1])), strict=True):
        assert np.allclose(c["values"], a[1:7:2]) and c["mean"] == pytest.approx(a[1:7:2].mean()) and c["std"] == pytest.approx(a[1:7:2].std())


def test_burg_recovers_a_process():
    rng = np.random.RandomState(0)
    a = np.zeros(4000)
    for i in range(2, 4000):
        a[i] = 0.6 * a[i - 1] - 0.3 * a[i - 2] + rng.normal()
    assert np.allclose(arrow.burg(a, 2), [0.6, -0.3], atol=0.05)
    assert np.isnan(arrow.burg(np.zeros(10), 2)).all()
