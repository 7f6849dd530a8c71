"""Published figures for the seeded generator, reproduced."""

import numpy as np
import pytest

from undula.operators.intervals import RandomIntervalTransformer, SupervisedIntervalTransformer
from undula.operators.transforms import AutocorrelationFunctionTransformer, PeriodogramTransformer, SevenNumberSummaryTransformer
from undula.sources import generators


def first(df, column):
    return np.array(df.where("case_id = 0").first()[column])


def test_summary(spark):
    df = generators.equal_length(spark, 4, 2, 10, seed=0)
    want = [1.12176987, 1.09468673, 0.52340259, 0.68084237, 0.0, 0.04043679, 1.92732552, 1.85119328, 0.8542758, 0.39514141, 1.14764656, 1.34620131, 1.39573111, 1.64479229]
    assert np.allclose(first(SevenNumberSummaryTransformer().fit_transform(df), "features"), want)


def test_autocorrelation(spark):
    df = generators.equal_length(spark, 4, 2, 20, seed=0)
    got = first(AutocorrelationFunctionTransformer(n_lags=10).fit_transform(df), "x")
    assert np.allclose(got[0], [0.10642255, -0.04497476, -0.27607675, -0.24169331, 0.04717655, 0.07221666, -0.36798515, -0.53768553, 0.07550288, 0.08557519])
    assert np.allclose(got[1], [-0.21166957, 0.24992846, -0.38036068, 0.10243225, -0.18565336, 0.05619381, -0.19569665, 0.28835692, -0.42359509, 0.21378191])


def test_periodogram(spark):
    df = generators.equal_length(spark, 4, 2, 20, seed=0)
    got = first(PeriodogramTransformer().fit_transform(df), "x")
    assert got.shape == (2, 16)
    assert np.allclose(got[0][:4], [22.16456597, 11.08122685, 3.69018936, 2.17665255])
    assert np.allclose(got[1][-2:], [2.27041859, 3.9023142])


def test_random_intervals(spark):
    df = generators.equal_length(spark, 4, 1, 12, seed=0)
    got = first(RandomIntervalTransformer(n_intervals=2, random_state=0).fit_transform(df), "features")
    want = [1.04753424, 0.14925939, 0.8473096, 1.20552675, 1.08976637, 0.96853798, 1.14764656, 1.07628806, 0.18170775, 0.8473096, 1.29178823, 1.08976637, 0.96853798, 1.1907773]
    assert np.allclose(got, want)


@pytest.mark.parametrize(("seed", "n", "width"), [(0, 10, 16)])
def test_equal_intervals_are_kept_once(spark, seed, n, width):
    df = generators.equal_length(spark, 10, 2, 10, seed=seed)
    model = RandomIntervalTransformer(n_intervals=n, features=["mean", "median"], random_state=seed).fit(df)
    assert len(first(model.transform(df), "features")) == width


def test_supervised_intervals(spark):
    df = generators.equal_length(spark, 10, 1, 12, seed=0)
    model = SupervisedIntervalTransformer(n_intervals=1, random_state=0).fit(df)
    got = first(model.transform(df), "features")
    want = [1.4237989, 1.20552675, 0.45060352, 0.13125638, 0.10101093, 0.76688304, 1.92732552, 0.54651945, 3.0, 2.0]
    assert np.allclose(got, want)
    assert model.set_features_to_transform([True] * 9 + [False])
    assert np.allclose(first(model.transform(df), "features"), [*want[:9], 0.0])
    with pytest.raises(ValueError, match="mask"):
        model.set_features_to_transform([True])
    assert not model.set_features_to_transform([1] * 10, raise_error=False)
    fast = SupervisedIntervalTransformer(n_intervals=2, random_state=0, mode="lockstep").fit_transform(df)
    assert len(first(fast, "features")) > 0
