"""Containers: validation, conversion, selection, long form."""

import pytest
from pyspark.sql import functions as F

from undula.operators.select import channels_of, check_key, check_mask, interval, select_channels
from undula.series import Capabilities, as_series, from_long, meta_of, pad, to_long, validate
from undula.sources import bundled, generators, tables

SCHEMA = "case_id long, x array<array<double>>, y int"


def frame(spark, *series, y=0):
    return spark.createDataFrame([(i, x, y) for i, x in enumerate(series)], SCHEMA)


@pytest.mark.parametrize(
    ("series", "needs", "message"),
    [
        ([], Capabilities(), "minimum of 1"),
        ([[[1.0, 2.0]], [[1.0, 2.0, 3.0]]], Capabilities(), "same series length"),
        ([[[1.0, 2.0]], [[1.0, 2.0], [1.0, 2.0]]], Capabilities(), "number of channels"),
        ([[[1.0, 2.0], [1.0]]], Capabilities(equal_length_only=False), "differ in length"),
        ([[[1.0, 2.0], [1.0, 3.0]]], Capabilities(univariate_only=True), "multivariate"),
        ([[[1.0]]], Capabilities(), "series length of 1"),
        ([[[1.0, float("nan")]]], Capabilities(), "NaN"),
        ([[[1.0, float("inf")]]], Capabilities(), "infinity"),
        ([[[1.0, None]]], Capabilities(), "null"),
        ([None], Capabilities(), "null"),
        ([[[1.0, 2.0]]], Capabilities(min_cases=2), "minimum of 2"),
    ],
)
def test_bad_collections(spark, series, needs, message):
    with pytest.raises(ValueError, match=message):
        validate(frame(spark, *series), needs)


def test_fitted_shape_is_kept(spark):
    one = validate(frame(spark, [[1.0, 2.0]], [[3.0, 4.0]]), Capabilities())
    assert tuple(one) == (1, 2, 2) and one.n_cases == 2
    with pytest.raises(ValueError, match="channels"):
        validate(frame(spark, [[1.0, 2.0], [3.0, 4.0]]), Capabilities(), like=one)
    with pytest.raises(ValueError, match="length of 3"):
        validate(frame(spark, [[1.0, 2.0, 3.0]]), Capabilities(), like=one)
    with pytest.raises(ValueError, match="y contains"):
        validate(frame(spark, [[1.0, 2.0]], y=None), Capabilities(), y="y")
    validate(frame(spark, [[1.0, float("nan")]]), Capabilities(allow_nan=True))


def test_conversions(spark):
    flat = spark.createDataFrame([(0, [1.0, 2.0])], "case_id long, x array<double>")
    assert as_series(flat).first().x == [[1.0, 2.0]]
    with pytest.raises(ValueError, match="Reshape your data"):
        as_series(spark.createDataFrame([(0, 1.0)], "case_id long, x double"))
    ragged = frame(spark, [[1.0, 2.0], [3.0, 4.0]], [[1.0], [2.0]])
    padded = ragged.select(pad(F.col("x"), meta_of(ragged).max_length).alias("x"), F.flatten(pad(F.col("x"), 2)).alias("f")).collect()
    assert padded[1].x == [[1.0, 0.0], [2.0, 0.0]] and padded[0].f == [1.0, 2.0, 3.0, 4.0]
    back = from_long(to_long(ragged).repartition(3)).orderBy("case_id").collect()
    assert [r.x for r in back] == [[[1.0, 2.0], [3.0, 4.0]], [[1.0], [2.0]]]


def test_selection(spark):
    df = frame(spark, [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])
    for key, want in ((1, [1]), ([2, 0], [2, 0]), (slice(1, None), [1, 2]), (-1, [2])):
        channels = channels_of(key, 3)
        assert channels == want
        assert [c[0] for c in df.select(select_channels(F.col("x"), channels).alias("x")).first().x] == [1.0 + 2 * k for k in want]
    for bad in ("a", 1.5, [], [True], slice(0, 2, 2)):
        with pytest.raises(ValueError, match="channels"):
            check_key(bad)
    with pytest.raises(ValueError, match="out of range"):
        channels_of(3, 3)
    a = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda v: v.cast("double")).alias("a"))
    assert a.select(interval(F.col("a"), 1, 8, 3).alias("s")).first().s == [1.0, 4.0, 7.0]
    assert check_mask([True, False], 2) and not check_mask([1, 0], 2, raise_error=False)


def test_generators(spark):
    assert tuple(meta_of(generators.equal_length(spark, 5, 2, 9, seed=1))) == (2, 9, 9)
    assert tuple(meta_of(generators.unequal_length(spark, 6, 1, 5, 9, seed=1))) == (1, 5, 9)
    assert generators.univariate(spark, seed=0).schema["x"].dataType.simpleString() == "array<double>"
    assert generators.equal_length(spark, 8, regression=True, seed=0).agg(F.avg("y")).first()[0] > 0


@pytest.mark.parametrize("name", bundled.SHAPES)
def test_bundled(spark, name):
    both = bundled.load(spark, name)
    assert both.count() == 40 and both.select("case_id").distinct().count() == 40
    channels, train, test, _ = bundled.SHAPES[name]
    assert tuple(meta_of(bundled.load(spark, name, "train"))) == (channels, *train)
    assert tuple(meta_of(getattr(bundled, f"load_{name}")(spark, "TEST"))) == (channels, *test)
    with pytest.raises(ValueError, match="split"):
        bundled.load(spark, name, "ALL")


def test_tables(spark):
    sf = "/root/testdata/sf0.001"
    assert tuple(meta_of(tables.embeddings(spark, sf))) == (1, 64, 64)
    assert meta_of(tables.daily_events(spark, sf)).n_channels == 5 and meta_of(tables.daily_events(spark, sf)).equal_length
    assert meta_of(tables.customer_prices(spark, sf)).n_cases > 0
