"""Every operator, fitted or not, is the same after it has been written and read; fitted ones run on streams and read once."""

import pytest
from pyspark.sql import functions as F

from tests.test_conformance import make, rounded
from undula.learn.storage import load, save
from undula.operators.base import all_operators
from undula.operators.fpca import FPCATransformer
from undula.operators.intervals import RandomIntervalTransformer, SupervisedIntervalTransformer
from undula.sources import generators


@pytest.fixture(scope="module")
def train(spark):
    return generators.equal_length(spark, 12, 1, 20, seed=3).coalesce(1).cache()


@pytest.mark.parametrize("name", [n for n, _ in all_operators()])
def test_round_trip(spark, tmp_path, train, name):
    kind, cls = next((k, c) for k in ("classifier", "regressor", "transformer", "clusterer") for n, c in all_operators(k) if n == name)
    df = train.withColumn("y", F.col("y").cast("double")) if kind == "regressor" else train
    model = make(cls).fit(df)
    save(model, f"file://{tmp_path}/fitted", spark)
    again = load(f"file://{tmp_path}/fitted", spark)
    assert type(again) is type(model) and rounded(again.transform(df)) == rounded(model.transform(df))
    save(make(cls), f"file://{tmp_path}/plain", spark)
    assert type(load(f"file://{tmp_path}/plain", spark)) is cls


def test_grail_neighbours_keep_their_cases(spark, tmp_path, train):
    from undula.learn.grail import GRAILClassifier

    model = GRAILClassifier("knn", random_state=0).fit(train)
    save(model, f"file://{tmp_path}/knn", spark)
    assert rounded(load(f"file://{tmp_path}/knn", spark).transform(train)) == rounded(model.transform(train))


FITTED = {"random": lambda: RandomIntervalTransformer(3, random_state=0), "supervised": lambda: SupervisedIntervalTransformer(1, random_state=0), "fpca": lambda: FPCATransformer(2)}


@pytest.mark.parametrize("name", FITTED)
def test_a_fitted_transform_is_a_projection(spark, tmp_path, train, name):
    train.write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    model = FITTED[name]().fit(train)
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    out = model.transform(df)
    assert len(tracker.getJobIdsForGroup(None)) == before  # nothing has been read yet
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    stream = model.transform(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination(120)
    assert rounded(spark.read.parquet(str(tmp_path / "out"))) == rounded(out)
    wrong = df.withColumn("x", F.transform("x", lambda c: F.slice(c, 1, 9)))
    with pytest.raises(Exception, match="X has a series length of 9, but 20 is expected"):
        model.transform(wrong).collect()
    odd = df.withColumn("x", F.transform("x", lambda c: F.transform(c, lambda v, i: F.when(i == 2, F.lit(float("inf"))).otherwise(v))))
    with pytest.raises(Exception, match="NaN, infinity or null"):
        model.transform(odd).collect()
