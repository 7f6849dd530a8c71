"""Held-out accuracy on well-separated classes, and options of the learners."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from undula.learn.dummy import DummyClassifier, DummyClusterer, DummyRegressor
from undula.learn.grail import GRAILClassifier
from undula.learn.pipelines import FPCAClassifier, FPCARegressor, RandomIntervalClassifier, SupervisedIntervalClassifier
from undula.learn.shapelets import RandomShapeletForestClassifier, nearest
from undula.learn.symbolic import MrSEQLClassifier, MrSQMClassifier
from undula.operators.fpca import FPCATransformer, bspline_basis
from undula.operators.neighbours import nearest_neighbours
from undula.sources import generators


@pytest.fixture(scope="module")
def waves(spark):
    """Slow and fast waves with noise."""
    rng = np.random.RandomState(0)
    rows = []
    for i in range(60):
        t, k = np.arange(40), i % 2
        rows.append((i, [(np.sin(t * (0.25 if k else 0.7) + rng.uniform(0, 6)) + rng.normal(0, 0.2, 40)).tolist()], "fast slow".split()[k]))
    return spark.createDataFrame(rows, "case_id long, x array<array<double>>, y string").coalesce(2).cache()


MODELS = {
    "random intervals": lambda: RandomIntervalClassifier(n_intervals=20, features=["slope", "std", "count_mean_crossing"], estimator=RandomForestClassifier(numTrees=20, seed=0), random_state=0),
    "supervised intervals": lambda: SupervisedIntervalClassifier(n_intervals=2, estimator=RandomForestClassifier(numTrees=20, seed=0), random_state=0),
    "shapelets": lambda: RandomShapeletForestClassifier(n_estimators=10, n_shapelets=4, random_state=0),
    "sax": lambda: MrSEQLClassifier(random_state=0),
    "sfa": lambda: MrSQMClassifier(nsfa=2, features_per_rep=50, random_state=0),
    "grail": lambda: GRAILClassifier("logistic", random_state=0),
    "grail neighbours": lambda: GRAILClassifier("knn", random_state=0),
    "grail svm": lambda: GRAILClassifier("svm", random_state=0, costs=[1.0, 100.0]),
}


@pytest.mark.parametrize("name", MODELS)
def test_accuracy(waves, name):
    train, test = waves.where("case_id < 40"), waves.where("case_id >= 40")
    assert MODELS[name]().fit(train).transform(test).agg(F.avg((F.col("y") == F.col("prediction")).cast("double"))).first()[0] >= 0.85


def test_fpca(spark):
    rng = np.random.RandomState(1)
    t = np.linspace(0, 1, 15)
    a, b = rng.normal(0, 3, 40), rng.normal(0, 1, 40)
    rows = [(i, [(5 + a[i] * np.sin(2 * np.pi * t) + b[i] * np.cos(2 * np.pi * t)).tolist()], float(a[i])) for i in range(40)]
    df = spark.createDataFrame(rows, "case_id long, x array<array<double>>, y double")
    scores = np.array([r.features for r in FPCATransformer(n_components=2).fit_transform(df).orderBy("case_id").collect()])
    assert np.allclose(scores.mean(0), 0, atol=1e-9) and abs(np.corrcoef(scores[:, 0], a)[0, 1]) > 0.99
    basis = bspline_basis(15, 8, 4)
    assert np.allclose(basis.sum(1), 1) and basis.shape == (15, 8)
    smooth = np.array([r.features for r in FPCATransformer(n_components=2, bspline=True, n_basis=10, order=4).fit_transform(df).orderBy("case_id").collect()])
    assert abs(np.corrcoef(smooth[:, 0], a)[0, 1]) > 0.99
    out = FPCARegressor(n_components=2).fit(df).transform(df)
    assert out.agg(F.corr("y", "prediction")).first()[0] > 0.99
    with pytest.raises(ValueError, match="n_basis"):
        FPCATransformer(bspline=True)
    assert FPCAClassifier(n_components=2).fit(df.withColumn("y", (F.col("y") > 0).cast("int"))).classes == [0, 1]


def test_neighbours(spark):
    rng = np.random.RandomState(2)
    m = rng.normal(size=(30, 4)).round(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "case_id long, features array<double>")
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2))
    want = {(i, k + 1): int(j) for i in range(30) for k, j in enumerate(np.lexsort((np.arange(30), d[i]))[:5])}
    assert {(r.case_id, r["rank"]): r.neighbour_id for r in nearest_neighbours(df, df).collect()} == want
    assert nearest(np.array([0.0, 1, 2, 3]), np.array([1.0, 2.5])) == pytest.approx(0.5)


def test_dummies(spark):
    df = generators.equal_length(spark, 8, 1, 10, seed=0)
    out = DummyClassifier("most_frequent").fit(df).transform(df)
    assert out.where("y = prediction").count() == 4  # published figure: accuracy 0.5
    for strategy in ("prior", "stratified", "uniform"):
        assert DummyClassifier(strategy, random_state=1).fit(df).transform(df).where("prediction in (0, 1)").count() == 8
    assert DummyClassifier("constant", constant=1).fit(df).transform(df).first().prediction == 1
    targets = generators.equal_length(spark, 8, 1, 10, regression=True, seed=0)
    mean = targets.agg(F.avg("y")).first()[0]
    assert DummyRegressor().fit(targets).transform(targets).first().prediction == pytest.approx(mean)
    assert DummyRegressor("constant", constant=3).fit(targets).transform(targets).first().prediction == 3.0
    assert sorted(r.cluster for r in DummyClusterer("unique").fit(df).transform(df).collect()) == list(range(8))
    assert {r.cluster for r in DummyClusterer("random", 3, random_state=0).fit(df).transform(df).collect()} <= {0, 1, 2}
    for bad in (lambda: DummyClassifier("x"), lambda: DummyRegressor("quantile"), lambda: DummyClusterer("x"), lambda: DummyRegressor("constant")):
        with pytest.raises(ValueError):
            bad()
