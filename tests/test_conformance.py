"""What every operator promises, generated from the registry."""

import ast
import inspect
import textwrap

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from undula.learn.compose import ChannelEnsembleClassifier, ChannelEnsembleRegressor
from undula.operators.base import all_operators, is_clusterer, is_transformer
from undula.operators.transforms import SevenNumberSummaryTransformer
from undula.sources import generators

OPERATORS = all_operators()


def make(cls):
    return cls(**cls.test_params())


def rounded(df, column="case_id"):
    def r(v):
        return [r(x) for x in v] if isinstance(v, list) else round(v, 6) + 0.0 if isinstance(v, float) else v

    skip = {"x", "y"}
    return {row[column]: {c: r(row[c]) for c in df.columns if c not in skip} for row in df.collect()}


def test_registry():
    assert len(OPERATORS) >= 27 and [n for n, _ in OPERATORS] == sorted(n for n, _ in OPERATORS)
    assert {n for k in ("classifier", "regressor", "transformer", "clusterer") for n, _ in all_operators(k)} == {n for n, _ in OPERATORS}
    assert len(all_operators(["regressor", "clusterer"])) == len(all_operators("regressor")) + len(all_operators("clusterer"))
    with pytest.raises(ValueError, match="type_filter"):
        all_operators("painter")


#: Settings of forests that are refused unless they have their default, and what is only checked.
REFUSED = {"min_samples_split", "alpha", "metric_params", "oob_score", "warm_start", "n_jobs"}


def test_every_argument_has_an_effect(spark):
    """Each constructor argument is kept, and read somewhere; what has no counterpart is refused."""
    for name, cls in OPERATORS:
        arguments = set(inspect.signature(cls.__init__).parameters) - {"self"}
        read = set()
        for c in cls.__mro__:
            if c.__module__.startswith("undula"):
                nodes = ast.walk(ast.parse(textwrap.dedent(inspect.getsource(c))))
                read |= {n.attr for n in nodes if isinstance(n, ast.Attribute) and isinstance(n.ctx, ast.Load) and isinstance(n.value, ast.Name) and n.value.id == "self"}
        allowed = REFUSED | ({"criterion"} if name == "RandomShapeletForestRegressor" else set()) if name.startswith("RandomShapelet") else set()
        assert arguments - read <= allowed, (name, arguments - read)
        made = make(cls)
        assert all(hasattr(made, a) for a in arguments), name
    for wrong in ({"min_samples_split": 5}, {"alpha": 0.1}, {"oob_score": True}, {"warm_start": True}, {"metric_params": {}}, {"criterion": "log_loss"}, {"n_jobs": "all"}, {"metric": "cosine"}):
        with pytest.raises(ValueError):
            dict(OPERATORS)["RandomShapeletForestClassifier"](**wrong)


def test_class_weights(spark):
    """A class that weighs next to nothing is not predicted by leaves that have another."""
    from undula.learn.shapelets import RandomShapeletForestClassifier

    df = generators.equal_length(spark, 12, 1, 20, seed=3)
    out = RandomShapeletForestClassifier(5, 2, class_weight={0: 1e-6, 1: 1.0}, max_depth=0, random_state=0).fit(df).transform(df)
    assert {r.prediction for r in out.collect()} == {1}
    assert RandomShapeletForestClassifier(3, 2, class_weight="balanced", random_state=0).fit(df).transform(df).count() == 12


@pytest.mark.parametrize("name", [n for n, c in OPERATORS])
def test_results_do_not_depend_on_partitions_or_other_cases(spark, name):
    kind, cls = next((k, c) for k in ("classifier", "regressor", "transformer", "clusterer") for n, c in all_operators(k) if n == name)
    train = generators.equal_length(spark, 12, 1, 20, regression=kind == "regressor", seed=3).coalesce(1).cache()
    operator = make(cls)
    assert is_transformer(operator) == (kind == "transformer") and is_clusterer(operator) == (kind == "clusterer")
    model = operator.fit(train)
    want = rounded(model.transform(train))
    assert len(want) == 12
    assert rounded(model.transform(train.repartition(3))) == want
    if name != "DummyClusterer":
        some = rounded(model.transform(train.where("case_id % 3 = 0")))
        assert some == {k: v for k, v in want.items() if k in some}
    assert rounded(operator.fit(train).transform(train)) == want  # fitting again changes nothing
    first = next(iter(want.values()))
    if kind == "classifier":
        assert all(abs(sum(v["probability"]) - 1) < 1e-5 for v in want.values())
        assert {v["prediction"] for v in want.values()} <= {0, 1}
    elif kind == "clusterer":
        assert all(isinstance(v["cluster"], int) and v["cluster"] >= 0 for v in want.values())
    elif kind == "regressor":
        assert isinstance(first["prediction"], float)


@pytest.mark.parametrize("name", [n for n, c in OPERATORS if c.needs.validates and n not in ("ChannelEnsembleClassifier", "ChannelEnsembleRegressor")])
def test_bad_input_is_rejected(spark, name):
    operator = make(dict(OPERATORS)[name])
    df = generators.equal_length(spark, 6, 1, 20, seed=0)
    odd = df.withColumn("x", F.transform("x", lambda c: F.transform(c, lambda v, i: F.when(i == 2, F.lit(float("nan"))).otherwise(v))))
    with pytest.raises(ValueError, match="NaN"):
        operator.fit(odd)
    if operator.needs.equal_length_only:
        with pytest.raises(ValueError, match="same series length"):
            operator.fit(generators.unequal_length(spark, 6, 1, 12, 20, seed=0))
    with pytest.raises(ValueError, match="minimum"):
        operator.fit(df.where("false"))


def test_one_class_is_predicted_without_learning(spark):
    df = generators.equal_length(spark, 6, 1, 20, seed=0).withColumn("y", F.lit("only"))
    for name, cls in all_operators("classifier"):
        row = make(cls).fit(df).transform(df).first()
        assert row.prediction == "only" and list(row.probability) == [1.0], name


def test_members_of_ensembles(spark):
    from undula.learn.compose import members_of
    from undula.learn.dummy import DummyClassifier, DummyRegressor
    from undula.series import SeriesMeta

    meta, d = SeriesMeta(8, 3, 10, 10), DummyClassifier()
    assert [c for _, _, c in members_of([("a", d, "all-split")], "drop", meta)] == [[0], [1], [2]]
    assert [c for _, _, c in members_of([("a", d, 0), ("b", "drop", 1)], d, meta)] == [[0], [2]]
    assert [c for _, _, c in members_of([("a", d, lambda m: [m.n_channels - 1])], "drop", meta)] == [[2]]
    for bad in ([("a", d, 0), ("a", d, 1)], [("a", "drop", "all")], [("a", d, "all-split"), ("b", d, "all-split")]):
        with pytest.raises(ValueError):
            members_of(bad, "drop", meta)
    # published figures: all 0 for the classifier, the mean of the targets for the regressor
    df = generators.equal_length(spark, 8, 1, 10, seed=0)
    assert {r.prediction for r in ChannelEnsembleClassifier([("a", d, "all"), ("b", d, [0])]).fit(df).transform(df).collect()} == {0}
    df = generators.equal_length(spark, 8, 1, 10, regression=True, seed=0)
    out = ChannelEnsembleRegressor([("a", DummyRegressor(), "all"), ("b", DummyRegressor(), 0)]).fit(df).transform(df)
    assert {round(r.prediction, 6) for r in out.collect()} == {0.867256}


def test_pipeline_of_stages(spark):
    df = generators.equal_length(spark, 6, 1, 20, seed=0)
    out = Pipeline(stages=[SevenNumberSummaryTransformer()]).fit(df).transform(df)
    assert len(out.first().features) == 7
