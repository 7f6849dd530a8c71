"""Ensembles over channels, and series for learners of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.learn.base import Featuriser, PredictingModel, SeriesClassifier, SeriesRegressor, class_at, first_maximum, fit_head, seeded
from undula.learn.dummy import DummyClassifier, DummyRegressor
from undula.operators.base import SeriesEstimator, register
from undula.operators.select import channels_of, check_key, select_channels
from undula.series import Capabilities, SeriesMeta, as_series, flatten, guarded, pad, validate

_ANY_LENGTH = Capabilities(equal_length_only=False, requires_y=True)


def members_of(estimators: Sequence[tuple], remainder, meta: SeriesMeta) -> list[tuple[str, object, list[int]]]:
    """(name, estimator, channels) of each member; "drop" uses channels up without a member."""
    out, used, split = [], set(), False
    names = [name for name, _, _ in estimators]
    if len(set(names)) != len(names):
        raise ValueError(f"the names of the members aren't unique: {names}")
    if taken := sorted(set(names) & {"estimators", "remainder", "random_state"}):
        raise ValueError(f"names of members are names of arguments: {taken}")
    if odd := [name for name in names if "__" in name]:
        raise ValueError(f"names of members must not contain __: {odd}")
    for name, estimator, key in estimators:
        key = key(meta) if callable(key) else key
        if key == "all-split":
            if split:
                raise ValueError("all-split can be given once")
            split = True
            groups = [(f"{name}-{k}", [k]) for k in range(meta.n_channels)]
        elif key == "all":
            groups = [(name, list(range(meta.n_channels)))]
        else:
            groups = [(name, channels_of(check_key(key), meta.n_channels))]
        for own, channels in groups:
            used |= set(channels)
            if not (isinstance(estimator, str) and estimator == "drop"):
                out.append((own, estimator, channels))
    rest = sorted(set(range(meta.n_channels)) - used)
    if rest and not (isinstance(remainder, str) and remainder == "drop"):
        out.append(("remainder", remainder, rest))
    if not out:
        raise ValueError("all channels are dropped")
    return out


class EnsembleModel(PredictingModel):
    """The unweighted mean of the members' probabilities or predictions."""

    def __init__(self, members: list[tuple[str, PredictingModel, list[int]]], classes: list | None, meta: SeriesMeta):
        super().__init__()
        self.members, self.classes, self.meta = members, classes, meta

    def _transform(self, df: DataFrame) -> DataFrame:
        own = df.columns
        rows = guarded(as_series(df), Capabilities(equal_length_only=False, min_length=1), self.meta)
        rows = rows.withColumn("__x", F.col("x"))
        result = "probability" if self.classes is not None else "prediction"
        for i, (_, model, channels) in enumerate(self.members):
            rows = model.transform(rows.withColumn("x", select_channels(F.col("__x"), channels)))
            rows = rows.withColumn(f"__m{i}", F.col(result)).drop("probability", "prediction", "features")
        n = len(self.members)
        if self.classes is None:
            total = F.col("__m0")
            for i in range(1, n):
                total = total + F.col(f"__m{i}")
            rows = rows.withColumn("prediction", total / n)
            extra = ["prediction"]
        else:
            total = F.col("__m0")
            for i in range(1, n):
                total = F.zip_with(total, F.col(f"__m{i}"), lambda a, b: a + b)
            rows = rows.withColumn("probability", F.transform(total, lambda v: v / n))
            rows = rows.withColumn("prediction", class_at(first_maximum(F.col("probability")), self.classes))
            extra = ["probability", "prediction"]
        return rows.withColumn("x", F.col("__x")).select(*own, *extra)


class _Ensemble:
    def _members(self, df: DataFrame, meta: SeriesMeta, default) -> list[tuple[str, PredictingModel, list[int]]]:
        given = self.estimators or [("members", default, "all-split")]
        fitted = []
        for i, (name, estimator, channels) in enumerate(members_of(given, self.remainder, meta)):
            own = estimator.clone(None if self.random_state is None else self.random_state + i)
            fitted.append((name, own.fit(df.withColumn("x", select_channels(F.col("x"), channels))), channels))
        return fitted


@register("classifier")
class ChannelEnsembleClassifier(_Ensemble, SeriesClassifier):
    """Members (name, classifier, channels), by mean probability.

    Channels: an int, a list, a slice, "all", "all-split" (a member each), or a function of
    ``SeriesMeta``. "drop" in place of a classifier or as ``remainder`` leaves channels out.
    """

    needs = _ANY_LENGTH

    def __init__(self, estimators=None, remainder="drop", random_state=None):
        super().__init__()
        self.estimators, self.remainder, self.random_state = estimators, remainder, random_state

    def learn(self, df: DataFrame, meta: SeriesMeta, classes: list) -> PredictingModel:
        return EnsembleModel(self._members(df, meta, DummyClassifier()), classes, meta)


@register("regressor")
class ChannelEnsembleRegressor(_Ensemble, SeriesRegressor):
    """Members (name, regressor, channels), by mean prediction."""

    needs = _ANY_LENGTH

    def __init__(self, estimators=None, remainder="drop", random_state=None):
        super().__init__()
        self.estimators, self.remainder, self.random_state = estimators, remainder, random_state

    def learn(self, df: DataFrame, meta: SeriesMeta) -> PredictingModel:
        return EnsembleModel(self._members(df, meta, DummyRegressor()), None, meta)


def table_featuriser(meta: SeriesMeta, pad_unequal: bool, concatenate_channels: bool) -> Featuriser:
    """Series as one flat array, padded to the length seen at fit; a longer series is an error."""
    if meta.n_channels > 1 and not concatenate_channels:
        raise ValueError("the data is multivariate; concatenate_channels joins the channels")
    if not meta.equal_length and not pad_unequal:
        raise ValueError("not all arrays have the same series length; pad_unequal pads them")

    def features(df: DataFrame) -> DataFrame:
        x = F.col("x")
        longer = F.exists(x, lambda c: F.size(c) > meta.max_length if pad_unequal else F.size(c) != meta.max_length)
        checked = F.when(longer, F.raise_error(F.lit(f"a series isn't of the length {meta.max_length} of the fit"))).otherwise(pad(x, meta.max_length))
        return as_series(df).withColumn("features", flatten(checked))

    return features


@register("classifier")
class TabularClassifier(SeriesClassifier):
    """Any MLlib classifier on flattened series."""

    needs = _ANY_LENGTH

    def __init__(self, classifier: Estimator | None = None, pad_unequal=False, concatenate_channels=False, random_state=None):
        super().__init__()
        self.classifier, self.pad_unequal, self.concatenate_channels, self.random_state = classifier, pad_unequal, concatenate_channels, random_state

    @classmethod
    def test_params(cls) -> dict:
        return {"classifier": RandomForestClassifier(numTrees=3, seed=0), "pad_unequal": True, "concatenate_channels": True}

    def learn(self, df: DataFrame, meta: SeriesMeta, classes: list) -> PredictingModel:
        if self.classifier is None:
            raise ValueError("classifier must be given")
        return fit_head(df, table_featuriser(meta, self.pad_unequal, self.concatenate_channels), seeded(self.classifier, self.random_state), self.label_col, classes, meta)


@register("regressor")
class TabularRegressor(SeriesRegressor):
    """Any MLlib regressor on flattened series."""

    needs = _ANY_LENGTH

    def __init__(self, regressor: Estimator | None = None, pad_unequal=False, concatenate_channels=False, random_state=None):
        super().__init__()
        self.regressor, self.pad_unequal, self.concatenate_channels, self.random_state = regressor, pad_unequal, concatenate_channels, random_state

    @classmethod
    def test_params(cls) -> dict:
        return {"regressor": RandomForestRegressor(numTrees=3, seed=0), "pad_unequal": True, "concatenate_channels": True}

    def learn(self, df: DataFrame, meta: SeriesMeta) -> PredictingModel:
        if self.regressor is None:
            raise ValueError("regressor must be given")
        return fit_head(df, table_featuriser(meta, self.pad_unequal, self.concatenate_channels), seeded(self.regressor, self.random_state), self.label_col, None, meta)


class ClusterModel(PredictingModel):
    def __init__(self, features: Featuriser, head):
        super().__init__()
        self.features, self.head = features, head

    def _transform(self, df: DataFrame) -> DataFrame:
        rows = self.features(df).withColumn("__features", array_to_vector("features"))
        return self.head.transform(rows).select(*df.columns, F.col("__cluster").cast("int").alias("cluster"))

    @property
    def labels(self) -> DataFrame:
        """The collection of the fit with its clusters."""
        return self.transform(self.fitted_on)


@register("clusterer")
class TabularClusterer(SeriesEstimator):
    """Any MLlib clustering on flattened series."""

    needs = Capabilities(equal_length_only=False)

    def __init__(self, clusterer: Estimator | None = None, pad_unequal=False, concatenate_channels=False, random_state=None):
        super().__init__()
        self.clusterer, self.pad_unequal, self.concatenate_channels, self.random_state = clusterer, pad_unequal, concatenate_channels, random_state

    @classmethod
    def test_params(cls) -> dict:
        return {"clusterer": KMeans(k=2, seed=0), "pad_unequal": True, "concatenate_channels": True}

    def _fit(self, df: DataFrame) -> ClusterModel:
        if self.clusterer is None:
            raise ValueError("clusterer must be given")
        df = as_series(df)
        meta = validate(df, self.needs)
        features = table_featuriser(meta, self.pad_unequal, self.concatenate_channels)
        head = seeded(self.clusterer, self.random_state).copy({})
        head._set(featuresCol="__features", predictionCol="__cluster")
        model = ClusterModel(features, head.fit(features(df).select(array_to_vector("features").alias("__features"))))
        model.fitted_on = df
        return model


