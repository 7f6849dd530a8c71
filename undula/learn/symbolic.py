"""Symbolic classifiers: words of windows, their frequent runs, a linear model.

SAX words are z-normalised windows, averaged by segment and cut at normal quantiles;
SFA words are leading Fourier coefficients of windows, cut at the quantiles that the
training windows have (a sketch of them, by ``percentile_approx``). After Le Nguyen
et al., "Interpretable time series classification using linear models and
multi-resolution multi-domain symbolic representations" (2019), and Nguyen and Ifrim,
"Fast time series classification with random symbolic subsequences" (2022).
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.functions import arrow
from undula.learn.base import Featuriser, PredictingModel, SeriesClassifier, class_index, fit_head
from undula.operators.base import register
from undula.series import Capabilities, SeriesMeta, as_series, guarded

_LETTERS = "abcdefghijklmnop"


def windows_of(a: np.ndarray, width: int) -> np.ndarray:
    m = np.lib.stride_tricks.sliding_window_view(a, width)
    return (m - m.mean(1, keepdims=True)) / np.maximum(m.std(1, keepdims=True), 1e-8)


def segments(m: np.ndarray, n: int) -> np.ndarray:
    """Piecewise aggregate approximation: means of n segments of each window."""
    return np.stack([part.mean(1) for part in np.array_split(m, n, axis=1)], 1)


def coefficients(m: np.ndarray, n: int, norm: bool) -> np.ndarray:
    """The first n real and imaginary Fourier parts of each window, without the mean if normalised."""
    f = np.fft.rfft(m)[:, 1 if norm else 0 :]
    parts = np.stack([f.real, f.imag], 2).reshape(len(m), -1)
    return np.pad(parts, ((0, 0), (0, max(0, n - parts.shape[1]))))[:, :n]


def words_of(values: np.ndarray, edges: np.ndarray) -> list[str]:
    """A letter a column; runs of the same word count once."""
    codes = (values[:, :, None] > edges[None, :, :]).sum(2)
    words = ["".join(_LETTERS[c] for c in row) for row in codes.tolist()]
    return [w for i, w in enumerate(words) if not i or w != words[i - 1]]


class Representation:
    """One way to turn a case into words: SAX, or SFA with learned cuts."""

    def __init__(self, kind: str, width: int, length: int, alphabet: int, norm: bool = True):
        self.kind, self.width, self.length, self.alphabet, self.norm = kind, width, length, alphabet, norm
        cuts = [NormalDist().inv_cdf(k / alphabet) for k in range(1, alphabet)]
        self.edges = [np.tile(cuts, (length, 1))]

    def values(self, a: np.ndarray) -> np.ndarray:
        m = windows_of(a, self.width)
        return segments(m, self.length) if self.kind == "sax" else coefficients(m, self.length, self.norm)

    def learn(self, df: DataFrame, meta: SeriesMeta) -> Representation:
        if self.kind == "sax":
            self.edges = self.edges * meta.n_channels
            return self
        values = arrow.per_case(F.col("x"), lambda m: [self.values(c).T.ravel().tolist() for c in m])
        n = self.length
        long = df.select(F.posexplode(values).alias("ch", "v")).select("ch", F.posexplode("v").alias("i", "v"))
        per = meta.min_length - self.width + 1
        qs = [k / self.alphabet for k in range(1, self.alphabet)]
        found = long.groupBy("ch", F.floor(F.col("i") / per).alias("k")).agg(F.percentile_approx("v", qs, 10_000).alias("q")).collect()  # a row a coefficient
        edges = np.zeros((meta.n_channels, n, len(qs)))
        for r in found:
            edges[r.ch, r.k] = r.q
        self.edges = list(edges)
        return self

    def tokens(self, x: Column, runs: Sequence[int]) -> Column:
        """Words of all channels and their runs, as one array of strings."""
        edges, values = self.edges, self.values

        def case(m: np.ndarray) -> list[str]:
            out = []
            for k, c in enumerate(m):
                words = [f"{k}:{w}" for w in words_of(values(c), edges[k])]
                for run in runs:
                    out += [" ".join(words[i : i + run]) for i in range(len(words) - run + 1)]
            return out

        return arrow.per_case(x, case, "array<string>")


def representations(meta: SeriesMeta, sax: int, sfa: int, norm: bool, seed: int | None) -> list[Representation]:
    """Windows from an eighth of the series up, more of them the more are asked for."""
    rng = np.random.RandomState(seed)
    out = []
    for kind, many in (("sax", sax), ("sfa", sfa)):
        for _ in range(many):
            width = int(rng.randint(max(2, min(8, meta.min_length // 2)), max(3, meta.min_length // 2 + 1)))
            out.append(Representation(kind, width, min(int(rng.choice([4, 6, 8])), width), int(rng.choice([3, 4])), norm))
    return out


class _Symbolic:
    def _featuriser(self, df: DataFrame, meta: SeriesMeta, classes: list, reps: Sequence[Representation], runs: Sequence[int], per_rep: int, pool: int, order: str) -> Featuriser:
        """Counts of ``per_rep`` runs in every representation.

        order: S (the best by chi squared), R (random ones), RS (the best of ``pool``
        random ones), SR (random ones of the ``pool`` best). All runs are scored, in Spark;
        only those selected reach the driver.
        """
        target = class_index(F.col(self.label_col), classes).cast("int")
        rows = df.select("x", target.alias("label"))
        steps = []
        for i, rep in enumerate(reps):
            rep.learn(df, meta)
            bag = rows.select("label", rep.tokens(F.col("x"), runs).alias("bag"))
            bag.cache()
            terms = chi_squared(bag, len(classes)).withColumn("draw", F.xxhash64("term", F.lit((self.seed or 0) + i)))
            # in a fixed order, so that equal scores don't depend on the reading
            best, random = [F.desc("score"), F.col("term")], [F.col("draw"), F.col("term")]
            first, second = {"S": (best, None), "R": (random, None), "RS": (random, best), "SR": (best, random)}[order]
            kept = terms.orderBy(*first).limit(per_rep if second is None else max(pool, per_rep))
            if second is not None:
                kept = kept.orderBy(*second).limit(per_rep)
            vocabulary = sorted(r.term for r in kept.select("term").collect())  # per_rep rows at most
            bag.unpersist()
            counted = CountVectorizerModel.from_vocabulary(vocabulary or [""], inputCol="bag", outputCol="counts")
            counted.setBinary(True)
            steps.append((rep, counted))

        def features(rows: DataFrame) -> DataFrame:
            own = rows.columns
            rows = guarded(as_series(rows), Capabilities(), meta)
            parts = []
            for i, (rep, counted) in enumerate(steps):
                rows = counted.copy({counted.inputCol: f"__b{i}", counted.outputCol: f"__c{i}"}).transform(rows.withColumn(f"__b{i}", rep.tokens(F.col("x"), runs)))
                parts.append(vector_to_array(f"__c{i}"))
            return rows.withColumn("features", F.concat(*parts)).select(*own, "features")

        return features


def chi_squared(bag: DataFrame, classes: int) -> DataFrame:
    """(term, score): chi squared of each term's presence against ``label`` (0 to classes - 1), for all terms."""
    labels = {r.label: r["count"] for r in bag.groupBy("label").count().collect()}  # a row a class
    n = [float(labels.get(c, 0)) for c in range(classes)]
    present = bag.select("label", F.explode(F.array_distinct("bag")).alias("term"))
    seen = present.groupBy("term").agg(F.count(F.lit(1)).alias("all"), *(F.sum((F.col("label") == c).cast("long")).alias(f"n{c}") for c in range(classes)))
    share, score = F.col("all") / F.lit(sum(n)), F.lit(0.0)
    for c in range(classes):
        expected = share * n[c]
        gap = (F.col(f"n{c}") - expected) * (F.col(f"n{c}") - expected)
        for part in (expected, F.lit(n[c]) - expected):
            score = score + F.when(part > 1e-9, gap / part).otherwise(0.0)
    return seen.select("term", F.round(score, 9).alias("score"))


@register("classifier")
class MrSEQLClassifier(_Symbolic, SeriesClassifier):
    """Runs of SAX or SFA words at several window widths. seql_mode: "fs" one linear model over all features, "clf" a mean of one a representation."""

    needs = Capabilities(requires_y=True, min_length=8)

    def __init__(self, seql_mode="fs", symrep="sax", custom_config=None, random_state=None):
        super().__init__()
        if seql_mode not in ("fs", "clf"):
            raise ValueError("seql_mode is 'fs' or 'clf'")
        kinds = [symrep] if isinstance(symrep, str) else list(symrep)
        if set(kinds) - {"sax", "sfa"}:
            raise ValueError("symrep is 'sax', 'sfa' or a list of both")
        self.seql_mode, self.symrep, self.custom_config, self.random_state = seql_mode, symrep, custom_config, random_state

    @classmethod
    def test_params(cls) -> dict:
        return {"random_state": 0}

    @property
    def seed(self):
        return self.random_state

    def learn(self, df: DataFrame, meta: SeriesMeta, classes: list) -> PredictingModel:
        kinds = [self.symrep] if isinstance(self.symrep, str) else list(self.symrep)
        if self.custom_config:
            reps = [Representation(c.get("kind", kinds[0]), c["window"], c["word"], c["alphabet"]) for c in self.custom_config]
        else:
            reps = representations(meta, 3 * ("sax" in kinds), 3 * ("sfa" in kinds), True, self.random_state)
        head = LogisticRegression(regParam=0.01)
        if self.seql_mode == "fs":
            return fit_head(df, self._featuriser(df, meta, classes, reps, (1, 2, 3), 200, 200, "S"), head, self.label_col, classes, meta)
        from undula.learn.compose import EnsembleModel

        every = list(range(meta.n_channels))
        members = [(f"{r.kind}{i}", fit_head(df, self._featuriser(df, meta, classes, [r], (1, 2, 3), 200, 200, "S"), head, self.label_col, classes, meta), every) for i, r in enumerate(reps)]
        return EnsembleModel(members, classes, meta)


@register("classifier")
class MrSQMClassifier(_Symbolic, SeriesClassifier):
    """Symbolic subsequences, selected at random and by chi squared (strat R, S, RS, SR), then logistic regression."""

    needs = Capabilities(requires_y=True, min_length=8)

    def __init__(self, strat="RS", features_per_rep=500, selection_per_rep=2000, nsax=0, nsfa=5, sfa_norm=True, custom_config=None, random_state=None):
        super().__init__()
        if strat not in ("R", "S", "RS", "SR"):
            raise ValueError("strat is R, S, RS or SR")
        self.strat, self.features_per_rep, self.selection_per_rep, self.nsax, self.nsfa = strat, features_per_rep, selection_per_rep, nsax, nsfa
        self.sfa_norm, self.custom_config, self.random_state = sfa_norm, custom_config, random_state

    @classmethod
    def test_params(cls) -> dict:
        return {"features_per_rep": 20, "selection_per_rep": 40, "nsfa": 1, "random_state": 0}

    @property
    def seed(self):
        return self.random_state

    def learn(self, df: DataFrame, meta: SeriesMeta, classes: list) -> PredictingModel:
        if self.custom_config:
            reps = [Representation(c["kind"], c["window"], c["word"], c["alphabet"], self.sfa_norm) for c in self.custom_config]
        else:
            reps = representations(meta, self.nsax, self.nsfa, self.sfa_norm, self.random_state)
        if not reps:
            raise ValueError("there are no representations: nsax and nsfa are 0")
        features = self._featuriser(df, meta, classes, reps, (1, 2, 3), self.features_per_rep, self.selection_per_rep, self.strat)
        return fit_head(df, features, LogisticRegression(regParam=0.01), self.label_col, classes, meta)


