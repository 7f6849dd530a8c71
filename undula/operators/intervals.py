"""Interval features: intervals drawn at random, or searched for with the labels."""

from __future__ import annotations

from collections.abc import Callable, Generator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.functions import windows
from undula.functions.stats import fisher_score
from undula.operators.base import SeriesEstimator, SeriesModel, register
from undula.operators.select import check_mask
from undula.plans.intervals import Feature, Interval, feature_expression, interval_features
from undula.series import Capabilities, SeriesMeta, as_series, guarded, validate

#: Features where none are given, in order.
RANDOM_FEATURES = ["mean", "std", "min", "max", "median", "quantile25", "quantile75"]
SUPERVISED_FEATURES = ["mean", "median", "std", "slope", "min", "max", "iqr", "count_mean_crossing", "count_above_mean"]
_SEEDS = np.iinfo(np.int32).max


def draw_interval(rng: np.random.RandomState, meta: SeriesMeta, shortest: int, longest: float, dilations: Sequence[int]) -> Interval:
    """One interval: a channel, then start or end first by a coin, then a length, then a dilation.

    Upper bounds are exclusive, as in the draws that results are compared with; where a
    range is empty its minimum is taken.
    """

    def upto(n: float) -> int:
        return int(rng.randint(0, int(n))) if n > 0 else 0

    n = meta.min_length
    dim = int(rng.randint(meta.n_channels))
    from_start = rng.random_sample() < 0.5
    edge = upto(n - shortest)
    room = min(n - edge if from_start else edge + shortest, longest)
    length = shortest + upto(room - shortest)
    start, end = (edge, edge + length) if from_start else (edge + shortest - length, edge + shortest)
    dilation = int(rng.choice(list(dilations)))
    while length / dilation < shortest:
        dilation -= 1
    return Interval(start, end, dim, dilation)


class IntervalModel(SeriesModel):
    """Intervals with their features; ``mask`` switches single features off (they become 0)."""

    def __init__(self, pairs: list[tuple[Interval, Feature]], meta: SeriesMeta, needs: Capabilities, grouped: list[Interval] | None = None, features: Sequence[Feature] = ()):
        super().__init__()
        self.pairs, self.meta, self.needs, self.grouped, self.features = pairs, meta, needs, grouped, list(features)
        self.mask: list[bool] | None = None

    @property
    def intervals(self) -> list[tuple[Interval, Feature]]:
        return self.pairs

    def set_features_to_transform(self, mask: Sequence[bool] | None, raise_error: bool = True) -> bool:
        if not check_mask(mask, len(self.pairs), raise_error):
            return False
        self.mask = None if mask is None else list(mask)
        return True

    def expression(self, x: Column) -> Column:
        if self.grouped is not None:
            return interval_features(x, self.grouped, self.features, self.mask)
        wanted = self.mask or [True] * len(self.pairs)
        parts = []
        # runs of one feature share a projection
        at = 0
        while at < len(self.pairs):
            end = at
            while end < len(self.pairs) and self.pairs[end][1] == self.pairs[at][1]:
                end += 1
            parts.append(interval_features(x, [i for i, _ in self.pairs[at:end]], [self.pairs[at][1]], wanted[at:end]))
            at = end
        return F.concat(*parts) if parts else F.array().cast("array<double>")

    def _transform(self, df: DataFrame) -> DataFrame:
        return super()._transform(guarded(as_series(df, self.input_col), self.needs, self.meta, self.input_col))


@register("transformer")
class RandomIntervalTransformer(SeriesEstimator):
    """Features of random intervals, interval by interval; equal intervals are kept once.

    ``n_intervals`` may be a function of the collection's ``SeriesMeta``. Intervals are
    drawn on the driver, one seed each, so a seed gives the same ones on any cluster.
    """

    needs = Capabilities(min_length=3)

    def __init__(self, n_intervals: int | Callable[[SeriesMeta], int] = 100, min_interval_length: int = 3, max_interval_length: float = float("inf"), features: Feature | list[Feature] | None = None, dilation: int | list[int] | None = None, random_state: int | None = None):
        super().__init__()
        self.n_intervals, self.min_interval_length, self.max_interval_length = n_intervals, min_interval_length, max_interval_length
        self.features, self.dilation, self.random_state = features, dilation, random_state

    @classmethod
    def test_params(cls) -> dict:
        return {"n_intervals": 2, "random_state": 0}

    def _fit(self, df: DataFrame) -> IntervalModel:
        return self.drawn_for(validate(as_series(df, self.input_col), self.needs, self.input_col))

    def drawn_for(self, meta: SeriesMeta) -> IntervalModel:
        """The model for a collection that is known to be valid: intervals depend on its sizes only."""
        shortest = max(3, self.min_interval_length)
        longest = min(max(self.max_interval_length, shortest), meta.min_length)
        number = self.n_intervals(meta) if callable(self.n_intervals) else self.n_intervals
        features = RANDOM_FEATURES if self.features is None else self.features if isinstance(self.features, list) else [self.features]
        dilations = [1] if self.dilation is None else [self.dilation] if isinstance(self.dilation, int) else self.dilation
        rng = np.random.RandomState(self.random_state)
        drawn = [draw_interval(np.random.RandomState(rng.randint(_SEEDS)), meta, shortest, longest, dilations) for _ in range(number)]
        kept = list(dict.fromkeys(drawn))
        return IntervalModel([(i, f) for i in kept for f in features], meta, self.needs, kept, features)


_Ask = tuple[int, int, int, int, int]  # channel, feature, start, split, end


def _halves(feature: Feature) -> Callable[[Column], Column]:
    """A feature of both halves of a requested interval of the column z."""

    def value(channel: Column, a: Column, b: Column) -> Column:
        return F.element_at(feature_expression(feature, F.slice(channel, a + 1, b - a)), 1)

    def halves(r: Column) -> Column:
        channel = F.element_at("z", r["k"] + 1)
        return F.struct(r["i"].alias("i"), F.array(value(channel, r["s"], r["m"]), value(channel, r["m"], r["e"])).alias("v"))

    return halves


@register("transformer")
class SupervisedIntervalTransformer(SeriesEstimator):
    """Features of intervals found by halving: of two halves, the one that separates classes better goes on.

    Searches are coroutines that ask for the scores of two halves; each round answers
    all that wait by one job over the data, so a round costs one pass whatever the
    number of searches. ``mode``: "exact" gives each run one generator for all its
    searches, which then take turns; "lockstep" seeds every search on its own, and all
    run at once (far fewer rounds).
    """

    needs = Capabilities(requires_y=True, min_cases=2, min_length=5)

    def __init__(self, n_intervals: int = 50, min_interval_length: int = 3, features: Feature | list[Feature] | None = None, metric: str | Callable = "fisher", randomised_split_point: bool = True, normalise_for_search: bool = True, random_state: int | None = None, mode: str = "exact"):
        super().__init__()
        if mode not in ("exact", "lockstep"):
            raise ValueError("mode is 'exact' or 'lockstep'")
        if not callable(metric) and metric != "fisher":
            raise ValueError("metric is 'fisher' or a function of values and labels")
        self.n_intervals, self.min_interval_length, self.features, self.metric = n_intervals, min_interval_length, features, metric
        self.randomised_split_point, self.normalise_for_search, self.random_state, self.mode = randomised_split_point, normalise_for_search, random_state, mode

    @classmethod
    def test_params(cls) -> dict:
        return {"n_intervals": 1, "random_state": 0}

    def _cut(self, rng: np.random.RandomState, n: int, least: int) -> int:
        while True:
            cut = int(rng.randint(1, n - 1))
            if max(cut, n - cut) >= 2 * least:
                return cut

    def _search(self, rng, channel: int, feature: int, start: int, end: int, least: int) -> Generator[_Ask, tuple[float, float], list[tuple[int, int]]]:
        found = []
        while end - start >= 2 * least:
            width = end - start
            split = int(rng.randint(least, width - least)) if self.randomised_split_point and width != 2 * least else width // 2
            left, right = yield channel, feature, start, start + split, end
            if left >= right and left != 0:
                end = start + split
            elif right > left:
                start += split
            else:
                break
            found.append((start, end))
        return found

    def _run(self, seed: int, meta: SeriesMeta, n_features: int, least: int) -> Generator[_Ask, tuple[float, float], list]:
        rng, out = np.random.RandomState(seed), []
        for channel in range(meta.n_channels):
            for feature in range(n_features):
                cut = self._cut(rng, meta.min_length, least)
                for start, end in ((0, cut), (cut, meta.min_length)):
                    found = yield from self._search(rng, channel, feature, start, end, least)
                    out += [(Interval(a, b, channel), feature) for a, b in found]
        return out

    def _single(self, seed: int, channel: int, feature: int, meta: SeriesMeta, least: int) -> Generator[_Ask, tuple[float, float], list]:
        rng, out = np.random.RandomState(seed), []
        cut = self._cut(rng, meta.min_length, least)
        for start, end in ((0, cut), (cut, meta.min_length)):
            found = yield from self._search(rng, channel, feature, start, end, least)
            out += [(Interval(a, b, channel), feature) for a, b in found]
        return out

    def scores(self, df: DataFrame, asks: Sequence[_Ask], features: Sequence[Feature]) -> dict[tuple[int, int], float]:
        """Score of half 0 or 1 of each request: (request, half) -> score; one job."""
        parts = []
        for f in sorted({a[1] for a in asks}):
            wanted = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("k"), F.lit(s).alias("s"), F.lit(m).alias("m"), F.lit(e).alias("e")) for i, (c, g, s, m, e) in enumerate(asks) if g == f))
            parts.append(F.transform(wanted, _halves(features[f])))
        long = df.select(self.label_col, F.explode(F.concat(*parts)).alias("r")).select(self.label_col, F.col("r.i").alias("i"), F.posexplode("r.v").alias("half", "v"))
        if callable(self.metric):
            metric = self.metric

            def one(key, pdf):
                import pandas as pd

                return pd.DataFrame({"i": [key[0]], "half": [key[1]], "score": [float(metric(pdf["v"].to_numpy(), pdf["y"].to_numpy()))]})

            scored = long.select("i", "half", "v", F.col(self.label_col).alias("y")).groupBy("i", "half").applyInPandas(one, "i int, half int, score double")
        else:
            scored = fisher_score(long, "v", self.label_col, ["i", "half"])
        return {(r.i, r.half): r.score for r in scored.collect()}  # two rows a request

    def _fit(self, df: DataFrame) -> IntervalModel:
        df = as_series(df, self.input_col)
        least = max(3, self.min_interval_length)
        needs = Capabilities(requires_y=True, min_cases=2, min_length=max(5, 2 * least + 1))
        meta = validate(df, needs, self.input_col, self.label_col)
        features = SUPERVISED_FEATURES if self.features is None else self.features if isinstance(self.features, list) else [self.features]
        z = F.transform(self.input_col, windows.z_normalise) if self.normalise_for_search else F.col(self.input_col)
        data = df.select(self.label_col, z.alias("z"))
        data.cache()
        rng = np.random.RandomState(self.random_state)
        seeds = [int(rng.randint(_SEEDS)) for _ in range(self.n_intervals)]
        if self.mode == "exact":
            runs = [self._run(s, meta, len(features), least) for s in seeds]
        else:
            runs = [self._single(int(np.random.SeedSequence([s, c, f]).generate_state(1)[0] % _SEEDS), c, f, meta, least) for s in seeds for c in range(meta.n_channels) for f in range(len(features))]
        found: list[list] = [[] for _ in runs]
        waiting: dict[int, _Ask] = {}

        def step(i: int, answer=None) -> None:
            try:
                waiting[i] = runs[i].send(answer)
            except StopIteration as done:
                found[i] = done.value
                waiting.pop(i, None)

        for i in range(len(runs)):
            step(i)
        known: dict[_Ask, tuple[float, float]] = {}
        while waiting:
            new = list(dict.fromkeys(a for a in waiting.values() if a not in known))
            if new:
                got = self.scores(data, new, features)
                known |= {a: (got[i, 0], got[i, 1]) for i, a in enumerate(new)}
            for i, ask in list(waiting.items()):
                step(i, known[ask])
        data.unpersist()
        pairs = [(i, features[f]) for run in found for i, f in run]
        return IntervalModel(pairs, meta, Capabilities(min_length=2 * least + 1))
