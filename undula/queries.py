"""Queries over the test tables, one a group of operators, with their SQL where SQL can state it.

Numbers are rounded to six decimals on both sides; ``+ 0.0`` turns -0.0 into 0.0.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.functions import stats, windows
from undula.learn.compose import ChannelEnsembleRegressor
from undula.learn.dummy import DummyClassifier, DummyClusterer, DummyRegressor
from undula.operators.intervals import RANDOM_FEATURES, RandomIntervalTransformer, SupervisedIntervalTransformer, draw_interval
from undula.operators.neighbours import nearest_neighbours
from undula.operators.select import channels_of, select_channels
from undula.operators.transforms import ARCoefficientTransformer, AutocorrelationFunctionTransformer, FunctionTransformer, PeriodogramTransformer, SevenNumberSummaryTransformer, TransformerConcatenator
from undula.plans.intervals import Interval, interval_features
from undula.series import SeriesMeta, flatten, meta_of, pad, to_long
from undula.sources.tables import customer_prices, daily_events, embeddings, event_values, supplier_months

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The fixtures in SQL: long form (case_id, [ch,] t, v).
E = "e AS (SELECT vec_id AS case_id, label AS y, i - 1 AS t, embedding[i]::DOUBLE AS v FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"
V = "v AS (SELECT user_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS v FROM events)"
D = """span AS (SELECT min(ts)::DATE AS lo, date_diff('day', min(ts)::DATE, max(ts)::DATE) AS n FROM events),
types AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS ch FROM (SELECT DISTINCT event_type FROM events)),
sums AS (SELECT user_id, event_type, date_diff('day', (SELECT lo FROM span), ts::DATE) AS t, sum(value) AS s FROM events GROUP BY ALL),
d AS (SELECT u.user_id AS case_id, types.ch, g.t, coalesce(sums.s, 0.0) AS v
      FROM (SELECT DISTINCT user_id FROM events) u, types, (SELECT unnest(range(0, (SELECT n FROM span) + 1)) AS t) g
      LEFT JOIN sums ON sums.user_id = u.user_id AND sums.event_type = types.event_type AND sums.t = g.t)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def sql6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def one_channel(df: DataFrame) -> DataFrame:
    return df.withColumn("a", F.element_at("x", 1))


def unpacked(df: DataFrame, n: int, column: str = "features") -> DataFrame:
    return df.select("case_id", *(r6(F.element_at(column, i + 1)).alias(f"f{i + 1}") for i in range(n)))


# summaries

_AGG = {"mean": "avg(v)", "std": "stddev_pop(v)", "min": "min(v)", "max": "max(v)"}
_SUMMARIES = {
    "default": ["mean", "std", "min", "max", 0.25, 0.5, 0.75],
    "percentiles": [0.2, 0.9, 0.25, 0.5, 0.75, 0.91, 0.98],
    "bowley": ["min", "max", 0.1, 0.25, 0.5, 0.75, 0.9],
    "tukey": ["min", "max", 0.125, 0.25, 0.5, 0.75, 0.875],
}


def _agg(stat) -> str:
    return _AGG.get(stat) or f"quantile_cont(v, {stat})"


def _summary(kind: str) -> Query:
    return lambda spark, sf: unpacked(SevenNumberSummaryTransformer(kind).transform(embeddings(spark, sf)), 7)


for _kind, _stats in _SUMMARIES.items():
    query(f"q_summary_{_kind}", f"WITH {E} SELECT case_id, " + ", ".join(f"{sql6(_agg(s))} AS f{i + 1}" for i, s in enumerate(_stats)) + " FROM e GROUP BY case_id")(_summary(_kind))


@query("q_summary_multichannel", f"WITH {D}, s AS (SELECT case_id, ch, " + ", ".join(f"{_agg(s)} AS s{i}" for i, s in enumerate(_SUMMARIES["default"])) + f" FROM d GROUP BY case_id, ch), u AS (UNPIVOT s ON s0, s1, s2, s3, s4, s5, s6 INTO NAME stat VALUE value) SELECT case_id, substr(stat, 2)::BIGINT * 5 + ch AS k, {sql6('value')} AS value FROM u")
def q_summary_multichannel(spark, sf):
    out = SevenNumberSummaryTransformer().transform(daily_events(spark, sf))
    return out.select("case_id", F.posexplode("features").alias("k", "v")).select("case_id", F.col("k").cast("long").alias("k"), r6("v").alias("value"))


# statistics of an array


def _stats_query(name: str, fixture: Callable, sql: str, **columns) -> None:
    def run(spark, sf):
        rows = one_channel(fixture(spark, sf))
        return rows.select("case_id", *(r6(f(F.col("a")).cast("double")).alias(c) for c, f in columns.items()))

    query(name, sql)(run)


def _select(view: str, cte: str, **columns: str) -> str:
    return f"WITH {cte} SELECT case_id, " + ", ".join(f"{sql6(x)} AS {c}" for c, x in columns.items()) + f" FROM {view} GROUP BY case_id"


_stats_query("q_mean_std_minmax", event_values, _select("v", V, mean="avg(v)", std="stddev_pop(v)", about1="sqrt(avg((v - 1.0) * (v - 1.0)))", lo="min(v)", hi="max(v)"), mean=stats.mean, std=stats.std, about1=lambda a: stats.std2(a, F.lit(1.0)), lo=stats.minimum, hi=stats.maximum)
_stats_query("q_quantiles", event_values, _select("v", V, q10="quantile_cont(v, 0.1)", q25="quantile_cont(v, 0.25)", q75="quantile_cont(v, 0.75)", q99="quantile_cont(v, 0.99)"), q10=lambda a: stats.quantile(a, 0.1), q25=stats.quantile25, q75=stats.quantile75, q99=lambda a: F.element_at(stats.quantiles(a, [0.1, 0.99]), 2))
_stats_query("q_median", event_values, _select("v", V, median="quantile_cont(v, 0.5)"), median=stats.median)
_stats_query("q_iqr", event_values, _select("v", V, iqr="quantile_cont(v, 0.75) - quantile_cont(v, 0.25)"), iqr=stats.iqr)
_stats_query("q_slope", embeddings, _select("e", E, slope="coalesce(regr_slope(v, t), 0)"), slope=stats.slope)
_stats_query("q_ppv", embeddings, _select("e", E, ppv="avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END)"), ppv=stats.ppv)
_WITH_MEAN = f"WITH {V}, m AS (SELECT *, avg(v) OVER (PARTITION BY case_id) AS m FROM v)"
_stats_query("q_count_above_mean", event_values, f"{_WITH_MEAN} SELECT case_id, count(*) FILTER (v > m)::DOUBLE AS n FROM m GROUP BY case_id", n=stats.count_above_mean)
_stats_query("q_mean_crossings", event_values, f"{_WITH_MEAN}, c AS (SELECT case_id, v > m AS u, lag(v > m) OVER (PARTITION BY case_id ORDER BY t) AS p FROM m) SELECT case_id, count(*) FILTER (u <> p)::DOUBLE AS n FROM c GROUP BY case_id", n=stats.count_mean_crossing)


def _index_sql(q: float) -> str:
    at = f"floor(n * {q})"
    return f"max(CASE WHEN n % 2 = 1 AND k = {at} THEN v END), (max(CASE WHEN k = {at} - 1 THEN v END) + max(CASE WHEN k = {at} THEN v END)) / 2"


_stats_query(
    "q_quantile_index_rule",
    event_values,
    f"WITH {V}, s AS (SELECT case_id, v, row_number() OVER (PARTITION BY case_id ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY case_id) AS n FROM v) SELECT case_id, " + ", ".join(f"{sql6(f'coalesce({_index_sql(q)})')} AS {c}" for c, q in (("median", 0.5), ("q25", 0.25), ("q75", 0.75))) + " FROM s GROUP BY case_id",
    median=stats.index_median,
    q25=lambda a: F.element_at(stats.index_quantiles(a, [0.25]), 1),
    q75=stats.index_quantile75,
)


@query("q_fisher_by_stat", f"""WITH {E}, f AS (SELECT case_id, y, avg(v) AS mean, stddev_pop(v) AS std, regr_slope(v, t) AS slope FROM e GROUP BY case_id, y),
u AS (UNPIVOT f ON mean, std, slope INTO NAME stat VALUE value), o AS (SELECT stat, avg(value) AS mu FROM u GROUP BY stat),
c AS (SELECT stat, y, count(*) AS n, avg(value) AS m, greatest(stddev_pop(value), 1e-6) AS s FROM u GROUP BY stat, y)
SELECT stat, {sql6('sum(n * (m - mu) * (m - mu)) / sum(n * s * s)')} AS score FROM c JOIN o USING (stat) GROUP BY stat""")
def q_fisher_by_stat(spark, sf):
    rows = one_channel(embeddings(spark, sf))
    values = F.array(*(F.struct(F.lit(n).alias("stat"), stats.STATS[n](F.col("a")).alias("v")) for n in ("mean", "std", "slope")))
    long = rows.select("y", F.explode(values).alias("s")).select("y", "s.stat", "s.v")
    return stats.fisher_score(long, "v", "y", ["stat"]).select("stat", r6("score").alias("score"))


@query("q_unique_count", f"WITH {V} SELECT case_id, floor(v / 10) AS value, count(*) AS n FROM v GROUP BY ALL")
def q_unique_count(spark, sf):
    rows = one_channel(event_values(spark, sf)).withColumn("a", F.transform("a", lambda v: F.floor(v / 10).cast("double")))
    return rows.select("case_id", F.explode(stats.unique_count(F.col("a"))).alias("u")).select("case_id", F.col("u.value").alias("value"), F.col("u.count").cast("long").alias("n"))


@query("q_combinations", f"WITH {V}, p AS (SELECT case_id, floor(v / 50)::INTEGER AS x, (t % 3)::INTEGER AS y, min(t) AS t FROM v GROUP BY ALL) SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY t) - 1 AS k, x, y FROM p")
def q_combinations(spark, sf):
    rows = one_channel(event_values(spark, sf))
    pairs = stats.combinations_1d(F.transform("a", lambda v: F.floor(v / 50)), F.transform("a", lambda v, i: i % 3))
    return rows.select("case_id", F.posexplode(pairs).alias("k", "p")).select("case_id", F.col("k").cast("long").alias("k"), "p.x", "p.y")


# windows


def _exploded(df: DataFrame, values: Column) -> DataFrame:
    return df.select("case_id", F.posexplode(values).alias("t", "v")).select("case_id", F.col("t").cast("long").alias("t"), r6("v").alias("v"))


@query("q_diff", f"WITH {V}, l AS (SELECT case_id, t - 1 AS t, v - lag(v) OVER (PARTITION BY case_id ORDER BY t) AS v FROM v) SELECT case_id, t, {sql6('v')} AS v FROM l WHERE t >= 0")
def q_diff(spark, sf):
    return _exploded(one_channel(event_values(spark, sf)), windows.first_order_differences(F.col("a")))


@query("q_znorm", f"WITH {V}, m AS (SELECT *, avg(v) OVER (PARTITION BY case_id) AS m, stddev_pop(v) OVER (PARTITION BY case_id) AS s FROM v) SELECT case_id, t, {sql6('CASE WHEN s > 0 THEN (v - m) / s ELSE v - m END')} AS v FROM m")
def q_znorm(spark, sf):
    return _exploded(one_channel(event_values(spark, sf)), windows.z_normalise(F.col("a")))


def _sliding_sql(dilation: int, length: int = 5) -> str:
    return f"WITH {E}, w AS (SELECT case_id, t - {(length - 1) * dilation} AS t, avg(v) OVER k AS m, stddev_pop(v) OVER k AS s, count(*) OVER k AS n FROM e WINDOW k AS (PARTITION BY case_id, t % {dilation} ORDER BY t ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW)) SELECT case_id, t, {sql6('m')} AS m, {sql6('s')} AS s FROM w WHERE n = {length}"


def _sliding(dilation: int) -> Query:
    def run(spark, sf):
        rows = one_channel(embeddings(spark, sf)).select("case_id", F.posexplode(windows.sliding_mean_std(F.col("a"), 5, dilation)).alias("t", "w"))
        return rows.select("case_id", F.col("t").cast("long").alias("t"), r6("w.mean").alias("m"), r6("w.std").alias("s"))

    return run


query("q_sliding_mean_std_d1", _sliding_sql(1))(_sliding(1))
query("q_sliding_mean_std_d3", _sliding_sql(3))(_sliding(3))


@query("q_sliding_dot", f"WITH {E} SELECT a.case_id, a.t, {sql6('0.5 * a.v - 1.0 * b.v + 2.0 * c.v')} AS v FROM e a JOIN e b ON b.case_id = a.case_id AND b.t = a.t + 2 JOIN e c ON c.case_id = a.case_id AND c.t = a.t + 4")
def q_sliding_dot(spark, sf):
    shapelet = F.array(F.lit(0.5), F.lit(-1.0), F.lit(2.0))
    return _exploded(one_channel(embeddings(spark, sf)), windows.sliding_dot_product(F.col("a"), shapelet, 3, 2))


@query("q_subsequence", f"WITH {E} SELECT case_id, {sql6('avg(v)')} AS m, {sql6('stddev_pop(v)')} AS s, {sql6('sum(v * (t + 1))')} AS w FROM e WHERE t IN (4, 7, 10, 13, 16) GROUP BY case_id")
def q_subsequence(spark, sf):
    rows = embeddings(spark, sf).withColumn("s", F.element_at(windows.subsequence_moments(F.col("x"), 4, 5, 3), 1))
    return rows.select("case_id", r6("s.mean").alias("m"), r6("s.std").alias("s"), r6(stats.total(F.transform("s.values", lambda v, i: v * (4 + i * 3 + 1)))).alias("w"))


@query("q_acf", f"""WITH {E}, k AS (SELECT unnest(range(1, 5)) AS k), p AS (SELECT a.case_id, k.k, a.v AS p, b.v AS q FROM e a, k JOIN e b ON b.case_id = a.case_id AND b.t = a.t + k.k),
m AS (SELECT *, avg(p) OVER (PARTITION BY case_id, k) AS mp, avg(q) OVER (PARTITION BY case_id, k) AS mq FROM p),
s AS (SELECT case_id, k, sum((p - mp) * (p - mp)) AS pp, sum((q - mq) * (q - mq)) AS qq, sum((p - mp) * (q - mq)) AS pq FROM m GROUP BY ALL)
SELECT case_id, k - 1 AS t, {sql6('CASE WHEN pp <= 1e-9 AND qq <= 1e-9 THEN 1.0 WHEN pp <= 1e-9 OR qq <= 1e-9 THEN 0.0 ELSE pq / (sqrt(pp) * sqrt(qq)) END')} AS v FROM s""")
def q_acf(spark, sf):
    return _exploded(one_channel(AutocorrelationFunctionTransformer(n_lags=4).transform(embeddings(spark, sf))), F.col("a"))


def _dft_sql(view: str, cte: str, size: str) -> str:
    return f"""WITH {cte}, n AS (SELECT case_id, {size} AS n FROM {view} GROUP BY case_id), f AS (SELECT case_id, n, unnest(range(0, n // 2)) AS f FROM n)
SELECT f.case_id, f.f AS t, {sql6('sqrt(power(sum(x.v * cos(2 * pi() * f.f * x.t / f.n)), 2) + power(sum(x.v * sin(2 * pi() * f.f * x.t / f.n)), 2))')} AS v
FROM f JOIN {view} x ON x.case_id = f.case_id GROUP BY f.case_id, f.f"""


@query("q_periodogram", _dft_sql("e", E, "64"))
def q_periodogram(spark, sf):
    return _exploded(one_channel(PeriodogramTransformer().transform(embeddings(spark, sf))), F.col("a"))


@query("q_periodogram_padded", _dft_sql("v", V, "power(2, ceil(log2(count(*))))::BIGINT"))
def q_periodogram_padded(spark, sf):
    return _exploded(one_channel(PeriodogramTransformer().transform(event_values(spark, sf))), F.col("a"))


@query("q_burg_order1", f"WITH {E}, p AS (SELECT case_id, v, lag(v) OVER (PARTITION BY case_id ORDER BY t) AS b FROM e) SELECT case_id, {sql6('2 * sum(v * b) / sum(v * v + b * b)')} AS k FROM p WHERE b IS NOT NULL GROUP BY case_id")
def q_burg_order1(spark, sf):
    out = one_channel(ARCoefficientTransformer(order=1).transform(embeddings(spark, sf)))
    return out.select("case_id", r6(F.element_at("a", 1)).alias("k"))


# intervals

_FEATURE_SQL = {"mean": "avg(v)", "std": "stddev_pop(v)", "min": "min(v)", "max": "max(v)", "median": "quantile_cont(v, 0.5)", "quantile25": "quantile_cont(v, 0.25)", "quantile75": "quantile_cont(v, 0.75)"}
_CATALOGUE = [Interval(0, 10), Interval(5, 64), Interval(20, 33), Interval(60, 64)]
_DILATED = [Interval(0, 10, 0, 3), Interval(5, 64, 0, 7), Interval(20, 33, 0, 2)]
_META = SeriesMeta(0, 1, 64, 64)


def _drawn(n: int, seed: int) -> list[Interval]:
    rng = np.random.RandomState(seed)
    return list(dict.fromkeys(draw_interval(np.random.RandomState(rng.randint(np.iinfo(np.int32).max)), _META, 3, 64, [1]) for _ in range(n)))


def _interval_sql(intervals: list[Interval]) -> str:
    values = ", ".join(f"({i}, {v.start}, {v.end}, {v.dilation})" for i, v in enumerate(intervals))
    features = " UNION ALL ".join(f"SELECT case_id, i, {k} AS f, {sql} AS v FROM j GROUP BY case_id, i" for k, sql in enumerate(_FEATURE_SQL[f] for f in RANDOM_FEATURES))
    return f"WITH {E}, c(i, a, b, d) AS (VALUES {values}), j AS (SELECT e.case_id, c.i, e.v FROM e JOIN c ON e.t >= c.a AND e.t < c.b AND (e.t - c.a) % c.d = 0), s AS ({features}) SELECT case_id, (i * {len(RANDOM_FEATURES)} + f)::BIGINT AS t, {sql6('v')} AS v FROM s"


def _fixed_intervals(intervals: list[Interval]) -> Query:
    return lambda spark, sf: _exploded(embeddings(spark, sf), interval_features(F.col("x"), intervals, RANDOM_FEATURES))


query("q_interval_features", _interval_sql(_CATALOGUE))(_fixed_intervals(_CATALOGUE))
query("q_interval_dilated", _interval_sql(_DILATED))(_fixed_intervals(_DILATED))


@query("q_random_intervals", _interval_sql(_drawn(20, 7)))
def q_random_intervals(spark, sf):
    return _exploded(RandomIntervalTransformer(n_intervals=20, random_state=7).fit_transform(embeddings(spark, sf)), F.col("features"))


@query("q_feature_mask", f"WITH {E} SELECT case_id, {sql6('avg(v)')} AS f1, 0.0::DOUBLE AS f2, 0.0::DOUBLE AS f3, {sql6('max(v)')} AS f4 FROM e WHERE t < 10 GROUP BY case_id")
def q_feature_mask(spark, sf):
    features = interval_features(F.col("x"), [Interval(0, 10)], ["mean", "std", "min", "max"], [True, False, False, True])
    return unpacked(embeddings(spark, sf).withColumn("features", features), 4)


_ASKS = [(0, 0, 0, 20, 41), (0, 0, 41, 50, 64), (0, 1, 0, 10, 30)]


@query("q_supervised_round", f"""WITH {E}, z AS (SELECT case_id, y, t, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS v FROM e WINDOW w AS (PARTITION BY case_id)),
q(i, f, half, a, b) AS (VALUES {", ".join(f"({i}, {f}, {h}, {a}, {b})" for i, (_, f, s, m, e) in enumerate(_ASKS) for h, a, b in ((0, s, m), (1, m, e)))}),
x AS (SELECT q.i, q.half, z.case_id, z.y, CASE WHEN q.f = 0 THEN avg(z.v) ELSE stddev_pop(z.v) END AS v FROM z JOIN q ON z.t >= q.a AND z.t < q.b GROUP BY q.i, q.f, q.half, z.case_id, z.y),
o AS (SELECT i, half, avg(v) AS mu FROM x GROUP BY ALL), c AS (SELECT i, half, y, count(*) AS n, avg(v) AS m, greatest(stddev_pop(v), 1e-6) AS s FROM x GROUP BY ALL)
SELECT i, half, {sql6('sum(n * (m - mu) * (m - mu)) / sum(n * s * s)')} AS score FROM c JOIN o USING (i, half) GROUP BY i, half""")
def q_supervised_round(spark, sf):
    data = embeddings(spark, sf).select("y", F.transform("x", windows.z_normalise).alias("z"))
    found = SupervisedIntervalTransformer().scores(data, _ASKS, ["mean", "std"])
    rows = [(i, h, s) for (i, h), s in sorted(found.items())]
    return spark.createDataFrame(rows, "i int, half int, score double").select("i", "half", r6("score").alias("score"))


# containers and composition


@query("q_pad_flatten", f"WITH {V}, n AS (SELECT max(t) + 1 AS n FROM v), g AS (SELECT DISTINCT case_id, unnest(range(0, (SELECT n FROM n))) AS t FROM v) SELECT g.case_id, g.t, {sql6('coalesce(v.v, 0.0)')} AS v FROM g LEFT JOIN v USING (case_id, t)")
def q_pad_flatten(spark, sf):
    rows = event_values(spark, sf)
    return _exploded(rows, flatten(pad(F.col("x"), meta_of(rows).max_length)))


@query("q_channel_select", f"WITH {D} SELECT case_id, ch - 1 AS ch, t, {sql6('v')} AS v FROM d WHERE ch BETWEEN 1 AND 3")
def q_channel_select(spark, sf):
    rows = daily_events(spark, sf)
    kept = rows.withColumn("x", select_channels(F.col("x"), channels_of(slice(1, 4), 5)))
    return to_long(kept).select("case_id", F.col("ch").cast("long").alias("ch"), F.col("t").cast("long").alias("t"), r6("v").alias("v"))


@query("q_concat", f"WITH {E} SELECT case_id, " + ", ".join(f"{sql6(_agg(s))} AS f{i + 1}" for i, s in enumerate(_SUMMARIES["default"] + _SUMMARIES["tukey"])) + " FROM e GROUP BY case_id")
def q_concat(spark, sf):
    both = TransformerConcatenator([SevenNumberSummaryTransformer(), SevenNumberSummaryTransformer("tukey")])
    return unpacked(both.transform(embeddings(spark, sf)), 14)


@query("q_function", f"WITH {E} SELECT case_id, t, {sql6('ln(1 + abs(v))')} AS v FROM e")
def q_function(spark, sf):
    log = FunctionTransformer(lambda x: F.transform(x, lambda c: F.transform(c, lambda v: F.log1p(F.abs(v)))))
    return _exploded(one_channel(log.transform(embeddings(spark, sf))), F.col("a"))


@query("q_ts_meta", f"""WITH {E}, {V}, {D}, l AS (SELECT DISTINCT l_suppkey AS case_id, date_trunc('month', l_shipdate) AS t FROM lineitem),
n AS (SELECT 'embeddings' AS name, case_id, 1 AS c, count(*) AS n FROM e GROUP BY case_id UNION ALL SELECT 'events', case_id, 1, count(*) FROM v GROUP BY case_id
UNION ALL SELECT 'daily', case_id, 5, count(*) FROM d WHERE ch = 0 GROUP BY case_id UNION ALL SELECT 'suppliers', case_id, 1, count(*) FROM l GROUP BY case_id)
SELECT name, count(*) AS n_cases, max(c)::INTEGER AS n_channels, min(n)::INTEGER AS min_length, max(n)::INTEGER AS max_length FROM n GROUP BY name""")
def q_ts_meta(spark, sf):
    parts = []
    for name, fixture in (("embeddings", embeddings), ("events", event_values), ("daily", daily_events), ("suppliers", supplier_months)):
        lengths = F.transform("x", F.size)
        parts.append(fixture(spark, sf).agg(F.count(F.lit(1)).alias("n_cases"), F.max(F.size("x")).alias("n_channels"), F.min(F.array_min(lengths)).alias("min_length"), F.max(F.array_max(lengths)).alias("max_length")).withColumn("name", F.lit(name)))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@query("q_supplier_months", f"SELECT l_suppkey AS case_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY date_trunc('month', l_shipdate)) - 1 AS t, {sql6('sum(l_extendedprice)')} AS v FROM lineitem GROUP BY l_suppkey, date_trunc('month', l_shipdate)")
def q_supplier_months(spark, sf):
    return _exploded(one_channel(supplier_months(spark, sf)), F.col("a"))


# baselines and ensembles


@query("q_class_prior", f"WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), p AS (SELECT label, n / sum(n) OVER () AS p, n FROM c) SELECT vec_id AS case_id, (SELECT label FROM p ORDER BY n DESC, label LIMIT 1) AS prediction, {sql6('p.p')} AS p, p.label - (SELECT min(label) FROM c) AS k FROM embeddings, p")
def q_class_prior(spark, sf):
    rows = embeddings(spark, sf)
    out = DummyClassifier("prior").fit(rows).transform(rows)
    return out.select("case_id", "prediction", F.posexplode("probability").alias("k", "p")).select("case_id", "prediction", "k", r6("p").alias("p"))


def _dummy(strategy: str, quantile: float | None = None) -> Query:
    def run(spark, sf):
        rows = customer_prices(spark, sf)
        return DummyRegressor(strategy, quantile=quantile).fit(rows).transform(rows).select("case_id", r6("prediction").alias("prediction"))

    return run


_R = "r AS (SELECT c_custkey AS case_id, c_acctbal::DOUBLE AS y FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))"
for _name, _sql, _f in (("mean", "avg(y)", _dummy("mean")), ("median", "quantile_cont(y, 0.5)", _dummy("median")), ("quantile", "quantile_cont(y, 0.9)", _dummy("quantile", 0.9))):
    query(f"q_dummy_{_name}", f"WITH {_R} SELECT case_id, (SELECT {sql6(_sql)} FROM r) AS prediction FROM r")(_f)


@query("q_ensemble_average", f"WITH {_R} SELECT case_id, (SELECT {sql6('(avg(y) + quantile_cont(y, 0.5) + quantile_cont(y, 0.9)) / 3')} FROM r) AS prediction FROM r")
def q_ensemble_average(spark, sf):
    rows = customer_prices(spark, sf).withColumn("x", F.array(F.element_at("x", 1), F.element_at("x", 1), F.element_at("x", 1)))
    members = [("mean", DummyRegressor(), 0), ("median", DummyRegressor("median"), [1]), ("high", DummyRegressor("quantile", quantile=0.9), slice(2, 3))]
    # series of one order are short, so lengths are not checked here beyond their presence
    ensemble = ChannelEnsembleRegressor(members)
    ensemble.needs = DummyRegressor.needs
    return ensemble.fit(rows).transform(rows).select("case_id", r6("prediction").alias("prediction"))


@query("q_knn5", f"WITH {E}, p AS (SELECT a.case_id, b.case_id AS neighbour_id, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS d FROM e a JOIN e b ON a.t = b.t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(d, 9), neighbour_id)::INTEGER AS rank FROM p) SELECT case_id, rank, neighbour_id, {sql6('d')} AS distance FROM r WHERE rank <= 5")
def q_knn5(spark, sf):
    rows = embeddings(spark, sf).select("case_id", F.element_at("x", 1).alias("features"))
    return nearest_neighbours(rows, rows, 5).select("case_id", "rank", "neighbour_id", r6("distance").alias("distance"))


@query("q_dummy_clusterer", "SELECT vec_id AS case_id, (row_number() OVER (ORDER BY vec_id) - 1)::INTEGER AS cluster FROM embeddings")
def q_dummy_clusterer(spark, sf):
    rows = embeddings(spark, sf)
    return DummyClusterer("unique").fit(rows).transform(rows).select("case_id", "cluster")
