"""Queries of learners, kernels and sources, and the SQL they are held against.

Learners run with a head that SQL can state (Gaussian naive Bayes, least squares, k-means
of two far-apart groups). Those whose training can't be stated (forests, symbolic and
landmark models) learn to tell two kinds of waves apart: any of them has to name every
case's kind.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import numpy as np
from pyspark.ml.classification import NaiveBayes, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.functions import arrow, draws, stats, windows
from undula.learn.compose import ChannelEnsembleClassifier, TabularClassifier, TabularClusterer, TabularRegressor, members_of
from undula.learn.dummy import DummyClassifier, DummyClusterer, DummyRegressor
from undula.learn.grail import GRAILClassifier, sink, z
from undula.learn.pipelines import FPCAClassifier, FPCARegressor, RandomIntervalClassifier, RandomIntervalRegressor, SupervisedIntervalClassifier
from undula.learn.shapelets import RandomShapeletForestClassifier, RandomShapeletForestRegressor, distances
from undula.learn.symbolic import MrSEQLClassifier, MrSQMClassifier, Representation, chi_squared
from undula.operators.base import all_operators, check_n_jobs, is_clusterer, is_transformer
from undula.operators.fpca import FPCATransformer
from undula.operators.intervals import RandomIntervalTransformer, SupervisedIntervalTransformer
from undula.operators.select import channels_of, check_key
from undula.operators.transforms import ARCoefficientTransformer, SevenNumberSummaryTransformer
from undula.plans.intervals import Interval, interval_features
from undula.queries import D, E, V, _drawn, _exploded, _interval_sql, one_channel, query, r6, sql6, unpacked
from undula.series import SeriesMeta, meta_of
from undula.sources import bundled, generators
from undula.sources.tables import customer_prices, daily_events, embeddings
from undula.sources.ts_format import TsFormatError, parse_case, parse_header, read_ts, with_first, write_ts
from undula.streaming.assemble import assemble

#: Two numbers a vector: the means of its halves, as a series of length 2.
H = f"{E}, h AS (SELECT case_id, y, avg(v) FILTER (t < 32) AS p, avg(v) FILTER (t >= 32) AS q FROM e GROUP BY case_id, y)"


def halves(spark, sf) -> DataFrame:
    a = F.element_at("x", 1)
    pair = F.array(F.array(stats.mean(F.slice(a, 1, 32)), stats.mean(F.slice(a, 33, 32))))
    return embeddings(spark, sf).select("case_id", "y", pair.alias("x"))


def waves(spark, sf) -> DataFrame:
    """Fast waves where the label is odd, slow ones elsewhere, each with a vector as noise."""
    rows = embeddings(spark, sf).withColumn("y", F.col("y") % 2)
    return rows.withColumn("x", F.transform("x", lambda c: F.transform(c, lambda v, i: v / 4 + F.sin(i * F.when(F.col("y") == 1, 2.1).otherwise(0.4)))))


def gaussian() -> NaiveBayes:
    return NaiveBayes(modelType="gaussian")


def bayes_sql(views: str, features: str = "f") -> str:
    """Views up to bayes(case_id, y, p): class probabilities by Gaussian naive Bayes from a view (case_id, y, k, v)."""
    return f"""{views},
    eps AS (SELECT 1e-9 * max(s) AS eps FROM (SELECT var_samp(v) AS s FROM {features} GROUP BY k)),
    nb AS (SELECT y, k, avg(v) AS m, avg(v * v) - avg(v) * avg(v) + any_value(eps) AS s FROM {features}, eps GROUP BY y, k),
    prior AS (SELECT y, ln(count(DISTINCT case_id) / (SELECT count(DISTINCT case_id) FROM {features})) AS prior FROM {features} GROUP BY y),
    lik AS (SELECT {features}.case_id, nb.y, sum(-0.5 * ln(2 * pi() * s) - 0.5 * (v - m) * (v - m) / s) AS l FROM {features} JOIN nb USING (k) GROUP BY {features}.case_id, nb.y),
    post AS (SELECT case_id, lik.y, l + prior AS l FROM lik JOIN prior USING (y)),
    bayes AS (SELECT case_id, y, exp(l - max(l) OVER w) / sum(exp(l - m)) OVER w AS p FROM (SELECT *, max(l) OVER (PARTITION BY case_id) AS m FROM post) WINDOW w AS (PARTITION BY case_id))"""


def best_sql(views: str) -> str:
    return f"WITH {views} SELECT case_id, y AS prediction, {sql6('p')} AS p FROM bayes QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY p DESC, y) = 1"


def best(out: DataFrame) -> DataFrame:
    return out.select("case_id", "prediction", r6(F.array_max("probability")).alias("p"))


def fitted(model, rows: DataFrame) -> DataFrame:
    return model.fit(rows).transform(rows)


# interval and FPCA pipelines

_FEATURES_20 = _interval_sql(_drawn(20, 7)).replace("WITH ", "", 1).rsplit(" SELECT case_id, (i * ", 1)[0]
_LONG_20 = f"{_FEATURES_20}, f AS (SELECT s.case_id, y.label AS y, (i * 7 + f) AS k, s.v FROM s JOIN embeddings y ON y.vec_id = s.case_id)"


@query("q_interval_classifier", best_sql(bayes_sql(_LONG_20)))
def q_interval_classifier(spark, sf):
    return best(fitted(RandomIntervalClassifier(n_intervals=20, estimator=gaussian(), random_state=7), embeddings(spark, sf)))


def line_sql(view: str) -> str:
    """Least squares of y on v over a view (case_id, y, v)."""
    return f"SELECT case_id, {sql6('(SELECT regr_intercept(y, v) FROM ' + view + ') + (SELECT regr_slope(y, v) FROM ' + view + ') * v')} AS prediction FROM {view}"


_ONE = _drawn(1, 3)[0]


@query("q_interval_regressor", f"WITH {E}, f AS (SELECT case_id, y::DOUBLE AS y, avg(v) AS v FROM e WHERE t >= {_ONE.start} AND t < {_ONE.end} GROUP BY case_id, y) {line_sql('f')}")
def q_interval_regressor(spark, sf):
    rows = embeddings(spark, sf).withColumn("y", F.col("y").cast("double"))
    return fitted(RandomIntervalRegressor(n_intervals=1, features="mean", estimator=LinearRegression(), random_state=3), rows).select("case_id", r6("prediction").alias("prediction"))


def _supervised_views(seed: int = 5) -> str:
    """Halving without chance from fixed cuts: views up to found(k, f, a, b), the intervals in their order."""
    search, meta = SupervisedIntervalTransformer(n_intervals=1, features=["mean", "std"], randomised_split_point=False, random_state=seed), SeriesMeta(0, 1, 64, 64)
    first = int(np.random.RandomState(seed).randint(np.iinfo(np.int32).max))
    roots, nodes = [], []

    def halve(f: int, a: int, b: int) -> None:
        if (f, a, b) not in nodes:
            nodes.append((f, a, b))
            if b - a >= 6:
                halve(f, a, a + (b - a) // 2)
                halve(f, a + (b - a) // 2, b)

    for f in (0, 1):
        rng = np.random.RandomState(int(np.random.SeedSequence([first, 0, f]).generate_state(1)[0] % np.iinfo(np.int32).max))
        cut = search._cut(rng, meta.min_length, 3)
        for side, (a, b) in enumerate(((0, cut), (cut, 64))):
            roots.append((f, side, a, b))
            halve(f, a, b)
    values = lambda rows: ", ".join(map(str, rows))
    return f"""{E}, z AS (SELECT case_id, y, t, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS v FROM e WINDOW w AS (PARTITION BY case_id)),
    node(f, a, b) AS (VALUES {values(nodes)}), root(f, side, a, b) AS (VALUES {values(roots)}),
    x AS (SELECT f, a, b, z.case_id, z.y, CASE WHEN f = 0 THEN avg(z.v) ELSE stddev_pop(z.v) END AS v FROM z JOIN node ON z.t >= a AND z.t < b GROUP BY f, a, b, z.case_id, z.y),
    o AS (SELECT f, a, b, avg(v) AS mu FROM x GROUP BY ALL), c AS (SELECT f, a, b, y, count(*) AS n, avg(v) AS m, greatest(stddev_pop(v), 1e-6) AS s FROM x GROUP BY ALL),
    score AS (SELECT f, a, b, sum(n * (m - mu) * (m - mu)) / sum(n * s * s) AS score FROM c JOIN o USING (f, a, b) GROUP BY f, a, b),
    path AS (SELECT f, side, 0 AS depth, a, b FROM root UNION ALL
      SELECT p.f, p.side, p.depth + 1, CASE WHEN l.score >= r.score AND l.score <> 0 THEN p.a ELSE r.a END, CASE WHEN l.score >= r.score AND l.score <> 0 THEN l.b ELSE p.b END
      FROM path p JOIN score l ON l.f = p.f AND l.a = p.a AND l.b = p.a + (p.b - p.a) // 2 JOIN score r ON r.f = p.f AND r.a = l.b AND r.b = p.b
      WHERE p.b - p.a >= 6 AND ((l.score >= r.score AND l.score <> 0) OR r.score > l.score)),
    found AS (SELECT row_number() OVER (ORDER BY f, side, depth) - 1 AS k, f, a, b FROM path WHERE depth > 0)"""


_SUPERVISED = {"n_intervals": 1, "features": ["mean", "std"], "randomised_split_point": False, "random_state": 5}


@query("q_supervised_search", f"WITH RECURSIVE {_supervised_views()} SELECT k, CASE WHEN f = 0 THEN 'mean' ELSE 'std' END AS feature, a AS first, b AS until FROM found")
def q_supervised_search(spark, sf):
    found = SupervisedIntervalTransformer(**_SUPERVISED, mode="lockstep").fit(embeddings(spark, sf)).pairs
    return spark.createDataFrame([(k, f, i.start, i.end) for k, (i, f) in enumerate(found)], "k long, feature string, first int, until int")


_SUPERVISED_LONG = f"{_supervised_views()}, f2 AS (SELECT k, e.case_id, e.y, CASE WHEN found.f = 0 THEN avg(e.v) ELSE stddev_pop(e.v) END AS v FROM found JOIN e ON e.t >= found.a AND e.t < found.b GROUP BY k, found.f, e.case_id, e.y)"


@query("q_supervised_classifier", best_sql("RECURSIVE " + bayes_sql(_SUPERVISED_LONG, "f2")))
def q_supervised_classifier(spark, sf):
    return best(fitted(SupervisedIntervalClassifier(**_SUPERVISED, estimator=gaussian()), embeddings(spark, sf)))


@query("q_fpca", f"WITH {E}, m AS (SELECT *, v - avg(v) OVER (PARTITION BY t) AS d FROM e) SELECT case_id, {sql6('sum(CASE WHEN t IN (0, 63) THEN 0.5 ELSE 1.0 END * d * d)')} AS energy FROM m GROUP BY case_id")
def q_fpca(spark, sf):
    """All components together keep a case's weighted distance from the mean."""
    out = FPCATransformer(n_components=64).fit_transform(embeddings(spark, sf))
    return out.select("case_id", r6(stats.total(F.transform("features", lambda v: v * v))).alias("energy"))


#: Both components of two points in closed form, signed so that the larger entry of an axis is positive.
_TWO = f"""{H}, cov AS (SELECT var_samp(p) AS a, var_samp(q) AS c, covar_samp(p, q) AS b, avg(p) AS mp, avg(q) AS mq FROM h),
    ax AS (SELECT *, (a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS l FROM cov), ay AS (SELECT *, b / sqrt(b * b + (l - a) * (l - a)) AS u, (l - a) / sqrt(b * b + (l - a) * (l - a)) AS w FROM ax),
    az AS (SELECT *, CASE WHEN abs(u) > abs(w) THEN sign(u) ELSE sign(w) END AS s1, CASE WHEN abs(w) > abs(u) THEN sign(-w) ELSE sign(u) END AS s2 FROM ay),
    sc AS (SELECT case_id, y, sqrt(0.5) * s1 * (u * (p - mp) + w * (q - mq)) AS f1, sqrt(0.5) * s2 * (u * (q - mq) - w * (p - mp)) AS f2 FROM h, az)"""


@query("q_fpca_two_points", f"WITH {_TWO} SELECT case_id, {sql6('f1')} AS f1, {sql6('f2')} AS f2 FROM sc")
def q_fpca_two_points(spark, sf):
    return unpacked(FPCATransformer(n_components=2).fit_transform(halves(spark, sf)), 2)


_TWO_LONG = f"{_TWO}, f AS (SELECT case_id, y, 1 AS k, f1 AS v FROM sc UNION ALL SELECT case_id, y, 2, f2 FROM sc)"


@query("q_fpca_classifier", best_sql(bayes_sql(_TWO_LONG)))
def q_fpca_classifier(spark, sf):
    return best(fitted(FPCAClassifier(n_components=2, estimator=gaussian()), halves(spark, sf)))


#: Least squares on two numbers, which a rotation of them doesn't change.
_PLANE = f"""WITH {H}, m AS (SELECT avg(p) AS mp, avg(q) AS mq, avg(y::DOUBLE) AS my, covar_pop(p, p) AS pp, covar_pop(q, q) AS qq, covar_pop(p, q) AS pq, covar_pop(p, y::DOUBLE) AS py, covar_pop(q, y::DOUBLE) AS qy FROM h)
    SELECT case_id, {sql6('my + (qq * py - pq * qy) / (pp * qq - pq * pq) * (p - mp) + (pp * qy - pq * py) / (pp * qq - pq * pq) * (q - mq)')} AS prediction FROM h, m"""


def _plane(model: Callable) -> Callable:
    def run(spark, sf):
        rows = halves(spark, sf).withColumn("y", F.col("y").cast("double"))
        return fitted(model(), rows).select("case_id", r6("prediction").alias("prediction"))

    return run


query("q_fpca_regressor", _PLANE)(_plane(lambda: FPCARegressor(n_components=2, estimator=LinearRegression(solver="normal"))))
query("q_tabular_regressor", _PLANE)(_plane(lambda: TabularRegressor(LinearRegression(solver="normal"))))


# tables, ensembles, baselines


@query("q_tabular_classifier", best_sql(bayes_sql(f"{E}, f AS (SELECT case_id, y, t AS k, v FROM e)")))
def q_tabular_classifier(spark, sf):
    return best(fitted(TabularClassifier(gaussian()), embeddings(spark, sf)))


@query("q_tabular_clusterer", "SELECT vec_id AS case_id, min(vec_id) OVER (PARTITION BY label % 2) AS first FROM embeddings")
def q_tabular_clusterer(spark, sf):
    """Two groups of series far apart: each case's cluster, named by its first case."""
    rows = embeddings(spark, sf).withColumn("x", F.transform("x", lambda c: F.transform(c, lambda v: v + 100 * (F.col("y") % 2))))
    out = fitted(TabularClusterer(KMeans(k=2, seed=0)), rows)
    firsts = out.groupBy("cluster").agg(F.min("case_id").alias("first"))
    return out.join(F.broadcast(firsts), "cluster").select("case_id", "first")


_LONG_5 = _interval_sql(_drawn(5, 7)).replace("WITH ", "", 1).rsplit(" SELECT case_id, (i * ", 1)[0]


@query(
    "q_channel_ensemble",
    "WITH " + bayes_sql(f"{_LONG_5}, f AS (SELECT s.case_id, y.label AS y, (i * 7 + f) AS k, s.v FROM s JOIN embeddings y ON y.vec_id = s.case_id)") + f" SELECT case_id, y - (SELECT min(label) FROM embeddings) AS k, {sql6('(p + exp(prior)) / 2')} AS p FROM bayes JOIN prior USING (y)",
)
def q_channel_ensemble(spark, sf):
    members = [("dummy", DummyClassifier(), "all"), ("intervals", RandomIntervalClassifier(n_intervals=5, estimator=gaussian(), random_state=7), lambda meta: [meta.n_channels - 1])]
    out = fitted(ChannelEnsembleClassifier(members), embeddings(spark, sf))
    return out.select("case_id", F.posexplode("probability").alias("k", "p")).select("case_id", "k", r6("p").alias("p"))


_SHARE = "('0x' || substr(md5(vec_id || '|' || '{}'), 1, 13))::BIGINT / power(2.0, 52)"


@query(
    "q_dummy_classifiers",
    f"""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), k AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS i, sum(n) OVER (ORDER BY label) / sum(n) OVER () AS upto, count(*) OVER () AS m FROM c),
    top AS (SELECT label FROM c ORDER BY n DESC, label LIMIT 1)
    SELECT 'most_frequent' AS strategy, vec_id AS case_id, (SELECT label FROM top) AS prediction FROM embeddings UNION ALL SELECT 'prior', vec_id, (SELECT label FROM top) FROM embeddings
    UNION ALL SELECT 'constant', vec_id, (SELECT min(label) FROM c) FROM embeddings
    UNION ALL SELECT 'uniform', vec_id, (SELECT label FROM k WHERE i = floor({_SHARE.format(3)} * m)) FROM embeddings
    UNION ALL SELECT 'stratified', vec_id, (SELECT min(label) FROM k WHERE {_SHARE.format(3)} < upto) FROM embeddings""",
)
def q_dummy_classifiers(spark, sf):
    rows = embeddings(spark, sf)
    least = rows.agg(F.min("y")).first()[0]
    parts = [fitted(DummyClassifier(s, constant=least if s == "constant" else None, random_state=3), rows).select(F.lit(s).alias("strategy"), "case_id", "prediction") for s in ("most_frequent", "prior", "constant", "uniform", "stratified")]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@query("q_dummy_constant", "SELECT c_custkey AS case_id, 3.5::DOUBLE AS prediction FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def q_dummy_constant(spark, sf):
    return fitted(DummyRegressor("constant", constant=3.5), customer_prices(spark, sf)).select("case_id", "prediction")


@query("q_dummy_clusterers", f"SELECT 'single' AS strategy, vec_id AS case_id, 0 AS cluster FROM embeddings UNION ALL SELECT 'random', vec_id, floor({_SHARE.format(4)} * 3)::INTEGER FROM embeddings")
def q_dummy_clusterers(spark, sf):
    rows = embeddings(spark, sf)
    single, random = (fitted(DummyClusterer(s, 3, random_state=4), rows).select(F.lit(s).alias("strategy"), "case_id", "cluster") for s in ("single", "random"))
    return single.unionByName(random)


# learners that tell kinds of waves apart


def _told_apart(name: str, model: Callable[[], object], sql: str = "SELECT vec_id AS case_id, label % 2 AS prediction FROM embeddings") -> None:
    query(name, sql)(lambda spark, sf: fitted(model(), waves(spark, sf)).select("case_id", "prediction"))


_told_apart("q_rf_pipeline", lambda: RandomIntervalClassifier(n_intervals=20, estimator=RandomForestClassifier(numTrees=50, seed=0), random_state=0))
_told_apart("q_rsf", lambda: RandomShapeletForestClassifier(n_estimators=20, min_shapelet_size=0.25, random_state=0))
_told_apart("q_sax", lambda: MrSEQLClassifier(symrep="sax", random_state=0))
_told_apart("q_sfa", lambda: MrSQMClassifier(nsfa=2, features_per_rep=100, random_state=0))
_told_apart("q_grail", lambda: GRAILClassifier("logistic", random_state=0))
_told_apart("q_grail_svm", lambda: GRAILClassifier("svm", random_state=0, costs=[10.0]))
_told_apart("q_grail_knn", lambda: GRAILClassifier("knn", random_state=0))


@query("q_rsf_regressor", "SELECT vec_id AS case_id, (label % 2)::DOUBLE AS prediction FROM embeddings")
def q_rsf_regressor(spark, sf):
    rows = waves(spark, sf).withColumn("y", F.col("y").cast("double"))
    return fitted(RandomShapeletForestRegressor(n_estimators=10, min_shapelet_size=0.25, random_state=0), rows).select("case_id", F.round("prediction").alias("prediction"))


# kernels of the learners


@query(
    "q_burg",
    f"""WITH RECURSIVE {E}, l AS (SELECT case_id, list(v ORDER BY t) AS x FROM e GROUP BY case_id),
    s AS (SELECT case_id, 0 AS m, x[2:] AS f, x[:-2] AS b, []::DOUBLE[] AS c FROM l UNION ALL
      SELECT case_id, m + 1, list_transform(range(2, len(f) + 1), lambda i: f[i] - k * b[i]), list_transform(range(1, len(f)), lambda i: b[i] - k * f[i]),
             list_concat(list_transform(range(1, m + 1), lambda i: c[i] - k * c[m + 1 - i]), [k])
      FROM (SELECT *, 2 * list_inner_product(f, b) / (list_inner_product(f, f) + list_inner_product(b, b)) AS k FROM s) WHERE m < 8)
    SELECT case_id, i - 1 AS t, {sql6('c[i]')} AS v FROM (SELECT case_id, c, unnest(range(1, 9)) AS i FROM s WHERE m = 8)""",
)
def q_burg(spark, sf):
    return _exploded(one_channel(ARCoefficientTransformer(order=8).transform(embeddings(spark, sf))), F.col("a"))


_SAX = (16, 4, 4)  # window, word, alphabet
_CUTS = [NormalDist().inv_cdf(k / _SAX[2]) for k in range(1, _SAX[2])]
_WINDOW = f"""w AS (SELECT a.case_id, a.t AS s, b.t - a.t AS j, b.v, avg(b.v) OVER k AS m, stddev_pop(b.v) OVER k AS sd FROM e a JOIN e b ON b.case_id = a.case_id AND b.t >= a.t AND b.t < a.t + {_SAX[0]} WHERE a.t <= {64 - _SAX[0]} WINDOW k AS (PARTITION BY a.case_id, a.t)),
    n AS (SELECT case_id, s, j, (v - m) / greatest(sd, 1e-8) AS v FROM w)"""
_WORDS = f"""{E}, {_WINDOW}, g AS (SELECT case_id, s, j // {_SAX[0] // _SAX[1]} AS g, avg(v) AS v FROM n GROUP BY ALL),
    c AS (SELECT case_id, s, string_agg(chr(97 + {" + ".join(f"(v > {x!r})::INTEGER" for x in _CUTS)}), '' ORDER BY g) AS word FROM g GROUP BY case_id, s),
    d AS (SELECT case_id, s, '0:' || word AS word FROM (SELECT *, lag(word) OVER (PARTITION BY case_id ORDER BY s) AS before FROM c) WHERE before IS NULL OR before <> word)"""


@query("q_sax_words", f"WITH {_WORDS} SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY s) - 1 AS k, word FROM d")
def q_sax_words(spark, sf):
    words = Representation("sax", *_SAX).tokens(F.col("x"), (1,))
    return embeddings(spark, sf).select("case_id", F.posexplode(words).alias("k", "word")).select("case_id", F.col("k").cast("long").alias("k"), "word")


@query(
    "q_chi_squared",
    f"""WITH {_WORDS}, has AS (SELECT DISTINCT case_id, word FROM d), k AS (SELECT label AS y, count(*) AS n FROM embeddings GROUP BY label), total AS (SELECT count(*) AS n FROM embeddings),
    seen AS (SELECT word, label AS y, count(*) AS o FROM has JOIN embeddings ON vec_id = case_id GROUP BY ALL), terms AS (SELECT word, count(*) AS a FROM has GROUP BY word),
    cell AS (SELECT terms.word, coalesce(o, 0) AS o, a / total.n * k.n AS x, k.n FROM terms, k, total LEFT JOIN seen ON seen.word = terms.word AND seen.y = k.y)
    SELECT word AS term, {sql6('sum(CASE WHEN x > 1e-9 THEN (o - x) * (o - x) / x ELSE 0 END + CASE WHEN n - x > 1e-9 THEN (o - x) * (o - x) / (n - x) ELSE 0 END)')} AS score FROM cell GROUP BY word""",
)
def q_chi_squared(spark, sf):
    words = Representation("sax", *_SAX).tokens(F.col("x"), (1,))
    rows = embeddings(spark, sf)
    classes = [r[0] for r in rows.select("y").distinct().orderBy("y").collect()]
    bag = rows.select((F.array_position(F.array(*map(F.lit, classes)), F.col("y")) - 1).cast("int").alias("label"), words.alias("bag"))
    return chi_squared(bag, len(classes)).select("term", r6("score").alias("score"))


@query(
    "q_sfa_coefficients",
    f"""WITH {E}, {_WINDOW}, k AS (SELECT unnest(range(0, 4)) AS k)
    SELECT case_id, s, k, {sql6(f'sum(v * CASE WHEN k % 2 = 0 THEN cos(2 * pi() * (k // 2 + 1) * j / {_SAX[0]}) ELSE -sin(2 * pi() * (k // 2 + 1) * j / {_SAX[0]}) END)')} AS v FROM n, k GROUP BY case_id, s, k""",
)
def q_sfa_coefficients(spark, sf):
    sfa = Representation("sfa", _SAX[0], 4, 4)
    values = arrow.per_case(F.col("x"), lambda m: sfa.values(m[0]).tolist())
    rows = embeddings(spark, sf).select("case_id", F.posexplode(values).alias("s", "c")).select("case_id", "s", F.posexplode("c").alias("k", "v"))
    return rows.select("case_id", F.col("s").cast("long").alias("s"), F.col("k").cast("long").alias("k"), r6("v").alias("v"))


_SHAPELETS = [[0.1, -0.2, 0.3], [0.2, 0.0, -0.1], [0.3, 0.1, -0.1, -0.3, 0.05]]


def _shapelet_sql(scaled: bool) -> str:
    rows = ", ".join(f"({i}, {j}, {v}, {len(s)})" for i, s in enumerate(_SHAPELETS) for j, v in enumerate(s))
    norm = lambda view, by: f"SELECT *, (v - avg(v) OVER w) / greatest(stddev_pop(v) OVER w, 1e-12) AS z FROM {view} WINDOW w AS (PARTITION BY {by})" if scaled else f"SELECT *, v AS z FROM {view}"
    return f"""WITH {E}, s(i, j, v, n) AS (VALUES {rows}), sz AS ({norm('s', 'i')}), x AS (SELECT s.i, a.case_id, a.t, s.j, b.v FROM e a JOIN (SELECT DISTINCT i, j, n FROM s) s ON a.t <= 64 - s.n JOIN e b ON b.case_id = a.case_id AND b.t = a.t + s.j),
    xz AS ({norm('x', 'i, case_id, t')}), d AS (SELECT xz.i, case_id, t, sqrt(sum((xz.z - sz.z) * (xz.z - sz.z))) AS d FROM xz JOIN sz USING (i, j) GROUP BY xz.i, case_id, t)
    SELECT case_id, i::BIGINT AS t, {sql6('min(d)')} AS v FROM d GROUP BY case_id, i"""


for _metric in ("euclidean", "scaled_euclidean"):
    query(f"q_shapelets_{_metric}", _shapelet_sql(_metric != "euclidean"))(lambda spark, sf, metric=_metric: _exploded(embeddings(spark, sf), distances(F.col("x"), [(0, np.array(s)) for s in _SHAPELETS], metric)))


#: Landmarks: three sine waves, and the width of the kernel.
_LANDMARKS, _GAMMA = [0.3, 1.0, 2.2], 5.0


@query(
    "q_sink",
    f"""WITH {E}, ez AS (SELECT case_id, t, (v - avg(v) OVER w) / greatest(stddev_pop(v) OVER w, 1e-12) AS z FROM e WINDOW w AS (PARTITION BY case_id)),
    l AS (SELECT k, f, t, sin(f * t) AS v FROM (VALUES {", ".join(f"({k}, {f})" for k, f in enumerate(_LANDMARKS))}) x(k, f), (SELECT unnest(range(0, 64)) AS t)),
    lz AS (SELECT k, t, (v - avg(v) OVER w) / greatest(stddev_pop(v) OVER w, 1e-12) AS z FROM l WINDOW w AS (PARTITION BY k)),
    en AS (SELECT case_id, sqrt(sum(z * z)) AS n FROM ez GROUP BY case_id), ln AS (SELECT k, sqrt(sum(z * z)) AS n FROM lz GROUP BY k),
    ee AS (SELECT a.case_id, b.t - a.t AS d, sum(a.z * b.z) AS c FROM ez a JOIN ez b USING (case_id) GROUP BY a.case_id, d), ll AS (SELECT a.k, b.t - a.t AS d, sum(a.z * b.z) AS c FROM lz a JOIN lz b USING (k) GROUP BY a.k, d),
    el AS (SELECT a.case_id, b.k, b.t - a.t AS d, sum(a.z * b.z) AS c FROM ez a, lz b GROUP BY a.case_id, b.k, d),
    eo AS (SELECT case_id, sum(exp({_GAMMA} * c / (n * n))) AS o FROM ee JOIN en USING (case_id) GROUP BY case_id), lo AS (SELECT k, sum(exp({_GAMMA} * c / (n * n))) AS o FROM ll JOIN ln USING (k) GROUP BY k),
    s AS (SELECT case_id, k, sum(exp({_GAMMA} * c / (en.n * ln.n))) AS s FROM el JOIN en USING (case_id) JOIN ln USING (k) GROUP BY case_id, k)
    SELECT case_id, k::BIGINT AS t, {sql6('s / sqrt(eo.o * lo.o)')} AS v FROM s JOIN eo USING (case_id) JOIN lo USING (k)""",
)
def q_sink(spark, sf):
    marks = z(np.sin(np.outer(_LANDMARKS, np.arange(64))))
    return _exploded(embeddings(spark, sf), arrow.per_batch(F.col("x"), lambda c: sink(z(c[:, 0]), marks, _GAMMA)))


# functions given by the user


@query("q_feature_callables", f"WITH {E} SELECT case_id, {sql6('max(v) - min(v)')} AS f1, " + ", ".join(f"{sql6(s)} AS f{i + 2}" for i, s in enumerate(["min(v)", "max(v)", *(f"quantile_cont(v, {q})" for q in (0.125, 0.25, 0.5, 0.75, 0.875))])) + " FROM e WHERE t >= 3 AND t < 20 GROUP BY case_id")
def q_feature_callables(spark, sf):
    features = interval_features(F.col("x"), [Interval(3, 20)], [lambda c: F.array_max(c) - F.array_min(c), SevenNumberSummaryTransformer("tukey")])
    return unpacked(embeddings(spark, sf).withColumn("features", features), 8)


@query("q_metric_callable", f"WITH {E}, x AS (SELECT half, case_id, y, avg(v) AS v FROM e JOIN (VALUES (0, 0, 20), (1, 20, 41)) q(half, a, b) ON t >= a AND t < b GROUP BY ALL) SELECT 0 AS i, half, {sql6('avg(v) FILTER (y = 0) - avg(v)')} AS score FROM x GROUP BY half")
def q_metric_callable(spark, sf):
    data = embeddings(spark, sf).select("y", F.col("x").alias("z"))
    found = SupervisedIntervalTransformer(metric=lambda v, y: v[y == 0].mean() - v.mean()).scores(data, [(0, 0, 0, 20, 41)], ["mean"])
    return spark.createDataFrame([(i, h, s) for (i, h), s in sorted(found.items())], "i int, half int, score double").select("i", "half", r6("score").alias("score"))


@query("q_size_callable", _interval_sql(_drawn(4, 9)))
def q_size_callable(spark, sf):
    return _exploded(RandomIntervalTransformer(n_intervals=lambda meta: meta.max_length // 16, random_state=9).fit_transform(embeddings(spark, sf)), F.col("features"))


@query("q_ensemble_channels", f"WITH {D}, n AS (SELECT count(DISTINCT ch) AS n FROM d) SELECT 'last' AS member, n - 1 AS ch FROM n UNION ALL SELECT 'two', unnest([0, 2]) UNION ALL SELECT 'remainder', unnest(range(0, n)) FROM n WHERE true EXCEPT ALL SELECT 'remainder', unnest([0, 2, n - 1]) FROM n")
def q_ensemble_channels(spark, sf):
    meta = meta_of(daily_events(spark, sf))
    found = members_of([("last", DummyClassifier(), lambda m: m.n_channels - 1), ("two", DummyClassifier(), [0, -3])], DummyClassifier(), meta)
    return spark.createDataFrame([(name, ch) for name, _, channels in found for ch in channels], "member string, ch long")


# pieces that need no table


def _values(rows: list[tuple], names: str, casts: str = "*") -> str:
    return f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join('NULL' if v is None else repr(v) for v in r) + ')' for r in rows)}) x({names})"


@query("q_primes", "SELECT n FROM range(2, 1001) r(n) WHERE NOT EXISTS (SELECT 1 FROM range(2, 32) d(d) WHERE d < n AND n % d = 0)")
def q_primes(spark, sf):
    return spark.createDataFrame([(n,) for n in stats.prime_up_to(1000)], "n long")


@query("q_znorm_about", f"WITH {V}, s AS (SELECT *, sqrt(avg((v - 1.0) * (v - 1.0)) OVER (PARTITION BY case_id)) AS s FROM v) SELECT case_id, t, {sql6('CASE WHEN s > 0 THEN (v - 1.0) / s ELSE v - 1.0 END')} AS v FROM s")
def q_znorm_about(spark, sf):
    from undula.sources.tables import event_values

    return _exploded(one_channel(event_values(spark, sf)), windows.z_normalise_with_mean(F.col("a"), F.lit(1.0)))


_KEYS = [("int", 2), ("negative", -1), ("list", [0, 3]), ("slice", slice(1, 3)), ("all", slice(None, None))]
_BAD_KEYS = [("float", 1.5), ("empty", []), ("step", slice(0, 4, 2)), ("bool", True), ("text", "a")]


@query("q_channel_keys", _values([("int", 2), ("negative", 3), ("list", 0), ("list", 3), ("slice", 1), ("slice", 2), *(("all", k) for k in range(4)), *((n, None) for n, _ in _BAD_KEYS), ("range", None)], "name, ch", "name, ch::BIGINT AS ch"))
def q_channel_keys(spark, sf):
    rows = [(n, ch) for n, key in _KEYS for ch in channels_of(key, 4)]
    for n, key in [*_BAD_KEYS, ("range", 4)]:
        try:
            channels_of(check_key(key), 4)
        except ValueError:
            rows.append((n, None))
    return spark.createDataFrame(rows, "name string, ch long")


@query("q_choice_log", f"WITH k AS (SELECT unnest(range(0, 9)) AS i) SELECT i, {sql6('sum(power(2.0, -ln(i + 1))) OVER (ORDER BY i) / sum(power(2.0, -ln(i + 1))) OVER ()')} AS upto FROM k")
def q_choice_log(spark, sf):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(draws.log_weights(9))], "i long, upto double").select("i", r6("upto").alias("upto"))


@query("q_choice_log_draws", "WITH k AS (SELECT unnest(range(0, 5)) AS i), w AS (SELECT i, sum(power(2.0, -ln(i + 1))) OVER (ORDER BY i) / sum(power(2.0, -ln(i + 1))) OVER () AS upto FROM k) SELECT vec_id AS case_id, (SELECT count(*) FROM w WHERE i < 4 AND upto <= " + _SHARE.format(6) + ")::INTEGER AS choice FROM embeddings")
def q_choice_log_draws(spark, sf):
    return embeddings(spark, sf).select("case_id", draws.choice_log_column(5, "case_id", seed=6).alias("choice"))


def _seeded() -> list[tuple]:
    rng = np.random.RandomState(11)
    return [(k, float(v)) for k, v in enumerate(rng.random_sample(5))]


@query("q_seeds", _values([*(("generator", k, v) for k, v in _seeded()), ("clone", 0, 21.0), ("clone", 1, 3.0)], "what, k, v", "what, k::BIGINT AS k, v::DOUBLE AS v"))
def q_seeds(spark, sf):
    rows = [("generator", k, float(v)) for k, v in enumerate(draws.generator(11).random_sample(5))]
    copy = RandomIntervalTransformer(n_intervals=3, random_state=5).clone(21)
    return spark.createDataFrame([*rows, ("clone", 0, float(copy.random_state)), ("clone", 1, float(copy.n_intervals))], "what string, k long, v double")


_KINDS = {
    "classifier": "ChannelEnsembleClassifier DummyClassifier FPCAClassifier GRAILClassifier MrSEQLClassifier MrSQMClassifier RandomIntervalClassifier RandomShapeletForestClassifier SupervisedIntervalClassifier TabularClassifier",
    "clusterer": "DummyClusterer TabularClusterer",
    "regressor": "ChannelEnsembleRegressor DummyRegressor FPCARegressor RandomIntervalRegressor RandomShapeletForestRegressor TabularRegressor",
    "transformer": "ARCoefficientTransformer AutocorrelationFunctionTransformer FPCATransformer FunctionTransformer PeriodogramTransformer RandomIntervalTransformer SevenNumberSummaryTransformer SupervisedIntervalTransformer TransformerConcatenator",
}


@query("q_registry", _values([(n, k, k == "transformer", k == "clusterer", True) for k, names in _KINDS.items() for n in names.split()], "name, kind, transforms, clusters, builds").replace("True", "true").replace("False", "false"))
def q_registry(spark, sf):
    """Every operator by name, its predicates, and whether its test parameters build one that can be cloned."""
    rows = []
    for kind in _KINDS:
        for name, cls in all_operators(kind):
            made = cls(**cls.test_params())
            rows.append((name, kind, is_transformer(made), is_clusterer(made), type(made.clone()) is cls))
    return spark.createDataFrame(rows, "name string, kind string, transforms boolean, clusters boolean, builds boolean")


@query("q_n_jobs", _values([("none", 1), ("zero", 1), ("three", 3), ("text", None)], "given, threads", "given, threads::BIGINT AS threads"))
def q_n_jobs(spark, sf):
    rows = [(n, check_n_jobs(v)) for n, v in (("none", None), ("zero", 0), ("three", 3))]
    try:
        check_n_jobs("all")
    except ValueError:
        rows.append(("text", None))
    return spark.createDataFrame(rows, "given string, threads long")


# sources


def _shared(spark) -> str:
    """A new folder below the cluster's checkpoint folder; a temporary one only in a local session without the setting."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="undula-")
    folder = f"{base.rstrip('/')}/undula-{spark.sparkContext.applicationId}-queries"
    there = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = there.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(there)
    store.deleteOnExit(there)  # when the driver ends
    return f"{folder}/{uuid.uuid4().hex}"


@query("q_ts_round_trip", "SELECT dense_rank() OVER (ORDER BY vec_id) - 1 AS case_id, label::VARCHAR AS y, i - 1 AS t, embedding[i]::DOUBLE AS v FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def q_ts_round_trip(spark, sf):
    """Series written as .ts text and read again, value by value."""
    path = _shared(spark)
    write_ts(embeddings(spark, sf).orderBy("case_id"), path)
    rows = read_ts(spark, path)
    return rows.select("case_id", "y", F.posexplode(F.element_at("x", 1)).alias("t", "v")).withColumn("t", F.col("t").cast("long"))


_HEAD = "@problemname p\n@univariate true\n@equallength true\n@serieslength 2\n@classlabel true a b\n@data\n"
#: A file's text, and what is wrong with it (nothing: the number of cases).
_FILES = [
    ("fine", "% note\n# note\n\n" + _HEAD + "1,2:a\n?,4:b\n", "2"),
    ("metadata in capitals", _HEAD.upper() + "1,2:A\n", "1"),
    ("no data", "@problemname p\n@classlabel false\n", "there is no @data tag"),
    ("text before data", "1,2\n@data\n", "line 1 comes before @data but isn't a tag or a comment"),
    ("bad flag", "@univariate yes\n", "@univariate must be true or false"),
    ("bad number", "@serieslength two\n", "@serieslength must be a whole number"),
    ("both labels", "@classlabel true a\n@targetlabel true\n@data\n", "@targetlabel and @classlabel exclude each other"),
    ("no classes", "@classlabel true\n@data\n", "@classlabel true needs the classes"),
    ("no label tag", "@univariate true\n@data\n", "one of @targetlabel and @classlabel is required"),
    ("timestamps", "@timestamps true\n@classlabel false\n@data\n", "timestamps aren't supported"),
    ("two channels of one", _HEAD + "1,2:3,4:a\n", "@univariate is missing or true, but a case has more than one channel"),
    ("wrong dimension", _HEAD.replace("@univariate true", "@univariate false\n@dimension 3") + "1,2:3,4:a\n", "@dimension is 3, but a case has 2 channels"),
    ("wrong length", _HEAD + "1,2,3:a\n", "@serieslength is 2, but a case has a length of 3"),
    ("another channel count", _HEAD.replace("@univariate true", "@univariate false") + "1,2:3,4:a\n1,2:b\n", "a case has 1 channels, 2 are expected"),
    ("another length", _HEAD.replace("@serieslength 2\n", "") + "1,2:a\n1,2,3:b\n", "a case has the lengths [3], 2 is expected"),
    ("unknown class", _HEAD + "1,2:c\n", "unknown class 'c'"),
]


def _said(text: str) -> str:
    lines = text.split("\n")
    try:
        head = parse_header(iter(lines))
        body = [x for x in lines[head.lines :] if x.strip()]
        head = with_first(head, body[0] if body else None)
        return str(len([parse_case(x, head) for x in body]))
    except TsFormatError as fault:
        return str(fault)


@query("q_ts_rules", "SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(n, s.replace("'", "''")) for n, _, s in _FILES) + ") x(name, said)")
def q_ts_rules(spark, sf):
    return spark.createDataFrame([(n, _said(t)) for n, t, _ in _FILES], "name string, said string")


_BUNDLED = [(n, s, 20, c, *(r2 if s == "TEST" else r1), k) for n, (c, r1, r2, k) in bundled.SHAPES.items() for s in ("TRAIN", "TEST")]


@query("q_bundled", _values(_BUNDLED, "name, split, n_cases, n_channels, lo, hi, classes", "name, split, n_cases::BIGINT AS n_cases, n_channels::INTEGER AS n_channels, lo::INTEGER AS lo, hi::INTEGER AS hi, classes::BIGINT AS classes"))
def q_bundled(spark, sf):
    parts = []
    for name in bundled.SHAPES:
        df, lengths = bundled.load(spark, name), F.transform("x", F.size)
        classes = F.countDistinct("y") if bundled.SHAPES[name][3] else F.lit(0).cast("long")
        parts.append(df.groupBy("split").agg(F.count(F.lit(1)).alias("n_cases"), F.max(F.size("x")).alias("n_channels"), F.min(F.array_min(lengths)).alias("lo"), F.max(F.array_max(lengths)).alias("hi"), classes.alias("classes")).withColumn("name", F.lit(name)))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _generated() -> list[tuple]:
    """The recipe of the equal-length generator, value by value."""
    raw = np.random.RandomState(4).uniform(size=(3, 1, 5)) * 2
    rows = []
    for i in range(3):
        first = float(i) if i < 2 else raw[i, 0, 0]
        y = int(first)
        rows += [(i, y, t, float((first if t == 0 else raw[i, 0, t]) * (1 + y))) for t in range(5)]
    return rows


@query("q_generator", _values(_generated(), "case_id, y, t, v", f"case_id::BIGINT AS case_id, y::INTEGER AS y, t::BIGINT AS t, {sql6('v::DOUBLE')} AS v"))
def q_generator(spark, sf):
    rows = generators.equal_length(spark, 3, 1, 5, seed=4)
    return rows.select("case_id", "y", F.posexplode(F.element_at("x", 1)).alias("t", "v")).select("case_id", "y", F.col("t").cast("long").alias("t"), r6("v").alias("v"))


@query("q_stream_windows", f"""WITH w AS (SELECT user_id AS case_id, time_bucket(INTERVAL '1 day', ts) AS day, count(*) AS n, {sql6('avg(value)')} AS mean FROM events GROUP BY ALL)
    SELECT case_id, day::DATE::VARCHAR AS day, n, mean FROM w WHERE day + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)""")
def q_stream_windows(spark, sf):
    """Daily series of a user, from a stream of the events: those whose day has ended, with a summary of each."""
    batch = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    # times without a zone count as UTC, whatever the session's zone is
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    stream = stream.withColumn("ts", F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col("ts").cast("timestamp_ntz"))))
    series = assemble(stream, "user_id", "ts", "value", "1 day")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros("start") / 86_400_000_000).cast("int")).cast("string")
    out = SevenNumberSummaryTransformer().transform(series).select("case_id", day.alias("day"), F.size(F.element_at("x", 1)).cast("long").alias("n"), r6(F.get("features", F.lit(0))).alias("mean"))
    path = _shared(spark)
    run = out.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")
