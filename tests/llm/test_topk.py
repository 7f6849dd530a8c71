import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.llm import topk


def brute(queries, rows, k):
    out = []
    for q, v in queries:
        found = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v)))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "equal", "huge", "sparse"])
def test_against_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "PART_VALUES", 1200)
    monkeypatch.setattr(topk, "SEED", 20)
    monkeypatch.setattr(topk, "GROUP", 5)
    gen = np.random.RandomState(3)
    n, d = 600, 8
    m = {"spread": gen.normal(0, 40, (n, d)), "equal": np.repeat(gen.normal(0, 40, (3, d)), n // 3, 0), "huge": gen.normal(0, 2e8, (n, d)), "sparse": gen.normal(0, 40, (n, d)) * (gen.rand(n, d) < 0.2)}[kind].round().astype(int)
    rows = [(i, m[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.top_k(df.where("vec_id % 50 = 0"), df, 5)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute(rows[::50], rows, 5)


def test_processing_stops_early():
    gen = np.random.RandomState(0)
    centers = gen.normal(0, 60, (10, 32))
    data = (centers[gen.randint(0, 10, 3000)] + gen.normal(0, 8, (3000, 32))).astype(np.int64)
    block = topk.Block(np.arange(3000), data, topk._kind(data, data))
    assert topk._kind(data, data) is np.float32 and topk._kind(data * 10**3, data) is np.float64 and topk._kind(data * 10**8, data * 10**8) is np.int64
    exact = data @ data[:20].T
    least = np.sort(exact[:500], axis=0)[-5].astype(float)
    q, v, score = block.search(data[:20], least)
    assert len(q) < 20 * 3000 / 4  # few members are possible, and the true ones are among them
    assert (score == exact[v, q]).all()
    for i in range(20):
        assert set(np.sort(exact[:, i])[-5:]) <= set(exact[v[q == i], i])


def test_repeated_ids_and_rows(spark):
    """A query doesn't find its own row, but other rows with its id; a row that occurs twice is answered twice."""
    rows = [(50, [2, 1]), (50, [2, 1]), (50, [3, 0]), (7, [1, 1])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").withColumn("dims", F.lit(9)).withColumn("score", F.lit("x"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df.where("vec_id % 50 = 0"), df, 2).collect())
    want = []
    for i, (q, v) in enumerate(rows):
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), w_id) for j, (w_id, w) in enumerate(rows) if j != i)[:2]
            want += [(q, r, w_id, -s) for r, (s, w_id) in enumerate(found, 1)]
    assert got == sorted(want)


def test_odd_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], "x"), (1, [0.5, None], "x"), (2, None, "x"), (3, [float("nan"), 1.0], "x"), (4, [float("inf"), 1.0], "x"), (5, [-0.001, 1.0], "x"), (None, [9.0, 9.0], "x"), (6, [1.0], "x"), (7, [], "x"), (5, [-0.001, 1.0], "x")], "vec_id long, embedding array<float>, score string")
    rows = df.select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    assert {r.vec_id: r.v for r in rows.where("v is not null").collect()} == {0: [256, 512], 5: [-1, 256], None: [2304, 2304], 6: [256], 7: []}
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(rows.where("vec_id % 50 = 0"), rows, 5).collect())
    assert got == [(0, 1, 5, -256 + 512 * 256), (0, 2, 5, -256 + 512 * 256)]
    assert topk.top_k(rows.where("false"), rows).count() == 0 and topk.top_k(rows, rows.where("false")).count() == 0
