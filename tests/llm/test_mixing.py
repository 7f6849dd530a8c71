import hashlib
import math

import pytest
from pyspark.sql import functions as F

from undula.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def make(corpus, sizes, rng):
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join(["w"] * rng.randint(1, 9)), source))
            i += 1
    return corpus(rows, SCHEMA), rows


def tokens(rows, source):
    return sum(len(t.split()) for _, t, s in rows if s == source)


def test_repetition_limit(corpus, rng):
    docs, rows = make(corpus, {"big": 900, "mid": 200, "small": 30, None: 10}, rng)
    out = mixing.mix(docs, max_passes=3.0).cache()
    total = {s: tokens(rows, s) for s in ("big", "mid", "small", None)}
    got = {r.source: r for r in out.groupBy("source").agg(F.sum("_tokens").alias("n"), F.max("_pass").alias("p"), F.first("_weight").alias("w"), F.countDistinct("doc_id").alias("d")).collect()}
    assert got["big"].n == total["big"] and got["big"].p == 0
    # the least source meets the limit; the exponent that does so has a closed form
    alpha = 1 - math.log(3) / math.log(total["big"] / total[None])
    scale = sum((t / sum(total.values())) ** alpha for t in total.values())
    for s, t in total.items():
        passes = (total["big"] / t) ** (1 - alpha)
        assert got[s].w == pytest.approx((t / sum(total.values())) ** alpha / scale, rel=1e-6)
        assert abs(got[s].n - passes * t) <= 9 + 1e-6 * t  # the budget ends inside one document
        assert got[s].d == sum(1 for r in rows if r[2] == s)  # every document once at least
    # passes come in turn: a document's copies are numbered without gaps
    assert out.groupBy("doc_id").agg(F.max("_pass").alias("p"), F.count("*").alias("n")).where("n <> p + 1").count() == 0
    assert out.where("_position < 0 or _position > 1").count() == 0


def test_entropy_and_budget(corpus, rng):
    docs, rows = make(corpus, {"a": 400, "b": 100, "c": 20}, rng)
    totals = docs.groupBy("source").agg(F.sum(mixing.tokens_of(F.col("text"))).alias("tokens"))
    t = mixing.temperature(totals, entropy=1.0)
    assert t.entropy == pytest.approx(1.0, abs=1e-6) and 0 < t.exponent < 1
    assert mixing.temperature(totals, entropy=5.0).exponent == 0.0  # cannot be reached: as even as can be
    assert mixing.temperature(totals, entropy=0.0).exponent == 1.0
    out = mixing.mix(docs, max_passes=None, entropy=1.0, budget=500)
    n = out.agg(F.sum("_tokens")).first()[0]
    assert abs(n - 500) <= 27
    # any prefix by position holds the sources by their weights
    half = {r.source: r.n for r in out.where("_position <= 0.5").groupBy("source").agg(F.sum("_tokens").alias("n")).collect()}
    assert half["a"] > half["b"] > 0


def test_same_mix_however_it_is_read(corpus, rng):
    docs, _ = make(corpus, {"a": 120, "b": 40}, rng)
    one = sorted((r.doc_id, r._pass, r._position) for r in mixing.mix(docs, max_passes=1.7).collect())
    assert one == sorted((r.doc_id, r._pass, r._position) for r in mixing.mix(docs.repartition(7), max_passes=1.7).collect())


def test_odd_rows(spark, corpus):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, "a"), (2, "", "a"), (None, "w w", "b"), (3, "w", "b"), (3, "w", "b"), (4, "w " * 5000, "c")]
    out = mixing.mix(corpus(rows, SCHEMA), max_passes=2.0)
    assert out.where("source = 'a'").count() == 2 and out.where("doc_id = 4").count() == 1 and out.select("doc_id").distinct().count() == 5
    with pytest.raises(ValueError, match="either"):
        mixing.mix(corpus(rows, SCHEMA), max_passes=2.0, entropy=1.0)


def test_names_that_are_taken(corpus, rng):
    docs, _ = make(corpus, {"a": 60, "b": 20}, rng)
    taken = ["_pass", "__block", "__key", "_weight", "__passes", "id", "tokens", "key"]
    odd = docs.withColumns({c: F.lit(c) for c in taken})
    out = mixing.mix(odd, max_passes=1.7)
    assert out.columns == [*odd.columns, "__weight", "_tokens", "__pass", "_position"]
    assert {tuple(r[c] for c in taken) for r in out.collect()} == {tuple(taken)}
    plain = mixing.mix(docs, max_passes=1.7)
    assert sorted((r.doc_id, r["__pass"], r._position) for r in out.collect()) == sorted((r.doc_id, r._pass, r._position) for r in plain.collect())


def by_hand(rows, most, blocks):
    """(doc_id, pass) of every row of the mix, by sorting and adding up."""

    def order(*parts):
        return int(hashlib.md5("|".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:15], 16)

    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    high, low = max(size.values()), min(n for n in size.values() if n)
    e = max(0.0, 1 - math.log(most) / math.log(high / low)) if high > low else 0.0
    out = []
    for s, n in size.items():
        key, own = "\0null" if s is None else s, [r for r in rows if r[2] == s]
        exact = (high / n) ** (1 - e) if n else 1.0
        whole = round(exact) if abs(exact - round(exact)) < 1e-6 else int(exact)
        out += [(i, k) for i, _, _ in own for k in range(whole)]
        left = (exact - whole) * n
        if left > 1e-6 * n:
            ids = sorted({i for i, _, _ in own}, key=lambda i: (order(key, whole, order("block", i) % blocks), order(i, whole)))
            for i in ids:
                same = [r for r in own if r[0] == i]
                if left <= 0:
                    break
                out += [(i, whole)] * len(same)
                left -= sum(len((t or "").split()) for _, t, _ in same)
    return sorted(out, key=str)


def test_against_brute_force(corpus, rng, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 16)
    docs, rows = make(corpus, {"big": 300, "mid": 110, "less": 47, "small": 9, None: 30}, rng)
    rows = [*rows, (5000, None, "mid"), (5001, "", "void"), (3, "w w w", "less"), (470, "w", "less"), (470, "w w", "less"), (None, "w", "small")]
    out = mixing.mix(corpus(rows, SCHEMA, name="all"), max_passes=2.5)
    assert sorted(((r.doc_id, r._pass) for r in out.collect()), key=str) == by_hand(rows, 2.5, 16)
