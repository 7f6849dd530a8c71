import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from undula.llm import toxicity
from undula.llm.lm import discounts

BAD = ["blarg", "snurfle", "grotch"]


def corpus_of(rng, n):
    parts = ["an", "the", "re", "tion", "in", "er", "ou", "sh", "and", "es"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.randint(5, 120))], int(rng.random() < 0.3)
        if toxic:
            for _ in range(2 + len(words) // 40):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "ing", "en", "s"]))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_accuracy(spark, corpus, rng):
    rows, labels = corpus_of(rng, 700)
    got = toxicity.classify(corpus(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [r for r in got if r.held_out]
    assert len(got) == 700 and 90 < len(held) < 190 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    # labels of held-out rows aren't read
    turned = [(i, 1 - t if any(r.doc_id == i for r in held) else t) for i, t in labels]
    again = {r.doc_id: r.score for r in toxicity.classify(corpus(rows), spark.createDataFrame(turned, "doc_id long, toxic int")).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, abs=1e-9) for r in got)


def test_rejection_keeps_rows_whole(spark, corpus, rng):
    rows, labels = corpus_of(rng, 500)
    docs = corpus([(i, t, f"s{i}", i) for i, t in rows], "doc_id long, text string, score string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    left = toxicity.reject(docs, model)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(i for i, s in scores.items() if s < 0.5)


def test_odd_rows(spark, corpus, rng):
    rows, labels = corpus_of(rng, 300)
    rows = rows + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "null"), (5, "repeated")]
    labels = [*labels, (1, None), (None, 1), (2, 0), (2, 0)]
    got = toxicity.classify(corpus(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def by_hand(texts):
    """Evidence of a word's marks under models counted in dictionaries, mark by mark."""
    order, shared = toxicity.ORDER, toxicity.SHARED
    raw = {k: {} for k in range(1, order + 1)}
    for text, c in texts:
        for w in {w.lower() for w in text.split()}:
            marks = [1, *w.encode(), 2]
            for i in range(1, len(marks)):
                gram = tuple(marks[max(0, i - order + 1) : i + 1])
                raw[len(gram)].setdefault(gram, [0, 0])[c] += 1
    tables, above = {}, {}
    for k in range(order, 0, -1):
        table = {g: list(n) for g, n in raw[k].items()}
        for g, n in above.items():
            own = table.setdefault(g[1:], [0, 0])
            for c in (0, 1):
                own[c] += n[c] > 0
        if k == shared:
            table = {g: [sum(n)] * 2 for g, n in table.items()}
        tables[k] = above = table

    def probability(gram, c):
        p = 1 / 256
        for k in range(1, len(gram) + 1):
            table, g = tables[k], gram[-k:]
            n = [sum(v[c] == j for v in tables[k].values()) for j in (1, 2, 3, 4)]
            cut = (0.0, *discounts(*n))
            seen = [v[c] for x, v in table.items() if x[:-1] == g[:-1]]
            if sum(seen):
                own = table.get(g, [0, 0])[c]
                p = (own - cut[min(own, 3)] + sum(cut[min(x, 3)] for x in seen) * p) / sum(seen)
        return p

    def word(w):
        marks = [1, *w.encode(), 2]
        grams = [tuple(marks[max(0, i - order + 1) : i + 1]) for i in range(1, len(marks))]
        return sum(math.log(probability(g, 1)) - math.log(probability(g, 0)) for g in grams)

    return word


def test_models_against_brute_force(rng):
    rows, labels = corpus_of(rng, 60)
    texts = [(t, c) for (_, t), (_, c) in zip(rows, labels, strict=True)]
    batch = pa.RecordBatch.from_pydict({"text": [t for t, _ in texts], "toxic": pa.array([c for _, c in texts], pa.int32())})
    found = pa.Table.from_batches(list(toxicity._count(iter([batch])))).group_by("code").aggregate([("ordinary", "sum"), ("toxic", "sum")]).sort_by("code")
    codes = found["code"].to_numpy().view(np.uint64)
    order = np.argsort(codes)
    model = toxicity.Model(toxicity._levels(codes[order], np.stack([found["ordinary_sum"].to_numpy(), found["toxic_sum"].to_numpy()], 1)[order]))
    word = by_hand(texts)
    for w in ["blarging", "snurf", "the", "tion", "unseen", "é", "a", "grotchs" * 4]:
        data = np.frombuffer(w.encode(), np.uint8)
        grams, _ = toxicity._spelling(data, np.array([0]), np.array([len(data)]))
        assert model.evidence(grams).sum() == pytest.approx(word(w), rel=1e-4, abs=1e-4), w


def test_bounds_of_the_sample(spark, corpus, rng, monkeypatch):
    rows, labels = corpus_of(rng, 400)
    docs, known = corpus(rows).withColumns({c: F.lit(1) for c in ("__id", "same", "size", "toxic", "score")}), spark.createDataFrame(labels, "doc_id long, toxic int")
    size = sum(len(t) for _, t in rows)
    half = toxicity.train(docs, known, sample_bytes=size // 2)
    whole = toxicity.train(docs, known)
    assert 0 < len(half.levels[-1].grams) < len(whole.levels[-1].grams)
    few = toxicity.train(docs, known, sample=100)
    assert 0 < len(few.levels[-1].grams) < len(whole.levels[-1].grams)
    monkeypatch.setattr(toxicity, "LONGEST", 3)
    assert toxicity.train(docs, known).constant == 0.0
    assert toxicity.classify(docs, known).columns == ["doc_id", "held_out", "score", "predicted"]


def test_nothing_to_learn_from(spark, corpus):
    docs = corpus([(i, f"text {i}") for i in range(20)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.classify(docs, none).collect()} == {0.0}
    one = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.classify(docs, one).collect()} == {1.0}
    assert toxicity.classify(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0
