import hashlib

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from undula.llm.exact_dedup import drop_copies, exact_dedup


def low(text):
    return (text or "").encode().lower()


def brute(rows, largest=True):
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    pick = max if largest else min
    return sorted((i, pick(groups[low(t)]), len(groups[low(t)]), i == pick(groups[low(t)]), hashlib.sha256(low(t)).hexdigest()) for i, t in rows)


@pytest.mark.parametrize(("parts", "fan_in", "keep"), [(1, 16, "largest"), (7, 2, "smallest"), (9, 3, "largest"), (20, 16, "largest")])
def test_against_brute_force(corpus, rng, parts, fan_in, keep):
    words = ["alpha", "Beta", "GAMMA"]
    rows = [(i, "hot" if i % 3 == 0 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 3)))) for i in range(400)] + [(1000 + i, t) for i, t in enumerate(ODD)]
    got = exact_dedup(corpus(rows, parts=parts), keep, fan_in).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == brute(rows, keep == "largest")


def test_ties_nulls_and_empty_tables(spark, corpus):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "B"), (2, "c"), (2, "d"), (3, "D")]
    found = exact_dedup(corpus(rows)).collect()
    by = {}
    for r in found:
        by.setdefault((r.text_sha256, r.kept), []).append(r)
    assert len(found) == 8
    assert {r.keep_id for r in found if r.text_sha256 == hashlib.sha256(b"a").hexdigest()} == {1}
    assert sum(r.kept for r in found) == 4 and all(len(v) == 1 for (_, kept), v in by.items() if kept)
    kept = sorted((r.doc_id or 0, r.text.lower()) for r in drop_copies(corpus(rows)).collect())
    assert kept == [(0, "b"), (1, "a"), (2, "c"), (3, "d")]
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert drop_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_columns_with_clashing_names_stay(corpus):
    rows = [(1, "x", 5, "s"), (2, "X", 6, "t"), (3, "y", 7, "u")]
    docs = corpus(rows, "doc_id long, text string, digest int, keep_id string")
    out = drop_copies(docs)
    assert out.columns == docs.columns and sorted(tuple(r) for r in out.collect()) == [(2, "X", 6, "t"), (3, "y", 7, "u")]
    assert out.agg(F.sum("digest")).first()[0] == 13
    with pytest.raises(ValueError, match="keep"):
        exact_dedup(docs, "newest")
