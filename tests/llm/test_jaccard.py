import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from undula.llm import jaccard, kernels
from undula.llm.components import components


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def edited(rng, words, vocabulary, times):
    words = list(words)
    for _ in range(times):
        i, kind = rng.randrange(len(words)), rng.random()
        if kind < 0.4:
            words[i] = rng.choice(vocabulary)
        elif kind < 0.7 and len(words) > 1:
            del words[i]
        else:
            words.insert(i, rng.choice(vocabulary))
    return words


def check(docs, rows):
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_components(docs).collect()) == brute(rows)


def test_near_copies_of_all_sizes(corpus, rng):
    vocabulary, texts = [f"w{i}" for i in range(300)], list(ODD)
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 6, 8, 12, 20, 50, 120]))]
        texts += [" ".join(edited(rng, base, vocabulary, rng.randint(0, len(base) // 40 + 1))) for _ in range(rng.choice([1, 2, 4, 15]))]
    rows = list(enumerate(texts))
    check(corpus(rows), rows)


@pytest.mark.parametrize(("cell", "wide"), [(512, 4096), (16, 3)])
def test_common_passage_large_group_and_chain(corpus, rng, monkeypatch, cell, wide):
    """Groups of one block and of several; signatures dealt at once and in two rounds."""
    monkeypatch.setattr(jaccard, "CELL", cell)
    monkeypatch.setattr(kernels, "WIDE", wide)
    vocabulary = [f"w{i}" for i in range(300)]
    passage, base, texts = [rng.choice(vocabulary) for _ in range(60)], [rng.choice(vocabulary) for _ in range(100)], []
    for _ in range(150):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))]
        k = rng.randrange(len(own))
        texts.append(" ".join(own[:k] + passage + own[k:]))
    texts += [" ".join(edited(rng, base, vocabulary, rng.randint(0, 5))) for _ in range(120)]
    for _ in range(30):
        base = edited(rng, base, vocabulary, 1)
        texts.append(" ".join(base))
    rows = list(enumerate(texts))
    check(corpus(rows, parts=5), rows)


def test_signatures_keep_their_promise(rng):
    """Linked sets share a signature, and as many segments as the slack says."""
    import numpy as np

    gen = np.random.RandomState(0)
    for _ in range(300):
        n = int(gen.choice([1, 2, 4, 7, 9, 15, 30, 40, 90, 300, 1500]))
        s = np.unique(gen.randint(0, 2**63, n).astype(np.uint64))
        drop = gen.randint(0, max(1, len(s) // 9) + 1)
        t = np.unique(np.concatenate([s[gen.permutation(len(s))[drop:]], gen.randint(0, 2**63, gen.randint(0, max(1, len(s) // 9) + 1)).astype(np.uint64)]))
        both = len(np.intersect1d(s, t))
        if not len(t) or 5 * both < 4 * (len(s) + len(t) - both):
            continue
        one, two = jaccard.signatures(s), jaccard.signatures(t)
        shared = [(len(np.intersect1d(a, b)), r >> 1, q >> 1) for a, r in one for b, q in two if not r & q & 1]
        assert any(k >= max(1, r, q) for k, r, q in shared), (len(s), len(t))
        d = np.bitwise_count(np.frombuffer(jaccard._sketch(s), np.uint8) ^ np.frombuffer(jaccard._sketch(t), np.uint8)).sum()
        assert d <= len(s) + len(t) - 2 * both
    for low, high in jaccard.bands()[:40]:
        assert jaccard.bands()[jaccard.band_of(low)] == jaccard.bands()[jaccard.band_of(high)] == (low, high)


def test_odd_rows(spark, corpus):
    docs = corpus([(1, "a b c d e f", 1), (None, "a b c d e f", 2), (2, None, 3), (3, "", 4), (4, "A B C D E F", 5), (4, "other words are here now", 6)], "doc_id long, text string, label int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_components(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1), (None, 2, 1), (2, 0, 2), (3, 0, 3), (4, 2, 1), (4, 1, 4)], key=str)
    kept = jaccard.drop_near(corpus([(1, "a b c d e f", 1), (2, "A B C D E F", 2), (3, "z", 3), (None, "z", 4)], "doc_id long, text string, n int", name="b"))
    assert kept.columns == ["doc_id", "text", "n"] and {r.n for r in kept.collect()} >= {1, 3} and kept.where("n = 2").count() == 0
    assert jaccard.near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_row_of_each_component_stays_where_ids_repeat(corpus):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [
        (1, near, 1),
        (2, near + " end", 2),  # a near copy of 1
        (2, "an unrelated clean text that shares its id", 3),
        (3, "one two three four five six", 4),
        (3, "ONE two three four five six", 5),  # near copies that share an id
        (None, "red green blue black white grey", 6),
        (None, "RED green blue black white grey", 7),  # near copies with null ids
        (None, near, 8),
        (None, "nobody else has this text here", 9),
        (5, "one two three four five six", 10),
        (6, None, 11),
        (6, "", 12),
    ]
    kept = {r.n for r in jaccard.drop_near(corpus(rows, "doc_id long, text string, n int")).collect()}
    assert kept == {1, 3, 5, 7, 9, 11, 12}  # of equal sets, the smallest text: capitals come first


def test_unlike_words_and_sets(corpus):
    """Words that a polynomial modulo 2^64 can't tell apart; documents that share no word."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, " ".join([word] * 6)), (4, " ".join([other] * 6)), (5, word.upper())]
    check(corpus(rows), rows)


def test_clashing_columns_and_repeated_rows(corpus):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(1, near, "x", 1), (2, near + " end", "y", 2), (3, "quite another text", "z", 3), (3, "quite another text", "z", 4), (None, near, None, 5)]
    docs = corpus(rows, "doc_id long, text string, __id string, __class long").withColumns({c: F.lit(7) for c in ("__row", "__kept_class", "__component", "class", "component_id", "label", "sig", "n")})
    kept = jaccard.drop_near(docs)
    assert kept.columns == docs.columns and sorted(r["__class"] for r in kept.collect())[:1] == [1] and kept.count() == 2
    clear = docs.where("doc_id < 3")
    assert [r["__id"] for r in jaccard.drop_near(clear).collect()] == ["x"]
    got = jaccard.near_components(docs).collect()
    assert sorted((r.component_id for r in got), key=str) == [1, 1, 1, 3, 3]


def test_a_doc_id_that_many_texts_share(corpus, rng):
    """Copies among texts of one id, and among texts without any, are found."""
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(90)]
    rows = [(key, " ".join(edited(rng, base, vocabulary, 1))) for key in (7, None) for _ in range(40)] + [(8, " ".join(base))] * 3
    got = jaccard.near_components(corpus(rows)).collect()
    assert len(got) == 83 and {r.component_id for r in got} == {7}
    assert jaccard.drop_near(corpus(rows, name="dropped")).count() == 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300), (7, 3)]
    labels = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {labels[i] for i in range(61)} == {0} and {labels[i] for i in (100, 200, 300)} == {100}


