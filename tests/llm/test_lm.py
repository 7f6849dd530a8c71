import collections
import math
import zlib

import numpy as np
import pytest

from tests.llm.conftest import ODD
from undula.llm import kernels, lm


def words(text):
    return (text or "").encode().lower().split()


def brute(rows, parts=7, held=2):
    """Scores by dictionaries."""
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % parts
    train = [[*words(t), None] for i, t in rows if fold(i) != held]
    c = collections.Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    pairs = collections.Counter(p for w in train for p in zip(["<s>", *w], w, strict=False))
    of = lambda counts: lm.discounts(*(collections.Counter(counts.values())[k] for k in (1, 2, 3, 4)))
    ends = collections.Counter(b for _, b in pairs)
    d, e = of(pairs), of(ends)
    cut = lambda k, by: by[min(k, 3) - 1] if k else 0.0
    rest = sum(cut(k, e) for k in ends.values()) / len(pairs) if pairs else 1.0
    total, left = collections.Counter(), collections.Counter()
    for (a, _), k in pairs.items():
        total[a] += k
        left[a] += cut(k, d)

    def p(a, b):
        low = (ends[b] - cut(ends[b], e)) / max(1, len(pairs)) + rest / (v + 1)
        return (pairs[a, b] - cut(pairs[a, b], d) + left[a] * low) / total[a] if total[a] else low

    out = []
    for i, t in rows:
        w = [*words(t), None]
        out.append((i, fold(i) == held, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w], w, strict=False))))
    return out


@pytest.mark.parametrize(("parts", "wide"), [(1, 4096), (5, 4096), (7, 2)])
def test_against_brute_force(corpus, rng, monkeypatch, parts, wide):
    """One bucket, several, and several that are dealt to in two rounds."""
    monkeypatch.setattr(kernels, "WIDE", wide)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 40)))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "w1 w2 new"), (5, "w1 w1 w1")]
    got = sorted(lm.score_held_out(corpus(rows, parts=parts)).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_tokens, r.score))
    want = sorted(brute(rows), key=lambda r: (r[0] is None, r[0], r[2], r[6]))
    for r, w in zip(got, want, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5]
        assert r.base_score == pytest.approx(w[5]) and r.score == pytest.approx(w[6])
        assert r.perplexity == pytest.approx(10 ** (-w[6] / w[2]))


def test_frequent_pairs_and_flushes(corpus, monkeypatch):
    rows = [(i, "a b " * 200) for i in range(40)] + [(100 + i, f"x{i} y{i}") for i in range(200)]
    got = {r.doc_id: r.score for r in lm.score_held_out(corpus(rows)).collect()}
    want = {r[0]: r[6] for r in brute(rows)}
    assert all(got[i] == pytest.approx(want[i]) for i in want)


def test_nothing_to_learn_from(spark, corpus):
    assert lm.score_held_out(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm.score_held_out(corpus([(held, "only held out")])).first()
    assert (row.train_tokens, row.n_known, row.n_tokens, row.held_out) == (0, 0, 4, True) and row.score == 0.0


def test_kernels(monkeypatch):
    import pyarrow as pa

    texts = ["Ab  cd\tab", "", None, "été AB", "x" * 500, " lead trail "]
    data, offsets = kernels.buffer_of(pa.array(texts))
    for chunk in (1 << 20, 7):
        monkeypatch.setattr(kernels, "CHUNK", chunk)
        hashes, first, length, counts = kernels.words(data, offsets)
        assert counts.tolist() == [len(words(t)) for t in texts]
        found = [bytes(data[f : f + n]).lower() for f, n in zip(first, length, strict=True)]
        assert found == [w for t in texts for w in words(t)]
        assert len({*hashes.tolist()}) == len({*found}) and hashes[0] == hashes[2]
    keys = np.sort(np.random.RandomState(0).randint(0, 2**63, 1000).astype(np.uint64))
    assert (kernels.unpack(kernels.pack(keys), 1000) == keys).all()
    assert kernels.unpack_small(kernels.pack_small(np.array([1, 70000])), 2).tolist() == [1, 70000]
    assert list(kernels.pieces(pa.array(["aaaa", "bb", "c" * 50, "d"]), 6)) == [(0, 2), (2, 3), (3, 4)]


def test_words_that_a_polynomial_confuses(corpus):
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(i, word if i % 7 else f"{word} {other}") for i in range(20)]
    rows = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 and other not in t] + [(2000, other)]
    held = next(i for i in range(3000, 4000) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows[-1] = (held, other)
    got = {r.doc_id: r.n_known for r in lm.score_held_out(corpus(rows)).collect()}
    assert got[held] == 1  # only the end is known


def test_clashing_columns(corpus):
    from pyspark.sql import functions as F

    docs = corpus([(i, f"a b {i}") for i in range(20)])
    odd = docs.withColumns({c: F.lit(1) for c in ("bucket", "n", "keys", "counts", "score", "held_out", "n_tokens")})
    assert sorted(lm.score_held_out(odd).collect()) == sorted(lm.score_held_out(docs).collect())
