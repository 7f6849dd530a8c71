import hashlib
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import ODD
from undula.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
REFERENCE = Tokenizer.from_file(PATH)
CODER = bpe.Coder(bpe.Vocabulary.load(PATH))


def expected(text):
    ids = REFERENCE.encode(text or "", add_special_tokens=False).ids
    return ids, REFERENCE.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x24F) | st.sampled_from("abehinot' Σ́가"), max_size=40), max_size=5))
def test_same_as_the_library(texts):
    for text, (ids, decoded, n) in zip(texts, CODER.encode_batch(texts), strict=True):
        want, back = expected(text)
        assert np.frombuffer(ids, "<u4").tolist() == want and decoded == back == CODER.decode(ids) and n == len(want)


def test_every_character():
    """Every code point, alone, within a word and with marks on it, is encoded as by the library."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    marks = [c for a, b in bpe.LATE_MARKS for c in range(a, b + 1)]
    texts = ["".join(f"a{chr(c)}b {chr(c)} " for c in points[k : k + 64]) for k in range(0, len(points), 64)]
    texts += [f"q{chr(a)}{chr(b)}{chr(c)} " for a in marks for b in (0x301, 0x323, 0x334, 0x345) for c in (a, 0x327)]
    texts += [f"q{chr(b)}{chr(a)}" for a in marks for b in (0x301, 0x323, 0x334, 0x345)] + ["\U00011935\U00011930 \U00011938\u0301"]
    texts += [unicodedata.normalize("NFD", chr(c)) + "\u0323" for c in points if unicodedata.decomposition(chr(c))]
    for k in range(0, len(texts), 512):
        part = texts[k : k + 512]
        for text, (ids, _, _), want in zip(part, CODER.encode_batch(part), REFERENCE.encode_batch(part, add_special_tokens=False), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == want.ids, ascii(text)


def test_failing_pairs_are_found():
    words = ["".join(w) for w in (("th", "an", "d"), ("in", "g", "er"), ("unt", "ion"), ("aa",) * 9, ("banana",), ("antidis",))]
    coder = bpe.Coder(bpe.Vocabulary.load(PATH))
    list(coder.encode_batch([" ".join(words)]))
    assert 0 <= coder.failed < len(words)
    # a verified guess and an exact merge agree wherever both exist
    for w in words:
        spelt = "".join(coder.letters[b] for b in w.encode())
        exact = coder._exact([*(coder.ids[c] for c in spelt[:-1]), coder.ids[spelt[-1] + coder.end]])
        assert np.frombuffer(coder.cache[w], "<u4").tolist() == exact


def test_long_texts_are_cut_at_blanks(monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 50)
    text = "It's a test, été  <|endoftext|> " * 40 + "x" * 300
    assert "".join(bpe.cut(text)) == text and len(bpe.cut(text)) > 5
    coder = bpe.Coder(bpe.Vocabulary.load(PATH))
    (ids, decoded, _), *_ = coder.encode_batch([text])
    assert (np.frombuffer(ids, "<u4").tolist(), decoded) == expected(text)


def test_small_caches_forget_but_stay_right(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    coder = bpe.Coder(bpe.Vocabulary.load(PATH))
    texts = [" ".join(f"word{i} <|endoftext|> w{i}" for i in range(k, k + 9)) for k in range(6)]
    for _ in range(2):
        for text, (ids, decoded, _) in zip(texts, coder.encode_batch(texts), strict=True):
            assert (np.frombuffer(ids, "<u4").tolist(), decoded) == expected(text)


@pytest.mark.parametrize("digests", [True, False])
def test_operator(spark, corpus, digests):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "null id", "x"), (3, "again", "x")]
    docs = corpus(rows, "doc_id long, text string, ids string")
    out = bpe.encode(docs, PATH, digests_only=digests)
    got = sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_tokens))
    want = sorted(((i, *expected(t)) for i, t, _ in rows), key=lambda r: (r[0] is None, r[0], len(r[1])))
    for r, (i, ids, decoded) in zip(got, want, strict=True):
        assert r.doc_id == i and r.n_tokens == len(ids)
        if digests:
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
        else:
            assert list(r.ids) == ids and r.decoded == decoded
    if not digests:
        back = bpe.decode(out.select("doc_id", "ids", "decoded").withColumnRenamed("decoded", "want"), PATH)
        assert back.where("decoded <> want").count() == 0
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH, digests_only=digests).count() == 0
