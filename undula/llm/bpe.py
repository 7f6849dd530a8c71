"""Byte-pair encoding by speculation and verification, and decoding.

Greedy longest match proposes tokens for a word. A sequence of tokens is what the
ranked merges give exactly if each adjacent pair of it is, so all pairs of all new
words are tested at once in whole-array steps: a pair fails if, when its last merges
are undone step by step towards the border, some merge across the border has a lower
rank than those undone. Only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.kernels import releasing

#: Words remembered by a worker, and as many of the time before.
CACHE_WORDS = 200_000
#: Characters after which a text is cut before the next word.
PIECE = 1 << 20
_NONE = np.int64(1 << 40)
_LAST = (1 << 40, -1)
#: White space as Unicode has it, for use in a class of characters.
_BLANKS = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and numbers that Unicode 16 has and 15.1, the interpreter's, hasn't.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: Capitals that Unicode 17 has and 15.1 hasn't: (first, last, first small one).
NEW_CAPITALS = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
#: Marks later than Unicode 9. Composition follows that version, so they neither move nor combine.
LATE_MARKS = [
    (0x07FD, 0x07FD), (0x0898, 0x089F), (0x08CA, 0x08D3), (0x09FE, 0x09FE), (0x0C3C, 0x0C3C), (0x0D3B, 0x0D3C), (0x0EBA, 0x0EBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE),
    (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070),
    (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x11938, 0x11938), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34),
    (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F),
    (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
]
#: Up to here all versions of Unicode agree on letters and digits.
_BEYOND = re.compile("[^\x00-\u024f]").search
_SAFE = regex.compile("[ \\n](?=[A-Za-z])").search


@dataclass(frozen=True)
class Vocabulary:
    """What a tokenizer file of the "word ends" kind states, as plain values."""

    tokens: dict[str, int]
    merges: list[tuple[str, str]]
    added: dict[str, int]
    pattern: str
    end: str

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]] + [x["type"] for x in steps]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] or spec["decoder"]:
            raise ValueError("a tokenizer of another kind")
        return Vocabulary(model["vocab"], [tuple(m) for m in model["merges"]], {x["content"]: x["id"] for x in spec["added_tokens"]}, steps[0]["pattern"]["Regex"], model["end_of_word_suffix"] or "")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 ones for themselves, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


def _ranges(spans: list[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


def _class_of(kind: str) -> str:
    """Ranges of the characters of a general category, by the interpreter's tables and what is new since."""
    member = [unicodedata.category(chr(i))[0] == kind for i in range(0x110000)] + [False]
    edges = [i for i in range(0x110001) if member[i] != member[i - 1]]
    return _ranges([(a, b - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]) + _ranges(NEW_LETTERS if kind == "L" else NEW_NUMBERS)


_CAPITALS = {a + i: b + i for a, last, b in NEW_CAPITALS for i in range(last - a + 1)}
_HAS_CAPITALS = re.compile(f"[{_ranges([(a, b) for a, b, _ in NEW_CAPITALS])}]").search
_MARKS = re.compile(f"([{_ranges(LATE_MARKS)}])")


def normalise(text: str) -> str:
    """Canonical composition and lower case, letter by letter (no final form of sigma), as the library does them."""
    if not _BEYOND(text):
        return unicodedata.normalize("NFC", text).lower()
    if _MARKS.search(text):  # each half is composed on its own
        text = "".join(x if i % 2 else unicodedata.normalize("NFC", x) for i, x in enumerate(_MARKS.split(text)))
    else:
        text = unicodedata.normalize("NFC", text)
    if _HAS_CAPITALS(text):
        text = text.translate(_CAPITALS)
    return text.replace("\u03a3", "\u03c3").lower()


def cut(text: str) -> list[str]:
    """Pieces of a text whose encodings, one after another, are the text's.

    Cuts are made before an ASCII blank that an ASCII letter follows: no word, no
    added token and no composed character reaches over it.
    """
    out, at = [], 0
    while len(text) - at > PIECE and (found := _SAFE(text, at + PIECE)):
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]] if at < len(text) else out


class Coder:
    """Encodes and decodes texts; built once a worker."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.letters, self.end, self.ids = byte_letters(), v.end, v.tokens
        self.names = {i: t for t, i in v.tokens.items()} | {i: t for t, i in v.added.items()}
        self.added = v.added
        plain, exact = v.pattern, v.pattern
        for name in "LN":
            exact = exact.replace(f"\\p{{{name}}}", _class_of(name))
        self.find_words = regex.compile(plain).findall
        self.find_words_beyond = re.compile(exact.replace("\\s", _BLANKS)).findall
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(v.added, key=len, reverse=True))) + ")").split if v.added else lambda x: [x]
        n = max(v.tokens.values()) + 1
        self.left, self.right, self.rank = np.full(n, -1), np.full(n, -1), np.full(n, _NONE)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(v.merges):
            i, j, k = v.tokens[a], v.tokens[b], v.tokens[a + b]
            self.merge.setdefault((i, j), (rank, k))
            if self.left[k] < 0:
                self.left[k], self.right[k], self.rank[k] = i, j, rank
        pairs = sorted((i << 32 | j, r) for (i, j), (r, _) in self.merge.items())
        self.pair_keys, self.pair_ranks = np.array([p for p, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64)
        # greedy matching may only use tokens that their own merges yield
        self.inner = {t: i for t, i in v.tokens.items() if self._whole(t)}
        self.reach: dict[str, int] = {}  # longest token by its first two letters
        for t in self.inner:
            self.reach[t[:2]] = max(self.reach.get(t[:2], 1), len(t))
        self.name_list = [self.names.get(i, "") for i in range(max(self.names) + 1)]
        self.cache: dict[str, bytes] = {}  # ids as little-endian 32-bit integers
        self.older: dict[str, bytes] = {}

    def _whole(self, token: str) -> bool:
        return len(self._exact(self._symbols_of(token))) == 1

    def _symbols_of(self, token: str) -> list[int]:
        ended = bool(self.end) and token.endswith(self.end) and token != self.end
        chars = list(token[: -len(self.end)] if ended else token)
        if ended:
            chars[-1] += self.end
        return [self.ids[c] for c in chars if c in self.ids]

    def _exact(self, ids: list[int]) -> list[int]:
        """Apply merges in the order of rank, then from the left."""
        if len(ids) < 2:
            return ids
        get = self.merge.get
        if len(ids) <= 24:  # a scan is faster than a heap
            ids = list(ids)
            found = [get(x, _LAST) for x in zip(ids, ids[1:])]
            while found:
                best = min(found)
                if best is _LAST:
                    break
                i = found.index(best)
                ids[i : i + 2] = [best[1]]
                del found[i]
                if i:
                    found[i - 1] = get((ids[i - 1], ids[i]), _LAST)
                if i < len(found):
                    found[i] = get((ids[i], ids[i + 1]), _LAST)
            return ids
        after, before, live = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)], [True] * len(ids)
        ids, heap = list(ids), []
        for i in range(len(ids) - 1):
            if m := self.merge.get((ids[i], ids[i + 1])):
                heappush(heap, (m[0], i, m[1], ids[i], ids[i + 1]))
        while heap:
            _, i, new, a, b = heappop(heap)
            j = after[i]
            if not live[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j], after[i] = new, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := self.merge.get((ids[x], ids[y]))):
                    heappush(heap, (m[0], x, m[1], ids[x], ids[y]))
        return [t for t, alive in zip(ids, live, strict=True) if alive]

    def _greedy(self, word: str) -> list[int]:
        """Longest tokens from the left; the last one carries the word's end."""
        out, at, n, get, reach, end = [], 0, len(word), self.inner.get, self.reach.get, self.end
        while at < n:
            stop = at + reach(word[at : at + 2], 1)
            if stop >= n:
                found = get(word[at:] + end)
                if found is not None:
                    out.append(found)
                    return out
                stop = n - 1
            found = get(word[at:stop])
            while found is None:
                stop -= 1
                if stop <= at:
                    raise ValueError("the vocabulary lacks a byte")
                found = get(word[at:stop])
            out.append(found)
            at = stop
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether merging their joint bytes yields the pair.

        The merges that built a and b are undone from the latest on, on the border
        side. At each state the two parts that touch must not merge at a rank below
        that of the undone merges: it would have come first. A merge of the same
        rank on the left side of the border comes first, on its right side later.
        """
        good, at = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), _NONE)
        while len(at):
            key = (a << 32) | b
            place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[place] == key, self.pair_ranks[place], _NONE)
            bad = rank < limit
            good[at[bad]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            go = ~bad & ((rank_a < _NONE) | (rank_b < _NONE))
            a, b, at, rank_a, rank_b = a[go], b[go], at[go], rank_a[go], rank_b[go]
            # undo the later merge; of equal ranks, the right one is made later
            from_a = (rank_a < _NONE) & ((rank_b == _NONE) | (rank_a > rank_b))
            limit = np.where(from_a, rank_a, rank_b + 1)
            a, b = np.where(from_a, self.right[a], a), np.where(from_a, b, self.left[b])
        return good

    def learn(self, words: list[str]) -> None:
        """Encode new words into the cache."""
        # printable ASCII stands for itself
        spelt = [w if w.isascii() and w.isprintable() else "".join([self.letters[x] for x in w.encode()]) for w in words]
        guess = [self._greedy(s) for s in spelt]
        counts = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter((t for g in guess for t in g), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(guess)), counts)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        failing = {*owner[inside[~self.compatible(flat[inside], flat[inside + 1])]].tolist()}
        self.failed = len(failing)
        packed, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        ids_of, cache, start = self.ids, self.cache, 0
        for i, (word, end) in enumerate(zip(words, ends, strict=True)):
            if i in failing:
                s = spelt[i]
                ids = self._exact([*map(ids_of.__getitem__, s[:-1]), ids_of[s[-1] + self.end]])
                cache[word] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                cache[word] = packed[start:end]
            start = end

    def words_of(self, text: str) -> list[str]:
        """Pre-tokenised words; added tokens are words of their own, marked by a leading NUL."""
        out: list[str] = []
        for i, piece in enumerate(self.split_added(text) if any(t in text for t in self.added) else [text]):
            if i % 2:
                out.append("\0" + piece)
            elif piece:
                if piece.isascii():
                    out += self.find_words(piece.lower())
                    continue
                piece = normalise(piece)
                out += (self.find_words_beyond if _BEYOND(piece) else self.find_words)(piece)
        return out

    def encode_pieces(self, pieces: list[str]) -> list[tuple[bytes, str, int]]:
        """(ids as little-endian 32-bit integers, decoded text, number of ids) of each piece."""
        found = [self.words_of(x) for x in pieces]
        if len(self.cache) > CACHE_WORDS:  # words in use come over from the older half
            self.older, self.cache = self.cache, {}
        known = [list(map(self.cache.get, words)) for words in found]
        new = {w for words, got in zip(found, known, strict=True) for w in compress(words, map(not_, got))}
        self.cache |= {w: x for w in new if (x := self.older.get(w))}
        self.cache |= {w: struct.pack("<I", self.added[w[1:]]) for w in new if w[0] == "\0" and w[1:] in self.added}
        self.learn([w for w in new if w not in self.cache])
        out = []
        for words, got in zip(found, known, strict=True):
            for i in list(compress(range(len(got)), map(not_, got))):
                got[i] = self.cache[words[i]]
            ids = b"".join(got)
            out.append((ids, self.decode(ids), len(ids) // 4))
        return out

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[bytes, str, int]]:
        """Encode whole texts; a very long one goes through in pieces cut at blanks."""
        waiting: list[tuple[int, str]] = []
        done: dict[int, list] = {}
        for i, text in enumerate(texts):
            waiting += [(i, x) for x in cut(text)]
            while sum(len(x) for _, x in waiting) > 2 * PIECE or (waiting and i == len(texts) - 1):
                for (k, _), x in zip(waiting[:256], self.encode_pieces([x for _, x in waiting[:256]]), strict=True):
                    done.setdefault(k, []).append(x)
                waiting = waiting[256:]
        for i in range(len(texts)):
            ids, decoded, counts = zip(*done.get(i) or [(b"", "", 0)], strict=True)
            yield b"".join(ids), " ".join(x for x in decoded if x), sum(counts)

    def decode(self, ids: bytes) -> str:
        """Text of little-endian 32-bit ids: token strings with blanks between; unknown ids are left out."""
        flat = np.frombuffer(ids, "<u4")
        if len(flat) and int(flat.max()) >= len(self.name_list):
            flat = flat[flat < len(self.name_list)]
        return " ".join(map(self.name_list.__getitem__, flat.tolist()))


_coders: dict[str, Coder] = {}


def _coder(shared: _Shared) -> Coder:
    """This worker's coder; it lives on between tasks and queries, one at a time."""
    if shared.name not in _coders:
        _coders.clear()
        _coders[shared.name] = Coder(shared.value)
    return _coders[shared.name]


class _Shared:
    """A vocabulary sent to each executor once (its size doesn't depend on the data)."""

    def __init__(self, spark, vocabulary: Vocabulary):
        self.broadcast = spark.sparkContext.broadcast(vocabulary)
        self.name = hashlib.sha256(repr((vocabulary.merges, vocabulary.added, vocabulary.pattern, vocabulary.end)).encode()).hexdigest()

    @property
    def value(self) -> Vocabulary:
        return self.broadcast.value


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", digests_only: bool = False) -> DataFrame:
    """Encode whole texts with the tokenizer file at ``tokenizer`` (read on the driver).

    Returns doc_id, n_tokens, ids (array<int>), decoded; with ``digests_only``
    doc_id, n_tokens, ids_sha256, decoded_sha256. A null or empty text has no
    tokens. Repeated rows and null doc_ids are encoded like any others; columns
    besides the two are ignored; an empty table gives no rows. Special tokens in a
    text count as themselves.
    """
    shared = _Shared(docs.sparkSession, Vocabulary.load(tokenizer))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                # nothing here makes cycles, and the collector would walk the words it remembers
                gc.disable()
                ids, decoded, counts = zip(*coder.encode_batch([x or "" for x in part.column(1).to_pylist()]), strict=True)
                gc.enable()
                columns = [part.column(0), pa.array(counts, pa.int64())]
                if digests_only:
                    columns += [pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
                else:
                    columns += [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests_only else ("ids", "decoded"))])

    kind = docs.schema[key].dataType.simpleString()
    rest = "ids_sha256 string, decoded_sha256 string" if digests_only else "ids array<int>, decoded string"
    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, {rest}")


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``, rebuilt from its ids alone (null ids: empty)."""
    names = Vocabulary.load(tokenizer)
    shared = _Shared(encoded.sparkSession, names)

    @F.pandas_udf("string")
    def text(column):
        coder = _coder(shared)
        return column.map(lambda x: "" if x is None else coder.decode(np.asarray(x, "<u4").tobytes()))

    return encoded.withColumn("decoded", text(F.col(ids)))
