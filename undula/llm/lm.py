"""Interpolated modified Kneser-Ney language model of whole texts.

Counting is done by Spark in three exchanges. What moves between tasks are sorted,
compressed arrays with one entry a distinct word or pair of words and reading task,
dealt by hash ranges; frequent words therefore weigh no more than rare ones. The
model is a folder of sorted arrays in the shared folder:

    word-*      hashes of the words, sorted; a word's id is its place
    count-*     occurrences of each word
    pair-*      word pairs (id << 32 | id), dealt by hash and sorted
    seen-*      occurrences of each pair (255: see over-*)
    stat-*      by word id: pairs it begins with 1, 2, 3+ occurrences; pairs it ends

Scoring tasks map these files into memory and look up the sorted distinct words and
pairs of a batch, so pages of the model are shared by all workers of a machine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm import scratch
from undula.llm.kernels import bucket_of, buffer_of, count_sorted, deal, mix, pack, pack_small, pieces, releasing, rounds, segment_sum, unpack, unpack_small, words

#: Stands for the end of a text; no word hashes are reserved, 64 bits make a clash improbable.
END = np.uint64(0x5EED0F7E47E4D001)
#: Distinct entries that a task holds before it passes them on.
HELD = 4_000_000
#: Word ids have 32 bits.
MOST_WORDS = 2**32 - 2

_BLOCK = "bucket int, n long, keys binary, counts binary"
_STATS = "bucket int, kind int, n long, keys binary, a binary, b binary, c binary, scalars array<long>"


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of each text with END after them, and tokens a text (1 at least)."""
    hashes, _, _, counts = words(*buffer_of(column))
    ends = np.cumsum(counts + 1) - 1
    out = np.empty(len(hashes) + len(counts), np.uint64)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = hashes, END
    return out, counts + 1


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return count_sorted(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))


def _blocks(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted keys and their counts, a row for each bucket that has any."""
    order = np.argsort(bucket.astype(np.uint32), kind="stable")
    keys, counts, bucket = keys[order], counts[order], bucket[order]
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=False):
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(bucket[lo])], pa.int32()), pa.array([hi - lo]), pa.array([pack(keys[lo:hi])]), pa.array([pack_small(counts[lo:hi])])],
            names=["bucket", "n", "keys", "counts"],
        )


def _counting(keys_of: Callable[[pa.Array], np.ndarray], bucket: Callable[[np.ndarray], np.ndarray]):
    """Count the keys of all texts a task reads; distinct ones only go on."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            column = batch.column(0)
            for lo, hi in pieces(column):
                held.append(count_sorted(keys_of(column.slice(lo, hi - lo))))
                size += len(held[-1][0])
                if size > HELD:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from _blocks(*held[0], bucket(held[0][0]))
                        held, size = [], 0
        keys, counts = _merged(held)
        yield from _blocks(keys, counts, bucket(keys))

    return run


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, keys, counts) of each bucket that a task has."""
    held: dict[int, list] = {}
    for batch in batches:
        for bucket, n, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            part = held.setdefault(bucket, [])
            part.append((unpack(keys, n), unpack_small(counts, n)))
            if len(part) > 1 and sum(len(k) for k, _ in part[1:]) > len(part[0][0]) + HELD // 4:
                part[:] = [_merged(part)]
    for bucket, part in held.items():
        yield bucket, *_merged(part)


def _redeal(bucket: Callable[[np.ndarray], np.ndarray]):
    """A range's keys by bucket, merged."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, counts in _read_blocks(batches):
            yield from _blocks(keys, counts, bucket(keys))

    return run


def _write_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, keys, counts in _read_blocks(batches):
            scratch.write_bytes(f"{folder}/word-{bucket}", keys.tobytes())
            scratch.write_bytes(f"{folder}/count-{bucket}", counts.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([len(keys)]), pa.array([int(counts.sum())])], names=["bucket", "words", "tokens"])

    return run


_open: dict[str, np.ndarray] = {}


def _array(uri: str, kind: str) -> np.ndarray:
    """A mapped array of the model; mappings are kept, they take no memory of their own."""
    if uri not in _open:
        if len(_open) > 20_000:
            _open.clear()
        _open[uri] = np.frombuffer(scratch.map_bytes(uri), kind)
    return _open[uri]


def _found(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each of some sorted keys in a sorted array, -1 where it isn't there."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def _log_sum(logs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of logarithms, each rounded to 13 decimals: they don't depend on the order of adding.

    The whole numbers are added in two parts, so texts of any length fit.
    """
    whole = np.round(logs * 1e13).astype(np.int64)
    edges = np.concatenate(([0], np.cumsum(counts)))
    high, low = (np.concatenate(([0], np.cumsum(part))) for part in (whole >> 20, whole & ((1 << 20) - 1)))
    return ((high[edges[1:]] - high[edges[:-1]]) * 2.0**20 + (low[edges[1:]] - low[edges[:-1]])) / 1e13


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the numbers that belong to no single word."""

    folder: str
    buckets: int
    firsts: tuple[int, ...]  # id of each bucket's first word; the last entry is the number of words
    train_tokens: int
    train_texts: int
    pairs: int = 0
    discounts: tuple[float, float, float] = (0.5, 0.5, 0.5)
    low_discounts: tuple[float, float, float] = (0.5, 0.5, 0.5)
    low_rest: float = 1.0  # mass of the lowest level's uniform part

    @property
    def words(self) -> int:
        return self.firsts[-1]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted distinct word hashes."""
        ids, counts = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        edges = np.searchsorted(bucket_of(hashes, self.buckets), np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(edges)):
            if self.firsts[b] == self.firsts[b + 1]:
                continue
            part = slice(edges[b], edges[b + 1])
            at = _found(_array(f"{self.folder}/word-{b}", "<u8"), hashes[part])
            ids[part] = np.where(at >= 0, at + self.firsts[b], -1)
            counts[part] = np.where(at >= 0, _array(f"{self.folder}/count-{b}", "<i8")[at], 0)
        return ids, counts

    def stats(self, ids: np.ndarray) -> np.ndarray:
        """The four columns of stat-* for sorted distinct ids."""
        out = np.zeros((len(ids), 4), np.int64)
        edges = np.searchsorted(self.range_of(ids), np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(edges)):
            part = slice(edges[b], edges[b + 1])
            out[part] = _array(f"{self.folder}/stat-{b}", "<u4").reshape(-1, 4)[ids[part] - self.range_start(b)]
        return out

    def range_of(self, ids: np.ndarray) -> np.ndarray:
        """Ranges of ids (0 to the number of words, which stands for a text's start)."""
        return ids * self.buckets // (self.words + 1)

    def range_start(self, bucket: int) -> int:
        return -(-bucket * (self.words + 1) // self.buckets)

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Occurrences of sorted distinct pairs."""
        out = np.zeros(len(keys), np.int64)
        bucket = bucket_of(mix(keys), self.buckets)
        order = np.argsort(bucket.astype(np.uint32), kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(edges)):
            own = order[edges[b] : edges[b + 1]]
            at = _found(_array(f"{self.folder}/pair-{b}", "<u8"), keys[own])
            hit = own[at >= 0]
            at = at[at >= 0]
            seen = _array(f"{self.folder}/seen-{b}", "u1")[at].astype(np.int64)
            if len(many := np.flatnonzero(seen == 255)):
                over = _array(f"{self.folder}/over-{b}", "<i8").reshape(-1, 2)
                seen[many] = over[np.searchsorted(over[:, 0], at[many]), 1]
            out[hit] = seen
        return out

    def low(self, ends: np.ndarray) -> np.ndarray:
        """Lowest level: probability of a word that ends so many distinct pairs."""
        rest = self.low_rest / (self.words + 1)
        cut = np.array((0.0, *self.low_discounts))[np.minimum(ends, 3)]
        return (ends - cut) / max(1, self.pairs) + rest

    def score(self, column: pa.Array) -> dict[str, np.ndarray]:
        """Per text: n_tokens, n_known, base_score, score (log10)."""
        flat, counts = tokens(column)
        hashes, place = np.unique(flat, return_inverse=True)
        ids, seen = self.ids(hashes)
        known = ids >= 0
        stats = np.zeros((len(ids) + 1, 4), np.int64)
        stats[: len(ids)][known] = self._by_id(ids[known])
        stats[-1] = self.stats(np.array([self.words]))[0] if self.pairs else 0
        starts = np.cumsum(counts) - counts
        before = np.empty(len(place), np.int64)  # place of the context; the last entry stands for a text's start
        before[1:] = place[:-1]
        before[starts] = len(ids)
        all_ids = np.append(ids, self.words)
        keys = (all_ids[before].astype(np.uint64) << np.uint64(32)) | ids[place].astype(np.uint64)
        both = np.flatnonzero((all_ids[before] >= 0) & (ids[place] >= 0))
        pair, at = np.unique(keys[both], return_inverse=True)
        c = np.zeros(len(place), np.int64)
        c[both] = self.pair_counts(pair)[at] if self.pairs else 0
        total = np.append(seen, self.train_texts)[before]
        low = self.low(stats[: len(ids), 3])[place]
        left = stats[:, :3] @ np.array(self.discounts)
        cut = np.array((0.0, *self.discounts))[np.minimum(c, 3)]
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(total > 0, (c - cut + left[before] * low) / total, low)
        base = np.log10((seen + 1) / (self.train_tokens + 1 * (self.words + 1)))
        return {
            "n_tokens": counts,
            "n_known": segment_sum(known[place].astype(np.int64), counts).astype(np.int64),
            "base_score": _log_sum(base[place], counts),
            "score": _log_sum(np.log10(p), counts),
        }

    def _by_id(self, ids: np.ndarray) -> np.ndarray:
        return self.stats(ids) if self.pairs else np.zeros((len(ids), 4), np.int64)


def _pair_keys(model: Model) -> Callable[[pa.Array], np.ndarray]:
    def keys(column: pa.Array) -> np.ndarray:
        flat, counts = tokens(column)
        hashes, place = np.unique(flat, return_inverse=True)
        ids = model.ids(hashes)[0][place].astype(np.uint64)
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[np.cumsum(counts) - counts] = model.words
        return (before << np.uint64(32)) | ids

    return keys


def _write_pairs(model: Model):
    """Write a bucket of pairs; pass on what it says about the words at either side."""

    def rows(kind: int, ids: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        edges = np.searchsorted(model.range_of(ids), np.arange(model.buckets + 1))
        for b in np.flatnonzero(np.diff(edges)):
            part = slice(edges[b], edges[b + 1])
            small = [pack_small(x[part]) for x in columns] + [b""] * (3 - len(columns))
            yield row(int(b), kind, part.stop - part.start, pack(ids[part].astype(np.uint64)), small, [])

    def row(bucket: int, kind: int, n: int, keys: bytes, small: list[bytes], scalars: list[int]) -> pa.RecordBatch:
        values = [bucket, kind, n, keys, *small, scalars]
        kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["bucket", "kind", "n", "keys", "a", "b", "c", "scalars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, keys, counts in _read_blocks(batches):
            many = np.flatnonzero(counts >= 255)
            scratch.write_bytes(f"{model.folder}/pair-{bucket}", keys.tobytes())
            scratch.write_bytes(f"{model.folder}/seen-{bucket}", np.minimum(counts, 255).astype("u1").tobytes())
            scratch.write_bytes(f"{model.folder}/over-{bucket}", np.stack([many, counts[many]], 1).astype("<i8").tobytes())
            yield row(bucket, 0, 0, b"", [b""] * 3, [len(keys), *(int((counts == k).sum()) for k in (1, 2, 3, 4))])
            first = (keys >> np.uint64(32)).astype(np.int64)
            at = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
            yield from rows(1, first[at], [np.add.reduceat(x.astype(np.int64), at) for x in (counts == 1, counts == 2, counts > 2)])
            yield from rows(2, *(lambda k, n: (k.astype(np.int64), [n]))(*count_sorted(keys & np.uint64(0xFFFFFFFF))))

    return run


def _write_stats(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        scalars = np.zeros(5, np.int64)
        for batch in batches:
            for bucket, kind, n, keys, a, b, c, numbers in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if bucket not in held:
                    held[bucket] = np.zeros((model.range_start(bucket + 1) - model.range_start(bucket), 4), np.int64)
                if kind == 0:
                    scalars += numbers
                    continue
                at = unpack(keys, n).astype(np.int64) - model.range_start(bucket)
                for column, packed in ((0, a), (1, b), (2, c)) if kind == 1 else ((3, a),):
                    held[bucket][at, column] += unpack_small(packed, n)
        ends = np.zeros(5, np.int64)
        for bucket, table in held.items():
            scratch.write_bytes(f"{model.folder}/stat-{bucket}", table.astype("<u4").tobytes())
            ends += [(table[:, 3] == k).sum() for k in (1, 2, 3, 4)] + [(table[:, 3] > 2).sum()]
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (*scalars, *ends)], names=_SCALARS)

    return run


_SCALARS = ["pairs", "n1", "n2", "n3", "n4", "e1", "e2", "e3", "e4", "e3_more"]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many entries occur once to four times.

    Where a count of counts is 0 (small corpora), the plain discount stands in.
    """
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = [k - (k + 1) * y * after / own if own and after else y for k, own, after in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.01), k - 0.01) for k, d in enumerate(out, 1))


def train(texts: DataFrame, text: str = "text") -> Model:
    """Count the words and word pairs of all ``texts`` and write the model."""
    spark, (supers, width) = texts.sparkSession, rounds(scratch.scan_tasks(texts))
    buckets = supers * width
    folder = scratch.new_path(spark, "lm")
    texts = texts.select(F.col(text).cast("string").alias("text"))

    def dealt(keys_of, spread) -> DataFrame:
        blocks = texts.mapInArrow(_counting(keys_of, lambda k: bucket_of(spread(k), supers)), _BLOCK)
        return deal(blocks, supers, width, _redeal(lambda k: bucket_of(spread(k), buckets)))

    sizes = dealt(lambda c: tokens(c)[0], lambda k: k).mapInArrow(_write_words(folder), "bucket int, words long, tokens long").collect()  # a row a bucket
    found = {r.bucket: r for r in sizes}
    own = [found[b].words if b in found else 0 for b in range(buckets)]
    firsts = tuple(int(x) for x in np.concatenate(([0], np.cumsum(own))))
    if firsts[-1] > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} distinct words")
    ends, seen = Model(folder, buckets, firsts, 0, 0).ids(np.array([END])) if sizes else (None, [0])
    model = Model(folder, buckets, firsts, sum(r.tokens for r in sizes), int(seen[0]))
    scratch.free_shuffles(spark)
    if not model.words:
        return model
    stats = dealt(_pair_keys(model), mix).mapInArrow(_write_pairs(model), _STATS)
    stats = stats.repartitionById(buckets, F.col("bucket")).mapInArrow(_write_stats(model), ", ".join(f"{x} long" for x in _SCALARS))
    s = stats.agg(*(F.sum(x).alias(x) for x in _SCALARS)).first()
    del stats
    scratch.free_shuffles(spark)
    low = discounts(s.e1, s.e2, s.e3, s.e4)
    rest = (low[0] * s.e1 + low[1] * s.e2 + low[2] * s.e3_more) / s.pairs
    return Model(folder, buckets, firsts, model.train_tokens, model.train_texts, s.pairs, discounts(s.n1, s.n2, s.n3, s.n4), low, rest)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity of every whole text.

    A text's tokens are its words and its end; a token's logarithm counts to 13
    decimals. A null or empty text has its end only. Repeated rows and null ids are scored like any others. An unknown word
    gets the lowest level's uniform share. Other columns are ignored.
    """

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for lo, hi in pieces(column):
                got = model.score(column.slice(lo, hi - lo))
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(got["n_tokens"]), pa.array(got["n_known"]), pa.array(np.full(n, model.train_tokens)), pa.array(got["base_score"]), pa.array(got["score"]), pa.array(10 ** (-got["score"] / got["n_tokens"]))],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def fold(key: str, parts: int):
    """crc32 of the id's text modulo ``parts``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def score_held_out(docs: DataFrame, parts: int = 7, held: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the rows outside fold ``held`` of ``parts`` and score all of them.

    As ``score``, with held_out beside. With no training rows, scores are those of an
    empty model.
    """
    away = fold(key, parts) == held
    model = train(docs.where(~away), text)
    out = score(docs, model, key, text)
    return out.select("doc_id", (fold("doc_id", parts) == held).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
