"""Toxicity by class-conditional Kneser-Ney models.

Words are spelt as start mark, bytes and end mark. Each class has an interpolated
modified Kneser-Ney model of the spelling, up to ORDER marks long; the levels up to
SHARED are counted over both classes together, so a rare or new expression is judged
by what both have in common, and only well-supported differences count. A word's
evidence is the difference of its log-likelihoods under the two models; a text's is
the length-normalised difference over all its words, beside that of its most
suspicious words. A logistic fit on labelled rows that took no part in the counts
turns these into a score.

An n-gram of up to eight bytes is one 64-bit integer, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm import scratch
from undula.llm.kernels import LOWER, NOT_ALNUM, buffer_of, pieces, releasing, segment_sum, words
from undula.llm.lm import discounts, fold

ORDER = 7
SHARED = 3
#: Labelled rows that the models learn from, about (chosen by hash); the sample is bounded, not the scoring.
SAMPLE = 24_000
#: Bytes that their texts have together at most, and of a text that may be among them.
SAMPLE_BYTES, LONGEST = 1 << 27, 1 << 21
#: Every so many of them calibrate the score and aren't counted.
CALIBRATE = 4
_START, _STOP = 1, 2
_MASKS = [np.uint64((1 << 8 * k) - 1) for k in range(9)]
_MASKS[8] = np.uint64(2**64 - 1)
FEATURES = 10
#: Evidence of a word beyond which more of it says nothing new, and what counts as suspicious.
ENOUGH, SUSPICIOUS = 6.0, (1.0, 2.0, 3.0, 4.5)


def _spelling(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-gram codes (ORDER marks at most, the latest lowest) of each mark after the start, and how many a word has."""
    size = length + 2
    ends = np.cumsum(size)
    marks = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - size
    inner = np.ones(len(marks), bool)
    inner[starts] = inner[ends - 1] = False
    at = np.repeat(first - starts - 1, size)[inner] + np.flatnonzero(inner)
    marks[inner] = LOWER[data[at]]
    marks[starts], marks[ends - 1] = _START, _STOP
    codes = marks.astype(np.uint64)
    age = np.arange(len(marks)) - np.repeat(starts, size)  # marks before this one
    out = codes.copy()
    for back in range(1, ORDER):
        shifted = np.zeros_like(codes)
        shifted[back:] = codes[:-back] << np.uint64(8 * back)
        out |= np.where(age >= back, shifted, 0)
    keep = np.ones(len(marks), bool)
    keep[starts] = False
    return out[keep], length + 1


def _lengths(codes: np.ndarray) -> np.ndarray:
    return sum((codes >> np.uint64(8 * k) > 0).astype(np.int64) for k in range(ORDER))


@dataclass(frozen=True)
class Level:
    """One order: sorted n-grams with their discounted shares, sorted contexts with the mass they leave; columns by class."""

    grams: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    rest: np.ndarray


def _level(grams: np.ndarray, counts: np.ndarray) -> Level:
    """``counts``: a column a class. A context that a class hasn't seen leaves all mass to the level below."""
    contexts, place = np.unique(grams >> np.uint64(8), return_inverse=True)
    share, rest = np.zeros(counts.shape, np.float32), np.ones((len(contexts), counts.shape[1]), np.float32)
    for c in range(counts.shape[1]):
        own = counts[:, c]
        cut = np.array((0.0, *discounts(*(int((own == k).sum()) for k in (1, 2, 3, 4)))))[np.minimum(own, 3)]
        total = np.bincount(place, own, len(contexts))
        left = np.bincount(place, cut, len(contexts))
        seen = total > 0
        rest[seen, c] = left[seen] / total[seen]
        share[:, c] = (own - cut) / np.maximum(total[place], 1)
    return Level(grams, share, contexts, rest)


def _levels(codes: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Models of both classes from top-level n-grams (distinct codes, a count for each class)."""
    size, low = _lengths(codes), None
    levels: list[Level] = []
    for k in range(ORDER, 0, -1):
        own = size == k  # of the shorter ones, those that begin a word: they keep their counts
        grams, n = codes[own], counts[own]
        if low is not None and len(low[0]):  # others count the distinct marks before them, by class
            suffix, place = np.unique(low[0] & _MASKS[k], return_inverse=True)
            before = np.stack([np.bincount(place, low[1][:, c] > 0, len(suffix)) for c in range(counts.shape[1])], 1).astype(np.int64)
            grams, at = np.unique(np.concatenate([grams, suffix]), return_inverse=True)
            both = np.zeros((len(grams), counts.shape[1]), np.int64)
            np.add.at(both, at, np.concatenate([n, before]))
            n = both
        if k == SHARED:  # from here on, of both classes
            n = np.repeat(n.sum(1, keepdims=True), counts.shape[1], 1)
        order = np.argsort(grams)
        grams, n = grams[order], n[order]
        low = (grams, n)
        levels.append(_level(grams, n))
    return levels[::-1]


def _at(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


@dataclass(frozen=True)
class Model:
    levels: list[Level]
    weights: np.ndarray | None = None
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    constant: float | None = None  # the score where there was nothing to learn from

    def evidence(self, codes: np.ndarray) -> np.ndarray:
        """Log-likelihood of each mark in toxic words less that in ordinary ones (columns 1 and 0)."""
        p = np.full((len(codes), 2), 1 / 256)
        size = _lengths(codes)
        for k, level in enumerate(self.levels, 1):
            at, hit = _at(level.contexts, (codes & _MASKS[k]) >> np.uint64(8))
            hit &= size >= k
            gram, there = _at(level.grams, codes & _MASKS[k])
            share = np.where((there & hit)[:, None], level.share[gram] if len(level.grams) else 0.0, 0.0)
            p = np.where(hit[:, None], share + (level.rest[at] if len(level.rest) else 1.0) * p, p)
        return np.log(p[:, 1]) - np.log(p[:, 0])

    def features(self, column: pa.Array) -> np.ndarray:
        """Per text: evidence a mark; that of the three strongest words; how many distinct words are suspicious, and
        their share; log of the number of words."""
        data, offsets = buffer_of(column)
        hashes, first, length, counts = words(data, offsets, NOT_ALNUM)
        _, one, place = np.unique(hashes, return_index=True, return_inverse=True)
        codes, marks = _spelling(data, first[one], length[one])
        distinct, at = np.unique(codes, return_inverse=True)
        word = segment_sum(self.evidence(distinct)[at], marks)
        out = np.zeros((len(counts), FEATURES))
        value = word[place]
        out[:, 0] = segment_sum(value, counts) / np.maximum(segment_sum(length + 1, counts), 1)
        pair, again = np.unique(np.repeat(np.arange(len(counts)), counts) * max(1, len(one)) + place, return_index=True)
        owner, value = pair // max(1, len(one)), np.minimum(value[again], ENOUGH)  # each word once a text
        counts = np.bincount(owner, minlength=len(counts))
        order = np.lexsort((-value, owner))
        starts = np.cumsum(counts) - counts
        for j in range(3):
            has = counts > j
            out[has, 1 + j] = value[order[starts[has] + j]]
        for j, least in enumerate(SUSPICIOUS):
            out[:, 4 + j] = np.log1p(np.bincount(owner, value > least, len(counts)))
        out[:, 8] = np.bincount(owner, np.maximum(value, 0), len(counts)) / np.maximum(counts, 1)
        out[:, 9] = np.log1p(counts)
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        x = (self.features(column) - self.center) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, the constant, by Newton's steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([*[ridge] * (x.shape[1] - 1), 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@releasing
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Top-level n-grams of labelled texts and how often each class has them."""
    for batch in batches:
        for lo, hi in pieces(batch.column(0)):
            data, offsets = buffer_of(batch.column(0).slice(lo, hi - lo))
            label = np.asarray(batch.column(1).slice(lo, hi - lo).to_pylist(), np.int64)
            hashes, first, length, counts = words(data, offsets, NOT_ALNUM)
            if not len(hashes):
                continue
            _, one, place = np.unique(hashes, return_index=True, return_inverse=True)
            pair = np.unique(np.repeat(np.arange(len(counts)), counts) * len(one) + place)  # each word once a text
            toxic, place = label[pair // len(one)], pair % len(one)
            often = np.stack([np.bincount(place, toxic == c, len(one)) for c in (0, 1)], 1)
            codes, marks = _spelling(data, first[one], length[one])
            distinct, at = np.unique(codes, return_inverse=True)
            each = np.repeat(often, marks, 0)
            n = np.stack([np.bincount(at, each[:, c], len(distinct)) for c in (0, 1)], 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(n[:, 0].copy()), pa.array(n[:, 1].copy())], names=["code", "ordinary", "toxic"])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from a bounded sample of the labelled rows, chosen by the hash of their id.

    ``sample``: about so many labelled ids; ``sample_bytes``: of their texts, in the order
    of their digests, as many as have so many bytes together. Texts of more than LONGEST
    bytes don't teach. ``labels``: (key, label 0 or 1); rows with a null are left out, and
    of labels that contradict each other 1 holds. A null text teaches what an empty one
    does. Without rows of both classes, the model scores every text by the share of
    toxic rows (0 without any). n-grams and features of the sample, and nothing of other
    rows, reach the driver.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__toxic"))
    total = known.count()
    if total > sample:  # of 2^60 hashes, the share of the sample: one at least for any number of labels
        known = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 60)) < F.lit(sample * (1 << 60) // total))
    place = F.pmod(F.xxhash64(F.lit("calibrate"), F.col("__id")), F.lit(CALIBRATE))
    rows = docs.select(F.col(key).alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(known), "__id").where(F.octet_length("text") <= LONGEST)  # about `sample` rows of two numbers
    rows = rows.groupBy(F.sha2("text", 256).alias("same")).agg(F.first("text").alias("text"), F.max("__toxic").alias("toxic"), F.min(place).alias("place"))  # copies count once
    rows = scratch.table(rows.select("same", F.octet_length("text").alias("size"), "text", "toxic", (F.col("place") == 0).alias("calibrate")), "labelled")
    if (rows.agg(F.sum("size")).first()[0] or 0) > sample_bytes:
        sizes = rows.select("same", "size").toArrow().sort_by("same")  # a digest and a number for each of the sample
        fitting = int(np.searchsorted(np.cumsum(sizes["size"].to_numpy()), sample_bytes, "right"))
        rows = rows.where(F.col("same") < sizes["same"][fitting].as_py())
    classes = {(r.calibrate, r.toxic): r.n for r in rows.groupBy("calibrate", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows
    if any((part, c) not in classes for part in (False, True) for c in (0, 1)):
        n = sum(classes.values())
        return Model([], constant=sum(v for (_, c), v in classes.items() if c) / n if n else 0.0)
    grams = rows.where("not calibrate").select("text", "toxic").mapInArrow(_count, "code long, ordinary long, toxic long")
    grams = grams.groupBy("code").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")).toArrow()
    codes = grams["code"].to_numpy().view(np.uint64)
    order = np.argsort(codes)
    model = Model(_levels(codes[order], np.stack([grams["ordinary"].to_numpy(), grams["toxic"].to_numpy()], 1)[order]))
    shared = spark.sparkContext.broadcast(model)

    @releasing
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(batch.column(0)):
                x = shared.value.features(batch.column(0).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([*(pa.array(x[:, j].copy()) for j in range(FEATURES)), batch.column(1).slice(lo, hi - lo)], names=[*(f"f{j}" for j in range(FEATURES)), "toxic"])

    held = rows.where("calibrate").select("text", "toxic").mapInArrow(features, ", ".join(f"f{j} double" for j in range(FEATURES)) + ", toxic int").toArrow()
    x = np.stack([held[f"f{j}"].to_numpy() for j in range(FEATURES)], 1)
    y = held["toxic"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # a fixed order, so that sums don't depend on the reading
    x, y = x[order], y[order]
    center, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    return Model(model.levels, _logistic((x - center) / scale, y), center, scale)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: toxic) of every whole text; null and empty texts too. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # grows with SAMPLE only

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(shared.value.score(batch.column(1).slice(lo, hi - lo)))], names=["doc_id", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def reject(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score is ``least`` or more; rows pass whole, nothing is joined.

    Null and empty texts have the score of a text without words. Repeated rows share
    their fate; null ids and other columns play no part; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(batch.column(place)):
                part = batch.slice(lo, hi - lo)
                yield part.filter(pa.array(shared.value.score(part.column(place)) < least))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; labels of fold ``held`` are never read.

    Null and empty texts have the score of a text without words. Rows that repeat an
    id are scored each by its own text. Where a class has no labelled rows, every
    score is the share of toxic ones among them (0 without any).
    """
    model = train(docs, labels.where(fold(key, parts) != held), key, text, label, sample)
    out = score(docs, model, key, text)
    return out.select("doc_id", (fold("doc_id", parts) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
