"""Exact Jaccard self-join of shingle sets by universe partition and pigeonhole.

Two sets of s1 <= s2 shingles with Jaccard >= 4/5 have s2 <= 5/4 s1 and differ in at
most H = (s1 + s2) / 9 shingles. Sizes fall into bands that grow by 5/4, so partners
are in the same band or the next one, and both use the smaller one's partition.

Allocations, chosen per band by cost (signatures plus what weak ones let through):

exact      the hash universe is cut into m > H segments; at most H of them differ, so
           partners agree on m - H. A set's signatures are its non-empty segments. If
           it has fewer than m - H empty ones, one non-empty segment agrees.
deletion   (H + 1) / 2 segments; one differs in at most one shingle. Signatures are the
           segments and their one-deletion neighbourhoods.

Sets with too many empty segments for the first use the second as well, among
themselves. Sets that are equal count once from the start.

Signatures are dealt by hash. Up to SMALL sets that share one are paired; of larger
groups, each set is paired with one of them only. Partners share ``slack`` = m - H -
(empty segments) signatures at least, which prunes pairs by how many they share.
After each set's best pair is verified, large groups whose sets are all connected are
done. Of the others, a set may

- do without all r it is in, if slack > r: its partners share a small group too;
- otherwise do without its slack - 1 most frequent ones (prefix filter).

In what is left, sets of different components meet: each first with the one nearest
by a parity sketch, and after those are verified with all that are still apart. The
sketch's distance never exceeds the sets' difference, so it only leaves out pairs that
can't be linked. A large group's rows are dealt into blocks, and every two blocks meet
in a task of their own. No group is dropped or capped, so no link is lost. Verification
compares the whole sets of 64-bit shingle hashes: two different shingles, or two
different sets, count as equal with a chance of 2^-64 a pair.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from undula.llm import scratch
from undula.llm.components import components
from undula.llm.kernels import bucket_of, buffer_of, deal, mix, pack, pack_small, pieces, releasing, rounds, unpack, unpack_small, words

SHINGLE = 5
#: Groups of up to so many sets are paired at once.
SMALL = 8
#: Rows of a large group that are compared with as many others in one cell, about.
CELL = 512
#: Signatures a task holds before it passes them on.
HELD = 1_500_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.uint64(0xFFFFFFFFFFFFFF00)  # 56 bits of a signature: chance agreements only cost a verification
_BLOCKS = "bucket int, n long, sigs binary, owners binary, sets long, classes binary, sizes binary, roles binary"


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; empty without words."""
    hashes, _, _, counts = words(*buffer_of(column))
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    if n >= SHINGLE:
        acc = hashes[: n - SHINGLE + 1].copy()
        for i in range(1, SHINGLE):
            acc = acc * _ODD + hashes[i : n - SHINGLE + 1 + i]
        rolled[: len(acc)] = mix(acc)
    at = 0
    for count in counts.tolist():
        if count >= SHINGLE:
            yield np.unique(rolled[at : at + count - SHINGLE + 1])
        elif count:
            acc = np.uint64(count)
            with np.errstate(over="ignore"):
                for h in hashes[at : at + count]:
                    acc = acc * _ODD + h
            yield mix(np.array([acc ^ np.uint64(0x517CC1B727220A95)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
        at += count


@cache
def bands() -> list[tuple[int, int]]:
    """(smallest, largest) size of each band."""
    out, low = [], 1
    while low < 1 << 40:
        out.append((low, low * 5 // 4))
        low = out[-1][1] + 1
    return out


@cache
def allocation(band: int) -> tuple[bool, int, int]:
    """(exact?, segments, H) of least cost for a band."""
    low, high = bands()[band]
    most = (high + high * 5 // 4) // 9
    if not most:
        return True, 1, 0
    weak = 1.0  # what a signature of one shingle or none costs beside its storage
    pairs = most // 2 + 1
    mean = low / pairs
    best = (low + pairs + weak * low * math.exp(-mean) * (1 + mean), False, pairs)
    step = max(1, most // 50)
    for m in range(most + 1, 3 * most + 8, step):
        empty = m * math.exp(-low / m)
        if m - most >= empty + 2 * math.sqrt(empty) + 0.1 * m:  # room for empty and for frequent segments
            cost = m - empty + weak * low * math.exp(-low / m)
            if cost < best[0]:
                best = (cost, True, m)
            break
    return best[1], best[2], most


def band_of(size: int) -> int:
    return bisect_right(bands(), (size, 1 << 62)) - 1


def _name(sums: np.ndarray, segment: np.ndarray, band: int, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(sums + segment.astype(np.uint64) * _ODD) + np.uint64(4 * band + kind) * _ODD) & _KEEP


def _deletions(s: np.ndarray, h: np.ndarray, band: int, most: int) -> np.ndarray:
    m = most // 2 + 1
    segment = bucket_of(s, m)
    sums = np.zeros(m, np.uint64)
    at = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    sums[segment[at].astype(np.int64)] = np.add.reduceat(h, at)
    own = segment.astype(np.int64)
    return np.concatenate([_name(sums, np.arange(m), band, 1), _name(sums[own] - h, own, band, 1)])


def signatures(s: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(signatures, role) of a set in its own band and, as a larger partner, the one below.

    ``role``: twice the slack, plus 1 in the band below. The slack is how many non-empty
    segments a partner shares at least (0: no such bound).
    """
    out, own = [], band_of(len(s))
    h = mix(s + _ODD)
    for lower, band in enumerate((own, own - 1)):
        if band < 0 or len(s) > bands()[band][1] * 5 // 4:
            continue
        exact, m, most = allocation(band)
        if not exact:
            out.append((np.unique(_deletions(s, h, band, most)), lower))
            continue
        segment = bucket_of(s, m)  # the set is sorted: a segment is a run of it
        at = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        slack = m - most - (m - len(at))
        out.append((_name(np.add.reduceat(h, at), segment[at], band, 0), 2 * max(0, slack) + lower))
        if slack <= 0:
            out.append((np.unique(_deletions(s, h, band, most)), lower))
    return out


def _class(s: np.ndarray) -> int:
    """Id of a set: equal sets share it (64 bits of two independent sums and the size)."""
    with np.errstate(over="ignore"):
        total = np.array([mix(s + _ODD).sum() ^ mix(np.array([len(s)], np.uint64))[0], (s * _ODD).sum()], np.uint64)
        return int(mix(mix(total[:1]) + total[1:]).view(np.int64)[0])


SKETCH = 512


def _sketch(s: np.ndarray) -> bytes:
    """Parities of how many items fall on each of SKETCH bits: sets that differ in d items differ in d bits at most."""
    return np.packbits(np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).tobytes()


@releasing
def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in pieces(batch.column(1)):
            sets = [(len(s), _class(s), _sketch(s)) if len(s) else (0, None, None) for s in shingle_sets(batch.column(1).slice(lo, hi - lo))]
            columns = [pa.array([x[j] for x in sets], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], names=["doc_id", "n", "class", "sketch"])


def _packed(sigs: np.ndarray, owners: np.ndarray, classes: np.ndarray, sizes: np.ndarray, roles: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Signatures and the sets that own them (places in ``classes``, ``sizes``, ``roles``), a row for each bucket that has any."""
    order = np.argsort(sigs, kind="stable")
    sigs, owners = sigs[order], owners[order]
    bucket = bucket_of(sigs, buckets)
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(sigs) else np.zeros(0, np.int64)
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(sigs)], strict=False):
        used, own = np.unique(owners[lo:hi], return_inverse=True)
        values = [int(bucket[lo]), hi - lo, pack(sigs[lo:hi]), pack_small(own), len(used), classes[used].tobytes(), pack_small(sizes[used]), pack_small(roles[used])]
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["bucket", "n", "sigs", "owners", "sets", "classes", "sizes", "roles"])


def _redeal(buckets: int):
    """A range's signatures by bucket."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], [], []]
        known = 0
        for batch in batches:
            for _, n, packed, owners, sets, ids, size, role in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                parts = unpack(packed, n), unpack_small(owners, n) + np.uint32(known), np.frombuffer(ids, np.int64), unpack_small(size, sets), unpack_small(role, sets)
                for own, part in zip(held, parts, strict=True):
                    own.append(part)
                known += sets
        if known:
            yield from _packed(*(np.concatenate(x) for x in held), buckets)

    return run


def _deal(buckets: int):
    """Signatures of the distinct sets a task reads, as sorted arrays for each bucket."""

    def flush(held: list, classes: list[int], sizes: list[int], roles: list[int]) -> Iterator[pa.RecordBatch]:
        if held:
            owners = np.repeat(np.array([o for _, o in held], np.uint32), [len(x) for x, _ in held])
            yield from _packed(np.concatenate([x for x, _ in held]), owners, np.array(classes, np.int64), np.array(sizes, np.uint32), np.array(roles, np.uint32), buckets)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, classes, sizes, roles, size = [], [], [], [], 0
        for batch in batches:
            column = batch.column(0)
            for lo, hi in pieces(column):
                for s in shingle_sets(column.slice(lo, hi - lo)):
                    if not len(s) or (name := _class(s)) in seen:
                        continue
                    seen.add(name)
                    for sigs, role in signatures(s):
                        held.append((sigs, len(classes)))
                        classes.append(name)
                        sizes.append(len(s))
                        roles.append(role)
                        size += len(sigs)
                    if size > HELD:
                        yield from flush(held, classes, sizes, roles)
                        held, classes, sizes, roles, size = [], [], [], [], 0
        yield from flush(held, classes, sizes, roles)

    return run


_CANDIDATES = "a long, b long, weight long, sig long, role_a long, role_b long"


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 5 * np.minimum(a, b) >= 4 * np.maximum(a, b)


@releasing
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a < b, weight, roles) of sets that share signatures, and members (a = set, weight = size, sig, role_a) of large groups.

    Two sets that are both in a band as larger partners meet in the band above.
    """
    sigs, classes, sizes, roles = [], [], [], []
    for batch in batches:
        for _, n, packed, owners, sets, ids, size, role in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            own = unpack_small(owners, n)
            sigs.append(unpack(packed, n))
            classes.append(np.frombuffer(ids, np.int64)[own])
            sizes.append(unpack_small(size, sets)[own])
            roles.append(unpack_small(role, sets)[own].astype(np.int32))
    if not sigs:
        return
    sigs = np.concatenate(sigs)
    order = np.argsort(sigs, kind="stable")
    sigs = sigs[order]
    again = np.concatenate(([False], sigs[1:] == sigs[:-1]))
    shared = again.copy()
    shared[:-1] |= again[1:]
    sigs, order = sigs[shared], order[shared]  # most signatures belong to one set
    classes, sizes, roles = (np.concatenate(x)[order] for x in (classes, sizes, roles))
    order = np.lexsort((classes, roles & 1, sigs))
    sigs, classes, sizes, roles = sigs[order], classes[order], sizes[order].astype(np.int64), roles[order].astype(np.int64)
    fresh = np.concatenate(([True], (sigs[1:] != sigs[:-1]) | (classes[1:] != classes[:-1])))[: len(sigs)]
    sigs, classes, sizes, roles = sigs[fresh], classes[fresh], sizes[fresh], roles[fresh]
    if not len(sigs):
        return
    at = np.flatnonzero(np.concatenate(([True], sigs[1:] != sigs[:-1])))
    count = np.diff(at, append=len(sigs))
    place = np.arange(len(sigs)) - np.repeat(at, count)
    group = np.where(np.repeat(roles[at] & 1, count) == 1, 0, np.repeat(count, count))  # the first is a smaller partner, if any is
    firsts, seconds = [], []
    for gap in range(1, SMALL):  # pairs of small groups, by their distance in the group
        lo = np.flatnonzero((group <= SMALL) & (place + gap < group))
        firsts.append(lo)
        seconds.append(lo + gap)
    hub = np.flatnonzero((group > SMALL) & (place > 0))
    firsts.append(hub - place[hub])
    seconds.append(hub)
    lo, hi = np.concatenate(firsts), np.concatenate(seconds)
    fit = _close(sizes[lo], sizes[hi]) & ((roles[lo] & roles[hi] & 1) == 0)
    lo, hi = lo[fit], hi[fit]
    turn = classes[lo] > classes[hi]
    lo, hi = np.where(turn, hi, lo), np.where(turn, lo, hi)
    rows = np.stack([classes[lo], classes[hi], roles[lo], roles[hi]], 1)
    if len(rows):
        rows, weight = np.unique(rows, axis=0, return_counts=True)
        a, b, role_a, role_b = (pa.array(rows[:, j].copy()) for j in range(4))
        yield pa.RecordBatch.from_arrays([a, b, pa.array(weight), pa.nulls(len(rows), pa.int64()), role_a, role_b], names=["a", "b", "weight", "sig", "role_a", "role_b"])
    large = np.flatnonzero(group > SMALL)
    if len(large):
        none = pa.nulls(len(large), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(classes[large]), none, pa.array(group[large]), pa.array(sigs[large].view(np.int64)), pa.array(roles[large]), none], names=["a", "b", "weight", "sig", "role_a", "role_b"])


@releasing
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in pieces(batch.column(1)):
            wanted = batch.column(0).slice(lo, hi - lo).to_pylist()
            sets = [(c, s.tobytes()) for c, s in zip(wanted, shingle_sets(batch.column(1).slice(lo, hi - lo)), strict=True) if len(s) and _class(s) == c]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in sets], pa.int64()), pa.array([x for _, x in sets], pa.binary())], names=["class", "items"])


@releasing
def _all_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in pieces(batch.column(0)):
            sets = [(_class(s), s.tobytes()) for s in shingle_sets(batch.column(0).slice(lo, hi - lo)) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in sets], pa.int64()), pa.array([x for _, x in sets], pa.binary())], names=["class", "items"])


def _wanted_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, items) of the wanted classes (class, first), read from a row whose doc_id is ``first``.

    A doc_id that several wanted classes share, or null, says too little: its rows are
    told apart by the class of their text.
    """
    shared = wanted.groupBy("first").count().where("count > 1 or first is null").select("first")
    shared = scratch.table(shared, "shared_ids")
    clear = wanted.join(scratch.small(shared), "first", "left_anti").where("first is not null")
    chosen = texts.join(scratch.small(clear), F.col("doc_id") == F.col("first")).select("class", "text")
    sets = chosen.mapInArrow(_sets, "class long, items binary")
    if not shared.isEmpty():
        rest = texts.join(scratch.small(shared), F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
        sets = sets.unionByName(rest.select("text").mapInArrow(_all_sets, "class long, items binary").join(scratch.small(wanted.select("class")), "class", "left_semi"))
    sets = scratch.table(sets, "sets")
    if not sets.groupBy("class").count().where("count > 1").isEmpty():  # rows that repeat an id and its text
        sets = scratch.table(sets.groupBy("class").agg(F.first("items").alias("items")), "sets")
    return sets


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for x, y, left, right in zip(*(batch.column(i) for i in range(4)), strict=True):
            s, t = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
            at = np.searchsorted(t, s)
            both = int((t[np.minimum(at, len(t) - 1)] == s).sum())
            if 5 * both >= 4 * (len(s) + len(t) - both):
                a.append(x.as_py())
                b.append(y.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("class").alias("a"), F.col("items").alias("left"))
    right = sets.select(F.col("class").alias("b"), F.col("items").alias("right"))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return scratch.table(rows.mapInArrow(_verify, "a long, b long"), "verified")


def _cells(held: DataFrame) -> DataFrame:
    """Rows of large groups dealt into cells (sig, i, j), so that every two rows of a group meet in one.

    A group's rows fall into blocks of about CELL by hash; a cell holds two of them (or
    one, where i = j). However large a group is, no task holds more than its cells.
    """
    blocks = F.ceil(F.col("size") / CELL).cast("int")
    rows = held.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "label", "role", "n", "sketch")
    return rows.repartition("sig", "i", "j")


def _across(nearest: bool):
    """Pairs of different components in each cell that can be linked: all of them, or each set's nearest."""

    def fitting(a: dict, b: dict) -> tuple[np.ndarray, np.ndarray]:
        """(whether they can be linked, distance of the sketches) of each row of a and each of b."""
        apart = np.zeros((len(a["class"]), len(b["class"])), np.int64)
        for k in range(SKETCH // 64):
            apart += np.bitwise_count(a["bits"][:, None, k] ^ b["bits"][None, :, k])
        x, y = a["n"][:, None], b["n"][None, :]
        fit = ((a["role"][:, None] & b["role"][None, :] & 1) == 0) & _close(x, y) & (9 * apart <= x + y) & (a["label"][:, None] != b["label"][None, :])
        return fit, apart

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not any(b.num_rows for b in batches):
            return
        table = pa.Table.from_batches(batches)
        names = ("class", "label", "role", "n", "own")
        rows = {x: table[x].to_numpy() for x in ("sig", "i", "j", *names)}
        rows["bits"] = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(-1, SKETCH // 64)
        order = np.lexsort((rows["class"], rows["own"], rows["j"], rows["i"], rows["sig"]))
        rows = {x: v[order] for x, v in rows.items()}
        new = np.flatnonzero(np.any([np.diff(rows[x], prepend=rows[x][0] - 1) != 0 for x in ("sig", "i", "j")], 0) | (np.arange(len(order)) == 0))
        for lo, hi in zip(new, np.append(new[1:], len(order)), strict=True):
            middle = hi if rows["i"][lo] == rows["j"][lo] else lo + int(np.searchsorted(rows["own"][lo:hi], rows["j"][lo]))
            b = {x: rows[x][lo if middle == hi else middle : hi] for x in (*names, "bits")}
            held: list[np.ndarray] = []
            least, best = np.full(len(b["class"]), SKETCH + 1), np.zeros(len(b["class"]), np.int64)  # nearest of the first side to each of the second
            for at in range(lo, middle, 256):
                a = {x: rows[x][at : min(at + 256, middle)] for x in (*names, "bits")}
                if not len(b["class"]):
                    break
                fit, apart = fitting(a, b)
                if nearest:
                    apart = np.where(fit, apart, SKETCH + 1)
                    u = np.flatnonzero(fit.any(1))
                    held.append(np.stack([a["class"][u], b["class"][apart[u].argmin(1)]], 1))
                    own, near = apart.min(0), apart.argmin(0)
                    best = np.where(own < least, a["class"][near], best)
                    least = np.minimum(least, own)
                else:
                    u, v = np.nonzero(fit)
                    held.append(np.stack([a["class"][u], b["class"][v]], 1))
            if nearest:
                found = least <= SKETCH
                held.append(np.stack([best[found], b["class"][found]], 1))
            if held and len(pairs := np.unique(np.sort(np.concatenate(held), 1), axis=0)):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    return run


def _labelled(df: DataFrame, column: str, name: str, labels: DataFrame) -> DataFrame:
    one = labels.select(F.col("node").alias("__node"), F.col("label").alias("__label"))
    return df.join(one, F.col(column) == F.col("__node"), "left").withColumn(name, F.coalesce("__label", F.col(column))).drop("__node", "__label")


def _mixed(large: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of large groups in which components differ, without those that a set can do without."""
    held = scratch.table(_labelled(large, "class", "label", labels), "large")
    mixed = held.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("sig")
    held = held.join(mixed, "sig")
    # of a set's n groups, the rarest n - slack + 1; none if n < slack. A set has no more groups than segments
    own = Window.partitionBy("class", "role")
    held = held.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("k", F.row_number().over(own.orderBy("size", "sig")))
    return held.where(F.col("k") <= F.col("n") - F.greatest(F.shiftright("role", 1), F.lit(1)) + 1).select("sig", "class", "label", "role", "size")


def links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members: doc_id, n, class; classes: class, first, docs; labels: node, label): sets of documents and their components."""
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    members = scratch.table(texts.mapInArrow(_members, f"doc_id {kind}, n long, class long, sketch binary"), "members")
    # equal sets meet here once, after each task has merged its own
    classes = members.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("docs"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = scratch.table(classes, "classes")
    supers, width = rounds(2 * scratch.scan_tasks(docs))
    dealt = deal(texts.select("text").mapInArrow(_deal(supers), _BLOCKS), supers, width, _redeal(supers * width))
    found = scratch.table(dealt.mapInArrow(_meet, _CANDIDATES), "candidates")
    del dealt
    scratch.free_shuffles(docs.sparkSession)
    large = found.where("b is null").select(F.col("a").alias("class"), "sig", F.col("role_a").alias("role"), F.col("weight").alias("size"))
    # partners share as many segments as either's slack says: in small groups (weight) or in its large ones
    pairs = found.where("b is not null").groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.max("role_a").alias("role_a"), F.max("role_b").alias("role_b"))
    heavy = scratch.table(large.groupBy("class", "role").agg(F.count(F.lit(1)).alias("n")), "heavy")
    for side in "ab":
        own = heavy.select(F.col("class").alias(side), F.col("role").alias(f"role_{side}"), F.col("n").alias(f"n_{side}"))
        pairs = pairs.join(own, [side, f"role_{side}"], "left").where(F.col("weight") + F.coalesce(f"n_{side}", F.lit(0)) >= F.shiftright(f"role_{side}", 1))
    pairs = scratch.table(pairs.select("a", "b", "weight"), "pairs")
    bound = heavy.where(F.col("n") >= F.shiftright("role", 1)).select("class", "role")
    large = scratch.table(large.join(bound, ["class", "role"]), "bound")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("class")).unionByName(bound.select("class")).distinct()
    wanted = scratch.table(nodes.join(classes.select("class", "first"), "class"), "wanted")
    sets = _wanted_sets(texts, wanted)
    # each set with the partner it shares most signatures with
    best = pairs.groupBy("b").agg(F.max(F.struct("weight", "a")).alias("x")).select("x.a", "b")
    best = scratch.table(best, "best")
    sure = _linked(best, sets)
    labels = components(sure)
    sketches = scratch.table(classes.join(bound.select("class").distinct(), "class").select("class", "n", "sketch"), "sketches")
    for nearest in (True, False):
        rest = pairs.join(best, ["a", "b"], "left_anti").select("a", "b")
        rest = _labelled(_labelled(rest, "a", "la", labels), "b", "lb", labels).where("la <> lb").select("a", "b")
        held = _mixed(large, labels).join(sketches, "class")
        across = _cells(held).mapInArrow(_across(nearest), "a long, b long")
        more = _linked(scratch.table((across if nearest else across.unionByName(rest)).distinct(), "rest"), sets)
        if not more.isEmpty():
            sure = scratch.table(sure.unionByName(more), "sure")
            labels = components(sure)
    return members, classes, labels


def _components(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members, named: class, component_id, kept_class): distinct texts of components with more than one row.

    A component's first row has the smallest doc_id (null ones last) and, of its texts
    with that doc_id, the smallest class.
    """
    members, classes, labels = links(docs, key, text)
    classes = classes.select("class", F.col("first").alias("least"), "docs")
    classes = classes.join(labels, F.col("class") == F.col("node"), "left").withColumn("label", F.coalesce("label", "class"))
    classes = scratch.table(classes.select("class", "label", "least", "docs"), "labelled")  # a row a distinct text
    first = F.min(F.struct(F.col("least").isNull().alias("unnamed"), "least", "class")).alias("x")
    classes = classes.join(classes.groupBy("label").agg(first).select("label", F.col("x.least").alias("component_id"), F.col("x.class").alias("kept_class")), "label")
    return members, scratch.table(classes.where("docs > 1 or class <> kept_class").select("class", "component_id", "kept_class"), "named")


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Sets: distinct runs of five words (A-Z in lower case); with fewer words, the whole
    sequence. Links: Jaccard at least 4/5. ``component_id`` is the smallest doc_id that
    links reach. A null or empty text has an empty set and only itself. A row with a
    null doc_id takes part, but can't name a component. Rows that repeat a doc_id are
    texts of their own. An empty table gives no rows; other columns are ignored.
    """
    members, named = _components(docs, key, text)
    named = named.select(F.col("class").alias("__class"), "component_id")
    out = members.join(named, F.col("class") == F.col("__class"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _classed(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)  # the text as a string
            for lo, hi in pieces(column):
                classes = [_class(s) if len(s) else None for s in shingle_sets(column.slice(lo, hi - lo))]
                own = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(classes, pa.int64())], names=[*batch.schema.names[:-1], name])

    return run


def drop_near(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id, a null one last.

    Rows are addressed by doc_id. Where a doc_id is null or occurs twice, its rows are
    told apart by the sets of their texts: one row of those with the component's first
    doc_id and set stays, the one with the smallest text; other texts with that doc_id
    are decided on their own. Rows with empty sets (null and empty texts) stay. An
    empty table stays empty; other columns are kept, whatever their names.
    """
    own_id, own_class, own_row = scratch.fresh(docs, "__id", "__class", "__row")
    members, named = _components(docs, key, text)
    found = members.join(named.withColumnRenamed("class", "__class"), F.col("class") == F.col("__class"))
    dropped = found.where("component_id is null or component_id <> doc_id").select(F.col("doc_id").alias(own_id))
    unclear = members.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias(own_id))
    unclear = scratch.table(unclear, "unclear")
    if unclear.isEmpty():
        return docs.join(scratch.small(scratch.table(dropped, "near")), F.col(key) == F.col(own_id), "left_anti")
    same = F.col(key).eqNullSafe(F.col(own_id))
    dropped = scratch.table(dropped.where(F.col(own_id).isNotNull()).distinct().join(unclear, own_id, "left_anti"), "near")
    clear = docs.join(scratch.small(unclear), same, "left_anti").join(scratch.small(dropped), F.col(key) == F.col(own_id), "left_anti")
    rest = docs.join(scratch.small(unclear), same, "left_semi").withColumn(own_class, F.col(text).cast("string"))
    rest = scratch.table(rest.mapInArrow(_classed(own_class), StructType([*docs.schema.fields, StructField(own_class, LongType())])), "unclear_rows")
    kept, component = scratch.fresh(rest, "__kept_class", "__component")
    named = named.select(F.col("class").alias(own_class), F.col("kept_class").alias(kept), F.col("component_id").alias(component))
    grouped = rest.join(scratch.small(named), own_class, "left")
    alone = grouped.where(F.col(kept).isNull()).select(*docs.columns)
    firsts = grouped.where((F.col(own_class) == F.col(kept)) & F.col(key).eqNullSafe(F.col(component)))
    firsts = firsts.groupBy(own_class).agg(F.min_by(F.struct(*docs.columns), F.col(text).cast("string")).alias(own_row)).select(f"{own_row}.*")
    return clear.unionByName(alone).unionByName(firsts)
