"""Vectorised text kernels that several operators share.

A batch of texts is one byte buffer with offsets, as Arrow holds it. Words are
found and hashed with whole-array operations, never in a loop over words.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; working arrays take about twenty times as much.
CHUNK = 1 << 19
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Words are runs of anything but the space and \x09-\x0D.
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
#: Words are runs of ASCII letters and digits and of all other characters than ASCII's.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

#: Byte masks of a block of which so many bytes belong to a word.
_WITHIN = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Blocks hashed at once: a word of any length takes no more memory than others.
_BLOCKS_AT_ONCE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hash_words(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of a buffer, A-Z as a-z.

    Blocks of eight bytes are mixed one by one, each with its number in the word, and
    then added; nothing is linear in the bytes. Words of up to seven bytes never share
    a hash with one another; of n longer ones, two do with a chance of about n^2 / 2^65.
    """
    low = np.empty(len(data) + 8, np.uint8)
    LOWER.take(data, out=low[: len(data)], mode="clip")
    low[len(data) :] = 0
    eight = np.ndarray((len(data) + 1,), "<u8", low, strides=(1,))  # the block that begins at each byte
    blocks = (length + 7) >> 3
    edges = np.concatenate(([0], np.cumsum(blocks)))
    out = np.empty(len(first), np.uint64)
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + _BLOCKS_AT_ONCE, "right")) - 1)
        if edges[hi] - edges[lo] <= _BLOCKS_AT_ONCE:
            own, size, n = blocks[lo:hi], length[lo:hi], int(edges[hi] - edges[lo])
            within = np.arange(n) - np.repeat(edges[lo:hi] - edges[lo], own)
            rest = np.repeat(size, own) - 8 * within
            value = eight[np.repeat(first[lo:hi], own) + 8 * within] & _WITHIN[np.minimum(rest, 8)]
            begins = edges[lo:hi] - edges[lo]
            value[begins] += np.where(size < 8, size, 0).astype(np.uint64) << np.uint64(56)
            mixed = mix(value + within.astype(np.uint64) * _STEP)
            out[lo:hi] = np.add.reduceat(mixed, begins) if len(begins) else mixed
        else:  # one very long word
            total = np.zeros(1, np.uint64)
            for at in range(0, int(length[lo]), 8 * _BLOCKS_AT_ONCE):
                k = np.arange(at, min(int(length[lo]), at + 8 * _BLOCKS_AT_ONCE), 8)
                value = eight[first[lo] + k] & _WITHIN[np.minimum(length[lo] - k, 8)]
                total += mix(value + (k >> 3).astype(np.uint64) * _STEP).sum()
            out[lo] = total[0]
        lo = hi
    return mix(out + np.where(length < 8, 0, length).astype(np.uint64) * _STEP)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give freed memory back to the system; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def releasing(run):
    """A batch function that gives its memory back when a task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def pieces(column: pa.Array, limit: int = 8 * CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, a longer text alone."""
    _, offsets = buffer_of(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, len(column))
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word in order, its first byte, its length, words of each text).

    A-Z count as a-z. Texts border words. The buffer is cut at blanks, so a long
    text takes no more memory than a short one.
    """
    n, hashes, firsts, lengths, lo = len(data), [], [], [], 0
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    while lo < n:
        hi = min(n, lo + CHUNK)
        if hi < n:
            cut = np.flatnonzero(blank[data[lo:hi]] | edge[lo + 1 : hi + 1])
            while not len(cut):  # a word longer than a chunk
                hi = min(n, hi + CHUNK)
                cut = np.flatnonzero(blank[data[lo:hi]] | edge[lo + 1 : hi + 1])
            hi = lo + int(cut[-1]) + 1
        part = data[lo:hi]
        off = blank[part]
        border = off | edge[lo + 1 : hi + 1]
        start = ~off
        start[1:] &= border[:-1]
        end = ~off
        end[:-1] &= off[1:] | edge[lo + 1 : hi]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        hashes.append(hash_words(part, s, e - s))
        firsts.append(s + lo)
        lengths.append(e - s)
        lo = hi
    first = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(first, offsets))
    length = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), first, length, counts


def segment_sum(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``, run i being ``counts[i]`` long."""
    return np.bincount(np.repeat(np.arange(len(counts)), counts), values, len(counts)) if len(values) else np.zeros(len(counts))


def pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, by byte planes, compressed."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return pa.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_small(values: np.ndarray) -> bytes:
    """Non-negative 32-bit values that are mostly small."""
    planes = np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack_small(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


def count_sorted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often (or with what weight) they occur."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[at], np.diff(at, append=len(keys))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(weights[order].astype(np.int64), at)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Range bucket of evenly spread 64-bit keys; it never falls as keys rise."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


#: Buckets up to which every task deals to each of them; beyond it, data goes through two rounds.
WIDE = 4096


def rounds(buckets: int) -> tuple[int, int]:
    """(supers, width): ranges of buckets dealt to in a first round, and buckets of each.

    A row is made for each task and bucket it has entries of. Were every task to deal to
    every bucket, their number would grow with the square of the input; with ranges of
    about the root of the number it grows with the power 1.5.
    """
    if buckets <= WIDE:
        return buckets, 1
    supers = math.isqrt(buckets - 1) + 1
    return supers, -(-buckets // supers)


def deal(blocks, supers: int, width: int, redeal):
    """Rows dealt to ``supers`` ranges (column ``bucket``) as rows of ``supers * width`` buckets, each in one partition.

    ``redeal``: batches of one range's rows to batches of rows by bucket, of the same schema.
    """
    from pyspark.sql import functions as F

    if width > 1:
        salt = F.pmod(F.spark_partition_id(), F.lit(width))
        blocks = blocks.repartitionById(supers * width, (F.col("bucket") * width + salt).cast("int")).mapInArrow(redeal, blocks.schema)
    return blocks.repartitionById(supers * width, F.col("bucket"))
