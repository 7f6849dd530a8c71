"""Exact deduplication by a tree merge of sorted digest runs.

1. Every text becomes a digest row once, in the task that reads it; the digest
   table is written to the shared folder, so texts are read and hashed once.
2. Each part of that table is a sorted run with one entry a digest. Runs are merged
   in rounds of a ``fan_in``-ary butterfly: in round r, node (digest prefix of r
   digits, group g) passes the next digit's sub-run to the group g // fan_in. Every
   level has about as many nodes as there are parts, each holds 1/parts of the
   entries, and a digest adds one entry a node at most, however often it occurs.
3. Each merge keeps, of the entries of a digest, the best identifier, after their
   full SHA-256 and length have been compared.
4. Winners of digests with copies go back to the parts that hold the digest, and
   rows look them up by (part, digest): a group of copies stays spread over the
   parts in which it was read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm import scratch
from undula.llm.kernels import releasing

FAN_IN = 16
#: Rows of a run that a task turns into Arrow at once.
ROWS = 1 << 18

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUN = "node long, digest binary, size long, best long, part int, place long, copies long"
_NAMES = ["node", "digest", "size", "best", "part", "place", "copies"]


def _words(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Digests of 32 bytes as rows of four numbers that sort like them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.zeros(0, np.uint8)
    start = 32 * column.offset
    return data[start : start + 32 * len(column)].view(">u8").reshape(-1, 4)


def _merge_batches(batches: Iterator[pa.RecordBatch], largest: bool, digit: int, fan_in: int, groups: int) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not any(b.num_rows for b in held):
        return
    table = pa.Table.from_batches(held)
    node, size, part, place, copies = (table[x].to_numpy() for x in ("node", "size", "part", "place", "copies"))
    null, best = table["best"].is_null().to_numpy(), table["best"].fill_null(0).to_numpy()
    digest = _words(table["digest"])
    # node, digest and length as one string: sorting it is stable and merges the runs that are in order already
    key = np.empty((len(node), 6), ">u8")
    key[:, 0], key[:, 1:5], key[:, 5] = node, digest, size
    order = np.argsort(key.view("S48").ravel(), kind="stable")
    key = key[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]).any(1)))
    group = np.cumsum(new) - 1
    # the wanted identifier first, a null one last, then the first row read
    rank = np.lexsort((place[order], part[order], -best[order] if largest else best[order], null[order], group))
    kept = order[rank[np.flatnonzero(new)]]
    total = np.add.reduceat(copies[order], np.flatnonzero(new))
    to = node[kept]
    if digit >= 0:
        high = digest[kept, 0].astype(np.uint64) >> np.uint64(32)  # 32 bits pick the nodes of all levels
        to = (high * np.uint64(fan_in ** (digit + 1)) >> np.uint64(32)).astype(np.int64) * groups + to % groups // fan_in
    out = pa.table([pa.array(to), table["digest"].take(pa.array(kept)), pa.array(size[kept]), table["best"].take(pa.array(kept)), pa.array(part[kept]), pa.array(place[kept]), pa.array(total)], names=_NAMES)
    yield from out.combine_chunks().to_batches(ROWS)


def _merge(largest: bool, digit: int, fan_in: int, groups: int):
    """Merge the sorted runs that reach a task, and address the result's sub-runs to the next level.

    ``digit``: which digit of the digest picks the next node; -1 to leave nodes.
    """

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _merge_batches(batches, largest, digit, fan_in, groups)

    return run


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, part and place (where it was read), SHA-256, length; all by built-in functions."""
    low = F.encode(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _UPPER, _LOWER), "UTF-8")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), low.alias("low"))
    place = F.monotonically_increasing_id()  # the partition, then the row in it
    rows = rows.select("doc_id", F.spark_partition_id().alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"), F.unhex(F.sha2("low", 256)).alias("digest"), F.octet_length("low").cast("long").alias("size"))
    return scratch.table(rows, "digests")


def merge_runs(digest_rows: DataFrame, largest: bool = True, fan_in: int = FAN_IN) -> DataFrame:
    """(digest, size, best, part, place, copies), one row a distinct text."""
    last = digest_rows.agg(F.max("part")).first()[0]
    parts = 1 if last is None else last + 1
    levels = 2 if parts > 2 else 1  # a single round would be a plain shuffle
    while fan_in**levels < parts:
        levels += 1
    fan = next(f for f in range(1, fan_in + 1) if f**levels >= parts)  # as even as the rounds allow
    groups = fan**levels  # node number = digest prefix * groups + group
    runs = digest_rows.select(F.col("part").cast("long").alias("node"), "digest", "size", F.col("doc_id").alias("best"), "part", "place", F.lit(1).cast("long").alias("copies"))
    runs = runs.mapInArrow(_merge(largest, 0, fan, groups), _RUN)
    for level in range(levels):
        width = -(-parts // fan ** (level + 1))  # groups that are left
        target = (F.floor(F.col("node") / groups) * width + F.col("node") % groups).cast("int")
        runs = runs.repartitionById(fan ** (level + 1) * width, target)
        runs = runs.mapInArrow(_merge(largest, level + 1 if level + 1 < levels else -1, fan, groups), _RUN)
    return runs.drop("node")


def exact_dedup(docs: DataFrame, keep: str = "largest", fan_in: int = FAN_IN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Group documents whose texts are equal but for the case of A-Z.

    Returns one row a document, dropped ones too: doc_id, keep_id, group_size, kept,
    text_sha256 (of the lower-cased text). A null text counts as empty. A null
    doc_id loses to any other; a group of null ids keeps its first row and has a null
    keep_id. Rows that repeat a doc_id and text count as copies: one is kept. An
    empty table gives no rows; other columns are ignored, whatever their names.
    ``keep``: "largest" or "smallest" doc_id.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    rows = digests(docs, key, text)
    winners = scratch.table(merge_runs(rows, keep == "largest", fan_in).where("copies > 1"), "winners")
    winners = winners.select("digest", "size", F.col("best").alias("keep_id"), F.struct("part", "place").alias("winner"), "copies")
    held = rows.select("part", "digest", "size").distinct()
    replies = held.join(winners, ["digest", "size"])
    out = rows.join(replies, ["part", "digest", "size"], "left")
    alone = F.col("copies").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("winner") == F.struct("part", "place"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, keep: str = "largest", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; all columns stay, whatever their names.

    Rows are addressed by doc_id. Where a doc_id is null or occurs twice, its rows
    are told apart by their text as well: of rows that share both, one stays. Null and
    empty texts are copies of one another; an empty table stays empty.
    """
    own_id, own_sha, kept_sha = scratch.fresh(docs, "__id", "__sha", "__kept")
    found = scratch.table(exact_dedup(docs, keep, key=key, text=text), "copies")
    unclear = found.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id")
    dropped = found.where("not kept").select(F.col("doc_id").alias(own_id))
    if unclear.isEmpty():
        return docs.join(scratch.small(dropped), F.col(key) == F.col(own_id), "left_anti")
    unclear = scratch.table(unclear, "unclear").select(F.col("doc_id").alias(own_id))
    same = F.col(key).eqNullSafe(F.col(own_id))
    clear = docs.join(scratch.small(unclear), same, "left_anti").join(scratch.small(dropped.join(unclear, own_id, "left_anti")), F.col(key) == F.col(own_id), "left_anti")
    low = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _UPPER, _LOWER)
    rest = docs.join(scratch.small(unclear), same, "left_semi").withColumn(own_sha, F.sha2(low, 256)).dropDuplicates([key, own_sha])
    kept = found.where("kept").select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(kept_sha))
    return clear.unionByName(rest.join(kept, same & (F.col(own_sha) == F.col(kept_sha)), "left_semi").drop(own_sha))
