"""Sharding by fixed virtual slots.

Rows hash into a fixed number of slots; a small versioned table maps slots to
shards. Growing or rebalancing edits that table, so only the rows of edited slots
move. Bytes are aggregated per slot before any decision. Rows get their places from
counts: a slot's rows fall into parts by the checksum of their text, and rows that
agree in everything are counted, not sorted, so no key or text is too frequent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undula.llm import scratch

SLOTS = 4096
#: Parts of a slot's rows; there are SLOTS * PARTS rows of counts, 262144 at most by default.
PARTS = 64
#: Rows that agree in everything are numbered in runs of so many, by several tasks.
RUN = 1 << 16


@dataclass(frozen=True)
class SlotMap:
    """One version of the slot-to-shard map; ``shards[slot]`` is the shard."""

    version: int
    shards: tuple[int, ...]

    @staticmethod
    def initial(n_shards: int, slots: int = SLOTS) -> SlotMap:
        """Slots dealt in turn; a function of the two numbers only."""
        if not 0 < n_shards <= slots:
            raise ValueError("there must be between 1 and `slots` shards")
        return SlotMap(1, tuple(i % n_shards for i in range(slots)))

    @property
    def n_shards(self) -> int:
        return max(self.shards) + 1

    def grow(self) -> SlotMap:
        """One more shard; it takes slots from the fullest shards, and nothing else moves."""
        shards, new = list(self.shards), self.n_shards
        held: dict[int, list[int]] = {s: [] for s in range(new)}
        for slot, shard in enumerate(shards):
            held[shard].append(slot)
        for _ in range(len(shards) // (new + 1)):
            most = max(held, key=lambda s: (len(held[s]), -s))
            shards[held[most].pop()] = new
        return SlotMap(self.version + 1, tuple(shards))

    def rebalance(self, slot_bytes: dict[int, int], tolerance: float = 0.02) -> SlotMap:
        """Move slots from heavy to light shards until the heaviest is near the mean."""
        shards, load = list(self.shards), [0] * self.n_shards
        for slot, shard in enumerate(shards):
            load[shard] += slot_bytes.get(slot, 0)
        mean = sum(load) / len(load)
        for _ in range(len(shards)):
            hi, lo = max(range(len(load)), key=lambda s: (load[s], -s)), min(range(len(load)), key=lambda s: (load[s], s))
            if load[hi] <= mean * (1 + tolerance):
                break
            room = (load[hi] - load[lo]) / 2
            fit = [(slot_bytes.get(s, 0), -s) for s, shard in enumerate(shards) if shard == hi and 0 < slot_bytes.get(s, 0) <= room]
            if not fit:
                break
            size, slot = max(fit)
            shards[-slot] = lo
            load[hi] -= size
            load[lo] += size
        return SlotMap(self.version + 1, tuple(shards))

    def table(self, spark: SparkSession) -> DataFrame:
        """As (version, virtual_slot, shard); a row a slot."""
        return spark.createDataFrame([(self.version, i, s) for i, s in enumerate(self.shards)], "version int, virtual_slot int, shard int")

    def store(self, spark: SparkSession, path: str) -> None:
        """Add this version to the map's table; versions that are there stay as they are."""
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={self.version:06d}")

    @staticmethod
    def read(spark: SparkSession, path: str, version: int) -> SlotMap:
        """A stored version; a row a slot is read."""
        rows = spark.read.parquet(f"{path.rstrip('/')}/version={version:06d}").select("virtual_slot", "shard").collect()
        return SlotMap(version, tuple(s for _, s in sorted((r.virtual_slot, r.shard) for r in rows)))


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 32 bits of its text's MD5, modulo ``slots``; a null key counts as an empty text."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % slots).cast("int")


def slot_bytes(docs: DataFrame, slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(virtual_slot, rows, bytes), the totals that rebalancing needs."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    return docs.groupBy(virtual_slot(F.col(key), slots).alias("virtual_slot")).agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"))


def shard(docs: DataFrame, n_shards: int = 24, slots: int = SLOTS, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Place every row, by law ``key``: doc_id and the number of shards decide.

    The slot map and its edit for one more shard are stored as versions 1 and 2 of the
    table at ``path`` (the shared folder without one), and rows are placed by what is
    read from there. Returns doc_id, size (bytes of the text + 8), text_crc32, law,
    shard, slot (the row's place in its shard, from 0 without gaps), grown_shard (with
    one more shard), virtual_slot, map_version and virtual_slot_bytes (all bytes of the
    virtual slot). Within a shard, rows follow their virtual slot, crc modulo PARTS,
    doc_id, size and crc; a place is the number of rows in earlier parts + the place in
    its own part, so no task ever holds a shard.

    A null text has no bytes and crc 0. A null doc_id is a key like any other. Rows
    that repeat a doc_id share a shard and get places of their own. An empty table
    gives no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    path = path or scratch.new_path(spark, "slot_map")
    first = SlotMap.initial(n_shards, slots)
    first.store(spark, path)
    first.grow().store(spark, path)
    now, grown = SlotMap.read(spark, path, 1), SlotMap.read(spark, path, 2)
    maps = spark.createDataFrame(list(zip(range(slots), now.shards, grown.shards, strict=True)), "virtual_slot int, shard int, grown_shard int")
    data = F.coalesce(F.encode(F.col(text).cast("string"), "UTF-8"), F.lit(b""))
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(data).cast("long") + 8).alias("size"), F.crc32(data).alias("text_crc32"))
    rows = rows.withColumns({"virtual_slot": virtual_slot(F.col("doc_id"), slots), "part": (F.col("text_crc32") % PARTS).cast("int")})
    rows = scratch.table(rows.groupBy("virtual_slot", "part", "doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")), "sharding")
    # at most slots * PARTS rows from here to the window over a shard's parts
    totals = rows.groupBy("virtual_slot", "part").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("size")).alias("bytes"))
    totals = totals.join(F.broadcast(maps), "virtual_slot").withColumn("virtual_slot_bytes", F.sum("bytes").over(Window.partitionBy("virtual_slot")))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows", "bytes")
    earlier = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("place", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(starts, ["virtual_slot", "part"])  # rows lie by these two already
    placed = placed.withColumn("slot", (F.col("first") + F.col("place")).cast("long"))
    runs = placed.where(F.col("n") > RUN).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long")))).repartition("doc_id", "run")
    runs = runs.withColumn("slot", F.col("slot") + F.col("run")).withColumn("n", F.least(F.lit(RUN), F.col("n") - F.col("run"))).drop("run")
    placed = placed.where(F.col("n") <= RUN).unionByName(runs)
    placed = placed.withColumn("again", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("slot") + F.col("again")).alias("slot"),
        "grown_shard",
        "virtual_slot",
        F.lit(now.version).alias("map_version"),
        "virtual_slot_bytes",
    )
