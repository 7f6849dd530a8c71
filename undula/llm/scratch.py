"""Written tables and files in the folder that all executors share.

``spark.checkpoint.dir`` names that folder. Only a local session without the
setting gets a temporary one (as in tests); elsewhere it has to be set.
"""

from __future__ import annotations

import gc
import mmap
import os
import tempfile
import time
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
FREE_EVERY_S = 20
_leaving: set[str] = set()
_freed = [0.0]


def root(spark: SparkSession) -> str:
    """Shared folder of this application."""
    base = spark.conf.get(SETTING, None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="undula-")
        spark.conf.set(SETTING, base)
    path = f"{base.rstrip('/')}/undula-{spark.sparkContext.applicationId}"
    if path not in _leaving:  # deleted when the driver ends; clear() does it earlier
        _leaving.add(path)
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = there.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(there)
        store.deleteOnExit(there)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a reader of it: its lineage ends here.

    Lost executors cost nothing afterwards, and later passes don't repeat the
    work. Shuffle files of the plans that made it are freed.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if time.monotonic() - _freed[0] > FREE_EVERY_S:
        free_shuffles(spark)
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of plans that are no longer referenced.

    It acts when the collectors of Python and of the JVM run, so both are asked to;
    called by hand after large exchanges, otherwise every FREE_EVERY_S seconds at most.
    """
    _freed[0] = time.monotonic()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, whatever their case: underscores are put before ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def scan_tasks(df: DataFrame) -> int:
    """Number of tasks that read ``df``; it grows with the input."""
    return max(1, df._jdf.toJavaRDD().getNumPartitions())


#: Rows of a table of ids up to which it is broadcast: a few MB.
BROADCAST_IDS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_IDS) -> DataFrame:
    """Broadcast a written table of ids if it has few rows; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def clear(spark: SparkSession) -> None:
    """Delete everything this application has written to the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def write_bytes(uri: str, data: bytes) -> None:
    """Write a file whole: a repeated task replaces it by the same content."""
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            out.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as out:
        out.write(data)


def map_bytes(uri: str):
    """The file's bytes, memory-mapped where the shared folder is mounted."""
    if path := _local(uri):
        if not os.path.getsize(path):
            return b""
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return f.read()
