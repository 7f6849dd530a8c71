"""Fitted models and operators on disk.

``save`` writes a folder: MLlib's own models by their writers, collections that a model
holds as Parquet, and the rest, which is small and plain, as one pickled row. ``load``
puts them together again, in this session or another one. Load only what you trust: a
pickle runs code.
"""

from __future__ import annotations

import io
import pickle

from pyspark.cloudpickle import CloudPickler
from pyspark.ml.util import MLReadable, MLWritable
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import DataFrame, SparkSession


def save(model, path: str, spark: SparkSession | None = None) -> None:
    """Write a fitted model, or an operator with its configuration, to a new folder."""
    spark = spark or SparkSession.getActiveSession()
    path, kept, out = path.rstrip("/"), [], io.BytesIO()

    class Writer(CloudPickler):
        def persistent_id(self, value):
            if isinstance(value, JavaWrapper) and isinstance(value, MLWritable):
                kind = "stage"
            elif isinstance(value, DataFrame):
                kind = "table"
            else:
                return None
            place = next((i for i, v in enumerate(kept) if v is value), None)
            if place is None:
                place = len(kept)
                kept.append(value)
                if kind == "stage":
                    value.write().save(f"{path}/stage-{place}")
                else:
                    value.write.parquet(f"{path}/table-{place}")
            return kind, place, type(value)

    Writer(out).dump(model)
    spark.createDataFrame([(bytearray(out.getvalue()),)], "data binary").coalesce(1).write.parquet(f"{path}/model")


def load(path: str, spark: SparkSession | None = None):
    """What ``save`` has written."""
    spark = spark or SparkSession.getActiveSession()
    path, found = path.rstrip("/"), {}

    class Reader(pickle.Unpickler):
        def persistent_load(self, name):
            kind, place, cls = name
            if place not in found:
                found[place] = spark.read.parquet(f"{path}/table-{place}") if kind == "table" else _read(cls, f"{path}/stage-{place}")
            return found[place]

    return Reader(io.BytesIO(bytes(spark.read.parquet(f"{path}/model").first().data))).load()


def _read(cls: type, path: str):
    if not issubclass(cls, MLReadable):
        raise TypeError(f"{cls.__name__} can't be read")
    return cls.load(path)
