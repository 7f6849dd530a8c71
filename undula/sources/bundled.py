"""Small sample collections: the shapes of well-known ones, filled by a seeded generator.

With ``folder``, the original files are read instead: ``<folder>/<Name>/<Name>_TRAIN.ts``
and ``_TEST.ts`` in the ``.ts`` format. Each collection has 20 training and 20 test cases. ``split``: "TRAIN", "TEST" (in any case) or None
for both, training cases first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.sources.ts_format import read_ts

#: Channels, shortest and longest series of TRAIN and TEST, classes (0: regression).
SHAPES = {
    "minimal_chinatown": (1, (24, 24), (24, 24), 2),
    "unequal_minimal_chinatown": (1, (20, 24), (18, 24), 2),
    "equal_minimal_japanese_vowels": (12, (25, 25), (25, 25), 9),
    "minimal_japanese_vowels": (12, (10, 26), (10, 23), 9),
    "minimal_gas_prices": (1, (20, 20), (20, 20), 0),
    "unequal_minimal_gas_prices": (1, (16, 20), (14, 20), 0),
}


def _cases(name: str, test: bool) -> list[tuple]:
    channels, train_range, test_range, classes = SHAPES[name]
    lo, hi = test_range if test else train_range
    rng = np.random.RandomState(list(SHAPES).index(name) * 2 + test)
    out = []
    for i in range(20):
        n = lo if i == 0 else hi if i == 1 else int(rng.randint(lo, hi + 1))
        kind = i % classes if classes else 0
        t = np.arange(n)
        x = np.stack([np.sin((t + k) * (1 + kind) / 4) + rng.normal(0, 0.1, n) for k in range(channels)])
        out.append((i, x.tolist(), float(x.mean()) if not classes else str(kind + 1)))
    return out


def load(spark: SparkSession, name: str, split: str | None = None, folder: str | None = None) -> DataFrame:
    """case_id, x, y, split of a bundled collection, or of the files of that name in ``folder``."""
    if name not in SHAPES:
        raise ValueError(f"no such collection: {name}")
    wanted = ["TRAIN", "TEST"] if split is None else [split.upper()]
    if set(wanted) - {"TRAIN", "TEST"}:
        raise ValueError("split must be TRAIN, TEST or None")
    if folder:
        title = "".join(word.capitalize() for word in name.split("_"))
        read = [read_ts(spark, f"{folder.rstrip('/')}/{title}/{title}_{s}.ts", split=s) for s in wanted]
        return read[0] if len(read) == 1 else read[0].unionByName(read[1].withColumn("case_id", F.col("case_id") + read[0].count()))
    kind = "string" if SHAPES[name][3] else "double"
    parts = [spark.createDataFrame(_cases(name, s == "TEST"), f"case_id long, x array<array<double>>, y {kind}").withColumn("split", F.lit(s)) for s in wanted]
    if len(parts) == 1:
        return parts[0]
    return parts[0].unionByName(parts[1].withColumn("case_id", F.col("case_id") + 20))


def load_minimal_chinatown(spark, split=None, folder=None):
    return load(spark, "minimal_chinatown", split, folder)


def load_unequal_minimal_chinatown(spark, split=None, folder=None):
    return load(spark, "unequal_minimal_chinatown", split, folder)


def load_equal_minimal_japanese_vowels(spark, split=None, folder=None):
    return load(spark, "equal_minimal_japanese_vowels", split, folder)


def load_minimal_japanese_vowels(spark, split=None, folder=None):
    return load(spark, "minimal_japanese_vowels", split, folder)


def load_minimal_gas_prices(spark, split=None, folder=None):
    return load(spark, "minimal_gas_prices", split, folder)


def load_unequal_minimal_gas_prices(spark, split=None, folder=None):
    return load(spark, "unequal_minimal_gas_prices", split, folder)
