import random

import pytest


@pytest.fixture
def corpus(spark, tmp_path):
    """Write (doc_id, text) rows, or more columns, as Parquet of some parts and read them."""

    def make(rows, schema="doc_id long, text string", parts=3, name="docs"):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, schema).repartition(parts).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture
def rng():
    return random.Random(7)


#: Texts that every operator must take.
ODD = [None, "", "   ", "\t\n", "a", "A", "Straße ÄÖ", "x " * 30_000, "same text here", "same text here", "Same Text HERE", "İΣ σς", "emoji \U0001f600 \U0001f600", "<|endoftext|> in text"]
