"""From raw documents to token ids: toxicity, exact copies, near copies, mixing, encoding.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet
and read again as the next one's ``docs``. Stages keep all columns of their input,
whatever their names; an empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from undula.llm import bpe, exact_dedup, jaccard, mixing, scratch, toxicity
from undula.llm.lm import fold
from undula.llm.queries import tokenizer_path

#: A source is repeated so often at most, and taken once at least.
MAX_PASSES = 2.0


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic.

    It learns from the labels outside fold 0 of 5. Null and empty texts are scored as
    texts without words; rows that repeat an id share its label but are scored by
    their own text. Without labels of both classes, the share of toxic ones decides.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(fold("doc_id", 5) != 0))
    return toxicity.reject(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the one with the largest doc_id.

    Null and empty texts are copies of one another; a null id loses to any other; of
    rows that repeat both id and text one stays.
    """
    return exact_dedup.drop_copies(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the one with the smallest doc_id (null last).

    Texts without words have no near copies. Rows that repeat an id are told apart by
    their texts.
    """
    return jaccard.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, those of small sources up to MAX_PASSES times.

    A null source is a source. Copies of a row come from further passes over its source.
    """
    return mixing.mix(docs, max_passes=MAX_PASSES).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text; null and empty texts have no tokens."""
    return bpe.encode(docs, tokenizer_path(), digests_only=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: A classifier and a tokenizer can't be stated in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
