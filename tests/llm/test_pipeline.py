"""The stages together, against plain versions of each on its own input."""

import hashlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_bpe import expected
from tests.llm.test_jaccard import brute as components
from tests.llm.test_mixing import by_hand
from undula.llm import scratch, toxicity
from undula.llm.lm import fold
from undula.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.table(stage(spark, docs, SF), "stage")
        kept.append([tuple(r) for r in docs.collect()])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    toxic, exact, near, mixed, encoded = kept
    assert 0 < len(toxic) <= 200
    best = {}
    for r in toxic:
        best[(r[1] or "").encode().lower()] = max(r[0], best.get((r[1] or "").encode().lower(), -1))
    assert sorted(r[0] for r in exact) == sorted(best.values())
    least = components([(r[0], r[1]) for r in exact])
    assert sorted(r[0] for r in near) == sorted({c for _, _, c in least})
    source = columns.index("source")
    assert sorted(r[0] for r in mixed) == sorted(i for i, _ in by_hand([(r[0], r[1], r[source]) for r in near], corpus_pipeline.MAX_PASSES, 4096))
    # the first stage by the scores of its model, the last one by the tokenizer's library
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    scores = toxicity.score(documents, toxicity.train(documents, labels.where(fold("doc_id", 5) != 0))).collect()
    assert sorted(r[0] for r in toxic) == sorted(r.doc_id for r in scores if r.score < 0.5)
    assert sorted(encoded) == sorted((r[0], *digests(r[1])) for r in mixed)


def digests(text):
    ids, decoded = expected(text)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_odd_documents(spark, tmp_path):
    """Nulls, repeated ids and rows, empty texts, columns named like inner ones, and an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, __id string, _weight int, __block long, __class string"
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    texts = [near, near + " end", near.upper(), None, "", "plain", "plain", "another text"]
    ids = [1, 2, 3, 4, 5, None, None, 1]
    rows = [(i, t, "en", None if k % 3 else "s", 1, "x", k, 7, None) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/one/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    for folder in ("one", "none"):
        spark.createDataFrame([(1, 0, 0), (2, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{folder}/labels.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[1:]:
            docs = scratch.table(stage(spark, docs, f"{tmp_path}/{folder}"), name.split()[0])
        found = docs.select("doc_id").distinct().collect()
        assert {r.doc_id for r in found} == ({1, 2, 5, None} if folder == "one" else set())
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_run_and_registry(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert [k.split("_")[0] for k in QUERIES] == [f"op{n}" for n in range(1, 11)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    norm = lambda v: float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v
    got, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(repr([norm(v) for v in r]) for r in got.select(*columns).collect()) == sorted(repr([norm(v) for v in r]) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())
