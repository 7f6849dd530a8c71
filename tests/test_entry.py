"""The driver contract, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = sorted(k for k in e.oracle_sql() if k.startswith("q_"))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_contract(spark):
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows_as_sql(spark, db, name):
    def norm(v):
        return float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v

    got = e.queries()[name](spark, SF)
    want = db.sql(e.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    mine = sorted(repr([norm(v) for v in r]) for r in got.select(*columns).collect())
    theirs = sorted(repr([norm(v) for v in r]) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())
    assert mine == theirs


def test_works_without_the_optional_subpackage():
    code = "import sys; sys.modules['undula.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.llm is None; assert len(e.queries()) > 40 and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)
