"""The text format: its grammar, and what it rejects."""

import pytest

from undula.sources import bundled
from undula.sources.ts_format import TsDataSource, TsFormatError, format_ts, parse_case, parse_header, read_ts

HEAD = "% a comment\n@problemName Demo\n@timeStamps false\n@missing true\n@univariate false\n@dimension 2\n@equalLength false\n@classLabel true A b\n@data\n"


def test_reading(spark, tmp_path):
    path = tmp_path / "demo.ts"
    path.write_text(HEAD + "1,2,3:4,5,?:A\n\n 7,8 : 9,1e1 :b \n")
    spark.dataSource.register(TsDataSource)
    for df in (read_ts(spark, str(path), missing="0"), spark.read.format("ts").option("missing", "0").load(str(path))):
        rows = df.orderBy("case_id").collect()
        assert [r.x for r in rows] == [[[1.0, 2.0, 3.0], [4.0, 5.0, 0.0]], [[7.0, 8.0], [9.0, 10.0]]]
        assert [r.y for r in rows] == ["a", "b"]


@pytest.mark.parametrize("name", ["minimal_chinatown", "unequal_minimal_gas_prices", "minimal_japanese_vowels"])
def test_round_trip(spark, tmp_path, name):
    rows = bundled.load(spark, name, "TRAIN").orderBy("case_id").collect()
    classes = None if isinstance(rows[0].y, float) else sorted({r.y for r in rows})
    path = tmp_path / "x.ts"
    path.write_text(format_ts(name, [(r.x, r.y) for r in rows], classes))
    back = read_ts(spark, str(path), split="TRAIN").orderBy("case_id").collect()
    assert [(r.case_id, r.x, r.y, r.split) for r in back] == [(r.case_id, r.x, r.y, "TRAIN") for r in rows]


@pytest.mark.parametrize(
    ("old", "new", "message"),
    [
        ("@timeStamps false", "@timeStamps maybe", "true or false"),
        ("@timeStamps false", "@timeStamps true", "timestamps"),
        ("@dimension 2", "@dimension two", "whole number"),
        ("@dimension 2", "@dimension 2 3", "one value"),
        ("@univariate false", "@univariate true", "univariate"),
        ("@classLabel true A b", "@classLabel true", "classes"),
        ("@classLabel true A b", "@targetLabel true\n@classLabel true A", "exclude"),
        ("@classLabel true A b\n", "", "required"),
        ("@data\n", "", "no @data"),
        ("@problemName Demo", "@problemName", "needs a value"),
        ("@data", "1,2\n@data", "before @data"),
    ],
)
def test_bad_headers(old, new, message):
    with pytest.raises(TsFormatError, match=message):
        parse_header(iter(HEAD.replace(old, new).splitlines()))


def test_unknown_tags_warn():
    with pytest.warns(UserWarning, match="unknown tag"):
        parse_header(iter(HEAD.replace("@data", "@colour blue\n@data").splitlines()))


@pytest.mark.parametrize(("line", "message"), [("1,2:A", "channels"), ("1,2:3,4:c", "unknown class"), ("1,x:3,4:a", "float")])
def test_bad_cases(line, message):
    with pytest.raises(ValueError, match=message):
        parse_case(line, parse_header(iter(HEAD.splitlines())))


def test_declared_length():
    head = parse_header(iter("@equalLength true\n@seriesLength 3\n@targetLabel true\n@data".splitlines()))
    assert parse_case("1,2,3:0.5", head) == ([[1.0, 2.0, 3.0]], "0.5")
    with pytest.raises(TsFormatError, match="is expected"):
        parse_case("1,2:0.5", head)
