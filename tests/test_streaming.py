from undula.operators.transforms import SevenNumberSummaryTransformer
from undula.streaming.assemble import assemble


def test_series_from_a_stream(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:0{i}:00", float(i)) for i in range(5)] + [("b", "2024-01-01 00:01:00", 7.0), ("a", "2024-01-03 00:00:00", 9.0), ("b", "2024-01-03 00:00:00", 1.0)]
    df = spark.createDataFrame(rows, "k string, ts string, v double").selectExpr("k", "cast(ts as timestamp) ts", "v")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    series = SevenNumberSummaryTransformer().transform(assemble(stream, "k", "ts", "v", "1 hour"))
    run = series.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination(120)
    found = {r.case_id: (r.x, r.features[0]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found["a"] == ([[0.0, 1.0, 2.0, 3.0, 4.0]], 2.0) and found["b"] == ([[7.0]], 7.0)
