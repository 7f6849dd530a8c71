"""Physical plans: transforms don't shuffle, scans read what is needed."""

import pytest
from pyspark.sql import functions as F

from undula.operators.intervals import RandomIntervalTransformer
from undula.operators.transforms import AutocorrelationFunctionTransformer, PeriodogramTransformer, SevenNumberSummaryTransformer
from undula.sources.tables import embeddings, event_values

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("transform", [SevenNumberSummaryTransformer(), AutocorrelationFunctionTransformer(n_lags=4), PeriodogramTransformer(), RandomIntervalTransformer(n_intervals=50, random_state=0)], ids=lambda t: type(t).__name__)
def test_transforms_are_projections(spark, transform):
    series = embeddings(spark, SF)
    found = plan(transform.fit(series).transform(series).drop("y").where("case_id > 10"))
    assert "Exchange" not in found and "Join" not in found
    assert "label" not in found.split("ReadSchema")[1] and "GreaterThan(vec_id,10)" in found


def test_catalogues_do_not_widen_the_plan(spark):
    series = embeddings(spark, SF)
    sizes = [len(plan(RandomIntervalTransformer(n_intervals=n, random_state=0).fit(series).transform(series)).splitlines()) for n in (5, 200)]
    assert sizes[0] == sizes[1]


def test_series_from_events_take_one_shuffle(spark):
    found = plan(event_values(spark, SF).where(F.col("case_id") > 3))
    assert found.count("Exchange") == 1 and "user_id" in found.split("PushedFilters")[1]
