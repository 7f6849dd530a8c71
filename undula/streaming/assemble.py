"""Series from streams of events.

Fitted and stateless transforms are projections and run on a stream as they are. What
a stream needs is the assembly of series: events of a key within a tumbling or session
window, complete once the watermark has passed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assemble(events: DataFrame, key: str, time: str, value: str, window: str, late: str = "10 minutes", session: bool = False) -> DataFrame:
    """case_id, start, x: a univariate series a key and window, values in order of time.

    Late events within ``late`` are taken in their place; later ones are dropped by
    the watermark. State holds open windows only. Write with output mode append.
    """
    span: Column = F.session_window(time, window) if session else F.window(time, window)
    rows = events.withWatermark(time, late).groupBy(F.col(key).alias("case_id"), span.alias("w"))
    held = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("v")))).alias("p"))
    return held.select("case_id", F.col("w.start").alias("start"), F.array(F.transform("p", lambda e: e["v"])).alias("x"))
