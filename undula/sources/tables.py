"""Tables reshaped as collections of series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.series import from_long


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector is a series of one channel; nothing is shuffled."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("case_id"), F.array(F.col("embedding").cast("array<double>")).alias("x"), F.col("label").alias("y"))


def _dense(channels: int, length: int):
    """Rows of a table of numbers from their cells (at, v); others are 0. One step a cell."""

    @F.pandas_udf("array<array<double>>")
    def fill(cells: pd.Series) -> pd.Series:
        out = []
        for case in cells:
            m = np.zeros(channels * length)
            m[[c["at"] for c in case]] = [c["v"] for c in case]
            out.append(list(m.reshape(channels, length)))
        return pd.Series(out, dtype=object)

    return fill


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of a user's events in order of time: one channel, lengths differ."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col("value").cast("double").alias("value"))))
    return rows.groupBy(F.col("user_id").alias("case_id")).agg(F.array(F.transform(ordered, lambda e: e["value"])).alias("x"))


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums of a user's events, a channel each type in order of its name, days without events 0."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.to_date("ts")
    span = rows.agg(F.min(day).alias("lo"), F.datediff(F.max(day), F.min(day)).alias("n"), F.array_sort(F.collect_set("event_type")).alias("types")).first()
    ch = F.array_position(F.array(*map(F.lit, span.types)), F.col("event_type")) - 1
    sums = rows.groupBy(F.col("user_id").alias("case_id"), ch.alias("ch"), F.datediff(day, F.lit(span.lo)).alias("t")).agg(F.sum("value").alias("v"))
    held = sums.groupBy("case_id").agg(F.collect_list(F.struct((F.col("ch") * (span.n + 1) + F.col("t")).cast("long").alias("at"), F.col("v").cast("double").alias("v"))).alias("cells"))
    return held.select("case_id", _dense(len(span.types), span.n + 1)("cells").alias("x"))


def supplier_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly sums of a supplier's line prices: one channel, months in order, those without lines left out."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sums = rows.groupBy(F.col("l_suppkey").alias("case_id"), F.trunc("l_shipdate", "month").alias("t")).agg(F.sum("l_extendedprice").alias("v"))
    return from_long(sums.withColumn("ch", F.lit(0)))


def customer_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's order prices in order of date, with the account balance as target."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    prices = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", F.col("o_totalprice").cast("double").alias("p"))))
    series = orders.groupBy(F.col("o_custkey").alias("case_id")).agg(F.array(F.transform(prices, lambda e: e["p"])).alias("x"))
    balance = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("case_id"), F.col("c_acctbal").cast("double").alias("y"))
    return series.join(balance, "case_id")
