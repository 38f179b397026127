"""The generic tables seen as prices, markets, events and panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def prices(spark: SparkSession, d: str) -> DataFrame:
    """(ticker, date, price): a nation's mean line price on each weekday."""
    line = table(spark, d, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date"), "l_extendedprice").where(F.weekday("date") < 5)
    supplier = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # nations are fixed
    # sums per supplier and day first, so that the join moves few rows
    part = line.groupBy("l_suppkey", "date").agg(F.sum("l_extendedprice").alias("s"), F.count("l_extendedprice").alias("n"))
    joined = part.join(supplier.select("s_suppkey", F.col("n_name").alias("ticker")), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("ticker", "date").agg((F.sum("s") / F.sum("n")).alias("price"))


def market(p: DataFrame) -> DataFrame:
    """(date, close): the mean price of a day."""
    return p.groupBy("date").agg(F.avg("price").alias("close"))


def events(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, Ticker, EventDate, Sentiment, industry): orders as filings."""
    customer = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("EventDate"), F.col("o_totalprice").alias("Sentiment"))
    joined = orders.join(customer.select("c_custkey", F.col("n_name").alias("Ticker"), F.col("c_mktsegment").alias("industry")), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("o_orderkey").alias("event_id"), "Ticker", "EventDate", "Sentiment", "industry")


def rates(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, pos_rate, neg_rate, lmmd_net) of an order's lines."""
    line = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.avg("l_discount").alias("pos_rate"), F.avg("l_tax").alias("neg_rate"))
    return line.withColumn("lmmd_net", F.col("pos_rate") - F.col("neg_rate"))
