"""Cumulative abnormal returns around events, for all windows in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .market_model import matched
from .returns import calendar

WINDOWS = ((0, 0), (0, 1), (-1, 1), (-2, 2), (-3, 3))


def snap(events: DataFrame, days: DataFrame, date: str = "EventDate", max_staleness: int | None = None) -> DataFrame:
    """events with i, the index of the latest trading day up to their date; events before the first day are dropped.

    A backward as-of join as an equality join: days (from calendar()) has a row for every civil day.  Events after the
    last day get the last day, however late they are, unless max_staleness (in days) is given.  days is broadcast; it has
    a row per civil day of the calendar.
    """
    last = days.agg(F.max("date").alias("__last"))
    df = events.join(F.broadcast(last)).withColumn("__day", F.least(F.col(date), F.col("__last")))
    if max_staleness is not None:
        df = df.where(F.datediff(F.col(date), F.col("__last")) <= max_staleness)
    return df.join(F.broadcast(days.withColumnRenamed("date", "__day")), "__day").drop("__day", "__last")


def abnormal(stock: DataFrame, market: DataFrame, parameters: DataFrame) -> DataFrame:
    """(Ticker, Date, ar): returns less the model's; tickers without parameters have alpha 0 and beta 1."""
    known = parameters.groupBy("Ticker").agg(F.max_by("alpha", F.struct("alpha", "beta")).alias("alpha"), F.max_by("beta", F.struct("alpha", "beta")).alias("beta"))
    df = matched(stock, market).join(known, "Ticker", "left")
    return df.select("Ticker", "Date", (F.col("Return") - (F.coalesce("alpha", F.lit(0.0)) + F.coalesce("beta", F.lit(1.0)) * F.col("MarketReturn"))).alias("ar"))


def cumulate(events: DataFrame, stock: DataFrame, market: DataFrame, parameters: DataFrame, windows: Sequence[tuple[int, int]] = WINDOWS, max_staleness: int | None = None) -> DataFrame:
    """events (Ticker, EventDate, ...) with window_start, window_end and CAR, a row per event and window with a return in it.

    Windows count trading days of the calendar of all stock returns and are cut at its ends.  Events are reduced to their
    distinct (Ticker, day) before offsets are exploded, so that work grows with tickers and days, not with events.
    """
    windows = list(windows)
    if not windows:
        raise ValueError("no windows")
    days = calendar(stock)
    index = days.groupBy("i").agg(F.min("date").alias("Date"))  # the first civil day of an index is the trading day
    ar = abnormal(stock, market, parameters).join(F.broadcast(index), "Date").select("Ticker", F.col("i").alias("__at"), "ar")
    at = snap(events, days, max_staleness=max_staleness)
    lo, hi = min(a for a, _ in windows), max(b for _, b in windows)
    spots = at.select("Ticker", "i").where("Ticker is not null").distinct()
    wide = spots.withColumn("__off", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).withColumn("__at", F.col("i") + F.col("__off")).join(ar, ["Ticker", "__at"])
    sums = wide.groupBy("Ticker", "i").agg(*(F.sum(F.when(F.col("__off").between(a, b), F.col("ar"))).alias(f"__w{k}") for k, (a, b) in enumerate(windows)))
    rows = F.array(*(F.struct(F.lit(a).alias("window_start"), F.lit(b).alias("window_end"), F.col(f"__w{k}").alias("CAR")) for k, (a, b) in enumerate(windows)))
    by_window = sums.select("Ticker", "i", F.inline(F.filter(rows, lambda x: x["CAR"].isNotNull())))
    return at.join(by_window, ["Ticker", "i"]).drop("i")
