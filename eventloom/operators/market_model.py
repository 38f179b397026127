"""Market models: one regression of stock returns on market returns per ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lenient_double


def matched(stock: DataFrame, market: DataFrame) -> DataFrame:
    """(Ticker, Date, Return, MarketReturn) on the dates of both."""
    m = market.select("Date", lenient_double(F.col("MarketReturn")).alias("MarketReturn"))
    s = stock.select("Ticker", "Date", lenient_double(F.col("Return")).alias("Return"))
    return s.join(m, "Date").na.drop(subset=["Ticker", "Return", "MarketReturn"]).select("Ticker", "Date", "Return", "MarketReturn")


def market_model(stock: DataFrame, market: DataFrame) -> DataFrame:
    """(Ticker, alpha, beta) by least squares; tickers of one observation or without variance of the market are left out."""
    fit = matched(stock, market).groupBy("Ticker").agg(F.regr_intercept("Return", "MarketReturn").alias("alpha"), F.regr_slope("Return", "MarketReturn").alias("beta"))
    return fit.where("alpha is not null and beta is not null and not isnan(alpha) and not isnan(beta)")


def observations(stock: DataFrame, market: DataFrame) -> DataFrame:
    """One row: fewest, median and most observations of a ticker, and the number of tickers."""
    size = matched(stock, market).groupBy("Ticker").agg(F.count("*").alias("n"))
    return size.agg(F.min("n").alias("n_min"), F.median("n").alias("n_median"), F.max("n").alias("n_max"), F.count("*").alias("tickers"))
