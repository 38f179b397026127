"""Returns, trading calendars and their overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite, lenient_double

MARKET_PRICE = ("adj_close", "close")
STOCK_PRICE = ("adj_close", "Adj Close", "adjusted_close", "close", "Close")
STOCK_KEY = ("symbol", "ticker", "Symbol", "Ticker")


def first_column(df: DataFrame, candidates: Sequence[str]) -> str:
    """The first candidate that df has; a ValueError names them if it has none."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of the columns {list(candidates)} in {df.columns}")


def returns(prices: DataFrame, price: str, date: str = "date", by: str | None = None, fill: str = "none", name: str = "ret", only_finite: bool = True) -> DataFrame:
    """Simple returns in date order, per key if by is given, without rows that have none.

    fill 'ffill' carries the last price over gaps first; 'none' lets a gap take the return before and after it.  A price
    of zero gives no return.  Without by there is one partition, whose size is the number of days.
    """
    if fill not in ("none", "ffill"):
        raise ValueError(f"fill is 'none' or 'ffill', not {fill!r}")
    order = Window.partitionBy(by).orderBy(date) if by else Window.orderBy(date)
    df = prices.withColumn("__p", lenient_double(F.col(price)))
    if fill == "ffill":
        df = df.withColumn("__p", F.last("__p", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    df = df.withColumn(name, F.try_divide(F.col("__p"), F.lag("__p").over(order)) - 1)
    keep = df.where(finite(F.col(name))) if only_finite else df.where(F.col(name).isNotNull())
    return keep.select(*([by] if by else []), date, name)


def market_returns(market: DataFrame, date: str = "date", basis: str = "price", fill: str = "none") -> DataFrame:
    """(Date, MarketReturn); a MarketReturn column that is there already is kept."""
    if "MarketReturn" in market.columns:
        return market.select(F.col(date).alias("Date"), lenient_double(F.col("MarketReturn")).alias("MarketReturn")).na.drop()
    price = first_column(market, MARKET_PRICE if basis == "price" else (basis,))
    return returns(market, price, date, fill=fill, name="MarketReturn").select(F.col(date).alias("Date"), "MarketReturn").na.drop()


def stock_returns(stocks: DataFrame, date: str = "date", fill: str = "none") -> DataFrame:
    """(Ticker, Date, Return)."""
    key = first_column(stocks, STOCK_KEY)
    if "Return" in stocks.columns:
        out = stocks.select(F.col(key).alias("Ticker"), F.col(date).alias("Date"), lenient_double(F.col("Return")).alias("Return"))
        return out.na.drop()
    price = first_column(stocks, STOCK_PRICE)
    out = returns(stocks.where(F.col(key).isNotNull()), price, date, by=key, fill=fill, name="Return")
    return out.select(F.col(key).alias("Ticker"), F.col(date).alias("Date"), "Return").na.drop()


def trading_day(df: DataFrame) -> str:
    """The column of days: trading_date if there, else date."""
    return first_column(df, ("trading_date", "date"))


def overlap(stock: DataFrame, market: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides on their common dates only."""
    days = stock.select("Date").intersect(market.select("Date"))
    return stock.join(days, "Date", "left_semi"), market.join(days, "Date", "left_semi")


def calendar(stock: DataFrame, date: str = "Date") -> DataFrame:
    """(date, i): every civil day from the first trading day to the last, with the index of the latest trading day.

    The result has a row per civil day between two dates, so its size is bounded by the years covered, not by the rows.
    """
    days = stock.select(F.col(date).alias("date")).where("date is not null").distinct()
    indexed = days.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("i"))
    span = days.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("date"))
    dense = span.join(indexed, "date", "left")
    return dense.select("date", F.last("i", ignorenulls=True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("i"))
