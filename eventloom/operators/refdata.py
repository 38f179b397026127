"""Reference data: code lists, constituents, industries and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import first_four_digits, lookup_code, pad_code, securities_code

#: Names of the code lists' columns and values, by language.
COLUMNS = {
    "en": {"code": "EDINET Code", "listed": "Listed company / Unlisted company", "kind": "Type of Submitter", "industry": "Submitter's industry", "sec": "Securities Identification Code"},
    "ja": {"code": "ＥＤＩＮＥＴコード", "listed": "上場区分", "kind": "提出者種別", "industry": "提出者業種", "sec": "証券コード"},
}
VALUES = {"en": ("Listed company", "内国法人・組合"), "ja": ("上場", "内国法人・組合")}


def steps(df: DataFrame, conditions: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet all conditions, and one row of counts: all rows, and those left after each condition in turn."""
    so_far, counts = F.lit(True), [F.count("*").alias("n_all")]
    for name, c in conditions:
        so_far = so_far & F.coalesce(c, F.lit(False))
        counts.append(F.count_if(so_far).alias(f"n_{name}"))
    return df.where(so_far), df.agg(*counts)


def valid_code(x: Column) -> Column:
    """A securities code is there and isn't a three-character text."""
    return x.isNotNull() & (F.length(x.cast("string")) != 3)


def listed_companies(codelist: DataFrame, lang: str = "en") -> tuple[DataFrame, DataFrame]:
    """Listed domestic companies with a code, and the counts after each step."""
    c, (listed, kind) = COLUMNS[lang], VALUES[lang]
    col = lambda k: F.col(f"`{c[k]}`")
    return steps(codelist, [("listed", col("listed") == listed), ("domestic", col("kind") == kind), ("coded", valid_code(col("sec")))])


def sorted_industries(codelist: DataFrame, column: str) -> DataFrame:
    """The distinct industries in order."""
    return codelist.select(F.col(f"`{column}`").alias("industry")).where("industry is not null").distinct().orderBy("industry")


def constituents(raw: DataFrame) -> DataFrame:
    """Index members with every column of the schema: codes of four digits, symbols made from codes wherever one is
    missing (all of them, then), dates as dates, and null where a column isn't there."""
    df = raw.withColumn("code", pad_code(F.col("code").cast("string")))
    for c in ("symbol", "company_ja", "name_ja", "sector_sub", "asof_date"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    gap = df.agg(F.count_if(F.col("symbol").isNull()).alias("__gaps"))
    df = df.crossJoin(F.broadcast(gap)).withColumn("symbol", F.when(F.col("__gaps") > 0, F.concat("code", F.lit(".T"))).otherwise(F.col("symbol")))
    return df.select("code", "symbol", "company_ja", "name_ja", "sector_sub", F.col("asof_date").try_cast("date").alias("asof_date"))


def join_codelist(members: DataFrame, codelist: DataFrame, sec: str, code: str = "code") -> DataFrame:
    """Members with their code list rows (left join on normalised codes); key columns of both sides are kept."""
    return members.withColumn("__k", pad_code(F.col(code).cast("string"))).join(codelist.withColumn("__k", securities_code(F.col(f"`{sec}`"))), "__k", "left").drop("__k")


def industry_map(ja: DataFrame, en: DataFrame) -> DataFrame:
    """(edinet_code, industry_jp, industry_en): full outer join on trimmed codes; null codes are dropped."""
    side = lambda df, lang, name: df.select(F.trim(F.col(f"`{COLUMNS[lang]['code']}`")).alias("edinet_code"), F.col(f"`{COLUMNS[lang]['industry']}`").alias(name)).where("edinet_code is not null")
    return side(ja, "ja", "industry_jp").join(side(en, "en", "industry_en"), "edinet_code", "full")


def with_canonical(df: DataFrame, label: str = "jp", canonical: str | None = "industry") -> DataFrame:
    """The label's industry as the canonical column; 'both' keeps both and takes the Japanese one."""
    if label not in ("jp", "en", "both"):
        raise ValueError(f"label is 'jp', 'en' or 'both', not {label!r}")
    if canonical:
        df = df.withColumn(canonical, F.col("industry_en" if label == "en" else "industry_jp"))
    return df if label == "both" else df.drop("industry_jp" if label == "en" else "industry_en")


def attach_by_code(panel: DataFrame, industries: DataFrame, label: str = "jp", canonical: str | None = "industry", code: str = "edinet_code") -> DataFrame:
    """panel with the industries of its company codes (left join)."""
    out = panel.withColumn("__k", F.trim(F.col(code))).join(industries.withColumnRenamed("edinet_code", "__k"), "__k", "left").drop("__k")
    return with_canonical(out, label, canonical)


def attach_by_ticker(panel: DataFrame, codelist: DataFrame, industries: DataFrame, ticker: str = "Ticker", sec: str = "証券コード", code: str = "ＥＤＩＮＥＴコード", label: str = "jp", canonical: str | None = "industry") -> DataFrame:
    """panel with the industries of its tickers, through the code list's securities codes (two left joins)."""
    by_sec = codelist.select(pad_code(first_four_digits(F.col(f"`{sec}`"))).alias("__sec"), F.trim(F.col(f"`{code}`")).alias("__code"))
    out = panel.withColumn("__sec", first_four_digits(F.col(ticker))).join(by_sec, "__sec", "left")
    out = out.join(industries.withColumnRenamed("edinet_code", "__code"), "__code", "left").drop("__sec", "__code")
    return with_canonical(out, label, canonical)


def lookup(queries: DataFrame, key: str, entries: DataFrame, entry_key: str, value: str, order: str, normalise=None) -> DataFrame:
    """queries with the value of the first entry, by order, whose normalised key agrees; null without one."""
    norm = normalise or (lambda c: F.upper(F.trim(c.cast("string"))))
    first = entries.select(norm(F.col(f"`{entry_key}`")).alias("__k"), F.col(f"`{value}`").alias("__v"), F.col(order).alias("__o")).where("__k is not null and __v is not null")
    first = first.groupBy("__k").agg(F.min_by("__v", F.struct("__o", "__v")).alias("found"))
    return queries.withColumn("__k", norm(F.col(key))).join(first, "__k", "left").drop("__k")


def _one(merged: DataFrame, key: str, value: str, wanted, normalise=None) -> str | None:
    norm = normalise or (lambda c: F.upper(F.trim(c.cast("string"))))
    df = merged.select(norm(F.col(f"`{key}`")).alias("k"), F.col(f"`{value}`").alias("v"), F.monotonically_increasing_id().alias("o"))
    row = df.where((F.col("k") == norm(F.lit(str(wanted)))) & F.col("v").isNotNull()).orderBy("o").first()
    return row and str(row["v"])


def sec_of_code(code: str, merged: DataFrame) -> str | None:
    return _one(merged, "EDINET Code", "Securities Identification Code", code)


def code_of_sec(sec: str | int, merged: DataFrame) -> str | None:
    return _one(merged, "Securities Identification Code", "EDINET Code", sec, lookup_code)


def symbol_of_code(code: str, merged: DataFrame) -> str | None:
    return _one(merged, "EDINET Code", "symbol", code)


def code_of_symbol(symbol: str, merged: DataFrame) -> str | None:
    return _one(merged, "symbol", "EDINET Code", symbol)


def carry_headers(lines: DataFrame, header: Column, order: str = "line_no", by: Sequence[str] = ("path",)) -> DataFrame:
    """lines with the value of the latest header line up to each, per file."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("header", F.last(header, ignorenulls=True).over(w))
