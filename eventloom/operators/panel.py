"""The panel merge and its quality counts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lenient_date

REQUIRED = ("document_score", "lmmd_net", "pos_rate", "neg_rate")
#: Columns that the merged panel doesn't carry.
UNWANTED = ("filename_x", "filename_y", "edinet_code_x", "edinet_code_y", "filing_date_parsed", "status", "token_count", "pos_count", "neg_count")


def with_date(df: DataFrame, date: str = "filing_date", legacy: str = "filing_date_parsed") -> DataFrame:
    """df with the legacy name of its date column replaced, and the column read as a date."""
    if date not in df.columns and legacy in df.columns:
        df = df.withColumnRenamed(legacy, date)
    if date not in df.columns:
        raise ValueError(f"no column {date!r} in {df.columns}")
    return df if dict(df.dtypes)[date] == "date" else df.withColumn(date, lenient_date(F.substring(F.col(date).cast("string"), 1, 10)))


def require(df: DataFrame, columns: Iterable[str], what: str = "table") -> None:
    """A ValueError that names the columns that df lacks."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"{what} lacks the columns {missing}")


def merge(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", dropna: Sequence[str] | None = None) -> DataFrame:
    """An equality join whose other common columns get _x and _y; rows without a key are dropped before, and rows that
    lack one of dropna after.  Repeated keys fan out."""
    require(left, keys, "left table")
    require(right, keys, "right table")
    both = (set(left.columns) & set(right.columns)) - set(keys)
    named = lambda df, end: df.select(*(F.col(c).alias(c + end if c in both else c) for c in df.columns))
    out = named(left.na.drop(subset=list(keys)), "_x").join(named(right.na.drop(subset=list(keys)), "_y"), list(keys), {"outer": "full"}.get(how, how))
    if dropna:
        require(out, dropna, "merged table")
        out = out.na.drop(subset=list(dropna))
    return out


def build_panel(scores: DataFrame, lexicon: DataFrame, how: str = "inner", dropna: Sequence[str] | None = REQUIRED) -> DataFrame:
    """Scores and lexicon rates by (symbol, filing_date), without the columns that neither stage needs."""
    out = merge(with_date(scores), with_date(lexicon), ["symbol", "filing_date"], how, dropna)
    return out.drop(*UNWANTED)


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys, and rows beyond the first of their key."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_keys"))


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the number of nulls of each column."""
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns))


def panel_qc(left: DataFrame, right: DataFrame, merged: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row of counts of both inputs and of the result."""
    name = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns))
    return name(key_counts(left, keys), "left").crossJoin(name(key_counts(right, keys), "right")).crossJoin(name(key_counts(merged, keys), "merged")).crossJoin(null_counts(merged, columns))
