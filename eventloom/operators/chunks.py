"""Nested document analyses, and lexicon tone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lenient_double


def chunk_scores(docs: DataFrame, key: str, chunks: str = "chunks") -> DataFrame:
    """Mean, median and number of a document's chunk scores, in its own row; scores that are no numbers don't count.

    Everything happens inside arrays, so nothing is shuffled.  Without scores, mean and median are 0.
    """
    scores = F.filter(F.transform(F.coalesce(F.col(chunks), F.array()), lambda c: lenient_double(c["score"])), lambda x: x.isNotNull())
    df = docs.withColumn("__s", F.sort_array(scores))
    n = F.size("__s")
    middle = (F.get("__s", F.floor((n - 1) / 2).cast("int")) + F.get("__s", F.floor(n / 2).cast("int"))) / 2
    mean = F.aggregate("__s", F.lit(0.0), lambda a, x: a + x) / F.when(n > 0, n)
    return df.select(key, F.coalesce(mean, F.lit(0.0)).alias("mean_chunk_score"), F.coalesce(middle, F.lit(0.0)).alias("median_chunk_score"), n.cast("long").alias("num_chunks"), (F.size(F.coalesce(F.col(chunks), F.array())) - n).cast("long").alias("bad_chunks"))


def tone(docs: DataFrame, key: str, text: str, positive: list[str], negative: list[str]) -> DataFrame:
    """Token, positive and negative counts, their rates, and the net rate, by short word lists."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z]+"), lambda w: w != "")
    df = docs.select(key, words.alias("__w"))
    count = lambda listed: F.size(F.filter("__w", lambda w: w.isin(*listed))).cast("long")
    df = df.select(key, F.size("__w").cast("long").alias("token_count"), count(positive).alias("pos_count"), count(negative).alias("neg_count"))
    rate = lambda c: F.when(F.col("token_count") > 0, F.col(c) / F.col("token_count")).otherwise(F.lit(0.0))
    return df.withColumns({"pos_rate": rate("pos_count"), "neg_rate": rate("neg_count")}).withColumn("lmmd_net", F.col("pos_rate") - F.col("neg_rate"))
