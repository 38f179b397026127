"""Operator 1: quality rules.  Base rules, then a hashed n-gram log-likelihood ratio.

Word unigrams and bigrams are hashed into buckets.  Two smoothed multinomials over the buckets, one of trusted documents
and one of the whole raw corpus, give each bucket a log ratio; a document's score is the sum over its n-grams divided by
their number, and it is kept when the score reaches a fixed threshold.  Everything is DataFrame expressions.

Cases: null and empty texts have no words and fail the base rules.  A text without n-grams has score 0.  Very long texts
are whole.  Repeated rows are judged each by itself.  Without trusted rows both multinomials are flat or equal to the
corpus, and the threshold decides.  Only the id and text columns are read, so others may have any name.  An empty table
gives an empty table.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, words

BUCKETS = 16384
WINDOW = 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Least mean log ratio (nats per n-gram) of a kept document.
THRESHOLD = -0.1
#: At most so many trusted rows are used, the first by hash of the id.
MOST_TRUSTED = 50_000


def repeat_words(hashes: Column) -> Column:
    """How many words lie in windows of WINDOW words that occur twice or more; hashes are the words' 64-bit hashes."""
    n = F.size(hashes)
    grams = F.transform(F.slice(hashes, F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(hashes, i + k) for k in range(1, WINDOW))))
    placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def same(x: Column, y: Column) -> Column:
        return F.coalesce(x["g"] == y["g"], F.lit(False))

    def covered(placed: Column) -> Column:
        m = F.size(placed)
        at = F.filter(placed, lambda x, k: same(x, F.get(placed, k + 1)) | ((k > 0) & same(x, F.get(placed, F.when(k > 0, k - 1).otherwise(m)))))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            F.sort_array(F.transform(at, lambda x: x["i"])),
            start,
            lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).cast("long").alias("n"), (i + WINDOW).alias("end")),
            lambda acc: acc["n"],
        )

    # the sorted array is bound once by a one-element transform, so that it isn't sorted for each reference to it
    slow = F.get(F.transform(F.array(placed), covered), 0)
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(slow)


def base_rules(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, hashes, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    t = F.coalesce(docs[text], F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    df = docs.select(
        docs[doc_id].alias("doc_id"),
        F.transform(words(docs[text]), lambda w: F.xxhash64(w)).alias("hashes"),
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    df = df.select(
        "doc_id", "hashes", F.size("hashes").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeat_words(F.col("hashes")).alias("n_repeat_words"),
    )
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def buckets_of(hashes: Column, buckets: int) -> Column:
    """Buckets of a document's word unigrams and bigrams."""
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    n = F.greatest(F.size(hashes) - 1, F.lit(0))
    two = F.transform(F.slice(hashes, F.lit(1), n), lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def fit_ratio(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, most_trusted: int = MOST_TRUSTED, text: str = "text", doc_id: str = "doc_id") -> list[float]:
    """Log ratio of trusted to raw by bucket.  Counts cover all rows; the driver gets one row a bucket."""
    chosen = trusted.select(trusted[doc_id].alias("doc_id")).where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_trusted).select("doc_id", F.lit(1).alias("t"))
    df = docs.select(docs[doc_id].alias("doc_id"), F.transform(words(docs[text]), lambda w: F.xxhash64(w)).alias("hashes"))
    df = df.join(F.broadcast(chosen), "doc_id", "left").select(F.coalesce("t", F.lit(0)).alias("t"), F.explode(buckets_of(F.col("hashes"), buckets)).alias("b"))
    raw, target = [0] * buckets, [0] * buckets
    for b, n, t in df.groupBy("b").agg(F.count("*"), F.sum("t")).collect():
        raw[b], target[b] = n, t
    all_raw, all_target = sum(raw) + buckets, sum(target) + buckets
    return [round(math.log((t + 1) / all_target) - math.log((n + 1) / all_raw), 6) for t, n in zip(target, raw, strict=True)]


def score(hashes: Column, ratio: list[float]) -> Column:
    """Mean log ratio of a document's n-grams; 0 without any."""
    literal = F.from_json(F.lit(json.dumps(ratio)), "array<double>")
    grams = buckets_of(hashes, len(ratio))
    total = F.aggregate(grams, F.lit(0.0), lambda acc, b: acc + F.get(literal, b))
    n = 2 * F.size(hashes) - 1
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Every document's base figures, score and verdict."""
    ratio = fit_ratio(docs, trusted, **options)
    names = {k: v for k, v in options.items() if k in ("text", "doc_id")}
    df = base_rules(docs, **names).withColumn("score", score(F.col("hashes"), ratio)).drop("hashes")
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))
