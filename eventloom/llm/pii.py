"""Operator 10: personal data, by base patterns and bootstrapped contextual extraction.

Base patterns find e-mail addresses, IP addresses, card numbers and phone numbers; these are the seeds.  Every seed and
every other token that looks like an identifier has lexical patterns: the words to its left and right, and its own shape
beside one of them.  Spark scores the graph of patterns and instances in turns: a pattern's confidence is the smoothed share
of its instances' scores, an instance's score is its best pattern's confidence (patterns of one instance overlap, so they
are no independent evidence), and seeds stay at 1.  Patterns count from LEAST_SEEDS instances that are seeds or were found
in an earlier turn; those of high confidence mark unseen identifiers.

Cases: null and empty texts have no spans.  Texts of any length are whole.  Spans are in code points, end exclusive.  Rows
are told apart by doc_id and text, so that rows that repeat an id, or have none, get the spans of their own texts.  Only the
id and text columns are read, so others may have any name.  An empty table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, staged, table

KINDS = ("email", "ip", "card", "phone", "context")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")
_WORD = re.compile(r"\S+")
_LETTER = re.compile("[a-z]+")
#: Tokens that look like identifiers: no white space, six characters or more, and LEAST_DIGITS digits or an @ in them.
TOKEN = re.compile(r"(?<![^\s\"'(\[{<=:,;|])[A-Za-z0-9][A-Za-z0-9._%+@/-]{4,}[A-Za-z0-9](?![A-Za-z0-9._%+@/-]*[A-Za-z0-9@])")
LEAST_DIGITS = 4
#: A pattern counts from so many distinct seeds and found instances; an instance is found from this score; so many turns of scoring.
LEAST_SEEDS = 5
LEAST_SCORE = 0.5
TURNS = 3
SMOOTHING = 1.0


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d)) // 10 + (2 * int(d)) % 10 for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and non-overlapping per kind, without what fails their tests."""
    out = []
    if "@" in text:
        out += [(0, *m.span()) for m in EMAIL.finditer(text)]
    if not _DIGITS.search(text):
        return out
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() >= 16 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


def tidy(word: str) -> str:
    """A word in lower case with digits masked."""
    return _DIGITS.sub("0", word.lower())


class Words:
    """The words of a text by position."""

    def __init__(self, text: str):
        self.text = text
        spans = [m.span() for m in _WORD.finditer(text)]
        self.starts, self.ends = [s for s, _ in spans], [e for _, e in spans]

    def word(self, i: int) -> str:
        return tidy(self.text[self.starts[i] : self.ends[i]]) if 0 <= i < len(self.starts) else ""

    def patterns(self, start: int, end: int) -> list[str]:
        """Lexical patterns of a span: the words beside it, and its shape with one of them."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        before = [x for x in (self.word(i - 2), self.word(i - 1), tidy(self.text[self.starts[i] : start])) if x][-2:]
        after = tidy(self.text[end : max(end, self.ends[j])]) or self.word(j + 1) or "$"
        left = before[-1] if before else "^"
        shape = _LETTER.sub("a", tidy(self.text[start:end]))
        out = [f"L {left}", f"R {after}", f"LR {left} {after}", f"SL {shape} {left}", f"SR {shape} {after}"]
        return [*out, f"LL {before[0]} {left}"] if len(before) == 2 else out


def found_in(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str, bool, list[str]]]]:
    """Base spans, and candidates (start, end, instance, whether it is a seed, patterns)."""
    base = base_spans(text)
    words = Words(text) if base or _DIGITS.search(text) or "@" in text else None
    cand = [(s, e, f"{KINDS[k]} {text[s:e]}", True, words.patterns(s, e)) for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    if words:
        at = 0
        for m in TOKEN.finditer(text):
            s, e = m.span()
            if "@" not in m[0] and len(_DIGITS.findall(m[0])) < LEAST_DIGITS:
                continue
            while at < len(taken) and taken[at][1] <= s:
                at += 1
            if not any(a < e and s < b for a, b in taken[max(at - 4, 0) : at + 4]):
                cand.append((s, e, m[0], False, words.patterns(s, e)))
    return base, cand


def row_hash() -> Column:
    return F.xxhash64("doc_id", "text")


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, row, base array<struct<k,s,e>>, cand array<struct<s,e,inst,seed,pats>>) of (doc_id, text); row tells rows apart."""

    def make():
        def fn(cols):
            base, cand = [], []
            for t in cols["text"]:
                b, c = found_in(t or "")
                base.append([{"k": k, "s": s, "e": e} for k, s, e in b])
                cand.append([{"s": s, "e": e, "inst": i, "seed": z, "pats": p} for s, e, i, z, p in c])
            return {"doc_id": cols["doc_id"], "row": cols["row"], "base": base, "cand": cand}

        return fn

    return map_arrow(docs.select("doc_id", row_hash().alias("row"), "text"), make, "doc_id long, row long, base array<struct<k:int,s:int,e:int>>, cand array<struct<s:int,e:int,inst:string,seed:boolean,pats:array<string>>>")


def bootstrap(found: DataFrame, scratch: Scratch, turns: int = TURNS, least_seeds: int = LEAST_SEEDS, least_score: float = LEAST_SCORE, smoothing: float = SMOOTHING) -> DataFrame:
    """(inst, score): identifiers that aren't seeds and reach least_score."""
    one = found.select(F.explode("cand").alias("c")).select("c.inst", "c.seed", F.explode("c.pats").alias("pat"))
    edges = scratch.staged(one.groupBy("inst", "pat").agg(F.max("seed").alias("seed")))
    score = edges.where("false").select("inst", F.lit(0.0).alias("score"))
    for _ in range(turns):
        scored = edges.join(score, "inst", "left").select("pat", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"))
        pattern = scored.groupBy("pat").agg((F.sum("score") / (F.count("*") + smoothing)).alias("conf"), F.count_if(F.col("score") >= least_score).alias("n")).where(F.col("n") >= least_seeds)
        score = scratch.staged(edges.where("not seed").join(pattern, "pat").groupBy("inst").agg(F.round(F.max("conf"), 9).alias("score")))
    return score.where(F.col("score") >= least_score)


def detect(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """(doc_id, base, extra) and row: spans (k, s, e) of the base patterns and of identifiers found by context."""
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.staged(extract(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))))
        new = bootstrap(found, scratch, **options)
        at = found.select("row", F.explode("cand").alias("c")).where("not c.seed").select("row", "c.s", "c.e", "c.inst")
        extra = at.join(new.select("inst"), "inst").groupBy("row").agg(F.sort_array(F.collect_set(F.struct(F.lit(4).alias("k"), "s", "e"))).alias("extra"))
        none = F.array().cast("array<struct<k:int,s:int,e:int>>")
        return staged(found.select("doc_id", "row", "base").join(extra, "row", "left").select("doc_id", "row", "base", F.coalesce("extra", none).alias("extra")))


def report(found: DataFrame) -> DataFrame:
    names = F.array(*(F.lit(k) for k in KINDS))
    spell = lambda x: F.array_join(F.transform(F.sort_array(x), lambda y: F.concat_ws(":", F.get(names, y["k"]), y["s"].cast("string"), y["e"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(spell(F.col("base")), 256).alias("base_sha256"), spell(F.concat("base", "extra")).alias("spans"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans are one, named by the first."""
    found = detect(docs.select("doc_id", "text"), **options).select(F.col("doc_id").alias("__doc"), F.col("row").alias("__row"), F.concat("base", "extra").alias("__spans")).where(F.size("__spans") > 0)
    found = found.groupBy("__doc", "__row").agg(F.first("__spans").alias("__spans"))  # rows of one id and text have the same spans
    names = F.array(*(F.lit(f"[{k}]") for k in KINDS))
    by_start = F.sort_array(F.transform("__spans", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        new = F.array(F.substring(docs["text"], acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0))), F.get(names, x["k"]))
        return F.when(x["s"] < acc["at"], F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(x["e"].alias("at"), F.concat(acc["out"], new).alias("out")))

    masked = F.aggregate(by_start, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(docs["text"], acc["at"] + 1, F.length(docs["text"]))))
    row = F.xxhash64(docs["doc_id"].cast("long"), docs["text"])
    out = docs.join(found, (row == found["__row"]) & docs["doc_id"].eqNullSafe(found["__doc"]), "left")
    text = F.when(found["__spans"].isNull() | docs["text"].isNull(), docs["text"]).otherwise(masked)
    return out.select(*(text.alias("text") if c == "text" else docs[c] for c in docs.columns))


def op10_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(detect(table(spark, sf_dir, "documents")))
