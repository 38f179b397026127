"""Operator 7: secret scans.  Base patterns, then character Markov models.

First-order character models of random strings, one for each alphabet that secrets are spelled in, and one of ordinary
identifiers score every long run of identifier characters: the log-likelihood ratio of the likeliest alphabet's model to
the identifiers'.  The random models are trained from labelled samples, digests spelled here in that alphabet; the identifier
model from labelled samples too, joined words in the usual styles, and from all long runs of the corpus in which no base
pattern matches.  Rare pairs back off to single characters.  The threshold is fitted on samples that were not trained on.
Everything is DataFrame expressions; the driver gets one count per character pair.

Cases: null and empty texts have no spans.  Very long texts are whole.  Spans are in code points, end exclusive.
Repeated rows are scanned each by itself.  Only the id and text columns are read, so others may have any name.  An empty
table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The base patterns.  Minimum lengths stand in the pattern where that changes no match.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
RUN_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
#: Least log-likelihood ratio (nats) of a run as a whole, and per character before the threshold is fitted.
LEAST_TOTAL = 8.0
LEAST_MEAN = 0.25
SAMPLES = 3000
HELD_OUT = 1000
#: How many observations the single characters count for in a pair's row, and each character in theirs.
BACK_OFF = 4.0
PRIOR = 0.5
#: Words that the labelled identifiers are joined of.
PARTS = """account active address admin agent alias amount array async author auth backup base batch body buffer build button cache
call channel check child class clean client clock cloud code column command comment commit common config connect content
context control cookie copy count create cursor custom data database date debug decode default delete deploy device
directory document domain download driver editor element email empty encode engine entry error event example export factory
feature field file filter first folder format frame function global group handle handler hash header height helper history
host image import index info init input instance interface internal invalid item job key label language last layer layout
length level library limit line link list load local lock log login manager map max memory menu message metadata method min
mode model module monitor name network node notify null number object offset open option order output owner package page
param parent parse password path pattern payment pending percent permission plugin point policy pool port position prefix
process product profile project property provider proxy public query queue random range read record reference refresh
register release remote remove render report repository request reset resource response result retry return role root route
rule runtime sample schema scope screen script search section security select send sequence server service session settings
shared signal size source span stage start state static status storage stream string style submit support switch system table
target task template test text theme thread time timeout title token tool total trace track transfer tree trigger type update
upload url user utils valid value variable version view visible wait warning widget width window worker write zone""".split()


def spans(text: Column, pattern: str, kind: int, good=None) -> Column:
    """array<struct<s,k,e,m>> of the leftmost non-overlapping matches that are good(match).

    Starts follow from the lengths of the gaps between matches, which splitting by the same pattern gives.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<s:int,k:int,e:int,m:string>>")

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + F.length(x["g"])
            e = s + F.length(x["m"])
            one = F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"), x["m"].alias("m")))
            return F.struct(e.alias("at"), F.concat(acc["out"], one).alias("out"))

        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
        out = F.aggregate(pairs, start, step, lambda acc: acc["out"])
        return F.filter(out, lambda x: good(x["m"])) if good else out

    return F.get(F.transform(F.array(found), lambda m: F.when(F.size(m) == 0, empty).otherwise(placed(m))), 0)


def spell(found: Column, order: str) -> Column:
    """The spans as kind:start:end, by start and then kind ('start') or by kind and then start ('kind'), comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    first, second = ("s", "k") if order == "start" else ("k", "s")
    keys = F.transform(found, lambda x: F.struct(x[first].alias(first), x[second].alias(second), x["e"].alias("e")))
    return F.array_join(F.transform(F.sort_array(keys), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def base_spans(text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    return [
        spans(t, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12),
        spans(t, ACCESS, 1),
        spans(t, HEX, 2),
    ]


def digest(i: int, k: int = 0) -> bytes:
    return hashlib.sha256(f"{k}/{i}".encode()).digest()


#: The alphabets, each with what spells a digest in it.
SPELLINGS = (
    lambda d: d.hex(),
    lambda d: base64.b32encode(d).decode().rstrip("="),
    lambda d: base64.b64encode(d).decode().rstrip("="),
    lambda d: base64.urlsafe_b64encode(d).decode().rstrip("="),
    lambda d: "".join(RUN_CHARS[x % 62] for x in d),  # letters and digits
    lambda d: "".join(RUN_CHARS[26 + x % 36] for x in d),  # small letters and digits
)


def sample_strings(kind: int, n: int = SAMPLES, first: int = 0) -> list[str]:
    """Labelled random strings of an alphabet, of 16 to 40 characters."""
    return [(SPELLINGS[kind](digest(i)) + SPELLINGS[kind](digest(i, 1)))[: 16 + i % 25] for i in range(first, first + n)]


def sample_identifiers(n: int = SAMPLES, first: int = 0) -> list[str]:
    """Labelled identifiers: two to five words, joined in the usual styles, some with a number."""
    out = []
    for i in range(first, first + n):
        d = digest(i, 2)
        words = [PARTS[(d[2 * k] * 256 + d[2 * k + 1]) % len(PARTS)] for k in range(2 + d[20] % 4)]
        while sum(map(len, words)) < 16:
            words.append(PARTS[(d[21] * 256 + d[22] + len(words)) % len(PARTS)])
        style = (lambda w: "_".join(w), lambda w: "-".join(w), lambda w: "/".join(w), lambda w: w[0] + "".join(x.capitalize() for x in w[1:]), lambda w: "".join(x.capitalize() for x in w), lambda w: "_".join(w).upper(), lambda w: "".join(w))[d[23] % 7]
        out.append(style(words) + ("" if d[24] % 4 else f"{d[25] % 100}"))
    return out


def pair_counts(runs: DataFrame) -> list[tuple[str, int]]:
    """Counts of character pairs in the column run."""
    chars = F.split("run", "")
    pairs = runs.select(chars.alias("c")).select(F.explode(F.transform(F.slice("c", F.lit(1), F.size("c") - 1), lambda x, i: F.concat(x, F.get("c", i + 1)))).alias("p"))
    return [tuple(r) for r in pairs.groupBy("p").count().collect()]


def sampled_counts(samples: list[str]) -> list[tuple[str, int]]:
    return [(s[i : i + 2], 1) for s in samples for i in range(len(s) - 1)]


def log_model(counts: list[tuple[str, int]]) -> list[float]:
    """log P(b|a) of all pairs of characters, row by row; rare pairs back off to single characters."""
    n, at = len(RUN_CHARS), {c: i for i, c in enumerate(RUN_CHARS)}
    rows = [[0.0] * n for _ in range(n)]
    for p, k in counts:
        if len(p) == 2 and p[0] in at and p[1] in at:
            rows[at[p[0]]][at[p[1]]] += k
    single = [PRIOR + sum(r[b] for r in rows) for b in range(n)]
    total = sum(single)
    return [math.log((rows[a][b] + BACK_OFF * single[b] / total) / (sum(rows[a]) + BACK_OFF)) for a in range(n) for b in range(n)]


class Markov:
    """Log ratios of each alphabet's model to the identifiers', and the least mean ratio of a secret."""

    def __init__(self, ratios: list[list[float]], least_mean: float):
        self.ratios, self.least_mean = ratios, least_mean

    def score(self, run: str) -> float:
        n, at = len(RUN_CHARS), [RUN_CHARS.index(c) for c in run]
        return max(sum(r[a * n + b] for a, b in zip(at, at[1:], strict=False)) for r in self.ratios)


def markov_score(run: Column, ratios: list[list[float]]) -> Column:
    """Log-likelihood ratio of a run's character pairs, by the likeliest alphabet."""
    n = len(RUN_CHARS)
    codes = F.transform(F.split(run, ""), lambda c: F.call_function("instr", F.lit(RUN_CHARS), c) - 1)

    def total(ratio: list[float], codes: Column) -> Column:
        literal = F.from_json(F.lit(json.dumps(ratio)), "array<double>")
        start = F.struct(F.lit(-1).alias("c"), F.lit(0.0).alias("x"))
        return F.aggregate(codes, start, lambda acc, c: F.struct(c.alias("c"), (acc["x"] + F.when(acc["c"] < 0, F.lit(0.0)).otherwise(F.get(literal, acc["c"] * n + c))).alias("x")), lambda acc: acc["x"])

    return F.get(F.transform(F.array(codes), lambda c: F.greatest(*(total(r, c) for r in ratios))), 0)


def fit_markov(docs: DataFrame, text: str = "text") -> Markov:
    """Trains the models; the corpus's long runs are those of all documents."""
    runs = docs.select(F.explode(F.regexp_extract_all(F.coalesce(docs[text], F.lit("")), F.lit(f"{ASSIGN}|({RUN})"), F.lit(3))).alias("run")).where("run <> ''")
    plain = log_model(pair_counts(runs.where(~F.col("run").rlike(f"{ACCESS}|{HEX}"))) + sampled_counts(sample_identifiers()))
    random = [log_model(sampled_counts(sample_strings(k))) for k in range(len(SPELLINGS))]
    model = Markov([[round(r - q, 6) for r, q in zip(x, plain, strict=True)] for x in random], LEAST_MEAN)
    secret = sorted(model.score(s) / len(s) for k in range(len(SPELLINGS)) for s in sample_strings(k, HELD_OUT // len(SPELLINGS), SAMPLES))
    other = sorted(model.score(s) / len(s) for s in sample_identifiers(HELD_OUT, SAMPLES))
    # between what nearly all identifiers stay below and nearly all random strings exceed
    model.least_mean = round(max(LEAST_MEAN, (secret[len(secret) // 50] + other[-1 - len(other) // 50]) / 2), 6)
    return model


def scan(docs: DataFrame, least_total: float = LEAST_TOTAL, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, base, extra): arrays of spans (start, kind, end, match); extra ones overlap no base span."""
    model = fit_markov(docs, text)
    t = F.coalesce(docs[text], F.lit(""))
    df = docs.select(docs[doc_id].alias("doc_id"), F.concat(*base_spans(t)).alias("base"), spans(t, RUN, 3).alias("runs"))
    good = lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))

    def random(x: Column) -> Column:
        total = markov_score(x["m"], model.ratios)
        return F.get(F.transform(F.array(total), lambda v: (v >= least_total) & (v >= model.least_mean * F.length(x["m"]))), 0)

    return df.select("doc_id", "base", F.filter("runs", lambda x: good(x) & random(x)).alias("extra"))


def report(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spell(F.col("base"), "start"), 256).alias("base_sha256"), spell(F.concat("base", "extra"), "start").alias("spans"),
    )


def op7_markov_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan(table(spark, sf_dir, "documents")))
