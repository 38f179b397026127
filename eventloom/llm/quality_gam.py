"""Operator 8: quality classifier, a generalised additive model with pairwise interactions.

Shape figures of the whole text are computed by DataFrame expressions.  Shallow trees on binned figures are boosted
cyclically, feature by feature, and so are four-cell trees on the strongest pairs; what they add up to is one lookup
table per feature and pair.  Scoring adds the entries of a document's bins, column by column.

Cases: a null or empty text has the figures of no words, and gets the score that the tables give them.  Very long texts
are whole.  Repeated rows are scored each by itself.  Labelled rows that name a document several times count once, with
the smaller label; labels that are null don't count.  Without labelled rows, or with one class only, every score is the
smoothed share of label 1.  Only the id and text columns are read, so others may have any name.  An empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, table, words

FEATURES = ("words", "word_length", "symbols", "marks", "upper", "digits", "stops", "varied", "echoed", "dup_lines", "line_length", "commas")
#: At most so many labelled rows are fitted, the first by hash of the id.
MOST_LABELLED = 20_000
CUT = 0.7


def share(t: Column, chars: str) -> Column:
    return (F.length(t) - F.length(F.translate(t, chars, ""))) / F.greatest(F.length(t), F.lit(1))


def with_features(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, one double column per feature)."""
    t = F.coalesce(docs[text], F.lit(""))
    hashes = F.transform(words(docs[text]), lambda w: F.xxhash64(w))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(x) > 0)
    shares = {
        "symbols": share(t, "#*$%&|<>~^=+{}[]\\_@"),
        "marks": share(t, "!?"),
        "upper": share(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "digits": share(t, "0123456789"),
        "stops": share(t, ".;:"),
        "commas": share(t, ","),
        "blank": share(t, " \t\n\x0b\x0c\r"),
    }
    df = docs.select(docs[doc_id].alias("doc_id"), hashes.alias("hs"), lines.alias("lines"), F.length(t).alias("n"), *(c.alias(k) for k, c in shares.items()))
    n = F.greatest(F.size("hs"), F.lit(1))
    echoes = F.size(F.filter(F.transform("hs", lambda h, i: h == F.get("hs", i + 1)), lambda x: x))
    more = {
        "words": F.log1p(F.size("hs")),
        "word_length": F.col("n") * (1 - F.col("blank")) / n,
        "varied": F.size(F.array_distinct("hs")) / F.sqrt(n.cast("double")),
        "echoed": echoes / n,
        "dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))) / F.greatest(F.size("lines"), F.lit(1)),
        "line_length": F.log1p(F.col("n") / F.greatest(F.size("lines"), F.lit(1))),
    }
    return df.withColumns(more).select("doc_id", *(F.col(k).cast("double").alias(k) for k in FEATURES))


@dataclass
class GamModel:
    """Bin edges and lookup tables; coarse maps a feature's bins to its bins in pairs."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        out = np.full(len(x), self.intercept)
        for b, t in zip(bins, self.tables, strict=True):
            out += t[b]
        for (i, j), t in self.pairs.items():
            out += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def tree_1d(g: np.ndarray, h: np.ndarray, depth: int, least: float, smooth: float) -> np.ndarray:
    """Leaf values by bin of a tree that splits a feature's bins into up to 2 ** depth runs."""
    out = np.full(len(g), g.sum() / (h.sum() + smooth))
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + smooth) + gr**2 / (hr + smooth), -1)
        k = int(gain.argmax()) + 1
        if gain[k - 1] > g.sum() ** 2 / (h.sum() + smooth) + 1e-9:
            out[:k], out[k:] = tree_1d(g[:k], h[:k], depth - 1, least, smooth), tree_1d(g[k:], h[k:], depth - 1, least, smooth)
    return out


def tree_2d(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[np.ndarray, float]:
    """Leaf values of the best four cells that one cut on each axis gives, and their gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    quads = [(a, b), (cg[:-1, -1:] - a, ch[:-1, -1:] - b), (cg[-1:, :-1] - a, ch[-1:, :-1] - b)]
    quads.append((cg[-1, -1] - sum(q[0] for q in quads), ch[-1, -1] - sum(q[1] for q in quads)))
    gain = sum(x**2 / (y + smooth) for x, y in quads)
    if not gain.size:
        return np.zeros_like(g), 0.0
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    value = [x[i, j] / (y[i, j] + smooth) for x, y in quads]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return out, float(gain[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + smooth))


def fit_gam(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 5, most_bins: int = 48, pair_bins: int = 8, rate: float = 0.15, depth: int = 2, least: float = 2.0, smooth: float = 1.0) -> GamModel:
    """Boosts trees in turn on each feature, then on the pairs that explain most of what is left."""
    share_1 = (y.sum() + 1) / (len(y) + 2)
    model = GamModel(float(np.log(share_1 / (1 - share_1))))
    for j in range(x.shape[1]):
        edges = np.unique(np.quantile(x[:, j], np.linspace(0, 1, most_bins + 1)[1:-1])) if len(x) else np.array([])
        model.edges.append(edges)
        model.tables.append(np.zeros(len(edges) + 1))
        model.coarse.append(np.arange(len(edges) + 1) * pair_bins // (len(edges) + 1))
    if not len(y) or y.min() == y.max():
        return model
    bins = model.bins(x)
    f = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for b, t in zip(bins, model.tables, strict=True):
            g, h = slopes()
            step = rate * tree_1d(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)), depth, least, smooth)
            t += step
            f += step[b]
    cells = {}
    for i, j in combinations(range(len(bins)), 2):
        cells[i, j] = model.coarse[i][bins[i]] * pair_bins + model.coarse[j][bins[j]]
    grid = lambda v, at: np.bincount(at, v, pair_bins**2).reshape(pair_bins, pair_bins)
    g, h = slopes()
    gains = {k: tree_2d(grid(g, at), grid(h, at), smooth)[1] for k, at in cells.items()}
    chosen = sorted(gains, key=lambda k: (-gains[k], k))[:n_pairs]
    model.pairs = {k: np.zeros((pair_bins, pair_bins)) for k in chosen}
    for _ in range(pair_rounds):
        for k in chosen:
            g, h = slopes()
            step = rate * tree_2d(grid(g, cells[k]), grid(h, cells[k]), smooth)[0]
            model.pairs[k] += step
            f += step.ravel()[cells[k]]
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most_labelled: int = MOST_LABELLED, text: str = "text", doc_id: str = "doc_id", **options) -> GamModel:
    """Fits a bounded sample of the labelled rows; only their figures come to the driver."""
    known = labels.select(labels[doc_id].alias("doc_id"), labels[label].alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    some = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).join(F.broadcast(known), "doc_id")
    figures = with_features(some.select(F.struct("doc_id", "y").alias("doc_id"), "text"))
    rows = figures.select("doc_id.doc_id", "doc_id.y", *FEATURES).toPandas().sort_values(["doc_id", *FEATURES]).drop_duplicates("doc_id")
    return fit_gam(rows[list(FEATURES)].to_numpy(float), rows["y"].to_numpy(float), **options)


def score_quality(docs: DataFrame, model: GamModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every document."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = np.column_stack([batch.column(j + 1).to_numpy() for j in range(len(FEATURES))]) if batch.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return with_features(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT, **options) -> DataFrame:
    """(doc_id, score, predicted) of every document, by a model of the given labels."""
    df = score_quality(docs, fit_quality(docs, labels, **options))
    return df.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def reject_low_quality(docs: DataFrame, labels: DataFrame, cut: float = CUT, **options) -> DataFrame:
    """docs without those whose score is below cut.  Rows with a null doc_id stay."""
    low = classify(docs, labels, cut, **options).where("predicted = 0").select(F.col("doc_id").alias("__doc")).distinct()
    return docs.join(low, docs["doc_id"] == low["__doc"], "left_anti")


def op8_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = crc_fold(F.col("doc_id"), 4)
    return classify(docs, labels.where(fold != 2)).select("doc_id", (fold == 2).alias("held_out"), "score", "predicted")
