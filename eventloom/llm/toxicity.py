"""Operator 4: toxicity by the nearest labelled examples.

A bounded, documented sample of labelled documents is indexed by TF-IDF over all their words, and norms are those of whole
texts: a word that no example has counts as one of no document.  Postings of rarer words are added up example by example.
Those of common words are cut into blocks of examples with the largest weight of each word per block (block-max); a text
visits its best blocks first and then every block whose bound, by these and by the sums so far, reaches its k-th best
cosine, so the neighbours are exact.  Texts are scored some at a time, and a block's postings of common words, which are
nearly full, are multiplied as a matrix.  Votes of the neighbours, weighted by distance, are calibrated on the examples
examples themselves, each left out of its own vote.

On request (least_g2; the query asks for it) what tells the labels apart weighs more, so that a few insults in a long text
decide on its neighbours: the weight of a word that label 1 has significantly more often is multiplied by the root of its
G2, and the beginnings of words, STEMS letters long, that tell as much are added as words of their own, since inflected
insults may share no whole word.  No word is left out for that.

Cases: a null or empty text, or one without an indexed word, has no neighbours and gets the calibrated share of label 1
among examples of that kind.  Ties go to the example with the smaller number.  Very long texts are whole.  Repeated rows
are scored each by itself.  Labelled rows that name a document several times count once, with the larger label; null
labels don't count.  Without examples every score is 0.5.  Only the id and text columns are read, so others may have any
name.  An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, table

#: At most so many examples of each label, the first by hash of the id.
MOST_EXAMPLES = 3000
NEIGHBOURS = 25
BLOCK = 64
CUT = 0.7
#: A word is common if one example in so many has it.
COMMON = 24
#: Blocks that a text visits before it has a k-th best cosine.
FIRST_BLOCKS = 8
#: At most so many texts at a time, and fewer where they have more postings together than this or more bytes.
TEXTS = 128
POSTINGS = 2_000_000
BATCH_BYTES = 4_000_000
#: Lengths of beginnings of words, and the G2 from which a word or beginning tells the labels apart.
STEMS = (4, 5, 6)
LEAST_G2 = 30.0


def words_of(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, object]:
    """The words of an Arrow array of texts, runs of letters in lower case, for examples and queries alike.

    Three arrays (text, word, count), by text and word, and the distinct words as an Arrow array.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())), r"\P{L}+")
    coded = parts.flatten().dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
    n = max(len(words), 1)
    cell, count = np.unique((row * n + code)[pc.not_equal(words, "").to_numpy(zero_copy_only=False)[code]], return_counts=True) if len(words) else (np.zeros(0, np.int64),) * 2
    return cell // n, cell % n, count, words


def tokens(text: str | None) -> Counter:
    """The words of one text."""
    import pyarrow as pa

    _, word, count, words = words_of(pa.array([text], pa.string()))
    return Counter(dict(zip(words.take(pa.array(word)).to_pylist(), count.tolist(), strict=True)))


def spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all spans one after another, and the span that each is of."""
    n = ends - starts
    return np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n), np.repeat(np.arange(len(n)), n)


def stems_of(words, length: int):
    """The beginnings of an Arrow array of words, with a mark that no word has; null for words that are not longer."""
    import pyarrow as pa
    import pyarrow.compute as pc

    text = lambda x: pa.scalar(x, words.type)
    begin = pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, length), text("-"), text(""))
    return pc.if_else(pc.greater(pc.utf8_length(words), length), begin, text(None))


def g2(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """G2 of words that a of n1 examples of label 1 and b of n0 others have; 0 for those that label 1 has less often."""
    row, n = a + b, n1 + n0
    part = lambda o, r, c: np.where(o > 0, o * np.log(np.maximum(o, 1) * n / np.maximum(r * c, 1)), 0)
    return np.where(a * n0 > b * n1, 2 * (part(a, row, n1) + part(b, row, n0) + part(n1 - a, n - row, n1) + part(n0 - b, n - row, n0)), 0)


def merged(row: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) with one entry for each row and term, by both; terms are less than n."""
    cell, at = np.unique(row * n + term, return_inverse=True)
    return cell // n, cell % n, np.bincount(at, count, len(cell))


@dataclass
class Vectors:
    """Indexed words of some texts and their weights, by the norms of the whole texts; those of text i from indptr[i]."""

    indptr: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def part(self, lo: int, hi: int) -> Vectors:
        at = slice(self.indptr[lo], self.indptr[hi])
        return Vectors(self.indptr[lo : hi + 1] - self.indptr[lo], self.terms[at], self.values[at])


@dataclass
class BlockMaxIndex:
    """Postings of each word in order of examples.

    Those of a common word are a column of full, a row per example, and tops has its largest weight in each block.
    """

    words: object  # an Arrow array
    idf: np.ndarray
    unseen: float
    labels: np.ndarray
    doc_ids: np.ndarray
    examples: Vectors | None
    starts: np.ndarray  # by word: its postings, none of a common word
    ids: np.ndarray  # by posting
    weights: np.ndarray
    column: np.ndarray  # by word: its column of full, or -1
    full: np.ndarray
    tops: np.ndarray
    stems: object = None  # an Arrow array of beginnings of words; the last of words

    @classmethod
    def build(cls, words, example: np.ndarray, word: np.ndarray, count: np.ndarray, labels, doc_ids, least_g2: float | None = None) -> BlockMaxIndex:
        """example, word, count: the examples' numbers, their words' numbers and how often they have them."""
        n, label, stems = len(labels), np.array(labels, int), None
        telling = lambda row, term, size: g2(*(np.bincount(term[label[row] == y], minlength=size) for y in (1, 0)), int(label.sum()), int(n - label.sum()))
        if least_g2 is not None:
            words, stems, example, word, count = cls.with_stems(words, example, word, count, telling, least_g2)
        df = np.bincount(word, minlength=len(words))
        idf = np.log((n + 1) / (df + 1)) + 1
        if least_g2 is not None:
            told = telling(example, word, len(words))
            idf *= np.where(told >= least_g2, np.sqrt(np.maximum(told, 1)), 1)
        by = np.lexsort((word, example))
        example, word = example[by], word[by]
        raw = (1 + np.log(count[by])) * idf[word]
        values = raw / np.sqrt(np.bincount(example, raw * raw, n))[example]
        indptr = np.concatenate([[0], np.cumsum(np.bincount(example, minlength=n))])
        is_common = df * COMMON >= n
        column = np.where(is_common, np.cumsum(is_common) - 1, -1)
        full = np.zeros((n, int(is_common.sum())))
        here = is_common[word]
        full[example[here], column[word[here]]] = values[here]
        tops = np.maximum.reduceat(full, np.arange(0, n, BLOCK), axis=0)
        by = np.lexsort((example, word))
        by = by[~here[by]]
        starts = np.concatenate([[0], np.cumsum(np.where(is_common, 0, df))])
        return cls(words, idf, math.log(n + 1) + 1, np.array(labels, int), np.array(doc_ids, np.int64), Vectors(indptr, word, values), starts, example[by].astype(np.int32), values[by], column, full, tops, stems)

    @staticmethod
    def with_stems(words, example: np.ndarray, word: np.ndarray, count: np.ndarray, telling, least: float):
        """The words with the beginnings that tell the labels apart, these beginnings, and (example, word, count) of both."""
        import pyarrow as pa
        import pyarrow.compute as pc

        found, parts, size = [], [(example, word, count)], len(words)
        for length in STEMS:
            coded = pc.drop_null(stems_of(words, length)).dictionary_encode()
            number = pc.fill_null(pc.index_in(stems_of(words, length), value_set=coded.dictionary), -1).to_numpy().astype(np.int64)[word]
            has, n = number >= 0, max(len(coded.dictionary), 1)
            row, stem, times = merged(example[has], number[has], count[has], n)
            good = telling(row, stem, n) >= least
            place = np.cumsum(good) - 1 + size
            keep = good[stem]
            parts.append((row[keep], place[stem[keep]], times[keep]))
            found.append(coded.dictionary.take(pa.array(np.flatnonzero(good[: len(coded.dictionary)]))))
            size += int(good.sum())
        stems = pa.concat_arrays(found)
        return pa.concat_arrays([words, stems]), stems, *(np.concatenate(x) for x in zip(*parts, strict=True))

    def vectors(self, texts) -> Vectors:
        """Those of an Arrow array of texts."""
        import pyarrow.compute as pc

        row, word, count, words = words_of(texts)
        place = lambda w: pc.fill_null(pc.index_in(w, value_set=self.words), -1).to_numpy().astype(np.int64)[word]
        term = place(words)
        if self.stems is not None and len(self.stems) and len(words):
            some = [(row[at >= 0], at[at >= 0], count[at >= 0]) for at in (place(stems_of(words, length)) for length in STEMS)]
            extra = merged(*(np.concatenate(x) for x in zip(*some, strict=True)), len(self.words))
            row, term, count = (np.concatenate(x) for x in zip((row, term, count), extra, strict=True))
            by = np.argsort(row, kind="stable")
            row, term, count = row[by], term[by], count[by]
        seen = term >= 0
        raw = 1 + np.log(count)
        raw *= np.where(seen, self.idf[term] if len(self.idf) else 0, self.unseen)
        values = raw / np.sqrt(np.bincount(row, raw * raw, len(texts)))[row]
        return Vectors(np.concatenate([[0], np.cumsum(np.bincount(row[seen], minlength=len(texts)))]), term[seen], values[seen])

    def vector(self, text: str | None) -> Vectors:
        import pyarrow as pa

        return self.vectors(pa.array([text], pa.string()))

    def nearest(self, query: Vectors, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest positive cosines with one text, largest first, and these cosines."""
        _, ids, cosines = self.search(query, k, np.array([without]))
        return ids, cosines

    def search(self, queries: Vectors, k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, example, cosine) of the k examples nearest to each text, by text and falling cosine; without: an example
        that a text is not compared with, or -1."""
        n = len(queries.indptr) - 1
        work = np.concatenate([[0], np.cumsum(self.starts[queries.terms + 1] - self.starts[queries.terms])])[queries.indptr]
        found, lo = [], 0
        while lo < n:
            hi = max(lo + 1, min(lo + TEXTS, int(np.searchsorted(work, work[lo] + POSTINGS, "right")) - 1))
            row, ids, cosines = self._search(queries.part(lo, hi), k, None if without is None else without[lo:hi])
            found.append((row + lo, ids, cosines))
            lo = hi
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _search(self, queries: Vectors, k: int, without: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, size = len(queries.indptr) - 1, len(self.labels)
        row, column = np.repeat(np.arange(n), np.diff(queries.indptr)), self.column[queries.terms]
        common = column >= 0
        q = np.zeros((n, self.full.shape[1]))
        q[row[common], column[common]] = queries.values[common]
        rare = queries.terms[~common]
        post, of = spans(self.starts[rare], self.starts[rare + 1])
        sums = np.bincount((row[~common] * size)[of] + self.ids[post], queries.values[~common][of] * self.weights[post], n * size).reshape(n, size)
        first = np.arange(0, size, BLOCK)
        bound = np.maximum.reduceat(sums, first, axis=1) + q @ self.tops.T
        cosines = np.zeros((n, size))

        def visit(chosen: np.ndarray) -> None:
            for b in np.flatnonzero(chosen.any(axis=0)):
                rows, at = np.flatnonzero(chosen[:, b]), slice(first[b], first[b] + BLOCK)
                cosines[rows, at] = np.round(sums[rows, at] + q[rows] @ self.full[at].T, 12)
            if without is not None:
                left_out = np.flatnonzero(without >= 0)
                cosines[left_out, without[left_out]] = 0

        def kth() -> np.ndarray:
            return np.partition(cosines, size - k, axis=1)[:, size - k, None] if k < size else np.zeros((n, 1))

        visited = np.zeros(bound.shape, bool)
        np.put_along_axis(visited, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_BLOCKS], True, axis=1)
        visited &= bound > 0
        visit(visited)
        visit((bound > 0) & (bound >= kth() - 1e-9) & ~visited)
        row, ids = np.nonzero((cosines > 0) & (cosines >= kth()))
        found = cosines[row, ids]
        by = np.lexsort((ids, -found, row))
        row, ids, found = row[by], ids[by], found[by]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[best], ids[best], found[best]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step fit of y on x (pool adjacent violators), each step shrunk slightly to the mean."""
    xs, at = np.unique(x, return_inverse=True)
    mass, total = np.bincount(at, w), np.bincount(at, w * y)
    mean = total.sum() / mass.sum()
    merged: list[list[float]] = []
    for a, m, t in zip(xs, mass, total, strict=True):
        merged.append([a, a, m, t])
        while len(merged) > 1 and merged[-2][3] / merged[-2][2] >= merged[-1][3] / merged[-1][2]:
            _, hi, m2, t2 = merged.pop()
            merged[-1][1], merged[-1][2], merged[-1][3] = hi, merged[-1][2] + m2, merged[-1][3] + t2
    knots = [(v, (t + mean) / (m + 1)) for lo, hi, m, t in merged for v in ((lo, hi) if hi > lo else (lo,))]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


@dataclass
class ToxicityModel:
    index: BlockMaxIndex | None
    prior: tuple[float, float]  # how many labelled documents an example of each label stands for
    none: float = 0.5
    knots: tuple[np.ndarray, np.ndarray] | None = None
    k: int = NEIGHBOURS

    def votes(self, n: int, row: np.ndarray, ids: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """The weighted share of label 1 among each text's neighbours; not a number without any."""
        y = self.index.labels[ids]
        weight = np.array(self.prior)[y] / (1.05 - cosines)
        with np.errstate(invalid="ignore"):
            return np.bincount(row, weight * y, n) / np.bincount(row, weight, n)

    def score(self, texts) -> tuple[np.ndarray, list[list[int]], list[list[float]]]:
        """The calibrated scores of an Arrow array of texts, and the evidence: the examples' doc_ids and cosines."""
        n = len(texts)
        if self.index is None:
            return np.full(n, self.none), [[]] * n, [[]] * n
        row, ids, cosines = self.index.search(self.index.vectors(texts), self.k)
        votes = self.votes(n, row, ids, cosines)
        scores = np.where(np.isnan(votes), self.none, np.interp(votes, *self.knots))
        ends = np.searchsorted(row, np.arange(n + 1))
        parts = [slice(a, min(b, a + 5)) for a, b in zip(ends, ends[1:], strict=False)]
        return scores, [self.index.doc_ids[ids[x]].tolist() for x in parts], [cosines[x].round(6).tolist() for x in parts]


def byte_slices(texts, most_rows: int = 4 * TEXTS, most_bytes: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Cuts of an Arrow array of texts, of some bytes or one text each."""
    import pyarrow.compute as pc

    grown = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())])
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, min(lo + most_rows, int(np.searchsorted(grown, grown[lo] + most_bytes, "right")) - 1))
        yield lo, hi
        lo = hi


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_examples: int = MOST_EXAMPLES, k: int = NEIGHBOURS, text: str = "text", doc_id: str = "doc_id", least_g2: float | None = None) -> ToxicityModel:
    """Indexes the sampled examples by all their words; least_g2: from which G2 on a word weighs more."""
    known = labels.select(labels[doc_id].alias("doc_id"), labels[label].cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    size = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = known.where("y = 1").orderBy(*order).limit(most_examples).union(known.where("y = 0").orderBy(*order).limit(most_examples))
    some = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).join(F.broadcast(sample), "doc_id")

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo, hi in byte_slices(batch.column(2)):
                row, word, n, words = words_of(batch.column(2)[lo:hi])
                ends = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, x) for x in (words.take(pa.array(word)).cast(pa.string()), pa.array(n.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], *lists], names=["doc_id", "y", "w", "n"])

    # bounded by the number of examples
    got = some.select(F.col("doc_id").cast("long"), "y", "text").mapInArrow(count, "doc_id long, y int, w array<string>, n array<int>").toArrow()
    examples = dict(zip(got["doc_id"].to_pylist(), got["y"].to_pylist(), strict=True))
    n1 = sum(examples.values())
    n0 = len(examples) - n1
    if not n0 or not n1:
        total = sum(size.values())
        return ToxicityModel(None, (1.0, 1.0), (size.get(1, 0) + 1) / (total + 2))
    ids = sorted(examples)
    lists = got["w"].combine_chunks()
    coded = lists.flatten().dictionary_encode()
    n_words = max(len(coded.dictionary), 1)
    example = np.repeat(np.searchsorted(np.array(ids, np.int64), got["doc_id"].to_numpy()), np.diff(lists.offsets.to_numpy()))
    # rows of one doc_id are one example
    cell, at = np.unique(example * n_words + coded.indices.to_numpy(), return_inverse=True)
    counts = np.bincount(at, got["n"].combine_chunks().flatten().to_numpy().astype(float), len(cell))
    index = BlockMaxIndex.build(coded.dictionary.cast("large_string"), cell // n_words, cell % n_words, counts, [examples[i] for i in ids], ids, least_g2)
    model = ToxicityModel(index, (size[0] / n0, size[1] / n1), k=k)
    votes = model.votes(len(ids), *index.search(index.examples, k, np.arange(len(ids))))
    weight, near = np.array(model.prior)[index.labels], ~np.isnan(votes)
    empty = np.bincount(index.labels[~near], weight[~near], 2) + 1e-9
    model.none = float((empty[1] + size[1] / (size[0] + size[1])) / (empty.sum() + 1))
    model.knots = isotonic(np.round(votes[near], 9), index.labels[near].astype(float), weight[near]) if near.any() else (np.array([0.0]), np.array([model.none]))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, cut: float = CUT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score, predicted, evidence, cosines) of every document."""
    # bounded by the number of examples, whose own vectors served to fit
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, index=model.index and replace(model.index, examples=None)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            for lo, hi in byte_slices(batch.column(1)):
                scores, evidence, cosines = model.score(batch.column(1)[lo:hi])
                columns = [batch.column(0)[lo:hi], pa.array(scores), pa.array((scores >= cut).astype(np.int32)), pa.array(evidence, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted", "evidence", "cosines"])

    some = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return some.mapInArrow(run, "doc_id long, score double, predicted int, evidence array<long>, cosines array<double>")


def op4_nearest_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = crc_fold(F.col("doc_id"), 3)
    model = fit_toxicity(docs, labels.where(fold != 1), least_g2=LEAST_G2)
    return score_toxicity(docs, model).select("doc_id", (fold == 1).alias("held_out"), "score", "predicted", "evidence", "cosines")
