"""Operator 2: near-duplicate documents by BagMinHash.

A document is the multiset of its five-word shingles (fewer words: one shingle of all).  Texts with equal word lists are
one class first.  For each distinct list, BagMinHash gives an unbiased weighted-Jaccard signature: every shingle runs
Poisson processes over dyadic blocks of its discretised weight, points of a block being split further only where the
block is cut by the weight, and each signature component keeps the earliest point that falls to it.  Signatures are
banded; pairs of a band are verified by the exact weighted Jaccard similarity of their multisets.

Near copies that no star reaches are found by how they differ from what most of their group has (see apart).

Cases: a null text is a class by itself; all texts without words are copies of each other.  Words are compared in lower
case.  Texts of any length are whole.  near_duplicates classes doc_ids: it leaves out rows without one, and a doc_id that
is repeated with several texts is in the class of the smallest id.  drop_near_duplicates tells rows apart by their texts
and keeps one row of each class, that of the smallest doc_id, also among rows that repeat that id or have none; rows
without a text stay.  Only the id and text columns are read, so others may have any name.  An empty table gives an empty
table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, components as connected, staged, table, words
from .groups import linked

SHINGLE = 5
LEAST_SIMILARITY = 0.8
COMPONENTS = 125
BANDS = 25

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31, _S11 = np.uint64(30), np.uint64(27), np.uint64(31), np.uint64(11)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the runs of size words, in order; one of all words where there are fewer."""
    h = hashes.view(np.uint64)
    if len(h) >= size:
        return windows(h, size)
    out = np.full(1, len(h), np.uint64)
    for x in h:
        out = mix(out * _GOLD + x)
    return out


def windows(h: np.ndarray, size: int) -> np.ndarray:
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mix(out * _GOLD + h[k : k + n])
    return out


def multiset(hashes: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(hashes, size), return_counts=True)


def multisets(flat: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of many documents' word hashes, sorted by document and shingle."""
    length = np.diff(offsets)
    flat = flat[offsets[0] : offsets[-1]].view(np.uint64)
    start = offsets[:-1] - offsets[0]
    doc, value = [], []
    if len(flat) >= size:
        all_ = windows(flat, size)
        n = np.maximum(length - size + 1, 0)
        at = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        doc.append(np.repeat(np.arange(len(length)), n))
        value.append(all_[at])
    short = np.flatnonzero(length < size)
    doc.append(short)
    value.append(np.array([shingles(flat[start[i] : start[i] + length[i]], size)[0] for i in short], np.uint64))
    doc, value = np.concatenate(doc), np.concatenate(value)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])]))
    return doc[new], value[new], np.diff(np.concatenate([new, [len(doc)]]))


def bag_minhash(doc: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_docs: int, m: int = COMPONENTS) -> np.ndarray:
    """Signatures (n_docs, m) of many bags at once: the marks of the earliest points of m components.

    Two bags agree in a component with the probability of their weighted Jaccard similarity.  Weights are positive
    integers.  The weight axis is cut into the blocks (0, 1], (1, 2], (2, 4], (4, 8] ...; a block of width v is a Poisson
    process of rate v for each component, so of rate v * m in all.  A point takes a component and, in a block that reaches
    past the weight, a level, drawn evenly in the block at once, which has the same distribution as halving the block level
    by level; points above the weight are dropped.  Equal elements see equal points up to the smaller weight, whatever the
    bag.  A process ends when its time has passed all of its bag's
    minima, so that few points are made.
    """
    times, marks = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, np.uint64)
    parts, lo, hi = [], 0, 1
    while (some := weights > lo).any():
        k = int(some.sum())
        parts.append((doc[some], elements[some], weights[some], np.full(k, lo), np.full(k, hi)))
        lo, hi = hi, hi * 2
    if not parts:
        return marks.reshape(n_docs, m)
    d, e, w, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
    total = np.bincount(doc, weights, n_docs)
    seed = mix(e + _GOLD * (high.astype(np.uint64) + np.uint64(1)))
    rate = (high - low).astype(np.float64) * m
    at_once = np.clip(np.ceil(2.0 * m / np.maximum(total, 1)), 1, 4 * m).astype(np.int64)[d]  # points of each process in a round
    now, done = np.zeros(len(seed)), np.zeros(len(seed), np.int64)
    while len(seed):
        ends = np.cumsum(at_once)
        own = np.repeat(np.arange(len(seed)), at_once)
        k = np.arange(ends[-1]) - (ends - at_once)[own] + done[own] + 1
        draw = mix(seed[own] + _GOLD * k.astype(np.uint64))
        gap = -np.log(((draw >> _S11).astype(np.float64) + 0.5) / 9007199254740992.0) / rate[own]
        at = _segment_sums(gap, ends - at_once, now, at_once)
        last = at[ends - 1]
        mark = mix(draw + _GOLD)
        good = np.ones(len(at), bool)
        if (cut := np.flatnonzero((high > w)[own])).size:  # the block is cut by the weight: which level is the point's?
            c = own[cut]
            level = (mix(mark[cut] + _GOLD) % (high - low)[c].astype(np.uint64)).astype(np.int64)
            good[cut] = low[c] + level < w[c]
        cell = d[own] * m + (mark % np.uint64(m)).astype(np.int64)
        good &= at < times[cell]
        at, cell, mark = at[good], cell[good], mark[good]
        order = np.lexsort((mark, at))[::-1]  # the earliest is written last
        times[cell[order]], marks[cell[order]] = at[order], mark[order]
        going = last < times.reshape(n_docs, m).max(axis=1)[d]
        done = (done + at_once)[going]
        seed, rate, now, at_once, d, w, low, high = seed[going], rate[going], last[going], at_once[going], d[going], w[going], low[going], high[going]
    return marks.reshape(n_docs, m)


def _segment_sums(gap: np.ndarray, start: np.ndarray, now: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Running sums of each process's gaps from its time on, with the same rounding whatever stands beside it."""
    out = np.empty_like(gap)
    for n in np.unique(count):
        which = np.flatnonzero(count == n)
        at = start[which][:, None] + np.arange(n)[None, :]
        out[at] = np.cumsum(np.concatenate([now[which][:, None], gap[at]], axis=1), axis=1)[:, 1:]
    return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum() if len(both) else 0
    return float(least / (a[1].sum() + b[1].sum() - least))


def word_hashes(text: str = "text") -> Column:
    """Hashes of the lower-case words; null for null texts."""
    return F.when(F.col(text).isNotNull(), F.transform(words(F.lower(text)), lambda w: F.xxhash64(w)))


def signatures(df: DataFrame, components: int, bands: int, size: int, at_once: int = 128) -> DataFrame:
    """(doc_id, raw, h1, size, keys array<long>): the number of shingles and a key per band, from (doc_id, raw, h1, hs)."""
    rows = components // bands

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, at_once):
                part = batch.slice(i, at_once)
                hs = part.column(3)
                offsets = hs.offsets.to_numpy().astype(np.int64)
                marks = bag_minhash(*multisets(hs.values.to_numpy(), offsets, size), part.num_rows, components)
                key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (part.num_rows, 1))
                for r in range(rows):
                    key = mix(key * _GOLD + marks[:, r * bands : (r + 1) * bands])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * bands), pa.array(key.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(np.maximum(np.diff(offsets) - (size - 1), 1)), lists], names=["doc_id", "raw", "h1", "size", "keys"])

    return df.select("doc_id", "raw", "h1", "hs").mapInArrow(run, "doc_id long, raw long, h1 long, size long, keys array<long>")


def levels(docs: DataFrame, size: int) -> DataFrame:
    """(node, els array<long>): a document's multiset as a set; the k-th occurrence of a shingle is an element of its own."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            hs = batch.column(1)
            doc, value, weight = multisets(hs.values.to_numpy(), hs.offsets.to_numpy().astype(np.int64), size)
            k = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
            els = mix(np.repeat(value, weight) + _GOLD * k.astype(np.uint64)).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, weight, batch.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(els))], names=["node", "els"])

    return docs.select("node", "hs").mapInArrow(run, "node long, els array<long>")


def apart(mixed: DataFrame, docs: DataFrame, least: float, size: int, scratch: Scratch) -> DataFrame:
    """Candidates (a, b) among documents that share a large key but lie in different components: no true pair is missing.

    Documents that are joined by such keys form a group.  What more than half of a group have is its consensus, and a
    document is told by its differences from that: d of them, in a document of n elements.  Two documents that have o
    differences in common differ in da + db - 2 * o elements, so they reach the similarity when o >= (xa + xb) / 2, with
    x = d - n * (1 - least) / (1 + least).  Where xa + xb <= 0 they surely do, and then both do with the document of the
    group's smallest x: one star.  All others must share a difference, so documents are joined on those alone, the rare
    ones first and only as many as the least overlap demands; what the group has in common is never joined on.
    """
    node = scratch.staged(mixed.groupBy("node").agg(F.min("label").alias("label")))
    low = mixed.groupBy("key").agg(F.min("node").alias("a"))
    group = connected(mixed.join(low, "key").select("a", F.col("node").alias("b")), scratch).withColumnRenamed("label", "g")
    els = scratch.staged(levels(docs.join(node.select("node"), "node", "left_semi"), size).join(node.join(group, "node"), "node"))
    half = els.groupBy("g").agg((F.count("*") / 2).alias("half"))
    common = els.select("g", F.explode("els").alias("e")).groupBy("g", "e").agg(F.count("*").alias("c")).join(half, "g").where("c > half")
    common = common.groupBy("g").agg(F.collect_list("e").alias("common"))  # shorter than twice the mean document
    none, slack = F.array().cast("array<long>"), (1 - least) / (1 + least)
    differ = els.join(common, "g", "left").withColumn("common", F.coalesce("common", none))
    differ = differ.select("node", "g", "label", F.size("els").alias("n"), F.array_except("els", "common").alias("more"), F.array_except("common", "els").alias("less"))
    differ = differ.withColumn("x", F.size("more") + F.size("less") - F.col("n") * F.lit(slack))
    differ = scratch.staged(differ.select("node", "g", "label", "n", "x", F.concat("more", F.transform("less", lambda e: F.xxhash64(e))).alias("diff")))
    centre = differ.groupBy("g").agg(F.min_by(F.struct("node", "label", "x"), F.struct("x", "node")).alias("c"))
    star = differ.join(centre, "g").where((F.col("x") + F.col("c.x") <= 1e-6) & (F.col("label") != F.col("c.label"))).select(F.col("node").alias("a"), F.col("c.node").alias("b"))
    each = differ.select("node", "g", "label", "n", "x", F.explode("diff").alias("e"))
    shared = each.groupBy("g", "e").agg(F.count("*").alias("c")).where("c > 1")  # a difference of one document alone can't be shared
    placed = each.join(shared, ["g", "e"])
    order, whole = Window.partitionBy("node").orderBy("c", "e"), Window.partitionBy("node")
    placed = placed.withColumn("left", F.count("*").over(whole) - F.row_number().over(order) + 1).join(centre.select("g", F.col("c.x").alias("cx")), "g")
    # the differences left, from this one on, must be enough for the nearest that a partner can be
    placed = scratch.staged(placed.where(F.col("left") >= F.greatest((F.col("x") + F.col("cx")) / 2 - 1e-6, F.lit(1))).select("node", "g", "label", "n", "x", "e", "left"))
    one = placed.select("g", "e", *(F.col(c).alias(f"a_{c}") for c in ("node", "label", "n", "x", "left")))
    two = placed.select(F.col("g").alias("g2"), F.col("e").alias("e2"), *(F.col(c).alias(f"b_{c}") for c in ("node", "label", "n", "x", "left")))
    on = (F.col("g") == F.col("g2")) & (F.col("e") == F.col("e2")) & (F.col("a_node") < F.col("b_node")) & (F.col("a_label") != F.col("b_label"))
    on = on & (F.least("a_n", "b_n") >= (least - 1e-9) * F.greatest("a_n", "b_n")) & (F.least("a_left", "b_left") >= (F.col("a_x") + F.col("b_x")) / 2 - 1e-6)
    pairs = one.join(two, on).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(pairs).distinct()


def tester(docs: DataFrame, signed: DataFrame, least: float, size: int):
    """similar, band, prepare and rest for groups.linked; nodes are hashes of word lists."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            good, known = [], (None, None)
            a = batch.column(0).to_pylist()
            x, y = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                if a[i] != known[0]:
                    known = a[i], multiset(x[i].values.to_numpy(), size)
                good.append(weighted_jaccard(known[1], multiset(y[i].values.to_numpy(), size)) >= least - 1e-12)
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    def prepare(nodes: DataFrame, scratch: Scratch):
        # texts of the nodes alone are shuffled, one of each, and hashed once for all tests
        chosen = signed.join(nodes.withColumnRenamed("node", "h1"), "h1", "left_semi").groupBy("h1").agg(F.min("raw").alias("raw"))
        some = docs.where("text is not null").withColumn("raw", raw_hash()).join(chosen, "raw").dropDuplicates(["raw"])
        hs = scratch.staged(some.select(F.col("h1").alias("node"), word_hashes().alias("hs")))

        def test(pairs: DataFrame) -> DataFrame:
            side = lambda x: hs.select(F.col("node").alias(x), F.col("hs").alias(f"h{x}"))
            both = pairs.join(side("a"), "a").join(side("b"), "b")
            return both.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")

        test.hashes = hs
        return test

    def rest(mixed: DataFrame, test, scratch: Scratch) -> DataFrame:
        return apart(mixed, test.hashes, least, size, scratch)

    def similar(a: str, b: str) -> Column:
        return F.least(a, b) >= (least - 1e-9) * F.greatest(a, b)

    def band(size: str) -> Column:
        return F.floor(F.log(size) / -math.log(least) + 1e-9).cast("int")

    return similar, band, prepare, rest


def raw_hash() -> Column:
    return F.xxhash64("text")


def classes(docs: DataFrame, scratch: Scratch, least: float = LEAST_SIMILARITY, components: int = COMPONENTS, bands: int = BANDS, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Two tables: (doc_id, raw, h1, keys) of all rows with a text, and (h1, label, first_id) of each distinct word list."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    split = docs.where("text is not null").select("doc_id", raw_hash().alias("raw"), word_hashes().alias("hs"))
    signed = scratch.staged(signatures(split.withColumn("h1", F.xxhash64("hs")), components, bands, size))
    lists = signed.groupBy("h1").agg(F.min("doc_id").alias("id"))
    distinct = scratch.staged(signed.groupBy(F.col("h1").alias("node")).agg(F.first("size").alias("size"), F.first("keys").alias("keys")))
    label = linked(distinct.select("node", F.explode("keys").alias("key")), distinct.select("node", "size"), *tester(docs, signed, least, size), scratch)
    member = lists.join(label.withColumnRenamed("node", "h1"), "h1", "left").select("h1", "id", F.coalesce("label", "h1").alias("label"))
    first = member.groupBy("label").agg(F.min("id").alias("first_id"))
    return signed, scratch.staged(member.join(first, "label").select("h1", "label", "first_id"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id): the smallest doc_id of each class of copies and near copies, a row for each doc_id there is."""
    with Scratch(docs.sparkSession) as scratch:
        signed, found = classes(docs, scratch, **options)
        out = staged(signed.where("doc_id is not null").select("doc_id", "h1").join(found, "h1").groupBy("doc_id").agg(F.min("first_id").alias("class_id")))
    none = docs.where("text is null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return out.union(none.join(out, "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("class_id")))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of each class: that with the smallest doc_id."""
    with Scratch(docs.sparkSession) as scratch:
        signed, found = classes(docs, scratch, **options)
        rows = signed.select("doc_id", "raw", "h1").join(found, "h1").where("doc_id <=> first_id")
        # rows that are kept, by their texts; a class may have several under its first id
        kept = staged(rows.groupBy("label").agg(F.first("first_id").alias("__id"), F.min("raw").alias("__raw"), F.count("*").alias("__n")).select("__id", "__raw", (F.col("__n") > 1).alias("__more")))
    text = docs["text"].isNotNull()
    out = docs.where(text).join(kept, F.xxhash64(docs["text"]).eqNullSafe(kept["__raw"]) & docs["doc_id"].eqNullSafe(kept["__id"]))
    many = out.where("__more").dropDuplicates(["__id", "__raw"])
    return docs.where(~text).union(out.where("not __more").union(many).select(*docs.columns))


def op2_bagminhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
