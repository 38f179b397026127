"""Classes of nodes that share keys and pass a test, without all pairs of a key's nodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components

#: Keys of so many nodes or fewer give all their pairs; larger ones give stars first.
FEW = 6


def shared_keys(keyed: DataFrame, sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows (key, node, n) of keyed whose key has n > 1 nodes, with size from sizes (node, size).

    Keys are counted first, without their nodes, and only what is shared gets its size.
    """
    several = scratch.staged(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    return keyed.join(several, "key").join(sizes, "node").select("key", "node", "size", "n")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def stars(members: DataFrame, centres: DataFrame, similar: Callable, band: Callable) -> DataFrame:
    """(a, b) of similar sizes: each centre (key, band, node, size) with the members (key, node, size) of its key whose size
    is of its band or one next to it."""
    near = members.withColumn("band", F.explode(F.array(band("size") - 1, band("size"), band("size") + 1)))
    near = near.select(F.col("key").alias("kb"), F.col("band").alias("bb"), F.col("node").alias("b"), F.col("size").alias("sb"), *(F.col(c) for c in members.columns if c == "label"))
    c = centres.select("key", "band", F.col("node").alias("a"), F.col("size").alias("sa"), *(F.col(c).alias("la") for c in centres.columns if c == "label"))
    on = (F.col("key") == F.col("kb")) & (F.col("band") == F.col("bb")) & (F.col("a") != F.col("b")) & similar("sa", "sb")
    return c.join(near, on & (F.col("label") != F.col("la")) if "la" in c.columns else on).select("a", "b")


def first_pairs(shared: DataFrame, similar: Callable, band: Callable, few: int = FEW) -> DataFrame:
    """(a, b), a < b, of similar sizes: all pairs of small keys, and of each large key the centre of each band of
    sizes with the other nodes.

    The centre is the node whose keys are the most widely shared (ties: the smallest node), as the original of a group
    of edited copies is; so most nodes agree with it, and a key of m nodes gives less than 3 * m pairs.
    """
    named = lambda df, x: df.select("key", F.col("node").alias(x), F.col("size").alias(f"s{x}"))
    small = shared.where(F.col("n") <= few)
    two = named(small, "b").withColumnRenamed("key", "kb")
    pairs = named(small, "a").join(two, (F.col("key") == F.col("kb")) & (F.col("a") < F.col("b")) & similar("sa", "sb")).select("a", "b")
    large = shared.where(F.col("n") > few)
    weight = large.groupBy("node").agg(F.sum("n").alias("w"))
    centre = large.withColumn("band", band("size")).join(weight, "node").groupBy("key", "band").agg(F.max_by(F.struct("node", "size"), F.struct("w", F.bitwise_not("node").alias("less"))).alias("c"))
    return ordered(pairs.union(stars(large.select("key", "node", "size"), centre.select("key", "band", "c.node", "c.size"), similar, band)))


def mixed_nodes(shared: DataFrame, label: DataFrame, few: int = FEW) -> DataFrame:
    """(key, node, size, label) of large keys whose nodes are in several components; a node without a link is its own label."""
    large = shared.where(F.col("n") > few).select("key", "node", "size")
    known = large.join(label, "node", "left").select("key", "node", "size", F.coalesce("label", "node").alias("label"))
    mixed = known.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    return known.join(mixed, "key", "left_semi")


def linked(keyed: DataFrame, sizes: DataFrame, similar: Callable, band: Callable, prepare: Callable, rest: Callable, keep: Scratch, few: int = FEW) -> DataFrame:
    """(node, label) of all nodes with a link, from (key, node) and (node, size): nodes that share a key and pass a test are linked.

    similar(sa, sb) is the condition on two columns of sizes without which a pair can't pass, band(size) a number that
    differs by one at most for such sizes.  prepare(nodes, scratch)
    returns the test, a function that keeps the true pairs of (a, b); nodes (column node) are those of the first pairs and
    of mixed keys.  rest(mixed, test, scratch) returns further pairs to test, of large keys whose nodes the stars left
    apart: all that can pass, so that the components are those of all pairs.
    The result is staged in keep.
    """
    with Scratch(keep.spark) as scratch:
        shared = scratch.staged(shared_keys(keyed, sizes, scratch))
        pairs = scratch.staged(first_pairs(shared, similar, band, few))
        large = shared.where(F.col("n") > few).select("node")
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(large).distinct()
        test = prepare(nodes, scratch)
        first = scratch.staged(test(pairs))
        label = components(first, keep)
        mixed = scratch.staged(mixed_nodes(shared, label, few))
        if mixed.isEmpty():
            return label
        more = scratch.staged(test(scratch.staged(rest(mixed, test, scratch))))
        return label if more.isEmpty() else components(first.union(more), keep)
