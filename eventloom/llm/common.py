"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where an installed public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def words(text: Column) -> Column:
    """The words of a text in order; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def shared_dir(spark: SparkSession) -> str:
    """A new folder's name under the folder that driver and executors share.

    Where none is set, a local master gets a temporary one (tests); on a cluster that is an error, as each machine would
    have a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not base:
        found = sc._jsc.sc().getCheckpointDir()
        if not found.isEmpty():
            base = found.get()
        elif sc.master.split("[")[0] == "local":
            base = tempfile.mkdtemp(prefix="eventloom-")
            sc.setCheckpointDir(base)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base}/{uuid.uuid4().hex}"


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_and_read(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet and reads it back.  The shuffle files of the write are removed, since the table stands in for them."""
    spark = df.sparkSession
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def staged(df: DataFrame) -> DataFrame:
    """A table in the shared folder: computed once, and lost executors don't matter.  It stays, for results that read it."""
    return write_and_read(df, shared_dir(df.sparkSession))


class Scratch:
    """Staged tables that are deleted when the block ends, or earlier by drop."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*(t for t, _ in self.tables))

    def staged(self, df: DataFrame) -> DataFrame:
        path = shared_dir(self.spark)
        self.tables.append((write_and_read(df, path), path))
        return self.tables[-1][0]

    def drop(self, *tables: DataFrame) -> None:
        for t, path in [x for x in self.tables if any(x[0] is t for t in tables)]:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self.tables = [x for x in self.tables if not any(x[0] is t for t in tables)]


def map_arrow(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str, at_once: int = 512) -> DataFrame:
    """Applies the function that make() builds once per task to columns of lists, at_once rows at a time."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                got = fn(batch.slice(at, at_once).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in target], schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)


def components(edges: DataFrame, keep: Scratch) -> DataFrame:
    """Connected components of edges (a, b): (node, label), the label being a node of each component.

    In every round each node takes its smallest neighbour's smallest neighbour, and edges are contracted to those between
    what is left; so rounds shrink quickly.  Each is staged, so lineage stays short, and goes when the next one is there.
    The result is staged in keep.
    """
    with Scratch(keep.spark) as scratch:
        left = scratch.staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
        label = None
        while True:
            low = scratch.staged(left.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("m")))
            far = low.select(F.col("v").alias("m"), F.col("m").alias("f"))
            to = scratch.staged(low.join(far, "m").select("v", "f"))
            end = lambda x: to.select(F.col("v").alias(x), F.col("f").alias(f"f{x}"))  # noqa: B023,E731
            more = scratch.staged(left.join(end("a"), "a").select("b", "fa").distinct().join(end("b"), "b").where("fa <> fb").select(F.col("fa").alias("a"), F.col("fb").alias("b")).distinct())
            new = to.select(F.col("v").alias("node"), F.col("f").alias("label"))
            if label is not None:
                new = label.join(to, label["label"] == to["v"], "left").select("node", F.coalesce("f", "label").alias("label"))
            done = more.isEmpty()
            new = (keep if done else scratch).staged(new)
            scratch.drop(left, low, to, *([label] if label is not None else []))
            if done:
                return new
            label, left = new, more
