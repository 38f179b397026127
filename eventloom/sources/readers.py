"""Readers of the tables' files.  Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import posix_path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def require_path(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return str(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """A CSV file with a header.  Without a schema all columns are strings; columns prunes the scan."""
    reader = spark.read.option("header", True).option("enforceSchema", False).options(**options)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(require_path(spark, path))
    return df.select(*columns) if columns else df


def read_typed_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A CSV file read as strings, and the named columns that it has turned into the types of ddl; bad values are null."""
    df = read_csv(spark, path)
    kinds = {f.name: f.dataType.simpleString() for f in T.StructType.fromDDL(ddl)}
    cast = lambda c: F.col(f"`{c}`").try_cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`")
    return df.select(*(cast(c) for c in df.columns))


def read_codelist(spark: SparkSession, path: str, charset: str = "cp932") -> tuple[list[str], DataFrame]:
    """A code list: its first line (about the file) split at commas, and the table that starts at line 2.

    The last column is a nullable long, the others strings; undecodable bytes are replaced, and a quoted value may span
    lines.  Code lists are small, so a file is parsed as one value; a row that lacks columns has nulls there.
    """

    def parse(batches):
        import csv
        import io

        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = [r for r in csv.reader(io.StringIO(content.decode(charset, errors="replace"), newline="")) if r]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))], names=["i", "r"])

    raw = spark.read.format("binaryFile").load(require_path(spark, path)).select("content").mapInArrow(parse, "i int, r array<string>")
    head = {r["i"]: r["r"] for r in raw.where("i < 2").collect()}
    names = head[1]
    last = len(names) - 1
    value = lambda i: F.get("r", F.lit(i)).try_cast("long") if i == last else F.get("r", F.lit(i))
    return head[0], raw.where("i > 1").select(*(value(i).alias(n) for i, n in enumerate(names)))


def read_data_files(spark: SparkSession, path: str, prefix: str, replacement: str) -> DataFrame:
    """The index of data files: eight columns, with the path prefix replaced."""
    return read_csv(spark, path, columns=schemas.DATA_FILES).withColumn("File", posix_path(F.col("File"), prefix, replacement))


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """(Industry, Code, Company Name) of a text file in which a line without a tab starts an industry."""
    lines = spark.read.text(require_path(spark, path), wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    lines = lines.where(F.trim("line") != "")
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = lines.withColumn("Industry", F.last(F.when(~F.contains("line", F.lit("\t")), F.trim("line")), ignorenulls=True).over(w))
    df = df.where(F.contains("line", F.lit("\t")) & ~F.startswith("line", F.lit("Code\tCompany Name")))
    parts = F.split("line", "\t")
    return df.orderBy("path", "line_no").select("Industry", F.trim(F.get(parts, 0)).alias("Code"), F.trim(F.get(parts, 1)).alias("Company Name"))


def read_analyses(spark: SparkSession, path: str) -> DataFrame:
    """Nested analyses, one JSON object per file, with the file's stem as doc."""
    df = spark.read.schema(schemas.ANALYSIS).option("multiLine", True).json(require_path(spark, path))
    return df.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("doc"), "mdna_found", "document_score", "chunks")
