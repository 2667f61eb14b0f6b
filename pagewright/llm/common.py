"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every contract of this subpackage.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, one of our own on a single machine, and an error on a cluster."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="pagewright-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir() or where


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; for narrow tables."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows that go to a Python worker at once where whole texts do; Spark's own bound of 64 MB a batch holds besides.
TEXTS = 1_000


@contextmanager
def _batches_of(spark: SparkSession, rows: int | None):
    """Arrow batches of so many rows at most, for what is planned inside; the session's setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if rows and not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, codec: str = "snappy", rows: int | None = None) -> DataFrame:
    """Write to a table in the shared folder and read it back: what follows never recomputes df.

    rows: of a batch to Python, where whole texts go there; this bounds a worker's memory.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    with _batches_of(spark, rows):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def again(df: DataFrame) -> DataFrame:
    """A table of ``written`` as a plan of its own, for a join with itself."""
    out = df.sparkSession.read.schema(df.schema).parquet(df._scratch)
    out._scratch = df._scratch
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made; nothing may read them any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def prefix_for(*tables: DataFrame) -> str:
    """A prefix that no column of the tables has, for columns of our own."""
    names, own = [c.lower() for df in tables for c in df.columns], "_pw"
    while any(c.startswith(own) for c in names):
        own += "_"
    return own


def sliced(batches, rows: int = TEXTS):
    """Batches of fewer rows, for a worker that makes much of each text."""
    for pdf in batches:
        for k in range(0, len(pdf), rows):
            yield pdf.iloc[k : k + rows]


def tables_of_slices(pd, total: np.ndarray, task: int, others: list[str], size: int = 4096):
    """One task's array as rows ``part, task, v`` of size numbers each; others: columns that are null there."""
    parts = range(0, len(total), size)
    own = {"part": [k // size for k in parts], "task": task, "v": [total[k : k + size] for k in parts]}
    return pd({c: [None] * len(parts) for c in others} | own)


def summed_slices(slices: DataFrame, length: int, add=np.add, size: int = 4096, fan: int = 64) -> np.ndarray:
    """The tasks' arrays (``part, task, v``) summed in a tree, of which each group has at most fan rows; in the order of tasks."""
    kind = slices.schema["v"].dataType.elementType

    def one(pdf):
        return pdf.iloc[:1].assign(v=[add.reduce(np.stack(pdf.sort_values("task")["v"]), axis=0)])

    most, step = slices.agg(F.max("task")).first()[0], slices
    while most is not None:
        most = most // fan
        step = step.withColumn("task", F.floor(F.col("task") / fan).cast("int")).groupBy("part", "task").applyInPandas(one, slices.schema)
        if not most:
            break
    out = np.zeros(length, np.float64 if kind.typeName() in ("double", "float") else np.int64)
    for r in step.collect():  # length numbers
        out[r["part"] * size : r["part"] * size + len(r["v"])] = r["v"]
    return out


def by_name(docs: DataFrame):
    """(doc_id as a string column, and the cast back): pandas would hold nullable longs as floats, which lose digits."""
    kind = docs.schema["doc_id"].dataType
    return F.col("doc_id").cast("string").alias("doc_id"), lambda df: df.withColumn("doc_id", F.col("doc_id").cast(kind))


def n_words(text):
    """Words of a text by WORD; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, order: list) -> DataFrame:
    """Add ``rank`` (long, from 0) by a total order, with no single-task window.

    Rows are dealt by range, numbered within their partition, and shifted by the
    sizes of the partitions before; that table has one row for each partition.
    """
    spark = df.sparkSession
    low = F.monotonically_increasing_id()
    parts = durable(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", low)
    ).withColumns({"_p": F.shiftright("_m", 33), "_i": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = sorted((r["_p"], r["n"]) for r in parts.groupBy("_p").agg(F.count("*").alias("n")).collect())
    at, starts = 0, []
    for p, n in sizes:
        starts.append((p, at))
        at += n
    offsets = spark.createDataFrame(starts or [(-1, 0)], "_p long, _o long")
    return (
        parts.join(F.broadcast(offsets), "_p")  # a row for each partition
        .withColumn("rank", F.col("_i") + F.col("_o"))
        .drop("_m", "_p", "_i", "_o")
    )
