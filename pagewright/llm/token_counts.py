"""Token counts by a separator scan of flat, unindexed token files.

A file is nothing but ids of fixed width, documents one after another, each closed by
an end-of-document id. Blocks of a file are searched for that id by one vectorised
comparison each. A prefix scan over the blocks' summaries (ids, separators, place of
the last separator) then tells where the document at a block's start began.

Defined cases: a document of no ids counts 0. Ids after a file's last separator are an open
document, returned with ``closed`` false. An empty file has no documents. A null or empty
text is a document of no ids. Repeated rows are documents of their own. A special token's
string in a text is ordinary text, so no text can hold the separator.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TEXTS, by_name, written
from .tokens import encoder

DTYPE = "<u2"
CLOSE = 49_407
BLOCK_IDS = 1 << 18
#: Bytes up to which a raw file is read whole.
WHOLE = 1 << 27
#: Blocks of a file whose summaries are scanned together.
SPAN = 512


def write_flat(docs: DataFrame, tokenizer: str, close: int = CLOSE, dtype: str = DTYPE, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Flat token streams, one for each task, as a table of their blocks: ``file, block, data``.

    Rows with ``doc_id`` and ``ordinal`` (block null) tell which document was put where; the
    scan does not read them.
    """
    doc_id, back = by_name(docs)

    def run(batches):
        from pyspark import TaskContext

        file, block, ordinal, rest = TaskContext.get().partitionId(), 0, 0, b""
        size = block_ids * np.dtype(dtype).itemsize
        encode = encoder(tokenizer, special=False)
        pd = None
        for pdf in batches:
            pd = pdf.__class__
            out, parts = [], [rest]
            for ids in encode.many(pdf["text"].tolist()):
                parts.append(np.append(ids, np.uint32(close)).astype(dtype).tobytes())
            data = b"".join(parts)
            whole = len(data) - len(data) % size
            for k in range(0, whole, size):
                out.append((block, data[k : k + size]))
                block += 1
            rest = data[whole:]
            yield pd({"file": file, "doc_id": pdf["doc_id"], "ordinal": np.arange(ordinal, ordinal + len(pdf)), "block": None, "data": None})
            ordinal += len(pdf)
            if out:
                yield pd([(file, None, None, b, d) for b, d in out], columns=["file", "doc_id", "ordinal", "block", "data"])
        if rest:
            yield pd({"file": [file], "doc_id": [None], "ordinal": [None], "block": [block], "data": [rest]})

    schema = "file long, doc_id string, ordinal long, block long, data binary"
    return back(docs.select(doc_id, "text").mapInPandas(run, schema))


def read_flat(spark: SparkSession, path: str, dtype: str = DTYPE, block_ids: int = BLOCK_IDS, whole: int = WHOLE) -> DataFrame:
    """Blocks of raw token files: ``file, block, data``.

    Files of at most ``whole`` bytes are read by Spark, from any store. Larger ones are listed by Spark and
    read block by block, each task some byte ranges, through Arrow's file systems (local, HDFS, S3 and others).
    """
    size = block_ids * np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").load(path)
    schema = "file string, block long, data binary"

    def cut(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                for k in range(0, len(content), size):
                    yield pdf.__class__({"file": [name], "block": [k // size], "data": [content[k : k + size]]})

    def fetch(batches):
        import re

        from pyarrow import fs

        for pdf in batches:
            for name, own in pdf.groupby("path"):
                store, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
                with store.open_input_file(inner) as f:
                    for block in own["block"].tolist():
                        f.seek(block * size)
                        yield pdf.__class__({"file": [name], "block": [block], "data": [f.read(size)]})

    small = files.where(F.col("length") <= whole).select("path", "content").mapInPandas(cut, schema)
    large = files.where(F.col("length") > whole).select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("block"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return small.unionAll(large.repartition(n, "path", F.floor(F.col("block") / SPAN)).mapInPandas(fetch, schema))


def scan(blocks: DataFrame, close: int = CLOSE, dtype: str = DTYPE, span: int = SPAN) -> DataFrame:
    """``file, ordinal, start, n_tokens, closed`` of every document of the files."""

    def find(batches):
        for pdf in batches:
            rows = []
            for file, block, data in zip(pdf["file"], pdf["block"], pdf["data"], strict=True):
                ids = np.frombuffer(data, dtype)
                at = np.flatnonzero(ids == close)
                rows.append((file, block, len(ids), at.astype(np.int32)))
            yield pdf.__class__(rows, columns=["file", "block", "n", "seps"])

    kind = blocks.schema["file"].dataType.simpleString()
    found = written(blocks.select("file", "block", "data").mapInPandas(find, f"file {kind}, block long, n int, seps array<int>"))
    # prefix scan: within spans of blocks, over the spans, and both together
    sums = found.select("file", "block", F.floor(F.col("block") / span).alias("s"), F.col("n").cast("long").alias("n"), F.size("seps").cast("long").alias("k"), F.get("seps", F.size("seps") - 1).cast("long").alias("last"))
    within = Window.partitionBy("file", "s").orderBy("block")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = sums.withColumns({"n0": F.coalesce(F.sum("n").over(before), zero), "k0": F.coalesce(F.sum("k").over(before), zero)})
    sums = sums.withColumn("last", F.col("n0") + F.col("last"))
    sums = sums.withColumn("last0", F.max("last").over(before))
    totals = sums.groupBy("file", "s").agg(F.sum("n").alias("tn"), F.sum("k").alias("tk"), F.max("last").alias("tl"))
    over = Window.partitionBy("file").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({"sn": F.coalesce(F.sum("tn").over(over), zero), "sk": F.coalesce(F.sum("tk").over(over), zero)})
    totals = totals.withColumn("tl", F.col("sn") + F.col("tl")).withColumn("sl", F.max("tl").over(over))
    scanned = sums.join(totals.select("file", "s", "sn", "sk", "sl"), ["file", "s"]).select(
        "file", "block", "n", (F.col("sn") + F.col("n0")).alias("base"), (F.col("sk") + F.col("k0")).alias("first"),
        (F.coalesce(F.col("sn") + F.col("last0"), F.col("sl"), F.lit(-1)) + 1).alias("open"),
    )
    rows = found.select("file", "block", "seps").join(scanned, ["file", "block"])
    docs = rows.select("file", "first", "base", "open", "seps", F.posexplode("seps").alias("i", "sep")).select(
        "file", (F.col("first") + F.col("i")).alias("ordinal"),
        F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("base") + F.get("seps", F.col("i") - 1) + 1).alias("start"),
        (F.col("base") + F.col("sep")).alias("end"),
    ).select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(True).alias("closed"))
    ends = totals.groupBy("file").agg(F.max(F.struct("s", (F.col("sn") + F.col("tn")).alias("n"), (F.col("sk") + F.col("tk")).alias("k"), F.coalesce("tl", "sl", F.lit(-1)).alias("l"))).alias("e"))
    rest = ends.where("e.n > e.l + 1").select("file", F.col("e.k").alias("ordinal"), (F.col("e.l") + 1).alias("start"), (F.col("e.n") - F.col("e.l") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return docs.unionAll(rest)


def count_tokens(docs: DataFrame, tokenizer: str, close: int = CLOSE) -> DataFrame:
    """Write docs as flat token files, scan these, and put each count to its document: ``doc_id, n_tokens``."""
    flat = written(write_flat(docs, tokenizer, close), "zstd", TEXTS)
    counts = scan(flat.where("block is not null"), close)
    names = flat.where("block is null").select(F.col("file").alias("_f"), F.col("ordinal").alias("_o"), "doc_id")
    return names.join(counts, (F.col("_f") == F.col("file")) & (F.col("_o") == F.col("ordinal"))).select("doc_id", "file", "ordinal", "start", "n_tokens")
