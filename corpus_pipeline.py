"""A corpus pipeline of five stages over ``documents``: each works on all that the one before it kept.

Language ID rejects texts that are of no language, or of none with at least LEAST_SCORE.
Line dedup removes repeated chunks of lines from texts. SimHash keeps the least doc_id of each
group of near copies: texts whose fingerprints operator 8 links, or that share 0.8 of their five-word shingles. Mixing repeats or drops rows to meet the sources' target weights. Packing
returns the pieces of the rows that are left.

Defined cases: a null or empty text, or one without a letter, is of no language and goes in the first stage. Null ids,
sources and other columns stay as they are; rows alike in id and text are one after the near-copy stage. A text
that line dedup leaves empty stays, and texts without a word are one group of near copies; mixing gives them the whole copies of their source alone.
An empty table gives no pieces. Extra columns of any names stay until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import language_id, line_dedup, mixing, packing, similar
from pagewright.llm.common import table, written
from pagewright.llm.queries import tokenizer_path

#: A text whose best language has less than this share of the probability is rejected.
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with equal doc_id and text are judged alike; the text itself is judged, so no join is needed."""
    return language_id.keep_known(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"), LEAST_SCORE)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8 in full, then an exact search for the similar texts that its 64 bits leave apart."""
    return similar.keep_similar(docs, fingerprints=True)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(), derive=lambda ids: {"ids_crc32": F.crc32(ids)})


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express neither the models nor the random rounding; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
