"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last two lines chooses where chunks end, so
boundaries depend on nearby lines alone and survive shifts. A line of more than LONG_WORDS words
is a chunk of its own. Chunks that recur anywhere are compared by bytes, and all but the first are removed.

Only chunks with two or more lines that hold a word, or with such a long line, are removed. First is the least
(doc_id, hash of text, chunk), null ids last. Only hashes are counted at first; bytes are compared
for chunks whose hash recurs. A hash with more than a SHARE of all chunks is dealt over SALTS tasks.

Defined cases: a null text stays null and takes no part; an empty one stays. Rows with equal id and text are one
document: they keep or lose the same chunks. Columns other than text stay as they are, and may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, prefix_for, written

#: A line ends a chunk when the first byte of the rolling hash is below 256 / DIVISOR.
DIVISOR = 3
MIN_LINES = 2
LONG_WORDS = 50
#: Hashes with more than this share of all chunks (fewer than 1 / SHARE of them), and the tasks that each is dealt over.
SHARE = 1e-3
SALTS = 32


def chunks(docs: DataFrame, own: str, divisor: int = DIVISOR) -> DataFrame:
    """Add ``lines``, ``n`` (words of each line) and ``ends`` (0-based last lines of the chunks), with the prefix own."""
    lines, n, h, ends = (F.col(f"{own}{c}") for c in ("lines", "n", "h", "ends"))
    df = docs.withColumn(f"{own}lines", F.split("text", "\n"))
    df = df.withColumns({f"{own}n": F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD))), f"{own}h": F.transform(lines, lambda x: F.md5(x))})
    rolls = lambda x, i: F.conv(F.substring(F.md5(F.concat(F.get(h, i - 1), x)), 1, 2), 16, 10).cast("int") < 256 // divisor
    long = lambda i: F.coalesce(F.get(n, i) > LONG_WORDS, F.lit(False))
    stop = lambda x, i: (i == F.size(h) - 1) | long(i) | long(i + 1) | F.coalesce(rolls(x, i), F.lit(False))
    df = df.withColumn(f"{own}ends", F.filter(F.transform(h, lambda x, i: F.when(stop(x, i), i)), lambda i: i.isNotNull()))
    return df.drop(f"{own}h")


def _span(values, ends, k):
    """The part of an array over lines that belongs to chunk k."""
    start = F.when(k == 0, 0).otherwise(F.get(ends, k - 1) + 1)
    return F.slice(values, start + 1, F.get(ends, k) - start + 1)


def removable(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """The chunks that may be removed, once for rows alike: ``d, k`` (doc_id, hash of text), ``idx``, ``chunk``, ``h``."""
    own = docs.where("text is not null").select("doc_id", "text").withColumn("k", F.xxhash64("text"))
    df = chunks(own, "c_", divisor)
    each = F.transform("c_ends", lambda e, k: F.struct(k.alias("idx"), _span(F.col("c_lines"), F.col("c_ends"), k).alias("lines"), _span(F.col("c_n"), F.col("c_ends"), k).alias("n")))
    fit = F.filter(each, lambda c: (F.size(F.filter(c["n"], lambda n: n > 0)) >= min_lines) | F.exists(c["n"], lambda n: n > LONG_WORDS))
    # explode would infer a filter that repeats the arrays' expressions
    rows = df.select(F.col("doc_id").alias("d"), "k", F.explode_outer(F.transform(fit, lambda c: F.struct(c["idx"].alias("idx"), F.array_join(c["lines"], "\n").alias("chunk")))).alias("c"))
    return rows.where("c is not null").select("d", "k", "c.idx", "c.chunk", F.xxhash64("c.chunk").alias("h"))


def repeated_chunks(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES, share: float = SHARE, salts: int = SALTS) -> DataFrame:
    """Occurrences to remove: ``d, k, idx``."""
    rows = removable(docs, divisor, min_lines)
    often = written(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    total = often.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(often.where(F.col("n") > max(100, share * total)).select("h", F.lit(salts).alias("of")))  # fewer than 1 / share rows
    place = F.struct(F.col("d").isNull().alias("no"), F.col("d").alias("d"), F.col("k").alias("k"), F.col("idx").alias("i"))
    salted = rows.join(heavy, "h", "left").withColumn("s", F.coalesce(F.pmod(F.xxhash64("k", "idx", F.coalesce(F.col("d").cast("string"), F.lit(""))), F.col("of").cast("long")), F.lit(0)))
    spread = lambda df: df.join(heavy, "h", "left").withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("of") - 1, F.lit(0)).cast("long"))))
    kept = salted.drop("of").join(spread(often.select("h")).select("h", "s"), ["h", "s"], "left_semi")
    # the chunk's bytes are part of the key: equal hashes of unlike chunks don't meet
    each = kept.groupBy("h", "s", "chunk").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    first = each.groupBy("h", "chunk").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").select("h", "chunk", "first")
    first = spread(first).select("h", "s", "chunk", "first")
    return kept.join(first, ["h", "s", "chunk"]).where(~place.eqNullSafe(F.col("first"))).select("d", "k", "idx")


def dedup_lines(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES, counts: tuple[str, str] | None = None) -> DataFrame:
    """The rows of docs with ``text`` lessened; counts: names of two more columns, the chunks of a text and those removed."""
    own = prefix_for(docs)
    name = lambda c: f"{own}{c}"
    gone = repeated_chunks(docs, divisor, min_lines).groupBy("d", "k").agg(F.collect_set("idx").alias(name("gone")))
    gone = gone.select(F.col("d").alias(name("d")), F.col("k").alias(name("key")), name("gone"))
    key = F.coalesce(F.xxhash64("text"), F.lit(0))
    df = docs.withColumn(name("own"), key)
    df = df.join(gone, F.col("doc_id").eqNullSafe(F.col(name("d"))) & (F.col(name("own")) == F.col(name("key"))) & F.col("text").isNotNull(), "left")
    df = chunks(df, own, divisor)
    lines, ends, out = F.col(name("lines")), F.col(name("ends")), F.col(name("gone"))
    spans = F.filter(F.transform(ends, lambda e, k: F.when(~F.array_contains(out, k), _span(lines, ends, k))), lambda x: x.isNotNull())
    text = F.when(out.isNull(), F.col("text")).otherwise(F.array_join(F.flatten(spans), "\n"))
    more = [F.coalesce(F.size(x), F.lit(0)).alias(c) for c, x in zip(counts, (ends, out), strict=True)] if counts else []
    return df.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], *more)
