"""Quality rules by a hashed n-gram log-likelihood ratio, in DataFrame functions alone.

Words and pairs of words are hashed into buckets. One multinomial over the buckets comes from trusted
documents, the other from all documents; a document's score is the mean over its
n-grams of the log-ratio of the two. The threshold is a low quantile of the trusted
documents' own scores, so it is the same for every document and every run.

Defined cases: a null or empty text has no words and fails the base rules. Labels that are
null, or of ids that don't occur, count for nothing. Without a trusted document, the ratio is
0 and only base rules decide. Repeated rows are judged alike. Only doc_id, text and the
labels' doc_id, quality are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, written

BUCKETS = 1 << 13
#: Trusted documents that the target multinomial is fitted on, at most; the threshold is over all of them.
TRUSTED = 10_000
SMOOTHING = 1.0
#: The threshold: this quantile of the trusted documents' scores, less MARGIN.
QUANTILE = 0.001
MARGIN = 0.02
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def split_words(docs: DataFrame) -> DataFrame:
    """Add ``_words`` and ``_h``, their hashes."""
    clean = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE + "+", " "))
    df = docs.withColumn("_clean", clean)
    df = df.withColumn("_words", F.when(F.col("_clean") == "", F.array().cast("array<string>")).otherwise(F.split("_clean", " ")))
    return df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))


def gram_buckets(buckets: int) -> Column:
    """Buckets of the words, and of the pairs of words, of ``_h``."""
    one = F.transform("_h", lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    n = F.size("_h")
    pair = F.transform(F.slice("_h", 2, F.greatest(n - 1, F.lit(0))), lambda h, i: F.pmod(F.xxhash64(F.get("_h", i), h), F.lit(buckets)).cast("int"))
    return F.concat(one, pair)


def base_features(docs: DataFrame) -> DataFrame:
    """Add the counts of the base rules to rows that have been through split_words."""
    text = F.coalesce("text", F.lit(""))
    n = F.size("_words")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    h = lambda k: F.get("_h", k)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    df = docs.withColumn("_w", F.transform(starts, lambda i: F.xxhash64(*[h(i + k) for k in range(WINDOW)])))
    # windows found twice: neighbours when sorted by hash, then by place; looked for only where a hash recurs
    placed = F.sort_array(F.transform("_w", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    at = lambda x: x["i"]
    words = lambda x: F.slice("_words", at(x) + 1, WINDOW)
    same = lambda x, y: (x["h"] == y["h"]) & (words(x) == words(y))
    twice = F.filter("_s", lambda x, i: F.coalesce(same(x, F.get("_s", i - 1)), F.lit(False)) | F.coalesce(same(x, F.get("_s", i + 1)), F.lit(False)))
    df = df.withColumn("_t", F.sort_array(F.transform(twice, at)))
    covered = F.transform("_t", lambda p, i: F.when(i == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), p - F.get("_t", i - 1))))
    return df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": (F.length("_clean") - F.greatest(n - 1, F.lit(0))).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x),
    })


def log_ratio(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """Log of the trusted over the raw probability of each bucket; trusted: ids, of bounded number."""
    mark = F.broadcast(trusted.select(F.col("_id"), F.lit(1).alias("_good")))
    grams = (
        split_words(docs.select("doc_id", "text"))
        .select("doc_id", gram_buckets(buckets).alias("g"))
        .join(mark, F.col("doc_id") == F.col("_id"), "left")
        # explode would infer a filter that repeats the arrays' expressions, one inside another
        .select("_good", F.explode_outer("g").alias("b"))
    )
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count("_good").alias("good")).collect()  # buckets rows
    raw, good = [SMOOTHING] * buckets, [SMOOTHING] * buckets
    for r in counts:
        if r["b"] is None:  # of documents without words
            continue
        raw[r["b"]] += r["raw"]
        good[r["b"]] += r["good"]
    if sum(good) == SMOOTHING * buckets:
        return [0.0] * buckets
    import math

    all_raw, all_good = sum(raw), sum(good)
    return [math.log(g / all_good) - math.log(r / all_raw) for g, r in zip(good, raw, strict=True)]


def score(ratio: list[float]) -> Column:
    """Mean log-ratio of the n-grams of ``_h``; the ratios are a literal of fixed length."""
    values = F.expr(f"cast(split('{','.join(repr(x) for x in ratio)}', ',') as array<double>)")
    grams = gram_buckets(len(ratio))
    total = F.aggregate(grams, F.lit(0.0), lambda a, b: a + F.get(values, b))
    return F.when(F.size("_h") > 0, total / (2 * F.size("_h") - 1)).otherwise(0.0)


def low_quantile(scores: DataFrame, quantile: float) -> float | None:
    """The exact quantile, between neighbours in proportion; only the lowest share of the scores is gathered."""
    n = scores.count()
    if not n:
        return None
    at = quantile * (n - 1)
    low = [r["score"] for r in scores.orderBy("score").limit(int(at) + 2).collect()]
    a, b = low[int(at)], low[min(int(at) + 1, len(low) - 1)]
    return a + (b - a) * (at - int(at))


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted: int = TRUSTED, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """Base counts, ``base_failed``, ``score`` and ``kept`` of every row."""
    every = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    good = written(every.orderBy(F.xxhash64("_id"), "_id").limit(trusted))
    ratio = log_ratio(docs, good, buckets)
    # narrow, so that no text is scored twice
    df = written(base_features(split_words(docs.select("doc_id", "text"))).withColumn("score", score(ratio)).select("doc_id", *COUNTS, "score"))
    low = low_quantile(df.join(every, F.col("doc_id") == F.col("_id"), "left_semi").select("score"), quantile)
    limit = (low if low is not None else 0.0) - margin
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.withColumn("base_failed", failed).select(
        "doc_id", *COUNTS, "base_failed",
        (~F.col("base_failed") & (F.col("score") >= F.lit(limit))).alias("kept"), "score",
    )
