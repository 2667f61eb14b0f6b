"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size gives the copies that each of its documents has on average:
whole copies are certain and the rest is a fractional probability. Two documents at a
time, word mass moves from one to the other until one probability is 0 or 1; which
way it moves is random, so that each expectation stays. The words of a source that are
taken stay equal to its target but for the last document that is left. Each task
rounds a bucket of documents and leaves one residual a source; residuals are combined
by the same step in a tree of fan-in FAN.

Defined cases: a null text has size 0 and takes no words; a null source is a source, last in
order. A source of size 0 has target 0. Repeated rows are documents of their own. Random
numbers come from hashes of the rows, so reruns agree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_name, n_words, prefix_for, ranked, written
from .tokens import let_go

WEIGHTS = (5, 2, 1)
MOST = 3.0
#: Documents of a bucket, and residual buckets that a tree node combines.
BUCKET = 1_024
FAN = 16


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """``source, size`` to ``source, source_size, target``: shares by weight, at most ``most`` times a size.

    A share is level * weight until it meets its cap; the level rises until all is shared.
    Each turn is one sum over the table of sources; only totals come to the driver.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    each = F.array(*[F.lit(float(w)) for w in weights])
    place = ranked(by, [F.col("source").asc_nulls_last()])
    place = written(place.withColumn("w", F.get(each, F.pmod("rank", F.lit(len(weights))).cast("int"))))
    total = place.agg(F.sum("source_size")).first()[0] or 0
    level, cap = 0.0, F.col("source_size") * F.lit(most)
    while total:
        full = cap <= F.col("w") * F.lit(level)
        r = place.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        new = (total - r[0]) / r[1] if r[1] else level
        if new <= level:
            break
        level = new
    return place.select("source", "source_size", F.least(cap, F.col("w") * F.lit(level)).alias("target"))


def _pivot(x: np.ndarray, a: np.ndarray, rng) -> int | None:
    """Round x (in place) by pairs, in order; a: mass at 1. The index that is left fractional, if any."""
    at = None
    u = rng.random(len(x))
    for k in range(len(x)):
        if not 0 < x[k] < 1:
            continue
        if at is None:
            at = k
            continue
        i, j = at, k
        up, down = min((1 - x[i]) * a[i], x[j] * a[j]), min(x[i] * a[i], (1 - x[j]) * a[j])
        if u[k] * (up + down) < down:  # mass moves from j to i
            done_i = (1 - x[i]) * a[i] <= x[j] * a[j]
            x[i], x[j] = (1.0 if done_i else x[i] + up / a[i]), (x[j] - up / a[j] if done_i else 0.0)
        else:
            done_i = x[i] * a[i] <= (1 - x[j]) * a[j]
            x[i], x[j] = (0.0 if done_i else x[i] - down / a[i]), (x[j] + down / a[j] if done_i else 1.0)
        at = j if done_i else i
        if not 1e-12 < x[at] < 1 - 1e-12:
            x[at] = round(x[at])
            at = None
    return at


def _round(pdf, last: bool, columns):
    """One source of one bucket, by size from the largest."""
    import xxhash

    x, a = pdf["x"].to_numpy(float).copy(), pdf["size"].to_numpy(float)
    name = pdf["source"].iloc[0]
    seed = xxhash.xxh64_intdigest(f"{name!r}|{pdf['bucket'].iloc[0]}|{len(x)}|{a.sum()}")
    rng = np.random.default_rng(seed)
    if (k := _pivot(x, a, rng)) is not None and last:
        x[k] = float(rng.random() < x[k])
    return pdf.assign(x=x)[columns]


def mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, source, size, h`` (a hash of the text), ``source_size, target, copies`` of every row."""
    spark = docs.sparkSession
    doc_id, back = by_name(docs)
    sized = written(docs.select(doc_id, F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h")))
    targets = source_targets(sized, weights, most)
    n = max(1, -(-sized.count() // bucket))
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (
        sized.join(t, F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("rate", rate)
        .withColumn("whole", F.floor("rate"))
        .withColumn("x", F.when(F.col("size") > 0, F.col("rate") - F.col("whole")).otherwise(0.0))
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "h"), F.lit(n)))
        .drop("rate")
    )
    columns = ["doc_id", "source", "size", "h", "source_size", "target", "whole", "x", "bucket"]
    schema = rows.select(columns).schema

    def deal(last: bool):
        def run(batches):
            import pandas as pd

            def groups(pdf):
                for _, g in pdf.groupby(["bucket", "source"], dropna=False, sort=False):
                    yield _round(g, last, columns)

            let_go()
            rest = None
            for pdf in batches:
                if rest is not None:
                    pdf = pd.concat([rest, pdf], ignore_index=True)
                own = pdf["source"].fillna("\0none")
                same = ((pdf["bucket"] == pdf["bucket"].iloc[-1]) & (own == own.iloc[-1])).to_numpy()
                rest = pdf[same]
                if not same.all():
                    yield from groups(pdf[~same])
            if rest is not None:
                yield from groups(rest)

        return run

    def level(df: DataFrame, last: bool) -> DataFrame:
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        order = ["bucket", "source", F.desc("size"), "doc_id", "h", "x"]
        out = df.select(columns).repartition(width, "bucket", "source").sortWithinPartitions(*order)
        return written(out.mapInPandas(deal(last), schema))

    open_ = (F.col("x") > 0) & (F.col("x") < 1)
    done, left = [], rows
    while True:
        out = level(left, n == 1)
        done.append(out.where(~open_))
        if n == 1:
            break
        n = -(-n // FAN)
        left = out.where(open_).withColumn("bucket", F.floor(F.col("bucket") / FAN))
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return back(out).select("doc_id", "source", "size", "h", "source_size", "target", (F.col("whole") + F.col("x").cast("long")).alias("copies"))


def mixed_rows(docs: DataFrame, weights=WEIGHTS, most: float = MOST, bucket: int = BUCKET) -> DataFrame:
    """The rows of docs, each as often as the mix takes it.

    Rows are found by id, source and hash of the text, in one shuffle; only rows alike in all three are numbered, and
    share what the mix takes of them as evenly as it did (such rows are in one task).
    """
    own = prefix_for(docs)
    name = lambda c: f"{own}{c}"
    text = lambda c: {name(f"{c}_none"): F.col(c).isNull(), name(c): F.coalesce(F.col(c).cast("string"), F.lit(""))}
    keys = [*text("doc_id"), *text("source"), name("h")]
    taken = mix(docs, weights, most, bucket).withColumns(text("doc_id") | text("source")).withColumnRenamed("h", name("h"))
    taken = taken.groupBy(*keys).agg(F.sum("copies").alias(name("sum")), F.count("*").alias(name("rows"))).where(F.col(name("sum")) > 0)
    found = docs.withColumns(text("doc_id") | text("source") | {name("h"): F.coalesce(F.xxhash64("text"), F.lit(0))}).join(taken, keys)
    total, rows, n = F.col(name("sum")), F.col(name("rows")), F.col(name("n"))
    one = found.where(rows == 1).withColumn(name("n"), total)
    some = found.where(rows > 1).withColumn(name("n"), F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]))))
    some = some.withColumn(name("n"), F.floor(total / rows) + (n <= total % rows).cast("long")).where(n > 0)
    out = one.unionByName(some).withColumn(name("copy"), F.explode(F.sequence(F.lit(1), n.cast("int"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
