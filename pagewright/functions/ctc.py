"""Greedy CTC decoding with array functions, row by row: no shuffle and no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = 0
UNKNOWN = "<unk>"


def steps(logits: Column, t: Column, c: Column) -> Column:
    """Flat ``t * c`` values to an array of t arrays."""
    rows = F.when(t > 0, F.sequence(F.lit(0), t - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(rows, lambda k: F.slice(logits, k * c + 1, c))


def best(row: Column) -> Column:
    """``struct(k, p)``: the first of the largest values; a NaN is never one, and where all are NaN, class 0."""
    low = F.lit(float("-inf"))
    clean = F.transform(row, lambda x: F.when(F.isnan(x) | x.isNull(), low).otherwise(x.cast("double")))
    top = F.array_max(clean)
    return F.struct((F.array_position(clean, top) - 1).cast("int").alias("k"), top.alias("p"))


def argmaxes(logits: Column, t: Column, c: Column) -> Column:
    return F.transform(steps(logits, t, c), best)


def collapse(path: Column) -> Column:
    """Drop blanks and what repeats the step before; any class, in the dictionary or not, is a step before."""
    return F.filter(path, lambda s, i: (s["k"] != BLANK) & ((i == 0) | (s["k"] != F.get(path, i - 1)["k"])))


def symbols(kept: Column, dictionary: Column) -> Column:
    """``struct(ch, p)`` of each emitted class: the last one is a blank space unless it is the unknown mark."""
    last = F.size(dictionary) - 1
    known = F.filter(kept, lambda s: (s["k"] <= last) & ~((s["k"] == last) & (F.get(dictionary, s["k"]) == UNKNOWN)))
    return F.transform(known, lambda s: F.struct(F.when(s["k"] == last, F.lit(" ")).otherwise(F.get(dictionary, s["k"])).alias("ch"), s["p"].alias("p")))


def mean_left_to_right(values: Column) -> Column:
    """Sum in order, then divide; 0 for none."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(F.lit(0.0))


def decoded(emitted: Column) -> Column:
    """``struct(text, confidence)`` of symbols."""
    text = F.array_join(F.transform(emitted, lambda s: s["ch"]), "")
    return F.struct(text.alias("text"), mean_left_to_right(F.transform(emitted, lambda s: s["p"])).alias("confidence"))


def decode(df, logits: str, t: Column, c: Column, dictionary: Column, name: str = "decoded"):
    """Add ``name``; each step is a column, so that none is computed again inside another."""
    df = df.withColumn("_path", argmaxes(F.col(logits), t, c))
    df = df.withColumn("_kept", collapse(F.col("_path")))
    df = df.withColumn("_emitted", symbols(F.col("_kept"), dictionary))
    return df.withColumn(name, decoded(F.col("_emitted"))).drop("_path", "_kept", "_emitted")
