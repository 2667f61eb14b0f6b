"""Reading order, lines and page text.

Lines are a fold over the ordered items of one page, within its row. Reading order compares
pairs by a rule that is no total order, so it is a stable sort by that rule in an Arrow
function; the JVM's own sort refuses such rules.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.ctc import mean_left_to_right
from pagewright.schemas import ITEMS


def order_of(y: list, x: list, height: list) -> list[int]:
    """Places in reading order: beside each other, by x; else by y. Boxes are beside each other within a quarter of their joint height."""

    def before(a: int, b: int):
        dy = y[a] - y[b]
        return x[a] - x[b] if abs(dy) < (height[a] + height[b]) / 4 else dy

    return sorted(range(len(y)), key=functools.cmp_to_key(before))


def in_reading_order(items: list[dict]) -> list[dict]:
    return [items[k] for k in order_of(*([i["box"][n] for i in items] for n in ("y", "x", "height")))]


def reading_order():
    """A function of an array of items; ties keep the order that they came in. Only three numbers of each box go to Python."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches):
        for columns in batches:
            yield pd.Series([None if y is None else order_of(*(v.tolist() for v in (y, x, h))) for y, x, h in zip(*columns, strict=True)])

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    order = F.pandas_udf(run, "array<int>").asNondeterministic()

    def ordered(items: str) -> Column:
        side = lambda name: F.transform(items, lambda i: i["box"][name])
        return F.transform(order(side("y"), side("x"), side("height")), lambda k: F.get(items, k))

    return ordered


def reading_order_udf():
    """The same as one function, for SQL."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches):
        for column in batches:
            yield pd.Series([None if v is None else in_reading_order(list(v)) for v in column])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, ITEMS).asNondeterministic()


def lines(items: Column, kind: str) -> Column:
    """Cut ordered items into lines, ``array<array<item>>``; kind: the item's type in SQL.

    An item joins the line if its y is within half of the line's mean height of the item before. The fold
    carries numbers and the places where lines begin, and copies the latter only at a break; lines are then slices.
    """
    zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(0.0).alias("heights"), F.lit(None).cast("int").alias("y"))

    def step(acc, item):
        height = item["box"]["height"].cast("double")
        joins = (acc["n"] > 0) & F.coalesce(F.abs(item["box"]["y"] - acc["y"]) <= F.lit(0.5) * (acc["heights"] / acc["n"]), F.lit(False))
        return F.struct(
            F.when(joins, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["i"]))).alias("starts"),
            (acc["i"] + 1).alias("i"),
            F.when(joins, acc["n"] + 1).otherwise(F.lit(1)).alias("n"),
            F.when(joins, acc["heights"] + height).otherwise(height).alias("heights"),
            item["box"]["y"].alias("y"),
        )

    starts = F.aggregate(items, zero, step, lambda acc: F.concat(acc["starts"], F.array(acc["i"])))  # and the end
    cut = lambda s: F.transform(F.slice(s, 1, F.size(s) - 1), lambda at, k: F.slice(items, at + 1, F.get(s, k + 1) - at))
    return F.get(F.transform(F.array(starts), cut), 0)  # named once


def text_of(found: Column) -> Column:
    """Blanks within lines, line breaks between them; empty items still count."""
    return F.array_join(F.transform(found, lambda line: F.array_join(F.transform(line, lambda i: F.coalesce(i["text"], F.lit(""))), " ")), "\n")


def confidence_of(items: Column) -> Column:
    return mean_left_to_right(F.transform(items, lambda i: i["confidence"]))


def assemble(df, items: str = "items", flat: bool = False):
    """A page's ordered items to ``text``, ``lines`` (or ``results``) and ``confidence``; none to empty ones."""
    kind = df.schema[items].dataType.elementType.simpleString()
    df = df.withColumn("_items", F.coalesce(F.col(items), F.array().cast(f"array<{kind}>")))
    df = df.withColumn("_lines", lines(F.col("_items"), kind))
    df = df.drop(items).withColumns({"text": text_of(F.col("_lines")), "confidence": confidence_of(F.col("_items"))})
    return df.withColumnRenamed("_items", "results").drop("_lines") if flat else df.withColumnRenamed("_lines", "lines").drop("_items")
