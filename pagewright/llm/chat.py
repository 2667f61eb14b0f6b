"""Preference formatting of paired conversations, in DataFrame functions alone.

The longest common prefix of the turns of a chosen and a rejected conversation is
rendered once as the prompt; what follows in each is its completion, with spans of
characters that a loss applies to: the texts of assistant turns and their end marks.

Defined cases: turns are ordered by (turn, role, text), nulls first; a null role or text
renders as an empty one, and equals only a null. A conversation without a partner has an
empty other completion. Where both are alike, both completions are empty. Repeated rows
are turns of their own. Rows of a null conversation belong to no pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, SHUT, END = "<|", "|>\n", "<|end|>\n"


def _render(turn):
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(SHUT), F.coalesce(turn["text"], F.lit("")), F.lit(END))


def _spans(turns):
    """Start and end of what a loss applies to, in characters of the rendered turns."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, turn):
        start = acc["at"] + F.length(F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(SHUT)))
        end = acc["at"] + F.length(_render(turn))
        own = F.when(turn["role"] == "assistant", F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], own).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def format_preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: ``pair_id, chosen, rejected`` (conversation ids). One row a pair.

    Returns ``pair_id, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans``.
    """
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.col("chosen").alias("_conv"), F.lit(0).alias("side")), F.struct(F.col("rejected").alias("_conv"), F.lit(1).alias("side")))).alias("x")).select("pair_id", "x._conv", "x.side")
    turn = F.struct("turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", "text").join(sides, F.col("conv_id") == F.col("_conv"))
    both = rows.groupBy("pair_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == k, turn))).alias(name) for k, name in ((0, "a"), (1, "b"))])
    alike = F.zip_with("a", "b", lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(alike, F.lit(False))
    both = both.withColumn("n_common", F.when(first > 0, first - 1).otherwise(F.size(alike)).cast("int"))
    rest = {c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0))) for c in "ab"}
    both = both.select("pair_id", "n_common", F.slice("a", 1, F.col("n_common")).alias("p"), rest["a"].alias("a"), rest["b"].alias("b"))
    text = lambda c: F.array_join(F.transform(c, _render), "")
    return both.select("pair_id", "n_common", text("p").alias("prompt"), text("a").alias("chosen"), text("b").alias("rejected"), _spans("a").alias("chosen_spans"), _spans("b").alias("rejected_spans"))
