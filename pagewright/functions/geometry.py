"""Box and image sizes as column expressions: all of it stays in code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRIDE = 32
#: A final box needs sides above this.
LEAST_SIDE = 5
LEAST_CROP = 8
#: The double just below a half: added before a floor, it rounds every double right, 0.49999999999999994 too.
BELOW_HALF = 0.49999999999999994


def half_up(x: Column) -> Column:
    """Round halves toward positive infinity."""
    return F.floor(x + F.when(x < 0, F.lit(0.5)).otherwise(F.lit(BELOW_HALF))).cast("int")


def rounded(x: Column) -> Column:
    """The same for what is never negative, naming x once. round() itself goes by way of decimals, and takes far longer."""
    return F.floor(x + F.lit(BELOW_HALF)).cast("int")


def resized(width: Column, height: Column, max_side: int = 960) -> Column:
    """``struct(resize_w, resize_h, ratio, model_w, model_h)``: shrunk to max_side, never grown, then padded to the stride."""
    side = F.greatest(width, height)
    ratio = F.when(side > max_side, F.lit(float(max_side)) / side).otherwise(F.lit(1.0))
    w, h = (F.when(side > max_side, rounded(x * ratio)).otherwise(x.cast("int")) for x in (width, height))
    padded = lambda x: (F.ceil(x / F.lit(STRIDE)) * STRIDE).cast("int")
    return F.struct(w.alias("resize_w"), h.alias("resize_h"), ratio.alias("ratio"), padded(w).alias("model_w"), padded(h).alias("model_h"))


def box(x, y, width, height) -> Column:
    return F.struct(*[c.cast("int").alias(n) for c, n in ((x, "x"), (y, "y"), (width, "width"), (height, "height"))])


def large_enough(b: Column, min_area: float = 20) -> Column:
    """On the box as found, before padding; an area of min_area itself is too small."""
    return b["width"] * b["height"] > F.lit(min_area)


def padded(b: Column, model_w: Column, model_h: Column, vertical: float = 0.4, horizontal: float = 0.6) -> Column:
    """Grown on all sides by shares of its height, within the model's image."""
    v, h = (rounded(b["height"] * F.lit(float(k))) for k in (vertical, horizontal))
    x, y = F.greatest(F.lit(0), b["x"] - h), F.greatest(F.lit(0), b["y"] - v)
    right = F.least(model_w, b["x"] + b["width"] + h)
    bottom = F.least(model_h, b["y"] + b["height"] + v)
    return box(x, y, right - x, bottom - y)


def rescaled(b: Column, ratio: Column, width: Column, height: Column) -> Column:
    """Back to the original image's pixels, within it."""
    x, y = (rounded(F.greatest(F.lit(0.0), b[k] / ratio)) for k in ("x", "y"))
    at = {k: half_up(b[k] / ratio) for k in ("width", "height")}
    return box(x, y, F.least(width.cast("int") - x, at["width"]), F.least(height.cast("int") - y, at["height"]))


def final(b: Column) -> Column:
    return (b["width"] > LEAST_SIDE) & (b["height"] > LEAST_SIDE)


def valid(b: Column) -> Column:
    return (b["width"] > 0) & (b["height"] > 0)


def corners(b: Column) -> Column:
    return F.struct(b["x"].alias("x0"), b["y"].alias("y0"), (b["x"] + b["width"]).alias("x1"), (b["y"] + b["height"]).alias("y1"))


def crop_width(b: Column, image_height: int = 48) -> Column:
    """Width of a crop that is resized to image_height; null for a crop without pixels."""
    w = rounded(F.lit(float(image_height)) * b["width"] / b["height"])
    return F.when(valid(b), F.greatest(F.lit(LEAST_CROP), w))


def crop_name(index: Column) -> Column:
    return F.format_string("crop_%03d.png", index)


def settled(df: DataFrame, name: str, b: Column) -> DataFrame:
    """Add a box whose numbers are columns of their own.

    The optimizer copies a struct's expressions into all that reads its fields; over a chain of
    steps these would double again and again.
    """
    own = {n: f"_{name}_{n}" for n in ("x", "y", "width", "height")}
    df = df.withColumns({c: b[n] for n, c in own.items()})
    return df.withColumn(name, F.struct(*[F.col(c).alias(n) for n, c in own.items()])).drop(*own.values())


def only_final(df: DataFrame, name: str) -> DataFrame:
    """Rows whose box is large enough at the end of a chain.

    The row number keeps the test above the chain: pushed below, it would name each step's
    expressions over and over, beyond what one generated method may hold. Cheap tests belong before the chain.
    """
    return df.withColumn("_row", F.monotonically_increasing_id()).where((F.col("_row") >= 0) & final(F.col(name))).drop("_row")
