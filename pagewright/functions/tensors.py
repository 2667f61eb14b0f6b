"""Pixel and probability arithmetic on array columns, for SQL users and for tests of the NumPy forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_channel(px: Column, mean: float, std: float) -> Column:
    return (px / F.lit(255.0) - F.lit(float(mean))) / F.lit(float(std))


def normalize_crop(px: Column) -> Column:
    return (px / F.lit(255.0) - F.lit(0.5)) / F.lit(0.5)


def gray(p: Column) -> Column:
    """A probability as a byte; null and NaN are 0, and values beyond the ends are cut."""
    x = F.coalesce(F.nanvl(p.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.round(x * F.lit(255.0)))).cast("int")
