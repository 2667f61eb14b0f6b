"""Where results go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"pretty": "true"})


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_debug(df: DataFrame, folder: str) -> None:
    """Debug images by kind, in place of those of an earlier run."""
    df.write.mode("overwrite").partitionBy("kind").parquet(folder)
