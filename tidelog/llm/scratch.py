"""Small frame helpers; ``Scratch`` is shared with the metadata operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.scratch import Scratch

__all__ = ["Scratch", "copies", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def copies(count: Column | str, per_tile: int) -> Column:
    """Number of tiles of about ``per_tile`` members for a group of ``count``."""
    return F.ceil(F.col(count) / F.lit(per_tile)).cast("int") if isinstance(count, str) else F.ceil(count / F.lit(per_tile)).cast("int")
