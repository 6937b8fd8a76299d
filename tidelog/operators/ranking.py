"""The first n rows per group without ever sending a whole group to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def first_per_group(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    n: int,
    spread: list[str],
    rank: str = "rank",
    salts: int = SALTS,
) -> DataFrame:
    """The ``n`` first rows of each group by ``order``, numbered in ``rank``.

    Ranked twice: inside ``salts`` slices of the group first, then over the at
    most ``n * salts`` rows left of it.  ``spread`` names columns that tell rows
    of a group apart, so a hot group is cut into even slices.
    """
    slice_of = F.pmod(F.xxhash64(*spread), F.lit(salts))
    within_slice = Window.partitionBy(*keys, "_slice").orderBy(*order)
    survivors = (
        df.withColumn("_slice", slice_of)
        .withColumn("_r", F.row_number().over(within_slice))
        .where(F.col("_r") <= n)
        .drop("_r", "_slice")
    )
    whole_group = Window.partitionBy(*keys).orderBy(*order)
    return survivors.withColumn(rank, F.row_number().over(whole_group)).where(F.col(rank) <= n)
