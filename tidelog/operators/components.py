"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """``(node, component)`` for every node of ``links (a, b)``.

    The component is its smallest node.  Each round points the neighbours of a
    node at its smallest neighbour, first the larger ones, then the smaller
    ones; the rounds end when the table no longer changes, after about the
    logarithm of the longest chain.  Minima combine before the shuffle, joins on
    a hub are split by adaptive execution, and each round is a written table, so
    neither a hub nor a lost executor hurts.  Nulls and self-links are ignored.
    """
    a, b = F.col("a"), F.col("b")
    edges = links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = scratch.write(edges, f"{name}-0")
    before = _state(edges)
    step = 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = large.unionByName(lowest.where("u != m").select("u", F.col("m").alias("v"))).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        step += 1
        edges_next = scratch.write(small.unionByName(floor.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        edges, after = edges_next, _state(edges_next)
        if after == before:
            break
        before = after
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
