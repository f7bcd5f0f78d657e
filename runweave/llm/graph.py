"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _least(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with ``m``, the least of u and its neighbours. A sum-like aggregate and a join, no group is gathered."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(cut(least, "least"), "u")


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b); root is the least node reachable.

    Self-loops and repeated edges do no harm; nulls are left out; no edges give an empty table.
    """
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = cut(now, "edges")
    sign = _sign(now)
    while sign[0]:
        both = cut(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        large = _least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where(F.col("u") != F.col("v")).distinct(), "large")
        small = _least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = cut(small.where(F.col("u") != F.col("v")).distinct(), "small")
        before, sign = sign, _sign(now)
        if sign == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
