"""Connected components by alternating large-star and small-star steps on a stored edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import release, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v): neighbours move to the least node that their common neighbour knows."""
    if large:
        sides = edges.unionByName(edges.selectExpr("v as u", "u as v"))
    else:
        sides = edges.selectExpr("greatest(u, v) as u", "least(u, v) as v")
    least = sides.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u as c", "least(u, m) as m")
    moved = sides.join(least, F.col("u") == F.col("c"))
    if large:
        moved = moved.where("v > u").selectExpr("v as u", "m as v")
    else:
        moved = moved.selectExpr("v as u", "m as v").unionByName(least.selectExpr("c as u", "m as v"))
    return moved.where("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node points at one smaller node that points at none."""
    bent = edges.where("v > u").select(F.lit(1)).limit(1)
    forked = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(1)).limit(1)
    long = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").select(F.lit(1)).limit(1)
    return bent.unionByName(forked).unionByName(long).isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of an edge table (u, v); a component is named by its least node.

    Both steps keep components and shorten paths; they end as stars, after rounds that grow with the logarithm of the
    longest path. Every round is stored, so a lost executor costs one round at most.
    """
    edges = stored(edges.where("u <> v").distinct(), name)
    while not _stars(edges):
        last, edges = edges, stored(_star(_star(edges, True), False), name)
        release(last)
    leaves = edges.selectExpr("u as node", "v as component")
    return leaves.unionByName(edges.selectExpr("v as node", "v as component")).distinct()
