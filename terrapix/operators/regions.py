"""Region merging: pixels grow into regions along their lightest edges, round by round.

Every pixel begins as a region; an edge joins two 4-neighbours and weighs the distance of their bands. A region knows its
size and its largest inner edge. An edge may be crossed where it weighs no more than either region's largest inner edge
plus scale / size. In a round every region picks the lightest edge that it may cross, regions that picks connect become one,
and edges between the new regions keep their least weight. Rounds end when no edge may be crossed; at least half of the
regions that can grow go in each, so their number follows the logarithm of the number of pixels. Every round is stored, and
regions, edges and names shrink from round to round.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import release, stored


def smooth(df: DataFrame, bands: list[str], sigma: float, truncate: float = 4.0) -> DataFrame:
    """(row, col, bands) smoothed by a Gauss kernel, one axis after the other, as sums of shifted pixels.

    The kernel ends at truncate * sigma. Null bands and cells outside the raster have no weight; a null band stays null.
    Sums are rounded to 9 digits, so that the order in which they are added up doesn't show.
    """
    radius = int(truncate * sigma + 0.5)
    if radius == 0:
        return df.select("row", "col", *bands)
    kernel = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(math.exp(-k * k / (2 * sigma * sigma))).alias("w")) for k in range(-radius, radius + 1)))
    out = df.select("row", "col", *bands)
    for axis in ("row", "col"):
        moved = out.withColumn("s", F.explode(kernel)).withColumn(axis, F.col(axis) + F.col("s.k"))
        weight = F.col("s.w")
        sums = [F.when(F.max(F.when(F.col("s.k") == 0, F.col(b))).isNotNull(), F.round(F.sum(F.col(b) * weight) / F.sum(F.when(F.col(b).isNotNull(), weight)), 9)).alias(b) for b in bands]
        out = moved.groupBy("row", "col").agg(F.bool_or(F.col("s.k") == 0).alias("own"), *sums).where("own").drop("own")
    return out


def pixel_edges(df: DataFrame, bands: list[str], within: str | None = None) -> DataFrame:
    """(a, b, w): edges between 4-neighbours with complete bands, a the pixel above or left; w has 9 digits.

    A pixel's number is (row << 32) + col + 1. within: a column whose change is a border, such as a tile.
    """
    keep = [*bands, *([within] if within else [])]
    pixels = df.dropna(subset=bands).select("row", "col", *keep, pixel_id().alias("a"))
    distance = F.sqrt(reduce(lambda x, y: x + y, ((F.col(b) - F.col(f"_{b}")) ** 2 for b in bands)))
    other = [F.col(k).alias(f"_{k}") for k in keep] + [F.col("a").alias("b")]
    sides = []
    for dr, dc in ((1, 0), (0, 1)):
        moved = pixels.select((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), *other)
        sides.append(pixels.join(moved, ["row", "col"]))
    both = sides[0].unionByName(sides[1])
    if within:
        both = both.where(F.col(within).eqNullSafe(F.col(f"_{within}")))
    return both.select("a", "b", F.round(distance, 9).alias("w"))


def pixel_id() -> Column:
    return F.shiftleft(F.col("row").cast("long"), 32) + F.col("col") + 1


def roots(picks: DataFrame) -> DataFrame:
    """(u, root, w) of a stored table of picks (u, v, w) that form trees: each u points at one v; pointers double until they end at roots."""
    at = picks.select("u", F.col("v").alias("root"), "w")
    while True:
        ahead = at.select(F.col("u").alias("root"), F.col("root").alias("beyond"))
        if at.join(ahead, "root", "left_semi").isEmpty():
            return at
        at = stored(at.join(ahead, "root", "left").select("u", F.coalesce("beyond", "root").alias("root"), "w"), "pointers")


def contract(nodes: DataFrame, edges: DataFrame, allowed: Column, picker: Column) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """One round: new nodes (region, size, inner), new edges (a, b, w) and names (region, into); None where no edge is allowed.

    allowed: which edges may be crossed, from size and inner of both ends (sa, ia, sb, ib). picker: which of an edge's
    ends may pick it, from that end's size (size).
    """
    a = nodes.select(F.col("region").alias("a"), F.col("size").alias("sa"), F.col("inner").alias("ia"))
    b = nodes.select(F.col("region").alias("b"), F.col("size").alias("sb"), F.col("inner").alias("ib"))
    open_ = edges.join(a, "a").join(b, "b").where(allowed)
    ends = F.array(F.struct(F.col("a").alias("region"), F.col("sa").alias("size")), F.struct(F.col("b").alias("region"), F.col("sb").alias("size")))
    each = open_.select("a", "b", "w", F.explode(ends).alias("e")).select("a", "b", "w", "e.*").where(picker)
    picked = each.groupBy("region").agg(F.min(F.struct("w", "a", "b")).alias("p")).select("region", "p.*")
    # An edge that both its ends picked is taken once, from the larger number to the smaller, which thereby is a root.
    by = picked.groupBy("a", "b", "w").agg(F.max(F.col("region") == F.col("b")).alias("by_b"))
    picks = stored(by.selectExpr("if(by_b, b, a) as u", "if(by_b, a, b) as v", "w"), "picks")
    if picks.isEmpty():
        release(picks)
        return None
    # Regions that meet at a root are one, named by their least number.
    found = roots(picks).select(F.col("u").alias("region"), "root", "w")
    joined = stored(nodes.join(found, "region", "left").withColumn("root", F.coalesce("root", "region")), "meeting")
    merged = joined.groupBy("root").agg(F.min("region").alias("into"), F.sum("size").alias("size"), F.greatest(F.max("inner"), F.max("w")).alias("inner"))
    names = joined.select("region", "root").join(merged.select("root", "into"), "root").select("region", "into")
    left, right = names.select(F.col("region").alias("a"), F.col("into").alias("x")), names.select(F.col("region").alias("b"), F.col("into").alias("y"))
    between = edges.join(left, "a").join(right, "b").where("x <> y")
    lighter = stored(between.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("w").alias("w")), "edges")
    release(picks, edges)
    return merged.select(F.col("into").alias("region"), "size", "inner"), lighter, names


def merge_regions(df: DataFrame, bands: list[str], scale: float, sigma: float = 0.0, min_size: int = 1, within: str | None = None) -> DataFrame:
    """(row, col, segment_id): regions of pixels, named by their first pixel; 0 for pixels with a null band.

    scale: how much more than its largest inner edge a region of one pixel may cross; larger regions may cross less. Its
    unit is that of the bands' distance. sigma smooths the bands first. Regions of fewer than min_size pixels then cross
    their lightest edge, round by round, until none of them has an edge. within: a column whose change no region crosses.
    Equal edges are told apart by their pixels' numbers, so the result doesn't depend on partitions. An empty raster
    gives no rows.
    """
    flat = smooth(df, bands, sigma)
    if within:
        flat = flat.join(df.select("row", "col", within), ["row", "col"])
    flat = stored(flat, "smooth")
    pixels = flat.dropna(subset=bands).select("row", "col", pixel_id().alias("region"))
    nodes = stored(pixels.select("region", F.lit(1).cast("long").alias("size"), F.lit(0.0).alias("inner")), "nodes")
    edges = stored(pixel_edges(flat, bands, within), "edges")
    limit = F.least(F.col("ia") + scale / F.col("sa"), F.col("ib") + scale / F.col("sb"))
    rules = [(F.col("w") <= limit, F.lit(True))]
    if min_size > 1:
        rules.append(((F.col("sa") < min_size) | (F.col("sb") < min_size), F.col("size") < min_size))
    rounds = []
    for allowed, picker in rules:
        while step := contract(nodes, edges, allowed, picker):
            nodes, edges, names = step
            rounds.append(names)
    # Names are put together from the last round, which is the smallest, to the first.
    named = rounds.pop() if rounds else None
    while rounds:
        earlier = rounds.pop()
        named = stored(earlier.select("region", F.col("into").alias("then")).join(named.withColumnRenamed("region", "then"), "then").select("region", "into"), "names")
    out = pixels if named is None else pixels.join(named, "region").select("row", "col", F.col("into").alias("region"))
    return df.select("row", "col").join(out, ["row", "col"], "left").select("row", "col", F.coalesce("region", F.lit(0)).alias("segment_id"))
