"""Segments: connected regions of alike pixels, their refinement, outlines and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .components import components


def segment_regions(df: DataFrame, bands: list[str], width: float, min_size: int = 1, within: str | None = None) -> DataFrame:
    """(row, col, segment_id): 4-connected regions of pixels whose bands fall into the same bins of `width`.

    A region is named by its first pixel, as (row << 32) + col + 1. A region of fewer than min_size pixels joins the
    neighbour it shares most edges with (once; the least of equals), 0 stays for pixels with a null band. within: a
    column whose change is a border too, such as a tile. Pixels of one row that follow each other are one node from the
    start, so edges are between runs; components come from star steps, not from walking the image.
    """
    valid = df.dropna(subset=bands)
    key = F.array(*(F.floor(F.col(b) / width).cast("long") for b in bands), *([F.col(within).cast("long")] if within else []))
    pixels = valid.select("row", "col", key.alias("k"))
    w = Window.partitionBy("row", F.floor(F.col("col") / 4096)).orderBy("col")  # a wide raster's rows are cut into stretches
    new = F.coalesce((F.lag("k").over(w) != F.col("k")) | (F.lag("col").over(w) != F.col("col") - 1), F.lit(True))
    node = F.shiftleft(F.col("row").cast("long"), 32) + F.col("col") + 1
    pixels = stored(pixels.withColumn("node", F.last(F.when(new, node), True).over(w)), "pixels")  # read five times
    below = pixels.select((F.col("row") - 1).alias("row"), "col", F.col("k").alias("k2"), F.col("node").alias("v"))
    right = pixels.select("row", (F.col("col") - 1).alias("col"), F.col("k").alias("k2"), F.col("node").alias("v"))
    touch = lambda other: pixels.join(other, ["row", "col"]).where("k = k2 and node <> v").select(F.col("node").alias("u"), "v")
    comp = components(touch(below).unionByName(touch(right.where("col % 4096 = 4095"))), "regions")
    labelled = pixels.join(comp.select("node", "component"), "node", "left").select("row", "col", F.coalesce("component", "node").alias("segment_id"))
    if min_size > 1:
        labelled = merge_small(labelled, min_size)
    return df.select("row", "col").join(labelled, ["row", "col"], "left").select("row", "col", F.coalesce("segment_id", F.lit(0)).alias("segment_id"))


def borders(seg: DataFrame) -> DataFrame:
    """(a, b, n): edges between different segments, both ways."""
    side = lambda dr, dc: seg.select((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.col("segment_id").alias("b"))
    pairs = seg.join(side(1, 0).unionByName(side(0, 1)), ["row", "col"]).where("segment_id <> b").select(F.col("segment_id").alias("a"), "b")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a", "b").agg(F.count("*").alias("n"))


def merge_small(seg: DataFrame, min_size: int) -> DataFrame:
    """Small segments take the id of the neighbour they share most edges with."""
    seg = stored(seg, "segments")  # read five times
    sizes = seg.groupBy("segment_id").agg(F.count("*").alias("size"))
    best = borders(seg).join(sizes.where(F.col("size") < min_size).select(F.col("segment_id").alias("a")), "a", "left_semi")
    best = best.join(sizes.where(F.col("size") >= min_size).select(F.col("segment_id").alias("b")), "b", "left_semi")
    best = best.groupBy(F.col("a").alias("segment_id")).agg(F.max_by("b", F.struct("n", (-F.col("b")).alias("least"))).alias("into"))
    return seg.join(best, "segment_id", "left").select("row", "col", F.coalesce("into", "segment_id").alias("segment_id"))


def refine_segments(df: DataFrame, seg: DataFrame, points: DataFrame, bands: list[str], width: float) -> DataFrame:
    """Segments that hold several points are cut anew at half the bin width; ids stay those of first pixels.

    points: (row, col) of each point.
    """
    seg = stored(seg, "segments")
    crowded = points.join(seg, ["row", "col"]).groupBy("segment_id").agg(F.count("*").alias("n")).where("n > 1 and segment_id <> 0")
    again = stored(df.join(seg, ["row", "col"]).join(crowded.select("segment_id"), "segment_id", "left_semi"), "crowded")
    finer = segment_regions(again, bands, width / 2, within="segment_id").withColumnRenamed("segment_id", "finer")
    return seg.join(finer, ["row", "col"], "left").select("row", "col", F.coalesce("finer", "segment_id").alias("segment_id"))


def outlines(seg: DataFrame) -> DataFrame:
    """Per segment: cells, bounds, centroid and the number of cell edges on its outline."""
    some = seg.where("segment_id <> 0")
    shape = some.groupBy("segment_id").agg(
        F.count("*").alias("cells"), F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col"),
        F.avg(F.col("row") + 0.5).alias("center_row"), F.avg(F.col("col") + 0.5).alias("center_col"),
    )
    side = lambda dr, dc: some.select((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), "segment_id")
    inner = some.join(side(1, 0).unionByName(side(0, 1)), ["row", "col", "segment_id"]).groupBy("segment_id").agg(F.count("*").alias("inner"))
    return shape.join(inner, "segment_id", "left").withColumn("outline", 4 * F.col("cells") - 2 * F.coalesce("inner", F.lit(0))).drop("inner")


def edges(seg: DataFrame) -> DataFrame:
    """(segment_id, row, col, side): the cell edges on every segment's outline, where the next cell is of another or none."""
    some = seg.where("segment_id <> 0")
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for s, dr, dc in (("top", -1, 0), ("bottom", 1, 0), ("left", 0, -1), ("right", 0, 1))))
    each = some.select("segment_id", "row", "col", F.explode(sides).alias("x")).select("segment_id", "row", "col", "x.side", (F.col("row") + F.col("x.dr")).alias("r2"), (F.col("col") + F.col("x.dc")).alias("c2"))
    next_to = some.select(F.col("row").alias("r2"), F.col("col").alias("c2"), "segment_id")
    return each.join(next_to, ["r2", "c2", "segment_id"], "left_anti").select("segment_id", "row", "col", "side")
