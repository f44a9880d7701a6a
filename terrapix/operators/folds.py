"""Splits and folds that depend on ids and a seed alone, not on the order or number of partitions.

Ids are put in the order of a seeded digest. Within a class that order is cut by counts: positions come from the digest's
leading digits first (counts of 4096 prefixes for each class) and from a window within one prefix then, so no window holds
a whole class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest(unique: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), unique.cast("string")))


def positions(df: DataFrame, by: list[str], unique: str, seed: int = 42) -> DataFrame:
    """Adds pos (0, 1, ... within `by`, in digest order) and n (rows within `by`)."""
    keyed = df.withColumn("dg", digest(F.col(unique), seed)).withColumn("px", F.substring("dg", 1, 3))
    counts = keyed.groupBy(*by, "px").agg(F.count("*").alias("k"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    starts = counts.withColumns({"before": F.sum("k").over(w.orderBy("px").rowsBetween(Window.unboundedPreceding, -1)), "n": F.sum("k").over(w)})
    starts = starts.select(*by, "px", F.coalesce("before", F.lit(0)).alias("before"), "n")
    own = Window.partitionBy(*by, "px").orderBy("dg", unique)
    out = keyed.withColumn("rn", F.row_number().over(own)).join(starts, [*by, "px"])
    return out.withColumn("pos", F.col("before") + F.col("rn") - 1).drop("dg", "px", "rn", "before")


def stratified_split(df: DataFrame, cls: str, unique: str, test_share: float, seed: int = 42) -> DataFrame:
    """Adds part: 'test' for the first floor(share * n) of each class, else 'train'."""
    p = positions(df, [cls], unique, seed)
    return p.withColumn("part", F.when(F.col("pos") < F.floor(F.col("n") * test_share), "test").otherwise("train")).drop("pos", "n")


def kfold(df: DataFrame, unique: str, k: int, by: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Adds fold: round robin over all rows, or over each class."""
    return positions(df, by or [], unique, seed).withColumn("fold", (F.col("pos") % k).cast("int")).drop("pos", "n")


def balanced_group_folds(df: DataFrame, group: str, cls: str, k: int, seed: int = 42) -> DataFrame:
    """(group, fold): whole groups dealt to k folds of nearly equal rows, class by class of their majority.

    Within a class groups come by size, largest first, equal sizes by digest, and are dealt to and fro (0 ... k-1, k-1
    ... 0), so each fold gets as many large groups as small ones; each class begins at a fold that its digest picks. A
    group's place follows from counts: groups of larger sizes, by a window over the class's distinct sizes (whose number
    follows the square root of its rows), then its place among groups of its own size. A group without a class is one
    of a null class. Groups larger than a fold make folds uneven.
    """
    from .windows import majority

    sizes = df.groupBy(group).agg(F.count("*").alias("rows"))
    named = sizes.join(majority(df.where(F.col(cls).isNotNull()), [group], cls).drop("n"), group, "left")
    kinds = named.groupBy(cls, "rows").agg(F.count("*").alias("n_same"))
    before = F.sum("n_same").over(Window.partitionBy(cls).orderBy(F.desc("rows")).rowsBetween(Window.unboundedPreceding, -1))
    kinds = kinds.select(F.col(cls).alias("_c"), F.col("rows").alias("_r"), F.coalesce(before, F.lit(0)).alias("ahead"))
    placed = positions(named.withColumn("_key", F.coalesce(F.col(cls).cast("string"), F.lit(""))), ["_key", "rows"], group, seed)
    placed = placed.join(kinds, F.col(cls).eqNullSafe(F.col("_c")) & (F.col("rows") == F.col("_r")))
    at = F.col("ahead") + F.col("pos")
    lap, step = F.floor(at / k), at % k
    start = F.conv(F.substring(digest(F.col("_key"), seed), 1, 6), 16, 10).cast("long")
    return placed.select(group, ((F.when(lap % 2 == 0, step).otherwise(k - 1 - step) + start) % k).cast("int").alias("fold"))
