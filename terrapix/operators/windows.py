"""Duplicates, majorities, ranks, running sums and dark-object thresholds.

Windows are partitioned by a key or run over aggregated values only, never over all pixels at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import release, stored
from .folds import digest as seeded_digest

def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds n (rows with these keys) and is_dup.

    Counts are formed before they are shuffled. Rows then meet their key's count in a join, which Spark broadcasts where
    the counts are small enough; else all rows of a key meet in one task.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return df.join(counts, list(keys)).withColumn("is_dup", F.col("n") > 1)


def majority(df: DataFrame, keys: Sequence[str], cls: str, ties_lose: bool = False) -> DataFrame:
    """The commonest class of each key, the least of equals, with its count n.

    ties_lose: a key whose classes all come once, more than one of them, gets none and is left out.
    """
    counts = df.groupBy(*keys, cls).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.max("n").alias("n"), F.count("*").alias("kinds"), F.min(F.struct((-F.col("n")).alias("neg"), cls)).alias("top"))
    out = best.select(*keys, F.col(f"top.{cls}").alias(cls), "n", "kinds")
    return (out.where(~((F.col("n") == 1) & (F.col("kinds") > 1))) if ties_lose else out).drop("kinds")


def dedupe_majority(df: DataFrame, key: str, cls: str, cover: str, unique: str) -> DataFrame:
    """One row for each key: of the commonest class, then of the highest cover, then of the least id.

    As classes that all come once tie, the row of the highest cover stays there. Each key and class first keeps its best
    row and its count, then each key its best class: two aggregations with partial results, and the table is read once.
    """
    row = F.struct(*df.columns)
    best = df.groupBy(key, cls).agg(F.count("*").alias("n"), F.max_by(row, F.struct(F.col(cover).alias("c"), (-F.col(unique)).alias("u"))).alias("row"))
    order = F.struct("n", F.col(f"row.{cover}").alias("c"), (-F.col(f"row.{unique}")).alias("u"))
    return best.groupBy(key).agg(F.max_by("row", order).alias("row")).select("row.*")


def first_rows(df: DataFrame, keys: Sequence[str], unique: str) -> DataFrame:
    """One row for each key, that of the least id."""
    best = df.groupBy(*keys).agg(F.min(unique).alias(unique))
    return df.join(best, [*keys, unique], "left_semi")


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """Sorted distinct labels numbered from 1."""
    labels = df.select(label).where(F.col(label).isNotNull()).distinct().withColumn("one", F.lit(1))
    return running_total(labels, label, "one", "code").select(label, F.col("code").cast("int").alias("code"))


def sample_per_class(df: DataFrame, cls: str, unique: Column, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each class, in the order of a seeded digest of their id.

    A first cut by the digest's leading part keeps the window small where a class is large: counts of 4096 prefixes for
    each class tell which prefixes hold the n least rows, and rows of others go before anything is sorted.
    """
    keyed = df.withColumn("dg", seeded_digest(unique, seed)).withColumn("pre", F.substring("dg", 1, 3))
    counts = keyed.groupBy(cls, "pre").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.partitionBy(cls).orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)) - F.col("k")
    low = counts.withColumn("before", before).where(F.col("before") < n).select(F.col(cls).alias("c2"), F.col("pre").alias("p2"))
    some = keyed.join(low, F.col(cls).eqNullSafe(F.col("c2")) & (F.col("pre") == F.col("p2")), "left_semi")
    return some.withColumn("rn", F.row_number().over(Window.partitionBy(cls).orderBy("dg"))).where(F.col("rn") <= n).drop("rn", "dg", "pre")


#: Rows that one window may hold; a larger table is cut into ranges.
WINDOW_ROWS = 1 << 16


def running_total(df: DataFrame, order: str, value: str, out: str, most: int = WINDOW_ROWS) -> DataFrame:
    """Adds the sum of value over all rows up to each, in the order of a column without equals.

    The table is stored and counted. Up to `most` rows one window does. More are cut into ranges and stored with their
    range's number, so that both uses below see the same cut; sums of earlier ranges come from a table of one row for
    each range, so no window runs over all rows.
    """
    kept = stored(df, "totals")
    upto = lambda *by: F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    if kept.count() <= most:
        return kept.withColumn(out, upto())
    ranged = stored(kept.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "ranges")
    release(kept)
    sizes = ranged.groupBy("part").agg(F.sum(value).alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"))
    return ranged.withColumn("own", upto("part")).join(F.broadcast(before), "part").withColumn(out, F.col("before") + F.col("own")).drop("part", "own", "before")


def average_ranks(df: DataFrame, value: str, cls: str) -> DataFrame:
    """Distinct values with counts per class and their average rank, ties shared.

    Counts of distinct values are stored and summed up range by range, so no window runs over very many values.
    """
    counts = stored(df.groupBy(value, cls).agg(F.count("*").alias("c")), "counts")
    totals = counts.groupBy(value).agg(F.sum("c").alias("t"))
    ranks = running_total(totals, value, "t", "cum").select(value, "t", (F.col("cum") - (F.col("t") - 1) / 2).alias("rank"))
    return counts.join(ranks, value)


def dark_threshold(df: DataFrame, band: str, factor: int = 3) -> DataFrame:
    """Dark-object threshold: the first bin past 0 with `factor` times the count of the second non-empty bin."""
    bins = df.where(F.col(band) > 0).groupBy(F.floor(band).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    second = bins.withColumn("k", F.row_number().over(Window.orderBy("bin"))).where("k = 2").select(F.col("n").alias("f"))
    return bins.join(F.broadcast(second)).where((F.col("bin") > 0) & (F.col("n") >= factor * F.col("f"))).agg(F.min("bin").alias("threshold"))


def dark_thresholds(df: DataFrame, band: str, value: str, bands: Sequence[str], factor: float = 3) -> DataFrame:
    """One row, dark_b for each band: dark_threshold of every band of a long table, from one histogram of all.

    The histogram has a row for each band and bin, whatever the raster's size; its windows hold one band's bins.
    """
    bins = df.where(F.col(value) > 0).groupBy(band, F.floor(value).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    placed = bins.withColumn("k", F.row_number().over(Window.partitionBy(band).orderBy("bin")))
    second = placed.withColumn("f", F.max(F.when(F.col("k") == 2, F.col("n"))).over(Window.partitionBy(band)))
    hit = lambda b: F.min(F.when((F.col(band) == b) & (F.col("bin") > 0) & (F.col("n") >= factor * F.col("f")), F.col("bin")))
    return second.agg(*(hit(b).alias(f"dark_{b}") for b in bands))


def running_sum(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Over a small ordered table, as explained variances."""
    return df.withColumn(out, F.sum(value).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def elbow(df: DataFrame, order: str, cumulative: str, gain: float = 1.0) -> DataFrame:
    """First position whose gain over the one before is under `gain`."""
    diff = df.withColumn("gain", F.col(cumulative) - F.lag(cumulative).over(Window.orderBy(order)))
    return diff.where(F.col("gain") < gain).agg(F.min(order).alias("components"))
