"""Joins by shared places: geometry is looked at once for each distinct place or shape, then the rows that share one meet in blocks.

Rows of a place are put into arrays of some 1024 items, and pairs of such blocks are dealt evenly over the tasks that
unfold them. So a place with many rows is spread over many tasks, and what is shuffled follows the input and the number of
blocks that meet, not the number of pairs of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blocks(df: DataFrame, keys: list[str], item: Column, most: int = 1024) -> DataFrame:
    """(keys, items): items of rows with equal keys as arrays of some `most`; rows with a null key are left out.

    A key's items are dealt to its blocks by their hash, so only rows whose items are equal as well stay together.
    """
    some = df.dropna(subset=keys).select(*keys, item.alias("item"))
    crowded = some.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).alias("parts"))
    part = F.pmod(F.xxhash64("item"), F.coalesce("parts", F.lit(1)))
    return some.join(crowded, keys, "left").groupBy(*keys, part.alias("part")).agg(F.collect_list("item").alias("items")).drop("part")


def unfold(pairs: DataFrame, left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str]) -> DataFrame:
    """(pairs, l, r): every item l of the left blocks with every item r of the right ones whose keys a row of pairs holds."""
    met = pairs.join(left.withColumnRenamed("items", "ls"), left_keys).join(right.withColumnRenamed("items", "rs"), right_keys)
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.repartition(parts)  # evenly: a few blocks make many rows
    # As many partitions as before, so nothing moves; but two explodes in one step would hold all rows of two blocks at once.
    lone = dealt.withColumn("l", F.explode("ls")).drop("ls").coalesce(parts)
    return lone.withColumn("r", F.explode("rs")).drop("rs")


def with_shape(polygons: DataFrame) -> DataFrame:
    """Adds shape, a digest of the ring, which is the same for equal rings alone."""
    return polygons.withColumn("shape", F.md5(F.to_json("ring")))


def shapes(polygons: DataFrame) -> DataFrame:
    """(shape, ring): the distinct rings."""
    return with_shape(polygons.select("ring")).dropDuplicates(["shape"])


def id_pairs(near: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_keys: list[str], right_keys: list[str]) -> DataFrame:
    """Distinct (left_id, right_id) of rows whose keys a row of near holds.

    left: left_id and left_keys; right alike. Ids are put together by the set of keys that they have, so sets are made
    distinct and pairs of ids needn't be.
    """
    a = left.groupBy(left_id).agg(F.sort_array(F.collect_set(F.struct(*left_keys))).alias("lset"))
    b = right.groupBy(right_id).agg(F.sort_array(F.collect_set(F.struct(*right_keys))).alias("rset"))
    lsets = a.select("lset").distinct().select("lset", F.explode("lset").alias("k")).select("lset", "k.*")
    rsets = b.select("rset").distinct().select("rset", F.explode("rset").alias("k")).select("rset", "k.*")
    met = near.join(lsets, left_keys).join(rsets, right_keys).select("lset", "rset").distinct()
    out = unfold(met, blocks(a, ["lset"], F.col(left_id)), blocks(b, ["rset"], F.col(right_id)), ["lset"], ["rset"])
    return out.select(F.col("l").alias(left_id), F.col("r").alias(right_id))
