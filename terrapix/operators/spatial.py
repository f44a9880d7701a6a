"""Distance joins and spatially buffered folds, by grid cells of the buffer's size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .places import blocks, unfold


def near_places(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Rows of left (lx, ly) with rows of right (rx, ry) within `radius`. Each right row is listed under its own cell and the eight around."""
    key = lambda v: F.floor(v / radius).cast("long")
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    b = right.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).withColumns({"gx": key(F.col("rx")) + F.col("dx"), "gy": key(F.col("ry")) + F.col("dy")})
    a = left.withColumns({"gx": key(F.col("lx")), "gy": key(F.col("ly"))})
    close = (F.col("lx") - F.col("rx")) ** 2 + (F.col("ly") - F.col("ry")) ** 2 <= radius * radius
    return a.join(b, ["gx", "gy"]).where(close).drop("gx", "gy", "dx", "dy")


def buffer_join(left: DataFrame, right: DataFrame, lid: str, rid: str, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """Pairs (lid, rid) of points within `radius`.

    Distances are those of distinct places; the points at two places that are near each other meet in blocks.
    """
    r = right.select(F.col(rid).alias("rid"), F.col(x).alias("rx"), F.col(y).alias("ry"))
    p = left.select(F.col(lid).alias("lid"), F.col(x).alias("lx"), F.col(y).alias("ly"))
    pairs = near_places(p.select("lx", "ly").distinct(), r.select("rx", "ry").distinct(), radius)
    out = unfold(pairs, blocks(p, ["lx", "ly"], F.col("lid")), blocks(r, ["rx", "ry"], F.col("rid")), ["lx", "ly"], ["rx", "ry"])
    return out.select(F.col("l").alias("lid"), F.col("r").alias("rid"))


def few(df: DataFrame, key: str, most: int) -> DataFrame:
    """The distinct values of a key, of which there may be `most`."""
    values = df.select(key).distinct()
    if values.limit(most + 1).count() > most:
        raise ValueError(f"{key} has more than {most} values")
    return values


def leave_one_out(points: DataFrame, key: str, unique: str, most: int = 1000) -> DataFrame:
    """(unique, fold, role): each value of the key is a fold, which its rows test and all others train.

    The result has a row for each row and fold, so more than `most` folds are an error.
    """
    folds = few(points, key, most).withColumnRenamed(key, "fold")
    every = points.select(unique, key).join(F.broadcast(folds))
    return every.select(unique, "fold", F.when(F.col(key) == F.col("fold"), "test").otherwise("train").alias("role"))


def blocked_places(points: DataFrame, tests: DataFrame, fold: str, radius: float) -> DataFrame:
    """(x, y, fold): places of points within `radius` of a test point of that fold; points of a place are looked at once."""
    places = points.select(F.col("x").alias("lx"), F.col("y").alias("ly")).distinct()
    others = tests.select(F.col("x").alias("rx"), F.col("y").alias("ry"), fold).distinct()
    return near_places(places, others, radius).select(F.col("lx").alias("x"), F.col("ly").alias("y"), fold).distinct()


def buffered_folds(points: DataFrame, fold: str, unique: str, radius: float, most: int = 1000) -> DataFrame:
    """(unique, fold, role): a point tests its own fold and trains every fold none of whose test points is near it.

    The result has a row for each point and fold, so more than `most` folds are an error.
    """
    folds = few(points, fold, most)
    test = points.select(unique, fold, F.lit("test").alias("role"))
    every = points.select(unique, "x", "y").join(F.broadcast(folds))  # folds are few by construction: the caller sets their number
    train = every.join(blocked_places(points, points, fold, radius), ["x", "y", fold], "left_anti")
    return test.unionByName(train.select(unique, fold, F.lit("train").alias("role")))
