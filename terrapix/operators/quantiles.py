"""Exact quantiles of groups by rounds of bucket counts.

Each round cuts the interval that still holds a rank into equal buckets, counts every group's values in them in one
aggregation, and narrows to the smallest and largest value of the bucket that the rank falls into; all groups and ranks go
at once. A rank is found when its bucket holds one value. Counts have partial sums, so a hot group costs a row for each
bucket and task; no buffer, window or task holds a group's values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import release, stored


def order_statistics(df: DataFrame, by: list[str], value: str, ranks: DataFrame, buckets: int = 1024) -> DataFrame:
    """(by, k, v): the value at each place k (from 0) of its group's sorted values.

    df: values that are neither null nor NaN; ranks: (by, k) with places below the group's count. The first interval of
    a group is that of all its values. A round leaves at most 1 / buckets of the interval's width, so a few rounds do for
    any usual values; their number is bounded by the digits of the largest interval over those of the smallest gap.
    Keys may be null. Each round is stored, and reads df again, which should therefore be stored or narrow.
    """
    keys = _keys(by)
    values = df.select(*_named(by), F.col(value).cast("double").alias("v"))
    whole = values.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = ranks.select(*_named(by), "k")
    state = wanted.alias("r").join(whole.alias("w"), _same(keys, "r", "w")).select(*(F.col(f"r.{k}") for k in keys), "k", F.col("k").alias("left"), "lo", "hi")
    return _renamed(_narrow(values, keys, stored(state, "ranks"), buckets), by)


def _keys(by: list[str]) -> list[str]:
    return [f"_k{n}" for n in range(len(by))]


def _named(by: list[str]) -> list[Column]:
    return [F.col(b).alias(k) for b, k in zip(by, _keys(by), strict=True)]


def _renamed(df: DataFrame, by: list[str]) -> DataFrame:
    return df.withColumnsRenamed(dict(zip(_keys(by), by, strict=True)))


def _same(keys: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys), F.lit(True))


def _narrow(values: DataFrame, keys: list[str], state: DataFrame, buckets: int) -> DataFrame:
    """(keys, k, v) of a stored table of ranks (keys, k, left, lo, hi): left is the rank among the values from lo to hi."""
    found = []
    while True:
        found.append(state.where("lo = hi").select(*keys, "k", F.col("lo").alias("v")))
        rest = state.where("lo < hi")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, found)
        spans = rest.select(*keys, "lo", "hi").distinct()
        within = values.alias("x").join(spans.alias("s"), _same(keys, "x", "s") & F.col("v").between(F.col("lo"), F.col("hi")))
        # Half the difference twice, as the difference of large numbers of both signs passes what a double holds.
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bucket = F.least(F.floor(share * buckets).cast("int"), F.lit(buckets - 1))
        counts = within.select(*(F.col(f"s.{k}") for k in keys), "lo", "hi", "v", bucket.alias("bucket")).groupBy(*keys, "lo", "hi", "bucket").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        counts = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys, "lo", "hi").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
        hit = _same(keys, "r", "c") & (F.col("r.lo") == F.col("c.lo")) & (F.col("r.hi") == F.col("c.hi")) & (F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n"))
        state = rest.alias("r").join(counts.alias("c"), hit).select(*(F.col(f"r.{k}") for k in keys), "k", (F.col("left") - (F.col("upto") - F.col("n"))).alias("left"), F.col("least").alias("lo"), F.col("most").alias("hi"))
        state = stored(state, "ranks")


def group_quantiles(df: DataFrame, by: list[str], value: str, shares: Sequence[float], buckets: int = 1024, keep: bool = True) -> DataFrame:
    """(by, q): an array of exact quantiles of each group, linear between neighbours.

    Nulls and NaN don't count; a group without values has none and is left out. Without `by`, one row, whose quantiles
    are null where there are no values. keep: store the values first; not needed where df is a stored table.
    """
    keys = _keys(by)
    values = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*_named(by), F.col(value).cast("double").alias("v"))
    values = stored(values, "values") if keep else values
    whole = values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 0")
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("n") - 1)).alias("at")) for i, p in enumerate(shares)))
    places = stored(whole.select(*keys, "lo", "hi", F.explode(wanted).alias("w")).select(*keys, "lo", "hi", "w.*"), "places")  # a row for each group and share
    ends = F.explode(F.array(F.floor("at"), F.ceil("at")))
    ranks = places.select(*keys, ends.alias("k"), "lo", "hi").distinct()
    exact = _narrow(values, keys, ranks.select(*keys, "k", F.col("k").alias("left"), "lo", "hi"), buckets)
    near = places.alias("p").join(exact.alias("e"), _same(keys, "p", "e") & F.col("e.k").isin(F.floor("p.at"), F.ceil("p.at")))
    part = near.groupBy(*(F.col(f"p.{k}").alias(k) for k in keys), "i", "at").agg(F.min("e.v").alias("a"), F.max("e.v").alias("b"))
    cut = F.col("a") + (F.col("at") - F.floor("at")) * (F.col("b") - F.col("a"))
    out = part.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", cut.alias("v")))).alias("q")).select(*keys, F.transform("q", lambda s: s["v"]).alias("q"))
    out = stored(_renamed(out, by), "quantiles")  # a row for each group
    release(places, *([values] if keep else []))
    if by:
        return out
    empty = F.array(*(F.lit(None).cast("double") for _ in shares))
    one = df.sparkSession.range(1)
    return one.join(out.where(F.size("q") > 0), F.lit(True), "left").select(F.coalesce("q", empty).alias("q"))


def table_quantiles(df: DataFrame, value: str, shares: Sequence[float], buckets: int = 1024) -> DataFrame:
    """One row, q: exact quantiles of a whole table by the same rounds; null where it has no values.

    A round is one aggregation, whose counts (a row for each bucket and open interval, two intervals for each share at
    most) come to the driver, so nothing is written. df is read in each round, and when this is called.
    """
    v = F.col(value).cast("double")
    values = df.where(v.isNotNull() & ~F.isnan(v)).select(v.alias("v"))
    n, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    places = [p * (n - 1) for p in shares]
    ranks = {k: (k, low, high) for at in places for k in (floor(at), ceil(at))} if n else {}
    while spans := sorted({(lo, hi) for _, lo, hi in ranks.values() if lo < hi}):
        span = F.coalesce(*(F.when(F.col("v").between(lo, hi), F.lit(k)) for k, (lo, hi) in enumerate(spans)))
        share = F.coalesce(*(F.when(F.col("v").between(lo, hi), (F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2)) for lo, hi in spans))
        some = values.select("v", span.alias("span"), F.least(F.floor(share * buckets).cast("int"), F.lit(buckets - 1)).alias("bucket")).where("span is not null")
        counts = sorted(tuple(r) for r in some.groupBy("span", "bucket").agg(F.count("*"), F.min("v"), F.max("v")).collect())
        upto = dict.fromkeys(spans, 0)
        found = []
        for k, _, c, lo, hi in counts:
            found.append((spans[k], upto[spans[k]], c, lo, hi))
            upto[spans[k]] += c
        for k, (left, lo, hi) in ranks.items():
            for own, before, c, least, most in found if lo < hi else ():
                if own == (lo, hi) and before <= left < before + c:
                    ranks[k] = left - before, least, most
                    break
    at = lambda k: ranks[k][1]
    q = [at(floor(p)) + (p - floor(p)) * (at(ceil(p)) - at(floor(p))) for p in places] if n else [None] * len(places)
    return df.sparkSession.range(1).select(F.array(*(F.lit(x).cast("double") for x in q)).alias("q"))
