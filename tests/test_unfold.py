"""Blocks that meet are unfolded an item at a time, so that no step holds the pairs of two blocks."""

from pyspark.sql import functions as F

from terrapix.operators import places
from terrapix.operators import spatial as sp
from terrapix.plans.catalog import QUERIES

N = 300


def made(df):
    """Rows that the explodes in the plan of df have given so far."""
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        elif kind == "ReusedExchangeExec":
            todo.append(p.child())
        elif kind == "GenerateExec":
            found += p.metrics().apply("numOutputRows").value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_first_pairs_come_before_the_others(spark):
    """All N * N pairs are of one place; ten of them take a few items, not the pairs of the whole block."""
    points = spark.range(N).selectExpr("id as point_id", "0.5D as x", "0.5D as y")
    pairs = sp.buffer_join(points, points, "point_id", "point_id", 1.0)
    some = pairs.limit(10)
    assert len(some.collect()) == 10 and made(some) < 5 * N
    assert pairs.distinct().count() == N * N


def test_unfolded_blocks_are_whole(spark):
    df = spark.range(500).selectExpr("id", "id % 3 as k")
    met = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "k long, j long")
    left, right = places.blocks(df, ["k"], F.col("id"), 50), places.blocks(df.withColumnRenamed("k", "j"), ["j"], F.col("id"), 20)
    rows = places.unfold(met, left, right, ["k"], ["j"]).collect()
    want = {(k, j, a, b) for k, j in ((0, 1), (1, 1), (2, 0)) for a in range(k, 500, 3) for b in range(j, 500, 3)}
    assert {(r.k, r.j, r.l, r.r) for r in rows} == want and len(rows) == len(want)


def test_first_pairs_of_the_query(spark, tmp_path):
    """Keys that are multiples of 100 all have one place."""
    spark.range(N).selectExpr("id * 100 as c_custkey", "1.0D as c_acctbal", "'a' as c_mktsegment", "1 as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    pairs = QUERIES["buffer_join_all"](spark, str(tmp_path))
    some = pairs.limit(10)
    assert len(some.collect()) == 10 and made(some) < 5 * N
    assert pairs.distinct().count() == N * N
