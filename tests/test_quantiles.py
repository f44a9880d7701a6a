"""Quantiles of groups by rounds against sorted lists."""

import random

import numpy as np
import pytest

from terrapix.operators.quantiles import group_quantiles, order_statistics, table_quantiles

SHARES = [0.0, 0.25, 0.5, 0.9, 1.0]


def groups(seed):
    rng = random.Random(seed)
    made = {
        "even": [rng.random() for _ in range(200)], "one": [4.0], "two": [1.0, 3.0], "same": [7.0] * 50, "heavy": [10.0 ** rng.uniform(-12, 12) for _ in range(150)],
        "ties": [float(rng.randrange(5)) for _ in range(99)], "signs": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-3, 300) for _ in range(60)], "far": [0.0] * 30 + [1e-300, 1e300, -1e308, 1.7e308], None: [2.0, 5.0, 5.0],
    }
    return made


@pytest.mark.parametrize("buckets", [2, 64])
def test_quantiles_of_groups(spark, buckets):
    made = groups(buckets)
    rows = [(g, v) for g, vs in made.items() for v in vs] + [("even", None), ("none", None), ("even", float("nan"))]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    keep = {g: vs for g, vs in made.items() if buckets > 2 or g in ("even", "one", "two", "same", "ties", None)}
    got = {r.g: r.q for r in group_quantiles(df if buckets > 2 else df.where("g is null or g in ('even', 'one', 'two', 'same', 'ties', 'none')"), ["g"], "v", SHARES, buckets).collect()}
    assert set(got) == set(keep)
    for g, vs in keep.items():
        s = np.sort(vs)
        for p, have in zip(SHARES, got[g], strict=True):
            at = p * (len(s) - 1)
            k = int(at)
            assert have == pytest.approx(s[k] + (at - k) * (s[min(k + 1, len(s) - 1)] - s[k]), rel=1e-12)


def test_places(spark):
    rows = [(k % 3, float((k * 37) % 101)) for k in range(100)]
    df = spark.createDataFrame(rows, "g int, v double")
    ranks = spark.createDataFrame([(g, k) for g in range(3) for k in range(33)], "g int, k long")
    got = {(r.g, r.k): r.v for r in order_statistics(df, ["g"], "v", ranks, 8).collect()}
    assert got == {(g, k): sorted(v for h, v in rows if h == g)[k] for g in range(3) for k in range(33)}


def test_of_a_whole_table_and_of_none(spark):
    df = spark.createDataFrame([(float(k),) for k in range(11)], "v double")
    assert group_quantiles(df, [], "v", [0.5, 0.95]).collect()[0].q == [5.0, 9.5]
    assert group_quantiles(df.limit(0), [], "v", [0.5, 0.95]).collect()[0].q == [None, None]
    assert group_quantiles(df.limit(0).selectExpr("v", "1 as g"), ["g"], "v", [0.5]).collect() == []


@pytest.mark.parametrize("buckets", [2, 1024])
def test_of_a_table_without_writing(spark, buckets):
    for name, vs in groups(3).items():
        if buckets > 2 or name in ("even", "one", "two", "same", "ties"):
            df = spark.createDataFrame([(v,) for v in [*vs, None, float("nan")]], "v double")
            assert table_quantiles(df, "v", SHARES, buckets).first().q == pytest.approx(np.quantile(vs, SHARES).tolist(), rel=1e-9)
    assert table_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).first().q == [None]
