"""Whole jobs on rasters whose segments, classes and areas are known beforehand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapix.functions import bands as fn
from terrapix.operators import chains

BANDS = ["b1", "b2", "b3"]
LEVELS = {(0, 0): (0.2, 0.3, 0.1), (0, 1): (0.6, 0.3, 0.1), (1, 0): (0.2, 0.8, 0.5), (1, 1): (0.7, 0.9, 0.2)}
N = 8


def raster(seed=1):
    """Four blocks of 8 x 8 cells with their own levels and a little noise; some missing cells, in all three ways."""
    rng = random.Random(seed)
    rows = []
    for r in range(2 * N):
        for c in range(2 * N):
            v = [round(x + rng.uniform(-0.004, 0.004), 6) for x in LEVELS[r // N, c // N]]
            rows.append([r, c, *v])
    rows[3][2] = None
    rows[20][3] = 0.0
    rows[40][4] = float("nan")
    return rows


#: id, x, y, class, cover: two classes meet in block (0, 0); block (0, 1) has a tie; block (1, 1) has no point.
POINTS = [(1, 1.5, 1.5, "sand", 1.0), (2, 2.5, 3.5, "sand", 5.0), (3, 5.5, 6.5, "mud", 9.0), (4, 12.5, 2.5, "algae", 2.0), (5, 10.5, 6.5, "mud", 7.0), (6, 3.5, 12.5, "algae", 1.0), (7, 99.0, 99.0, "sand", 1.0)]


@pytest.fixture(scope="module")
def tables(spark):
    px = spark.createDataFrame(raster(), "row long, col long, b1 double, b2 double, b3 double").cache()
    points = spark.createDataFrame(POINTS, "point_id long, x double, y double, cls string, cover double")
    return px, points


def complete():
    return {(r, c): v for r, c, *v in raster() if all(x is not None and x == x and x != 0 for x in v)}


def test_training_table(spark, tables):
    px, points = tables
    got = chains.training_table(px, points, BANDS, "cls", "cover", "point_id", tile=N, scale=0.2).collect()
    want = {(0, 0): ("sand", 2), (0, 1): ("mud", 5), (1, 0): ("algae", 6)}
    have = {(r.row, r.col): (r.cls, r.point_id) for r in got}
    assert have == {k: want[k[0] // N, k[1] // N] for k in complete() if (k[0] // N, k[1] // N) in want} and len(got) == len(have)
    assert len({r.segment_id for r in got}) == 3 and all(r.pc1 is not None and r.pc2 is not None for r in got)
    assert {(r.row, r.col): (r.b1, r.b2, r.b3) for r in got} == {k: tuple(complete()[k]) for k in have}


def test_statistics_table(spark, tables):
    px, points = tables
    b1, b2, b3 = (F.col(b) for b in BANDS)
    got = chains.statistics_table(px, points, BANDS, "cls", "cover", "point_id", N, 0.2, {"eg": fn.excess_green(b3, b2, b1)}, land=b1 > 0.65).collect()
    cells = complete()
    blocks = {k: np.array([v for (r, c), v in cells.items() if (r // N, c // N) == k]) for k in LEVELS}
    assert len(got) == 3 and {r.tile for r in got} == {"0_0", "0_1", "1_0"}  # the block of (1, 1) is land
    for r in got:
        own = blocks[tuple(int(x) for x in r.tile.split("_"))]
        assert r.n == len(own)
        for k, b in enumerate(BANDS):
            assert (r[f"{b}_min"], r[f"{b}_max"]) == (own[:, k].min(), own[:, k].max())
            assert r[f"{b}_mean"] == pytest.approx(own[:, k].mean()) and r[f"{b}_var"] == pytest.approx(own[:, k].var(ddof=1))
        assert r.eg == pytest.approx((2 * own[:, 1] - own[:, 2] - own[:, 0]).mean())
    assert {r.tile: r.cls for r in got} == {"0_0": "sand", "0_1": "mud", "1_0": "algae"}


def test_crowded_segments_are_refined(spark):
    """Two levels that merge at the whole scale and part at half of it, where two points lie in them."""
    rows = [(r, c, 0.0 if c < 5 else 0.16, 0.0) for r in range(4) for c in range(10)]
    px = spark.createDataFrame(rows, "row long, col long, b1 double, b2 double")
    seg = spark.createDataFrame([(r, c, 1) for r, c, *_ in rows], "row long, col long, segment_id long")
    at = spark.createDataFrame([(0, 0), (0, 9)], "row long, col long")
    fine = {(r.row, r.col): r.segment_id for r in chains.refine_regions(px, seg, at, ["b1", "b2"], 3.0).collect()}
    assert len(set(fine.values())) == 2 and all((fine[r, c] == fine[0, 0]) == (c < 5) for r, c, *_ in rows)
    one = chains.refine_regions(px, seg, at.limit(1), ["b1", "b2"], 3.0)
    assert {r.segment_id for r in one.collect()} == {1}


def square(x, y, w):
    return [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + w), (x, y + w))]


def test_polygon_gaps(spark):
    px = spark.createDataFrame([(r, c, float(r), 0.0 if c % 2 else 4.0) for r in range(10) for c in range(10)], "row long, col long, b1 double, b2 double")
    polygons = spark.createDataFrame([(1, square(0, 1, 2)), (2, square(5, 5, 3)), (3, square(6, 6, 1)), (4, square(0, 8, 1))], "poly_id long, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 0.5, 1.5, "z"), (2, 1.5, 2.5, "a"), (3, 5.5, 5.5, "z"), (4, 6.5, 6.5, "m"), (5, 9.5, 9.5, "unseen")], "point_id long, x double, y double, lab string")
    got = {r.code: (r.lab, r.cells, r.b1, r.b2) for r in chains.polygon_gaps(px, polygons, points, "lab", "point_id", ["b1", "b2"]).collect()}
    # Polygon 1 takes its last point's label; 3 lies over 2, which has the last of its own points' labels, m, as well.
    assert got == {1: ("a", 4, 1.5, 4.0), 2: ("m", 9, 6.0, 4.0)}


def test_polygon_change(spark, tmp_path):
    """Blocks whose class changes where they were planted to."""
    rng = random.Random(4)
    level = {"1": 0.1, "2": 0.5, "3": 0.9}
    was = lambda r, c: "123"[c // 10 % 3]
    now = lambda r, c: "2" if r < 5 and c < 10 else "3" if r >= 15 and 10 <= c < 20 else was(r, c)
    make = lambda f, w: spark.createDataFrame([(r, c, level[f(r, c)] + rng.uniform(-w, w), 1 - level[f(r, c)] + rng.uniform(-w, w)) for r in range(20) for c in range(30)], "row long, col long, b1 double, b2 double")
    before, after = make(was, 0.02), make(now, 0.004)  # what is predicted lies within what was learned
    after = after.withColumn("b1", F.when((F.col("row") == 19) & (F.col("col") == 29), None).otherwise(F.col("b1")))
    polygons = spark.createDataFrame([(k, k, square(10 * (k - 1) + 1, 2, 8)) for k in (1, 2, 3)], "poly_id int, int_class int, ring array<struct<x:double,y:double>>")
    scores, areas = chains.polygon_change(before, after, polygons, "int_class", "poly_id", ["b1", "b2"], "2", (tmp_path / "m").as_uri(), numTrees=10)
    assert {r.code: (r.cells, r.hectares) for r in areas.collect()} == {0: (350, 3.5), 1: (150, 1.5), 2: (50, 0.5), 3: (50, 0.5)}
    assert [r.oa > 0.95 for r in scores.collect()] == [True] * 3


ROWS = [(f, t, p) for f, t, p, n in [(0, "a", "a", 6), (0, "a", "b", 2), (0, "b", "b", 4), (1, "a", "a", 3), (1, "b", "a", 1), (1, "b", "b", 1), (1, "c", "a", 1)] for _ in range(n)]


def test_fold_metrics_by_hand(spark):
    df = spark.createDataFrame(ROWS, "fold int, truth string, pred string")
    got = {(r.fold, r.metric): r.v for r in chains.fold_metrics(df, ["fold"]).collect()}
    assert got[0, "oa"] == pytest.approx(10 / 12) and got[0, "kappa"] == pytest.approx((10 / 12 - (8 * 6 + 4 * 6) / 144) / (1 - (8 * 6 + 4 * 6) / 144))
    assert (got[0, "precision_b"], got[0, "recall_a"], got[0, "f1_b"]) == pytest.approx((4 / 6, 6 / 8, 8 / 10))
    assert got[0, "f1_macro"] == pytest.approx((12 / 14 + 8 / 10) / 2) and got[0, "f1_weighted"] == pytest.approx((8 * 12 / 14 + 4 * 8 / 10) / 12)
    assert got[0, "n_c_a"] == 0 and got[1, "n_c_a"] == 1 and got[1, "precision_c"] is None and got[1, "recall_c"] == 0
    assert got[1, "f1_macro"] == pytest.approx((2 * 3 / 8 + 2 / 3 + 0) / 3)


def test_report_averages_and_comparison(spark):
    df = spark.createDataFrame(ROWS, "fold int, truth string, pred string")
    before = chains.fold_metrics(df, ["fold"])
    after = chains.fold_metrics(df.withColumn("pred", F.col("truth")), ["fold"])
    got = {(r.metric, r.stat): r for r in chains.compare_reports(before, after).collect()}
    oa = got["oa", "mean"]
    assert (oa.before, oa.after) == (pytest.approx((10 / 12 + 4 / 6) / 2), 1.0) and oa.change == pytest.approx(100 * (1 / 0.75 - 1))
    assert got["n_a_b", "n"].before == 2 and got["n_a_b", "mean"].before == 1 and got["n_a_b", "mean"].after is None
    assert got["oa", "q50"].before == pytest.approx(0.75) and got["precision_c", "n"].before == 0
