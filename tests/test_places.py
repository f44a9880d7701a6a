"""Many rows at few places: joins make no row for each pair, but those of the result."""

import pytest
from pyspark.sql import functions as F

from terrapix.operators import chains, grid, places, segments
from terrapix.operators import polygons as po
from terrapix.operators import spatial as sp

RING = "array<struct<x:double,y:double>>"
PLACES = [(0.5, 0.5), (1.5, 0.5), (9.0, 9.0)]
RINGS = [[(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 0), (2, 0), (2, 1), (0, 1)]]
N, K = 300, 200


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(i, *PLACES[i % 3], f"h{i % 7}") for i in range(N)], "point_id long, x double, y double, hab string")


@pytest.fixture(scope="module")
def areas(spark):
    return spark.createDataFrame([(k, k % 5, [{"x": float(x), "y": float(y)} for x, y in RINGS[k % 2]]) for k in range(K)], f"poly_id long, fold int, ring {RING}")


def joined(df):
    """The rows of df, and the most rows that a join in its plan gave."""
    rows = df.collect()
    found, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        elif kind == "ReusedExchangeExec":
            todo.append(p.child())
        elif "Join" in kind and p.metrics().contains("numOutputRows"):
            found.append(p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return rows, max(found)


def inside(i, k):
    return i % 3 == 0 or i % 3 == 1 and k % 2 == 1


def test_points_within_a_radius(points):
    rows, most = joined(sp.buffer_join(points, points, "point_id", "point_id", 1.0))
    assert sorted(map(tuple, rows)) == [(i, j) for i in range(N) for j in range(N) if (i % 3 < 2) == (j % 3 < 2) and (i % 3 < 2 or j % 3 == 2)]
    assert most < 1000


def test_blocks_are_small_and_whole(spark):
    df = spark.range(5000).selectExpr("id", "id div 4000 as k", "if(id = 7, null, 1) as j")
    made = [r["items"] for r in places.blocks(df, ["k", "j"], F.col("id"), 100).collect()]
    assert sorted(x for r in made for x in r) == [x for x in range(5000) if x != 7]
    assert max(map(len, made)) < 200 and len(made) > 40


@pytest.mark.parametrize("left", [False, True])
def test_points_in_polygons(points, areas, left):
    a = areas.select("poly_id", "ring")
    rows, most = joined(grid.spatial_join_left(points, a, ["point_id"]) if left else grid.spatial_join(points, a))
    want = {(i, k) for i in range(N) for k in range(K) if inside(i, k)} | ({(i, None) for i in range(2, N, 3)} if left else set())
    assert {(r.point_id, r.poly_id) for r in rows} == want and len(rows) == len(want) and most < 1000
    assert all((r.x, r.y) == PLACES[r.point_id % 3] and r.hab == f"h{r.point_id % 7}" for r in rows)


@pytest.mark.parametrize("invert", [False, True])
def test_points_kept_by_polygons(points, areas, invert):
    rows, most = joined(grid.clip(points, areas, ["point_id"], invert=invert))
    assert sorted(r.point_id for r in rows) == [i for i in range(N) if (i % 3 == 2) == invert] and most < 1000


def test_points_counted_in_polygons(points, areas):
    rows, most = joined(grid.points_in(points, areas, "poly_id"))
    assert sorted(map(tuple, rows)) == [(k, sum(inside(i, k) for i in range(N))) for k in range(K)] and most < 1000


def test_gaps_of_polygons(spark, points, areas):
    pixels = spark.createDataFrame([(0, c, float(c + 1)) for c in range(4)], "row long, col long, b1 double")
    rows, most = joined(chains.polygon_gaps(pixels, areas, points, "hab", "point_id", ["b1"]))
    # The last polygon is a wide one, whose last point is the last of the first two places.
    last = max(i for i in range(N) if inside(i, K - 1))
    assert [(r.code, r.hab, r.cells, r.b1) for r in rows] == [(last % 7 + 1, f"h{last % 7}", 2, 1.5)] and most < 3000


def test_points_near_polygons(points, areas):
    rows, most = joined(po.points_near(points, areas, "point_id", "poly_id", 0.6))
    assert {tuple(r) for r in rows} == {(i, k) for i in range(N) for k in range(K) if i % 3 < 2} and len(rows) == 200 * K and most < 1000


def test_polygons_near_polygons(areas):
    rows, most = joined(po.polygons_near(areas.selectExpr("poly_id as l", "ring"), areas.selectExpr("poly_id as r", "ring"), "l", "r", 0.5))
    assert {tuple(r) for r in rows} == {(a, b) for a in range(K) for b in range(K)} and len(rows) == K * K and most < 1000


def test_ids_of_several_rings_and_places_pair_once(spark, points, areas):
    twice = areas.selectExpr("poly_id % 2 as poly_id", "ring").unionByName(areas.selectExpr("1 - poly_id % 2 as poly_id", "ring"))
    some = points.selectExpr("point_id % 2 as point_id", "x", "y")
    rows = po.points_near(some, twice, "point_id", "poly_id", 0.6).collect()
    assert sorted(map(tuple, rows)) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_folds_of_polygons(points, areas):
    rows, most = joined(po.buffered_polygon_folds(points, areas, "fold", "point_id", "poly_id", 0.6))
    want = [("point", i, f, "test" if i % 3 < 2 else "train") for i in range(N) for f in range(5)] + [("polygon", k, k % 5, "test") for k in range(K)]
    assert sorted(map(tuple, rows)) == sorted(want) and most < 3000


def test_segments_are_worked_out_once(spark):
    """What is read again is a stored table, so no plan holds the numbering of runs."""
    df = spark.range(40).selectExpr("id div 8 as row", "id % 8 as col", "(id % 3) / 3.0D as b")
    seg = segments.segment_regions(df, ["b"], 0.2, min_size=2)
    fine = segments.refine_segments(df, seg, df.select("row", "col"), ["b"], 0.2)
    for made in (seg, fine):
        assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString() and made.count() == 40
