"""Hand-made tables of a few rows for what the given tables don't hold: no data, ties, constants, edges."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapix.functions import bands, rules
from terrapix.operators import aggregates as ag
from terrapix.operators import folds, grid, polygons, segments, spatial
from terrapix.operators import statistics as st
from terrapix.operators import windows as wi
from terrapix.operators.quantiles import group_quantiles
from terrapix.sources import tables as src


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_indices_have_no_value_where_bands_cancel(spark):
    df = spark.createDataFrame([(1.0, -1.0), (0.3, 0.1), (None, 0.1), (0.0, 0.0)], "a double, b double")
    got = [r[0] for r in df.select(bands.normalised_difference(F.col("a"), F.col("b"))).collect()]
    assert got[0] is None and got[1] == pytest.approx(0.5) and got[2:] == [None, None]
    assert [r[0] for r in df.select(bands.log_ratio(F.col("a"), F.col("b"))).collect()][0] is None


def test_mask_makes_one_null_of_all_missing_values(spark):
    df = spark.createDataFrame([(0.0,), (float("nan"),), (float("inf"),), (-float("inf"),), (None,), (-9999.0,), (2.0,)], "v double")
    assert [r[0] for r in df.select(bands.mask(F.col("v"), -9999.0)).collect()] == [0.0, None, None, None, None, None, 2.0]


def test_zonal_stats_of_one_pixel_and_of_none(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 1.0), (3, 3.0)], "s int, b double")
    got = {r.s: r for r in ag.zonal_stats(df, ["s"], ["b"]).collect()}
    assert (got[1].b_mean, got[1].b_var) == (5.0, 0.0)
    assert got[2].b_mean is None and got[2].b_var is None and got[2].n == 1
    assert (got[3].b_var, got[3].b_skew) == (2.0, 0.0)


def test_majority_ties(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "x"), (3, "p"), (3, "q"), (3, "q"), (4, "m"), (4, "m"), (4, "n"), (4, "n")], "k int, c string")
    assert rows(wi.majority(df, ["k"], "c")) == [(1, "a", 1), (2, "x", 1), (3, "q", 2), (4, "m", 2)]
    assert [r[0] for r in rows(wi.majority(df, ["k"], "c", ties_lose=True))] == [2, 3, 4]


def test_dedupe_majority_prefers_class_then_cover(spark):
    df = spark.createDataFrame([(1, 1, "a", 1.0), (2, 1, "b", 9.0), (3, 1, "a", 2.0), (4, 2, "c", 1.0), (5, 2, "d", 7.0)], "id int, k int, c string, cover double")
    assert [r[0] for r in rows(wi.dedupe_majority(df, "k", "c", "cover", "id").select("id"))] == [3, 5]


def test_point_on_an_edge_belongs_to_the_cell_after_it(spark):
    raster = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(3) for c in range(3)], "row long, col long, v double")
    points = spark.createDataFrame([(1, 1.0, 2.0), (2, 0.99, 1.5), (3, 5.0, 0.0)], "id int, x double, y double")
    assert rows(grid.sample_raster(raster, points, "x", "y").select("id", "v")) == [(1, 21.0), (2, 10.0)]


def test_ring_edges_and_overlaps(spark):
    square = [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 4.0}, {"x": 0.0, "y": 4.0}]
    other = [{"x": p["x"] + 2, "y": p["y"]} for p in square]
    polys = spark.createDataFrame([(1, square), (2, other)], "poly_id int, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 0.0, 1.0), (2, 4.0, 1.0), (3, 6.0, 1.0), (4, 3.0, 3.0)], "id int, x double, y double")
    assert rows(grid.spatial_join(points, polys).select("id", "poly_id")) == [(1, 1), (2, 2), (4, 1), (4, 2)]
    burnt = {(r.row, r.col): r.c for r in polygons.rasterise(polys.withColumn("c", F.col("poly_id")), "c", "poly_id").collect()}
    assert len(burnt) == 24 and burnt[0, 1] == 1 and burnt[0, 2] == 2
    assert rows(grid.clip(points, polys, ["id"], invert=True).select("id")) == [(3,)]


def test_patches_cover_each_pixel_and_drop_the_rest(spark):
    df = spark.createDataFrame([(r, c) for r in range(10) for c in range(11)], "row int, col int")
    got = grid.patches(df, 10, 11, 4, 3)
    counts = {(r.patch_i, r.patch_j): r["count"] for r in got.groupBy("patch_i", "patch_j").count().collect()}
    assert counts == {(i, j): 16 for i in range(3) for j in range(3)}
    assert got.where("col = 10").count() == 0


def test_remainder_tiles_end_with_the_raster(spark):
    meta = spark.createDataFrame([(1, 50, 70, 10.0, 0.0, -10.0, 1000.0)], "raster_id int, height int, width int, a double, c double, e double, f double")
    got = {(r.i, r.j): r for r in grid.tile_bounds(meta, 32).collect()}
    assert len(got) == 6 and (got[1, 2].minx, got[1, 2].maxx, got[1, 2].miny, got[1, 2].maxy) == (640.0, 700.0, 500.0, 680.0)


def test_bilinear_keeps_a_plane(spark):
    df = spark.createDataFrame([(r, c, 2.0 * r + c) for r in range(4) for c in range(4)], "row long, col long, v double")
    got = {(r.row, r.col): r.v for r in grid.bilinear(df, "v", 2).collect()}
    assert len(got) == 64
    assert all(got[r, c] == pytest.approx(2 * ((r + 0.5) / 2 - 0.5) + (c + 0.5) / 2 - 0.5) for r in range(1, 7) for c in range(1, 7))


def test_projections_meet_known_points(spark):
    df = spark.createDataFrame([(27.0, 0.0), (10.0, 52.0)], "lon double, lat double")
    e, n = grid.to_utm(F.col("lon"), F.col("lat"), 35)
    le, ln = grid.laea_europe(F.col("lon"), F.col("lat"))
    got = df.select(e, n, le, ln).collect()
    assert got[0][:2] == pytest.approx((500000, 0), abs=1e-3)
    assert got[1][2:] == pytest.approx((4321000, 3210000), abs=1e-3)


def test_regions_are_connected_components(spark):
    picture = ["aab", "bab", "bbb", ".ab"]
    cells = [(r, c, None if x == "." else float(ord(x))) for r, line in enumerate(picture) for c, x in enumerate(line)]
    got = {(r.row, r.col): r.segment_id for r in segments.segment_regions(spark.createDataFrame(cells, "row long, col long, v double"), ["v"], 1.0).collect()}
    one = (0 << 32) + 1
    b = (0 << 32) + 3
    assert got[0, 0] == got[0, 1] == got[1, 1] == one
    assert {got[k] for k in [(0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0), (3, 2)]} == {b}
    assert got[3, 0] == 0 and got[3, 1] == (3 << 32) + 2
    merged = segments.merge_small(spark.createDataFrame([(r, c, s) for (r, c), s in got.items() if s], "row long, col long, segment_id long"), 2)
    assert {r.segment_id for r in merged.where("row = 3 and col = 1").collect()} == {b}
    shape = {r.segment_id: (r.cells, r.outline) for r in segments.outlines(spark.createDataFrame([(r, c, s) for (r, c), s in got.items()], "row long, col long, segment_id long")).collect()}
    assert shape[one] == (3, 8)


def test_buffered_folds_keep_train_away_from_test(spark):
    points = spark.createDataFrame([(k, float(k), 0.0, k % 2) for k in range(10)] + [(10, 100.0, 0.0, 0)], "id int, x double, y double, fold int")
    got = rows(spatial.buffered_folds(points, "fold", "id", 1.0))
    train = {(i, f) for i, f, role in got if role == "train"}
    assert train == {(10, 1)}
    assert len([1 for r in got if r[2] == "test"]) == 11


def test_folds_part_the_ids(spark):
    df = spark.createDataFrame([(k, "ab"[k % 3 == 0]) for k in range(50)], "id int, c string")
    got = folds.kfold(df, "id", 5, ["c"]).groupBy("c", "fold").count().collect()
    assert sum(r["count"] for r in got) == 50 and all(abs(r["count"] - {"a": 33, "b": 17}[r.c] / 5) < 1 for r in got)


def test_constant_class_has_no_distance(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 3.0), ("c", 2.0)], "c string, v double")
    assert rows(st.jeffries_matusita(df, "v", "c").select("cls_a", "cls_b")) == []
    assert rows(st.welch(df, "v", "c").select("cls_a", "cls_b")) == [("a", "b")]


def test_kruskal_with_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 2.0), ("b", 3.0), ("b", 4.0)], "c string, v double")
    got = st.kruskal_wallis(df, "v", "c").first()
    ranks = {1.0: 1, 2.0: 3, 3.0: 5, 4.0: 6}
    ra, rb = sum(ranks[v] for v in (1.0, 2.0, 2.0)), sum(ranks[v] for v in (2.0, 3.0, 4.0))
    want = (12 / 42 * (ra * ra / 3 + rb * rb / 3) - 21) / (1 - 24 / 210)
    assert got.h == pytest.approx(want) and got.df == 1


def test_change_codes_swap_when_epochs_swap(spark):
    df = spark.createDataFrame([("n", "n"), ("n", "x"), ("x", "n"), ("x", "y"), (None, "n"), ("n", None)], "a string, b string")
    ab = [r[0] for r in df.select(rules.change_code(F.col("a"), F.col("b"), "n")).collect()]
    ba = [r[0] for r in df.select(rules.change_code(F.col("b"), F.col("a"), "n")).collect()]
    assert ab == [1, 2, 3, 0, 0, 0] and [{2: 3, 3: 2}.get(x, x) for x in ba] == ab


def test_depth_texts(spark):
    df = spark.createDataFrame([("1,5 - 2,5",), ("-3,2",), ("4",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(rules.parse_depth(F.col("t"))).collect()] == [2.5, 3.2, 4.0, None, None]


def test_grouped_metadata(spark):
    text = ['v = "R";', "BEGIN_GROUP = B", "\tg = 1.5;", "END_GROUP = B", "w = (1, 2);"]
    lines = spark.createDataFrame([("f", k, t) for k, t in enumerate(text)], "file string, line int, text string")
    assert rows(src.grouped_metadata(lines)) == [("f", "B", "g", "1.5", 1.5), ("f", "top", "v", "R", None), ("f", "top", "w", "(1, 2)", None)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "row long, col long, v double, c string")
    assert ag.zonal_stats(none, ["c"], ["v"]).count() == 0
    assert segments.segment_regions(none, ["v"], 1.0).count() == 0
    assert st.kruskal_wallis(none, "v", "c").first().h is None
    assert ag.overall(ag.confusion(none, "c", "c")).first().oa is None


def test_tail_probabilities():
    from terrapix.functions.tails import beta_tail, gamma_tail

    assert beta_tail(5, 0.5, 10 / (10 + 4)) == pytest.approx(0.0733880, abs=1e-6)  # t = 2, 10 degrees of freedom
    assert beta_tail(0.5, 0.5, 1 / 2) == pytest.approx(0.5)  # t = 1, one degree: a Cauchy
    assert gamma_tail(1, 2.5) == pytest.approx(2.718281828459045**-2.5)
    assert gamma_tail(0.5, 3.841458820694124 / 2) == pytest.approx(0.05)
    assert gamma_tail(1.5, 0.1) == pytest.approx(0.977589, abs=1e-6)


def test_quantiles_and_running_totals_are_exact(spark):
    rnd = np.random.default_rng(2)
    values = np.round(rnd.gamma(2.0, 3.0, 500), 1)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(7)
    shares = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    assert group_quantiles(df, [], "v", shares).first().q == pytest.approx(np.quantile(values, shares).tolist())
    assert group_quantiles(df.where("v < 0"), [], "v", [0.5]).first().q == [None]
    for most in (10, 1000):  # cut into ranges, and in one window
        got = rows(wi.running_total(spark.createDataFrame([(k, k % 3) for k in range(100)], "k int, n int"), "k", "n", "total", most).select("k", "total"))
        assert sorted(got) == [(k, sum(j % 3 for j in range(k + 1))) for k in range(100)]


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (2.0, "b"), (2.0, "b"), (5.0, "a")], "v double, g string")
    assert sorted(rows(wi.average_ranks(df, "v", "g").select("v", "g", "c", "rank"))) == [(1.0, "a", 1, 1.0), (2.0, "a", 1, 3.0), (2.0, "b", 2, 3.0), (5.0, "a", 1, 5.0)]


def test_sample_per_class_takes_the_least_digests(spark):
    import hashlib

    ids = {"a": range(300), "b": range(300, 303), None: range(400, 420)}
    df = spark.createDataFrame([(k, c) for c, ks in ids.items() for k in ks], "id int, c string")
    got = wi.sample_per_class(df, "c", F.col("id"), 10).collect()
    for c, ks in ids.items():
        want = sorted(ks, key=lambda k: hashlib.md5(f"42-{k}".encode()).hexdigest())[:10]
        assert sorted(r.id for r in got if r.c == c) == sorted(want)


def test_leave_one_out_and_its_bound(spark):
    df = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "id int, k string")
    assert rows(spatial.leave_one_out(df, "k", "id")) == [(1, "p", "test"), (1, "q", "train"), (2, "p", "test"), (2, "q", "train"), (3, "p", "train"), (3, "q", "test")]
    with pytest.raises(ValueError, match="more than 1"):
        spatial.leave_one_out(df, "k", "id", most=1)


def test_only_polygons_are_scanned(spark, tmp_path):
    ring = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 1.0}]
    shape = "poly_id long, label string, type string, ring array<struct<x:double,y:double>>"
    spark.createDataFrame([(1, "a", "Polygon", ring)], shape).write.parquet(f"{tmp_path}/good")
    assert [r.poly_id for r in src.scan_polygons(spark, f"{tmp_path}/good").collect()] == [1]
    for k, row in enumerate([(2, "b", "Point", ring), (3, "c", "Polygon", ring[:2])]):
        spark.createDataFrame([row], shape).write.parquet(f"{tmp_path}/bad{k}")
        with pytest.raises(ValueError, match="not a polygon"):
            src.scan_polygons(spark, f"{tmp_path}/bad{k}")


def test_edges_of_segments(spark):
    seg = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 0, 2), (1, 1, 0)], "row long, col long, segment_id long")
    got = rows(segments.edges(seg).select("segment_id", "row", "col", "side"))
    assert sorted(got) == sorted([(1, 0, 0, s) for s in ("top", "bottom", "left")] + [(1, 0, 1, s) for s in ("top", "bottom", "right")] + [(2, 1, 0, s) for s in ("top", "bottom", "left", "right")])
    assert sorted(Counter(r[0] for r in got).items()) == sorted((r.segment_id, r.outline) for r in segments.outlines(seg).collect())


def test_zscore_steps_see_what_the_last_kept(spark):
    values = [(float(k % 10), float(k)) for k in range(50)] + [(100.0, 25.0), (5.0, 500.0)]
    got = {r.b for r in st.zscore_filter(spark.createDataFrame(values, "a double, b double"), ["a", "b"], 3.0).collect()}
    a = np.array(values)
    a = a[np.abs(a[:, 0] - a[:, 0].mean()) / a[:, 0].std() < 3]
    assert got == set(a[np.abs(a[:, 1] - a[:, 1].mean()) / a[:, 1].std() < 3, 1])
