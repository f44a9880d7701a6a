"""Queries that take a table as large as it is, on small tables larger than the pieces other queries take."""

import os

import duckdb
import pytest

from terrapix.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
HEIGHT, WIDTH = 45, 100


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """A raster of 45 x 100 pixels, whose last rows have a class of their own; 40 points near its first rows; orders."""
    d = tmp_path_factory.mktemp("whole")
    duckdb.sql(f"copy (select * replace (if(event_id >= 4000, 'far', event_type) as event_type) from '{SF}/events.parquet' where event_id < {HEIGHT * WIDTH}) to '{d}/events.parquet'")
    duckdb.sql(f"copy (select * from '{SF}/customer.parquet' where c_custkey <= 40) to '{d}/customer.parquet'")
    duckdb.sql(f"copy (select * from '{SF}/orders.parquet' where o_custkey <= 60) to '{d}/orders.parquet'")
    return str(d)


def points(d):
    """(id, x, y, segment) of every point."""
    return [(k, k * 7 % 100 + 0.5, k * 13 % 10 + 0.5, n) for k, n in duckdb.sql(f"select c_custkey, c_nationkey from '{d}/customer.parquet'").fetchall()]


def near(a, b, radius):
    return (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= radius * radius


def rows(spark, name, d):
    """The query's rows, which its SQL gives as well."""
    got = QUERIES[name](spark, d)
    have = sorted(tuple(r) for r in got.collect())
    if name in ORACLE:
        con = duckdb.connect()
        for f in os.listdir(d):
            con.sql(f"create view {f.split('.')[0]} as select * from '{d}/{f}'")
        assert have == sorted(con.sql(f"select {', '.join(got.columns)} from ({ORACLE[name]})").fetchall())
    return have


def test_crop_modulo_raster(spark, tables):
    assert [r[:2] for r in rows(spark, "crop_modulo_raster", tables)] == [(r, c) for r in range(40) for c in range(96)]


def test_patchify_raster(spark, tables):
    want = [(i * 6 + r, j * 6 + c, i, j, r, c) for i in range(7) for j in range(16) for r in range(8) for c in range(8)]
    assert rows(spark, "patchify_raster", tables) == sorted(want)


def test_patch_transform_raster(spark, tables):
    want = [(i, j, 500000.0 + j * 120, 6000000.0 - i * 30) for i in range(14) for j in range(7)]
    assert rows(spark, "patch_transform_raster", tables) == want


def test_buffer_join_all(spark, tables):
    p = points(tables)
    assert rows(spark, "buffer_join_all", tables) == sorted((a[0], b[0]) for a in p for b in p if near(a, b, 2))


def test_outside_buffer_all(spark, tables):
    p, fold = points(tables), {r.point_id: r.fold for r in QUERIES["stratified_group_kfold"](spark, tables).collect()}
    want = sorted((a[0], k) for a in p for k in set(fold.values()) if not any(fold[b[0]] == k and near(a, b, 2) for b in p))
    assert 0 < len(want) < len(p) * len(set(fold.values()))
    assert rows(spark, "outside_buffer_all", tables) == want


def test_missing_ids_all(spark, tables):
    known = {k for k, _, _, n in points(tables) if n < 12}
    want = sorted({k for (k,) in duckdb.sql(f"select o_custkey from '{tables}/orders.parquet'").fetchall()} - known)
    assert {k % 3 for k in want} == {0, 1, 2}
    assert rows(spark, "missing_ids_all", tables) == [(k,) for k in want]


def test_segment_disjoint_folds_all(spark, tables):
    have = rows(spark, "segment_disjoint_folds_all", tables)
    assert {fold for _, fold in have} == set(range(30))


def test_gap_clusters_all(spark, tables):
    assert [(r[0], r[2]) for r in rows(spark, "gap_clusters_all", tables)] == [("far", 500)]


def test_permutation_importance_of_every_band(spark):
    got = QUERIES["permutation_importance"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.band, r.repeat) for r in got) == [(f"b{b}", k) for b in range(1, 5) for k in range(10)]


def test_grid_search_over_several_tree_counts(spark):
    got = QUERIES["grid_search"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.trees, r.depth) for r in got) == [(n, depth) for n in (5, 10, 20) for depth in (3, 5)]
