"""Queries of polygons: burning, distances, folds outside buffers, rings round segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds as fo
from ..operators import polygons as po
from ..operators import segments
from . import extras  # noqa: F401  registers the segments' SQL
from .grid import INSIDE
from .registry import ORACLE, query
from .tables import DG
from .views import polys, pts, px, spec, sql

EDGES = "e as (select poly_id, int_class, ring[k].x as x1, ring[k].y as y1, ring[k % len(ring) + 1].x as x2, ring[k % len(ring) + 1].y as y2 from polys, lateral (select unnest(range(1, len(ring) + 1)) as k))"


def _distance(x: str, y: str, e: str) -> str:
    """Squared distance of a point and an edge of the table e."""
    dx, dy = f"({e}.x2 - {e}.x1)", f"({e}.y2 - {e}.y1)"
    t = f"greatest(0.0::double, least(1.0::double, (({x} - {e}.x1) * {dx} + ({y} - {e}.y1) * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
    return f"(pow({x} - ({e}.x1 + {t} * {dx}), 2) + pow({y} - ({e}.y1 + {t} * {dy}), 2))"


def _turn(p: str, q: str, r: str) -> str:
    """Which way r lies from p to q, each given as its x and y."""
    (px_, py), (qx, qy), (rx, ry) = (v.split(",") for v in (p, q, r))
    return f"(({qx} - {px_}) * ({ry} - {py}) - ({qy} - {py}) * ({rx} - {px_}))"


_A, _B = ("a.x1,a.y1", "a.x2,a.y2"), ("b.x1,b.y1", "b.x2,b.y2")
_CROSS = f"({_turn(*_A, _B[0])} * {_turn(*_A, _B[1])} < 0 and {_turn(*_B, _A[0])} * {_turn(*_B, _A[1])} < 0)"
_APART = f"least({_distance('a.x1', 'a.y1', 'b')}, {_distance('a.x2', 'a.y2', 'b')}, {_distance('b.x1', 'b.y1', 'a')}, {_distance('b.x2', 'b.y2', 'a')})"


def _near_points(radius: float) -> str:
    return f"select distinct point_id, poly_id from pts p, e where {_distance('p.x', 'p.y', 'e')} <= {radius * radius}::double union select point_id, poly_id from pts, polys where {INSIDE.format(x='x', y='y')}"


def _near_polygons(radius: float) -> str:
    inside = lambda a, b: f"select a.poly_id as left_id, b.poly_id as right_id from polys a, polys b where {INSIDE.replace('ring', f'{b}.ring').format(x=f'{a}.ring[1].x', y=f'{a}.ring[1].y')}"
    return f"select distinct a.poly_id as left_id, b.poly_id as right_id from e a, e b where {_CROSS} or {_APART} <= {radius * radius}::double union {inside('a', 'b')} union {inside('b', 'a')}"


_PASSES = (
    "greatest(0.0::double, least((col - x1) / nullif(x2 - x1, 0), (col + 1 - x1) / nullif(x2 - x1, 0)), least((row - y1) / nullif(y2 - y1, 0), (row + 1 - y1) / nullif(y2 - y1, 0))) < "
    "least(1.0::double, greatest((col - x1) / nullif(x2 - x1, 0), (col + 1 - x1) / nullif(x2 - x1, 0)), greatest((row - y1) / nullif(y2 - y1, 0), (row + 1 - y1) / nullif(y2 - y1, 0))) "
    "and (x1 <> x2 or (col < x1 and x1 < col + 1)) and (y1 <> y2 or (row < y1 and y1 < row + 1))"
)
_CENTRES = f"select row, col, poly_id, int_class from px, polys where {INSIDE.format(x='(col + 0.5::double)', y='(row + 0.5::double)')}"


def _burnt(cells: str) -> str:
    return f"select x.row, x.col, coalesce(b.int_class, 0) as int_class from px x left join (select row, col, arg_max(int_class, poly_id) as int_class from ({cells}) group by row, col) b on b.row = x.row and b.col = x.col"


def _rasterised(spark, d, all_touched):
    burnt = po.rasterise(polys(spark, d), "int_class", "poly_id", all_touched)
    return px(spark, d).select("row", "col").join(burnt, ["row", "col"], "left").select("row", "col", F.coalesce("int_class", F.lit(0)).alias("int_class"))


@query("rasterize_polygons", sql(_burnt(_CENTRES), "px", "polys"))
def rasterize_polygons(spark, d):
    return _rasterised(spark, d, False)


@query("rasterize_touched", sql(_burnt(f"{_CENTRES} union all select row, col, poly_id, int_class from px, e where {_PASSES}"), "px", "polys", extra=EDGES))
def rasterize_touched(spark, d):
    """Every cell whose interior a polygon meets."""
    return _rasterised(spark, d, True)


@query("polygon_buffer_join", sql(_near_points(1.3), "pts", "polys", extra=EDGES))
def polygon_buffer_join(spark, d):
    """Points in a polygon or its buffer."""
    return po.points_near(pts(spark, d), polys(spark, d), "point_id", "poly_id", 1.3)


@query("polygons_within", sql(_near_polygons(0.75), "polys", extra=EDGES))
def polygons_within(spark, d):
    """Polygons within a distance of each other."""
    p = polys(spark, d)
    return po.polygons_near(p.select(F.col("poly_id").alias("left_id"), "ring"), p.select(F.col("poly_id").alias("right_id"), "ring"), "left_id", "right_id", 0.75)


_K = f"f as (select poly_id, cast((row_number() over (partition by label order by {DG.format('poly_id')}, poly_id) - 1) % 5 as int) as fold from polys)"
_TESTS = f"(select distinct point_id, fold from (select point_id, poly_id from pts, polys where {INSIDE.format(x='x', y='y')}) join f using (poly_id))"


@query(
    "polygon_buffer_folds",
    sql(
        f"select 'point' as kind, point_id as id, fold, 'test' as role from {_TESTS} "
        "union all select 'point', p.point_id, k.fold, 'train' from pts p, k where not exists (select 1 from near join f using (poly_id) where near.point_id = p.point_id and f.fold = k.fold) "
        "union all select 'polygon', poly_id, fold, 'test' from f "
        "union all select 'polygon', p.poly_id, k.fold, 'train' from polys p, k where not exists (select 1 from beside join f on f.poly_id = beside.right_id where beside.left_id = p.poly_id and f.fold = k.fold)",
        "pts", "polys", extra=f"{EDGES}, {_K}, k as (select distinct fold from f), near as ({_near_points(1.3)}), beside as ({_near_polygons(1.3)})",
    ),
)
def polygon_buffer_folds(spark, d):
    """Folds of polygons; points and polygons outside the buffers of a fold's polygons train it."""
    p = fo.kfold(polys(spark, d), "poly_id", 5, ["label"]).select("poly_id", "fold", "ring")
    return po.buffered_polygon_folds(pts(spark, d), p, "fold", "point_id", "poly_id", 1.3)


def _segments(spark, d):
    return segments.segment_regions(spec(spark, d), ["b1"], 0.02)


@query("segment_rings")
def segment_rings(spark, d):
    """Corners of the rings of every segment; tests burn them back and trace them by hand."""
    return po.segment_rings(_segments(spark, d))


@query("burn_rings", ORACLE["segment_regions"])
def burn_rings(spark, d):
    """Rings traced round segments and burnt again, which gives the segments back."""
    rings = po.ring_arrays(po.segment_rings(_segments(spark, d)))
    return po.burn(po.ring_edges(rings, "segment_id"), ["segment_id"]).select("row", "col", "segment_id")
