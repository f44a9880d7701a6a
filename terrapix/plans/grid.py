"""Queries of grid operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid
from ..operators.aggregates import broadcast_row
from .registry import ORACLE, query
from .views import change_epochs, polys, pts, px, r, spec, sql


def meta(spark, d):
    """Raster metadata that follow from the pixel table: 10 m cells, the origin at (500000, 6000000)."""
    size = px(spark, d).agg((F.max("row") + 1).cast("int").alias("height"), (F.max("col") + 1).cast("int").alias("width"))
    return size.select(F.lit(1).alias("raster_id"), "height", "width", F.lit(10.0).alias("a"), F.lit(500000.0).alias("c"), F.lit(-10.0).alias("e"), F.lit(6000000.0).alias("f"))


META = "meta as (select 1 as raster_id, cast(max(row) + 1 as int) as height, cast(max(col) + 1 as int) as width, 10.0::double as a, 500000.0::double as c, -10.0::double as e, 6000000.0::double as f from px)"
INSIDE = (
    "len(list_filter(range(1, len(ring) + 1), lambda k: ((ring[k].y > {y}) <> (ring[k % len(ring) + 1].y > {y})) and "
    "{x} < (ring[k % len(ring) + 1].x - ring[k].x) * ({y} - ring[k].y) / nullif(ring[k % len(ring) + 1].y - ring[k].y, 0) + ring[k].x)) % 2 = 1"
)


@query("raster_bounds", sql("select raster_id, c as minx, c + a * width as maxx, f + e * height as miny, f as maxy from meta", "px", extra=META))
def raster_bounds(spark, d):
    return grid.raster_bounds(meta(spark, d)).select("raster_id", "minx", "maxx", "miny", "maxy")


@query("tile_bounds", sql("select raster_id, cast(i as int) as i, cast(j as int) as j, c + a * j * 32 as minx, c + a * least((j + 1) * 32, width) as maxx, f + e * least((i + 1) * 32, height) as miny, f + e * i * 32 as maxy from meta, range(0, (select cast(ceil(height / 32) as bigint) from meta)) ti(i), range(0, (select cast(ceil(width / 32) as bigint) from meta)) tj(j)", "px", extra=META))
def tile_bounds(spark, d):
    return grid.tile_bounds(meta(spark, d), 32)


@query("assign_tiles", sql("select row, col, cast(row // 32 as int) as tile_i, cast(col // 32 as int) as tile_j from px", "px"))
def assign_tiles(spark, d):
    return grid.assign_tiles(px(spark, d), 32).select("row", "col", "tile_i", "tile_j")


def sized(spark, d):
    """Every pixel with the raster's height and width."""
    return broadcast_row(px(spark, d), meta(spark, d).select("height", "width"))


@query("crop_modulo", sql("select row, col, b1 from px, meta where row < height - height % 8 and col < width - width % 8", "px", extra=META))
def crop_modulo(spark, d):
    return grid.crop_to_multiple(sized(spark, d), F.col("height"), F.col("width"), 8).select("row", "col", "b1")


@query(
    "patchify",
    sql("select row, col, cast(i as int) as patch_i, cast(j as int) as patch_j, cast(row - i * 6 as int) as pr, cast(col - j * 6 as int) as pc from px, range(0, (select cast((height - 8) // 6 + 1 as bigint) from meta)) ti(i), range(0, (select cast((width - 8) // 6 + 1 as bigint) from meta)) tj(j) where row >= i * 6 and row < i * 6 + 8 and col >= j * 6 and col < j * 6 + 8", "px", extra=META),
)
def patchify(spark, d):
    return grid.patches(sized(spark, d), F.col("height"), F.col("width"), 8, 6).select("row", "col", "patch_i", "patch_j", "pr", "pc")


@query("patch_transform", sql("select cast(i as int) as patch_i, cast(j as int) as patch_j, c + j * 12 * a as x0, f + i * 3 * e as y0 from meta, range(0, (select cast((height - 4) // 3 + 1 as bigint) from meta)) ti(i), range(0, (select cast((width - 24) // 12 + 1 as bigint) from meta)) tj(j)", "px", extra=META))
def patch_transform(spark, d):
    return grid.patch_origins(meta(spark, d), 4, 24, 3, 12).select("patch_i", "patch_j", "x0", "y0")


for _f in (crop_modulo, patchify, patch_transform):  # under both names that they had
    query(f"{_f.__name__}_raster", ORACLE[_f.__name__])(_f)


@query("sample_raster", sql("select p.point_id, x.row, x.col, x.b1, x.b2 from pts p join px x on x.row = cast(floor(p.y) as bigint) and x.col = cast(floor(p.x) as bigint)", "pts", "px"))
def sample_raster(spark, d):
    return grid.sample_raster(px(spark, d), pts(spark, d), "x", "y").select("point_id", "row", "col", "b1", "b2")


@query("filter_bbox", sql("select point_id, x, y from pts where x between 20 and 60 and y between 2 and 8", "pts"))
def filter_bbox(spark, d):
    return pts(spark, d).where("x between 20 and 60 and y between 2 and 8").select("point_id", "x", "y")


@query("spatial_join", sql(f"select point_id, poly_id, label from pts, polys where {INSIDE.format(x='x', y='y')}", "pts", "polys"))
def spatial_join(spark, d):
    return grid.spatial_join(pts(spark, d), polys(spark, d), cell=4.0).select("point_id", "poly_id", "label")


@query("spatial_join_left", sql(f"select a.point_id, b.poly_id from pts a left join (select point_id, poly_id from pts, polys where {INSIDE.format(x='x', y='y')}) b on a.point_id = b.point_id", "pts", "polys"))
def spatial_join_left(spark, d):
    return grid.spatial_join_left(pts(spark, d).select("point_id", "x", "y"), polys(spark, d), ["point_id"], cell=4.0).select("point_id", "poly_id")


@query("filter_in_polygon", sql(f"select point_id, x, y from pts p where exists (select 1 from polys where {INSIDE.format(x='p.x', y='p.y')})", "pts", "polys"))
def filter_in_polygon(spark, d):
    return grid.clip(pts(spark, d), polys(spark, d), ["point_id"]).select("point_id", "x", "y")


@query("filter_out_of_polygon", sql(f"select point_id, x, y from pts p where not exists (select 1 from polys where {INSIDE.format(x='p.x', y='p.y')})", "pts", "polys"))
def filter_out_of_polygon(spark, d):
    return grid.clip(pts(spark, d), polys(spark, d), ["point_id"], invert=True).select("point_id", "x", "y")


@query("patches_with_label", sql("select row, col, b1 from px where exists (select 1 from px q where q.row // 10 = px.row // 10 and q.col // 10 = px.col // 10 and q.b2 > 98)", "px"))
def patches_with_label(spark, d):
    tiled = grid.assign_tiles(px(spark, d), 10)
    some = tiled.groupBy("tile_i", "tile_j").agg(F.max(F.when(F.col("b2") > 98, 1).otherwise(0)).alias("any")).where("any > 0")
    return tiled.join(some, ["tile_i", "tile_j"], "left_semi").select("row", "col", "b1")


@query("drop_empty_tiles", sql("select segment_id, tile_id, b3 from segpx where tile_id in (select tile_id from segpx group by tile_id having count(b3) > 500)", "segpx"))
def drop_empty_tiles(spark, d):
    from .views import segpx

    pixels = segpx(spark, d)
    full = pixels.groupBy("tile_id").agg(F.count("b3").alias("n")).where("n > 500")
    return pixels.join(full, "tile_id", "left_semi").select("segment_id", "tile_id", "b3")


@query("dissolve", sql("select segment_id, count(*) as cells, min(x) as minx, max(x) as maxx, min(y) as miny, max(y) as maxy from (select distinct segment_id, x, y from pts) group by segment_id", "pts"))
def dissolve(spark, d):
    p = pts(spark, d).select("segment_id", "x", "y").distinct()
    return p.groupBy("segment_id").agg(F.count("*").alias("cells"), F.min("x").alias("minx"), F.max("x").alias("maxx"), F.min("y").alias("miny"), F.max("y").alias("maxy"))


@query("resample_average", sql(f"select row // 10 as row, col // 10 as col, {r('avg(b1)')} as b1, {r('avg(b2)')} as b2 from px group by row // 10, col // 10", "px"))
def resample_average(spark, d):
    return grid.downsample(px(spark, d), 10, ["b1", "b2"]).select("row", "col", F.round("b1", 6).alias("b1"), F.round("b2", 6).alias("b2"))


@query(
    "resample_bilinear",
    sql(
        f"select r as row, c as col, {r('sum(b1 * w) / sum(w)')} as b1 from (select f.r, f.c, s.b1, f.r // 2 = s.row and f.c // 2 = s.col as inside, (1 - abs((f.r + 0.5::double) / 2 - 0.5 - s.row)) * (1 - abs((f.c + 0.5::double) / 2 - 0.5 - s.col)) as w "
        "from spec s, (select unnest(range(-1, 4)) as dr), (select unnest(range(-1, 4)) as dc), lateral (select s.row * 2 + dr as r, s.col * 2 + dc as c) f where f.r >= 0 and f.c >= 0 and abs((f.r + 0.5::double) / 2 - 0.5 - s.row) < 1 and abs((f.c + 0.5::double) / 2 - 0.5 - s.col) < 1) group by r, c having bool_or(inside)",
        "spec",
    ),
)
def resample_bilinear(spark, d):
    return grid.bilinear(spec(spark, d), "b1", 2).select("row", "col", F.round("b1", 6).alias("b1"))


#: A finer, shifted grid over spec: cells of two thirds, which begin 0.4 and 0.3 cells off.
_GRID = "t as (select r, k, 0.3::double + 2.0::double / 3 * (k + 0.5::double) as x, 0.4::double + 2.0::double / 3 * (r + 0.5::double) as y from (select unnest(range(0, (select cast((max(row) + 1) * 3 / 2 as bigint) from spec))) as r), (select unnest(range(0, 38)) as k))"


def _target(spark, d):
    rows = spec(spark, d).agg(F.max("row")).first()[0]
    return {"height": (rows + 1) * 3 // 2, "width": 38, "a": 2.0 / 3, "c": 0.3, "e": 2.0 / 3, "f": 0.4}


@query("resample_nearest", sql("select t.r as row, t.k as col, s.b1 from t join spec s on s.row = cast(floor(t.y) as bigint) and s.col = cast(floor(t.x) as bigint)", "spec", extra=_GRID))
def resample_nearest(spark, d):
    return grid.resample(spec(spark, d), "b1", method="nearest", **_target(spark, d))


@query(
    "resample_grid",
    sql(
        f"select r as row, k as col, {r('sum(b1 * w) / sum(w)', 9)} as b1 from (select t.r, t.k, s.b1, (1 - abs(t.y - 0.5::double - s.row)) * (1 - abs(t.x - 0.5::double - s.col)) as w, s.row = floor(t.y) and s.col = floor(t.x) as own from t, "
        "(select unnest([0, 1]) as i), (select unnest([0, 1]) as j), spec s where s.row = cast(floor(t.y - 0.5::double) as bigint) + i and s.col = cast(floor(t.x - 0.5::double) as bigint) + j) group by r, k having bool_or(own)",
        "spec",
        extra=_GRID,
    ),
)
def resample_grid(spark, d):
    """Onto a grid of another cell size and origin."""
    return grid.resample(spec(spark, d), "b1", **_target(spark, d)).select("row", "col", F.round("b1", 9).alias("b1"))


@query("mosaic", sql("select row, col, coalesce(max(b1) filter (where src = 2), max(b1) filter (where src = 1)) as v from (select row, col, b1, 1 as src from px where row < 60 union all select row, col, nullif(b2, 0) as b1, 2 as src from px where row >= 40) group by all having count(b1) > 0", "px"))
def mosaic(spark, d):
    p = px(spark, d)
    one, two = p.where("row < 60").selectExpr("row", "col", "b1 as v", "1 as src"), p.where("row >= 40").selectExpr("row", "col", "nullif(b2, 0D) as v", "2 as src")
    return grid.mosaic(one.unionByName(two), "v", "src")


_DRAW = "cast(concat('0x', substr(md5(concat_ws('-', '42{}', cast(row // 10 as varchar), cast(col // 10 as varchar))), 1, 6)) as integer) / 16777216.0::double"


@query("augment_patches", sql(f"select row, col, cast(row // 10 as int) as tile_i, cast(col // 10 as int) as tile_j, cast(case when {_DRAW.format('f')} < 0.5 then 9 - col % 10 else col % 10 end as int) as pc, {r('least(greatest(b2 / 100 + (' + _DRAW.format('b') + ' - 0.5::double), 0), 1)')} as v from px", "px"))
def augment_patches(spark, d):
    p = grid.assign_tiles(px(spark, d), 10).withColumns({"pc": F.expr("cast(col % 10 as int)"), "v": F.col("b2") / 100})
    return grid.augment(p, 10, 42, ["tile_i", "tile_j"], ["v"]).select("row", "col", "tile_i", "tile_j", "pc", F.round("v", 6).alias("v"))


_SHIFT = "cast(floor({} * 7) as int) - 3"


@query(
    "random_crop",
    sql(
        f"select m.tile_i, m.tile_j, cast(a.pr as int) as pr, cast(b.pc as int) as pc, case when x.there then x.b1 else 0 end as b1, case when x.there then x.mask else 0 end as mask "
        f"from (select distinct cast(row // 10 as int) as tile_i, cast(col // 10 as int) as tile_j, {_SHIFT.format(_DRAW.format('y'))} as dy, {_SHIFT.format(_DRAW.format('x'))} as dx from px) m, (select unnest(range(0, 10)) as pr) a, (select unnest(range(0, 10)) as pc) b "
        "left join (select row // 10 as ti, col // 10 as tj, row % 10 as sr, col % 10 as sc, true as there, b1, cast(b2 > 50 as double) as mask from px) x on x.ti = m.tile_i and x.tj = m.tile_j and x.sr = a.pr + m.dy and x.sc = b.pc + m.dx",
        "px",
    ),
)
def random_crop(spark, d):
    """Image and mask of each patch, padded and cut again at a drawn place."""
    p = grid.assign_tiles(px(spark, d), 10).withColumns({"pr": F.expr("cast(row % 10 as int)"), "pc": F.expr("cast(col % 10 as int)"), "mask": F.expr("cast(b2 > 50 as double)")})
    return grid.random_crop(p, 10, 3, 42, ["tile_i", "tile_j"], ["b1", "mask"])


@query("reproject_points", None)
def reproject_points(spark, d):
    p = pts(spark, d).select("point_id", (24.0 + F.col("x") / 50).alias("lon"), (60.0 + F.col("y") / 10).alias("lat"))
    (e, n), (le, ln) = grid.to_utm(F.col("lon"), F.col("lat"), 35), grid.laea_europe(F.col("lon"), F.col("lat"))
    return p.select("point_id", *(F.round(c, 3).alias(k) for c, k in ((e, "utm_e"), (n, "utm_n"), (le, "laea_e"), (ln, "laea_n"))))


@query(
    "clahe_tiles",
    sql(
        "select p.row, p.col, coalesce(cast(floor(cum / total * 127) as int), 0) as equalised from px p left join (select ti, tj, b2, total, sum(least(n, cap)) over (partition by ti, tj order by b2 rows unbounded preceding) + excess * b2 / 128 as cum from "
        "(select *, sum(greatest(n - cap, 0)) over (partition by ti, tj) as excess from (select *, greatest(1, floor(2.0 * total / 128)) as cap from (select *, sum(n) over (partition by ti, tj) as total from (select row // 25 as ti, col // 25 as tj, b2, count(*) as n from px where b2 > 0 group by all))))) l "
        "on p.row // 25 = l.ti and p.col // 25 = l.tj and p.b2 = l.b2",
        "px",
    ),
)
def clahe_tiles(spark, d):
    return grid.equalise_tiles(px(spark, d), "b2", 25, 128).select("row", "col", "equalised")


@query("class_change", sql("select coalesce(a.cell, b.cell) as cell, case when a.cls is null or b.cls is null then 0 when a.cls = 'N' and b.cls = 'N' then 1 when a.cls = 'N' then 2 when b.cls = 'N' then 3 else 0 end as code from (select * from change_epochs where epoch = 1) a full join (select * from change_epochs where epoch = 2) b on a.cell = b.cell", "change_epochs"))
def class_change(spark, d):
    from ..functions.rules import change_code

    epochs = change_epochs(spark, d)
    a, b = (epochs.where(F.col("epoch") == k).select("cell", F.col("cls").alias(f"c{k}")) for k in (1, 2))
    return a.join(b, "cell", "full").select("cell", change_code(F.col("c1"), F.col("c2"), "N").alias("code"))
