"""Queries of scans and sinks, radiometry, segments, models and composite jobs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bands as fn
from ..operators import aggregates as ag
from ..operators import folds as fo
from ..operators import grid, models, regions, segments
from ..operators import statistics as st
from ..operators import windows as wi
from ..operators.spatial import few
from ..sources import tables as src
from ..sources.shared import shared_dir, stored
from .registry import query
from .views import polys, pts, px, r, segpx, spec, sql, table

B = ["b1", "b2", "b3", "b4"]


def scratch(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- scans and sinks ----


@query("scan_pixels", "select event_id, event_type, value from events")
def scan_pixels(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", "value")


@query("scan_band_subset", "select l_orderkey, l_linenumber, l_tax from lineitem")
def scan_band_subset(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_tax")


@query("stack_bands", sql("select row, col, b1, b2, b3 from spec", "spec"))
def stack_bands(spark, d):
    pixels = spec(spark, d)
    return src.stack_bands({b: pixels.select("row", "col", F.col(b).alias("value")) for b in ("b1", "b2", "b3")})


@query("write_pixels", sql("select row, col, b1, cast(row // 16 as int) as tile_i, cast(col // 16 as int) as tile_j from spec", "spec"))
def write_pixels(spark, d):
    path = scratch(spark, "pixels")
    src.write_pixels(spec(spark, d).select("row", "col", "b1"), path, 16, "double")
    return spark.read.parquet(path).select("row", "col", "b1", "tile_i", "tile_j")


@query("scan_csv_locale", sql("select point_id, round(depth, 2) + 0.0 as depth, hab_class from pts", "pts"))
def scan_csv_locale(spark, d):
    path = scratch(spark, "observations")
    comma = F.regexp_replace(F.round("depth", 2).cast("string"), r"\.", ",")
    pts(spark, d).select("point_id", comma.alias("depth"), "hab_class").write.option("sep", ";").option("encoding", "ISO-8859-1").option("header", True).csv(path)
    read = src.scan_delimited(spark, path, ["point_id", "depth", "hab_class"])
    return read.select(F.col("point_id").cast("long").alias("point_id"), src.decimal_comma(F.col("depth")).alias("depth"), "hab_class")


@query("scan_many_csv", sql("select segment_id % 4 as year, count(*) as n from pts group by 1", "pts"))
def scan_many_csv(spark, d):
    path = scratch(spark, "segvals")
    pts(spark, d).select("point_id", (F.col("segment_id") % 4).alias("year")).write.partitionBy("year").option("sep", ";").option("header", True).csv(path)
    read = src.scan_delimited(spark, f"{path}/*", ["point_id"])
    year = F.regexp_extract("file", r"year=(\d+)", 1).cast("long")
    return read.groupBy(year.alias("year")).agg(F.count("*").alias("n"))


@query("write_tables", "select c_mktsegment as hab_class, count(*) as n from customer group by 1")
def write_tables(spark, d):
    path = scratch(spark, "counts")
    pts(spark, d).groupBy("hab_class").agg(F.count("*").alias("n")).write.json(path)
    return spark.read.schema("hab_class string, n long").json(path)


@query("scan_points", sql("select point_id, x, y from pts", "pts"))
def scan_points(spark, d):
    return src.points_from_xy(pts(spark, d), "x", "y").select("point_id", "geometry.x", "geometry.y")


@query("scan_polygons", "select s_suppkey as poly_id, concat('n', cast(s_nationkey as varchar)) as label, 4 as corners, (s_suppkey * 3) % 90 + 0.0::double as minx, (s_suppkey * 7) % 8 + 1.0::double as maxy from supplier")
def scan_polygons(spark, d):
    """Rectangles that follow from the suppliers, written as polygons and scanned."""
    path = scratch(spark, "polygons")
    x, y, w = "double(s_suppkey * 3 % 90)", "double(s_suppkey * 7 % 8)", "double(1 + s_nationkey % 5)"
    corners = ", ".join(f"named_struct('x', {a}, 'y', {b})" for a, b in ((x, y), (f"{x} + {w}", y), (f"{x} + {w}", f"{y} + 1D"), (x, f"{y} + 1D")))
    table(spark, d, "supplier").selectExpr("s_suppkey as poly_id", "concat('n', s_nationkey) as label", "'Polygon' as type", f"array({corners}) as ring").write.parquet(path)
    b = grid.with_bounds(src.scan_polygons(spark, path))
    return b.select("poly_id", "label", F.size("ring").alias("corners"), "minx", "maxy")


@query("points_from_xy", sql("select point_id, x + y as total from pts", "pts"))
def points_from_xy(spark, d):
    return src.points_from_xy(pts(spark, d), "x", "y").select("point_id", (F.col("geometry.x") + F.col("geometry.y")).alias("total"))


@query("parse_group_metadata", "select cast(o_orderkey as varchar) as file, k.grp, k.key, k.value, try_cast(k.value as double) as number from orders, lateral (select unnest([{'grp': 'top', 'key': 'version', 'value': 'R1'}, {'grp': 'BAND_B', 'key': 'absCal', 'value': cast(o_orderkey % 7 as varchar)}, {'grp': 'IMAGE', 'key': 'status', 'value': o_orderstatus}]) as k)")
def parse_group_metadata(spark, d):
    orders = table(spark, d, "orders")
    text = ['version = "R1";', "BEGIN_GROUP = BAND_B", F.concat(F.lit("\tabsCal = "), (F.col("o_orderkey") % 7).cast("string"), F.lit(";")), "END_GROUP = BAND_B", "BEGIN_GROUP = IMAGE", F.concat(F.lit('  status = "'), "o_orderstatus", F.lit('";')), "END_GROUP = IMAGE", "END;"]
    lines = F.array(*(x if not isinstance(x, str) else F.lit(x) for x in text))
    rows = orders.select(F.col("o_orderkey").cast("string").alias("file"), F.posexplode(lines).alias("line", "text"))
    return src.grouped_metadata(rows)


@query("pair_tiles", "select concat(cast(l_partkey % 50 as varchar), '_', cast(l_suppkey % 5 as varchar)) as suffix, count(distinct l_returnflag)::int as kinds from lineitem group by 1")
def pair_tiles(spark, d):
    name = F.concat_ws("_", (F.col("l_partkey") % 50).cast("string"), (F.col("l_suppkey") % 5).cast("string"))
    paths = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), F.concat(F.lit("/tiles/"), "l_returnflag", F.lit("/t_"), name, F.lit(".tif")).alias("path"))
    return src.pair_tiles(paths).select("suffix", F.size("paths").alias("kinds"))


# ---- radiometry ----

CAL = [("b1", 1.5, -1.2, 0.0123, 0.054), ("b2", 0.98, 0.4, 0.0151, 0.063), ("b3", 1.02, -0.7, 0.0098, 0.057)]
SSI = {"b1": 1974.24, "b2": 1856.41, "b3": 1559.46}
_CAL = "cal as (select * from (values " + ", ".join(f"('{b}', {g}::double, {o}::double, {a}::double, {w}::double, {SSI[b]}::double)" for b, g, o, a, w in CAL) + ") as t(band, gain, off, abscal, width, ssi))"
_LONG = "long as (select row, col, unnest(['b1', 'b2', 'b3']) as band, unnest([b1, b2, b3]) * 10000 as dn from spec)"


def calibrated(spark, d):
    cal = spark.createDataFrame([(b, g, o, a, w, SSI[b]) for b, g, o, a, w in CAL], "band string, gain double, off double, abscal double, width double, ssi double")
    long = spec(spark, d).unpivot(["row", "col"], ["b1", "b2", "b3"], "band", "v").withColumn("dn", F.col("v") * 10000)
    return long.join(F.broadcast(cal), "band")


@query("join_calibration", sql("select row, col, band, gain, off from long join cal using (band)", "spec", extra=f"{_CAL}, {_LONG}"))
def join_calibration(spark, d):
    return calibrated(spark, d).select("row", "col", "band", "gain", "off")


@query("toa_radiance", sql(f"select row, col, band, {r('gain * dn * (abscal / width) + off')} as radiance from long join cal using (band)", "spec", extra=f"{_CAL}, {_LONG}"))
def toa_radiance(spark, d):
    rad = fn.radiance(F.col("dn"), F.col("gain"), F.col("off"), F.col("abscal"), F.col("width"))
    return calibrated(spark, d).select("row", "col", "band", F.round(rad, 6).alias("radiance"))


@query("toa_reflectance", sql(f"select row, col, band, {r('(gain * dn * (abscal / width) + off) * 1.0167::double * 1.0167::double * pi() / (ssi * cos(radians(90 - 52.5::double)))')} as reflectance from long join cal using (band)", "spec", extra=f"{_CAL}, {_LONG}"))
def toa_reflectance(spark, d):
    rad = fn.radiance(F.col("dn"), F.col("gain"), F.col("off"), F.col("abscal"), F.col("width"))
    refl = fn.toa_reflectance(rad, F.lit(1.0167), F.col("ssi"), fn.solar_zenith(F.lit(52.5)))
    return calibrated(spark, d).select("row", "col", "band", F.round(refl, 6).alias("reflectance"))


@query("solar_zenith", sql(f"select row, col, {r('radians(90 - b2)')} as zenith from px", "px"))
def solar_zenith(spark, d):
    return px(spark, d).select("row", "col", F.round(fn.solar_zenith(F.col("b2")), 6).alias("zenith"))


_G = "(357.529::double + 0.98560028::double * (floor(365.25::double * (y + 4716)) + floor(30.6001::double * (m + 1)) + day(ts) + (hour(ts) + minute(ts) / 60.0::double + second(ts) / 3600.0::double) / 24 + (2 - floor(y / 100.0::double) + floor(floor(y / 100.0::double) / 4)) - 1524.5::double - 2451545))"


@query("earth_sun_distance", sql(f"select row, col, {r(f'1.00014::double - 0.01671::double * cos(radians({_G})) - 0.00014::double * cos(radians(2 * {_G}))')} as au from (select row, col, ts, case when month(ts) <= 2 then year(ts) - 1 else year(ts) end as y, case when month(ts) <= 2 then month(ts) + 12 else month(ts) end as m from px)", "px"))
def earth_sun_distance(spark, d):
    return px(spark, d).select("row", "col", F.round(fn.earth_sun_distance(F.col("ts")), 6).alias("au"))


#: A scene's metadata as text, as image suppliers deliver it: calibration of four bands, the sun's height and the time.
SCENE = [("b1", 0.0123, 0.054), ("b2", 0.0151, 0.063), ("b3", 0.0098, 0.057), ("b8", 0.0121, 0.098)]
SCENE_SSI = {"b1": 1974.24, "b2": 1856.41, "b3": 1559.46, "b8": 1069.73}
_CHAIN_BANDS = list(SCENE_SSI)
_SCENE = "s as (select * from (values " + ", ".join(f"('{b}', {a}::double, {w}::double, {SCENE_SSI[b]}::double)" for b, a, w in SCENE) + ") as t(band, abscal, width, ssi))"
_AU = r(f"1.00014::double - 0.01671::double * cos(radians({_G})) - 0.00014::double * cos(radians(2 * {_G}))", 12)
_CHAIN = ", ".join(
    [
        _SCENE,
        f"au as (select {_AU} as d from (select timestamp '2019-07-14 10:12:30' as ts, 2019 as y, 7 as m))",
        "dn as (select row, col, unnest(['b1', 'b2', 'b3', 'b8']) as band, unnest([b1, b2, b3, b8]) * 10000 as dn from spec)",
        "refl as (select row, col, band, case when dn <> 0 then 1000 * dn * (abscal / width) * d * d * pi() / (ssi * cos(radians(90 - 52.5::double))) end as v from dn join s using (band), au)",
        "bin as (select band, cast(floor(v) as int) as bin, count(*) as n from refl where v > 0 group by all)",
        "sec as (select band, n as f from (select *, row_number() over (partition by band order by bin) as k from bin) where k = 2)",
        "thr as (select band, min(bin) as t from bin join sec using (band) where bin > 0 and n >= 1.5 * f group by band)",
        "dos as (select row, col, max(v) filter (where band = 'b1') as b1, max(v) filter (where band = 'b2') as b2, max(v) filter (where band = 'b3') as b3, max(v) filter (where band = 'b8') as b8 from (select row, col, refl.band, case when v <> 0 then case when t is null then 0 else greatest(v - t, 0) end end as v from refl left join thr on refl.band = thr.band) group by row, col)",
        "g as (select " + ", ".join(f"regr_slope({b}, b8) as s_{b}" for b in ("b1", "b2", "b3")) + ", min(b8) as m from dos where b8 < 40)",
    ]
)


@query("radiometry", sql("select row, col, " + ", ".join(f"{r(f'case when {b} - s_{b} * (b8 - m) >= 0 then {b} - s_{b} * (b8 - m) end', 5)} as {b}" for b in ("b1", "b2", "b3")) + f", {r('b8 - m', 5)} as b8 from dos, g", "spec", extra=_CHAIN))
def radiometry(spark, d):
    """From digital numbers to water reflectance, in thousandths: metadata, radiance, reflectance, dark objects, glint."""
    text = [x for b, a, w in SCENE for x in (f"BEGIN_GROUP = BAND_{b}", f"\tabsCalFactor = {a};", f"\teffectiveBandwidth = {w};", f"END_GROUP = BAND_{b}")]
    text += ["BEGIN_GROUP = IMAGE_1", "\tmeanSunEl = 52.5;", '\tfirstLineTime = "2019-07-14 10:12:30";', "END_GROUP = IMAGE_1", "END;"]
    lines = spark.createDataFrame([("scene", k, x) for k, x in enumerate(text)], "file string, line int, text string")
    meta = src.grouped_metadata(lines)
    ssi = spark.createDataFrame(list(SCENE_SSI.items()), "band string, ssi double")
    band = F.regexp_extract("grp", "^BAND_(.+)$", 1).alias("band")
    value = lambda key: F.max(F.when(F.col("key") == key, F.col("number")))
    cal = meta.groupBy(band).agg(value("absCalFactor").alias("abscal"), value("effectiveBandwidth").alias("width")).join(ssi, "band")
    time = F.to_timestamp(F.max(F.when(F.col("key") == "firstLineTime", F.col("value"))))
    image = meta.agg(value("meanSunEl").alias("elevation"), F.round(fn.earth_sun_distance(time), 12).alias("au"))

    long = spec(spark, d).unpivot(["row", "col"], _CHAIN_BANDS, "band", "v").join(F.broadcast(cal), "band")  # a row for each band
    rad = fn.radiance(F.col("v") * 10000, F.lit(1.0), F.lit(0.0), F.col("abscal"), F.col("width"))
    refl = fn.toa_reflectance(rad, F.col("au"), F.col("ssi"), fn.solar_zenith(F.col("elevation"))) * 1000
    long = ag.broadcast_row(long, image).select("row", "col", "band", refl.alias("v"))
    long = stored(long, "reflectance")  # read three times: for thresholds, the glint's fit and the result
    dark = wi.dark_thresholds(long, "band", "v", _CHAIN_BANDS, 1.5)
    wide = ag.broadcast_row(long.groupBy("row", "col").pivot("band", _CHAIN_BANDS).agg(F.max("v")), dark)
    less = lambda b: F.when(F.col(f"dark_{b}").isNull(), F.lit(0.0)).otherwise(F.greatest(F.col(b) - F.col(f"dark_{b}"), F.lit(0.0)))
    pixels = wide.withColumns({b: F.when(F.col(b) != 0, less(b)) for b in _CHAIN_BANDS})
    out = st.glint_apply(pixels, pixels.where("b8 < 40"), ["b1", "b2", "b3"], "b8", [])
    return out.select("row", "col", *(F.round(b, 5).alias(b) for b in _CHAIN_BANDS))


# ---- segments ----

_BINS = "n as (select row, col, row * 100000 + col as id, cast(floor(b1 / 0.02) as int) as k from spec), e as (select a.id as u, b.id as v from n a join n b on a.k = b.k and ((a.row = b.row and a.col + 1 = b.col) or (a.col = b.col and a.row + 1 = b.row))), s as (select u, v from e union all select v, u from e), reach as (select id, id as seen from n union select reach.id, s.v from reach join s on reach.seen = s.u)"


@query("segment_regions", sql("select n.row, n.col, (min(reach.seen) // 100000) * 4294967296 + min(reach.seen) % 100000 + 1 as segment_id from n join reach on n.id = reach.id group by n.row, n.col, n.id", "spec", extra=_BINS))
def segment_regions(spark, d):
    return segments.segment_regions(spec(spark, d), ["b1"], 0.02)


_LABELLED = f"{_BINS}, lab as (select n.row, n.col, min(reach.seen) as lo from n join reach on n.id = reach.id group by n.row, n.col, n.id), inn as (select a.lo, count(*) as k from lab a join lab b on a.lo = b.lo and ((a.row = b.row and a.col + 1 = b.col) or (a.col = b.col and a.row + 1 = b.row)) group by a.lo)"


@query(
    "vectorize_segments",
    sql(
        "select (lo // 100000) * 4294967296 + lo % 100000 + 1 as segment_id, count(*) as cells, min(row) as min_row, max(row) as max_row, min(col) as min_col, max(col) as max_col, "
        f"{r('avg(row + 0.5::double)')} as center_row, {r('avg(col + 0.5::double)')} as center_col, 4 * count(*) - 2 * coalesce(any_value(k), 0) as outline from lab left join inn using (lo) group by lo",
        "spec",
        extra=_LABELLED,
    ),
)
def vectorize_segments(spark, d):
    shapes = segments.outlines(segments.segment_regions(spec(spark, d), ["b1"], 0.02))
    return shapes.withColumns({c: F.round(c, 6) for c in ("center_row", "center_col")})


@query(
    "segment_edges",
    sql(
        "select (e.lo // 100000) * 4294967296 + e.lo % 100000 + 1 as segment_id, e.row, e.col, e.side from (select lo, row, col, unnest(['bottom', 'left', 'right', 'top']) as side, unnest([1, 0, 0, -1]) as dr, unnest([0, -1, 1, 0]) as dc from lab) e "
        "where not exists (select 1 from lab b where b.lo = e.lo and b.row = e.row + e.dr and b.col = e.col + e.dc)",
        "spec",
        extra=_LABELLED,
    ),
)
def segment_edges(spark, d):
    """The outline of every segment, edge by edge."""
    return segments.edges(segments.segment_regions(spec(spark, d), ["b1"], 0.02))


@query("merge_regions")
def merge_regions(spark, d):
    """Regions that grew from pixels by rounds, after smoothing; no SQL has such rounds."""
    return regions.merge_regions(spec(spark, d), ["b1", "b2"], scale=0.05, sigma=0.5, min_size=4)


@query("refine_segments")
def refine_segments(spark, d):
    pixels = spec(spark, d)
    seg = segments.segment_regions(pixels, ["b1"], 0.04, min_size=2)
    points = pts(spark, d).selectExpr("cast(floor(y) as bigint) as row", "cast(floor(x / 4) as bigint) as col")
    return segments.refine_segments(pixels, seg, points, ["b1"], 0.04)


@query("segment_training_table", sql("select x.segment_id, x.b1, x.b2, c.hab_class from segpx x join (select segment_id, hab_class from (select *, row_number() over (partition by segment_id order by n desc, depth desc, point_id) as rn from (select *, count(*) over (partition by segment_id, hab_class) as n from pts)) where rn = 1) c using (segment_id) where x.b3 is not null", "segpx", "pts"))
def segment_training_table(spark, d):
    """Every complete pixel of a segment that holds a point, with the point's class after majority de-duplication."""
    labels = wi.dedupe_majority(pts(spark, d), "segment_id", "hab_class", "depth", "point_id").select("segment_id", "hab_class")
    return segpx(spark, d).dropna(subset=["b3"]).join(labels, "segment_id").select("segment_id", "b1", "b2", "hab_class")


@query("gap_clusters", sql("select cls, b2, round(avg(nullif(b1, 0)), 6) + 0.0 as c1, count(*) as n from px where not exists (select 1 from px x join pts p on x.row = cast(floor(p.y) as bigint) and x.col = cast(floor(p.x) as bigint) where x.cls = px.cls and x.b2 = px.b2) group by cls, b2", "px", "pts"))
def gap_clusters(spark, d):
    """Clusters, here of one class and one value of the second band, that no point lies in."""
    pixels = px(spark, d)
    seen = grid.sample_raster(pixels, pts(spark, d), "x", "y").select("cls", "b2").distinct()
    return pixels.join(seen, ["cls", "b2"], "left_anti").groupBy("cls", "b2").agg(F.round(F.avg(fn.mask(F.col("b1"))), 6).alias("c1"), F.count("*").alias("n"))


@query("gap_clusters_all", sql("select cls, avg(nullif(b1, 0)) as c1, count(*) as n from px where cls not in (select x.cls from px x join pts p on x.row = cast(floor(p.y) as bigint) and x.col = cast(floor(p.x) as bigint)) group by cls", "px", "pts").replace("avg(nullif(b1, 0))", "round(avg(nullif(b1, 0)), 6) + 0.0"))
def gap_clusters_all(spark, d):
    pixels = px(spark, d)
    seen = grid.sample_raster(pixels, pts(spark, d), "x", "y").select("cls").distinct()
    return pixels.join(F.broadcast(seen), "cls", "left_anti").groupBy("cls").agg(F.round(F.avg(fn.mask(F.col("b1"))), 6).alias("c1"), F.count("*").alias("n"))


@query("gap_polygons", sql("select poly_id, count(*) as points from pts, polys where len(list_filter(range(1, len(ring) + 1), lambda k: ((ring[k].y > y) <> (ring[k % len(ring) + 1].y > y)) and x < (ring[k % len(ring) + 1].x - ring[k].x) * (y - ring[k].y) / nullif(ring[k % len(ring) + 1].y - ring[k].y, 0) + ring[k].x)) % 2 = 1 group by poly_id", "pts", "polys"))
def gap_polygons(spark, d):
    return grid.points_in(pts(spark, d), polys(spark, d), "poly_id")


# ---- models: no SQL has these fits ----


def labelled(spark, d):
    return spec(spark, d).select("row", "col", *B, F.col("cls").cast("string").alias("cls"))


@query("pca_transform")
def pca_transform(spark, d):
    out, _ = models.pca(spec(spark, d).select("row", "col", *B), B, 2)
    return out.select("row", "col", F.round(F.abs(F.col("pc")[0]), 6).alias("pc1"), F.round(F.abs(F.col("pc")[1]), 6).alias("pc2"))


@query("kmeans_clusters")
def kmeans_clusters(spark, d):
    return models.kmeans(spec(spark, d).select("row", "col", *B), B).select("row", "col", "cluster")


def _classifier(name, kind, **params):
    @query(name)
    def run(spark, d):
        rows = labelled(spark, d)
        extra = {"classes": rows.select("cls").distinct().count()} if kind == "mlp" else {}
        model = models.train(rows.where("row % 3 <> 0"), B, "cls", kind, **params, **extra)
        return models.predict(model, rows).select("row", "col", "cls", "pred")


_classifier("rf_classify", "rf")
_classifier("svm_classify", "svm")
_classifier("gbt_classify", "gbt")
_classifier("mlp_classify", "mlp")
_classifier("predict_pixels", "rf", numTrees=10)


@query("rf_regress")
def rf_regress(spark, d):
    rows = spec(spark, d).select("row", "col", *B, F.col("b5").alias("y"))
    return models.regress(rows.where("row % 3 <> 0"), B, "y").transform(rows).select("row", "col", "y", F.round("prediction", 6).alias("pred"))


@query("predict_proba_pixels")
def predict_proba_pixels(spark, d):
    rows = labelled(spark, d)
    return models.probabilities(models.train(rows, B, "cls", numTrees=10), rows, ["row", "col"])


@query("predict_segments")
def predict_segments(spark, d):
    stats = segpx(spark, d).groupBy("segment_id").agg(F.avg("b1").alias("m1"), F.avg("b2").alias("m2"))
    labels = wi.majority(segpx(spark, d), ["segment_id"], "cls").drop("n")
    rows = stats.join(labels, "segment_id")
    pred = models.predict(models.train(rows, ["m1", "m2"], "cls", numTrees=5), rows).select("segment_id", "pred")
    return segpx(spark, d).join(pred, "segment_id", "left").groupBy("segment_id", "pred").agg(F.count("*").alias("pixels"))


def folded(spark, d):
    return fo.kfold(labelled(spark, d).withColumn("id", F.col("row") * 1000 + F.col("col")), "id", 3, ["cls"])


@query("cross_validate")
def cross_validate(spark, d):
    return models.score(models.cross_validate(folded(spark, d), B, "cls", "fold", 3, numTrees=5), ["fold"])


@query("grid_search")
def grid_search(spark, d):
    return models.grid_search(folded(spark, d), B, "cls", "fold", 3, [5, 10, 20], [3, 5])


@query("permutation_importance")
def permutation_importance(spark, d):
    rows = folded(spark, d)
    model = models.train(rows.where("fold <> 0"), B, "cls", numTrees=5)
    return models.permutation_importance(model, rows.where("fold = 0"), B, "cls", "id", 10).select("band", "repeat", "importance")


@query("feature_importance")
def feature_importance(spark, d):
    return models.importances(spark, models.train(labelled(spark, d), B, "cls", numTrees=10), B)


_ETA = " union all ".join(f"select {k} as k, (select sum(n * power(m - (select avg(b{k}) from spec), 2)) from (select count(*) as n, avg(b{k}) as m from spec group by cls)) / (select var_pop(b{k}) * count(*) from spec) as eta from (select 1)" for k in range(1, 11))


@query("sort_importance", sql(f"select k, {r('eta')} as importance, rank() over (order by eta desc) as place from ({_ETA})", "spec"))
def sort_importance(spark, d):
    """Bands by how much of their variance lies between classes."""
    from pyspark.sql import Window

    pixels, bands = spec(spark, d), range(1, 11)
    means = pixels.groupBy("cls").agg(F.count("*").alias("n"), *(F.avg(f"b{k}").alias(f"m{k}") for k in bands))
    whole = pixels.agg(*(F.avg(f"b{k}").alias(f"a{k}") for k in bands), *((F.var_pop(f"b{k}") * F.count("*")).alias(f"t{k}") for k in bands))
    between = ag.broadcast_row(means, whole).agg(*((F.sum(F.col("n") * (F.col(f"m{k}") - F.col(f"a{k}")) ** 2) / F.first(f"t{k}")).alias(f"e{k}") for k in bands))
    rows = between.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"e{k}").alias("eta")) for k in bands))).alias("x")).select("x.*")
    return rows.select("k", F.round("eta", 6).alias("importance"), F.rank().over(Window.orderBy(F.desc("eta"))).cast("long").alias("place"))  # ten rows


@query("importance_ranking")
def importance_ranking(spark, d):
    """A forest's impurity importances, largest first."""
    from pyspark.sql import Window

    found = models.importances(spark, models.train(labelled(spark, d), B, "cls", numTrees=10), B)
    return found.withColumn("place", F.rank().over(Window.orderBy(F.desc("importance"))).cast("long"))  # a row for each band


@query("model_roundtrip")
def model_roundtrip(spark, d):
    from pyspark.ml import PipelineModel

    path = scratch(spark, "model")
    rows = labelled(spark, d)
    models.train(rows, B, "cls", numTrees=5).write().save(path)
    return models.predict(PipelineModel.load(path), rows).select("row", "col", "pred")


@query("model_by_zone")
def model_by_zone(spark, d):
    rows = labelled(spark, d).withColumn("zone", F.ceil(F.col("b3") * 40).cast("int"))
    zones = [x.zone for x in few(rows, "zone", 20).orderBy("zone").collect()]  # a model for each, so there may be few
    own = lambda z: rows.where(F.col("zone") == z)
    fit = lambda z: models.predict(models.train(own(z), B, "cls", numTrees=5), own(z)).select("zone", "row", "col", "pred")
    return reduce(DataFrame.unionByName, models.at_once(fit, zones))


@query("compare_models", sql(f"select case when fold < 5 then 'a' else 'b' end as model, {r('avg(ok)')} as oa, count(*) as n from (select fold, case when truth = pred then 1.0 else 0.0 end as ok from pred) group by 1", "pred"))
def compare_models(spark, d):
    from .views import pred

    named = pred(spark, d).withColumn("model", F.when(F.col("fold") < 5, "a").otherwise("b"))
    return ag.overall(ag.confusion(named, "truth", "pred", ["model"]), ["model"]).select("model", F.round("oa", 6).alias("oa"), "n")
