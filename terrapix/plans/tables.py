"""Queries of windows, joins, set operators, rules, folds, statistics and radiometry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bands as fn
from ..functions import rules
from ..operators import aggregates as ag
from ..operators import folds as fo
from ..operators import models
from ..operators import spatial as sp
from ..operators import statistics as st
from ..operators import windows as wi
from ..operators.grid import sample_raster
from ..sources.shared import prepare, stored
from .registry import ORACLE, query
from .views import change_epochs, cover_wide, dates, pred, proba_stack, pts, px, r, segpx, spec, sql, table

DG = "md5(concat('42-', cast({} as varchar)))"


# ---- windows, duplicates, ranks ----


@query("flag_duplicates", sql("select point_id, segment_id, count(*) over (partition by segment_id, hab_class) > 1 as is_dup, count(*) over (partition by segment_id, hab_class) as n from pts", "pts"))
def flag_duplicates(spark, d):
    return wi.duplicates(pts(spark, d), ["segment_id", "hab_class"]).select("point_id", "segment_id", "is_dup", "n")


@query(
    "dedupe_majority",
    sql("select point_id, segment_id, hab_class, depth from (select *, row_number() over (partition by segment_id order by n desc, depth desc, point_id) as rn from (select *, count(*) over (partition by segment_id, hab_class) as n from pts)) where rn = 1", "pts"),
)
def dedupe_majority(spark, d):
    return wi.dedupe_majority(pts(spark, d), "segment_id", "hab_class", "depth", "point_id").select("point_id", "segment_id", "hab_class", "depth")


@query(
    "segment_majority",
    sql("select segment_id, hab_class, n from (select *, row_number() over (partition by segment_id order by n desc, hab_class) as rn, count(*) over (partition by segment_id) as kinds from (select segment_id, hab_class, count(*) as n from pts group by all)) where rn = 1 and not (n = 1 and kinds > 1)", "pts"),
)
def segment_majority(spark, d):
    return wi.majority(pts(spark, d), ["segment_id"], "hab_class", ties_lose=True)


@query("drop_duplicates", sql("select min(point_id) as point_id, x, y from pts group by x, y", "pts"))
def drop_duplicates(spark, d):
    return wi.first_rows(pts(spark, d), ["x", "y"], "point_id").select("point_id", "x", "y")


@query("drop_all_duplicates", sql("select segment_id, hab_class, x, min(point_id) as point_id from pts group by all having count(*) = 1", "pts"))
def drop_all_duplicates(spark, d):
    return wi.duplicates(pts(spark, d), ["segment_id", "hab_class", "x"]).where("n = 1").select("segment_id", "hab_class", "x", "point_id")


_C = [f"c{k}" for k in range(1, 8)]


@query(
    "argmax_column",
    sql(
        f"select obs_id, case when len(list_filter([{', '.join(_C)}], lambda v: v = greatest({', '.join(_C)}))) > 1 then 'Mixed' else "
        f"case greatest({', '.join(_C)}) {' '.join(f'''when {c} then '{c}' ''' for c in _C)} end end as top, greatest({', '.join(_C)}) as cover from cover_wide",
        "cover_wide",
    ),
)
def argmax_column(spark, d):
    cols = {c: F.col(c) for c in _C}
    return cover_wide(spark, d).select("obs_id", fn.argmax_name(cols, "Mixed").alias("top"), F.greatest(*_C).alias("cover"))


@query("rowwise_max", sql(f"select obs_id, greatest({', '.join(_C)}) as most from cover_wide", "cover_wide"))
def rowwise_max(spark, d):
    return cover_wide(spark, d).select("obs_id", F.greatest(*_C).alias("most"))


#: The two variances along the principal axes of two bands, in closed form, as shares in %.
_VAR = (
    "m as (select var_samp(b1) as a, var_samp(b2) as c, covar_samp(b1, b2) as b from spec where b1 <> 0 and b2 <> 0), "
    "v as (select unnest([1, 2]) as k, unnest([50 + 100 * h / (a + c), 50 - 100 * h / (a + c)]) as share from (select *, sqrt((a - c) * (a - c) / 4 + b * b) as h from m))"
)


def explained(spark, d, bands):
    """(k, share): the variance that each principal component explains, in %."""
    shares = models.pca(spec(spark, d).select("row", "col", *bands), bands, len(bands))[1]
    return spark.createDataFrame([(k + 1, 100 * x) for k, x in enumerate(shares)], "k int, share double")


def cumulated(spark, d, bands):
    return wi.running_sum(explained(spark, d, bands), "k", "share", "cumulative").select("k", F.round("cumulative", 6).alias("cumulative"))


@query("cumulative_variance", sql(f"select k, {r('sum(share) over (order by k rows unbounded preceding)')} as cumulative from v", "spec", extra=_VAR))
def cumulative_variance(spark, d):
    return cumulated(spark, d, ["b1", "b2"])


@query("pca_elbow", sql("select min(k) as components from v where share < 50 and k > 1", "spec", extra=_VAR))
def pca_elbow(spark, d):
    return wi.elbow(cumulated(spark, d, ["b1", "b2"]), "k", "cumulative", 50.0)


@query("cumulative_variance_all")
def cumulative_variance_all(spark, d):
    """Of all ten bands; eigenvalues are past SQL, so a test works them out."""
    return cumulated(spark, d, [f"b{k}" for k in range(1, 11)])


_DOS = "select min(bin) as threshold from h, (select n as f from (select n, row_number() over (order by bin) as k from h) where k = 2) where bin > 0 and n >= 1.01 * f"
_H = "h as (select cast(floor(b2) as int) as bin, count(*) as n from px where b2 > 0 group by 1)"


@query("dos_threshold", sql(_DOS, "px", extra=_H))
def dos_threshold(spark, d):
    return wi.dark_threshold(px(spark, d), "b2", 1.01)


@query("dos_correct", sql(f"select row, col, case when b2 <> 0 then greatest(b2 - t.threshold, 0) end as b2 from px left join ({_DOS}) t on true", "px", extra=_H))
def dos_correct(spark, d):
    pixels = px(spark, d)
    t = wi.dark_threshold(pixels, "b2", 1.01)
    dark = F.greatest(F.col("b2") - F.col("threshold"), F.when(F.col("threshold").isNotNull(), F.lit(0.0)))
    return ag.broadcast_row(pixels, t).select("row", "col", F.when((F.col("b2") != 0) & F.col("threshold").isNotNull(), dark).when(F.col("b2") != 0, F.lit(0.0)).alias("b2"))


@query("sample_per_class", sql(f"select point_id, hab_class from (select *, row_number() over (partition by hab_class order by {DG.format('point_id')}) as rn from pts) where rn <= 50", "pts"))
def sample_per_class(spark, d):
    return wi.sample_per_class(pts(spark, d), "hab_class", F.col("point_id"), 50).select("point_id", "hab_class")


@query("average_rank", sql("select b2, cls, c, cum - (t - 1) / 2.0 as rank from (select b2, cls, count(*) as c from px group by all) join (select b2, t, sum(t) over (order by b2) as cum from (select b2, count(*) as t from px group by b2)) using (b2)", "px"))
def average_rank(spark, d):
    return wi.average_ranks(px(spark, d), "b2", "cls").select("b2", "cls", "c", "rank")


@query("first_per_segment", sql("select segment_id, min_by(hab_class, point_id) as hab_class from pts group by segment_id", "pts"))
def first_per_segment(spark, d):
    return pts(spark, d).groupBy("segment_id").agg(F.min_by("hab_class", "point_id").alias("hab_class"))


@query("label_encode", sql("select point_id, hab_class, cast(dense_rank() over (order by hab_class) as int) as int_class from pts", "pts"))
def label_encode(spark, d):
    p = pts(spark, d)
    return p.join(wi.label_codes(p, "hab_class"), "hab_class").select("point_id", "hab_class", F.col("code").alias("int_class"))


@query("class_by_label", sql("select cast(code as int) as int_class, label from (select label, row_number() over (order by label) as code from (select distinct hab_class as label from pts)) where label like 'M%'", "pts"))
def class_by_label(spark, d):
    return wi.label_codes(pts(spark, d), "hab_class").where("hab_class like 'M%'").select(F.col("code").alias("int_class"), F.col("hab_class").alias("label"))


# ---- joins and sets ----


@query("join_rasters", sql(f"select s.row, s.col, {r('s.b1 + p.b1')} as total from spec s join px p on s.row = p.row and s.col = p.col", "spec", "px"))
def join_rasters(spark, d):
    other = px(spark, d).select("row", "col", F.col("b1").alias("o1"))
    return spec(spark, d).join(other, ["row", "col"]).select("row", "col", F.round(F.col("b1") + F.col("o1"), 6).alias("total"))


@query("join_segment_class", sql("select s.segment_id, s.n, c.hab_class from (select segment_id, count(*) as n from segpx group by segment_id) s left join (select segment_id, min_by(hab_class, point_id) as hab_class from pts group by segment_id) c using (segment_id)", "segpx", "pts"))
def join_segment_class(spark, d):
    classes = pts(spark, d).groupBy("segment_id").agg(F.min_by("hab_class", "point_id").alias("hab_class"))
    return segpx(spark, d).groupBy("segment_id").agg(F.count("*").alias("n")).join(classes, "segment_id", "left")


@query("paint_segments", sql("select s.segment_id, s.tile_id, s.b1, coalesce(c.k, 0) as painted from segpx s left join (select segment_id, count(*) as k from pts group by segment_id) c using (segment_id)", "segpx", "pts"))
def paint_segments(spark, d):
    classes = pts(spark, d).groupBy("segment_id").agg(F.count("*").alias("k"))
    return segpx(spark, d).join(classes, "segment_id", "left").select("segment_id", "tile_id", "b1", F.coalesce("k", F.lit(0)).alias("painted"))


@query("join_point_attrs", "select c_custkey as point_id, o_orderkey, o_totalprice from customer join orders on o_custkey = c_custkey")
def join_point_attrs(spark, d):
    o = table(spark, d, "orders").selectExpr("o_custkey as point_id", "o_orderkey", "o_totalprice")
    return pts(spark, d).select("point_id").join(o, "point_id")


@query("buffer_join", sql("select a.point_id as lid, b.point_id as rid from pts a join pts b on (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4", "pts"))
def buffer_join(spark, d):
    p = pts(spark, d)
    return sp.buffer_join(p, p, "point_id", "point_id", 2.0)


query("buffer_join_all", ORACLE["buffer_join"])(buffer_join)


@query("semi_by_id", sql("select segment_id, tile_id, b1 from segpx where segment_id in (select segment_id from pts)", "segpx", "pts"))
def semi_by_id(spark, d):
    return segpx(spark, d).join(pts(spark, d), "segment_id", "left_semi").select("segment_id", "tile_id", "b1")


@query("anti_by_id", sql("select segment_id, tile_id, b1 from segpx where segment_id not in (select segment_id from pts)", "segpx", "pts"))
def anti_by_id(spark, d):
    return segpx(spark, d).join(pts(spark, d), "segment_id", "left_anti").select("segment_id", "tile_id", "b1")


@query("segments_with_points", sql("select segment_id, count(*) as n from segpx where segment_id in (select segment_id from pts) group by segment_id", "segpx", "pts"))
def segments_with_points(spark, d):
    return segpx(spark, d).join(pts(spark, d), "segment_id", "left_semi").groupBy("segment_id").agg(F.count("*").alias("n"))


@query("segment_sizes", sql("select count(*) as segments, sum(n)::bigint as pixels, round(avg(n), 6) + 0.0 as mean_size from (select segment_id, count(*) as n from segpx where segment_id <> 0 group by segment_id)", "segpx"))
def segment_sizes(spark, d):
    sizes = segpx(spark, d).where("segment_id <> 0").groupBy("segment_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("segments"), F.sum("n").alias("pixels"), F.round(F.avg("n"), 6).alias("mean_size"))


@query("segment_global_id", sql("select tile_id, segment_id, segment_id + coalesce(sum(m) over (order by tile_id rows between unbounded preceding and 1 preceding), 0)::bigint as global_id from (select distinct tile_id, segment_id from segpx) join (select tile_id, max(segment_id) as m from segpx group by tile_id) using (tile_id)", "segpx").replace("sum(m) over (order by tile_id rows between unbounded preceding and 1 preceding)", "off"). replace("join (select tile_id, max(segment_id) as m from segpx group by tile_id)", "join (select tile_id, sum(max(segment_id)) over (order by tile_id rows between unbounded preceding and 1 preceding) as off from segpx group by tile_id)"))
def segment_global_id(spark, d):
    p = segpx(spark, d).select("tile_id", "segment_id").distinct()
    tops = p.groupBy("tile_id").agg(F.max("segment_id").alias("m"))
    before = wi.running_total(tops, "tile_id", "m", "upto").select("tile_id", (F.col("upto") - F.col("m")).alias("off"))
    return p.join(before, "tile_id").select("tile_id", "segment_id", (F.col("segment_id") + F.col("off")).alias("global_id"))


@query("class_pairs", sql("select a.cls as cls_a, b.cls as cls_b from (select distinct cls from px) a join (select distinct cls from px) b on a.cls < b.cls", "px"))
def class_pairs(spark, d):
    return st.pairs(px(spark, d).groupBy("cls").agg(F.count("*").alias("n")), "cls").select("cls_a", "cls_b")


_ZONE = "cast(floor(x / 5) as bigint) * 10 + cast(floor(y / 5) as bigint)"


@query("zones_in_buffer", sql(f"select a.point_id, count(distinct b.zone) as zones from pts a join (select *, {_ZONE} as zone from pts) b on (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4 group by a.point_id having count(distinct b.zone) = 1", "pts"))
def zones_in_buffer(spark, d):
    """Points all of whose neighbours within the buffer lie in one zone of 5 x 5."""
    p = pts(spark, d)
    places = p.selectExpr("x", "y", f"{_ZONE} as zone").distinct().withColumn("place", F.struct("x", "y", "zone"))
    return sp.buffer_join(p, places, "point_id", "place", 2.0).groupBy(F.col("lid").alias("point_id")).agg(F.count_distinct("rid.zone").alias("zones")).where("zones = 1")


@query("union_tiles", sql("select tile_id, count(*) as n from (select tile_id from segpx where tile_id % 2 = 0 union all select tile_id from segpx where tile_id % 2 = 1) group by tile_id", "segpx"))
def union_tiles(spark, d):
    p = segpx(spark, d)
    both = p.where("tile_id % 2 = 0").unionByName(p.where("tile_id % 2 = 1").drop("b4"), allowMissingColumns=True)
    return both.groupBy("tile_id").agg(F.count("*").alias("n"))


@query("fold_leakage", "select l_suppkey as segment_id from lineitem where l_linenumber <= 2 intersect select l_suppkey as segment_id from lineitem where l_linenumber > 5")
def fold_leakage(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("segment_id"), "l_linenumber")
    return p.where("l_linenumber <= 2").select("segment_id").intersect(p.where("l_linenumber > 5").select("segment_id"))


@query("cluster_gap", sql("select distinct segment_id from segpx except select segment_id from pts", "segpx", "pts"))
def cluster_gap(spark, d):
    return segpx(spark, d).select("segment_id").distinct().join(pts(spark, d), "segment_id", "left_anti")


@query("missing_ids", "select distinct o_custkey as id from orders where o_custkey not in (select c_custkey from customer where c_nationkey < 12)")
def missing_ids(spark, d):
    known = pts(spark, d).where("segment_id < 12").select(F.col("point_id").alias("id"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct().join(known, "id", "left_anti")


query("missing_ids_all", ORACLE["missing_ids"])(missing_ids)


# ---- filters, dates, text ----


@query("filter_range", sql("select obs_id, cls from dates where year(date) between 1994 and 1996 and cls in ('F', 'O')", "dates"))
def filter_range(spark, d):
    return dates(spark, d).where(F.year("date").between(1994, 1996) & F.col("cls").isin("F", "O")).select("obs_id", "cls")


@query("parse_dates", sql("select obs_id, cast(date as date) as day, cast(year(date) as int) as y, cast(month(date) as int) as m from dates", "dates"))
def parse_dates(spark, d):
    text = F.date_format("date", "dd/MM/yyyy")
    day = F.to_date(text, "dd/MM/yyyy")
    return dates(spark, d).select("obs_id", day.alias("day"), F.year(day).alias("y"), F.month(day).alias("m"))


@query("filter_iqr", sql("select l_orderkey, l_linenumber, b2 from (select l_orderkey, l_linenumber, l_extendedprice / 100000 as b2 from lineitem), (select quantile_cont(l_extendedprice / 100000, 0.25) as a, quantile_cont(l_extendedprice / 100000, 0.75) as b from lineitem) where b2 between a - 0.25 * (b - a) and b + 0.25 * (b - a)"))
def filter_iqr(spark, d):
    t = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_extendedprice / 100000 as b2")
    return st.iqr_filter(t, "b2", 0.25).select("l_orderkey", "l_linenumber", "b2")


@query("filter_zscore", sql("select row, col, b1, b2 from z1, (select avg(b2) as m, stddev_pop(b2) as s from z1) where abs(b2 - m) / s < 1.5", "spec", extra="z1 as (select row, col, b1, b2 from spec, (select avg(b1) as m, stddev_pop(b1) as s from spec) where abs(b1 - m) / s < 1.5)"))
def filter_zscore(spark, d):
    return st.zscore_filter(spec(spark, d), ["b1", "b2"], 1.5).select("row", "col", "b1", "b2")


@query("clean_na_strings", "select o_orderkey, case when o_orderpriority like '5%' then null when o_orderpriority like '1%' then 21 else try_cast(substr(o_orderpriority, 1, 1) as int) end as method from orders")
def clean_na_strings(spark, d):
    raw = F.when(F.col("o_orderpriority").startswith("5"), "NA").when(F.col("o_orderpriority").startswith("1"), "Dive").otherwise(F.substring("o_orderpriority", 1, 1))
    clean = rules.clean_na(raw)
    return table(spark, d, "orders").select("o_orderkey", F.when(clean == "Dive", 21).otherwise(clean.try_cast("int")).alias("method"))


@query("parse_depth", sql("select point_id, case when point_id % 2 = 0 then round(depth + 1, 1) else round(depth, 1) end as d from pts", "pts"))
def parse_depth(spark, d):
    comma = lambda c: F.regexp_replace(F.round(c, 1).cast("string"), r"\.", ",")
    text = F.when(F.col("point_id") % 2 == 0, F.concat_ws(" - ", comma(F.col("depth")), comma(F.col("depth") + 1))).otherwise(F.concat(F.lit("-"), comma(F.col("depth"))))
    return pts(spark, d).select("point_id", rules.parse_depth(text).alias("d"))


@query("product_name", "select doc_id, concat('S2_', source, '_', lang, '.tif') as name from documents")
def product_name(spark, d):
    path = F.concat(F.lit("/data/"), "source", F.lit("/"), "lang", F.lit("/x.jp2"))
    part = lambda k: F.substring_index(F.substring_index(path, "/", k), "/", -1)
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("S2_"), part(3), F.lit("_"), part(4), F.lit(".tif")).alias("name"))


# ---- rules ----

_COV = "obs_id, c1, c2, c3, c1 + c2 as cover, (c3 - 20) / 10 as depth"


def _obs(spark, d):
    return cover_wide(spark, d).selectExpr("obs_id", "c1", "c2", "c3", "c1 + c2 as cover", "(c3 - 20) / 10 as depth")


def _rule(name, spark_rule, duck):
    @query(name, sql(f"select obs_id, {duck} as cls from (select {_COV} from cover_wide)", "cover_wide"))
    def run(spark, d):
        return _obs(spark, d).select("obs_id", spark_rule().alias("cls"))


def _bottom():
    return F.when(F.col("c1") > 40, "sand fine").when(F.col("c1") > 20, "soft mud").otherwise("hard")


_bottom_sql = "case when c1 > 40 then 'sand fine' when c1 > 20 then 'soft mud' else 'hard' end"
_rule("habitat_class", lambda: rules.habitat_class(F.col("depth"), F.col("cover"), F.col("c2"), F.col("c1") > 30), "case when depth > 3 and not c1 > 30 then 5 when depth > 5 then 5 when cover >= 30 and c2 < 30 then 1 when cover >= 30 and c2 >= 30 and depth <= 3 then 2 when cover < 30 and c1 > 30 and depth < 5 then 3 when cover < 30 then 4 else 0 end")
_rule("bottom_cover_class", lambda: rules.bottom_cover_class(-F.col("depth"), F.col("c2") / 100, _bottom(), F.col("cover")), f"case when -depth < -2 then 6 when c2 / 100 > 0.3 then 4 when starts_with({_bottom_sql}, 'sand') then 1 when starts_with({_bottom_sql}, 'soft') then 2 when starts_with({_bottom_sql}, 'hard') then 3 when cover > 30 then 5 else 0 end")
_rule("veg_class", lambda: rules.vegetation_class(-F.col("depth"), F.col("c2") / 100, F.col("cover")), "case when -depth < -4.5 then 3 when cover < 30 then 2 when cover >= 30 then 1 when c2 / 100 > 0.3 then 4 end")
_rule("species_class", lambda: rules.species_class(F.col("depth"), _bottom(), F.col("cover"), "sand fine"), f"case when depth >= 6 then 3 when {_bottom_sql} = 'sand fine' and cover >= 30 then 1 when cover >= 30 then 2 when cover < 30 then 0 end")
_rule("presence", lambda: rules.presence(F.col("cover")), "case when cover > 0 then 1 else 0 end")
_rule("turbid_class", lambda: rules.turbid_class(F.col("depth"), (F.col("c1") - F.col("c2")) / 100), "case when (c1 - c2) / 100 >= -0.35 and depth >= 3 then 'turbid' when depth >= 3.5 then 'deep' else 'shallow' end")
_rule("postclass_ndvi", lambda: rules.postclass((F.col("c1") % 9).cast("int"), (F.col("c2") - 40) / 100, F.col("c1") > 0), "case when not c1 > 0 then 0 when (c2 - 40) / 100 >= 0.2 then 8 when (c2 - 40) / 100 >= 0 then 9 when cast(trunc(c1 % 9) as int) > 6 then 0 else cast(trunc(c1 % 9) as int) end")
_rule("remap_class", lambda: rules.remap((F.col("c1") % 7).cast("int"), {5: 6, 2: 1, 0: None}), "case cast(trunc(c1 % 7) as int) when 5 then 6 when 2 then 1 when 0 then null else cast(trunc(c1 % 7) as int) end")


@query("threshold_map", sql("select row, col, class, case when avg(proba) >= 0.5 then 1 else 0 end as hit from proba_stack group by all", "proba_stack"))
def threshold_map(spark, d):
    return proba_stack(spark, d).groupBy("row", "col", "class").agg(F.avg("proba").alias("p")).select("row", "col", "class", rules.over_threshold(F.col("p"), 0.5).alias("hit"))


# ---- statistics ----

_CS = "c as (select cls, count(b1) as n, avg(b1) as m, var_samp(b1) as v, var_pop(b1) as vp from px group by cls)"
_BD = "0.125 * (a.m - b.m) * (a.m - b.m) / (a.vp + b.vp) + 0.5 * ln((a.vp + b.vp) / (2 * sqrt(a.vp * b.vp)))"


@query("jeffries_matusita", sql(f"select a.cls as cls_a, b.cls as cls_b, {r(f'2 * (1 - exp(-({_BD})))')} as jm from c a join c b on a.cls < b.cls where a.vp > 0 and b.vp > 0", "px", extra=_CS))
def jeffries_matusita(spark, d):
    return st.jeffries_matusita(px(spark, d), "b1", "cls").select("cls_a", "cls_b", F.round("jm", 6).alias("jm"))


@query("welch_ttest", sql(f"select a.cls as cls_a, b.cls as cls_b, {r('(a.m - b.m) / sqrt(a.v / a.n + b.v / b.n)')} as t, {r('power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1))', 4)} as df from c a join c b on a.cls < b.cls where a.n > 1 and b.n > 1", "px", extra=_CS))
def welch_ttest(spark, d):
    return st.welch(px(spark, d), "b1", "cls").select("cls_a", "cls_b", F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))


_KW = (
    "rk as (select b2, t, cum - (t - 1) / 2.0 as rank from (select b2, t, sum(t) over (order by b2) as cum from (select b2, count(*) as t from px group by b2))), "
    "g as (select cls, sum(c) as n, sum(c * rank) as rs from (select b2, cls, count(*) as c from px group by all) join rk using (b2) group by cls), "
    "tot as (select sum(n)::double as n, sum(rs * rs / n) as s from g), tie as (select sum(power(t::double, 3) - t) as ties from rk)"
)


@query("kruskal_wallis", sql(f"select {r('(12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (power(n, 3) - n))', 4)} as h, (select count(*) from g) - 1 as df from tot, tie", "px", extra=_KW))
def kruskal_wallis(spark, d):
    return st.kruskal_wallis(px(spark, d), "b2", "cls").select(F.round("h", 4).alias("h"), "df")


_GLINT = " union all ".join(f"select 'b{k}' as band, regr_slope(b{k}, b8) as slope, regr_intercept(b{k}, b8) as intercept, regr_r2(b{k}, b8) as r2, (select min(b8) from spec where b8 < 0.06) as nir_min from spec where b8 < 0.06" for k in (1, 2, 3))


@query("deglint_fit", sql(f"select band, {r('slope')} as slope, {r('intercept')} as intercept, {r('r2')} as r2, {r('nir_min')} as nir_min from ({_GLINT})", "spec"))
def deglint_fit(spark, d):
    fit = st.glint_fit(spec(spark, d).where("b8 < 0.06"), ["b1", "b2", "b3"], "b8")
    return fit.select("band", *(F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2", "nir_min")))


@query("deglint_apply", sql(f"select row, col, {', '.join(f'''{r(f'case when b{k} - s{k} * (b8 - m) >= 0 then b{k} - s{k} * (b8 - m) end')} as b{k}''' for k in (1, 2, 3))}, {r('b8 - m')} as b8 from spec, (select {', '.join(f'regr_slope(b{k}, b8) as s{k}' for k in (1, 2, 3))}, min(b8) as m from spec where b8 < 0.06)", "spec"))
def deglint_apply(spark, d):
    pixels = spec(spark, d)
    out = st.glint_apply(pixels, pixels.where("b8 < 0.06"), ["b1", "b2", "b3"], "b8", [])
    return out.select("row", "col", *(F.round(c, 6).alias(c) for c in ("b1", "b2", "b3", "b8")))


_LOGBR = "x as (select p.point_id, p.depth, ln(x.b1 * 1000) / ln(x.b2 * 1000) as lr from pts p join spec x on x.row = cast(floor(p.y) as bigint) and x.col = cast(floor(p.x / 4) as bigint) where x.b1 > 0 and x.b2 > 0 and p.depth between 2 and 18)"


def _log_ratios(spark, d):
    p = sample_raster(spec(spark, d), pts(spark, d).where("depth between 2 and 18"), "x", "y", a=4.0)
    return p.select("point_id", "depth", fn.log_ratio(F.col("b1"), F.col("b2")).alias("lr")).where("lr is not null")


@query("bathymetry_fit", sql(f"select {r('regr_slope(depth, lr)', 4)} as slope, {r('regr_intercept(depth, lr)', 4)} as intercept, {r('regr_r2(depth, lr)', 4)} as r2, count(*) as n from x", "pts", "spec", extra=_LOGBR))
def bathymetry_fit(spark, d):
    f = ag.linear_fit(_log_ratios(spark, d), "depth", "lr")
    return f.select(*(F.round(c, 4).alias(c) for c in ("slope", "intercept", "r2")), "n")


@query("sdb_predict", sql(f"select row, col, {r('case when m * lr + c >= 0 then m * lr + c end', 4)} as depth from (select row, col, ln(b1 * 1000) / ln(b2 * 1000) as lr from spec where b1 > 0 and b2 > 0), (select regr_slope(depth, lr) as m, regr_intercept(depth, lr) as c from x)", "pts", "spec", extra=_LOGBR))
def sdb_predict(spark, d):
    fit = ag.linear_fit(_log_ratios(spark, d), "depth", "lr").select("slope", "intercept")
    pixels = spec(spark, d).select("row", "col", fn.log_ratio(F.col("b1"), F.col("b2")).alias("lr")).where("lr is not null")
    return ag.broadcast_row(pixels, fit).select("row", "col", F.round(fn.clamp_low(F.col("slope") * F.col("lr") + F.col("intercept")), 4).alias("depth"))


_CHAIN = (
    f"{_LOGBR}, q as (select quantile_cont(lr, 0.25) as a, quantile_cont(lr, 0.75) as b from x), "
    "kept as (select x.* from x, q where lr between a - 1.5 * (b - a) and b + 1.5 * (b - a)), "
    "fit as (select regr_slope(depth, lr) as m, regr_intercept(depth, lr) as c from kept), "
    "scored as (select 1 - sum(power(depth - (m * lr + c), 2)) / (var_pop(depth) * count(*)) as r2, sqrt(avg(power(depth - (m * lr + c), 2))) as rmse from kept, fit)"
)


@query("bathymetry", sql(f"select row, col, {r('case when m * lr + c >= 0 then m * lr + c end', 4)} as depth, {r('r2', 4)} as r2, {r('rmse', 4)} as rmse from (select row, col, ln(b1 * 1000) / ln(b2 * 1000) as lr from spec where b1 > 0 and b2 > 0), fit, scored", "pts", "spec", extra=_CHAIN))
def bathymetry(spark, d):
    """Depth of every pixel from the log ratio of two bands: sampled at points in a range of depths, outliers taken out,
    fitted, scored on the points and applied, with the fit's scores beside each pixel."""
    sample = stored(st.iqr_filter(stored(_log_ratios(spark, d), "sample"), "lr", 1.5), "sample")
    fit = ag.linear_fit(sample, "depth", "lr").select("slope", "intercept")
    guess = F.col("slope") * F.col("lr") + F.col("intercept")
    scores = ag.regression_scores(ag.broadcast_row(sample, fit).withColumn("guess", guess), "depth", "guess").select("r2", "rmse")
    pixels = spec(spark, d).select("row", "col", fn.log_ratio(F.col("b1"), F.col("b2")).alias("lr")).where("lr is not null")
    out = ag.broadcast_row(ag.broadcast_row(pixels, fit), scores)
    return out.select("row", "col", F.round(fn.clamp_low(guess), 4).alias("depth"), F.round("r2", 4).alias("r2"), F.round("rmse", 4).alias("rmse"))


@query("band_correlation", sql(f"select cls, {r('corr(b1, b2)')} as r12, {r('corr(b1, b3)')} as r13, {r('corr(b2, b3)')} as r23 from spec group by cls", "spec"))
def band_correlation(spark, d):
    return spec(spark, d).groupBy("cls").agg(*(F.round(F.corr(f"b{a}", f"b{b}"), 6).alias(f"r{a}{b}") for a, b in ((1, 2), (1, 3), (2, 3))))


# ---- folds ----

_POS = f"p as (select *, row_number() over (partition by hab_class order by {DG.format('point_id')}, point_id) - 1 as pos, count(*) over (partition by hab_class) as n from pts)"


@query("split_stratified", sql("select point_id, hab_class, case when pos < floor(n * 0.3) then 'test' else 'train' end as part from p", "pts", extra=_POS))
def split_stratified(spark, d):
    return fo.stratified_split(pts(spark, d), "hab_class", "point_id", 0.3).select("point_id", "hab_class", "part")


@query("split_three_way", sql(f"select s.segment_id, s.tile_id, s.b1, case when g.pos < floor(g.n * 0.2) then 'test' when g.pos < floor(g.n * 0.4) then 'val' else 'train' end as part from segpx s join (select segment_id, row_number() over (order by {DG.format('segment_id')}) - 1 as pos, count(*) over () as n from (select distinct segment_id from segpx)) g using (segment_id)", "segpx"))
def split_three_way(spark, d):
    p = segpx(spark, d)
    g = fo.positions(p.select("segment_id").distinct(), [], "segment_id")
    part = F.when(F.col("pos") < F.floor(F.col("n") * 0.2), "test").when(F.col("pos") < F.floor(F.col("n") * 0.4), "val").otherwise("train")
    return p.join(g.select("segment_id", part.alias("part")), "segment_id").select("segment_id", "tile_id", "b1", "part")


@query("kfold", sql(f"select point_id, cast((row_number() over (order by {DG.format('point_id')}) - 1) % 5 as int) as fold from pts", "pts"))
def kfold(spark, d):
    return fo.kfold(pts(spark, d), "point_id", 5).select("point_id", "fold")


@query("stratified_kfold", sql("select point_id, hab_class, cast(pos % 3 as int) as fold from p", "pts", extra=_POS))
def stratified_kfold(spark, d):
    return fo.kfold(pts(spark, d), "point_id", 3, ["hab_class"]).select("point_id", "hab_class", "fold")


_START = "cast(concat('0x', substr(md5(concat('42-', hab_class)), 1, 6)) as bigint)"
_SEG = (
    "mj as (select segment_id, hab_class from (select segment_id, hab_class, row_number() over (partition by segment_id order by count(*) desc, hab_class) as rn from pts group by segment_id, hab_class) where rn = 1), "
    f"pl as (select segment_id, hab_class, row_number() over (partition by hab_class order by rows desc, {DG.format('segment_id')}) - 1 as place from mj join (select segment_id, count(*) as rows from pts group by segment_id) using (segment_id)), "
    f"g as (select segment_id, cast((case when place // 5 % 2 = 0 then place % 5 else 4 - place % 5 end + {_START}) % 5 as int) as fold from pl)"
)


def group_folds(spark, d, k=5):
    p = pts(spark, d)
    return p.drop("hab_class").join(fo.balanced_group_folds(p, "segment_id", "hab_class", k), "segment_id")


@query("stratified_group_kfold", sql("select point_id, segment_id, fold from pts join g using (segment_id)", "pts", extra=_SEG))
def stratified_group_kfold(spark, d):
    return group_folds(spark, d).select("point_id", "segment_id", "fold")


@query("loo_folds", sql("select point_id, fold, case when segment_id = fold then 'test' else 'train' end as role from pts, (select distinct segment_id as fold from pts)", "pts"))
def loo_folds(spark, d):
    return sp.leave_one_out(pts(spark, d), "segment_id", "point_id")


_FOLDED = "f as (select point_id, x, y, fold from pts join g using (segment_id))"
_BUFFERED = "select point_id, fold, 'test' as role from f union all select a.point_id, k.fold, 'train' as role from f a, (select distinct fold from f) k where not exists (select 1 from f b where b.fold = k.fold and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1)"


@query("spatial_buffer_folds", sql(_BUFFERED, "pts", extra=f"{_SEG}, {_FOLDED}"))
def spatial_buffer_folds(spark, d):
    return sp.buffered_folds(stored(group_folds(spark, d).select("point_id", "x", "y", "fold"), "folds"), "fold", "point_id", 1.0)


@query("outside_buffer", sql("select a.point_id, k.fold from pts a, (select distinct cast(floor(x / 20) as int) as fold from pts) k where not exists (select 1 from pts b where cast(floor(b.x / 20) as int) = k.fold and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4)", "pts"))
def outside_buffer(spark, d):
    """For each block of the area, the points outside the buffers of all points in it."""
    f = pts(spark, d).select("point_id", "x", "y", F.floor(F.col("x") / 20).cast("int").alias("fold"))
    return sp.buffered_folds(f, "fold", "point_id", 2.0).where("role = 'train'").select("point_id", "fold")


@query("outside_buffer_all", sql("select a.point_id, k.fold from pts a, (select distinct fold from f) k where not exists (select 1 from f b where b.fold = k.fold and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4)", "pts", extra=f"{_SEG}, {_FOLDED}"))
def outside_buffer_all(spark, d):
    """For each fold, the points outside the buffers of all its test points."""
    f = stored(group_folds(spark, d).select("point_id", "x", "y", "fold"), "folds")
    out = sp.buffered_folds(f, "fold", "point_id", 2.0).where("role = 'train'")
    return out.select("point_id", "fold")


@query("test_fold_column", sql("select point_id, min(fold) as test_fold from f group by point_id", "pts", extra=f"{_SEG}, {_FOLDED}"))
def test_fold_column(spark, d):
    return group_folds(spark, d).groupBy("point_id").agg(F.min("fold").alias("test_fold"))


@query("segment_disjoint_folds", sql("select point_id, k.fold from pts a, (select unnest(range(0, 30))::int as fold) k where not exists (select 1 from p b where b.segment_id = a.segment_id and b.pos % 30 = k.fold)", "pts", extra=_POS))
def segment_disjoint_folds(spark, d):
    p = fo.positions(pts(spark, d), ["hab_class"], "point_id")
    test = p.select("segment_id", (F.col("pos") % 30).cast("int").alias("fold")).distinct()
    every = p.select("point_id", "segment_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("fold"))
    return every.join(test, ["segment_id", "fold"], "left_anti").select("point_id", "fold")


query("segment_disjoint_folds_all", ORACLE["segment_disjoint_folds"])(segment_disjoint_folds)


@query("repeated_kfold", sql(" union all ".join(f"select point_id, {s} as repeat, cast((row_number() over (partition by hab_class order by md5(concat('{s}-', cast(point_id as varchar)))) - 1) % 5 as int) as fold from pts" for s in (1, 2, 3)), "pts"))
def repeated_kfold(spark, d):
    parts = [fo.kfold(pts(spark, d), "point_id", 5, ["hab_class"], s).select("point_id", F.lit(s).alias("repeat"), "fold") for s in (1, 2, 3)]
    return reduce(DataFrame.unionByName, parts)


@query("random_sample", None)
def random_sample(spark, d):
    return px(spark, d).where("b2 > 0").sample(withReplacement=True, fraction=0.3, seed=42).select("row", "col", "b1")


_CELLS = "y as (select p.cls, s.b1 from px p join spec s on s.row = p.row and s.col = p.col)"
_SEP = _CELLS + ", " + _CS.replace("from px", "from y") + ", " + _KW.replace("b2", "b1").replace("from px", "from y")


@query(
    "class_separability",
    sql(
        f"select a.cls as cls_a, b.cls as cls_b, {r('(a.m - b.m) / sqrt(a.v / a.n + b.v / b.n)')} as t, case when a.vp > 0 and b.vp > 0 then {r(f'2 * (1 - exp(-({_BD})))')} end as jm, "
        f"{r('(12 / (tot.n * (tot.n + 1)) * s - 3 * (tot.n + 1)) / (1 - ties / (power(tot.n, 3) - tot.n))', 4)} as h, (select count(*) from g) - 1 as df from c a join c b on a.cls < b.cls, tot, tie where a.n > 1 and b.n > 1",
        "px", "spec", extra=_SEP,
    ),
)
def class_separability(spark, d):
    """Classes of one raster by the values of another: t and distance of each pair, and the rank test over all."""
    cells = stored(px(spark, d).select("row", "col", "cls").join(spec(spark, d).select("row", "col", "b1"), ["row", "col"]), "cells")
    w = st.welch(cells, "b1", "cls").select("cls_a", "cls_b", F.round("t", 6).alias("t"))
    jm = st.jeffries_matusita(cells, "b1", "cls").select("cls_a", "cls_b", F.round("jm", 6).alias("jm"))
    h = st.kruskal_wallis(cells, "b1", "cls").select(F.round("h", 4).alias("h"), "df")
    return ag.broadcast_row(w.join(jm, ["cls_a", "cls_b"], "left"), h)


@query("habitat_change_area", sql("select code, count(*) as cells, round(count(*) * 100 / 10000.0, 6) + 0.0 as hectares from (select case when a.cls is null or b.cls is null then 0 when a.cls = 'R' and b.cls = 'R' then 1 when a.cls = 'R' then 2 when b.cls = 'R' then 3 else 0 end as code from (select * from change_epochs where epoch = 1) a full join (select * from change_epochs where epoch = 2) b on a.cell = b.cell) group by code", "change_epochs"))
def habitat_change_area(spark, d):
    epochs = change_epochs(spark, d)
    a, b = (epochs.where(F.col("epoch") == k).select("cell", F.col("cls").alias(f"c{k}")) for k in (1, 2))
    codes = a.join(b, "cell", "full").select(rules.change_code(F.col("c1"), F.col("c2"), "R").alias("code"))
    return codes.groupBy("code").agg(F.count("*").alias("cells")).withColumn("hectares", F.round(F.col("cells") * 100 / 10000.0, 6))


@query("fold_accuracy", sql(f"select fold, count(*) as n, {r('avg(case when truth = pred then 1.0 else 0.0 end)')} as oa from pred group by fold", "pred"))
def fold_accuracy(spark, d):
    return ag.overall(ag.confusion(pred(spark, d), "truth", "pred", ["fold"]), ["fold"]).select("fold", "n", F.round("oa", 6).alias("oa"))


@query("welch_pvalue")
def welch_pvalue(spark, d):
    from ..functions.tails import t_two_sided

    prepare(spark)
    return st.welch(px(spark, d), "b1", "cls").select("cls_a", "cls_b", F.round(t_two_sided("t", "df"), 9).alias("p"))


@query("kruskal_pvalue")
def kruskal_pvalue(spark, d):
    from ..functions.tails import chi2_upper

    prepare(spark)
    return st.kruskal_wallis(px(spark, d), "b2", "cls").select(F.round(chi2_upper("h", F.col("df").cast("double")), 9).alias("p"))
