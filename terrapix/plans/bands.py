"""Queries of per-pixel band algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as fn
from ..operators.aggregates import broadcast_row, standardise
from .registry import query
from .views import px, r, spec, sql



class _Bands:
    """B[k] is the column of band k; columns can't be made before a session is there."""

    def __getitem__(self, k: int):
        return F.col(f"b{k}")


B = _Bands()
WAVE = {"red": 665.0, "green": 560.0, "blue": 492.0}


def _r(c, digits=6):
    return F.round(c, digits)


def _per_pixel(name, expr, duck, out, view=spec, v="spec"):
    def run(spark, d):
        return view(spark, d).select("row", "col", _r(expr()).alias(out))

    run.__name__ = name
    query(name, sql(f"select row, col, {r(duck)} as {out} from {v}", v))(run)


_per_pixel("idx_normdiff", lambda: fn.normalised_difference(B[4], B[3]), "(b4 - b3) / nullif(b4 + b3, 0)", "ndvi")
_per_pixel("idx_vari", lambda: fn.vari(B[2], B[3], B[1]), "(b2 - b3) / nullif(b2 + b3 - b1, 0)", "vari")
_per_pixel("idx_gcc", lambda: fn.green_chromatic(B[3], B[2], B[1]), "b2 / nullif(b3 + b2 + b1, 0)", "gcc")
_per_pixel("idx_eg", lambda: fn.excess_green(B[3], B[2], B[1]), "2 * b2 - (b3 + b1)", "eg")
_per_pixel("idx_tgi", lambda: fn.triangular_greenness(B[3], B[2], B[1], WAVE["red"], WAVE["green"], WAVE["blue"]), "((665.0::double - 492.0::double) * (b3 - b2) - (665.0::double - 560.0::double) * (b3 - b1)) / 2", "tgi")
_per_pixel("band_ratio", lambda: fn.ratio(B[1], B[2]), "b1 / nullif(b2, 0)", "ratio")
_per_pixel("log_band_ratio", lambda: fn.log_ratio(B[1], B[2]), "case when b1 > 0 and b2 > 0 then ln(b1 * 1000) / nullif(ln(b2 * 1000), 0) end", "log_ratio")
_per_pixel("optical_depth", lambda: fn.optical_depth(B[5]), "case when b5 > 0 then -0.251 * ln(b5) + 0.8 end", "odw")
_per_pixel("scale_reflectance", lambda: fn.scale(B[1] * 10000), "b1 * 10000 / 10000", "refl")
_per_pixel("invert_mask", lambda: F.when(F.col("b2") == 0, 1.0).otherwise(0.0), "case when b2 = 0 then 1.0 else 0.0 end", "land", px, "px")


@query("stack_layers", sql(f"select s.row, s.col, s.b1, s.b2, {r('(s.b4 - s.b3) / nullif(s.b4 + s.b3, 0)')} as ndvi, p.b2 as depth from spec s join px p on s.row = p.row and s.col = p.col", "spec", "px"))
def stack_layers(spark, d):
    depth = px(spark, d).select("row", "col", F.col("b2").alias("depth"))
    return spec(spark, d).select("row", "col", "b1", "b2", _r(fn.normalised_difference(B[4], B[3])).alias("ndvi")).join(depth, ["row", "col"])


@query("l2_normalize", sql(f"select row, col, {r('b1 / sqrt(b1*b1 + b2*b2 + b3*b3)')} as n1, {r('b2 / sqrt(b1*b1 + b2*b2 + b3*b3)')} as n2, {r('b3 / sqrt(b1*b1 + b2*b2 + b3*b3)')} as n3 from spec", "spec"))
def l2_normalize(spark, d):
    norm = fn.l2_norm([B[1], B[2], B[3]])
    return spec(spark, d).select("row", "col", *(_r(F.try_divide(B[k], norm)).alias(f"n{k}") for k in (1, 2, 3)))


@query("minmax_byte", sql("select row, col, cast(floor((b1 - lo) / nullif(hi - lo, 0) * 255) as int) as byte from px, (select min(b1) as lo, max(b1) as hi from px)", "px"))
def minmax_byte(spark, d):
    pixels = px(spark, d)
    scaled = broadcast_row(pixels, pixels.agg(F.min("b1").alias("lo"), F.max("b1").alias("hi")))
    return scaled.select("row", "col", F.floor(F.try_divide(F.col("b1") - F.col("lo"), F.col("hi") - F.col("lo")) * 255).cast("int").alias("byte"))


@query("standardize", sql(f"select row, col, {r('(b1 - m1) / nullif(s1, 0)')} as z1, {r('(b2 - m2) / nullif(s2, 0)')} as z2 from spec, (select avg(b1) as m1, stddev_pop(b1) as s1, avg(b2) as m2, stddev_pop(b2) as s2 from spec where row % 3 <> 0)", "spec"))
def standardize(spark, d):
    pixels = spec(spark, d)
    z = standardise(pixels, pixels.where("row % 3 <> 0"), ["b1", "b2"])
    return z.select("row", "col", _r(F.col("b1_z")).alias("z1"), _r(F.col("b2_z")).alias("z2"))


@query("patch_minmax", sql(f"select row, col, {r('(b1 - min(b1) over w) / nullif(max(b1) over w - min(b1) over w, 0)')} as scaled from px window w as (partition by row // 10, col // 10)", "px"))
def patch_minmax(spark, d):
    pixels = px(spark, d).withColumns({"pi": F.expr("row div 10"), "pj": F.expr("col div 10")})
    ends = pixels.groupBy("pi", "pj").agg(F.min("b1").alias("lo"), F.max("b1").alias("hi"))
    return pixels.join(ends, ["pi", "pj"]).select("row", "col", _r(F.try_divide(F.col("b1") - F.col("lo"), F.col("hi") - F.col("lo"))).alias("scaled"))


@query("one_hot", sql("select row, col, case when cls = 'click' then 1 else 0 end as is_click, case when cls = 'view' then 1 else 0 end as is_view from px", "px"))
def one_hot(spark, d):
    return px(spark, d).select("row", "col", *fn.one_hot(F.col("cls"), ["click", "view"]))


@query("cast_round", sql("select row, col, round(b1, 3) + 0.0 as r3, cast(trunc(b1) as bigint) as whole, cast(floor(b1) as int) as low from px", "px"))
def cast_round(spark, d):
    return px(spark, d).select("row", "col", F.round("b1", 3).alias("r3"), F.col("b1").cast("bigint").alias("whole"), F.floor("b1").cast("int").alias("low"))


@query("mask_nodata", sql("select row, col, nullif(b2, 0) as b2, case when b2 <> 0 then b1 end as b1 from px", "px"))
def mask_nodata(spark, d):
    ok = fn.mask(F.col("b2"), 0.0).isNotNull()
    return px(spark, d).select("row", "col", F.when(ok, F.col("b2")).alias("b2"), F.when(ok, F.col("b1")).alias("b1"))


@query("mask_inf", sql("select row, col, b1 / b2 as q from px where b2 <> 0", "px"))
def mask_inf(spark, d):
    q = F.when(F.col("b2") == 0, F.lit(float("inf"))).otherwise(F.try_divide("b1", "b2"))
    return px(spark, d).select("row", "col", fn.mask(q, None).alias("q")).dropna(subset=["q"])


@query("mask_index", sql("select row, col, b1 from spec where (b4 - b3) / nullif(b4 + b3, 0) < 0", "spec"))
def mask_index(spark, d):
    return spec(spark, d).where(fn.normalised_difference(B[4], B[3]) < 0).select("row", "col", "b1")


@query("mask_depth", sql("select s.row, s.col, case when p.b2 is not null and p.b2 >= 20 then s.b1 end as b1 from spec s left join px p on s.row = p.row and s.col = p.col", "spec", "px"))
def mask_depth(spark, d):
    depth = px(spark, d).select("row", "col", F.col("b2").alias("depth"))
    return spec(spark, d).select("row", "col", "b1").join(depth, ["row", "col"], "left").select("row", "col", F.when(F.col("depth") >= 20, F.col("b1")).alias("b1"))


@query("mask_optically_deep", sql("select row, col, b1, b2, b4 from spec where b1 < 0.05 and b4 < 0.055 and b2 < 0.05", "spec"))
def mask_optically_deep(spark, d):
    return spec(spark, d).where("b1 < 0.05D and b4 < 0.055D and b2 < 0.05D").select("row", "col", "b1", "b2", "b4")


@query("clamp_negative", sql("select row, col, greatest(b1 - 50, 0) as low, case when b1 - 50 >= 0 then b1 - 50 end as gone from px", "px"))
def clamp_negative(spark, d):
    v = F.col("b1") - 50
    return px(spark, d).select("row", "col", F.greatest(v, F.lit(0.0)).alias("low"), fn.clamp_low(v).alias("gone"))


@query("drop_na", "select l_orderkey, l_linenumber, l_quantity / 50 as b1, nullif(l_discount, 0) as b3, nullif(l_tax, 0) as b4 from lineitem where l_discount <> 0 and l_tax <> 0")
def drop_na(spark, d):
    from .views import table

    t = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity / 50 as b1", "nullif(l_discount, 0D) as b3", "nullif(l_tax, 0D) as b4")
    return t.dropna(how="any", subset=["b3", "b4"])


@query("select_columns", sql("select row, col, b1, b3 from spec", "spec"))
def select_columns(spark, d):
    pixels = spec(spark, d)
    return pixels.select([c for c in ("row", "col", "b1", "b3", "pca1") if c in pixels.columns])


@query("array_to_columns", "select vec_id, cast(embedding[1] as double) as e1, cast(embedding[2] as double) as e2, cast(embedding[3] as double) as e3 from embeddings")
def array_to_columns(spark, d):
    from .views import table

    return table(spark, d, "embeddings").select("vec_id", *(F.get("embedding", F.lit(k)).cast("double").alias(f"e{k + 1}") for k in range(3)))
