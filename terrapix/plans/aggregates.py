"""Queries of aggregates, accuracy measures and class statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as fn
from ..operators import aggregates as ag
from ..operators.quantiles import table_quantiles
from ..sources.shared import stored
from .registry import query
from .views import change_epochs, cover_wide, dates, pred, proba_stack, pts, px, segpx, spec, sql
from .views import r as _round


def r(x: str, digits: int = 9) -> str:
    return _round(x, digits)


def single(x: str) -> str:
    """In single precision, as rasters are stored; sums in any order give the same."""
    return f"cast(cast({x} as float) as double)"


def rounded(df, *keep, digits=9):
    return df.select(*keep, *(F.round(F.col(c), digits).alias(c) for c in df.columns if c not in keep))


def singles(df, *keep):
    return df.select(*keep, *(F.col(c).cast("float").cast("double").alias(c) for c in df.columns if c not in keep))


def _zonal(b):
    return (
        f"{single(f'min({b})')} as {b}_min, {single(f'max({b})')} as {b}_max, {single(f'avg({b})')} as {b}_mean, "
        f"{single(f'case when count({b}) > 0 then coalesce(var_samp({b}), 0) end')} as {b}_var"
    )


ZONAL = sql(f"select segment_id, count(*) as n, {_zonal('b1')}, {_zonal('b2')}, {_zonal('b3')} from segpx group by segment_id", "segpx")


@query("zonal_stats", ZONAL)
def zonal_stats(spark, d):
    z = ag.zonal_stats(segpx(spark, d), ["segment_id"], ["b1", "b2", "b3"])
    return singles(z.drop(*(c for c in z.columns if c.endswith(("_skew", "_kurt")))), "segment_id", "n")


@query(
    "zonal_shape",
    sql(
        "select segment_id, round(case when v > 0 then m3 / power(v, 1.5) end, 4) + 0.0 as b1_skew, round(case when v > 0 then m4 / (v * v) - 3 end, 4) + 0.0 as b1_kurt from ("
        "select segment_id, avg(power(b1 - m, 2)) as v, avg(power(b1 - m, 3)) as m3, avg(power(b1 - m, 4)) as m4 from (select segment_id, b1, avg(b1) over (partition by segment_id) as m from segpx) group by segment_id)",
        "segpx",
    ),
)
def zonal_shape(spark, d):
    z = ag.zonal_stats(segpx(spark, d), ["segment_id"], ["b1"])
    return z.select("segment_id", F.round("b1_skew", 4).alias("b1_skew"), F.round("b1_kurt", 4).alias("b1_kurt"))


@query("zonal_index_mean", sql(f"select segment_id, {single('avg((b2 - b1) / nullif(b2 + b1, 0))')} as grvi, {single('avg(b1 / nullif(b2, 0))')} as gr, {single('avg(2 * b1 - (b2 + b3))')} as eg from segpx group by segment_id", "segpx"))
def zonal_index_mean(spark, d):
    b1, b2, b3 = F.col("b1"), F.col("b2"), F.col("b3")
    means = ag.zonal_means(segpx(spark, d), ["segment_id"], {"grvi": fn.normalised_difference(b2, b1), "gr": fn.ratio(b1, b2), "eg": fn.excess_green(b2, b1, b3)})
    return singles(means, "segment_id")


SEGSTATS = sql(
    f"select s.*, c.cls from (select segment_id, count(*) as n, {_zonal('b1')}, {_zonal('b2')}, {single('avg((b2 - b1) / nullif(b2 + b1, 0))')} as grvi, {single('avg(b1 / nullif(b2, 0))')} as gr from segpx where b3 is not null group by segment_id) s "
    "left join (select segment_id, cls from (select segment_id, cls, row_number() over (partition by segment_id order by count(*) desc, cls) as rn from segpx group by segment_id, cls) where rn = 1) c using (segment_id)",
    "segpx",
)


@query("segstats_table", SEGSTATS)
def segstats_table(spark, d):
    """Masked pixels to one row of statistics and indices for each segment, with the segment's class."""
    from ..operators.windows import majority

    pixels = segpx(spark, d)
    valid = pixels.where("b3 is not null")
    b1, b2 = F.col("b1"), F.col("b2")
    stats = ag.zonal_stats(valid, ["segment_id"], ["b1", "b2"])
    stats = stats.drop(*(c for c in stats.columns if c.endswith(("_skew", "_kurt"))))
    means = ag.zonal_means(valid, ["segment_id"], {"grvi": fn.normalised_difference(b2, b1), "gr": fn.ratio(b1, b2)})
    labels = majority(pixels, ["segment_id"], "cls").drop("n")
    return singles(stats.join(means, "segment_id"), "segment_id", "n").join(labels, "segment_id", "left")


@query(
    "describe_segment",
    sql(
        f"select tile_id, s.stat, s.b1, s.b2 from (select tile_id, unnest([{', '.join(f'''{{'stat': '{k}', 'b1': {r(e.format('b1'))}, 'b2': {r(e.format('b2'))}}}''' for k, e in {'mean': 'avg({})', 'std': 'stddev_samp({})', 'min': 'min({})', '50%': 'median({})', 'max': 'max({})'}.items())}]) as s from segpx group by tile_id)",
        "segpx",
    ),
)
def describe_segment(spark, d):
    return rounded(ag.describe_long(segpx(spark, d), ["tile_id"], ["b1", "b2"]), "tile_id", "stat")


_QUARTILES = "count(v) as n, round(avg(v), 9) + 0.0 as mean, round(stddev_samp(v), 9) + 0.0 as std, round(min(v), 9) + 0.0 as min, round(quantile_cont(v, 0.25), 9) + 0.0 as q25, round(quantile_cont(v, 0.5), 9) + 0.0 as q50, round(quantile_cont(v, 0.75), 9) + 0.0 as q75, round(max(v), 9) + 0.0 as max"


@query("describe_accuracy", sql(f"select metric, {_QUARTILES} from (select 'oa' as metric, avg(case when truth = pred then 1.0 else 0.0 end) as v from pred group by fold union all select 'n' as metric, count(*)::double as v from pred group by fold) group by metric", "pred"))
def describe_accuracy(spark, d):
    folds = ag.overall(ag.confusion(pred(spark, d), "truth", "pred", ["fold"]), ["fold"])
    return rounded(ag.describe(folds, ["oa", "n"]), "metric", "n")


@query("value_counts", sql("select cls, n, round(n * 100.0 / sum(n) over (), 9) + 0.0 as share from (select cls, count(*) as n from px group by cls)", "px"))
def value_counts(spark, d):
    return rounded(ag.value_counts(px(spark, d), "cls"), "cls", "n")


@query("class_spectra", sql(f"select cls, {', '.join(f'''{r(f'avg(b{k})')} as b{k}''' for k in range(1, 7))} from spec group by cls", "spec"))
def class_spectra(spark, d):
    return rounded(ag.class_means(spec(spark, d), ["cls"], [f"b{k}" for k in range(1, 7)]), "cls")


@query("depth_zone_spectra", sql(f"select cast(ceil(p.depth) as int) - 1 as zone, p.hab_class, count(*) as n, {r('avg(x.b1)')} as b1, {r('avg(x.b2)')} as b2 from pts p join px x on x.row = cast(floor(p.y) as bigint) and x.col = cast(floor(p.x) as bigint) where p.depth > 0 group by all", "pts", "px"))
def depth_zone_spectra(spark, d):
    from ..operators.grid import sample_raster

    sampled = sample_raster(px(spark, d), pts(spark, d).where("depth > 0"), "x", "y")
    zoned = sampled.withColumn("zone", ag.depth_zone(F.col("depth")))
    return rounded(zoned.groupBy("zone", "hab_class").agg(F.count("*").alias("n"), F.avg("b1").alias("b1"), F.avg("b2").alias("b2")), "zone", "hab_class", "n")


@query("cluster_centroids", sql(f"select cls, {r('avg(nullif(b1, 0))')} as c1, {r('avg(nullif(b2, 0))')} as c2 from px group by cls", "px"))
def cluster_centroids(spark, d):
    return rounded(px(spark, d).groupBy("cls").agg(F.avg(fn.mask(F.col("b1"))).alias("c1"), F.avg(fn.mask(F.col("b2"))).alias("c2")), "cls")


@query("month_counts", sql("select cast(year(date) as int) as y, cast(month(date) as int) as m, count(*) as n from dates group by all", "dates"))
def month_counts(spark, d):
    return dates(spark, d).groupBy(F.year("date").alias("y"), F.month("date").alias("m")).agg(F.count("*").alias("n"))


@query("band_histogram", sql("select g.bin, coalesce(h.n, 0) as n from (select cast(unnest(range(0, greatest(cast(ceil(max(b2)) as bigint), 1))) as int) as bin from px) g left join (select least(cast(floor(b2) as int), greatest(cast(ceil((select max(b2) from px)) as int) - 1, 0)) as bin, count(*) as n from px where b2 >= 0 group by 1) h using (bin)", "px"))
def band_histogram(spark, d):
    return ag.histogram(px(spark, d), "b2")


@query("mean_prediction", sql(f"select row, col, class, {r('avg(proba)')} as proba from proba_stack group by all", "proba_stack"))
def mean_prediction(spark, d):
    return rounded(proba_stack(spark, d).groupBy("row", "col", "class").agg(F.avg("proba").alias("proba")), "row", "col", "class")


@query(
    "percentile_area",
    sql(
        f"select t.p, {r('t.t')} as threshold, count(*) filter (where m.proba >= t.t) as cells, round(count(*) filter (where m.proba >= t.t) * 100 / 10000.0, 9) + 0.0 as hectares from (select * from m where class = 'A') m, "
        "(select unnest([75, 80, 85, 90]) as p, unnest(quantile_cont(proba, [0.75, 0.8, 0.85, 0.9])) as t from m) t group by t.p, t.t",
        "proba_stack",
        extra="m as (select row, col, class, avg(proba) as proba from proba_stack group by all)",
    ),
)
def percentile_area(spark, d):
    mean = stored(proba_stack(spark, d).groupBy("row", "col", "class").agg(F.avg("proba").alias("proba")), "mean")
    cuts = table_quantiles(mean, "proba", [0.75, 0.8, 0.85, 0.9], buckets=1 << 14).select(F.posexplode("q").alias("k", "t"))
    cuts = cuts.select((75 + 5 * F.col("k")).alias("p"), "t")
    hit = mean.where("class = 'A'").join(F.broadcast(cuts)).groupBy("p", "t").agg(F.count_if(F.col("proba") >= F.col("t")).alias("cells"))
    return hit.select("p", F.round("t", 9).alias("threshold"), "cells", F.round(F.col("cells") * 100 / 10000.0, 9).alias("hectares"))


@query("confusion_matrix", sql("select case when grouping(truth) = 1 then 'All' else truth end as truth, case when grouping(pred) = 1 then 'All' else pred end as pred, count(*) as n from pred group by cube (truth, pred)", "pred"))
def confusion_matrix(spark, d):
    return ag.confusion_margins(pred(spark, d), "truth", "pred")


_TOTALS = "t as (select coalesce(a.cls, b.cls) as cls, coalesce(tp, 0) as tp, coalesce(support, 0) as support, coalesce(predicted, 0) as predicted from (select truth as cls, count(*) filter (where truth = pred) as tp, count(*) as support from pred group by truth) a full join (select pred as cls, count(*) as predicted from pred group by pred) b on a.cls = b.cls)"


def _report(name, columns, duck):
    @query(name, sql(f"select cls, {duck} from t", "pred", extra=_TOTALS))
    def run(spark, d):
        report = ag.class_report(ag.class_totals(ag.confusion(pred(spark, d), "truth", "pred")))
        return report.select("cls", *columns())


_p, _rc = "tp::double / nullif(predicted, 0)", "tp::double / nullif(support, 0)"
_report("accuracy_metrics", lambda: [F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall")], f"{r(_p)} as precision, {r(_rc)} as recall")
_report(
    "omission_commission",
    lambda: [F.round(100 * (1 - F.col("recall")), 9).alias("omission"), F.round(100 * (1 - F.col("precision")), 9).alias("commission")],
    f"{r(f'100 * (1 - {_rc})')} as omission, {r(f'100 * (1 - {_p})')} as commission",
)


@query(
    "classification_report",
    sql(
        f"with s as (select *, {_p} as p, {_rc} as c, 2.0::double * tp / nullif(support + predicted, 0) as f from t), "
        f"o as (select sum(support)::bigint as n, sum(tp)::double / sum(support) as oa, avg(coalesce(p, 0)) as mp, avg(coalesce(c, 0)) as mc, avg(coalesce(f, 0)) as mf, sum(coalesce(p, 0) * support) / sum(support) as wp, sum(coalesce(c, 0) * support) / sum(support) as wc, sum(coalesce(f, 0) * support) / sum(support) as wf from s) "
        f"select cls, {r('p')} as precision, {r('c')} as recall, {r('f')} as f1, support from s union all select 'accuracy', {r('oa')}, {r('oa')}, {r('oa')}, n from o "
        f"union all select 'macro avg', {r('mp')}, {r('mc')}, {r('mf')}, n from o union all select 'weighted avg', {r('wp')}, {r('wc')}, {r('wf')}, n from o",
        "pred",
        extra=_TOTALS,
    ).replace(" with s as", ", s as"),
)
def classification_report(spark, d):
    """Measures of each class, and their averages."""
    from ..operators.chains import report_averages

    report = ag.class_report(ag.class_totals(ag.confusion(pred(spark, d), "truth", "pred")))
    columns = ["precision", "recall", "f1", "support"]
    return rounded(report.select("cls", *columns).unionByName(report_averages(report).select("cls", *columns)), "cls", "support")


_report("iou", lambda: [F.round(F.try_divide(F.col("tp") + 1, F.col("support") + F.col("predicted") - F.col("tp") + 1), 9).alias("iou")], f"{r('(tp + 1.0) / (support + predicted - tp + 1)')} as iou")


@query("mean_iou", sql(f"select {r('avg(tp::double / nullif(support + predicted - tp, 0))')} as mean_iou from t", "pred", extra=_TOTALS))
def mean_iou(spark, d):
    report = ag.class_report(ag.class_totals(ag.confusion(pred(spark, d), "truth", "pred")))
    return report.agg(F.round(F.avg("iou"), 9).alias("mean_iou"))


@query("cohen_kappa", sql(f"select n, {r('po')} as oa, {r('(po - pe) / nullif(1 - pe, 0)')} as kappa from (select sum(support)::bigint as n, sum(tp)::double / sum(support) as po, sum(support::double * predicted) / (sum(support)::double * sum(support)) as pe from t)", "pred", extra=_TOTALS))
def cohen_kappa(spark, d):
    return rounded(ag.overall(ag.confusion(pred(spark, d), "truth", "pred")), "n")


@query(
    "confusion_percent",
    sql(
        f"select m.truth, m.pred, m.n, round(m.n * 100.0 / sum(m.n) over (partition by m.truth), 9) + 0.0 as row_pct, round(m.n * 100.0 / sum(m.n) over (partition by m.pred), 9) + 0.0 as col_pct, {r(_p)} as precision, {r(_rc)} as recall, {r('2.0::double * tp / nullif(support + predicted, 0)')} as f1 "
        "from (select truth, pred, count(*) as n from pred group by all) m join t on t.cls = m.truth",
        "pred",
        extra=_TOTALS,
    ),
)
def confusion_percent(spark, d):
    """Each pair's share of its row and its column, with the measures of the true class."""
    cm = stored(ag.confusion(pred(spark, d), "truth", "pred"), "confusion")
    rows, cols = cm.groupBy("truth").agg(F.sum("n").alias("rt")), cm.groupBy("pred").agg(F.sum("n").alias("ct"))
    report = ag.class_report(ag.class_totals(cm)).select(F.col("cls").alias("truth"), "precision", "recall", "f1")
    wide = cm.join(F.broadcast(rows), "truth").join(F.broadcast(cols), "pred").join(F.broadcast(report), "truth")
    shares = wide.select("truth", "pred", "n", (F.col("n") * 100 / F.col("rt")).alias("row_pct"), (F.col("n") * 100 / F.col("ct")).alias("col_pct"), "precision", "recall", "f1")
    return rounded(shares, "truth", "pred", "n")


@query("confusion_fold_mean", sql(f"select truth, pred, {r('count(*)::double / (select count(distinct fold) from pred)')} as mean_n from pred group by truth, pred", "pred"))
def confusion_fold_mean(spark, d):
    p = pred(spark, d)
    cm = ag.confusion(p, "truth", "pred", ["fold"])
    folds = cm.select("fold").distinct().agg(F.count("*").alias("k"))
    return ag.broadcast_row(cm.groupBy("truth", "pred").agg(F.sum("n").alias("n")), folds).select("truth", "pred", F.round(F.col("n") / F.col("k"), 9).alias("mean_n"))


@query("regression_scores", sql(f"select cls, {r('1 - sum((b2 - b1) * (b2 - b1)) / nullif(var_pop(b2) * count(b2), 0)', 4)} as r2, {r('sqrt(avg((b2 - b1) * (b2 - b1)))', 4)} as rmse, {r('avg(b2 - b1)', 4)} as residual, {r('corr(b2, b1)', 4)} as r from px group by cls", "px"))
def regression_scores(spark, d):
    return rounded(ag.regression_scores(px(spark, d), "b2", "b1", ["cls"]), "cls", digits=4)


@query("balanced_weights", sql(f"select p.row, p.col, p.cls, {r('(select count(*) from px)::double / ((select count(distinct cls) from px) * c.n)')} as weight from px p join (select cls, count(*) as n from px group by cls) c using (cls)", "px"))
def balanced_weights(spark, d):
    return ag.balanced_weights(px(spark, d), "cls").select("row", "col", "cls", F.round("weight", 9).alias("weight"))


@query("row_sum_matching", sql(f"select obs_id, c1 + c2 + c7 as picked, {r('100 * (c1 + c2 + c7) / nullif(c1 + c2 + c3 + c4 + c5 + c6 + c7, 0)')} as share from cover_wide", "cover_wide"))
def row_sum_matching(spark, d):
    wide = cover_wide(spark, d)
    some, every = ag.row_sum(wide.columns, ["c1", "c2", "c7"]), ag.row_sum([c for c in wide.columns if c != "obs_id"], ["c"])
    return wide.select("obs_id", some.alias("picked"), F.round(F.try_divide(100 * some, every), 9).alias("share"))


@query("segment_min_class", sql("select segment_id, min(cls) as cls, cast(round(avg(case cls when 'A' then 1 when 'N' then 2 else 3 end)) as int) as mean_code from segpx group by segment_id", "segpx"))
def segment_min_class(spark, d):
    code = F.when(F.col("cls") == "A", 1).when(F.col("cls") == "N", 2).otherwise(3)
    return segpx(spark, d).groupBy("segment_id").agg(F.min("cls").alias("cls"), F.round(F.avg(code)).cast("int").alias("mean_code"))


@query("segment_purity", sql("select segment_id, count(distinct cls) as classes from segpx group by segment_id having count(distinct cls) > 1", "segpx"))
def segment_purity(spark, d):
    return segpx(spark, d).groupBy("segment_id").agg(F.count_distinct("cls").alias("classes")).where("classes > 1")


@query("linear_fit", sql(f"select cls, {r('regr_slope(b2, b1)', 4)} as slope, {r('regr_intercept(b2, b1)', 4)} as intercept, {r('regr_r2(b2, b1)', 4)} as r2, regr_count(b2, b1)::bigint as n from px group by cls", "px"))
def linear_fit(spark, d):
    return rounded(ag.linear_fit(px(spark, d), "b2", "b1", ["cls"]), "cls", "n", digits=4)


_PAIRS = [("b1", "b2"), ("b1", "b3"), ("b2", "b3"), ("b1", "b1"), ("b2", "b2"), ("b3", "b3")]


@query("band_covariance", sql(" union all ".join(f"select '{a}' as a, '{b}' as b, round(covar_samp({a}, {b}), 8) + 0.0 as cov, round(corr({a}, {b}), 9) + 0.0 as corr from spec" for a, b in _PAIRS), "spec"))
def band_covariance(spark, d):
    c = ag.covariances(spec(spark, d), ["b1", "b2", "b3"])
    return c.select("a", "b", F.round("cov", 8).alias("cov"), F.round("corr", 9).alias("corr"))


@query("accuracy_delta", sql(f"select truth as cls, {r('b - a')} as diff, {r('100 * (b - a) / nullif(a, 0)')} as change from (select truth, avg(case when fold < 5 then ok end) as a, avg(case when fold >= 5 then ok end) as b from (select truth, fold, case when truth = pred then 1.0 else 0.0 end as ok from pred) group by truth)", "pred"))
def accuracy_delta(spark, d):
    half = lambda c, name: ag.class_report(ag.class_totals(ag.confusion(pred(spark, d).where(c), "truth", "pred"))).select("cls", F.col("recall").alias(name))
    both = half("fold < 5", "a").join(half("fold >= 5", "b"), "cls").where("a is not null")
    diff = F.col("b") - F.col("a")
    return both.select("cls", F.round(diff, 9).alias("diff"), F.round(F.try_divide(100 * diff, F.col("a")), 9).alias("change"))


@query("nan_range", sql(f"select min(b1) as lo, max(b1) as hi, {r('stddev_pop(b1)')} as std from px", "px"))
def nan_range(spark, d):
    b = fn.mask(F.col("b1"), None)
    return px(spark, d).agg(F.min(b).alias("lo"), F.max(b).alias("hi"), F.round(F.stddev_pop(b), 9).alias("std"))


@query("class_area", sql("select epoch, cls, count(*) as cells, round(count(*) * 100 / 10000.0, 9) + 0.0 as hectares from change_epochs group by all", "change_epochs"))
def class_area(spark, d):
    return change_epochs(spark, d).groupBy("epoch", "cls").agg(F.count("*").alias("cells")).withColumn("hectares", F.round(F.col("cells") * 100 / 10000.0, 9))
