"""Queries of whole jobs: training and statistics tables of segments, gaps, change from polygons, model reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import bands as fn
from ..operators import chains
from ..sources.shared import shared_dir, stored
from .grid import INSIDE
from .polygons import _CENTRES, _PASSES, EDGES
from .registry import query
from .views import polys, pred, pts, px, r, spec, sql

BANDS = ["b1", "b2", "b3"]


def _points(spark, d):
    """Field points in cells of spec, whose 25 columns take 100 of the points' units."""
    return pts(spark, d).select("point_id", (F.col("x") / 4).alias("x"), "y", "hab_class", "depth")


@query("segment_training_chain")
def segment_training_chain(spark, d):
    """From a raster and points to labelled pixels: tiles, mask, components, merged and refined segments, majority, complete rows."""
    return chains.training_table(spec(spark, d), _points(spark, d), BANDS, "hab_class", "depth", "point_id", tile=16, scale=0.05, min_size=4)


@query("segstats_chain")
def segstats_chain(spark, d):
    """From a raster and points to a row for each segment: tiles, land mask, segments, moments, components, indices, class."""
    b1, b2, b3 = (F.col(b) for b in BANDS)
    indices = {"gr": fn.ratio(b2, b3), "gb": fn.ratio(b2, b1), "eg": fn.excess_green(b3, b2, b1)}
    land = fn.normalised_difference(b1, b3) < -0.3
    return chains.statistics_table(spec(spark, d), _points(spark, d), BANDS, "hab_class", "depth", "point_id", 16, 0.05, indices, land=land, min_size=4)


_GAP = (
    f"{EDGES}, pair as (select poly_id, point_id, hab_class from pts, polys where {INSIDE.format(x='x', y='y')}), "
    "code as (select hab_class, dense_rank() over (order by hab_class) as code from (select distinct hab_class from pair)), "
    "named as (select poly_id, arg_max(hab_class, point_id) as hab_class from pair group by poly_id), "
    f"burnt as (select row, col, arg_max(code, poly_id) as code from ({_CENTRES} union all select row, col, poly_id, int_class from px, e where {_PASSES}) join named using (poly_id) join code using (hab_class) group by row, col)"
)


@query("gap_polygon_centroids", sql(f"select cast(b.code as int) as code, c.hab_class, count(*) as cells, {r('avg(nullif(b1, 0))')} as b1, {r('avg(nullif(b2, 0))')} as b2 from px join burnt b using (row, col) join code c on c.code = b.code group by b.code, c.hab_class", "px", "pts", "polys", extra=_GAP))
def gap_polygon_centroids(spark, d):
    """Polygons labelled by their points, burnt, and each label's place in feature space."""
    found = chains.polygon_gaps(px(spark, d), polys(spark, d), pts(spark, d), "hab_class", "point_id", ["b1", "b2"])
    return found.select("code", "hab_class", "cells", F.round("b1", 6).alias("b1"), F.round("b2", 6).alias("b2"))


def _change(spark, d):
    """Two epochs of a raster and polygons on its grid; classes are the polygons' labels, in three groups."""
    raster = spec(spark, d)
    before, after = raster.select("row", "col", "b1", "b2", "b3"), raster.select("row", "col", F.col("b4").alias("b1"), F.col("b5").alias("b2"), F.col("b6").alias("b3"))
    ring = F.transform("ring", lambda p: F.struct((p["x"] / 4).alias("x"), (p["y"] * 2).alias("y")))
    areas = polys(spark, d).select("poly_id", (F.col("int_class") % 3 + 1).alias("int_class"), ring.alias("ring"))
    path = f"{shared_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    return chains.polygon_change(before, after, areas, "int_class", "poly_id", BANDS, "2", path, numTrees=10)


@query("polygon_change_area")
def polygon_change_area(spark, d):
    """Area of each change code between two epochs, by a saved forest that learned from burnt polygons."""
    return _change(spark, d)[1].select("code", "cells", F.round("hectares", 6).alias("hectares"))


@query("polygon_change_scores")
def polygon_change_scores(spark, d):
    """Accuracy of the same forest's folds."""
    return _change(spark, d)[0]


# ---- reports ----

#: A second model's predictions for the same rows.
_LATER = "case when l_linenumber <= 6 then l_returnflag when l_linestatus = 'O' then 'N' else 'R' end"
_BOTH = f"p as (select 'before' as model, fold, truth, pred from pred union all select 'after' as model, l_suppkey % 10 as fold, l_returnflag as truth, {_LATER} as pred from lineitem)"
_METRICS = ", ".join(
    [
        _BOTH,
        "cm as (select model, fold, truth, pred, count(*) as n from p group by all)",
        "t as (select coalesce(a.model, b.model) as model, coalesce(a.fold, b.fold) as fold, coalesce(a.cls, b.cls) as cls, coalesce(tp, 0) as tp, coalesce(support, 0) as support, coalesce(predicted, 0) as predicted from "
        "(select model, fold, truth as cls, sum(n) filter (where truth = pred) as tp, sum(n) as support from cm group by all) a full join (select model, fold, pred as cls, sum(n) as predicted from cm group by all) b on a.model = b.model and a.fold = b.fold and a.cls = b.cls)",
        "s as (select *, tp::double / nullif(predicted, 0) as pr, tp::double / nullif(support, 0) as rc, 2.0::double * tp / nullif(support + predicted, 0) as f1 from t)",
        "o as (select model, fold, sum(tp)::double / sum(support) as po, sum(support::double * predicted) / (sum(support)::double * sum(support)) as pe, avg(coalesce(f1, 0)) as fm, sum(coalesce(f1, 0) * support)::double / sum(support) as fw from s group by all)",
        "m as (select model, fold, 'oa' as metric, po as v from o union all select model, fold, 'kappa', (po - pe) / nullif(1 - pe, 0) from o union all select model, fold, 'f1_macro', fm from o union all select model, fold, 'f1_weighted', fw from o "
        "union all select model, fold, 'precision_' || cls, pr from s union all select model, fold, 'recall_' || cls, rc from s union all select model, fold, 'f1_' || cls, f1 from s "
        "union all select f.model, f.fold, 'n_' || q.truth || '_' || q.pred, coalesce(cm.n, 0)::double from (select distinct model, fold from cm) f join (select distinct model, truth, pred from cm) q on f.model = q.model left join cm on cm.model = f.model and cm.fold = f.fold and cm.truth = q.truth and cm.pred = q.pred)",
        "w as (select model, metric, unnest(['n', 'mean', 'std', 'min', 'q25', 'q50', 'q75', 'max']) as stat, unnest([count(v)::double, avg(v), stddev_samp(v), min(v), quantile_cont(v, 0.25), quantile_cont(v, 0.5), quantile_cont(v, 0.75), max(v)]) as v from m group by model, metric)",
        "b as (select * from w where model = 'before')",
        "a as (select * from w where model = 'after')",
    ]
)


@query(
    "model_report",
    sql(f"select coalesce(b.metric, a.metric) as metric, coalesce(b.stat, a.stat) as stat, {r('b.v')} as before, {r('a.v')} as after, {r('a.v - b.v')} as diff, {r('100 * (a.v - b.v) / nullif(b.v, 0)', 4)} as change from b full join a on a.metric = b.metric and a.stat = b.stat", "pred", extra=_METRICS),
)
def model_report(spark, d):
    """Every measure of two models over folds, described and compared."""
    from .views import table

    later = table(spark, d, "lineitem").selectExpr("l_suppkey % 10 as fold", "l_returnflag as truth", f"{_LATER} as pred")
    before, after = (stored(chains.fold_metrics(df, ["fold"]), "metrics") for df in (pred(spark, d), later))
    found = chains.compare_reports(before, after)
    digits = {"before": 6, "after": 6, "diff": 6, "change": 4}
    return found.select("metric", "stat", *(F.round(c, n).alias(c) for c, n in digits.items()))
