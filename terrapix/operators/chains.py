"""Whole jobs, each from given tables to its end: segments with labels and statistics, gaps, change from polygons, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import mask
from ..functions.rules import change_code
from ..sources.shared import stored
from . import aggregates as ag
from . import folds as fo
from . import grid, models
from . import polygons as po
from .places import with_shape
from .regions import merge_regions
from .windows import dedupe_majority, label_codes


def refine_regions(df: DataFrame, seg: DataFrame, points: DataFrame, bands: list[str], scale: float, **how) -> DataFrame:
    """Segments that hold several points, merged anew at half the scale; the others stay.

    points: (row, col) of each. New segments are named by their first pixels, as the others are, so names stay unique.
    """
    crowded = points.join(seg, ["row", "col"]).groupBy("segment_id").agg(F.count("*").alias("n")).where("n > 1 and segment_id <> 0")
    again = stored(df.join(seg, ["row", "col"]).join(crowded.select("segment_id"), "segment_id", "left_semi"), "crowded")
    if again.isEmpty():
        return seg
    finer = merge_regions(again, bands, scale / 2, within="segment_id", **how).withColumnRenamed("segment_id", "finer")
    return stored(seg.join(finer, ["row", "col"], "left").select("row", "col", F.coalesce("finer", "segment_id").alias("segment_id")), "segments")


def segment_points(pixels: DataFrame, points: DataFrame, bands: list[str], cls: str, cover: str, unique: str, tile: int, scale: float, land: Column | None = None, pcs: int = 2, **how) -> tuple[DataFrame, DataFrame]:
    """Pixels with segments, and one labelled point for each segment that holds any.

    pixels: row, col, bands. Missing values and land (where `land` holds) become null; principal components pc1 ... are
    those of all complete pixels, of which there has to be one; segments grow within tiles of `tile` cells and are
    refined where they hold several points. points: x and y in cells, cls, cover and unique; of several in a segment the
    one of the commonest class stays, then of the highest cover, then of the least id. Points outside the raster or on
    missing pixels are left out.
    """
    clean = pixels.select("row", "col", *(mask(F.col(b)).alias(b) for b in bands))
    if land is not None:
        dry = F.coalesce(land, F.lit(False))
        clean = clean.withColumn("_dry", dry).select("row", "col", *(F.when(~F.col("_dry"), F.col(b)).alias(b) for b in bands))
    clean = stored(grid.assign_tiles(clean, tile).withColumn("tile", F.concat_ws("_", "tile_i", "tile_j")).drop("tile_i", "tile_j"), "clean")
    scores, _ = models.pca(clean.dropna(subset=bands), bands, pcs)
    scores = scores.select("row", "col", *(F.col("pc")[k].alias(f"pc{k + 1}") for k in range(pcs)))
    seg = stored(merge_regions(clean, bands, scale, within="tile", **how), "segments")
    placed = points.withColumns({"col": F.floor("x").cast("long"), "row": F.floor("y").cast("long")})
    seg = refine_regions(clean, seg, placed.select("row", "col"), bands, scale, **how)
    full = stored(clean.join(seg, ["row", "col"]).join(scores, ["row", "col"], "left"), "pixels")
    inside = placed.join(seg.where("segment_id <> 0"), ["row", "col"]).select("segment_id", *points.columns)
    return full, stored(dedupe_majority(inside, "segment_id", cls, cover, unique), "labels")


def training_table(pixels: DataFrame, points: DataFrame, bands: list[str], cls: str, cover: str, unique: str, tile: int, scale: float, **how) -> DataFrame:
    """Every complete pixel of a labelled segment: row, col, bands, components, segment_id, the label's id and class."""
    full, labels = segment_points(pixels, points, bands, cls, cover, unique, tile, scale, **how)
    return full.dropna(subset=bands).join(labels.select("segment_id", unique, cls), "segment_id").drop("tile")


def statistics_table(pixels: DataFrame, points: DataFrame, bands: list[str], cls: str, cover: str, unique: str, tile: int, scale: float, indices: dict[str, Column], pcs: int = 2, **how) -> DataFrame:
    """One row for each segment: moments of every band, means of components and indices, tile, and the class where it has one."""
    full, labels = segment_points(pixels, points, bands, cls, cover, unique, tile, scale, pcs=pcs, **how)
    valid = full.where("segment_id <> 0")
    stats = ag.zonal_stats(valid, ["segment_id", "tile"], bands)
    means = ag.zonal_means(valid, ["segment_id"], indices | {f"pc{k + 1}": F.col(f"pc{k + 1}") for k in range(pcs)})
    return stats.join(means, "segment_id").join(labels.select("segment_id", unique, cls), "segment_id", "left")


def polygon_gaps(pixels: DataFrame, polygons: DataFrame, points: DataFrame, label: str, unique: str, bands: Sequence[str]) -> DataFrame:
    """Where in feature space the classes of points lie: code, label, cells and mean of each band, zeros left out.

    A polygon takes the label of the last of the points in it; labels are coded in order from 1; polygons are burnt with
    every cell they touch, later ones over earlier ones.
    """
    hits = grid.place_hits(points, polygons, cell=4.0).drop("ring")
    codes = label_codes(points.join(hits.select("x", "y").distinct(), ["x", "y"], "left_semi").select(label).distinct(), label)
    last = [F.max_by(label, unique).alias(label), F.max(unique).alias(unique)]  # of a place, of a ring, of a polygon
    held = hits.join(points.groupBy("x", "y").agg(*last), ["x", "y"]).groupBy("shape").agg(*last)
    named = with_shape(polygons).select("poly_id", "shape").join(held, "shape").groupBy("poly_id").agg(*last).select("poly_id", label).join(codes, label)
    named = polygons.select("poly_id", "ring").join(named, "poly_id")
    burnt = po.rasterise(named, "code", "poly_id", all_touched=True)
    means = pixels.join(burnt, ["row", "col"]).groupBy("code").agg(F.count("*").alias("cells"), *(F.avg(mask(F.col(b))).alias(b) for b in bands))
    return means.join(named.select("code", label).distinct(), "code")


def polygon_change(before: DataFrame, after: DataFrame, polygons: DataFrame, value: str, order: str, bands: list[str], cls: str, path: str, k: int = 3, cell_area: float = 100.0, seed: int = 42, **params) -> tuple[DataFrame, DataFrame]:
    """Accuracy of each fold, and the area of each change code of one class, from polygons burnt as labels.

    A forest is fitted on the labelled pixels of `before`, saved under `path`, read again, and predicts both rasters;
    pixels with a null band have no class and code 0. Areas are in hectares, cell_area in square metres.
    """
    labels = po.rasterise(polygons, value, order).select("row", "col", F.col(value).cast("string").alias("habitat"))
    rows = stored(before.join(labels, ["row", "col"]).dropna(subset=bands).withColumn("id", F.shiftleft(F.col("row").cast("long"), 32) + F.col("col")), "labelled")
    folded = stored(fo.kfold(rows, "id", k, ["habitat"], seed), "folded")
    scores = models.score(models.cross_validate(folded, bands, "habitat", "fold", k, **params), ["fold"])
    models.train(rows, bands, "habitat", **params).write().overwrite().save(path)
    model = PipelineModel.load(path)
    a, b = (models.predict(model, df.select("row", "col", *bands)).select("row", "col", F.col("pred").alias(name)) for df, name in ((before, "was"), (after, "is")))
    both = a.join(b, ["row", "col"], "full")
    codes = both.select(change_code(F.col("was"), F.col("is"), cls).alias("code"))
    return scores, codes.groupBy("code").agg(F.count("*").alias("cells")).withColumn("hectares", F.col("cells") * cell_area / 10000.0)


def fold_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, v): accuracy, kappa, mean and weighted F1, each class's precision, recall and F1, each pair's count.

    df: by, truth, pred. The names are oa, kappa, f1_macro, f1_weighted, precision_x, recall_x, f1_x, n_x_y. A class's
    measure is null where it has nothing to divide by; pairs of classes that a group lacks count 0.
    """
    cm = stored(ag.confusion(df, "truth", "pred", by), "confusion")  # a row for each group and pair of classes
    report = ag.class_report(ag.class_totals(cm, by))
    each = [report.select(*by, F.concat(F.lit(f"{m}_"), "cls").alias("metric"), F.col(m).alias("v")) for m in ("precision", "recall", "f1")]
    known = ag.overall(cm, by).join(report_averages(report, by).where("cls <> 'accuracy'").groupBy(*by).pivot("cls", ["macro avg", "weighted avg"]).agg(F.first("f1")), by)
    known = known.select(*by, "oa", "kappa", F.col("macro avg").alias("f1_macro"), F.col("weighted avg").alias("f1_weighted"))
    pairs = cm.select("truth", "pred").distinct().join(F.broadcast(cm.select(*by).distinct()))
    counts = pairs.join(cm, [*by, "truth", "pred"], "left").select(*by, F.concat_ws("_", F.lit("n"), "truth", "pred").alias("metric"), F.coalesce("n", F.lit(0)).cast("double").alias("v"))
    out = known.unpivot(by, ["oa", "kappa", "f1_macro", "f1_weighted"], "metric", "v")
    for part in (*each, counts):
        out = out.unionByName(part)
    return out


def report_averages(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows accuracy, macro avg and weighted avg of a class report: cls, precision, recall, f1, support; null measures count 0."""
    parts = ("precision", "recall", "f1")
    filled = report.withColumns({p: F.coalesce(p, F.lit(0.0)) for p in parts})
    n, oa = F.sum("support"), F.try_divide(F.sum("tp"), F.sum("support"))
    weigh = lambda p: F.try_divide(F.sum(F.col(p) * F.col("support")), n)
    row = lambda name, f: F.struct(F.lit(name).alias("cls"), *(f(p).alias(p) for p in parts), n.alias("support"))
    rows = F.array(row("accuracy", lambda _: oa), row("macro avg", lambda p: F.avg(p)), row("weighted avg", weigh))
    return filled.groupBy(*by).agg(rows.alias("x")).select(*by, F.explode("x").alias("x")).select(*by, "x.*")


def compare_reports(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, stat, before, after, diff, change): what folds give, described, of two models over the same folds.

    Both: metric and v, a row for each fold. stat is n, mean, std, min, q25, q50, q75 or max; change is in % of before.
    """
    stats = ["n", "mean", "std", "min", "q25", "q50", "q75", "max"]

    def described(df: DataFrame, name: str) -> DataFrame:
        q = lambda p: F.percentile("v", F.lit(p))  # noqa: E731  a value for each fold
        wide = df.groupBy("metric").agg(
            F.count("v").cast("double").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max("v").alias("max"),
        )
        return wide.unpivot(["metric"], stats, "stat", name)

    both = described(before, "before").join(described(after, "after"), ["metric", "stat"], "full")
    diff = F.col("after") - F.col("before")
    return both.withColumns({"diff": diff, "change": F.try_divide(100 * diff, F.col("before"))})
