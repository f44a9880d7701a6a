"""Zonal statistics, class spectra, accuracy measures and other aggregates.

All are single hash aggregations with partial sums before the shuffle, so a hot segment or class costs no more than one
row for each task. Joins against one-row results or class tables are broadcasts of a size that doesn't follow the input.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import group_quantiles


def broadcast_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """df with the columns of a one-row table."""
    return df.join(F.broadcast(row))


def standardise(df: DataFrame, fit_on: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Adds c_z: (c - mean) / population deviation, both of fit_on alone; null where nothing varies."""
    fit = fit_on.agg(*(F.avg(c).alias(f"{c}_m") for c in cols), *(F.stddev_pop(c).alias(f"{c}_s") for c in cols))
    wide = broadcast_row(df, fit)
    return wide.withColumns({f"{c}_z": F.try_divide(F.col(c) - F.col(f"{c}_m"), F.col(f"{c}_s")) for c in cols}).drop(*(f"{c}_{k}" for c in cols for k in "ms"))


def zonal_stats(df: DataFrame, by: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """Per segment and band: min, max, mean, variance (0 for a single pixel), skewness and excess kurtosis (biased)."""
    out = []
    for b in bands:
        out += [F.min(b).alias(f"{b}_min"), F.max(b).alias(f"{b}_max"), F.avg(b).alias(f"{b}_mean"), F.when(F.count(b) > 0, F.coalesce(F.var_samp(b), F.lit(0.0))).alias(f"{b}_var")]
        out += [F.skewness(b).alias(f"{b}_skew"), F.kurtosis(b).alias(f"{b}_kurt")]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *out)


def zonal_means(df: DataFrame, by: Sequence[str], exprs: dict[str, Column]) -> DataFrame:
    """Mean of expressions per segment, as of indices that are worked out per pixel."""
    return df.groupBy(*by).agg(*(F.avg(e).alias(k) for k, e in exprs.items()))


def describe_long(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """mean, std, min, median, max of each column per group, one row for each statistic; keys may be null.

    Medians come from rounds of bucket counts over all groups and columns at once, so no buffer holds a group's values.
    """
    keys = list(by)
    stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.groupBy(*keys).agg(*(f(c).alias(f"{c}|{s}") for c in cols for s, f in stats.items()))
    long = df.select(*keys, *(F.col(c).cast("double").alias(c) for c in cols)).unpivot(keys, list(cols), "_col", "_v")
    medians = group_quantiles(long, [*keys, "_col"], "_v", [0.5]).groupBy(*keys).pivot("_col", list(cols)).agg(F.first(F.col("q")[0]))
    medians = medians.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(c).alias(f"{c}|50%") for c in cols))
    both = wide.join(medians, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), "left")
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("stat"), *(F.col(f"`{c}|{s}`").alias(c) for c in cols)) for s in ("mean", "std", "min", "50%", "max"))))
    return both.select(*keys, rows.alias("x")).select(*keys, "x.*")


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max of columns, one row for each column, in one scan.

    Meant for tables of results, such as accuracies of folds: exact quartiles hold a column's distinct values. Of large
    tables take quantiles.group_quantiles.
    """
    long = df.select(*(F.col(c).cast("double").alias(c) for c in cols)).unpivot([], list(cols), "metric", "v")
    q = lambda p: F.percentile("v", F.lit(p))
    return long.groupBy("metric").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max("v").alias("max"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts and shares in % of values."""
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    return broadcast_row(counts, counts.agg(F.sum("n").alias("total"))).select(col, "n", (F.col("n") * 100 / F.col("total")).alias("share"))


def class_means(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*(F.avg(c).alias(c) for c in cols))


def depth_zone(depth: Column) -> Column:
    """Zone n holds depths in (n, n + 1]."""
    return (F.ceil(depth) - 1).cast("int")


def histogram(df: DataFrame, col: str) -> DataFrame:
    """Unit-wide bins from 0 to the maximum, empty ones too; the last is closed on the right."""
    top = df.agg(F.max(col).alias("top"))
    last = F.greatest(F.ceil("top").cast("int") - 1, F.lit(0))
    bins = broadcast_row(df.select(col), top).select(F.least(F.floor(col).cast("int"), last).alias("bin")).where("bin >= 0").groupBy("bin").agg(F.count("*").alias("n"))
    return top.select(F.explode(F.sequence(F.lit(0), last)).alias("bin")).join(bins, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def confusion(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of (truth, prediction), long."""
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion_margins(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """The same with totals of rows, of columns and of all, which are named 'All'."""
    cube = df.select(F.col(truth).alias("truth"), F.col(pred).alias("pred")).cube("truth", "pred").agg(F.count("*").alias("n"), F.grouping("truth").alias("gt"), F.grouping("pred").alias("gp"))
    name = lambda c, g: F.when(F.col(g) == 1, "All").otherwise(F.col(c)).alias(c)
    return cube.select(name("truth", "gt"), name("pred", "gp"), "n")


def class_totals(cm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class: true positives, support and predictions of a confusion table."""
    t = cm.groupBy(*by, F.col("truth").alias("cls")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    p = cm.groupBy(*by, F.col("pred").alias("cls")).agg(F.sum("n").alias("predicted"))
    both = t.join(p, [*by, "cls"], "full")
    return both.select(*by, "cls", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "support", "predicted")))


def class_report(totals: DataFrame) -> DataFrame:
    """Precision, recall, F1 and IoU per class; null where there is nothing to divide by."""
    precision, recall = F.try_divide("tp", "predicted"), F.try_divide("tp", "support")
    f1 = F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted"))
    iou = F.try_divide(F.col("tp"), F.col("support") + F.col("predicted") - F.col("tp"))
    return totals.withColumns({"precision": precision, "recall": recall, "f1": f1, "iou": iou})


def overall(cm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Overall accuracy and Cohen's kappa, per group of `by`."""
    totals = class_totals(cm, by).groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("support").alias("n"), F.sum(F.col("support").cast("double") * F.col("predicted")).alias("chance"))
    po, pe = F.try_divide("tp", "n"), F.try_divide(F.col("chance"), F.col("n").cast("double") * F.col("n"))
    return totals.select(*by, "n", po.alias("oa"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def regression_scores(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """R2, RMSE, mean residual and Pearson's r."""
    sse = F.sum((F.col(y) - F.col(p)) ** 2)
    sst = F.var_pop(y) * F.count(y)
    return df.groupBy(*by).agg((1 - F.try_divide(sse, sst)).alias("r2"), F.sqrt(F.avg((F.col(y) - F.col(p)) ** 2)).alias("rmse"), F.avg(F.col(y) - F.col(p)).alias("residual"), F.corr(y, p).alias("r"))


def linear_fit(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept and R2 of y on x."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def balanced_weights(df: DataFrame, cls: str) -> DataFrame:
    """Adds weight: n / (classes * n of the class)."""
    counts = df.groupBy(cls).agg(F.count("*").alias("n_c"))
    one = counts.agg(F.sum("n_c").alias("n_all"), F.count("*").alias("k"))
    weights = broadcast_row(counts, one).select(cls, (F.col("n_all") / (F.col("k") * F.col("n_c"))).alias("weight"))
    return df.join(F.broadcast(weights), cls)  # a row for each class


def row_sum(columns: Sequence[str], parts: Sequence[str]) -> Column:
    """Sum over columns whose name contains any of the parts; nulls count as 0."""
    hit = [c for c in columns if any(p in c for p in parts)]
    return reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0.0)) for c in hit), F.lit(0.0))


def covariances(df: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Sample covariance and correlation of every pair of bands, as rows (a, b)."""
    pairs = [*combinations(bands, 2), *((b, b) for b in bands)]
    wide = df.agg(*(F.covar_samp(a, b).alias(f"v_{a}_{b}") for a, b in pairs), *(F.corr(a, b).alias(f"r_{a}_{b}") for a, b in pairs))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"v_{a}_{b}").alias("cov"), F.col(f"r_{a}_{b}").alias("corr")) for a, b in pairs))
    return wide.select(F.explode(rows).alias("x")).select("x.*")
