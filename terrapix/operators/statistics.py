"""Class separability, sun-glint regression and outlier filters. Class tables have a row for each class and are small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import broadcast_row
from .quantiles import table_quantiles
from .windows import average_ranks


def class_moments(df: DataFrame, band: str, cls: str) -> DataFrame:
    return df.groupBy(F.col(cls).alias("cls")).agg(F.count(band).alias("n"), F.avg(band).alias("m"), F.var_samp(band).alias("v"), F.var_pop(band).alias("vp"))


def pairs(classes: DataFrame, cls: str) -> DataFrame:
    """Every pair of classes once, with both sides' columns suffixed _a and _b; over class statistics, not rows."""
    side = lambda s: classes.select(*(F.col(c).alias(f"{'cls' if c == cls else c}_{s}") for c in classes.columns))
    return side("a").join(F.broadcast(side("b")), F.col("cls_a") < F.col("cls_b"))


def jeffries_matusita(df: DataFrame, band: str, cls: str, textbook: bool = False) -> DataFrame:
    """Distance of each pair of classes, 0 to 2; pairs with a constant class have none.

    textbook: weigh the difference of means twice as much, as the usual formula does.
    """
    p = pairs(class_moments(df, band, cls), "cls").where("vp_a > 0 and vp_b > 0")
    v = F.col("vp_a") + F.col("vp_b")
    b = (0.25 if textbook else 0.125) * (F.col("m_a") - F.col("m_b")) ** 2 / v + 0.5 * F.ln(v / (2 * F.sqrt(F.col("vp_a") * F.col("vp_b"))))
    return p.withColumn("jm", 2 * (1 - F.exp(-b)))


def welch(df: DataFrame, band: str, cls: str) -> DataFrame:
    """t and degrees of freedom for unequal variances, for pairs whose classes have two values at least."""
    p = pairs(class_moments(df, band, cls), "cls").where("n_a > 1 and n_b > 1")
    a, b = F.col("v_a") / F.col("n_a"), F.col("v_b") / F.col("n_b")
    df_ = F.try_divide((a + b) ** 2, a**2 / (F.col("n_a") - 1) + b**2 / (F.col("n_b") - 1))
    return p.withColumns({"t": F.try_divide(F.col("m_a") - F.col("m_b"), F.sqrt(a + b)), "df": df_})


def kruskal_wallis(df: DataFrame, band: str, cls: str) -> DataFrame:
    """H with correction for ties, and its degrees of freedom; H is null for fewer than two classes."""
    ranks = average_ranks(df.select(F.col(band).alias("v"), F.col(cls).alias("g")).where("v is not null"), "v", "g")
    groups = ranks.groupBy("g").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("rs"))
    one = groups.agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("rs") ** 2 / F.col("n")).alias("s"), F.count("*").alias("k"))
    t = F.col("t").cast("double")
    ties = ranks.select("v", "t").distinct().agg(F.sum(t**3 - t).alias("ties"))
    n = F.col("n")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.col("ties") / (n**3 - n))
    return broadcast_row(one, ties).select(F.when(F.col("k") > 1, h).alias("h"), (F.col("k") - 1).alias("df"))


def glint_fit(sample: DataFrame, bands: list[str], nir: str) -> DataFrame:
    """Per visible band: slope, intercept and R2 on the infrared, and the infrared's minimum, in one aggregation."""
    fits = [F.struct(F.lit(b).alias("band"), F.regr_slope(b, nir).alias("slope"), F.regr_intercept(b, nir).alias("intercept"), F.regr_r2(b, nir).alias("r2")) for b in bands]
    return sample.agg(F.array(*fits).alias("fits"), F.min(nir).alias("nir_min")).select(F.explode("fits").alias("x"), "nir_min").select("x.*", "nir_min")


def glint_apply(df: DataFrame, sample: DataFrame, bands: list[str], nir: str, later: list[str]) -> DataFrame:
    """Visible bands less the glint that the infrared shows, negatives null; infrared and later bands less the minimum."""
    fit = sample.agg(*(F.regr_slope(b, nir).alias(f"slope_{b}") for b in bands), F.min(nir).alias("nir_min"))
    glint = F.col(nir) - F.col("nir_min")
    fixed = {b: F.col(b) - F.col(f"slope_{b}") * glint for b in bands}
    out = broadcast_row(df, fit).withColumns({b: F.when(v >= 0, v) for b, v in fixed.items()} | {b: F.col(b) - F.col("nir_min") for b in [nir, *later]})
    return out.drop("nir_min", *(f"slope_{b}" for b in bands))


def iqr_filter(df: DataFrame, band: str, k: float = 1.5, exact: bool = True) -> DataFrame:
    """Rows within k interquartile ranges of the quartiles; exact=False takes sketched quartiles, in one pass."""
    one = table_quantiles(df, band, [0.25, 0.75]) if exact else df.agg(F.percentile_approx(band, [0.25, 0.75], 10000).alias("q"))
    cuts = one.select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    span = k * (F.col("q3") - F.col("q1"))
    return broadcast_row(df, cuts).where(F.col(band).between(F.col("q1") - span, F.col("q3") + span)).drop("q1", "q3")


def zscore_filter(df: DataFrame, bands: list[str], limit: float = 3.0) -> DataFrame:
    """Rows within `limit` population deviations of the mean, band by band, each on what the one before kept.

    Each band's mean and deviation are two numbers that come to the driver, so a fit is one pass with plain filters.
    """

    def step(part: DataFrame, b: str) -> DataFrame:
        m, s = part.agg(F.avg(b), F.stddev_pop(b)).first()
        return part.where(F.try_divide(F.abs(F.col(b) - F.lit(m)), F.lit(s)) < limit)

    return reduce(step, bands, df)
