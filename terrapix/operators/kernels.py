"""Radial support vectors by random Fourier features, and hyper-parameter search over folds of groups."""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from math import sqrt

import numpy as np
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import release, stored
from .aggregates import balanced_weights
from .models import at_once, predict, train
from .spatial import few

#: Bytes of features in a partition that fits read: each iteration is a job, so small tables take few tasks.
FIT_BYTES = 1 << 26
#: Machines fitted side by side; each holds the features in blocks of its own, in memory or on disk.
MACHINES = 10


@dataclass
class RadialModel:
    """Standardised bands to cosines to a margin for each class; slope and bias turn a margin into a probability."""

    bands: list[str]
    labels: list[str]
    centre: list[tuple[float, float]]
    waves: list[list[float]]
    phases: list[float]
    margins: list[LinearSVCModel]
    scales: list[tuple[float, float]]


def fourier(bands: Sequence[str], centre: Sequence[tuple[float, float]], waves: Sequence[Sequence[float]], phases: Sequence[float]) -> Column:
    """Random features whose inner product nears exp(-gamma |x - y|^2), as one vector of column expressions."""
    z = [(F.col(b) - m) / s for b, (m, s) in zip(bands, centre, strict=True)]
    table = F.lit([[*wave, phase] for wave, phase in zip(waves, phases, strict=True)])  # one constant, however many waves
    waved = F.transform(table, lambda w: F.cos(sum((w[k] * x for k, x in enumerate(z)), w[len(z)])) * sqrt(2 / len(waves)))
    return array_to_vector(waved)


def train_radial(df: DataFrame, bands: list[str], cls: str, gamma: float | None = None, features: int = 128, reg: float = 1e-3, seed: int = 42, most: int = 50) -> RadialModel:
    """A linear support vector machine for each class against the others, over random Fourier features.

    gamma: of the standardised bands, 1 / number of bands by default. A logistic curve over each machine's margins gives
    its probability. Classes are weighed so that all count alike; more than `most` of them are an error. Waves and phases
    follow from the seed alone. Rows with nulls are left out. Rows, features and margins are stored once for all fits, as
    each iteration is a job.
    """
    rows = stored(balanced_weights(df.dropna(subset=[*bands, cls]).select(*bands, cls), cls), "rows")
    labels = [x[cls] for x in few(rows, cls, most).orderBy(cls).collect()]
    fit = rows.agg(F.count("*").alias("n"), *(F.avg(b).alias(f"m{k}") for k, b in enumerate(bands)), *(F.stddev_pop(b).alias(f"s{k}") for k, b in enumerate(bands))).first()
    centre = [(fit[f"m{k}"] or 0.0, fit[f"s{k}"] or 1.0) for k in range(len(bands))]
    rng = np.random.default_rng(seed)
    waves = (rng.standard_normal((features, len(bands))) * sqrt(2 * (gamma or 1 / len(bands)))).tolist()
    phases = (rng.random(features) * 2 * np.pi).tolist()
    parts = max(1, -(-fit["n"] * features * 8 // FIT_BYTES))
    wide = stored(rows.select("weight", F.col(cls).alias("cls"), fourier(bands, centre, waves, phases).alias("features")), "waves")

    def machine(label) -> LinearSVCModel:
        own = wide.coalesce(parts).withColumn("label", (F.col("cls") == label).cast("double"))
        return LinearSVC(regParam=reg, maxIter=50, weightCol="weight", standardization=False).fit(own)

    margins = at_once(machine, labels, MACHINES)
    out = wide
    for k, svc in enumerate(margins):
        out = svc.copy().setRawPredictionCol(f"_raw{k}").setPredictionCol(f"_pred{k}").transform(out)
    flat = stored(out.select("weight", "cls", *(vector_to_array(f"_raw{k}")[1].alias(f"m{k}") for k in range(len(labels)))), "margins")

    def curve(k: int) -> tuple[float, float]:
        own = flat.coalesce(parts).select("weight", (F.col("cls") == labels[k]).cast("double").alias("label"), array_to_vector(F.array(f"m{k}")).alias("features"))
        found = LogisticRegression(regParam=1e-4, weightCol="weight").fit(own)
        return float(found.coefficients[0]), float(found.intercept)

    scales = at_once(curve, range(len(labels)), MACHINES)
    release(rows, wide, flat)
    return RadialModel(list(bands), labels, centre, waves, phases, margins, scales)


def predict_radial(model: RadialModel, df: DataFrame) -> DataFrame:
    """Adds proba (an array in the order of the model's labels, which sums to 1) and pred; null where a band is."""
    whole = F.lit(True)
    for b in model.bands:
        whole &= F.col(b).isNotNull()
    filled = df.withColumns({f"_{b}": F.col(b) for b in model.bands}).fillna(0.0, model.bands)
    out = filled.withColumn("_features", fourier(model.bands, model.centre, model.waves, model.phases))
    for k, svc in enumerate(model.margins):
        out = svc.copy().setFeaturesCol("_features").setRawPredictionCol(f"_raw{k}").setPredictionCol(f"_pred{k}").transform(out)
    p = [1 / (1 + F.exp(-(vector_to_array(f"_raw{k}")[1] * a + b))) for k, (a, b) in enumerate(model.scales)]
    out = out.withColumns({b: F.col(f"_{b}") for b in model.bands}).withColumn("_p", F.array(*p))
    total = F.aggregate("_p", F.lit(0.0), lambda x, y: x + y)
    out = out.withColumn("proba", F.when(whole, F.transform("_p", lambda x: x / total)))
    pred = F.get(F.array(*(F.lit(x) for x in model.labels)), (F.array_position("proba", F.array_max("proba")) - 1).cast("int"))
    return out.withColumn("pred", pred).drop(*(c for c in out.columns if c.startswith("_")))


def balanced_accuracy(df: DataFrame, truth: str, pred: str) -> float:
    """The mean of the classes' recalls; a null prediction is a miss. None where there are no rows."""
    recalls = df.where(F.col(truth).isNotNull()).groupBy(truth).agg(F.avg(F.coalesce(F.col(truth) == F.col(pred), F.lit(False)).cast("int")).alias("recall"))
    return recalls.agg(F.avg("recall")).first()[0]


def leaking(df: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups that lie in more than one fold."""
    return df.groupBy(group).agg(F.count_distinct(fold).alias("folds")).where("folds > 1")


def draws(grid: dict[str, Sequence], n: int | None, seed: int) -> list[dict]:
    """n settings of a grid drawn without replacement, all of them where n is None or not less than their number; in grid order."""
    every = [dict(zip(grid, x, strict=True)) for x in product(*grid.values())]
    if n is None or n >= len(every):
        return every
    return [every[k] for k in sorted(random.Random(seed).sample(range(len(every)), n))]


def search(df: DataFrame, bands: list[str], cls: str, group: str, fold: str, grid: dict[str, Sequence], n: int | None = 10, kind: str = "rf", seed: int = 42, most: int = 20) -> DataFrame:
    """(setting, fold, each parameter, test, train): balanced accuracy of every drawn setting on every fold and on what it was fitted on.

    Folds are of whole groups: a group in two of them is an error, as are more than `most` folds. Fits and their scores
    run a few at a time; each reads the rows again, so df should be stored.
    """
    if not leaking(df, group, fold).isEmpty():
        raise ValueError(f"{group} has values in several folds")
    folds = [x[fold] for x in few(df, fold, most).orderBy(fold).collect()]
    settings = draws(grid, n, seed)

    def one(case: tuple[int, int]) -> tuple:
        k, f = case
        inside, outside = df.where(F.col(fold) != f), df.where(F.col(fold) == f)
        model = train(inside, bands, cls, kind, **settings[k])
        test, own = (balanced_accuracy(predict(model, part), cls, "pred") for part in (outside, inside))
        return (k, int(f), *settings[k].values(), test, own)

    found = at_once(one, product(range(len(settings)), folds))
    kinds = {int: "long", float: "double", str: "string"}
    schema = ", ".join(["setting long", "fold long", *(f"{p} {kinds[type(v[0])]}" for p, v in grid.items()), "test double", "train double"])
    return df.sparkSession.createDataFrame(found, schema)


def best_settings(found: DataFrame, params: Sequence[str]) -> DataFrame:
    """Mean and spread over folds of each setting of a search, and its place (1 is best; of equals the first setting's)."""
    from pyspark.sql import Window

    each = found.groupBy("setting", *params).agg(F.avg("test").alias("test"), F.stddev_pop("test").alias("spread"), F.avg("train").alias("train"))
    return each.withColumn("place", F.row_number().over(Window.orderBy(F.desc("test"), "setting")))  # a row for each setting
