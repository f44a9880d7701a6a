"""The radial classifier on rings that no line parts, and the search against fits by hand."""

import math
import random
from pathlib import Path
from statistics import median
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from terrapix.operators import kernels as ke
from terrapix.operators import models
from terrapix.operators.aggregates import balanced_weights
from terrapix.sources.shared import shared_dir

BANDS = ["x", "y"]


def two_rings(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        a, r = rng.uniform(0, 2 * math.pi), (1.0 if k % 2 else 2.5) + rng.uniform(-0.3, 0.3)
        rows.append((k, r * math.cos(a), r * math.sin(a), "in" if k % 2 else "out"))
    return spark.createDataFrame(rows, "id long, x double, y double, cls string")


def test_rings_that_no_line_parts(spark):
    df = two_rings(spark)
    fit, rest = df.where("id % 4 < 2"), df.where("id % 4 >= 2")
    radial = ke.predict_radial(ke.train_radial(fit, BANDS, "cls"), rest)
    flat = models.predict(models.train(fit, BANDS, "cls", "svm"), rest)
    assert ke.balanced_accuracy(radial, "cls", "pred") > 0.97
    assert ke.balanced_accuracy(flat, "cls", "pred") < 0.75
    for r in radial.collect():
        assert sum(r.proba) == pytest.approx(1) and r.pred == ["in", "out"][r.proba.index(max(r.proba))]
    assert ke.train_radial(fit, BANDS, "cls").waves == ke.train_radial(fit, BANDS, "cls").waves


def test_fits_take_few_tasks_and_are_those_by_hand(spark):
    """A table in many parts; an iteration is a job, and takes one task where all features fit into a partition."""
    from pyspark.ml.classification import LinearSVC

    df, tracker = two_rings(spark, 200).repartition(32).cache(), spark.sparkContext.statusTracker()
    assert df.count() == 200
    old = set(tracker.getJobIdsForGroup())
    model = ke.train_radial(df, BANDS, "cls", features=32)
    jobs = [x for x in map(tracker.getJobInfo, set(tracker.getJobIdsForGroup()) - old) if x]
    tasks = [sum(s.numTasks for s in map(tracker.getStageInfo, x.stageIds) if s) for x in jobs]
    assert len(jobs) > 50 and median(tasks) == 1
    assert not [x for name in ("rows", "waves", "margins") for x in Path(urlparse(shared_dir(spark)).path).glob(f"{name}-*")]
    wide = balanced_weights(df.select(*BANDS, "cls"), "cls").withColumn("features", ke.fourier(BANDS, model.centre, model.waves, model.phases))
    for label, svc in zip(model.labels, model.margins, strict=True):
        own = wide.withColumn("label", (F.col("cls") == label).cast("double"))
        hand = LinearSVC(regParam=1e-3, maxIter=50, weightCol="weight", standardization=False).fit(own)
        assert svc.coefficients.toArray() == pytest.approx(hand.coefficients.toArray(), abs=1e-2) and svc.intercept == pytest.approx(hand.intercept, abs=1e-2)


def test_features_near_the_kernel(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    waves, phases = (rng.standard_normal((2000, 2)) * math.sqrt(2 * 0.5)).tolist(), (rng.random(2000) * 2 * math.pi).tolist()
    df = spark.createDataFrame([(0.0, 0.0), (0.5, -0.3), (2.0, 1.0)], "x double, y double")
    z = np.array([r[0].toArray() for r in df.select(ke.fourier(BANDS, [(0.0, 1.0)] * 2, waves, phases)).collect()])
    p = np.array([(0.0, 0.0), (0.5, -0.3), (2.0, 1.0)])
    want = np.exp(-0.5 * ((p[:, None] - p[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - want).max() < 0.08


def test_missing_bands_and_three_classes(spark):
    rows = [(k, float(k % 3), float(k % 3) ** 2, "abc"[k % 3]) for k in range(60)] + [(99, None, 1.0, "a"), (98, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, x double, y double, cls string")
    got = {r.id: r for r in ke.predict_radial(ke.train_radial(df, BANDS, "cls", features=64), df).collect()}
    assert got[99].pred is None and got[99].proba is None and got[99].x is None and got[98].pred == "b"
    assert all(got[k].pred == "abc"[k % 3] and len(got[k].proba) == 3 for k in range(60))


def test_search_equals_fits_by_hand(spark):
    df = two_rings(spark, 240).withColumns({"seg": F.col("id") % 12, "fold": (F.col("id") % 12 % 3).cast("int")}).cache()
    grid = {"numTrees": [2, 4], "maxDepth": [2, 5]}
    found = ke.search(df, BANDS, "cls", "seg", "fold", grid, n=3)
    rows = found.collect()
    assert len(rows) == 9 and {(r.numTrees, r.maxDepth) for r in rows} == {(d["numTrees"], d["maxDepth"]) for d in ke.draws(grid, 3, 42)}
    r = rows[4]
    model = models.train(df.where(F.col("fold") != r.fold), BANDS, "cls", numTrees=r.numTrees, maxDepth=r.maxDepth)
    for part, have in ((df.where(F.col("fold") == r.fold), r.test), (df.where(F.col("fold") != r.fold), r.train)):
        pairs = [(x.cls, x.pred) for x in models.predict(model, part).collect()]
        recalls = [sum(p == c for t, p in pairs if t == c) / sum(t == c for t, _ in pairs) for c in ("in", "out")]
        assert have == pytest.approx(sum(recalls) / 2)
    best = {x.setting: x for x in ke.best_settings(found, list(grid)).collect()}
    assert best[r.setting].test == pytest.approx(sum(x.test for x in rows if x.setting == r.setting) / 3)
    assert sorted(x.place for x in best.values()) == [1, 2, 3] and max(best.values(), key=lambda x: x.test).test == next(x.test for x in best.values() if x.place == 1)


def test_a_group_in_two_folds_is_an_error(spark):
    df = two_rings(spark, 30).withColumns({"seg": F.col("id") % 5, "fold": F.col("id") % 2})
    with pytest.raises(ValueError, match="several folds"):
        ke.search(df, BANDS, "cls", "seg", "fold", {"numTrees": [2]})


def test_balanced_accuracy_counts_classes_alike(spark):
    df = spark.createDataFrame([("a", "a")] * 9 + [("b", "a"), ("b", None), ("b", "b"), ("b", "b"), (None, "a")], "t string, p string")
    assert ke.balanced_accuracy(df, "t", "p") == pytest.approx((1 + 0.5) / 2)


def test_draws_follow_the_seed():
    grid = {"a": [1, 2, 3, 4], "b": [0.1, 0.2, 0.3]}
    some = ke.draws(grid, 10, 7)
    assert len(some) == 10 == len({tuple(x.items()) for x in some}) and some == ke.draws(grid, 10, 7) != ke.draws(grid, 10, 8)
    assert len(ke.draws(grid, None, 1)) == 12 == len(ke.draws(grid, 50, 1))
