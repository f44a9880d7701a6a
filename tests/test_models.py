"""Queries that SQL can't express: run on the smallest tables for their rows and a property; fits on planted data."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapix.operators import folds, models, segments
from terrapix.plans.catalog import ORACLE, QUERIES
from terrapix.plans.extras import B, labelled
from terrapix.plans.views import px, pts, segpx, spec

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
PROPERTIES = {}


def prop(f):
    PROPERTIES[f.__name__] = f
    return f


def run(spark, name):
    return QUERIES[name](spark, SF)


def bands(spark, names=B):
    return np.array([tuple(r) for r in spec(spark, SF).select("row", "col", *names).orderBy("row", "col").collect()])


@prop
def pca_transform(spark):
    got = np.array([tuple(r) for r in run(spark, "pca_transform").orderBy("row", "col").collect()])
    x = bands(spark)
    valid = (x[:, 2:] != 0).all(1)
    z = x[:, 2:] - x[valid, 2:].mean(0)
    _, vectors = np.linalg.eigh(np.cov(z[valid].T))
    assert np.allclose(got[:, 2:], np.abs(z @ vectors[:, ::-1][:, :2]), atol=1e-5)


@prop
def cumulative_variance_all(spark):
    x = bands(spark, [f"b{k}" for k in range(1, 11)])[:, 2:]
    values = np.linalg.eigvalsh(np.cov(x[(x != 0).all(1)].T))[::-1]
    got = [r.cumulative for r in run(spark, "cumulative_variance_all").orderBy("k").collect()]
    assert got == pytest.approx((100 * values.cumsum() / values.sum()).tolist(), abs=1e-4)


@prop
def kmeans_clusters(spark):
    got = np.array([tuple(r) for r in run(spark, "kmeans_clusters").orderBy("row", "col").collect()])
    x, c = bands(spark)[:, 2:], got[:, 2]
    inner = sum(((x[c == k] - x[c == k].mean(0)) ** 2).sum() for k in set(c))
    assert len(got) == len(x) and len(set(c)) == 3 and inner < 0.95 * ((x - x.mean(0)) ** 2).sum()


def classes(spark, name, cls="cls"):
    rows = run(spark, name).collect()
    known = {r.cls for r in labelled(spark, SF).select("cls").distinct().collect()}
    assert len(rows) == labelled(spark, SF).count() and {r.pred for r in rows} <= known
    return rows


for _name in ("rf_classify", "svm_classify", "gbt_classify", "mlp_classify", "predict_pixels"):
    PROPERTIES[_name] = lambda spark, name=_name: classes(spark, name)


@prop
def rf_regress(spark):
    rows = run(spark, "rf_regress").collect()
    y, p = (np.array([r[k] for r in rows]) for k in ("y", "pred"))
    assert len(rows) == spec(spark, SF).count() and ((y - p) ** 2).sum() < ((y - y.mean()) ** 2).sum()


@prop
def predict_proba_pixels(spark):
    sums = run(spark, "predict_proba_pixels").groupBy("row", "col").agg(F.sum("proba").alias("s"), F.count("*").alias("n")).collect()
    kinds = labelled(spark, SF).select("cls").distinct().count()
    assert len(sums) == spec(spark, SF).count() and all(r.n == kinds and abs(r.s - 1) < 1e-9 for r in sums)


@prop
def predict_segments(spark):
    rows = run(spark, "predict_segments").collect()
    assert sum(r.pixels for r in rows) == segpx(spark, SF).count() and len({r.segment_id for r in rows}) == len(rows)


@prop
def cross_validate(spark):
    rows = run(spark, "cross_validate").collect()
    assert sorted(r.fold for r in rows) == [0, 1, 2] and sum(r.n for r in rows) == spec(spark, SF).count() and all(0 <= r.oa <= 1 for r in rows)


@prop
def grid_search(spark):
    got = run(spark, "grid_search").collect()
    assert sorted((r.trees, r.depth) for r in got) == [(n, depth) for n in (5, 10, 20) for depth in (3, 5)] and all(0 <= r.accuracy <= 1 for r in got)


@prop
def permutation_importance(spark):
    got = run(spark, "permutation_importance").collect()
    assert sorted((r.band, r.repeat) for r in got) == [(f"b{b}", k) for b in range(1, 5) for k in range(10)] and all(abs(r.importance) <= 1 for r in got)


@prop
def feature_importance(spark):
    rows = run(spark, "feature_importance").collect()
    assert {r.band for r in rows} == set(B) and sum(r.importance for r in rows) == pytest.approx(1)


@prop
def importance_ranking(spark):
    rows = run(spark, "importance_ranking").orderBy("place").collect()
    assert [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True) and rows[0].place == 1


@prop
def model_roundtrip(spark):
    rows = labelled(spark, SF)
    want = models.predict(models.train(rows, B, "cls", numTrees=5), rows).select("row", "col", "pred")
    assert run(spark, "model_roundtrip").exceptAll(want).isEmpty()


@prop
def model_by_zone(spark):
    rows = run(spark, "model_by_zone").collect()
    want = Counter(r.zone for r in labelled(spark, SF).select(F.ceil(F.col("b3") * 40).cast("int").alias("zone")).collect())
    assert Counter(r.zone for r in rows) == want


@prop
def refine_segments(spark):
    rows = {(r.row, r.col): r.segment_id for r in run(spark, "refine_segments").collect()}
    coarse = {(r.row, r.col): r.segment_id for r in segments.segment_regions(spec(spark, SF), ["b1"], 0.04, min_size=2).collect()}
    assert rows.keys() == coarse.keys()
    inside = {}
    for at, s in rows.items():
        inside.setdefault(s, set()).add(coarse[at])
    assert all(len(x) == 1 for x in inside.values())  # segments are only cut, never joined


@prop
def reproject_points(spark):
    rows = run(spark, "reproject_points").collect()
    assert len(rows) == pts(spark, SF).count() and all(3e5 < r.utm_e < 7e5 and 6e6 < r.utm_n < 8e6 for r in rows)


@prop
def random_sample(spark):
    rows, pixels = run(spark, "random_sample").collect(), px(spark, SF).where("b2 > 0")
    known = {(r.row, r.col): r.b1 for r in pixels.collect()}
    assert 0.15 * len(known) < len(rows) < 0.45 * len(known) and all(known[r.row, r.col] == r.b1 for r in rows)


def tail(density, start, end=400.0, n=400_001):
    """The area under a density past a point, by Simpson's rule."""
    x = np.linspace(start, end, n)
    y = density(x)
    return float((x[1] - x[0]) / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()))


@prop
def welch_pvalue(spark):
    from math import exp, lgamma, pi

    values = {}
    for r in px(spark, SF).where("b1 is not null").collect():
        values.setdefault(r.cls, []).append(r.b1)
    rows = run(spark, "welch_pvalue").collect()
    assert len(rows) == len(values) * (len(values) - 1) // 2
    for r in rows:
        a, b = (np.array(values[c]) for c in (r.cls_a, r.cls_b))
        u, v = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
        t, df = abs(a.mean() - b.mean()) / (u + v) ** 0.5, (u + v) ** 2 / (u**2 / (len(a) - 1) + v**2 / (len(b) - 1))
        top = exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / (df * pi) ** 0.5
        assert r.p == pytest.approx(2 * tail(lambda x, k=df, c=top: c * (1 + x * x / k) ** (-(k + 1) / 2), t), abs=1e-6)


@prop
def kruskal_pvalue(spark):
    from math import exp, lgamma

    (h,) = run(spark, "kruskal_wallis").collect()
    (row,) = run(spark, "kruskal_pvalue").collect()
    k = h.df / 2
    assert row.p == pytest.approx(tail(lambda x: x ** (k - 1) * np.exp(-x / 2) / (2**k * exp(lgamma(k))), h.h), abs=1e-4)


@prop
def merge_regions(spark):
    """test_regions.py has the same rounds in plain Python."""
    seg = {(r.row, r.col): r.segment_id for r in run(spark, "merge_regions").collect()}
    assert len(seg) == spec(spark, SF).count() and min(Counter(seg.values()).values()) >= 4
    assert all(s == min((r << 32) + c + 1 for (r, c), t in seg.items() if t == s) for s in set(seg.values()))


@prop
def segment_rings(spark):
    """burn_rings burns them back, against SQL; here rings are whole and have corners alone."""
    rings = {}
    for r in run(spark, "segment_rings").orderBy("ring", "pos").collect():
        rings.setdefault((r.ring, r.hole), []).append((r.x, r.y))
    for (_, hole), p in rings.items():
        area = sum(a * d - c * b for (a, b), (c, d) in zip(p, p[1:] + p[:1], strict=True)) / 2
        assert len(p) >= 4 and (area < 0) == hole and all((a == c) != (b == d) for (a, b), (c, d) in zip(p, p[1:] + p[:1], strict=True))


@prop
def svm_radial(spark):
    rows = run(spark, "svm_radial").collect()
    labels = {r.cls for r in rows}
    assert len(rows) == spec(spark, SF).count() and {r.pred for r in rows} <= labels
    assert all(len(r.proba) == len(labels) and abs(sum(r.proba) - 1) < 1e-4 for r in rows)


@prop
def random_search(spark):
    rows = run(spark, "random_search").collect()
    assert len(rows) == 30 and len({(r.numTrees, r.maxDepth) for r in rows}) == 10 and all(0 <= r.test <= 1 and 0 <= r.train <= 1 for r in rows)
    assert np.mean([r.train for r in rows]) > np.mean([r.test for r in rows])


@prop
def best_settings(spark):
    rows = run(spark, "best_settings").orderBy("place").collect()
    assert [r.place for r in rows] == list(range(1, 11)) and all(a.test >= b.test for a, b in zip(rows, rows[1:], strict=False))


@prop
def segment_training_chain(spark):
    rows = run(spark, "segment_training_chain").collect()
    label = {}
    assert rows and all(label.setdefault(r.segment_id, (r.point_id, r.hab_class)) == (r.point_id, r.hab_class) for r in rows)
    assert all(None not in (r.b1, r.b2, r.b3, r.pc1) for r in rows) and len({(r.row, r.col) for r in rows}) == len(rows)


@prop
def segstats_chain(spark):
    rows = run(spark, "segstats_chain").collect()
    assert len({r.segment_id for r in rows}) == len(rows) and sum(r.n for r in rows) <= spec(spark, SF).count()
    assert any(r.hab_class for r in rows) and all(r.b1_min <= r.b1_mean <= r.b1_max and r.b1_var >= 0 for r in rows)


@prop
def polygon_change_area(spark):
    rows = run(spark, "polygon_change_area").collect()
    assert sum(r.cells for r in rows) == spec(spark, SF).count() and all(abs(r.hectares - r.cells / 100) < 1e-9 for r in rows)


@prop
def polygon_change_scores(spark):
    rows = run(spark, "polygon_change_scores").collect()
    assert sorted(r.fold for r in rows) == [0, 1, 2] and all(0 <= r.oa <= 1 for r in rows)


@needs_tables
@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLE))
def test_without_sql(spark, name):
    PROPERTIES[name](spark)


@pytest.fixture(scope="module")
def planted(spark):
    """Three classes of pixels around different spectra, and a value that follows the first band."""
    rnd = random.Random(1)
    middle = {"sand": (0.6, 0.2, 0.1, 0.5), "grass": (0.2, 0.6, 0.3, 0.5), "deep": (0.1, 0.2, 0.7, 0.5)}
    rows = []
    for k in range(600):
        cls = rnd.choice(list(middle))
        b = [m + rnd.gauss(0, 0.05) for m in middle[cls]]
        rows.append((k, cls, *b, 3 * b[0] + rnd.gauss(0, 0.05)))
    df = spark.createDataFrame(rows, "id long, cls string, b1 double, b2 double, b3 double, b4 double, y double")
    return folds.kfold(df, "id", 3, ["cls"]).cache()


@pytest.mark.parametrize("kind", ["rf", "svm", "gbt", "mlp"])
def test_classifiers_beat_the_commonest_class(planted, kind):
    extra = {"classes": 3} if kind == "mlp" else {}
    model = models.train(planted.where("fold <> 0"), B, "cls", kind, **extra)
    held = models.predict(model, planted.where("fold = 0")).select("cls", "pred").collect()
    most = Counter(r.cls for r in held).most_common(1)[0][1] / len(held)
    assert np.mean([r.cls == r.pred for r in held]) > max(0.9, most)


def test_regression_explains_held_out_values(planted):
    model = models.regress(planted.where("fold <> 0"), B, "y")
    rows = model.transform(planted.where("fold = 0")).select("y", "prediction").collect()
    y, p = (np.array([r[k] for r in rows]) for k in ("y", "prediction"))
    assert 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.8


def test_clusters_are_the_classes(planted):
    rows = models.kmeans(planted, B).select("cls", "cluster").collect()
    best = Counter((r.cls, r.cluster) for r in rows)
    assert sum(max(n for (c, _), n in best.items() if c == cls) for cls in {r.cls for r in rows}) > 0.95 * len(rows)


def test_the_band_without_signal_matters_least(planted):
    model = models.train(planted.where("fold <> 0"), B, "cls", numTrees=10)
    lost = {}
    for r in models.permutation_importance(model, planted.where("fold = 0"), B, "cls", "id", 3).collect():
        lost[r.band] = lost.get(r.band, 0) + r.importance
    assert min(lost, key=lost.get) == "b4" and abs(lost["b4"]) < 0.1
    assert models.importances(planted.sparkSession, model, B).orderBy("importance").first().band == "b4"


def flood(cells, width):
    """Regions of equal bins by plain flood fill: {cell: first cell}."""
    bins = {at: int(v // width) for at, v in cells.items()}
    out = {}
    for at in sorted(bins):
        if at in out:
            continue
        todo = [at]
        out[at] = at
        while todo:
            r, c = todo.pop()
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in bins and n not in out and bins[n] == bins[at]:
                    out[n] = at
                    todo.append(n)
    return out


def test_refinement_against_flood_fill(spark):
    rnd = random.Random(3)
    cells = {(r, c): rnd.choice([0.05, 0.15, 0.25, 0.35]) for r in range(14) for c in range(14)}
    points = [(rnd.randrange(14), rnd.randrange(14)) for _ in range(25)]
    df = spark.createDataFrame([(*at, v) for at, v in cells.items()], "row long, col long, b double")
    seg = segments.segment_regions(df, ["b"], 0.2)
    got = {(r.row, r.col): r.segment_id for r in segments.refine_segments(df, seg, spark.createDataFrame(points, "row long, col long"), ["b"], 0.2).collect()}
    coarse = flood(cells, 0.2)
    crowded = {s for s, n in Counter(coarse[p] for p in points).items() if n > 1}
    want = dict(coarse)
    for s in crowded:
        want.update(flood({at: v for at, v in cells.items() if coarse[at] == s}, 0.1))
    assert got == {at: (r << 32) + c + 1 for at, (r, c) in want.items()} and len(set(want.values())) > len(set(coarse.values()))
