import random
import zlib

import numpy as np

from terrapix.llm.quality import NAMES, Discriminant, fit, keep_good, score_quality, statistics
from terrapix.llm.common import bytes_of

import pyarrow as pa


def fixture(n=600):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(1, 9)))
    docs, labels = [(0, None), (1, ""), (2, "x" * 300_000)], []
    for k in range(3, n):
        w = [word() for _ in range(rnd.randint(20, 200))]
        bad = k % 4 == 0
        if bad:
            w = [x + rnd.choice(["###", "$$$", "%%%"]) for x in w] if k % 8 else [x.upper() + "!!" for x in w[:10]] * 12
        docs.append((k, ". ".join(" ".join(w[i : i + 8]) for i in range(0, len(w), 8))))
        if k % 2 == 0 or k % 3 == 0:
            labels.append((k, int(not bad)))
    return docs, labels


def frames(spark, docs, labels):
    d = spark.createDataFrame([(i, t, 1.0, "q") for i, t in docs], "doc_id long, text string, score double, quality string")
    return d, spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = fixture()
    got = {r.doc_id: r for r in score_quality(*frames(spark, docs, labels)).collect()}
    assert len(got) == len(docs)
    want = dict(labels)
    held = [i for i in want if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.5) for i in got)
    assert np.mean([got[i].predicted == want[i] for i in held]) > 0.97


def test_keeps_columns(spark):
    docs, labels = fixture()
    d, y = frames(spark, docs, labels)
    kept = keep_good(d, y)
    assert kept.columns == d.columns
    good = {r.doc_id for r in score_quality(d, y).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == good


def test_without_labels_or_rows(spark):
    docs, labels = fixture(20)
    assert {r.score for r in score_quality(*frames(spark, docs, [])).collect()} == {0.5}
    assert score_quality(*frames(spark, [], labels)).count() == 0


def test_discriminant_against_plain_formula():
    rnd = np.random.default_rng(5)
    p = len(NAMES)
    xs = {k: rnd.normal(k, 1 + k, (500, p)) for k in (0, 1)}
    model = fit({k: (len(x), x.sum(0), x.T @ x) for k, x in xs.items()})
    assert isinstance(model, Discriminant)
    z = (xs[1][:50] - model.centre) / model.scale
    logs = []
    for c, mean, inverse in model.classes:
        cov = np.linalg.inv(inverse.T @ inverse)
        logs.append([-0.5 * (v - mean) @ np.linalg.solve(cov, v - mean) - 0.5 * np.linalg.slogdet(cov)[1] for v in z])
    prior = [np.log(0.5)] * 2
    want = 1 / (1 + np.exp(-((np.array(logs[1]) + prior[1]) - (np.array(logs[0]) + prior[0])) / model.temperature))
    assert np.allclose(model.score(xs[1][:50]), want)


def test_statistics_do_not_depend_on_neighbours():
    texts = ["", "one two  two\ntwo\n", "A B C | d", "é" * 10, ""]
    both = statistics(*bytes_of(pa.array(texts)))
    for k, t in enumerate(texts):
        assert np.allclose(both[k], statistics(*bytes_of(pa.array([t])))[0])
    assert both.shape == (5, len(NAMES)) and np.isfinite(both).all()


def test_temperature_makes_scores_as_sure_as_they_are_right():
    from terrapix.llm.quality import calibrated

    d = np.array([-40.0, -10.0, 10.0, 40.0])
    t = calibrated(d, np.array([90.0, 70.0, 30.0, 10.0]), np.array([10.0, 30.0, 70.0, 90.0]))  # right as often as 1 / (1 + exp(-d / 16))
    assert 10 < t < 25
    apart = calibrated(d, np.array([50.0, 50.0, 0.0, 0.0]), np.array([0.0, 0.0, 50.0, 50.0]))
    assert 0.9 < 1 / (1 + np.exp(-10 / apart)) < 0.9999


def test_repeated_rows_and_ties(spark):
    """Rows that repeat score alike and stay or go alike; rows without an id stay or go by their text."""
    docs, labels = fixture(200)
    d, y = frames(spark, docs + [docs[40], docs[40], (None, docs[40][1]), (None, docs[41][1])], labels)
    got = {}
    for r in score_quality(d, y).collect():
        got.setdefault(r.doc_id, set()).add(round(r.score, 9))
    assert None not in got and all(len(x) == 1 for x in got.values())
    kept = [(r.doc_id, r.text) for r in keep_good(d, y).collect()]
    assert kept.count((40, docs[40][1])) in (0, 3) and ((None, docs[41][1]) in kept) == ((41, docs[41][1]) in kept)
    assert len(keep_good(d, y.limit(0)).collect()) == len(docs) + 4 and keep_good(d.limit(0), y).isEmpty()
