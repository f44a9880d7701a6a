"""Region merging against the same rounds in plain Python, and what each of its parameters changes."""

import math
import random
from collections import defaultdict

import pytest

from terrapix.operators.regions import merge_regions, smooth
from terrapix.plans.catalog import QUERIES

BANDS = ["b1", "b2"]


def pid(r, c):
    return (r << 32) + c + 1


def plain_smooth(px, sigma):
    radius = int(4 * sigma + 0.5)
    out = px
    for dr, dc in ((1, 0), (0, 1)):
        now = {}
        for (r, c), v in out.items():
            near = [(math.exp(-k * k / (2 * sigma * sigma)), out.get((r + k * dr, c + k * dc))) for k in range(-radius, radius + 1)] if radius else []
            now[r, c] = v if not radius else tuple(None if x is None else round(sum(w * q[b] for w, q in near if q and q[b] is not None) / sum(w for w, q in near if q and q[b] is not None), 9) for b, x in enumerate(v))
        out = now
    return out


def plain_merge(px, scale, sigma=0.0, min_size=1, tile=None):
    flat = {k: v for k, v in plain_smooth(px, sigma).items() if None not in v}
    size, inner, of = {pid(*k): 1 for k in flat}, {pid(*k): 0.0 for k in flat}, {k: pid(*k) for k in flat}
    edges = {}
    for (r, c), v in flat.items():
        for q in ((r + 1, c), (r, c + 1)):
            if q in flat and (tile is None or tile(r, c) == tile(*q)):
                edges[pid(r, c), pid(*q)] = round(math.dist(v, flat[q]), 9)
    rules = [(lambda a, b, w: w <= min(inner[a] + scale / size[a], inner[b] + scale / size[b]), lambda a: True)]
    if min_size > 1:
        rules.append((lambda a, b, w: size[a] < min_size or size[b] < min_size, lambda a: size[a] < min_size))
    for allowed, picks in rules:
        while True:
            best = {}
            for (a, b), w in edges.items():
                if allowed(a, b, w):
                    for x in (a, b):
                        if picks(x):
                            best[x] = min(best.get(x, (w, a, b)), (w, a, b))
            if not best:
                break
            parent = {x: x for x in size}

            def find(x, parent=parent):
                while parent[x] != x:
                    x = parent[x]
                return x

            for w, a, b in best.values():
                parent[max(find(a), find(b))] = min(find(a), find(b))
            new = {x: find(x) for x in size}
            total, top = defaultdict(int), defaultdict(float)
            for x, y in new.items():
                total[y] += size[x]
                top[y] = max(top[y], inner[x])
            for w, a, _ in best.values():
                top[new[a]] = max(top[new[a]], w)
            fewer = {}
            for (a, b), w in edges.items():
                if new[a] != new[b]:
                    k = min(new[a], new[b]), max(new[a], new[b])
                    fewer[k] = min(fewer.get(k, w), w)
            size, inner, edges, of = dict(total), dict(top), fewer, {k: new[x] for k, x in of.items()}
    return {k: of.get(k, 0) for k in px}


def steps(n, m, seed):
    """Patches of different levels with noise, and some missing pixels."""
    rng = random.Random(seed)
    return {(r, c): None if rng.random() < 0.03 else (0.1 * (r // 4) + rng.random() * 0.02, 0.2 * (c // 5) + rng.random() * 0.02) for r in range(n) for c in range(m)}


FIXTURES = {
    "patches": {k: v or (None, 0.5) for k, v in steps(13, 14, 1).items()},
    "gradient": {(r, c): (0.01 * c, 0.0) for r in range(6) for c in range(20)},
    "flat with an island": {(r, c): (1.0, 1.0) if (r, c) in {(3, 3), (3, 4)} else (0.0, 0.0) for r in range(8) for c in range(9)},
    "noise": {(r, c): (random.Random(r * 31 + c).random(), random.Random(r * 17 + c).random()) for r in range(10) for c in range(10)},
}


def run(spark, px, *args, within=None, **kw):
    rows = [(r, c, *v, r // 5) for (r, c), v in px.items()]
    df = spark.createDataFrame(rows, "row long, col long, b1 double, b2 double, t long").repartition(3)
    return {(r.row, r.col): r.segment_id for r in merge_regions(df, BANDS, *args, within=within, **kw).collect()}


@pytest.mark.parametrize(("name", "args"), [("patches", (0.05,)), ("patches", (0.05, 0.8, 6)), ("gradient", (0.02,)), ("flat with an island", (0.1, 0.0, 5)), ("noise", (0.3, 0.4, 3))])
def test_equals_the_same_rounds_in_python(spark, name, args):
    assert run(spark, FIXTURES[name], *args) == plain_merge(FIXTURES[name], *args)


def test_borders_are_not_crossed(spark):
    got = run(spark, FIXTURES["flat with an island"], 200.0, within="t")
    assert got == plain_merge(FIXTURES["flat with an island"], 200.0, tile=lambda r, c: r // 5)
    assert len(set(got.values())) == 2


def test_each_parameter_changes_the_result(spark):
    px = FIXTURES["patches"]
    base = run(spark, px, 0.05)
    regions = lambda x: len(set(x.values()))
    assert regions(run(spark, px, 5.0)) < regions(base) < regions(run(spark, px, 0.001))
    assert run(spark, px, 0.05, sigma=1.0) != base
    small = run(spark, px, 0.05, min_size=8)
    sizes = lambda x: [list(x.values()).count(k) for k in set(x.values()) - {0}]
    assert min(sizes(small)) >= 8 > min(sizes(base))


def test_smoothing_and_missing_values(spark):
    px = {(0, 0): (1.0, None), (0, 1): (3.0, 2.0), (1, 1): (None, 4.0)}
    df = spark.createDataFrame([(r, c, *v) for (r, c), v in px.items()], "row long, col long, b1 double, b2 double")
    assert {(r.row, r.col): (r.b1, r.b2) for r in smooth(df, BANDS, 0.7).collect()} == plain_smooth(px, 0.7)
    assert merge_regions(df.limit(0), BANDS, 1.0).collect() == []


def test_query_equals_python(spark):
    import os

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("needs the given tables")
    from terrapix.plans.views import spec

    px = {(r.row, r.col): (r.b1, r.b2) for r in spec(spark, d).collect()}
    assert {(r.row, r.col): r.segment_id for r in QUERIES["merge_regions"](spark, d).collect()} == plain_merge(px, 0.05, 0.5, 4)
