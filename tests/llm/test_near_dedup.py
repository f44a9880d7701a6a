import random
import re

import numpy as np

from terrapix.operators.components import components
from terrapix.llm.near_dedup import joint_estimate, multipliers, near_dedup, registers


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[p : p + k]) for p in range(max(1, len(w) - k + 1))} if w else set()
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                comp[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def fixture():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 4)))
    rows = [(0, None), (1, ""), (2, "  \n"), (3, "One"), (4, "one"), (5, "one two"), (6, "ONE\ttwo"), (7, "a " * 4000)]
    n = 8
    for size in (60, 200, 35):
        base = [word() for _ in range(size)]
        rows.append((n, " ".join(base)))
        n += 1
        chain = list(base)
        for k in range(18):
            w = list(base) if k % 2 else chain
            for _ in range(rnd.randint(1, max(1, size // 25))):
                w[rnd.randrange(size)] = word()
            rows.append((n, " ".join(w)))
            n += 1
    base = [word() for _ in range(150)]  # near each other, but mostly not near enough
    for k in range(25):
        w = list(base)
        for p in rnd.sample(range(150), rnd.randint(8, 14)):
            w[p] = word() + str(k)
        rows.append((n, " ".join(w)))
        n += 1
    rows += [(n + k, " ".join(word() for _ in range(rnd.randint(1, 50)))) for k in range(40)]
    rnd.shuffle(rows)
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, component int, sig string")
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup(df, **kw).collect()}


def test_against_brute_force(spark):
    rows = fixture()
    assert run(spark, rows, shingle=2) == brute(rows, 2, 80)


def test_large_buckets_meet_in_blocks(spark):
    rows = fixture()
    assert run(spark, rows, shingle=2, few=2, block=3) == brute(rows, 2, 80)


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100, 160)] + [(5, 3), (3, 9), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, 3: 3, 5: 3, 9: 3}


def test_joint_estimate():
    rnd = np.random.default_rng(0)
    for j in (0.3, 0.6, 0.8, 0.95):
        n = 4000
        every = rnd.integers(1, 2**63, int(2 * n - n * 2 * j / (1 + j)) + 1, dtype=np.uint64)
        a, b = every[:n], every[len(every) - n :]
        r = registers([a, b], multipliers(1024))
        est = joint_estimate(r[:1], r[1:], np.array([float(n)]), np.array([float(n)]))[0]
        assert abs(est - len(set(a) & set(b)) / len(every)) < 0.06


def test_rows_that_repeat_an_id(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(4, a), (4, b), (4, a), (2, a + " end"), (7, b), (5, "alone at last"), (None, a)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect())
    assert got == [(2, 60, 2, True), (4, 59, 2, False), (4, 59, 2, False), (4, 59, 4, True), (5, 2, 5, True), (7, 59, 4, False)]


def test_words_that_weak_hashes_confuse(spark):
    for n in (1024, 4096):
        bits = [bin(k).count("1") % 2 for k in range(n)]
        x, y = "".join("ab"[k] for k in bits), "".join("ba"[k] for k in bits)
        rows = [(1, f"one {x}"), (2, f"one {y}"), (3, f"one {x}")]
        assert run(spark, rows, shingle=2) == brute(rows, 2, 80)
