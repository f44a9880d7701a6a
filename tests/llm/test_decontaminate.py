import hashlib
import random
import re

import numpy as np

from terrapix.llm.decontaminate import FMIndex, decontaminate, digest

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, items, window):
    wins = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        for p in range(len(w) - window + 1) if len(w) >= window else [0] * bool(w):
            wins.setdefault(tuple(w[p : p + window]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, ids = WORD.findall(lower(t)), set(), set()
        for x, own in wins.items():
            for p in range(len(w) - len(x) + 1):
                if tuple(w[p : p + len(x)]) == x:
                    hit.update(range(p, p + len(x)))
                    ids |= own
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


def fixture():
    rnd = random.Random(4)
    prose = lambda n: " ".join(rnd.choice(["the", "Tide", "é1", "of", "Boat9", "x"]) + rnd.choice(["", ",", ".\n"]) for _ in range(n))
    items = [(k, prose(rnd.randint(8, 30))) for k in range(12)] + [(20, "zz yy"), (21, "of THE"), (22, None), (23, "..."), (100, "unique zebra")]
    docs = [(0, None), (1, ""), (2, "of, the"), (3, "ZZ-yy zz"), (4, "unique\tzebra" * 3), (5, "x " * 3000)]
    for d in range(6, 40):
        t = prose(rnd.randint(1, 60))
        if d % 3 == 0:
            t += " " + (items[d % 12][1]) + " " + prose(3)
        docs.append((d, t))
    return docs, items


def run(spark, docs, items, window, **kw):
    d = spark.createDataFrame([(i, t, "a", 0) for i, t in docs], "doc_id long, text string, item_id string, n_hit int")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    hits = decontaminate(d, b, window, **kw)
    return {r.doc_id: tuple(r)[1:] for r in digest(hits).collect()}


def test_against_brute_force(spark):
    docs, items = fixture()
    assert run(spark, docs, items, 5) == brute(docs, items, 5)


def test_benchmark_in_blocks(spark):
    docs, items = fixture()
    want = brute(docs, items, 5)
    for limits in ({"block_bytes": 300}, {"block_bytes": 0, "shard_bytes": 100}, {"block_bytes": 50, "shard_bytes": 1000}):
        assert run(spark, docs, items, 5, **limits) == want, limits
    assert run(spark, [], items, 5, block_bytes=10) == {}


def test_a_large_benchmark_passes_no_block_through_the_driver(spark):
    """The plan reads the documents twice, whatever the benchmark's size."""
    docs, items = fixture()
    d = spark.createDataFrame([(i, t, "docs") for i, t in docs], "doc_id long, text string, mark string")
    for n in (1, 5):
        b = spark.createDataFrame([(i + 1000 * k, t) for i, t in items for k in range(n)], "item_id long, text string")
        plan = decontaminate(d, b, 5, block_bytes=10)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LogicalRDD") == 2 and "Cartesian" not in plan


def test_empty_tables(spark):
    docs, items = fixture()
    assert run(spark, [], items, 5) == {}
    assert run(spark, docs, [], 5) == brute(docs, [], 5)


def test_fm_index():
    rnd = np.random.default_rng(1)
    t = np.append(rnd.integers(1, 4, 500), 0)
    index = FMIndex(t, 4)
    for n in (1, 3, 6):
        pats = rnd.integers(1, 5, (50, n))
        l, r = index.search(pats)
        for p, a, b in zip(pats, l, r):
            want = [k for k in range(len(t) - n + 1) if (t[k : k + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_rows_that_repeat_an_id(spark):
    """Each is searched for itself, whether the benchmark fits one block or not."""
    items = [("a", "one two three four five six"), ("b", "seven eight nine ten eleven")]
    docs = [(1, "x one two three four five y"), (1, "seven eight nine ten eleven and more"), (1, "x one two three four five y"), (2, None), (None, "one two three four five")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (None, "x")], "item_id string, text string")
    want = [(1, 7, 5, ["a"]), (1, 7, 5, ["a"]), (1, 7, 5, ["b"]), (2, 0, 0, [])]
    for size in (1 << 20, 20, 0):
        got = sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate(d, b, 5, block_bytes=size).collect())
        assert got == want, size


def test_words_that_weak_hashes_confuse(spark):
    for n in (1024, 4096):
        bits = [bin(k).count("1") % 2 for k in range(n)]
        x, y = "".join("ab"[k] for k in bits), "".join("ba"[k] for k in bits)
        docs = [(1, f"q {x} r"), (2, f"q {y} r")]
        assert run(spark, docs, [(7, x)], 1) == brute(docs, [(7, x)], 1)


def test_known_words_are_compared_by_their_bytes():
    from terrapix.llm.decontaminate import Windows, shard_hits

    w = Windows([("a", "one two three")], 3)
    w.hashes = np.sort(w.hashes)
    raw, offsets = np.frombuffer(b"one two three", np.uint8), np.array([0, 13])
    assert shard_hits(raw, offsets, w)[1].tolist() == [3]
    w.blob = np.frombuffer(b"xnetwothree", np.uint8)  # as if another word had this hash
    assert shard_hits(raw, offsets, w)[1].tolist() == [0]
