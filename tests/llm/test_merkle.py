"""The manifest against a list-based one, its SQL, and bitmaps against sorted arrays."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from terrapix.llm.merkle import Bitmap, counted, h, manifest, packed, repeats, unpacked
from terrapix.llm.queries import ORACLE

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def leaf_of(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tower(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    towers = {g: tower([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in langs}
    top, out = tower([towers[g][-1][0] for g in langs]), []
    root = top[-1][0] if rows else ""
    for j, g in enumerate(langs):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            x, beside = leaf, []
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                x = leaf_of(*r[:4], r[4] + 1)
            for t, at in ((towers[g], i), (top, j)):
                for level in t[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else None
                    x = h(x) if other is None else h(other, x) if at & 1 else h(x, other)
                    beside += [other] if other else []
                    at >>= 1
            out.append((r[0], leaf, towers[g][-1][0], root, h(*beside), x, x == root))
    return sorted(out, key=repr)


def run(spark, rows, **limits):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as leaf", "1 as i", "2 as total", "3 as g", "4 as block").repartition(3)
    got = manifest(df, **limits)
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()), key=repr)


def table(n, seed, langs=("en", "de", None, "é", "")):
    rng = random.Random(seed)
    return [(rng.choice([k, k * 70_001, -k * 3]), rng.choice([None, "", "text é", "x" * 1000]), rng.choice(langs), rng.choice([None, "s"]), rng.choice([None, 3, k])) for k in range(n)]


EDGES = [(None, "a", "en", None, 1), (None, "b", "en", None, 1), (None, None, None, None, None), (2**63 - 1, "a", "en", "s", 2**63 - 1), (-(2**63), "a", "en", "s", 0), (5, "z" * 200_000, "zz", "s", 1)]
CASES = {
    "edges": EDGES, "lone": EDGES[:1], "two langs": [(1, "a", "x", None, 1), (2, "a", "y", None, 1)], "mixed": table(200, 1) + EDGES, "one lang": table(70, 2, ("en",)), "many langs": [(k, "t", f"l{k % 41}", None, k) for k in range(90)],
    "repeated ids": [(k % 4, f"t{k % 9}", "en", None, 1) for k in range(120)] + table(50, 3), "equal rows": [(7, "same", "en", "s", 1)] * 60 + [(8, "same", "en", "s", 1)] * 5,
}


@pytest.mark.parametrize("name", CASES)
def test_against_brute_force(spark, name):
    assert run(spark, CASES[name]) == brute(CASES[name])


@pytest.mark.parametrize("bits", [1, 3])
def test_many_rounds_of_small_blocks_and_hot_ids(spark, bits):
    rows = CASES["repeated ids"] + CASES["mixed"]
    assert run(spark, rows, bits=bits, meet=10) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_against_sql(spark):
    rows = CASES["mixed"][:-3] + CASES["repeated ids"]  # DuckDB's n_chars can't pass 64 bits
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    assert sorted(con.sql(f"select {', '.join(COLUMNS)} from ({ORACLE['op13_merkle_manifest']})").fetchall(), key=repr) == brute(rows)


def test_just_the_tampered_fail(spark):
    rows = [(k, "t", "en", "s", None if k % 10 == 0 else k) for k in range(300)]
    got = {r[0]: r[6] for r in run(spark, rows)}
    assert {k for k, ok in got.items() if not ok} == {k for k in got if zlib.crc32(str(k).encode()) % 7 == 0 and k % 10}


@pytest.mark.parametrize("n", [0, 1, 255, 256, 3000, 4096])
def test_bitmaps(n):
    rng = np.random.default_rng(n)
    values = np.sort(rng.choice(4096, n, replace=False))
    counts = rng.integers(1, 4, n)
    assert (unpacked(packed(values)) == values).all() and len(packed(values)) <= 512
    assert all((a == b).all() for a, b in zip(counted(packed(values), repeats(values, counts)), (values, counts), strict=True))
    some = rng.integers(0, 4096, 1000)
    assert (Bitmap(values).rank(some) == np.searchsorted(values, some)).all()


def test_hash_of_nothing():
    assert h() == hashlib.sha256(b"").hexdigest()
