"""The trie against a dictionary of all prefixes, and its hash tables against sets."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from terrapix.llm.prefix_trie import Slots, conversation_trie, shards
from terrapix.llm.queries import ORACLE

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = sha(f"{len(role.encode())}:{role}{text}")[:32]
            convs[c].append((turn is not None, turn or 0, tie, role, text))
    convs = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(convs.get(c - int(np.fmod(c, 5)), [])[:h] + own[h:])
    members = defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in m if built[c] == p)
        leaf = lambda q: not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        children = sum(len(q) == len(p) + 1 for q in below)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children, sum(map(leaf, below)), saved, sha(",".join(map(str, ends)))))
    return sorted(out, key=repr)


def run(spark, rows, **limits):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as depth", "1 as t", "2 as k0", "3 as pos")
    got = conversation_trie(df, **limits)
    assert got.columns == COLUMNS and all(t == "bigint" for c, t in got.dtypes if c != "ends_sha256")
    return sorted(map(tuple, got.collect()), key=repr)


def table(n, seed, words=3):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant"]), " ".join(rng.choice(["a", "é", "bb"]) for _ in range(rng.randrange(words)))) for c in range(n) for t in range(rng.randrange(1, 13))]
    rng.shuffle(rows)
    return rows


EDGES = [(0, None, None, None), (0, None, "user", ""), (0, 3, "user", "x"), (0, 3, "user", "x"), (1, 0, "user", "x" * 100_000), (None, 0, "user", "x"), (-3, 1, "", "y"), (-5, 1, "u", "z"), (7, 0, "user", "q"), (13, 5, None, "q"), (13, -5, "s", None)]


@pytest.mark.parametrize("rows", [EDGES, table(40, 1), table(60, 2, 2), [(c, t, "u", "same") for c in range(30) for t in range(4)]], ids=["edges", "mixed", "alike", "copies"])
def test_against_brute_force(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_small_shards_and_pieces(spark):
    rows = table(80, 3, 2)
    assert run(spark, rows, shard_rows=10, chunk_bytes=4) == brute(rows)


def test_shards_hold_whole_conversations():
    conv = np.repeat(np.arange(7), [1, 3, 1, 9, 2, 1, 4])
    batch = pa.RecordBatch.from_arrays([pa.array(conv)], ["conv_id"])
    cut = [t.column("conv_id").to_pylist() for t in shards(iter([batch.slice(0, 8), batch.slice(8, 5), batch.slice(13)]), 5)]
    assert sum(cut, []) == conv.tolist() and all(not set(a) & set(b) for a, b in zip(cut, cut[1:], strict=False)) and len(cut) > 1


def test_empty(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_slots_are_minimal_and_tell_strangers(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**63, (n, 3)).astype(np.uint64), axis=0)
    slots = Slots(keys)
    assert sorted(slots.of(keys)) == list(range(len(keys)))
    other = rng.integers(0, 2**63, (1000, 3)).astype(np.uint64)
    other[:, :2] = keys[rng.integers(0, n, 1000), :2] if n else other[:, :2]
    assert (slots.of(other) == -1).all()


def test_against_sql(spark):
    rows = table(50, 5, 2) + EDGES
    con = duckdb.connect()
    con.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert run(spark, rows) == sorted(con.sql(f"select {', '.join(COLUMNS)} from ({ORACLE['op12_prefix_trie']})").fetchall(), key=repr) == brute(rows)
