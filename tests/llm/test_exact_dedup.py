import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from terrapix.llm import exact_dedup as module
from terrapix.llm.exact_dedup import exact_dedup

ROWS = [(5, "a  b"), (2, "a\tb"), (9, "a b"), (4, None), (3, ""), (7, "a b "), (8, "A b"), (1, "x" * 100_000), (6, "x" * 100_000), (10, "a b"), (11, "\n"), (12, " ")]


def brute(rows):
    groups = defaultdict(list)
    norm = {i: re.sub(r"[ \t\n\x0b\x0c\r]+", " ", t or "") for i, t in rows}
    for i, t in norm.items():
        groups[t].append(i)
    return {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def run(spark, rows):
    got = exact_dedup(spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, group_size int, h string"))
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()}


def test_against_brute_force(spark):
    assert run(spark, ROWS) == brute(ROWS)
    assert run(spark, []) == {}


def test_collisions_are_told_apart_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(module.F, "md5", lambda c: F.lit("00112233445566778899aabbccddeeff"))
    assert run(spark, ROWS) == brute(ROWS)


def test_rows_that_repeat_an_id(spark):
    rows = [(3, "a b"), (3, "a b"), (3, "c"), (5, "a  b"), (4, "c"), (None, "c"), (2, "d"), (2, "d")]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(2, 2, 2, True)] * 2 + [(3, 3, 2, True), (3, 3, 3, True), (3, 3, 3, True), (4, 3, 2, False), (5, 3, 3, False)]
    assert len({r.text_sha256 for r in got}) == 3
