import random
import re

import pytest

import corpus_pipeline
from terrapix.llm.quality import score_quality

rnd = random.Random(23)
word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 8)))
prose = lambda n: " ".join(word() for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    items = [(k, prose(15)) for k in range(4)]
    docs, labels = [], []
    for k in range(300):
        t = prose(rnd.randint(30, 150))
        if k % 10 == 3:
            t = " ".join(x + "###" for x in t.split())
        if k % 15 == 7:
            t += " " + items[k % 4][1] + " " + prose(3)
        if k % 20 == 11 and k > 20:
            t = "  ".join(docs[k - 1][1].split(" "))
        if k % 20 == 12 and k > 20:
            w = docs[k - 2][1].split()
            w[-1] = word() + "z"
            t = " ".join(w)
        docs.append((k, t, "en", "s", len(t)))
        if k % 2 or k % 3 == 0:
            labels.append((k, int(k % 10 != 3), 0))
    docs.append((300, None, None, None, None))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, items


def shingles(t):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
    return {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set()


def brute(stage, rows, items, good):
    """What each stage keeps of {doc_id: text}."""
    if stage == "quality":
        return {i: t for i, t in rows.items() if i in good}
    if stage == "exact_dedup":
        first = {}
        for i in sorted(rows):
            first.setdefault(re.sub(r"[ \t-\r]+", " ", rows[i] or ""), i)
        return {i: rows[i] for i in first.values()}
    if stage == "near_dedup":
        root = {i: i for i in rows}
        ids = sorted(rows)
        s = {i: shingles(rows[i]) for i in ids}
        for a in ids:
            for b in ids:
                if a < b and s[a] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                    x, y = sorted((root[a], root[b]))
                    root = {k: x if v == y else v for k, v in root.items()}
        return {i: rows[i] for i in ids if root[i] == i}
    grams = {tuple(w[p : p + 10]) for _, t in items for w in [t.split()] for p in range(len(w) - 9)}
    return {i: t for i, t in rows.items() if not any(tuple((t or "").split()[p : p + 10]) in grams for p in range(len((t or "").split()) - 9))}


def test_stages_against_brute_force(spark, folder):
    d, docs, items = folder
    frame = spark.read.parquet(f"{d}/documents.parquet")
    good = {r.doc_id for r in score_quality(frame, spark.read.parquet(f"{d}/labels.parquet")).collect() if r.predicted}
    assert all((k % 10 != 3) == (k in good) for k in range(300) if k % 20 not in (11, 12))
    rows, kept = {r[0]: r[1] for r in docs}, [len(docs)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.stored(stage(spark, frame, d), "test")
        assert frame.columns == corpus_pipeline.COLUMNS
        rows = brute(name, rows, items, good)
        assert {r.doc_id: r.text for r in frame.collect()} == rows, name
        kept.append(len(rows))
    assert kept == sorted(kept, reverse=True) and len(set(kept)) == 5
    pieces = corpus_pipeline.run(spark, d).collect()
    size = {}
    for r in pieces:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
    assert size == {r.doc_id: r.doc_tokens for r in pieces} and size.keys() == rows.keys()


def edge_tables(spark, d, docs, labels, items):
    extra = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, quality string, score string, h string"
    spark.createDataFrame(docs, extra).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")


def stage_ids(spark, d):
    """The ids that each stage keeps, and the columns that it returns."""
    frame, out = spark.read.parquet(f"{d}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.stored(stage(spark, frame, d), "test")
        assert frame.columns == corpus_pipeline.COLUMNS
        out.append(sorted((r.doc_id for r in frame.collect()), key=lambda x: (x is not None, x)))
    return out, corpus_pipeline.STAGES[-1][1](spark, frame, d).collect()


def test_edges_of_every_stage(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, no labels of one class, clashing columns, items without words."""
    passage = prose(12)
    row = lambda i, t: (i, t, None, None, None, 7, "x", "y", None)
    long = prose(40_000)
    docs = [row(5, None), row(3, ""), row(4, long), row(9, long), row(6, "one two"), row(6, "one two"), row(7, "One Two"), row(8, f"a {passage} b"), row(None, "lost"), row(2, "one  two")]
    edge_tables(spark, str(tmp_path), docs, [(4, 1, 0), (None, 0, 0), (6, None, 0)], [(1, passage), (2, None), (3, "...")])
    (quality, exact, near, clean), pieces = stage_ids(spark, str(tmp_path))
    assert quality == [None, 2, 3, 4, 5, 6, 6, 7, 8, 9]
    assert exact == [2, 3, 4, 7, 8] and near == [2, 3, 4, 8] and clean == [2, 3, 4]
    assert {r.doc_id for r in pieces} == {2, 3, 4}


def test_empty_tables(spark, tmp_path):
    edge_tables(spark, str(tmp_path), [], [], [])
    assert stage_ids(spark, str(tmp_path)) == ([[], [], [], []], [])
