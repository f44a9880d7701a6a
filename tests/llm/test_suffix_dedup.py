import hashlib
import random
from collections import Counter

from terrapix.llm.suffix_dedup import deep_shallow_sort, suffix_dedup


def brute(rows, length):
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, t in texts:
        seen.update(t[p : p + length] for p in range(len(t) - length + 1))
    out = {}
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def shared_words(rows, k):
    """Words in k words in a row that another document holds too."""
    texts = [(i, (t or "").split(" ")) for i, t in rows]
    texts = [(i, [x.lower() for x in w if x]) for i, w in texts]
    owners = {}
    for i, w in texts:
        for p in range(len(w) - k + 1):
            owners.setdefault(tuple(w[p : p + k]), set()).add(i)
    out = []
    for i, w in texts:
        hit = set()
        for p in range(len(w) - k + 1):
            if len(owners[tuple(w[p : p + k])]) > 1:
                hit.update(range(p, p + k))
        out.append((i, len(hit)))
    return sorted(out)


def fixture(seed=3, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeéß ") for _ in range(rnd.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage, edge = prose(120), prose(60), prose(9)
    rows = [(0, None), (1, ""), (2, "short"), (3, "a" * 300), (4, "ab" * 90), (5, base), (6, base)]
    for i in range(7, n):
        kind = i % 5
        t = prose(rnd.randint(5, 150))
        if kind == 0:
            w = base.split(" ")
            for _ in range(rnd.randint(1, 4)):
                w[rnd.randrange(len(w))] = word()
            t = " ".join(w)
        elif kind == 1:
            cut = rnd.randint(0, 80)
            t = prose(rnd.randint(0, 30)) + passage[cut : cut + rnd.randint(60, 300)] + prose(rnd.randint(0, 30))
        elif kind == 2:
            t = edge + t[:40] + edge + t[:40] + edge
        rows.append((i, t))
    return rows


def run(spark, rows, length, gram, **kw):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, anchor string, spans int")
    got = suffix_dedup(df, length=length, gram=gram, **kw).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got}


def test_against_brute_force(spark):
    rows = fixture()
    assert run(spark, rows, 60, 12) == brute(rows, 60)


def test_groups_past_the_block_size(spark):
    rows = fixture(seed=5)
    assert run(spark, rows, 60, 12, block=2) == brute(rows, 60)


def test_empty_table(spark):
    assert run(spark, [], 60, 12) == {}


def test_deep_shallow_order():
    rnd = random.Random(1)
    strings = list({bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 90))) for _ in range(300)} | {b"a" * k for k in range(60)})
    order, lcps = deep_shallow_sort(strings, shallow=4)
    assert [strings[i] for i in order] == sorted(strings)
    for k in range(1, len(order)):
        a, b = strings[order[k - 1]], strings[order[k]]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert n == lcps[k]


def passages(spark, rows, k, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((r.doc_id, r.n_shared_words) for r in suffix_dedup(df, length=60, gram=12, passage=k, **kw).collect())


def test_passages_of_words(spark):
    """Against brute force: within blocks and past them; what repeats in one document alone doesn't count."""
    rnd = random.Random(4)
    rows = [(i, t and t.replace("  ", " ")) for i, t in fixture(seed=7)]
    rows += [(100, "x y z " * 40), (101, "x y z " * 3), (102, "Some Words " + "q w e r t " * 12 + "end"), (103, "q w e r t " * 4)]
    rows += [(200 + k, " ".join(rnd.choice(["u", "v", "vv"]) for _ in range(40))) for k in range(12)]
    want = shared_words(rows, 9)
    assert passages(spark, rows, 9) == want and sum(n for _, n in want) > 0 and dict(want)[100] == 120
    assert passages(spark, rows, 9, block=2) == want


def test_rows_that_repeat_an_id(spark):
    rows = [(1, "abcdefgh" * 20 + "x"), (1, "abcdefgh" * 20 + "x"), (1, "other " * 30), (2, "".join(map(chr, range(200, 290)))), (2, "".join(map(chr, range(200, 290)))), (None, "lost")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_shared_words) for r in suffix_dedup(df, length=60, gram=12, passage=5).collect())
    assert got == [(1, 161, 161, 0), (1, 161, 161, 0), (1, 180, 180, 0), (2, 180, 180, 0), (2, 180, 180, 0)]


def thue_morse(n, a="a", b="b"):
    """The word of n letters and its complement, which polynomial hashes modulo a power of two can't tell apart."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join(a if x else b for x in bits), "".join(b if x else a for x in bits)


def test_words_that_weak_hashes_confuse(spark):
    for n in (1024, 4096):
        x, y = thue_morse(n)
        rows = [(1, "k" * 70 + x + "m" * 70), (2, "k" * 70 + y + "n" * 70), (3, f"one two {x}"), (4, f"one two {y}")]
        assert run(spark, rows, 600, 64) == brute(rows, 600)
        assert passages(spark, rows, 3) == [(1, 0), (2, 0), (3, 0), (4, 0)]
