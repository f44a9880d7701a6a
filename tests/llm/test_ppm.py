import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from terrapix.llm.ppm import ppm_score, segments


def is_train(i):
    return zlib.crc32(str(i).encode()) % 10 != 0


def symbols(t):
    return (257,) * 4 + tuple(t) + (256,)


def parts(t):
    """Segments as (bytes, whether the text ends)."""
    raw = np.frombuffer(t, np.uint8)
    at = [*segments(raw, np.array([0, len(t)]))[0].tolist(), len(t)]
    return [(t[a:b], k == len(at) - 2) for k, (a, b) in enumerate(zip(at, at[1:]))]


def brute(rows):
    """A trie walked byte by byte under a trie of segments; only where segments end is taken from the operator."""
    trie = defaultdict(Counter)
    cut = {i: parts((t or "").encode()) for i, t in rows}
    vocabulary = Counter()
    tokens = {}
    for i, t in rows:
        t = (t or "").encode()
        tokens[i] = [*re.findall(rb"[^ \t-\r]+", t.lower()), None]
        if is_train(i):
            vocabulary.update(tokens[i])
            s = symbols(t)
            for p in range(4, len(s)):
                for k in range(5):
                    trie[s[p - k : p]][s[p]] += 1
    n, v = sum(vocabulary.values()), len(vocabulary)
    out = {}
    for i, t in rows:
        s, prices = symbols((t or "").encode()), []
        for p in range(4, len(s)):
            total = 0.0
            gone = set()
            for k in range(4, -1, -1):
                seen = {x: c for x, c in trie.get(s[p - k : p], {}).items() if x not in gone}
                size = sum(seen.values()) + len(seen)
                if s[p] in seen:
                    total += math.log10(seen[s[p]] / size)
                    break
                if size:
                    total += math.log10(len(seen) / size)
                gone |= set(seen)
            else:
                total -= math.log10(max(257 - len(gone), 1))
            prices.append(total)
        base = sum(math.log10((vocabulary[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens[i])
        known, after = Counter(), defaultdict(Counter)
        for j, other in cut.items():  # whole corpora of segments, this document's own left out
            if is_train(j) and j != i:
                known.update(other)
                for x, y in zip(other, other[1:]):
                    after[x][y] += 1
        size, total, at = sum(known.values()), 0.0, 0
        for k, x in enumerate(cut[i]):
            bits = sum(prices[at : at + len(x[0]) + x[1]])
            at += len(x[0])
            here = after.get(cut[i][k - 1], {}) if k else {}
            if x in here:
                total += math.log10(here[x] / (sum(here.values()) + 1))
                continue
            if here:
                total -= math.log10(sum(here.values()) + 1)
            if x in known:
                total += math.log10(known[x] / (size + len(known)))
            else:
                total += bits + (math.log10(len(known) / (size + len(known))) if size else 0)
        out[i] = (not is_train(i), len(tokens[i]), sum(vocabulary[x] > 0 for x in tokens[i]), n, base, total)
    return out


def check(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 0, "b") for i, t in rows], "doc_id long, text string, key int, block string")
    got = {r.doc_id: tuple(r)[1:] for r in ppm_score(df, **kw).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][:4] == want[i][:4], i
        assert got[i][4:] == pytest.approx(want[i][4:], rel=1e-9), i


def fixture(n=120):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdEé") for _ in range(rnd.randint(1, 5)))
    rows = [(0, None), (1, ""), (2, " \n "), (3, "a" * 2000), (4, "nul\0inside"), (5, "😀")]
    rows += [(k, " ".join(word() for _ in range(rnd.randint(1, 60)))) for k in range(6, n)]
    passage = " ".join(word() for _ in range(150))
    rows += [(n + k, f"{word()} {passage} {word()}" if k % 2 else passage) for k in range(12)]
    return rows + [(n + 20, "ab cd " * 300), (n + 21, "x\0"), (n + 22, "x")]


def test_against_a_trie(spark):
    check(spark, fixture())


def test_in_blocks(spark):
    check(spark, fixture(), block_bytes=1500)


def test_edges(spark):
    assert ppm_score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = [k for k in range(200) if not is_train(k)][:3]
    check(spark, [(k, "only held out") for k in held])


def test_probabilities_sum_to_one():
    from terrapix.llm.ppm import code_lengths

    rnd = np.random.default_rng(0)
    keys = np.unique(rnd.integers(97, 100, (4000, 5)) @ (1 << np.array([36, 27, 18, 9, 0])))
    counts = rnd.integers(0, 3, len(keys))
    first = np.zeros((258, 257))
    np.add.at(first, ((keys >> 9) & 511, keys & 511), counts)
    contexts = np.unique(keys >> 9)[:20]
    every = np.unique(np.concatenate([keys, (contexts[:, None] << 9 | np.arange(257)).ravel()]))
    n = np.zeros(len(every), np.int64)
    n[np.searchsorted(every, keys)] = counts
    p = 10 ** code_lengths(every, n, first)
    for c in contexts:
        assert p[every >> 9 == c].sum() == pytest.approx(1)


def test_cuts_are_chosen_by_the_text():
    """A passage is cut alike wherever it stands, and all bytes are in segments."""
    rnd = random.Random(2)
    passage = " ".join("".join(rnd.choice("abcde") for _ in range(4)) for _ in range(400)).encode()
    assert len(parts(passage)) > 8 and b"".join(x for x, _ in parts(passage)) == passage
    assert len(set(parts(b"one two three " + passage + b" four")) & set(parts(passage))) >= len(parts(passage)) - 2


def test_known_documents_cost_little(spark):
    rnd = random.Random(6)
    prose = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(300))
    rows = [(k, prose()) for k in range(60)]
    held, trained = [k for k in range(100, 300) if not is_train(k)][:2], [k for k in range(100, 300) if is_train(k)][:2]
    rows += [(held[0], rows[7][1]), (held[1], prose()), (trained[0], rows[8][1]), (trained[1], prose())]
    got = {r.doc_id: r.score / len(dict(rows)[r.doc_id]) for r in ppm_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] > -0.2 for k in (held[0], trained[0], 8)) and all(got[k] < -0.7 for k in (held[1], trained[1], 20))
