import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from terrapix.llm.common import bytes_of
from terrapix.llm.packing import Bm25, Encoder, fill, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rnd = random.Random(17)
    some = [None, "", "  ", "a", "<|endoftext|> x<|startoftext|>y", "naïve — “q” İSTANBUL ΣΑΣ 日本語 😀", "é ̈x", "x" * 3000, "it's we'll 12345 \x0b\x1c ok\x00"]
    word = lambda: "".join(rnd.choice("etaoinés'1.") for _ in range(rnd.randint(1, 9)))
    return some + [" ".join(word() for _ in range(rnd.choice([3, 40, 200, 900]))) for _ in range(60)]


def want_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


def test_long_pre_tokens():
    """Texts without white space have the library's ids and take a time that follows their length."""
    rnd = random.Random(11)
    every = ["".join(rnd.choices(letters, k=n)) for letters, n in (("abcdefghijklmnopqrstuvwxyz", 200_000), ("ab", 3000), ("acgt", 9000), ("éñß", 700), ("etaoin", 97))] + ["a" * 2001, "=" * 999]
    tokenizer, began = Tokenizer.from_file(PATH), time.process_time()
    got = Encoder(PATH)(*bytes_of(pa.array(every)))
    assert time.process_time() - began < 15
    assert [x.tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in every]


def test_ids_are_the_librarys():
    rnd = random.Random(5)
    bits = ["'", "s", "re", "ll", "d", "x", "É", "é", "ß", "1", "½", "²", " ", "\u00a0", "\u2028", "!", "<|", "日", "😀", "\u0301", "İ", "Σ", "\0", "\x1c", "Ⅷ", "longerthansixteenbytes"]
    every = texts() + ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(400)]
    every += ["'s", "'sure 'll 'llama 're 'r ''s !'s 'S it'S 'é 's's", "'", "s"]
    column = pa.array([t or "" for t in every])
    tokenizer = Tokenizer.from_file(PATH)
    encode = Encoder(PATH)
    for _ in range(2):  # new, then remembered
        got = encode(*bytes_of(column))
        assert [x.tolist() for x in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in every]
    assert len(encode.long) < encode.n / 4
    encode.slots[:] = 0  # every slot is another's
    assert [x.tolist() for x in encode(*bytes_of(column))] == [x.tolist() for x in got]


def check(rows, docs, window):
    ids = {i: want_ids(t) for i, t in docs}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(piece) > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for pieces, size in [*((by_doc[i], len(ids[i])) for i in ids), *((p, None) for p in by_seq.values())]:
        at = 0
        for s, n in sorted(pieces):
            assert s == at
            at += n
        assert at == size if size is not None else at <= window and at & (at - 1) == 0


def test_pieces(spark):
    docs = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in docs], "doc_id long, text string, shard string, start int")
    check(pack(df, window=256).collect(), docs, 256)
    check(pack(df, window=64, shard_bytes=9000).collect(), docs, 64)
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_neighbours_are_the_most_alike():
    rnd = np.random.default_rng(2)
    rests = [rnd.integers(1000 * (k % 3), 1000 * (k % 3) + 300, 100).astype("<u2") for k in range(30)]
    scores = Bm25(rests).scores(0)
    assert set(np.argsort(-scores)[:10]) == set(range(0, 30, 3))
    for line in fill(rests, 512)[:1]:
        assert len({d % 3 for d, _, _ in line}) == 1
