import random
import time

import public_tokenizers
from tokenizers import Tokenizer

from terrapix.llm.token_counts import merger, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rnd = random.Random(2)
    some = ["", " ", "  \n\n x", "a" * 5000, "ab" * 700, "Hello world's end, we'll see <|endoftext|> and<|endoftext|><|endoftext|>", "日本語のテキスト。", "naïve — “quoted” £5.00 + 1234567", "\x00\x01 tab\tend\r\n", "é" * 99, "😀😀 ok", "x y " * 300]
    for _ in range(200):
        some.append("".join(rnd.choice("abcdefghij  éß.,'\n😀0123-") for _ in range(rnd.randint(1, 400))))
    return some


def test_against_the_library():
    tok = Tokenizer.from_file(PATH)
    want = [len(x.ids) for x in tok.encode_batch(texts(), add_special_tokens=False)]
    assert merger(PATH).count_texts(texts()) == want


def long_texts():
    rnd = random.Random(7)
    draw = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    some = [draw("abcdefghijklmnopqrstuvwxyz", 4000), draw("ab", 3000), draw("etaoinshr", 2500), "ab" * 900 + "a" * 777, "a" * 3001, draw("0123456789", 999), draw("éßñ日本語", 800), draw("acgt", 5000), "=" * 333 + draw("+/=xyzXYZ", 1500)]
    return [*some, *(draw("theandofin", rnd.randrange(90, 110)) for _ in range(50)), *(draw("aaab", rnd.randrange(80, 300)) for _ in range(50))]


def test_long_pre_tokens_against_the_library():
    tok = Tokenizer.from_file(PATH)
    want = [len(x.ids) for x in tok.encode_batch(long_texts(), add_special_tokens=False)]
    assert merger(PATH).count_texts(long_texts()) == want


def test_a_megabyte_of_letters_ends_soon():
    rnd = random.Random(3)
    text = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=1 << 20))
    began = time.process_time()
    got = merger(PATH).count_texts([text])
    assert time.process_time() - began < 20
    assert got == [len(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids)]


def test_table(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "two words", 7), (3, "two words", 8), (4, "a " * 1500, 9)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == [(1, 0, 0, False), (2, 0, 0, False), (3, 9, 2, False), (3, 9, 2, False), (4, 3000, 1501, True)]
    assert token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
