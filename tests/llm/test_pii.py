import hashlib
import random
import re

import numpy as np

from terrapix.llm.pii import IP, LABELERS, NO, SILENT, YES, base_spans, digest, estimate, find_pii, luhn

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute(text):
    out = []
    for kind, p in PATTERNS:
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def texts():
    rnd = random.Random(13)
    some = [None, "", "mail é jo.doe+x@mail.example.com, or a@b or a@b.c@d.e.f", "10.0.0.1.2.3.4.5 300.1.1.1 1.2.3", "4539 1488 0343 6467 and 4539148803436467 4539-1488-0343-6468", "+1 (017) 555-7713 rethsh +49 30 1234567- +12", "@@@ a@@b.c x@y.z@", "9" * 30_000, "a" * 50_000 + "@" + "b" * 9, "1." * 5000]
    for _ in range(400):
        some.append("".join(rnd.choice("ab1234567890 @.+-() é,") for _ in range(rnd.randint(0, 120))))
    return some


def test_addresses_with_very_many_digits():
    for part, good in (("0" * 5000 + "1", True), ("0" * 5000 + "255", True), ("0" * 5000 + "256", False), ("1" * 5000, False), ("0" * 5000, True)):
        text = f"at {part}.2.3.4 now"
        assert [(k, s, e) for k, s, e in base_spans(text) if k == IP] == ([(IP, 3, len(text) - 4)] if good else [])


def test_base_spans_against_patterns():
    names = ("email", "ip", "card", "phone")
    for t in texts():
        assert [f"{names[k]}:{s}:{e}" for k, s, e in base_spans(t or "")] == brute(t), t


def test_table(spark):
    rows = [(k, t, "x") for k, t in enumerate(texts())]
    token = 'set token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" now, write to jo (at) example dot com'
    rows += [(1000, token, "x"), (1001, "call me: 555-123-4567 thanks", "x"), (1002, "Dr. Smith and Mary Jones", "x")]
    got = {r.doc_id: r for r in digest(find_pii(spark.createDataFrame(rows, "doc_id long, text string, spans string"))).collect()}
    assert len(got) == len(rows)
    for k, t, _ in rows:
        base = brute(t)
        assert got[k].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone] == [sum(x.startswith(f"{n}:") for x in base) for n, _ in PATTERNS]
        assert set(base) <= set(got[k].spans.split(",")) | {""}
    assert "secret:13:53" in got[1000].spans
    assert digest(find_pii(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_em_finds_the_reliable_labelers():
    rnd = np.random.default_rng(3)
    truth = rnd.random(5000) < 0.4
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.55])
    said = np.where(rnd.random((5000, LABELERS)) < right, truth[:, None], ~truth[:, None]) * (YES - NO) + NO
    said[rnd.random(said.shape) < 0.2] = SILENT
    q, table, prior = estimate(said, np.ones(5000))
    assert ((q > 0.5) == truth).mean() > 0.93
    assert abs(prior - 0.4) < 0.05
    share = table[1, :, YES] / (table[1, :, YES] + table[1, :, NO])
    assert np.abs(share - right).max() < 0.06


def planted(n, seed=3):
    """Documents with one span each of every kind, and as many with what only looks like one."""
    rnd = random.Random(seed)
    prose = lambda k: " ".join(rnd.choice("the tide went out past old harbour wall and boats lay on mud until evening version section".split()) for _ in range(k))
    digits = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))

    def valid(make, good):
        while not good(x := make()):
            pass
        return x

    iban = lambda: valid(lambda: f"DE{digits(20)}", lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1)
    makers = {
        "email": lambda: f"{rnd.choice(['mail', ''])} ann.{digits(2)}@mail{digits(1)}.example.com",
        "ip": lambda: f"host {rnd.randint(1, 250)}.{rnd.randint(0, 255)}.3.{rnd.randint(0, 255)}",
        "card": lambda: f"{rnd.choice(['card', ''])} {valid(lambda: '4' + digits(15), luhn)}",
        "phone": lambda: f"+1 ({digits(3)}) 555-{digits(4)}",
        "email_like": lambda: f"{rnd.choice(['mail', ''])} {rnd.choice('ann bob eve'.split())} [at] mail{digits(1)} [dot] com",
        "phone_like": lambda: f"{rnd.choice(['phone', ''])} ({digits(3)}) 555-{digits(4)}",
        "secret": lambda: f'{rnd.choice(["token", "api key"])} = "{"".join(rnd.choice("0123456789abcdef") for _ in range(40))}"',
        "ssn": lambda: f"{rnd.choice(['SSN', ''])} {rnd.randint(100, 600)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}",
        "iban": lambda: f"{rnd.choice(['IBAN', ''])} {iban()}",
        "name": lambda: f"{rnd.choice(['signed', ''])} {rnd.choice(['Mary', 'Peter', 'Dr.', 'Mrs'])} {rnd.choice(['Miller', 'Stone'])}",
    }
    rows = [(k, f"{prose(15)} {makers[kind]()} {prose(15)}", kind) for k, kind in enumerate(rnd.choice(list(makers)) for _ in range(n))]
    odd = lambda: rnd.choice(["version 1.2.3", "order 123-456", "isbn 978-3-16-148410", f"= {digits(10)}", "The End", "size: averylongwordwithoutdigits"])
    return rows + [(n + k, f"{prose(15)} {odd()} {prose(15)}", "") for k in range(n)]


def test_planted_data_is_found(spark):
    rows = planted(600)
    got = {r.doc_id: r for r in digest(find_pii(spark.createDataFrame(rows, "doc_id long, text string, kind string"))).collect()}
    for kind in {k for _, _, k in rows if k}:
        some = [i for i, _, k in rows if k == kind]
        assert sum(f"{kind}:" in got[i].spans for i in some) >= 0.9 * len(some), kind
    assert sum(got[i].n_spans > 0 for i, _, k in rows if not k) <= 0.02 * 600


def test_names_that_no_list_has(spark):
    """Names made up of syllables, after what introduces them; and clean documents with words in capitals."""
    rnd = random.Random(8)
    made = lambda: "".join(rnd.choice("ba zor ti quil mer ön thes ka lév dra".split()) for _ in range(rnd.choice([2, 3]))).capitalize()
    prose = lambda k: " ".join(rnd.choice("the tide went out past old harbour wall and boats lay on mud until evening end contact".split()) for _ in range(k))
    rows = [(k, f"{prose(15)} {rnd.choice(['signed', 'name:', 'contact', 'Dear', 'author:', 'Dr.'])} {made()} {made()}, {prose(9)}") for k in range(200)]
    rows += [(k, f"{prose(9)} {rnd.choice(['The End', 'Old Harbour', 'contact The Wall', 'signed Mud'])} {prose(15)}. {made()} {prose(4)}") for k in range(200, 500)]
    rows += [(1000 + k, t) for k, t, _ in planted(300)]
    got = {r.doc_id: r.spans for r in digest(find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert sum("name:" in got[k] for k in range(200)) >= 180
    assert sum(got[k] != "" for k in range(200, 500)) <= 6


def test_nothing_to_add(spark):
    """Where the classifier accepts nothing, or no candidate is there, base spans stay alone."""
    rows = [(1, "mail a@b.example and 1.2.3.4"), (2, "plain"), (3, "= 4539148803436467 and 000-00-0000")]
    got = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [len(got[k].base) for k in (1, 2, 3)] == [2, 0, 1] and all(set(got[k].base) <= set(got[k].spans) for k in got)


def test_no_largest_length():
    from terrapix.llm.pii import KINDS, loose_spans

    secret = "a1" * 4000
    assert loose_spans(f"key = {secret}", []) == [(KINDS.index("secret"), 6, 6 + len(secret))]
    address = "x" * 300 + " (at) " + "y" * 300 + " dot " + "z" * 40 + " dot com dot uk dot eu"
    assert loose_spans(address, []) == [(KINDS.index("email_like"), 0, len(address))]
    spread = "4 5 3 9-1 4 8 8-0 3 4 3-6 4 6 7"
    assert loose_spans("4" + " 5" * 12, [])[0][1:] == (0, 25) or base_spans(spread)
    name = "Mary " + "J" + "o" * 60
    assert loose_spans(name, []) == [(KINDS.index("name"), 0, len(name))]


def test_scans_are_linear():
    import time

    from terrapix.llm.pii import loose_spans

    for piece in ("a.", "a at ", "= ", " ", "Aa ", "1 ", "x", "AB12", "a (at) b dot "):
        began = time.process_time()
        text = "=" + piece * (400_000 // len(piece))
        loose_spans(text, base_spans(text))
        assert time.process_time() - began < 8, piece
