"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a classifier decides.

Candidates are all matches of four agreed patterns and of looser ones (spelled-out addresses, local phone numbers,
short card numbers, secrets, social security numbers, bank accounts, names). Five labelers look at each: the strict
pattern, a check sum or range, a gazetteer, the words before it, and its shape. Each says yes, no or nothing.
Expectation-maximisation over the counts of vote patterns (their number is fixed, whatever the corpus) estimates how
reliable each labeler is; its posteriors train a logistic classifier over votes, kind, length and digits. What that
accepts is added to the matches of the agreed patterns, which always stay.
"""

from __future__ import annotations


import math
import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, prepare, stored

KINDS = ("email", "ip", "card", "phone", "email_like", "phone_like", "card_like", "secret", "ssn", "iban", "name")
EMAIL, IP, CARD, PHONE, EMAIL_LIKE, PHONE_LIKE, CARD_LIKE, SECRET, SSN, IBAN, NAME = range(len(KINDS))
NO, YES, SILENT = range(3)
LABELERS = 5

#: The agreed patterns. Of an address only what follows its @; a number can't begin inside another.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser patterns. None has a largest length of its own; each run of characters is scanned once.
SPELLED = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++(?: ?[\[(] ?at ?[\])] ?| at )[A-Za-z0-9-]++(?:(?: ?[\[(] ?dot ?[\])] ?| dot |\.)[A-Za-z]{2,}+)++")
LOCAL_PHONE = re.compile(r"(?<![0-9.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
SECRET_VALUE = re.compile(r"[=:]\s*+[\"']?([A-Za-z0-9_/+-]{16,}+)")
SOCIAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
ACCOUNT = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
FULL_NAME = re.compile(r"(?<!\w)(?!(?:Dear|Name|Signed|Author|Contact|Regards|Sincerely|Attn)\b)([A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]++)\.? ([A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]++)(?!\w)")
#: What a name stands after, within NEAR characters.
INTRODUCED = re.compile(r"(?:^|[^a-z])(?:name(?: is)?|signed(?: by)?|author|written by|contact|dear|regards|sincerely|attn)[:,]? {1,2}$")
NEAR = 24
SMALL = re.compile(r"(?<!\w)[a-zß-öø-ÿ]++(?!\w)")
#: Gazetteers and cue words. They vote; a name needs none of them where it is introduced as one.
ENDINGS = frozenset("com org net edu gov info io de fr es it nl uk eu us ca au ch at be se no fi dk pl ru jp cn in br mx".split())
COUNTRY = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "62", "64", "65", "7", "81", "82", "86", "90", "91", "351", "353", "358", "420")
GIVEN = frozenset(
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Margaret Mark Betty Donald Sandra Steven Ashley "
    "Paul Emily Andrew Donna Joshua Michelle Kenneth Carol Kevin Amanda Brian Melissa George Deborah Edward Stephanie Peter Anna Hans Ursula Klaus Petra Wolfgang Monika Stefan Sabine Jürgen Renate Dieter Helga Andreas Ingrid Jean Marie "
    "Pierre Sophie Jacques Isabelle Michel Nathalie Philippe Catherine Nicolas Julie Luis Carmen Jose Lucia Carlos Elena Antonio Maria Manuel Ana Francisco Laura Javier Isabel Miguel Pilar Fernando Rosa Diego Teresa Pablo Cristina".split()
)
TITLES = frozenset("Mr Mrs Ms Miss Dr Prof Sir Herr Frau Mme Mlle Monsieur Madame Sr Sra Señor Señora Don Doña".split())
CUES = {
    EMAIL: "mail contact write reach", IP: "ip address host server login client", CARD: "card visa credit pay amex number", PHONE: "phone tel call mobile fax cell contact",
    EMAIL_LIKE: "mail contact write reach", PHONE_LIKE: "phone tel call mobile fax cell contact", CARD_LIKE: "card visa credit pay amex", SECRET: "token secret key passw auth credential bearer",
    SSN: "ssn social security", IBAN: "iban account bank", NAME: "name signed author contact dear",
}
CUES = {k: tuple(v.split()) for k, v in CUES.items()}
AGAINST = ("isbn", "version", "order", "invoice", "doi", "rfc", "section")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def octet(s: str) -> bool:
    """Whether digits, of whatever length, are a number of at most 255."""
    s = s.lstrip("0")
    return len(s) < 3 or len(s) == 3 and s <= "255"


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the agreed patterns, by kind and start. Every scan is linear, whatever the text."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        s = at
        while s > last and text[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(text, at + 1) if s < at else None
        if m:
            found.append((EMAIL, s, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in DOTTED.finditer(text):
        if all(octet(x) for x in m[0].split(".")):
            found.append((IP, m.start(), m.end()))
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            d = only_digits(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                found.append((CARD, m.start(), m.end()))
    if "+" in text:
        for m in PLUS.finditer(text):
            if 8 <= len(only_digits(m[0])) <= 15:
                found.append((PHONE, m.start(), m.end()))
    return found


def loose_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the looser patterns that touch no earlier span, in the order of the kinds."""
    used = sorted((s, e) for _, s, e in taken)
    for k in range(len(used) - 1, 0, -1):  # spans of different kinds can overlap: as one
        if used[k][0] < used[k - 1][1]:
            used[k - 1 : k + 1] = [(used[k - 1][0], max(used[k - 1][1], used[k][1]))]
    found = []

    def add(kind: int, s: int, e: int) -> None:
        k = bisect_left(used, (s, e))
        if (k == 0 or used[k - 1][1] <= s) and (k == len(used) or e <= used[k][0]):
            used.insert(k, (s, e))
            found.append((kind, s, e))

    if " at " in text or "(at" in text or "[at" in text or "( at" in text or "[ at" in text:
        for m in SPELLED.finditer(text):
            if "dot" in m[0] or "(" in m[0] or "[" in m[0]:
                add(EMAIL_LIKE, m.start(), m.end())
    for m in LOCAL_PHONE.finditer(text):
        add(PHONE_LIKE, m.start(), m.end())
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := only_digits(m[0])) <= 19 and (luhn(d) or len(d) >= 16):
            add(CARD_LIKE, m.start(), m.end())
    for m in SECRET_VALUE.finditer(text):
        if any(c.isdigit() for c in m[1]):
            add(SECRET, m.start(1), m.end(1))
    for m in SOCIAL.finditer(text):
        add(SSN, m.start(), m.end())
    for m in ACCOUNT.finditer(text):
        add(IBAN, m.start(), m.end())
    for m in FULL_NAME.finditer(text):  # by a title or given name, or by what stands before words that are no usual ones
        introduced = INTRODUCED.search(text[max(0, m.start() - NEAR) : m.start()].lower()) and small_words(text).isdisjoint((m[1].lower(), m[2].lower()))
        if m[1] in GIVEN or m[1] in TITLES or introduced:
            add(NAME, m.start(), m.end())
    return sorted(found)


@lru_cache(1)
def small_words(text: str) -> frozenset[str]:
    """The words of a text in small letters."""
    return frozenset(SMALL.findall(text))


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def votes(text: str, kind: int, s: int, e: int) -> tuple[int, ...]:
    """What each labeler says of a span: strict pattern, check, gazetteer, context, shape."""
    span, digits = text[s:e], only_digits(text[s:e])
    before = text[max(0, s - 32) : s].lower()
    strict = YES if kind <= PHONE or kind in (SSN, IBAN) else SILENT
    if kind in (CARD, CARD_LIKE):
        check = YES if luhn(digits) else NO
    elif kind == IBAN:
        plain = span.replace(" ", "")
        check = YES if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else NO
    elif kind == SECRET:
        check = YES if entropy(span) >= 3.0 else NO
    elif kind == SSN:
        check = NO if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else YES
    elif kind in (PHONE, PHONE_LIKE):
        check = YES if 8 <= len(digits) <= 15 else NO
    elif kind == IP:
        check = YES
    elif kind == NAME:  # words that the text also has in small letters are words, not names
        check = NO if any(x.rstrip(".").lower() in small_words(text) for x in span.split(" ")) else YES
    else:
        check = SILENT
    if kind in (EMAIL, EMAIL_LIKE):
        listed = YES if re.split(r"[. ]", span.lower().rstrip(" ])"))[-1] in ENDINGS else NO
    elif kind == PHONE:
        listed = YES if digits.startswith(COUNTRY) else NO
    elif kind in (CARD, CARD_LIKE):
        listed = YES if digits[0] in "23456" else NO
    elif kind == IP:
        listed = NO if digits[0] == "0" else YES
    elif kind == NAME:
        listed = YES if span.split(" ")[0].rstrip(".") in GIVEN | TITLES else SILENT
    else:
        listed = SILENT
    context = YES if any(x in before for x in CUES[kind]) else NO if any(x in before for x in AGAINST) else SILENT
    n = e - s
    usual = {EMAIL: (6, 64), IP: (7, 15), CARD: (16, 23), PHONE: (9, 24), EMAIL_LIKE: (10, 80), PHONE_LIKE: (12, 14), CARD_LIKE: (15, 23), SECRET: (24, 128), SSN: (11, 11), IBAN: (15, 42), NAME: (5, 30)}[kind]
    shape = YES if usual[0] <= n <= usual[1] else NO
    return strict, check, listed, context, shape


def code_of(text: str, kind: int, s: int, e: int) -> int:
    """Votes, kind, length and digits of a span as one number; there are SIZE of them."""
    out = kind
    for v in votes(text, kind, s, e):
        out = out * 3 + v
    length = min(int(math.log2(e - s)), 7)
    share = min(int(4 * len(only_digits(text[s:e])) / (e - s)), 3)
    return (out * 8 + length) * 4 + share


SIZE = len(KINDS) * 3**LABELERS * 32  # 85,536


def decode(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kind, votes (one column each), length class and digit class of codes."""
    share, codes = codes % 4, codes // 4
    length, codes = codes % 8, codes // 8
    said = np.stack([(codes // 3 ** (LABELERS - 1 - k)) % 3 for k in range(LABELERS)], 1)
    return codes // 3**LABELERS, said, length, share


def estimate(said: np.ndarray, weight: np.ndarray, sure: np.ndarray | None = None, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """EM for two classes: posterior of each vote pattern, table (class, labeler, vote), and the share of true spans.

    sure: patterns that are true by agreement; they anchor the classes.
    """
    yes, no = (said == YES).sum(1), (said == NO).sum(1)
    sure = np.zeros(len(said), bool) if sure is None else sure
    q = np.where(sure, 1.0, (yes + 1) / (yes + no + 2))
    table, prior = np.full((2, LABELERS, 2), 1 / 2), 0.5
    spoke = said != SILENT
    for _ in range(rounds):
        prior = float((weight @ q + 2) / (weight.sum() + 4))
        for c, p in ((0, 1 - q), (1, q)):
            for k in range(LABELERS):
                n = np.bincount(said[spoke[:, k], k], (weight * p)[spoke[:, k]], 2)
                table[c, k] = (n + np.array([2.0, 1.0] if c == 0 else [1.0, 2.0])) / (n.sum() + 3)  # better than chance
        # Silence is no evidence: a labeler that has nothing to say of a kind tells nothing of its spans.
        says = lambda c: sum(np.where(spoke[:, k], np.log(table[c, k][np.minimum(said[:, k], 1)]), 0.0) for k in range(LABELERS))
        odds = np.log(1 - prior) + says(0) - np.log(prior) - says(1)
        q = np.where(sure, 1.0, 1 / (1 + np.exp(np.clip(odds, -500, 500))))
    return q, table, prior


def design(codes: np.ndarray) -> np.ndarray:
    kind, said, length, share = decode(codes)
    parts = [np.ones((len(codes), 1)), kind[:, None] == np.arange(len(KINDS)), length[:, None] == np.arange(8), share[:, None] == np.arange(4)]
    parts += [said[:, k, None] == np.array([NO, YES]) for k in range(LABELERS)]
    return np.concatenate([x.astype(float) for x in parts], 1)


def train(codes: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of the logistic classifier, fitted to the EM posteriors by Newton's method."""
    if not len(codes):
        return np.zeros(design(np.zeros(1, np.int64)).shape[1])
    kind, said, _, _ = decode(codes)
    q, _, _ = estimate(said, weight, kind <= PHONE)
    x = design(codes)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (q - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("code", pa.int32())]))
FOUND = "doc_id long, base array<struct<kind:int,s:int,e:int,code:int>>, loose array<struct<kind:int,s:int,e:int,code:int>>"


def _find(batches):
    for batch in batches:
        base, loose = [], []
        for text in batch.column("text").to_pylist():
            b = base_spans(text)
            for out, spans in ((base, b), (loose, loose_spans(text, b))):
                out.append([{"kind": k, "s": s, "e": e, "code": code_of(text, k, s, e)} for k, s, e in spans])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, SPAN), pa.array(loose, SPAN)], ["doc_id", "base", "loose"])


def find_pii(df: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind, s, e in code points, by kind and start) of every document.

    base: the agreed patterns' matches. spans: these and what the trained classifier adds. Null and empty texts have
    none; repeated rows are searched each; an empty table gives an empty result; other columns are ignored. Rows without doc_id are left out.
    """
    prepare(df.sparkSession)
    found = stored(documents(df).mapInArrow(_find, FOUND), "op10-found")
    counts = found.select(F.explode(F.concat("base", "loose")).alias("x")).groupBy("x.code").count().collect()  # SIZE rows at most
    codes, weight = np.array([r.code for r in counts], np.int64), np.array([r["count"] for r in counts], float)
    w = train(codes, weight)
    kind = decode(codes)[0] if len(codes) else codes
    good = codes[(kind > PHONE) & (design(codes) @ w >= 0)] if len(codes) else codes
    bits = np.zeros(SIZE + 63, np.uint8)  # a bit for each code, whatever is accepted
    bits[good] = 1
    accepted = F.lit(np.packbits(bits[: len(bits) // 64 * 64], bitorder="little").view(np.int64).tolist()).cast("array<long>")
    bare = lambda c: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    added = F.filter("loose", lambda x: F.getbit(F.get(accepted, F.shiftright(x["code"], 6)), x["code"].bitwiseAND(63)) == 1)
    return found.select("doc_id", bare("base").alias("base"), bare(F.concat("base", added)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the agreed kinds, the digest of their matches, and all spans as text and number."""
    names = F.array(*(F.lit(x) for x in KINDS))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *(count(k) for k in (EMAIL, IP, CARD, PHONE)), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
