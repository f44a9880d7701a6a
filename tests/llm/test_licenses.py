"""The scanner against one without gates, with every rule over every text and containment checked pair by pair."""

import random
import re

import pytest

from terrapix.llm.licenses import KINDS, PHRASES, SPACED, detect, digest, keyword, rules, scan_licenses

TEXTS = [
    "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
    "Licensed under the Apache License, Version 2.0 (the \"License\")", "SPDX-License-Identifier: LGPL-2.1-or-later", "GNU Lesser General Public License v2.1, or GPLv3+",
    "see https://creativecommons.org/licenses/by-nc-sa/4.0/ and https://www.apache.org/licenses/LICENSE-2.0", "under the MIT\n\nLICENSE under  the mit-license. cc_by_nc cc by nc, CC-BY-NC-SA 4.0",
    "", None, "mit", "underthe mit license ünder the mit licensé", "cc by nc", "All rights reserved. No part of this publication may be reproduced", "BSD-3-Clause; 3-clause BSD license; FreeBSD licence",
]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text):
    """Agreed columns and detections of one text, the slow way."""
    words = re.findall(WORD, lowered(text))
    places = [(i, label) for phrase, label in PHRASES for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    spaced = b" " + (text or "").encode().translate(SPACED) + b" "
    found = [(m.start(), m.end(), k, r.priority) for k, r in enumerate(rules()) for m in r.pattern.finditer(spaced)]

    def beaten(x, y):
        s, e, k, p = x
        return y is not x and y[0] <= s and e <= y[1] and (y[3], y[1] - y[0], -y[2]) > (p, e - s, -k) and y[3] >= p

    kept = [x for x in found if not any(beaten(x, y) for y in found)]
    labels = {rules()[x[2]].label for x in kept} | {label for _, label in places}
    at = [i for i, _ in places]
    base = ",".join(sorted({label for _, label in places}))
    score = max([rules()[x[2]].confidence for x in kept], default=0.0)
    return (len(words), len(places), min(at, default=None), max(at, default=None), base, ",".join(sorted(labels)), score), sorted(x[:3] for x in kept)


def mixed(n, seed):
    rng = random.Random(seed)
    parts = [t for t in TEXTS if t] + ["the", "mit", "cc", "by", "nc", "license", "version", "2.0", "gnu", "general public license", "or later", "\n", "é"]
    return [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_rules_are_many_and_gated():
    assert len(rules()) > 300 and {r.kind for r in rules()} == set(KINDS)
    assert all(r.keys and all(re.fullmatch("[a-z0-9]+", k) for k in r.keys) for r in rules())
    assert keyword("(?:gnu )?general public licen[sc]e") == "general" and keyword("free ?bsd licen[sc]e") is None


@pytest.mark.parametrize("seed", range(3))
def test_detections_equal_those_without_gates(seed):
    for text in [*TEXTS, *mixed(60, seed)]:
        assert detect(b" " + (text or "").encode().translate(SPACED) + b" ") == brute(text)[1]


def test_against_brute_force(spark):
    texts = [*TEXTS, *mixed(60, 9), ("word " * 50_000) + "under the mit license" + " x" * 50_000]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(None, "under the mit license", 7), (0, TEXTS[0], 7)], "doc_id long, text string, n_words int")
    got = digest(scan_licenses(df)).collect()
    assert len(got) == len(texts) + 1 and sum(r.doc_id == 0 for r in got) == 2
    for r in got:
        assert tuple(r)[1:] == brute(texts[r.doc_id])[0]
    assert digest(scan_licenses(df.limit(0))).collect() == []


def test_labels_of_plain_notices(spark):
    expected = {0: "mit", 1: "gpl-3", 2: "cc-by-nc", 3: "apache-2", 4: "lgpl-2.1", 5: "gpl-3,lgpl-2.1", 6: "apache-2,cc-by-nc-sa", 13: "proprietary", 14: "bsd-2,bsd-3", 10: ""}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in digest(scan_licenses(df)).collect()}
    assert {k: got[k] for k in expected} == expected


def test_offsets_are_bytes_of_the_text(spark):
    text = "é under the MIT License"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (d,) = scan_licenses(df).first().detections
    assert text.encode()[d.start : d.end] == b"under the MIT License"
