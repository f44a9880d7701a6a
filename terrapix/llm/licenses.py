"""License scans by ordered signature rules: keywords gate regexes, priority and containment settle overlaps.

A text is reduced to lower-case words with spaces between them, so that one rule covers every spelling of its
separators. One pass of an automaton finds which keywords a text holds; just the rules of those keywords are run over the
whole text. Every rule has a priority. A detection goes where one of the same or a higher priority contains it, so that
"general public license" inside a longer name, or a bare name inside a notice, doesn't count twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, bytes_of, documents, passes, prepare, words

#: The agreed phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Kinds of rules: priority (the larger wins) and confidence.
KINDS = {"tag": (5, 1.0), "text": (4, 0.95), "url": (4, 0.95), "notice": (3, 0.9), "phrase": (3, 0.9), "name": (2, 0.7), "short": (1, 0.5)}

V = "(?: version| v)?"
LATER = "(?: or (?:at your option )?(?:any )?later(?: version)?| only)?"
CC = "(?:(?:creative commons|cc) )"
CCV = "(?: (?:version )?[1-4](?: [05])?)?(?: (?:international|unported|generic))?(?: (?:public )?licen[sc]e)?"

#: Signatures by hand: label, keyword, formal name, short name as in tags (or -), address (or -), a sentence of its text (or -).
#: A space stands for whatever separates words; a number after a version may have a v before it.
SIGNATURES = rf"""
mit            | mit          | mit(?: expat)?(?: style)? licen[sc]e | mit | opensource org licenses? mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit-0          | mit          | mit no attribution(?: licen[sc]e)? | mit 0 | github com aws mit 0 | -
x11            | x11          | x11 licen[sc]e | x11 | - | except as contained in this notice the name of (?:the )?x consortium shall not be used
isc            | isc          | isc licen[sc]e | isc | opensource org licenses? isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
bsd-0          | bsd          | (?:bsd zero clause|zero clause bsd|0 clause bsd)(?: licen[sc]e)? | 0bsd | - | -
bsd-1          | bsd          | (?:bsd 1 clause|1 clause bsd)(?: licen[sc]e)? | bsd 1 clause | - | -
bsd-2          | bsd,freebsd,simplified  | (?:simplified bsd|freebsd|bsd (?:2|two) clause|(?:2|two) clause bsd)(?: licen[sc]e)? | bsd 2 clause | opensource org licenses? bsd 2 clause | -
bsd-3          | bsd          | (?:new bsd|revised bsd|modified bsd|bsd (?:3|three) clause|(?:3|three) clause bsd)(?: licen[sc]e)? | bsd 3 clause | opensource org licenses? bsd 3 clause | -
bsd-4          | bsd          | (?:original bsd|old bsd|bsd (?:4|four) clause|(?:4|four) clause bsd)(?: licen[sc]e)? | bsd 4 clause | - | -
bsd            | bsd          | bsd(?: style)? licen[sc]e | bsd | opensource org licenses? bsd licen[sc]e | -
bsd            | redistributions | - | - | - | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
apache-2       | apache       | apache(?: software)? licen[sc]e{V} 2(?: 0)? | apache 2(?: 0)? | apache org licenses license 2 0 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-1.1     | apache       | apache(?: software)? licen[sc]e{V} 1 1 | apache 1 1 | apache org licenses license 1 1 | -
apache-1       | apache       | apache(?: software)? licen[sc]e{V} 1 0 | apache 1 0 | apache org licenses license 1 0 | -
apache         | apache       | apache(?: software)? licen[sc]e | - | apache org licenses | -
gpl-1          | general      | (?:gnu )?general public licen[sc]e{V} 1(?: 0)?{LATER} | - | - | -
gpl-2          | general      | (?:gnu )?general public licen[sc]e{V} 2(?: 0)?{LATER} | - | gnu org licenses old licenses gpl 2 0 general | -
gpl-3          | general      | (?:gnu )?general public licen[sc]e{V} 3(?: 0)?{LATER} | - | - | -
gpl            | general      | (?:gnu )?general public licen[sc]e | - | - | either version [1-3] of the license or at your option any later version
gpl-1          | gpl          | gnu gpl{V} 1(?: 0)?{LATER} | gpl{V} ?1(?: 0)?(?: only| or later)? | - | -
gpl-2          | gpl          | gnu gpl{V} 2(?: 0)?{LATER} | gpl{V} ?2(?: 0)?(?: only| or later)? | gnu org licenses (?:old licenses )?gpl 2 0 | -
gpl-3          | gpl          | gnu gpl{V} 3(?: 0)?{LATER} | gpl{V} ?3(?: 0)?(?: only| or later)? | gnu org licenses gpl 3 0 | -
gpl            | gpl          | gnu gpl | gpl | gnu org (?:licenses|copyleft) gpl | -
lgpl-2         | general      | (?:gnu )?(?:library|lesser) general public licen[sc]e{V} 2(?: 0)?{LATER} | - | - | -
lgpl-2.1       | general      | (?:gnu )?(?:library|lesser) general public licen[sc]e{V} 2 1{LATER} | - | - | -
lgpl-3         | general      | (?:gnu )?(?:library|lesser) general public licen[sc]e{V} 3(?: 0)?{LATER} | - | - | -
lgpl           | general      | (?:gnu )?(?:library|lesser) general public licen[sc]e | - | - | -
lgpl-2.1       | lgpl         | gnu lgpl{V} 2 1{LATER} | lgpl{V} ?2 1(?: only| or later)? | gnu org licenses (?:old licenses )?lgpl 2 1 | -
lgpl-3         | lgpl         | gnu lgpl{V} 3(?: 0)?{LATER} | lgpl{V} ?3(?: 0)?(?: only| or later)? | gnu org licenses lgpl 3 0 | -
lgpl           | lgpl         | gnu lgpl | lgpl | gnu org (?:licenses|copyleft) (?:lgpl|lesser) | -
agpl-3         | affero       | (?:gnu )?affero general public licen[sc]e{V} 3(?: 0)?{LATER} | - | - | -
agpl           | affero       | (?:gnu )?affero general public licen[sc]e | - | - | -
agpl-3         | agpl         | gnu agpl{V} 3(?: 0)?{LATER} | agpl{V} ?3(?: 0)?(?: only| or later)? | gnu org licenses agpl 3 0 | -
agpl           | agpl         | gnu agpl | agpl | gnu org licenses agpl | -
gfdl-1.3       | documentation | (?:gnu )?free documentation licen[sc]e{V} 1 3{LATER} | - | - | -
gfdl           | documentation | (?:gnu )?free documentation licen[sc]e | - | gnu org (?:licenses|copyleft) fdl | with no invariant sections no front cover texts and no back cover texts
gfdl           | gfdl         | gnu gfdl | gfdl | - | -
mpl-1.1        | mozilla      | mozilla public licen[sc]e{V} 1 1 | - | mozilla org mpl (?:mpl )?1 1 | -
mpl-2          | mozilla      | mozilla public licen[sc]e{V} 2(?: 0)? | - | mozilla org mpl 2 0 | this source code form is subject to the terms of the mozilla public license
mpl            | mozilla      | mozilla public licen[sc]e | - | mozilla org mpl | -
mpl-2          | mpl          | - | mpl{V} 2(?: 0)? | - | -
mpl-1.1        | mpl          | - | mpl{V} 1 1 | - | -
epl-1          | eclipse      | eclipse public licen[sc]e{V} 1(?: 0)? | - | eclipse org legal epl v10 | -
epl-2          | eclipse      | eclipse public licen[sc]e{V} 2(?: 0)? | - | eclipse org legal epl (?:v20|2 0) | -
epl            | eclipse      | eclipse public licen[sc]e | - | eclipse org legal epl | -
edl-1          | eclipse      | eclipse distribution licen[sc]e(?:{V} 1(?: 0)?)? | - | eclipse org org documents edl | -
epl-1          | epl          | - | epl{V} 1(?: 0)? | - | -
epl-2          | epl          | - | epl{V} 2(?: 0)? | - | -
cddl-1         | cddl         | - | cddl{V} 1(?: 0)? | opensource org licenses? cddl 1 0 | -
cddl           | development  | common development and distribution licen[sc]e | - | - | -
cpl-1          | common       | common public licen[sc]e(?:{V} 1(?: 0)?)? | cpl 1 0 | opensource org licenses? cpl 1 0 | -
cpal-1         | cpal         | - | cpal{V} 1(?: 0)? | opensource org licenses? cpal 1 0 | -
cpal-1         | attribution  | common public attribution licen[sc]e | - | - | -
ipl-1          | ibm          | ibm public licen[sc]e | ipl 1 0 | opensource org licenses? ibmpl | -
eupl-1.1       | eupl         | - | eupl{V} 1 1 | - | -
eupl-1.2       | eupl         | - | eupl{V} 1 2 | joinup ec europa eu (?:collection|software|community) eupl | -
eupl           | european     | european union public licen[sc]e | - | - | -
osl-3          | open         | open software licen[sc]e{V} 3(?: 0)? | osl 3 0 | opensource org licenses? osl 3 0 | -
afl-3          | academic     | academic free licen[sc]e{V} 3(?: 0)? | afl 3 0 | opensource org licenses? afl 3 0 | -
afl            | academic     | academic free licen[sc]e | - | - | -
artistic-1     | artistic     | artistic licen[sc]e{V} 1(?: 0)? | artistic 1 0 | opensource org licenses? artistic licen[sc]e 1 | -
artistic-2     | artistic     | artistic licen[sc]e{V} 2(?: 0)? | artistic 2 0 | opensource org licenses? artistic licen[sc]e 2 | -
artistic       | artistic     | (?:perl )?artistic licen[sc]e | - | - | -
perl           | perl         | under the same terms as perl(?: itself)? | - | dev perl org licenses | -
bsl-1          | boost        | boost software licen[sc]e(?:{V} 1(?: 0)?)? | bsl 1 0 | boost org license 1 0 | -
busl-1.1       | business     | business source licen[sc]e(?:{V} 1 1)? | busl 1 1 | mariadb com bsl11 | -
sspl-1         | server       | server side public licen[sc]e(?:{V} 1)? | sspl 1 0 | mongodb com licensing server side public license | -
elastic-2      | elastic      | elastic licen[sc]e{V} 2(?: 0)? | elastic 2 0 | elastic co licensing elastic license | -
elastic        | elastic      | elastic licen[sc]e | - | - | -
confluent      | confluent    | confluent community licen[sc]e | - | confluent io confluent community license | -
commons-clause | clause       | commons clause(?: licen[sc]e)? | - | commonsclause com | -
zlib           | zlib         | zlib(?: libpng)? licen[sc]e | zlib | opensource org licenses? zlib | -
libpng         | libpng       | libpng licen[sc]e | libpng | - | -
unlicense      | unlicense,unlicence | - | unlicen[sc]e | unlicense org | -
unlicense      | unencumbered | - | - | - | this is free and unencumbered software released into the public domain
wtfpl          | wtfpl        | - | wtfpl | wtfpl net | -
wtfpl          | fuck         | do what the fuck you want to public licen[sc]e | - | - | -
beerware       | beer         | beer ?ware licen[sc]e | - | - | you can do whatever you want with this stuff
beerware       | beerware     | - | beerware | - | -
postgresql     | postgresql   | postgresql licen[sc]e | postgresql | opensource org licenses? postgresql | -
python-2       | python       | (?:python software foundation|psf) licen[sc]e(?:{V} 2(?: 0)?)? | python 2 0 | docs python org (?:[23] )?license | -
psf-2          | psf          | psf licen[sc]e agreement | psf 2 0 | - | -
php-3.01       | php          | php licen[sc]e{V} 3 01 | php 3 01 | php net license 3 01 | -
php            | php          | php licen[sc]e | - | php net license | -
ruby           | ruby         | ruby s? ?licen[sc]e | ruby | ruby lang org en about license | -
openssl        | openssl      | openssl licen[sc]e | openssl | openssl org source license | -
curl           | curl         | curl licen[sc]e | curl | curl se docs copyright | -
ntp            | ntp          | ntp licen[sc]e | ntp | opensource org licenses? ntp | -
w3c            | w3c          | w3c software (?:notice and )?licen[sc]e | w3c | w3 org consortium legal (?:2015 )?copyright software | -
icu            | icu          | icu licen[sc]e | icu | - | -
unicode        | unicode      | unicode (?:inc )?licen[sc]e(?: agreement)? | unicode dfs 2016 | unicode org copyright | -
ncsa           | ncsa         | (?:university of illinois )?ncsa(?: open source)? licen[sc]e | ncsa | opensource org licenses? ncsa | -
bsd-3-lbnl     | lbnl         | lbnl bsd licen[sc]e | bsd 3 clause lbnl | - | -
ms-pl          | microsoft    | microsoft public licen[sc]e | ms pl | opensource org licenses? ms pl | -
ms-rl          | microsoft    | microsoft reciprocal licen[sc]e | ms rl | opensource org licenses? ms rl | -
upl-1          | permissive   | universal permissive licen[sc]e(?:{V} 1(?: 0)?)? | upl 1 0 | opensource org licenses? upl | -
ecl-2          | educational  | educational community licen[sc]e(?:{V} 2(?: 0)?)? | ecl 2 0 | opensource org licenses? ecl 2 0 | -
cecill-2.1     | cecill       | cecill licen[sc]e(?:{V} 2 1)? | cecill 2 1 | cecill info licences licence cecill v2 | -
cecill-b       | cecill       | cecill b licen[sc]e | cecill b | cecill info licences licence cecill b | -
cecill-c       | cecill       | cecill c licen[sc]e | cecill c | cecill info licences licence cecill c | -
mulan-2        | mulan        | mulan (?:psl|permissive software licen[sc]e)(?:{V} 2)? | mulanpsl 2 0 | license coscl org cn mulanpsl2 | -
vim            | vim          | vim licen[sc]e | vim | - | -
ofl-1.1        | font         | (?:sil )?open font licen[sc]e(?:{V} 1 1)? | - | - | -
ofl-1.1        | ofl          | sil ofl | ofl{V} 1 1 | scripts sil org ofl | -
odbl-1         | database     | open (?:data commons open )?database licen[sc]e(?:{V} 1(?: 0)?)? | odbl 1 0 | opendatacommons org licenses odbl | -
odc-by-1       | commons      | open data commons attribution licen[sc]e | odc by 1 0 | opendatacommons org licenses by | -
pddl-1         | dedication   | (?:open data commons )?public domain dedication and licen[sc]e | pddl 1 0 | opendatacommons org licenses pddl | -
ogl-3          | government   | open government licen[sc]e(?: {V} ?3(?: 0)?)? | ogl uk 3 0 | nationalarchives gov uk doc open government licence | -
etalab-2       | ouverte      | licence ouverte(?: {V} ?2(?: 0)?)? | etalab 2 0 | etalab gouv fr licence ouverte | -
cdla-permissive | cdla        | - | cdla permissive [12] 0 | cdla (?:dev|io) permissive | -
cdla-sharing   | cdla         | - | cdla sharing 1 0 | cdla (?:dev|io) sharing | -
cdla-permissive | agreement   | community data licen[sc]e agreement permissive | - | - | -
cdla-sharing   | agreement    | community data licen[sc]e agreement sharing | - | - | -
openrail       | openrail,open,creativeml,bigscience | (?:creativeml |bigscience )?open ?rail(?: m| s)?(?: licen[sc]e)? | openrail | - | -
llama-2        | llama        | llama 2 community licen[sc]e(?: agreement)? | llama2 | ai meta com llama license | -
llama-3        | llama        | (?:meta )?llama 3(?: [0-9])? community licen[sc]e(?: agreement)? | llama3(?: [0-9])? | llama meta com llama3(?: [0-9])? license | -
gemma          | gemma        | gemma terms of use | gemma | ai google dev gemma terms | -
cc0            | cc0          | (?:creative commons )?cc0(?: 1(?: 0)?)?(?: universal)?(?: public domain dedication| licen[sc]e)? | cc0(?: 1 0)? | - | -
cc0            | creativecommons | - | - | creativecommons org publicdomain zero | -
cc-pdm         | creativecommons | - | - | creativecommons org publicdomain mark | -
cc-by          | cc,creative  | {CC}by{CCV} | cc by(?: [1-4] [05])? | - | -
cc-by-sa       | cc,creative  | {CC}by sa{CCV} | cc by sa(?: [1-4] [05])? | - | -
cc-by-nd       | cc,creative  | {CC}by nd{CCV} | cc by nd(?: [1-4] [05])? | - | -
cc-by-nc       | cc,creative  | {CC}by nc{CCV} | cc by nc(?: [1-4] [05])? | - | -
cc-by-nc-sa    | cc,creative  | {CC}by nc sa{CCV} | cc by nc sa(?: [1-4] [05])? | - | -
cc-by-nc-nd    | cc,creative  | {CC}by nc nd{CCV} | cc by nc nd(?: [1-4] [05])? | - | -
cc-by          | creative     | creative commons (?:by|attribution){CCV} | - | - | -
cc-by-sa       | creative     | creative commons (?:by sa|attribution share ?alike){CCV} | - | - | -
cc-by-nd       | creative     | creative commons (?:by nd|attribution no ?deriv(?:ative)?s?(?: works)?){CCV} | - | - | -
cc-by-nc       | creative     | creative commons (?:by nc|attribution non ?commercial){CCV} | - | - | -
cc-by-nc-sa    | creative     | creative commons (?:by nc sa|attribution non ?commercial share ?alike){CCV} | - | - | -
cc-by-nc-nd    | creative     | creative commons (?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?){CCV} | - | - | -
cc-by          | creativecommons | - | - | creativecommons org licenses by(?: [1-4] [05])? | -
cc-by-sa       | creativecommons | - | - | creativecommons org licenses by sa(?: [1-4] [05])? | -
cc-by-nd       | creativecommons | - | - | creativecommons org licenses by nd(?: [1-4] [05])? | -
cc-by-nc       | creativecommons | - | - | creativecommons org licenses by nc(?: [1-4] [05])? | -
cc-by-nc-sa    | creativecommons | - | - | creativecommons org licenses by nc sa(?: [1-4] [05])? | -
cc-by-nc-nd    | creativecommons | - | - | creativecommons org licenses by nc nd(?: [1-4] [05])? | -
public-domain  | public       | (?:released|dedicated|placed|is|are) (?:in|into|to) the public domain | - | - | -
proprietary    | reserved     | - | - | - | all rights reserved no part of this (?:publication|document|work) may be (?:reproduced|copied)
proprietary    | confidential | - | - | - | (?:proprietary and confidential|confidential and proprietary)
"""
#: What stands before a name in a notice, and before a short name in a tag.
GIVEN = "(?:licen[sc]ed|released|distributed|redistributed|available|published|provided|covered|governed|shared|offered|issued) (?:to you )?(?:under|by|with|subject to)(?: an?| the)?(?: (?:terms|conditions)(?: and conditions)? of)?(?: the)? "
TAG = "(?:spdx )?licen[sc]e identifier "
#: Short names that stand for a license wherever they are; the others count in tags and notices alone.
CLEAR = re.compile(r"[al]?gpl|gfdl|cc |cc0|bsd [0-9]|0bsd|mpl|epl|cddl|cpal|eupl|odbl|pddl|ofl|wtfpl|sspl|busl|cdla|ms [pr]l|mulanpsl|beerware|openrail")
#: Words too frequent to gate a rule.
COMMON = frozenset("license licence public version software open free the terms of use under by and any this that with not for in is be to or at your form subject source code licenses licences org com".split())


def keyword(pattern: str) -> str | None:
    """The longest word outside all groups and optional parts, which any match must hold; None where there is none."""
    flat, depth, at = [], 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "(":
            if depth == 0:
                flat.append(" \0" if pattern.startswith("(?: ", at) else "\0")
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                flat.append(" " if pattern[at - 1] == " " else "")
                at += pattern.startswith("?", at + 1)
        elif depth == 0:
            flat.append(c)
        at += 1
    found = "".join(flat).replace(" ?", "\0").split(" ")
    good = [w for w in found if re.fullmatch("[a-z0-9]{3,}", w) and w not in COMMON]
    return max(good, key=len) if good else None


class Rule:
    """One signature: label, kind, keywords of which a text must hold one, and the pattern over spaced words."""

    __slots__ = ("label", "kind", "keys", "pattern", "priority", "confidence")

    def __init__(self, label: str, kind: str, keys: tuple[str, ...], pattern: str):
        self.label, self.kind, self.keys = label, kind, keys
        self.priority, self.confidence = KINDS[kind]
        spaced = pattern.replace(" ?", "\0").replace("(?: ", "(?:\1").replace(" ", " +").replace("\1", " +").replace("\0", " *")
        self.pattern = re.compile(b"(?<= )" + spaced.encode() + b"(?= )")


@lru_cache(1)
def rules() -> list[Rule]:
    """All rules in order; of equal detections the first rule's stays."""
    found = [Rule(label, "phrase", (keyword(phrase) or phrase.split()[0],), phrase) for phrase, label in PHRASES]
    for line in re.sub(re.escape(V) + r" (\??)(?=\d)", lambda m: f"{V} {m[1]}v?", SIGNATURES).strip().splitlines():
        label, given, name, short, url, text = (x.strip() for x in line.split(" | "))
        keys = tuple(given.split(","))
        gate = lambda p: (k,) if (k := keyword(p)) else keys
        if short != "-":
            found += [Rule(label, "tag", ("identifier",), TAG + short), Rule(label, "notice", gate(short), GIVEN + short)]
            if CLEAR.match(short):
                found.append(Rule(label, "short", gate(short), short))
        if url != "-":
            found.append(Rule(label, "url", gate(url), url))
        if text != "-":
            found.append(Rule(label, "text", gate(text), text))
        if name != "-":
            found += [Rule(label, "notice", gate(name), GIVEN + name), Rule(label, "name", gate(name), name)]
    return found


#: Bytes to spaced words: A-Z become lower case, separators become spaces.
SPACED = bytes(32 if not ALNUM[LOWER[b]] else int(LOWER[b]) for b in range(256))


@lru_cache(1)
def gates() -> tuple[ahocorasick.Automaton, dict[str, list[int]]]:
    """The automaton over all keywords, each as the start of a word, and the rules that each opens."""
    opens: dict[str, list[int]] = {}
    for k, rule in enumerate(rules()):
        for key in rule.keys:
            opens.setdefault(" " + key, []).append(k)
    automaton = ahocorasick.Automaton()
    for key in opens:
        automaton.add_word(key, key)
    automaton.make_automaton()
    return automaton, opens


def settle(start: np.ndarray, end: np.ndarray, rule: np.ndarray) -> np.ndarray:
    """Which detections stay, by their index: those that none of the same or a higher priority contains.

    Of equal intervals the higher priority's, then the earlier rule's stays. Detections are taken level by level; in a
    level sorted by start, the largest end so far tells whether an earlier one contains the next, so k detections cost
    k log k and not their square.
    """
    priority = np.array([r.priority for r in rules()])[rule]
    kept, starts, reach = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    for level in np.unique(priority)[::-1]:
        at = np.flatnonzero(priority == level)
        at = at[np.lexsort((rule[at], -end[at], start[at]))]
        before = np.concatenate([[-1], np.maximum.accumulate(end[at])[:-1]])
        above = np.searchsorted(starts, start[at], "right") - 1
        higher = np.where(above >= 0, reach[above], -1) if len(reach) else np.full(len(at), -1)
        stay = at[(before < end[at]) & (higher < end[at])]
        kept.append(stay)
        every = np.concatenate(kept)
        every = every[np.argsort(start[every], kind="stable")]
        starts, reach = start[every], np.maximum.accumulate(end[every]) if len(every) else reach
    return np.sort(np.concatenate(kept)) if kept else np.zeros(0, np.int64)


def detect(spaced: bytes) -> list[tuple[int, int, int]]:
    """(start, end, rule) of every detection that stays, by start; offsets are bytes of the spaced text."""
    automaton, opens = gates()
    present = {key for _, key in automaton.iter(spaced.decode("latin-1"))}
    some = sorted({k for key in present for k in opens[key]})
    found = [(m.start(), m.end(), k) for k in some for m in rules()[k].pattern.finditer(spaced)]
    if not found:
        return []
    start, end, rule = (np.array(x, np.int64) for x in zip(*found, strict=True))
    return sorted(found[k] for k in settle(start, end, rule))


BASE = [(label, re.compile(b"(?<= )" + phrase.replace(" ", " +").encode() + b"(?= )"), b" " + phrase.split()[0].encode()) for phrase, label in PHRASES]

SCHEMA = (
    "doc_id long, n_words long, places array<struct<label: string, word: long>>, "
    "detections array<struct<label: string, kind: string, start: long, end: long, confidence: double>>"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, found = pa.struct([("label", pa.string()), ("word", pa.int64())]), pa.struct([("label", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("confidence", pa.float64())])
    for batch in batches:
        raw, offsets = bytes_of(batch.column("text"))
        counts, places, detections = [], [], []
        for i, j in passes(offsets):
            off = offsets[i : j + 1] - offsets[i]
            part = raw[offsets[i] : offsets[j]]
            starts, _, row = words(LOWER[part], off, ALNUM)
            bounds = np.searchsorted(row, np.arange(j - i + 1))
            counts.append(np.diff(bounds))
            for k in range(j - i):
                spaced = b" " + part[off[k] : off[k + 1]].tobytes().translate(SPACED) + b" "
                own = starts[bounds[k] : bounds[k + 1]] - off[k] + 1
                places.append([{"label": label, "word": int(np.searchsorted(own, m.start()))} for label, p, first in BASE if first in spaced for m in p.finditer(spaced)])
                detections.append([{"label": rules()[r].label, "kind": rules()[r].kind, "start": s - 1, "end": e - 1, "confidence": rules()[r].confidence} for s, e, r in detect(spaced)])
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(places, pa.list_(place)), pa.array(detections, pa.list_(found))], ["doc_id", "n_words", "places", "detections"])


def scan_licenses(df: DataFrame) -> DataFrame:
    """Every document's number of words, the places of the agreed phrases, and the license detections that stay.

    places: label and first word (from 0) of each. detections: label, kind of rule, start and end in bytes of the UTF-8
    text (end exclusive), and the rule's confidence. Null and empty texts have no words and find nothing; texts of any
    length are scanned whole, in linear time for each rule whose keyword they hold. Repeated rows give repeated results,
    rows without doc_id are left out, other columns are ignored, an empty table gives an empty result.
    """
    prepare(df.sparkSession)
    return documents(df).mapInArrow(_scan, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """The agreed columns of scan_licenses: counts, first and last place, labels (all of the agreed phrases among them).

    score is the highest confidence of what was detected, 0 where nothing was.
    """
    word, own = F.transform("places", lambda x: x["word"]), F.array_distinct(F.transform("places", lambda x: x["label"]))
    every = F.array_union(own, F.transform("detections", lambda x: x["label"]))
    best = F.coalesce(F.array_max(F.transform("detections", lambda x: x["confidence"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(word).alias("first_word"), F.array_max(word).alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"), F.array_join(F.array_sort(every), ",").alias("labels"), best.alias("score"),
    )
