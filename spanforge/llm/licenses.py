"""License scans (6): ordered signature rules behind a keyword prefilter; the stronger of nested detections stays."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import no_text_is_empty, null_id

#: Phrases and labels that the contract fixes.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label; SPDX id in words; words of which one stands in whatever the regex matches; regex of the name, over lower-case words with one blank between.
#: {L} is license or licence, {V} the word version or v before a number.
NAMES = r"""
mit; mit; mit, expat, x11; (?:the )?(?:expat|x11) {L}|mit {L}
mit-0; mit 0; mit; mit no attribution(?: {L})?
apache-2; apache 2 0; apache; apache(?: software)? {L} ?{V}2(?: 0)?|apache 2(?: 0)? {L}
apache-1.1; apache 1 1; apache; apache(?: software)? {L} ?{V}1 1
apache-1.0; apache 1 0; apache; apache(?: software)? {L} ?{V}1 0
bsd-2-clause; bsd 2 clause; bsd, freebsd; (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: {L})?
bsd-3-clause; bsd 3 clause; bsd; (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: {L})?
bsd-4-clause; bsd 4 clause; bsd; (?:bsd 4 clause|4 clause bsd|original bsd)(?: {L})?
bsd-0-clause; 0bsd; 0bsd, zero; 0bsd|zero clause bsd(?: {L})?
bsd; bsd; bsd; bsd(?: style)? {L}
isc; isc; isc; isc {L}
zlib; zlib; zlib; zlib(?: libpng)? {L}
libpng; libpng; libpng; libpng {L}
boost-1.0; bsl 1 0; boost; boost software {L}(?: {V}1 0)?
unlicense; unlicense; unlicense; (?:the )?unlicense
wtfpl; wtfpl; wtfpl, public; wtfpl|do what the f\w+ you want to public {L}
cc0-1.0; cc0 1 0; cc0; cc0(?: 1 0)?(?: universal)?
gpl-1; gpl 1 0; gnu; gnu general public {L} {V}1(?: 0)?
gpl-2; gpl 2 0; gnu; gnu (?:general public {L}|gpl) {V}2(?: 0)?
gpl-3; gpl 3 0; gnu; gnu (?:general public {L}|gpl) {V}3(?: 0)?
gpl-2; gpl 2 0 only; gpl, gpl2, gplv2; gpl ?v?2(?: 0)?(?: only| or later)?
gpl-3; gpl 3 0 only; gpl, gpl3, gplv3; gpl ?v?3(?: 0)?(?: only| or later)?
gpl; gpl; gnu; gnu general public {L}
lgpl-2; lgpl 2 0; gnu; gnu (?:library|lesser) general public {L} {V}2(?: 0)?
lgpl-2.1; lgpl 2 1; gnu; gnu lesser general public {L} {V}2 1
lgpl-3; lgpl 3 0; gnu; gnu lesser general public {L} {V}3(?: 0)?
lgpl-2.1; lgpl 2 1 only; lgpl, lgpl2, lgplv2; lgpl ?v?2 1
lgpl-3; lgpl 3 0 only; lgpl, lgpl3, lgplv3; lgpl ?v?3(?: 0)?
lgpl; lgpl; gnu; gnu (?:lesser|library) general public {L}
agpl-3; agpl 3 0; gnu; gnu affero general public {L}(?: {V}3(?: 0)?)?
agpl-3; agpl 3 0 only; agpl, agpl3, agplv3; agpl ?v?3(?: 0)?
agpl-1; agpl 1 0; affero; affero general public {L} {V}1(?: 0)?
gfdl-1.1; gfdl 1 1; gnu; gnu free documentation {L} {V}1 1
gfdl-1.2; gfdl 1 2; gnu; gnu free documentation {L} {V}1 2
gfdl-1.3; gfdl 1 3; gnu; gnu free documentation {L} {V}1 3
gfdl; gfdl; gnu; gnu free documentation {L}
mpl-1.0; mpl 1 0; mozilla; mozilla public {L} ?{V}1 0
mpl-1.1; mpl 1 1; mozilla; mozilla public {L} ?{V}1 1
mpl-2.0; mpl 2 0; mozilla; mozilla public {L} ?{V}2(?: 0)?
mpl-2.0; mpl 2 0 no copyleft exception; mpl, mpl2, mplv2; mpl ?v?2 0
epl-1.0; epl 1 0; eclipse; eclipse public {L} ?{V}1(?: 0)?
epl-2.0; epl 2 0; eclipse; eclipse public {L} ?{V}2(?: 0)?
edl-1.0; edl 1 0; eclipse; eclipse distribution {L}(?: {V}1 0)?
cddl-1.0; cddl 1 0; cddl, cddl1, cddlv, cddlv1, cddlversion, development; (?:common development and distribution {L}|cddl)(?: ?{V}1 0)?
cddl-1.1; cddl 1 1; cddl, cddl1, cddlv, cddlv1, cddlversion, development; (?:common development and distribution {L}|cddl) ?{V}1 1
cpl-1.0; cpl 1 0; common; common public {L}(?: {V}1 0)?
ipl-1.0; ipl 1 0; ibm; ibm public {L}(?: {V}1 0)?
artistic-1.0; artistic 1 0; artistic; artistic {L} {V}1(?: 0)?
artistic-2.0; artistic 2 0; artistic; artistic {L} {V}2(?: 0)?
artistic; artistic; artistic; (?:perl )?artistic {L}
ofl-1.1; ofl 1 1; sil; sil open font {L}(?: {V}1 1)?
ofl-1.0; ofl 1 0; sil; sil open font {L} {V}1 0
eupl-1.1; eupl 1 1; eupl, eupl1, euplv, euplv1, euplversion, european; (?:european union public {L}|eupl) ?{V}1 1
eupl-1.2; eupl 1 2; eupl, eupl1, euplv, euplv1, euplversion, european; (?:european union public {L}|eupl)(?: ?{V}1 2)?
cecill-2.1; cecill 2 1; cecill; cecill(?: {L})?(?: {V}2 1)?
cecill-b; cecill b; cecill; cecill b(?: {L})?
cecill-c; cecill c; cecill; cecill c(?: {L})?
afl-3.0; afl 3 0; academic; academic free {L}(?: {V}3 0)?
osl-3.0; osl 3 0; osl, software; (?:open software {L}|osl)(?: {V}3 0)?
ms-pl; ms pl; microsoft; microsoft public {L}
ms-rl; ms rl; microsoft; microsoft reciprocal {L}
ncsa; ncsa; ncsa; (?:university of illinois )?ncsa(?: open source)? {L}
postgresql; postgresql; postgresql; postgresql {L}
python-2.0; python 2 0; python; python(?: software foundation)? {L}(?: {V}2)?
php-3.01; php 3 01; php; php {L}(?: {V}3 01)?
ruby; ruby; ruby; ruby {L}
openssl; openssl; openssl; openssl {L}
ssleay; ssleay; ssleay; (?:original )?ssleay {L}
vim; vim; vim; vim {L}
zpl-2.1; zpl 2 1; zope; zope public {L}(?: {V}2 1)?
w3c; w3c; w3c; w3c software(?: notice)?(?: and)?(?: {L})
unicode-dfs; unicode dfs 2016; unicode; unicode(?: data files and software)? {L}
json; json; json; json {L}
beerware; beerware; beerware, beer; beer ?ware {L}
qpl-1.0; qpl 1 0; q; q public {L}(?: {V}1 0)?
sleepycat; sleepycat; sleepycat; sleepycat {L}
watcom-1.0; watcom 1 0; watcom; sybase open watcom public {L}
apsl-2.0; apsl 2 0; apple; apple public source {L}(?: {V}2 0)?
naist; naist 2003; naist; naist {L}
nasa-1.3; nasa 1 3; nasa; nasa open source agreement(?: {V}1 3)?
odbl-1.0; odbl 1 0; odbl, database; odbl(?: {V}1 0)?|open database {L}
odc-by-1.0; odc by 1 0; odc, commons; odc by(?: {V}1 0)?|open data commons attribution {L}
pddl-1.0; pddl 1 0; pddl, dedication; pddl|public domain dedication and {L}
cdla-permissive; cdla permissive 2 0; cdla, community; (?:cdla|community data {L} agreement) permissive(?: {V}[12] 0)?
cdla-sharing; cdla sharing 1 0; cdla, community; (?:cdla|community data {L} agreement) sharing(?: {V}1 0)?
openrail; openrail; openrail, rail; (?:creativeml |bigscience |bigcode )?open ?rail(?: m)?(?: {L})?
llama; llama2; llama, llama2, llama3; llama ?[23]? community {L}
busl-1.1; busl 1 1; business; business source {L}(?: {V}?1 1)?
elastic-2.0; elastic 2 0; elastic; elastic {L}(?: {V}?2 0)?
sspl-1.0; sspl 1 0; sspl, server; server side public {L}(?: {V}?1)?|sspl(?: {V}1)?
commons-clause; commons clause; commons; commons clause(?: {L} condition)?
polyform; polyform noncommercial 1 0 0; polyform; polyform (?:noncommercial|small business|shield|strict|free trial|internal use) {L}
mulan-2; mulanpsl 2 0; mulan; mulan p(?:ermissive software|sl) {L}?(?: {V}2)?
public-domain; public domain; domain; (?:in|into|to) the public domain
"""

#: Creative Commons codes and their long names; versions and forms are made by rule below.
CC = {"by": "attribution", "by-sa": "attribution sharealike", "by-nd": "attribution noderiv(?:ative)?s", "by-nc": "attribution noncommercial", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderiv(?:ative)?s"}

#: label; words as above; sentences of the texts themselves.
TEXTS = r"""
mit; granted; permission is hereby granted free of charge to any person obtaining a copy of this software
isc; granted; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd; redistribution; redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause; endorse; neither the name of (?:\S+ ){1,12}may be used to endorse or promote products derived
gpl; redistribute; this program is free software you can redistribute it and or modify it under the terms of the gnu
gpl; warranty; this program is distributed in the hope that it will be useful but without any warranty
apache-2; compliance; you may not use this file except in compliance with the {L}
apache-2; unless; unless required by applicable law or agreed to in writing software distributed under the {L}
mpl-2.0; mozilla; this source code form is subject to the terms of the mozilla public {L} v ?2 0
zlib; implied; this software is provided as is without any express or implied warranty in no event
unlicense; unencumbered; this is free and unencumbered software released into the public domain
boost-1.0; granted; permission is hereby granted free of charge to any person or organization obtaining a copy of the software
wtfpl; want; you just do what the f\w+ you want to
ofl-1.1; font; this font software is licen[cs]ed under the sil open font {L}
cc0-1.0; waived, dedicated; (?:has|have) (?:dedicated|waived) (?:all|the work|any) (?:\S+ ){0,12}(?:rights|public domain)
all-rights-reserved; reserved; all rights reserved
proprietary; proprietary; proprietary and confidential
no-redistribution; redistributed; may not be (?:published broadcast rewritten or )?redistributed
"""


class Rule(NamedTuple):
    """Rules are tried in order of priority; confidence is what a detection adds to the score.

    A regex has a rule for each of the words of which a match holds one at least.
    """

    label: str
    priority: int
    confidence: float
    keyword: bytes
    regex: re.Pattern


def rules() -> list[Rule]:
    """Four forms of each name (SPDX line, grant, link to the name, mention), the sentences, and the Creative Commons family."""
    out = []

    def add(label, priority, confidence, keywords, pattern):
        pattern = pattern.replace("{L}", "licen[cs]e").replace("{V}", "(?:version |v ?)?")
        regex = re.compile(f" (?:{pattern})(?= )".encode())
        out.extend(Rule(label, priority, confidence, k.strip().encode(), regex) for k in keywords.split(","))

    def name(label, spdx, keywords, pattern, sure=0.6):
        add(label, 90, 1.0, "spdx", f"spdx licen[cs]e identifier {spdx}(?: or later| only)?")
        add(label, 80, 0.95, keywords, f"(?:licen[cs]ed|released|distributed|available|published|provided|covered|redistributed) (?:to you )?(?:under|by|with) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{pattern})")
        add(label, 70, 0.8, keywords, f"(?:under|see|use|{{L}}|agree to|terms of|subject to) (?:the )?(?:{pattern})")
        add(label, 50, sure, keywords, pattern)

    for line in NAMES.strip().splitlines():
        name(*(x.strip() for x in line.split(";")))
    for code, long in CC.items():
        short = code.replace("-", " ")
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            name(f"cc-{code}-{version.replace(' ', '.')}", f"cc {short} {version}", "cc", f"cc {short} {version}", 0.9)
            name(f"cc-{code}-{version.replace(' ', '.')}", f"cc {short} {version}", "commons", f"creative commons {long} {version}(?: international| unported| generic)?(?: public)?(?: {{L}})?", 0.9)
        name(f"cc-{code}", f"cc {short}", "cc", f"cc {short}(?! sa| nc| nd| \\d)", 0.7)
        name(f"cc-{code}", f"cc {short}", "commons", f"creative commons {long}(?: {{L}})?", 0.7)
    for line in TEXTS.strip().splitlines():
        label, keywords, pattern = (x.strip() for x in line.split(";"))
        add(label, 100, 1.0, keywords, pattern)
    return sorted(dict.fromkeys(out), key=lambda r: -r.priority)


class Scanner:
    def __init__(self):
        self.by_word: dict[bytes, list[Rule]] = {}
        for r in rules():
            self.by_word.setdefault(r.keyword, []).append(r)
        self.keywords = frozenset(self.by_word)
        self.blank = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

    def words(self, text: str) -> list[bytes]:
        """A-Z as small letters, then runs of what is no ASCII sign, blank or control."""
        return text.encode("utf-8").lower().translate(self.blank).split()

    def detect(self, words: list[bytes], line: bytes) -> list[tuple[int, int, Rule]]:
        """(start, end, rule) of the detections that stay: one within another of higher priority, or of the same and begun before or longer, goes."""
        found = []
        tried = {id(r.regex): r for word in self.keywords.intersection(words) for r in self.by_word[word]}
        for r in tried.values():
            found += [(m.start(), m.end(), r) for m in r.regex.finditer(line)]
        out: list[tuple[int, int, Rule]] = []
        for priority in sorted({d[2].priority for d in found}, reverse=True):
            starts, ends = [d[0] for d in out], list(accumulate((d[1] for d in out), max))
            reach = -1
            for a, b, r in sorted((d for d in found if d[2].priority == priority), key=lambda d: (d[0], -d[1], d[2].label)):
                k = bisect_right(starts, a)
                if b > reach and not (k and ends[k - 1] >= b):
                    out.append((a, b, r))
                    reach = b
            out.sort(key=lambda d: d[:2])
        return out

    def scan(self, text: str):
        """n_words, starts and labels of the base phrases, all labels, score."""
        words = self.words(text)
        line = b" " + b" ".join(words) + b" "
        starts, base = [], set()
        for phrase, label in BASE.items():
            at, known, n = line.find(b" %s " % phrase.encode()), 0, 0
            while at >= 0:
                n += line.count(b" ", known, at)
                known = at
                starts.append(n)
                base.add(label)
                at = line.find(b" %s " % phrase.encode(), at + 1)
        found = self.detect(words, line)
        score = max([0.95 * bool(base), *(r.confidence for _, _, r in found)])
        return len(words), starts, base, base | {r.label for _, _, r in found}, score


_scanner: list[Scanner] = []


def scanner() -> Scanner:
    if not _scanner:
        _scanner.append(Scanner())
    return _scanner[0]


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs, from whole texts.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lowered.
    A null or empty text has no words, no labels and the score 0. Equal and
    overlapping detections count once per label; rows are scanned one by one.
    """

    def run(batches):
        scan = scanner().scan
        for b in batches:
            rows = [scan(t.as_py()) for t in b["text"]]
            columns = [
                b["doc_id"],
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(r[1]) for r in rows], pa.int64()),
                pa.array([min(r[1], default=None) for r in rows], pa.int64()),
                pa.array([max(r[1], default=None) for r in rows], pa.int64()),
                pa.array([",".join(sorted(r[2])) for r in rows], pa.string()),
                pa.array([",".join(sorted(r[3])) for r in rows], pa.string()),
                pa.array([r[4] for r in rows], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    out = no_text_is_empty(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    return out.select(null_id(), *out.columns[1:])
