import random
import re
from re import _parser

import numpy as np
import pytest

from spanforge.llm import quality
from spanforge.llm.exact_dedup import exact_dedup
from spanforge.llm.language import fit, language_id
from spanforge.llm.licenses import BASE, Scanner, license_scan, rules, scanner

from .helpers import WORD, documents, prose
from collections import Counter

from pyspark.sql import functions as F


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def measures(t):
    t = t or ""
    w = WORD.findall(t)
    tri = list(zip(w, w[1:], w[2:]))
    n = Counter(tri)
    again = {i + k for i, x in enumerate(tri) if n[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def test_quality_measures_and_verdict(spark):
    texts = [*prose(4, 50), "a b c a b c a b c " * 30, "x\ny\nx\n \n x\n\n", "a  b\x0b#|c", "tic tac toe " + " ".join(f"w{i}" for i in range(60)) + " tic tac toe", " ".join("##%$" for _ in range(80))]
    docs = documents(spark, texts)
    marks = labels(spark, [(i, int(i % 2), 0) for i in range(40)] + [(2, 1, 0), (2, 0, 0), (None, 1, 0)])
    got = {r["doc_id"]: r for r in quality.quality_rules(docs, marks, 256).collect()}
    assert len(got) == len(texts)
    hashes = {r["doc_id"]: r["g"] for r in docs.select("doc_id", quality.let(quality.hashed(quality.words(F.coalesce("text", F.lit("")))), lambda h: quality.grams(h, 256)).alias("g")).collect()}
    raw, target = np.zeros(256), np.zeros(256)
    for i, g in hashes.items():
        c = np.bincount(np.array(g, int), minlength=256)
        raw += c
        target += c * (i < 40 and i % 2 == 1)
    weights = np.log((target + 1) / (target.sum() + 256)) - np.log((raw + 1) / (raw.sum() + 256))
    for i, t in enumerate(texts):
        r, m = got[i], measures(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == m
        assert len(hashes[i]) == max(0, 2 * m[0] - 1)
        assert r["base_failed"] == (m[0] < 50 or 2 * m[4] > m[0])
        score = weights[np.array(hashes[i], int)].mean() if hashes[i] else 0
        assert abs(r["score"] - score) < 1e-9
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)


def test_quality_odd_tables(spark):
    none = labels(spark, [])
    assert quality.quality_rules(documents(spark, []), none).collect() == []
    got = quality.quality_rules(documents(spark, [(1, None), (1, "w " * 60), (None, " ".join(f"w{i}" for i in range(70)))]), none).orderBy("n_words").collect()
    assert [(r["doc_id"], r["kept"], r["score"]) for r in got] == [(1, False, 0.0), (1, False, 0.0), (None, True, 0.0)]


def test_quality_falls_back_to_whole_hashes(spark, monkeypatch):
    """With few place bits, long texts and windows that differ in high bits only take the other ways."""
    monkeypatch.setattr(quality, "PLACE_BITS", 5)
    texts = prose(8, 40)
    got = documents(spark, texts).select("doc_id", quality.let(quality.hashed(quality.words(F.coalesce("text", F.lit("")))), quality.repeated_words).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {i: measures(t)[4] for i, t in enumerate(texts)}


@pytest.mark.parametrize("digest", [None, lambda c: F.pmod(F.crc32(c.cast("binary")), F.lit(3)).cast("string")])
def test_exact_dedup(spark, digest):
    """Also with a digest that many texts share."""
    texts = [*prose(2, 60), "a \t b", "a b", "a\nb", " a b", "A b"]
    random.Random(1).shuffle(texts)
    got = exact_dedup(documents(spark, texts), **({"digest": digest} if digest else {})).collect()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    groups = {}
    for i, t in enumerate(norm):
        groups.setdefault(t, []).append(i)
    assert sorted(tuple(r)[:4] for r in got) == [(i, groups[t][0], len(groups[t]), groups[t][0] == i) for i, t in enumerate(norm)]


def test_exact_dedup_odd_tables(spark):
    assert exact_dedup(documents(spark, [])).collect() == []
    got = exact_dedup(documents(spark, [(None, "x"), (4, "x"), (4, "x"), (None, "y"), (7, None), (6, "")])).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in got) == [("4", "4", 3, False), ("4", "4", 3, True), ("6", "6", 2, True), ("7", "6", 2, False), ("None", "4", 3, False), ("None", "None", 1, True)]


def test_license_base(spark):
    texts = ["It is UNDER the MIT-License.", "under the mit license under the mit license", "cc by nc, CC/BY\nNC cc by ncx", "the apache license; version 2.0", "ünder the mit license", "under  the mit license\x7f", "comitted", None, "", *prose(1, 10)]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in license_scan(documents(spark, texts)).collect():
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r["doc_id"]] or "")
        w = word.findall(t)
        at = [(i, x) for p, x in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min([i for i, _ in at], default=None), max([i for i, _ in at], default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert set(r["base_labels"].split(",")) <= {*r["labels"].split(","), ""} and 0 <= r["score"] <= 1


def test_license_rules():
    assert len(rules()) > 300
    s = scanner()
    found = lambda t: s.scan(t)[3]
    assert found("SPDX-License-Identifier: GPL-3.0-only") == {"gpl-3"}
    assert found("licensed under the GNU Lesser General Public License v2.1") == {"lgpl-2.1"}
    assert found("Creative Commons Attribution-ShareAlike 4.0 International License") == {"cc-by-sa-4.0"}
    assert found("Mozilla Public License, version 2.0 and the ISC license") == {"mpl-2.0", "isc"}
    assert found("a person of no license at all") == set()
    # the plain way round: each detection against each
    line = s.words("released under the terms of the GNU General Public License version 2 and the MIT license, or GPL v3")
    text = b" " + b" ".join(line) + b" "
    every = sorted(((m.start(), m.end(), r) for r in rules() if r.keyword in line for m in r.regex.finditer(text)), key=lambda d: (-d[2].priority, d[0], -d[1], d[2].label))
    kept = []
    for a, b, r in every:
        if not any(x <= a and b <= y for x, y, _ in kept):
            kept.append((a, b, r))
    assert sorted(d[:2] for d in kept) == [d[:2] for d in s.detect(line, text)]


def spelled(parsed):
    """What a parsed regex matches, each optional or repeated part left out or once, look-aheads left out."""
    out = [""]
    for op, x in parsed:
        op = str(op)
        if op == "LITERAL":
            forms = [chr(x)]
        elif op == "IN":
            forms = ["z"] if any(str(o) == "CATEGORY" for o, _ in x) else [chr(c) for _, c in x]
        elif op == "BRANCH":
            forms = [f for b in x[1] for f in spelled(b)]
        elif op == "SUBPATTERN":
            forms = spelled(x[3])
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            forms = [f * k for k in {x[0], max(x[0], 1)} for f in (spelled(x[2]) if k else [""])]
        else:
            assert op in ("ASSERT", "ASSERT_NOT")
            forms = [""]
        out = [a + f for a in out for f in forms]
    return out


def test_license_prefilter_loses_nothing():
    s, every = scanner(), rules()
    found = lambda t: s.scan(t)[3]
    for t, label in [("licensed under GPLv2", "gpl-2"), ("LGPLv2.1", "lgpl-2.1"), ("AGPLv3", "agpl-3"), ("MPLv2.0", "mpl-2.0"), ("the X11 License", "mit"), ("FreeBSD License", "bsd-2-clause"), ("Zero-Clause BSD", "bsd-0-clause"), ("Common Development and Distribution License 1.0", "cddl-1.0"), ("European Union Public Licence", "eupl-1.2"), ("Open Software License v3.0", "osl-3.0"), ("Q Public License", "qpl-1.0")]:
        assert label in found(t), t
    # every form of every regex, which the sentences and the bare names have all alternatives of, with and without the words
    unfiltered = Scanner()
    unfiltered.keywords, unfiltered.by_word = frozenset([b"q7"]), {b"q7": every}
    for r in {id(r.regex): r for r in every if r.priority in (50, 100)}.values():
        for t in spelled(_parser.parse(r.regex.pattern.decode())):
            words = s.words(t)
            if r.regex.search(b" " + b" ".join(words) + b" "):
                assert {q.keyword for q in every if q.regex is r.regex} & set(words), t
    for t in ["Licensed under GPLv3 or LGPLv2.1, see the Expat License", "open data commons attribution license and the beer ware license", "openrail, open rail m license", "llama3 community license", "do what the fudge you want to public license", *prose(2, 20)]:
        line = b" " + b" ".join(s.words(t or "")) + b" "
        assert [d[:2] + d[2][:3] for d in s.detect(s.words(t or ""), line)] == [d[:2] + d[2][:3] for d in unfiltered.detect([b"q7"], line)]


def test_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and held
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_id_odd_tables(spark):
    assert language_id(documents(spark, [])).collect() == []
    rows = [(i, ["the cat sat on the mat", "el gato y la casa"][i % 2] + f" {i}") for i in range(60)]
    docs = documents(spark, [*rows, (100, None), (101, "123 !"), (None, "the cat"), (1, "el perro")]).withColumn("lang", F.when(F.col("doc_id") == 3, None).when(F.col("doc_id") % 2 == 0, "en").otherwise("es"))
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id(docs).collect()}
    assert {(100, "und"), (101, "und"), (None, "en"), (4, "en"), (5, "es")} <= got
    assert {r["lang_pred"] for r in language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_id_learns_every_language(spark):
    # 230 languages of five texts, each with a letter of its own
    rows = [(5 * i + k, chr(0x4E00 + i) * (k + 4), f"l{i:03}") for i in range(230) for k in range(5)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 1 << 13)
    assert model.languages == [f"l{i:03}" for i in range(230)]
    assert np.mean([model.predict(chr(0x4E00 + i) * 6)[0] == f"l{i:03}" for i in range(230)]) > 0.95
