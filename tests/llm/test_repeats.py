import hashlib

import pytest

from spanforge.llm import repeats
from spanforge.llm.substring_dedup import difference_cover, substring_dedup
from spanforge.llm.suffix_dedup import suffix_dedup

from .helpers import WORD, documents, prose


def runs(mask):
    return sum(m and not (i and mask[i - 1]) for i, m in enumerate(mask))


def plain_words(texts, window):
    """texts: (id, text) in order of id; windows of earlier ids count."""
    seen, out = {}, []
    lists = [[w.encode() for w in WORD.findall(t or "")] for _, t in texts]
    for k, w in enumerate(lists):
        for p in range(len(w) - window + 1):
            seen.setdefault(tuple(w[p : p + window]), k)
    for k, w in enumerate(lists):
        mask = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] < k:
                mask[p : p + window] = [True] * window
        out.append((texts[k][0], len(w), sum(mask), b" ".join(x for x, m in zip(w, mask) if not m)))
    return out


def plain_bytes(texts, window):
    seen, out = set(), []
    for i, t in texts:
        data = (t or "").encode()
        mask = [False] * len(data)
        for p in range(len(data) - window + 1):
            part = data[p : p + window]
            if part in seen:
                mask[p : p + window] = [True] * window
            seen.add(part)
        out.append((i, len(data), sum(mask), runs(mask), bytes(x for x, m in zip(data, mask) if not m)))
    return out




@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    texts = prose(seed, 80)
    got = sorted(map(tuple, substring_dedup(documents(spark, texts).repartition(5), 12, 7).collect()))
    assert [(*r[:3], bytes(r[3])) for r in got] == plain_words(list(enumerate(texts)), 12)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed):
    texts = prose(seed, 80)
    got = sorted(map(tuple, suffix_dedup(documents(spark, texts).repartition(5), 40, 12).collect()))
    assert [(*r[:4], bytes(r[4])) for r in got] == plain_bytes(list(enumerate(texts)), 40)


def test_production_parameters(spark):
    texts = prose(9, 60)
    docs = documents(spark, texts, first=-20)
    got = sorted(map(tuple, substring_dedup(docs).collect()))
    assert [(*r[:3], bytes(r[3])) for r in got] == plain_words(list(enumerate(texts, -20)), 50)
    got = sorted(map(tuple, suffix_dedup(docs).collect()))
    assert [(*r[:4], bytes(r[4])) for r in got] == plain_bytes(list(enumerate(texts, -20)), 100)


def test_many_contexts_of_one_passage(spark):
    """A passage in more documents than HEAVY, each with other words around."""
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(f"a{k}x{i}" for i in range(30)) + f" {passage} " + " ".join(f"b{k}x{i}" for i in range(20)) for k in range(3 * repeats.HEAVY)]
    got = sorted(map(tuple, substring_dedup(documents(spark, texts).repartition(2)).collect()))
    assert [(*r[:3], bytes(r[3])) for r in got] == plain_words(list(enumerate(texts)), 50)
    got = sorted(map(tuple, suffix_dedup(documents(spark, texts).repartition(2)).collect()))
    assert [(*r[:4], bytes(r[4])) for r in got] == plain_bytes(list(enumerate(texts)), 100)


def test_blocks_of_long_texts(spark):
    """One text of several blocks, with repeats across them."""
    unit = "".join(chr(97 + (i * i // 7) % 26) for i in range(997))
    long = "".join(unit[k % 500 :] + str(k) for k in range(2600))
    texts = [unit * 2, long, "é" * 50]
    got = sorted(map(tuple, suffix_dedup(documents(spark, texts)).collect()))
    assert [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in got] == [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in plain_bytes(list(enumerate(texts)), 100)]


def test_odd_tables(spark):
    text = " ".join(f"w{i}" for i in range(80))
    assert substring_dedup(documents(spark, [])).collect() == [] and suffix_dedup(documents(spark, [])).collect() == []
    rows = [(5, text), (5, text), (None, text), (7, None), (8, "")]
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["n_removed"]) for r in substring_dedup(documents(spark, rows)).collect()), key=str)
    assert got == sorted([(True, None, 0), (False, 5, 80), (False, 5, 80), (False, 7, 0), (False, 8, 0)], key=str)
    got = [r["n_removed"] for r in suffix_dedup(documents(spark, rows)).orderBy("n_removed").collect()]
    assert got == [0, 0, 0, len(text), len(text)]


@pytest.mark.parametrize("period", [2, 7, 13, 31, 40])
def test_difference_cover(period):
    cover = difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert len(cover) <= 2.3 * period**0.5 + 1


def test_rows_of_one_id(spark):
    """None of them has a smaller doc_id than another; a document's own earlier places count for bytes."""
    one, two = (" ".join(f"{c}{i}" for i in range(80)) for c in "wv")
    words = lambda rows: sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup(documents(spark, rows).repartition(3)).collect())
    assert words([(5, one), (5, one), (6, two)]) == [(5, 0), (5, 0), (6, 0)]
    assert words([(5, one), (5, f"x {one}"), (7, f"{two} {one}"), (7, f"{one} y")]) == [(5, 0), (5, 0), (7, 80), (7, 80)]
    got = lambda rows: sorted((r["doc_id"], r["n_removed"]) for r in suffix_dedup(documents(spark, rows).repartition(3)).collect())
    n = len(one)
    assert got([(5, one), (5, one), (6, two)]) == [(5, 0), (5, 0), (6, 0)]
    assert got([(5, one), (5, one + one), (9, one)]) == [(5, 0), (5, n), (9, n)]


def test_prefix_doubling(spark):
    """Every position ranked by pairs at growing offsets: the same rows as brute force."""
    texts = prose(5, 30)
    got = sorted(map(tuple, suffix_dedup(documents(spark, texts).repartition(3), 40, 12, method="doubling").collect()))
    assert [(*r[:4], bytes(r[4])) for r in got] == plain_bytes(list(enumerate(texts)), 40)
