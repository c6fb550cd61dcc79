import random

import pytest

from spanforge.llm.components import components
from spanforge.llm.near_dup import jaccard_join

from .helpers import WORD, documents, prose


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def plain(texts, n=5, s=80):
    """texts: (id, text), ids ascending. All pairs."""
    sets = []
    for _, t in texts:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= s * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return [(texts[i][0], len(a), texts[root(i)][0]) for i, a in enumerate(sets)]


def family(seed, n, words=60, changes=3):
    """Near copies in chains and stars around one text."""
    r = random.Random(seed)
    out = [[f"w{r.randrange(400)}" for _ in range(words)]]
    while len(out) < n:
        x = list(r.choice(out))
        for _ in range(r.randrange(1, changes)):
            x[r.randrange(len(x))] = f"W{r.randrange(400)}"
        out.append(x if r.random() < 0.7 else x[: r.randrange(max(1, len(x) - 12), len(x) + 1)])
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("seed", [1, 2])
def test_rows(spark, seed):
    texts = [*prose(seed, 60), *family(seed, 60), *family(seed + 50, 40, 12), "a b", "A  b", "a b c d e"]
    random.Random(seed).shuffle(texts)
    got = sorted(map(tuple, jaccard_join(documents(spark, texts).repartition(4)).collect()))
    assert got == plain(list(enumerate(texts)))


def test_common_passage_and_many_copies(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"{passage} " + " ".join(f"x{k}y{i}" for i in range(40)) for k in range(120)]
    texts += [f"{passage} tail"] * 70 + [f"{passage} tail end {k}" for k in range(90)]
    got = sorted(map(tuple, jaccard_join(documents(spark, texts).repartition(4)).collect()))
    assert got == plain(list(enumerate(texts)))


def test_odd_tables(spark):
    assert jaccard_join(documents(spark, [])).collect() == []
    got = sorted(map(tuple, jaccard_join(documents(spark, [(4, "a b c d e f"), (4, "A b c d e f"), (4, "other"), (9, None), (8, " ")])).collect()))
    assert got == [(4, 1, 4), (4, 2, 4), (4, 2, 4), (8, 0, 8), (9, 0, 9)]
    got = jaccard_join(documents(spark, [(None, "a b"), (3, "a b")])).collect()
    assert sorted(str(tuple(r)) for r in got) == ["(3, 1, None)", "(None, 1, None)"]


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1200)] + [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(200)]
    up = {x: x for e in links for x in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: root(x) for e in links for x in e if e[0] != e[1]}
