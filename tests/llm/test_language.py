import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from spanforge.llm import language
from spanforge.llm.codes import mix

BUCKETS, PER_LANGUAGE = 96, 15
WORDS = {"en": "the cat sat on a mat with its hat", "es": "el gato y la casa están aquí ñandú", "de": "über straße und öl der hund läuft"}


def plain_held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def plain_counts(text):
    """Bucket to count over all 1 to 3 character runs, one by one."""
    text, out = text.lower(), Counter()
    for n in (1, 2, 3):
        for k in range(len(text) - n + 1):
            key = 0
            for c in text[k : k + n]:
                key = key << 21 | ord(c)
            out[int(mix(np.array([key + n], np.uint64))[0]) % BUCKETS] += 1
    return out


def plain_softmax(s):
    e = [math.exp(x - max(s)) for x in s]
    return [x / sum(e) for x in e]


class Plain:
    """FTRL-proximal by its textbook update, one number at a time."""

    def __init__(self, learned, order):
        found = {i: plain_counts(t) for i, t, _ in learned}
        df = Counter(b for c in found.values() for b in c)
        self.idf = [math.log((1 + len(learned)) / (1 + df[b])) + 1 for b in range(BUCKETS)]
        self.names = sorted({lang for _, _, lang in learned})
        taken = [r for lang in self.names for r in sorted((r for r in learned if r[2] == lang), key=lambda r: order[r[0]])[:PER_LANGUAGE]]
        rows = [(self.features(found[i]), self.names.index(lang)) for i, _, lang in sorted(taken, key=lambda r: order[r[0]]) if found[i]]
        self.held = rows[::5]
        self.z = [[0.0] * len(self.names) for _ in range(BUCKETS)]
        self.n = [[0.0] * len(self.names) for _ in range(BUCKETS)]
        for _ in range(language.EPOCHS):
            for k, (x, y) in enumerate(rows):
                if k % 5:
                    self.learn(x, y)

    def features(self, counts):
        x = {b: math.log(1 + n) * self.idf[b] for b, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {b: v / norm for b, v in x.items()}

    def weight(self, b, c):
        z, n = self.z[b][c], self.n[b][c]
        if abs(z) <= language.L1:
            return 0.0
        return -(z - math.copysign(language.L1, z)) / ((language.BETA + math.sqrt(n)) / language.ALPHA + language.L2)

    def logits(self, x):
        return [sum(v * self.weight(b, c) for b, v in x.items()) for c in range(len(self.names))]

    def learn(self, x, y):
        p = plain_softmax(self.logits(x))
        for b, v in x.items():
            for c in range(len(self.names)):
                g, w = v * (p[c] - (c == y)), self.weight(b, c)
                sigma = (math.sqrt(self.n[b][c] + g * g) - math.sqrt(self.n[b][c])) / language.ALPHA
                self.z[b][c] += g - sigma * w
                self.n[b][c] += g * g

    def loss(self, temperature):
        spread, total = 1 / (len(self.held) + 2), 0.0
        for x, y in self.held:
            p = [math.log(q) for q in plain_softmax([s / temperature for s in self.logits(x)])]
            total -= (1 - spread) * p[y] + spread * sum(p) / len(p)
        return total / len(self.held)


def test_language_id_against_plain(spark):
    """The split, the sample, the weights, the temperature and every prediction against a plain version."""
    rng = random.Random(5)
    # words of the other languages among a text's own, so that not every score is near 1
    every = " ".join(WORDS.values()).split()
    rows = [(7 * i, " ".join(rng.choice(WORDS[lang].split() if rng.random() < 0.7 else every) for _ in range(rng.randint(1, 12))).title(), lang) for i, lang in enumerate(sorted(WORDS) * 50)]
    rows += [(3, "no language is given", None), (9, None, "en"), (11, "", "de"), (13, "12 !", "es"), (None, "the cat", "es")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.language_id(docs, BUCKETS, PER_LANGUAGE).collect()}
    assert {i: r["held_out"] for i, r in got.items()} == {i: plain_held(i) for i, _, _ in rows}

    learned = [r for r in rows if r[1] is not None and r[2] is not None and not plain_held(r[0])]
    assert min(Counter(r[2] for r in learned).values()) > PER_LANGUAGE
    order = {r["doc_id"]: (r["h"], r["doc_id"]) for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    plain = Plain(learned, order)
    model = language.fit(spark.createDataFrame(learned, docs.schema), BUCKETS, PER_LANGUAGE)
    assert model.languages == plain.names
    assert np.allclose(model.idf, plain.idf, atol=1e-12)
    assert np.allclose(model.w, [[plain.weight(b, c) for c in range(3)] for b in range(BUCKETS)], atol=1e-9)
    assert 0.02 < model.temperature < 20
    assert plain.loss(model.temperature) <= min(plain.loss(math.exp(k / 20)) for k in range(-78, 60)) + 1e-6

    for i, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        p = plain_softmax([s / model.temperature for s in plain.logits(plain.features(plain_counts(text)))])
        assert got[i]["lang_pred"] == plain.names[p.index(max(p))]
        assert abs(got[i]["score"] - max(p)) < 1e-6
