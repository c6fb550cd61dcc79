"""Language ID (4): sparse multinomial logistic regression on TF-IDF character n-grams, trained with FTRL, then temperature calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .codes import mix
from .common import no_text_is_empty, null_id

#: Buckets of the hashed n-grams of 1 to MOST characters.
BUCKETS, MOST = 1 << 15, 3
#: Documents of each language, those of least hash of the id, that the weights are fitted on.
PER_LANGUAGE = 800
#: Parts that a language is dealt into when its sample is taken.
SALTS = 16
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.05, 0.01
#: Characters of a text hashed at once.
BLOCK = 1 << 20
UNKNOWN = "und"


def counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in the whole text."""
    out = np.zeros(buckets, np.int64)
    for k in range(0, len(text), BLOCK):
        c = np.frombuffer(text[k : k + BLOCK + MOST - 1].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        key = np.zeros(len(c), np.uint64)
        for n in range(1, MOST + 1):
            key = (key[: len(c) - n + 1] << np.uint64(21)) | c[n - 1 :]
            out += np.bincount((mix(key + np.uint64(n)) % np.uint64(buckets)).astype(np.int64), minlength=buckets)
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Model:
    """Weights by bucket and language, idf and temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf = languages, idf
        self.z = np.zeros((len(idf), len(languages)))
        self.n = np.zeros_like(self.z)
        self.bias = np.zeros(len(languages))
        self.temperature = 1.0
        self.w: np.ndarray | None = None

    def features(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = np.log1p(n) * self.idf[at]
        return x / max(1e-12, np.sqrt(x @ x))

    def weights(self, at) -> np.ndarray:
        """FTRL's weights: 0 where the gradients' sum stays under L1."""
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ (self.weights(at) if self.w is None else self.w[at])

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = x[:, None] * (softmax(x @ w) - (np.arange(len(self.languages)) == y))
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g

    def calibrate(self, logits: np.ndarray, y: np.ndarray) -> None:
        """The temperature of least log loss on rows that the weights weren't fitted on, by golden section over its logarithm.

        As in Platt's scaling, one row's worth of each label's mass is taken as spread over all labels, so that
        rows without a mistake don't drive the scores to 1.
        """
        spread = 1 / (len(y) + 2)

        def loss(t):
            s = logits / np.exp(t)
            s = s - s.max(1, keepdims=True)
            p = s - np.log(np.exp(s).sum(1, keepdims=True))
            return -((1 - spread) * p[np.arange(len(y)), y] + spread * p.mean(1)).mean()

        a, b, r = np.log(0.02), np.log(20), (5**0.5 - 1) / 2
        while b - a > 1e-3:
            c, d = b - r * (b - a), a + r * (b - a)
            a, b = (a, d) if loss(c) < loss(d) else (c, b)
        self.temperature = float(np.exp((a + b) / 2))

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        n = counts(text, len(self.idf))
        at = np.flatnonzero(n)
        p = softmax(self.logits(at, self.features(at, n[at])) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max())
    return e / e.sum()


def fit(rows: DataFrame, buckets: int = BUCKETS, per_language: int = PER_LANGUAGE) -> Model:
    """A model of every lang in rows (doc_id, text, lang), lang not null. Document frequencies cover all rows; the weights a sample of per_language of each.

    The driver holds the sample and two numbers a bucket and language, so its memory bounds the languages.
    """
    names = [r["lang"] for r in rows.select("lang").distinct().collect()]
    sample = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    # salted first, so that a language's last choice is among SALTS times per_language rows, whatever its share
    for keys in (["lang", F.pmod("h", F.lit(SALTS))], ["lang"]):
        sample = sample.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "doc_id"))).where(F.col("k") <= per_language).drop("k")
    chosen = F.broadcast(sample.select("doc_id", "lang", "h").distinct())  # per_language of each at most

    def frequencies(batches):
        df, n = np.zeros(buckets, np.int64), 0
        for b in batches:
            for text in b["text"]:
                df += counts(text.as_py(), buckets) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([*range(buckets), -1], pa.int32()), pa.array(np.r_[df, n])], ["bucket", "df"])

    def taken(batches):
        for b in batches:
            found = [counts(t.as_py(), buckets) for t in b["text"]]
            at = [np.flatnonzero(c).astype(np.int32) for c in found]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["lang"], b["h"], pa.array(at, pa.list_(pa.int32())), pa.array([c[i] for c, i in zip(found, at)], pa.list_(pa.int64()))], ["doc_id", "lang", "h", "at", "n"])

    df = {r["bucket"]: r["df"] for r in rows.select("text").mapInArrow(frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()}  # buckets + 1 rows
    total = df.get(-1, 0)
    model = Model(sorted(names), np.array([np.log((1 + total) / (1 + df.get(i, 0))) + 1 for i in range(buckets)]))
    data = rows.join(chosen, ["doc_id", "lang"]).select("doc_id", "lang", "text", "h").mapInArrow(taken, "doc_id long, lang string, h long, at array<int>, n array<long>").toPandas()
    data = data.sort_values(["h", "doc_id"], ignore_index=True)
    place = {lang: i for i, lang in enumerate(model.languages)}
    data = [(place[r.lang], np.asarray(r.at, np.int64), model.features(np.asarray(r.at, np.int64), np.asarray(r.n))) for r in data.itertuples() if len(r.at)]
    held = data[::5] if len(data) >= 20 else []
    for _ in range(EPOCHS):
        for i, (y, at, x) in enumerate(data):
            if not held or i % 5:
                model.learn(at, x, y)
    model.w = model.weights(slice(None))
    if held:
        model.calibrate(np.array([model.logits(at, x) for _, at, x in held]), np.array([y for y, _, _ in held]))
    model.z = model.n = None
    return model


def held_out(doc_id):
    """Whether crc32 of the id as text leaves 0 modulo 5; rows without an id are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def language_id(docs: DataFrame, buckets: int = BUCKETS, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang).

    Learned from rows with text and lang that are not held out, every lang of
    theirs; predicted from the whole text alone. `und` and 0 where a text has no letter or is null, and
    everywhere if there is nothing to learn from. Repeated rows count as often
    as they stand. An empty table gives no rows.
    """
    learned = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    sent = docs.sparkSession.sparkContext.broadcast(fit(learned, buckets, per_language))  # buckets times languages

    def predict(batches):
        model = sent.value
        for b in batches:
            got = [model.predict(t.as_py()) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = no_text_is_empty(docs, held_out(F.col("doc_id")).alias("held_out"))
    out = rows.select("doc_id", "held_out", "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
    return out.select(null_id(), "held_out", "lang_pred", "score")
