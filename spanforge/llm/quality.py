"""Quality rules (3), native: text measures and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written

#: White space of the word rule.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Low bits of a packed window that hold its place.
PLACE_BITS = 24
#: Buckets of the two multinomials.
BUCKETS = 1 << 14
#: Trusted documents taken as the target, those with the smallest hash of their id.
TRUSTED = 20_000
#: A document stays if its mean log ratio per n-gram is at least this.
THRESHOLD = -0.08


def words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text."""
    return let(F.btrim(text, F.lit(SPACE)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")))


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def hashed(w: Column) -> Column:
    """64-bit hashes of the words of an array."""
    return F.transform(w, lambda x: F.xxhash64(x))


def repeated_words(h: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, h being the hashed words.

    Each window's 64-bit hash with its place in the low 24 bits is a long; once
    these are sorted, windows that may be equal are neighbours. The few that have
    such a neighbour are compared by whole hash, as are all windows of a text
    with 2**24 words or more. In order of place, each repeated window covers what
    the one after it leaves of its three words.
    """

    def covered(at):
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")))["n"]

    def twins(s):
        return F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)))

    def repeats(t, at):
        pairs = F.sort_array(F.transform(at, lambda i: F.struct(F.get(t, i).alias("h"), i.alias("i"))))
        return F.sort_array(F.transform(let(pairs, twins), lambda x: x["i"]))

    def near(t):
        packed = F.sort_array(F.transform(t, lambda x, i: F.shiftleft(F.shiftright(x, PLACE_BITS), PLACE_BITS) + i))
        place = lambda x: F.pmod(x, F.lit(1 << PLACE_BITS)).cast("int")
        pairs = lambda s: F.filter(F.transform(s, lambda x, k: F.when(F.shiftright(x, PLACE_BITS) == F.shiftright(F.get(s, k + 1), PLACE_BITS), F.array(place(x), place(F.get(s, k + 1))))), lambda x: x.isNotNull())
        return F.array_distinct(F.flatten(let(packed, pairs)))

    def count(t, at):
        return F.when(F.size(at) == 0, F.lit(0)).otherwise(covered(repeats(t, at)))

    windows = F.transform(F.slice(h, 3, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(F.get(h, i), F.get(h, i + 1), x))
    every = lambda t: F.sequence(F.lit(0), F.size(t) - 1)
    short = F.size(h) < 1 << PLACE_BITS
    return F.when(F.size(h) < 4, F.lit(0)).otherwise(let(windows, lambda t: let(F.when(short, near(t)).otherwise(every(t)), lambda at: count(t, at)))).cast("long")


def grams(h: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the words and word pairs, h being the hashed words."""
    one = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
    two = F.transform(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.pmod(F.xxhash64(F.get(h, i), x), F.lit(buckets)).cast("int"))
    return F.when(F.size(h) > 1, F.concat(one, two)).otherwise(one)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted: int = TRUSTED) -> DataFrame:
    """One row, weights: log p_target(bucket) / p_raw(bucket) by bucket, with one added to each count.

    Raw: every document. Target: the documents of labels with quality 1, at most
    `trusted` of them, by hash of the id; an id labelled 0 anywhere is none. No
    target gives weights of 0, which keep every document.
    """
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    good = F.broadcast(good.select("doc_id", F.lit(1).alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", let(hashed(words(text)), lambda h: grams(h, buckets)).alias("grams")).join(good, "doc_id", "left").select("good", F.explode_outer("grams").alias("bucket"))
    # explode_outer, as the filter that Spark infers for explode would build the array twice more
    counts = rows.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("target"))
    counts = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(counts), "bucket", "left").na.fill(0)
    # at most `buckets` rows from here on
    every = counts.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"), F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    ratio = F.transform("c", lambda x: F.log((x["target"] + 1) / (F.col("target") + buckets)) - F.log((x["raw"] + 1) / (F.col("raw") + buckets)))
    return written(every.select(F.when(F.col("target") > 0, ratio).otherwise(F.array_repeat(F.lit(0.0), buckets)).alias("weights")))


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted: int = TRUSTED, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, the text measures, base_failed, score and kept for every row of docs.

    score is the document's mean log ratio per n-gram; kept is false where
    base_failed, else score >= threshold. A null or empty text has no words and
    fails. Rows that repeat an id are judged one by one; an empty table gives no
    rows.
    """
    weights = fit(docs, labels, buckets, trusted).scalar()
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: without(x, SPACE) != "")
    # A subquery may not stand in a lambda as written; as a column used once, the optimizer puts it there.
    rows = docs.withColumn("_weights", weights).select(
        *keep,
        let(
            hashed(words(text)),
            lambda h: F.struct(
                F.size(h).cast("long").alias("n_words"),
                repeated_words(h).alias("n_repeat_words"),
                F.when(F.size(h) > 0, let(grams(h, buckets), lambda g: F.aggregate(g, F.lit(0.0), lambda s, b: s + F.get("_weights", b)) / F.size(g))).otherwise(0.0).alias("score"),
            ),
        ).alias("w"),
        F.length(without(text, SPACE)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    rows = rows.select(*keep, "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "w.score")
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
