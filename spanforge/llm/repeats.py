"""What substring dedup (9) and suffix-array dedup (2) share: finding the windows that stand earlier too.

A window is a run of `window` units (words or bytes) of one document, and counts
as repeated when the same run stands earlier. Anchors are places of which a
repeated window and its earlier copy have at least one in common; how they are
chosen is the operators' affair. Rounds with longer and longer runs drop what turns out to
be unique:

1. Anchors are grouped by the run at the anchor. One that stands alone is done.
2. Of an anchor group, those whose whole context (all windows that the anchor
   answers for) stands earlier are repeated as a whole. If the group has but one
   context, its first one is done.
3. What is left are first contexts of groups with several: places where copies
   begin, end or differ. Where each window has one anchor, its windows are cut,
   by their distance from it, into steps of STEP; a step goes through the same
   two rounds, its windows' common part being the run, which is nearly a window
   long.
4. Single windows of what is left then are grouped.

A map task folds equal keys among the rows it holds before they are shuffled,
and keys with many contexts there skip the first two rounds, so that neither
copies nor common passages make a large group: of a key that is not skipped, no
more than HEAVY contexts in each FOLD of rows come to the shuffle, which is a
share that a task can hold at any size.

Where documents share a table's id, they have a column `lead`, the id that
"earlier" is told by; rows of their own id are then not earlier than each other.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .codes import BASES, Runs, mix, signed
from .common import written

#: Units of a text worked on at once.
BLOCK = 1 << 20
#: Anchors or windows that a map task folds at once.
FOLD = 400_000
#: Contexts of one key among these from which the key skips the shuffle by key.
HEAVY = 64
#: Windows that a step of the third round holds at most.
STEP = 8
#: Kinds of rows in the shuffle by key.
PLAIN, MARKER, REPEATED, SHARED = 0, 1, 2, 3

Anchors = Callable[[np.ndarray, Runs], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def in_blocks(codes: np.ndarray, window: int):
    """(start, part) with all windows of the codes, each in one part."""
    for at in range(0, max(0, len(codes) - window + 1), BLOCK):
        yield at, codes[at : at + BLOCK + window - 1]


class Fold:
    """Columns of rows, gathered until there are FOLD of them."""

    def __init__(self, width: int):
        self.parts, self.n, self.width = [], 0, width

    def add(self, *columns: np.ndarray) -> bool:
        if len(columns[0]):
            self.parts.append(columns)
            self.n += len(columns[0])
        return self.n >= FOLD

    def take(self) -> list[np.ndarray]:
        out = [np.concatenate([p[i] for p in self.parts]) for i in range(self.width)] if self.parts else []
        self.parts, self.n = [], 0
        return out


def first_of(*keys: np.ndarray) -> np.ndarray:
    """For sorted rows, whether each is the first with its keys."""
    out = np.zeros(len(keys[0]), bool)
    if len(out):
        out[0] = True
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
    return out


def last_first(flags: np.ndarray) -> np.ndarray:
    """The place of the last flag at or before each place."""
    return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), 0))


GROUPED = "key long, ctx long, doc_id long, pn long"
#: Low bits of pn: kind, then the number of windows; the place stands above.
KIND_BITS, N_BITS = 2, 14


def earlier(new: np.ndarray, lead: np.ndarray, doc: np.ndarray, within: bool, *keys: np.ndarray) -> np.ndarray:
    """For rows sorted by keys, lead, doc and place, whether one before with the same keys counts as earlier; new: the first with its keys."""
    again = lead > lead[last_first(new)]
    return again | ~first_of(*keys, doc) if within else again


def grouped(fold: Fold, within: bool, led: bool = False) -> pa.RecordBatch:
    """Rows (key, ctx, doc_id, p, n, lead) with equal ones folded, as key, ctx, doc_id, pn and, if led, lead."""
    key, ctx, doc, p, n, lead = fold.take()
    order = np.lexsort((p, doc, lead, ctx, key) if led else (p, doc, ctx, key))
    key, ctx, doc, p, n, lead = (x[order] for x in (key, ctx, doc, p, n, lead))
    new_key, new_ctx = first_of(key), first_of(key, ctx)
    again = ~new_ctx if within and not led else earlier(new_ctx, lead, doc, within, key, ctx)
    starts = np.flatnonzero(new_key)
    heavy = np.repeat(np.add.reduceat(new_ctx, starts) > HEAVY, np.diff(np.r_[starts, len(key)]))
    kind = np.where(again, REPEATED, np.where(heavy, SHARED, PLAIN))
    mark = np.flatnonzero(new_key & heavy)
    pn = (p << N_BITS | n) << KIND_BITS
    columns = [np.where(kind >= REPEATED, key + ctx * np.uint64(BASES[0]) + doc.view(np.uint64) * np.uint64(BASES[1]), key), ctx, doc, pn | kind]  # rows that need no group go anywhere
    columns = [np.concatenate([c, m]) for c, m in zip([*columns, lead], (key[mark], ctx[mark], doc[mark], pn[mark] | MARKER, lead[mark]))][: 4 + led]
    return pa.RecordBatch.from_arrays([pa.array(signed(c) if i < 2 else c) for i, c in enumerate(columns)], ["key", "ctx", "doc_id", "pn", "lead"][: 4 + led])


def has_lead(docs: DataFrame) -> bool:
    return "lead" in docs.columns


def with_lead(schema: str, led: bool) -> str:
    return schema + ", lead long" * led


def identities(b: pa.RecordBatch) -> zip:
    """(doc_id, lead) of the rows of a batch."""
    ids = b["doc_id"].to_pylist()
    return zip(ids, b["lead"].to_pylist() if "lead" in b.schema.names else ids)


def anchor_rows(docs: DataFrame, codes_of, anchors: Anchors, window: int, within: bool) -> DataFrame:
    """The anchors of docs, each with the windows that it answers for."""

    def run(batches):
        fold = Fold(6)
        for b in batches:
            for (doc, lead), text in zip(identities(b), b["text"]):
                for lo, part in in_blocks(codes_of(text.as_py()), window):
                    runs = Runs(part)
                    key, at, first, last = anchors(part, runs)
                    # an anchor's place in its context is part of it
                    ctx = mix(runs(first, last + window) + (at - first).astype(np.uint64))
                    if fold.add(key, ctx, np.full(len(key), doc, np.int64), first + lo, last - first + 1, np.full(len(key), lead, np.int64)):
                        yield grouped(fold, within, led)
        if fold.n:
            yield grouped(fold, within, led)

    led = has_lead(docs)
    return docs.mapInArrow(run, with_lead(GROUPED, led))


def step_rows(docs: DataFrame, codes_of, anchors: Anchors, window: int, within: bool) -> DataFrame:
    """The steps of the anchors of docs whose first windows are in `at`."""

    def run(batches):
        fold = Fold(6)
        for b in batches:
            for (doc, lead), text, asked in zip(identities(b), b["text"], b["at"]):
                asked = asked.values.field("p").to_numpy()
                for lo, part in in_blocks(codes_of(text.as_py()), window):
                    runs = Runs(part)
                    _, at, first, last = anchors(part, runs)
                    chosen = np.isin(first + lo, asked)
                    at, first, last = at[chosen], first[chosen], last[chosen]
                    for back in range(0, int((at - first).max(initial=-1)) + 1, STEP):
                        a, z = np.maximum(first, at - back - STEP + 1), np.minimum(last, at - back)
                        ok = a <= z
                        x, a, z = at[ok], a[ok], z[ok]
                        key = mix(runs(x - back, x - back - STEP + 1 + window) + np.uint64(back))
                        ctx = mix(runs(a, z + window) + (x - a).astype(np.uint64))
                        if fold.add(key, ctx, np.full(len(key), doc, np.int64), a + lo, z - a + 1, np.full(len(key), lead, np.int64)):
                            yield grouped(fold, within, led)
        if fold.n:
            yield grouped(fold, within, led)

    led = has_lead(docs)
    return docs.mapInArrow(run, with_lead(GROUPED, led))


def stands_earlier(rows: DataFrame, within: bool, *keys: str) -> Column:
    """Whether a row of the plain ones stands behind another with the same keys."""
    plain, same = F.col("kind") == PLAIN, Window.partitionBy(*keys)
    if not has_lead(rows):
        place = F.struct("doc_id", "p") if within else F.col("doc_id")
        return plain & (place > F.min(F.when(plain, place)).over(same))
    later = F.col("lead") > F.min(F.when(plain, F.col("lead"))).over(same)
    if within:
        later = later | (F.col("p") > F.min(F.when(plain, F.col("p"))).over(Window.partitionBy(*keys, "doc_id")))
    return plain & later


def judged(rows: DataFrame, within: bool) -> DataFrame:
    """doc_id, p, n, again of grouped rows that stand earlier as a whole (again), or of whose key there are several contexts."""
    n = F.shiftright("pn", KIND_BITS).bitwiseAND(F.lit((1 << N_BITS) - 1)).cast("int")
    lead = ["lead"] if has_lead(rows) else []
    rows = rows.repartition("key").select("key", "ctx", "doc_id", *lead, F.shiftright("pn", KIND_BITS + N_BITS).alias("p"), n.alias("n"), F.col("pn").bitwiseAND(F.lit(3)).alias("kind"))
    group, plain = Window.partitionBy("key"), F.col("kind") == PLAIN
    rows = rows.withColumn("again", (F.col("kind") == REPEATED) | stands_earlier(rows, within, "key", "ctx"))
    several = (F.min("ctx").over(group) != F.max("ctx").over(group)) | F.max(F.col("kind") == MARKER).over(group)
    rows = rows.withColumn("shared", (F.col("kind") == SHARED) | (plain & several))
    return rows.where("again OR shared").select("doc_id", "p", "n", "again")


def window_rows(docs: DataFrame, codes_of, window: int, within: bool) -> DataFrame:
    """key, key2, doc_id, p, kind for each window in the ranges `at` (p, n) of docs."""

    def batch(fold):
        key, key2, doc, p, lead = fold.take()
        order = np.lexsort((p, doc, lead, key2, key) if led else (p, doc, key2, key))
        key, key2, doc, p, lead = (x[order] for x in (key, key2, doc, p, lead))
        again = earlier(first_of(key, key2), lead, doc, within, key, key2)
        key = np.where(again, key + doc.view(np.uint64) * np.uint64(BASES[1]), key)
        columns = [signed(key), signed(key2), doc, p, np.where(again, REPEATED, PLAIN).astype(np.int8), lead][: 5 + led]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["key", "key2", "doc_id", "p", "kind", "lead"][: 5 + led])

    def run(batches):
        fold = Fold(5)
        for b in batches:
            for (doc, lead), text, at in zip(identities(b), b["text"], b["at"]):
                codes = codes_of(text.as_py())
                asked = covered(len(codes), at, 1)
                for lo, part in in_blocks(codes, window):
                    p = np.flatnonzero(asked[lo : lo + len(part) - window + 1])
                    if len(p) and fold.add(Runs(part)(p, p + window), Runs(part, BASES[1])(p, p + window), np.full(len(p), doc, np.int64), p + lo, np.full(len(p), lead, np.int64)):
                        yield batch(fold)
        if fold.n:
            yield batch(fold)

    led = has_lead(docs)
    return docs.mapInArrow(run, with_lead("key long, key2 long, doc_id long, p long, kind byte", led))


def covered(n: int, at: pa.Scalar, window: int) -> np.ndarray:
    """Which of n units the windows of the ranges cover; at: list of (p, n), or null."""
    steps = np.zeros(n + 1, np.int32)
    ranges = at.values
    if ranges is not None and len(ranges):
        p, k = (ranges.field(c).to_numpy().astype(np.int64) for c in ("p", "n"))
        np.add.at(steps, p, 1)
        np.add.at(steps, np.minimum(p + k - 1 + window, n), -1)
    return np.cumsum(steps[:-1]) > 0


def by_document(ranges: DataFrame) -> DataFrame:
    """doc_id, at: a document's ranges (p, n); as many as the document is long at most."""
    return ranges.groupBy("doc_id").agg(F.collect_list(F.struct("p", F.col("n").cast("int").alias("n"))).alias("at"))


def repeated(docs: DataFrame, codes_of, anchors: Anchors, window: int, within: bool, steps: bool) -> DataFrame:
    """doc_id, at: the ranges of repeated windows of each document that has any.

    codes_of: a text to its units' codes. within: a window counts as repeated by
    an earlier place of its own document too, else only by documents with a
    smaller doc_id (lead, where docs has it); doc_id must be unique. steps: each window has one anchor, at
    or behind its start, so that the third round is of use.
    """
    found = [written(judged(anchor_rows(docs, codes_of, anchors, window, within), within), large=True)]
    if steps:
        left = docs.join(by_document(found[-1].where("NOT again")), "doc_id")
        found.append(written(judged(step_rows(left, codes_of, anchors, window, within), within), large=True))
    left = docs.join(by_document(found[-1].where("NOT again")), "doc_id")
    rows = window_rows(left, codes_of, window, within).repartition("key")
    rows = rows.withColumn("again", (F.col("kind") == REPEATED) | stands_earlier(rows, within, "key", "key2"))
    out = written(rows.where("again").select("doc_id", "p", F.lit(1).alias("n")), large=True)
    for f in found:
        out = out.unionByName(f.where("again").select("doc_id", "p", "n"))
    return by_document(out)
