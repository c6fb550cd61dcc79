"""Suffix-array dedup (2): repeated byte strings by hashes at sampled positions, in place of prefix doubling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .codes import BYTE_CODES, Runs
from .common import identified, own_ids, written
from .repeats import by_document, covered, repeated

#: Bytes of a string that counts as repeated, and of the runs ranked first.
WINDOW, RUN = 100, 32
#: Low bits of a packed rank that hold a position in a block.
PLACE_BITS = np.uint64(21)


def least_anchors(window: int, run: int):
    """Each window's anchor is the position in it of the run of least rank, the first of equals; so equal windows have theirs at the same place."""
    width = window - run + 1

    def anchors(codes: np.ndarray, runs: Runs):
        rank = runs.every(run)
        low = (rank >> PLACE_BITS << PLACE_BITS) | np.arange(len(rank), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if width > span:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        at = (low & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(at)] - 1
        return rank[at[first]], at[first], first, last

    return anchors


def text_codes(text: str) -> np.ndarray:
    return BYTE_CODES[np.frombuffer(text.encode("utf-8"), np.uint8)]


def doubled(rows: DataFrame, window: int, run: int) -> DataFrame:
    """doc_id, at as repeated() gives them, by prefix doubling over every byte position.

    All strings of `run` bytes are ranked first. A string of up to twice a
    length is the pair of ranks at its position and at a growing offset; Spark
    sorts the pairs, and each gets the rank of its first position, until the
    window is reached. Positions that are unique, or cross a document's end,
    drop out of each round. Every position goes through the shuffle with its
    rank, 44 times the text in all (README), which is why this is not the
    default.
    """

    def positions(batches):
        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"]):
                data = text.as_py().encode("utf-8")
                for lo in range(0, max(0, len(data) - run + 1), 1 << 16):
                    p = range(lo, min(lo + (1 << 16), len(data) - run + 1))
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(p), pa.int64()), pa.array(p, pa.int64()), pa.array([data[i : i + run] for i in p], pa.binary())], ["doc_id", "p", "key"])

    def ranked(found: DataFrame) -> DataFrame:
        same = Window.partitionBy("key")
        place = F.struct("doc_id", "p")
        out = found.withColumn("rank", F.min(place).over(same)).withColumn("last", F.max(place).over(same))
        return written(out.where("rank <> last").select("doc_id", "p", "rank"), large=True)

    ranks, length = ranked(rows.select("doc_id", "text").mapInArrow(positions, "doc_id long, p long, key binary")), run
    while length < window:
        step = min(length, window - length)
        second = ranks.select("doc_id", (F.col("p") - step).alias("p"), F.col("rank").alias("second"))
        ranks = ranked(ranks.join(second, ["doc_id", "p"]).select("doc_id", "p", F.struct("rank", "second").alias("key")))
        length += step
    return by_document(ranks.where(F.struct("doc_id", "p") > F.col("rank")).select("doc_id", "p", F.lit(1).alias("n")))


def suffix_dedup(docs: DataFrame, window: int = WINDOW, run: int = RUN, method: str = "anchors") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept for every row of docs; kept: the bytes that stay.

    A byte goes when a string of `window` bytes that covers it also starts
    earlier: in a document with a smaller doc_id, or in the same one before.
    Strings are judged on the input and never cross documents. A null text is
    empty. Rows that repeat a doc_id are documents of their own, of which none is
    earlier than another; null ids come first. An empty table gives no rows.

    method "doubling" ranks every position by prefix doubling (see doubled), for
    tables of different ids; "anchors" replaces it:

    Ranks are 64-bit hashes, which need no renumbering (128 bits in the last
    round). Doubling starts at runs of `run` bytes, at one position per window's
    least rank instead of all; positions that are unique drop out, the others go
    on to their whole context, to steps of nearly `window` bytes and at last to
    single strings of `window` bytes.
    """
    rows, back = identified(docs, lead=True)
    if method == "doubling" and back is not None:
        raise ValueError("prefix doubling needs different ids")
    ranges = doubled(rows, window, run) if method == "doubling" else repeated(rows, text_codes, least_anchors(window, run), window, within=True, steps=True)

    def remove(batches):
        for b in batches:
            n, gone, spans, kept = [], [], [], []
            for text, at in zip(b["text"], b["at"]):
                data = np.frombuffer(text.as_py().encode("utf-8"), np.uint8)
                mask = covered(len(data), at, window)
                n.append(len(data))
                gone.append(int(mask.sum()))
                spans.append(int((mask[1:] & ~mask[:-1]).sum() + mask[:1].sum()))
                kept.append(data[~mask].tobytes())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = rows.select("doc_id", "text").join(ranges, "doc_id", "left").mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return own_ids(out, back, "doc_id")
