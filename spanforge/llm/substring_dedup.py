"""Substring dedup (9): anchors at difference-cover places of the words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .codes import Runs, word_codes, words
from .common import identified, own_ids
from .repeats import covered, repeated

#: Words in a window.
WINDOW = 50
#: Anchors stand at the cover's places modulo this.
PERIOD = 31


def difference_cover(period: int) -> list[int]:
    """Places modulo `period`, greedily chosen, among which any difference modulo `period` occurs."""
    found, missing = [0], set(range(1, period))
    while missing:
        gain = lambda x: len({d for y in found for d in ((x - y) % period, (y - x) % period)} & missing)
        best = max((x for x in range(period) if x not in found), key=lambda x: (gain(x), -x))
        missing -= {d for y in found for d in ((best - y) % period, (y - best) % period)}
        found.append(best)
    return sorted(found)


def cover_anchors(window: int, period: int):
    """For two equal windows some shift below `period` brings both to cover places, and the run there lies in both windows."""
    marks = np.zeros(period, bool)
    marks[difference_cover(period)] = True
    run = window - period + 1

    def anchors(codes: np.ndarray, runs: Runs):
        at = np.flatnonzero(np.resize(marks, max(0, len(codes) - run + 1)))
        return runs.every(run)[at], at, np.maximum(at - period + 1, 0), np.minimum(at, len(codes) - window)

    return anchors


def text_codes(text: str) -> np.ndarray:
    return word_codes(words(text))


def substring_dedup(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept for every row of docs; kept: the words that stay, joined by one space, as UTF-8.
    The columns in carry stand beside them.

    A word goes when a window that covers it also starts in a document with a
    smaller doc_id; windows are judged on the input. Documents with fewer words
    than a window lose nothing; null and empty texts have no words. Rows that
    repeat a doc_id are documents of their own, and lose nothing to each other;
    null ids come first. An empty table gives no rows. carry may not hold `lead`.
    """
    rows, back = identified(docs, *carry, lead=True)
    ranges = repeated(rows.drop(*carry), text_codes, cover_anchors(window, period), window, within=False, steps=False)

    def remove(batches):
        for b in batches:
            n, gone, kept = [], [], []
            for text, at in zip(b["text"], b["at"]):
                found = words(text.as_py())
                mask = covered(len(found), at, window)
                n.append(len(found))
                gone.append(int(mask.sum()))
                kept.append(b" ".join([w for w, g in zip(found, mask.tolist()) if not g] if gone[-1] else found))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()), *(b[c] for c in carry)], ["doc_id", "n_words", "n_removed", "kept", *carry])

    schema = StructType.fromDDL("doc_id long, n_words long, n_removed long, kept binary")
    schema = StructType([*schema.fields, *(rows.schema[c] for c in carry)])
    out = rows.drop("lead").join(ranges, "doc_id", "left").mapInArrow(remove, schema)
    return own_ids(out, back, "doc_id")
