"""Best-fit packing (5): bins are planned over the histogram of lengths, then pieces take planned slots by rank."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import no_text_is_empty, null_id, written
from .tokens import encoder

#: Ids in a sequence at most.
CAPACITY = 4096
#: The id that ends a document.
END = 1
#: Pieces of one length are ranked in groups; a further group for each so many pieces in all.
PER_GROUP, LEAST_GROUPS = 1_000_000, 8


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first_rank, bins, each, first_bin, offset): the pieces of that length with ranks first_rank + i,
    i < bins * each, go to bin first_bin + i // each at offset + (i % each) * length.

    Best fit over lengths in descending order, a whole run of equal bins at a
    time: a piece goes to the fullest bin that has room for it. The histogram
    has `capacity` rows at most and each length splits at most two runs, so that
    the plan's size does not depend on the number of pieces.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # bins by room left: (first, number)
    rooms: list[int] = []
    opened, out = 0, []

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, n))

    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[i]
            else:
                room, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            each = min(room // length, left)
            bins = min(n, left // each)
            out.append((length, rank, bins, each, first, capacity - room))
            put(room - each * length, first, bins)
            put(room, first + bins, n - bins)
            rank += bins * each
            left -= bins * each
    return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece of every document; a document is its text's ids and `end`."""

    def cut(batches):
        ids_of = encoder(path, False).ids
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = memoryview(ids_of(text.as_py()) + end.to_bytes(4, "little"))
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    doc.append(i)
                    piece.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return no_text_is_empty(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(items: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """items, which have a `length` of 1 to capacity, with sequence_id and offset. order: what ranks items of one length."""
    spark = items.sparkSession
    n = items.count()
    group = F.pmod(F.xxhash64(*order), F.lit(LEAST_GROUPS + n // PER_GROUP))
    items = items.withColumn("_group", group)
    counts = written(items.groupBy("length", "_group").agg(F.count("*").alias("_n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # capacity rows at most
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_group")) - F.col("_n")).drop("_n")
    ranked = items.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_group").orderBy(*order)) - 1)
    ranked = ranked.join(before.hint("merge"), ["length", "_group"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_group", "_before")
    rows = np.array(plan(histogram, capacity), dtype=np.int64).reshape(-1, 6)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    sent = spark.sparkContext.broadcast(rows)  # bounded by the number of lengths, not of items
    names = [c for c in ranked.columns if c != "_rank"]

    def slot(batches):
        rows = sent.value
        key = rows[:, 0] << 48 | rows[:, 1]
        for batch in batches:
            length, rank = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            r = rows[np.searchsorted(key, length << 48 | rank, "right") - 1] if len(rank) else rows[:0]
            i = rank - r[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(r[:, 4] + i // np.maximum(r[:, 3], 1)), pa.array(r[:, 5] + i % np.maximum(r[:, 3], 1) * length)], [*names, "sequence_id", "offset"])

    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema}
    return ranked.mapInArrow(slot, ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs.

    Documents are encoded whole; only those of more than `capacity` ids are cut,
    into pieces of `capacity` ids, of which the last may be shorter. A null or
    empty text is one piece with the end id alone. Equal lengths are told apart
    by rank, so copies and repeated rows take a place each. An empty table gives
    no rows.
    """
    items = written(pieces(docs, path, capacity, end))
    out = pack(items, ["doc_id", "piece", "start"], capacity)
    return out.select(null_id(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
