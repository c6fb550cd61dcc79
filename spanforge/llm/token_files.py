"""Token-ID / binary output (8): Arrow files of fixed-size-list batches with masks, and an index of documents."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_repeat, no_text_is_empty, null_id, scratch, written
from .tokens import encoder

#: Ids in a sequence.
SEQUENCE = 2048
#: Sequences in a record batch: what a writer holds.
BATCH = 64
END = 0


class Writer:
    """An Arrow file of (ids, mask) batches of equal-length sequences; the last sequence is filled up with 0 and masked."""

    def __init__(self, path: str, length: int, small: bool):
        self.length, self.kind = length, np.dtype("<u2" if small else "<u4")
        fs, at = pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(at)
        fields = [("ids", pa.list_(pa.from_numpy_dtype(self.kind), length)), ("mask", pa.list_(pa.bool_(), length))]
        self.schema = pa.schema(fields)
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.held, self.n = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.n += len(ids)
        if self.n >= self.length * BATCH:
            self.flush(self.n // (self.length * BATCH) * BATCH)

    def flush(self, sequences: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, self.kind)
        most = self.length * BATCH
        for k in range(0, sequences * self.length, most):
            part = ids[k : min(k + most, sequences * self.length)]
            mask = np.ones(-(-len(part) // self.length) * self.length, bool)
            mask[len(part) :] = False
            part = np.pad(part, (0, len(mask) - len(part)))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (part, mask)]
            self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.held, self.n = [ids[sequences * self.length :]], max(0, self.n - sequences * self.length)

    def close(self) -> None:
        if self.n:
            self.flush(-(-self.n // self.length))
        self.file.close()
        self.out.close()


class Reader:
    """Random access to a file of Writer. A local file is mapped, so that ids are views of it."""

    def __init__(self, path: str):
        fs, at = pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)
        self.source = pa.memory_map(at) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(at)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.at, self.flat = -1, None

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence k."""
        batch, j = self.file.get_batch(k // BATCH), k % BATCH
        cut = slice(j * self.length, (j + 1) * self.length)
        return batch.column(0).values.to_numpy()[cut], batch.column(1).values.to_numpy(zero_copy_only=False)[cut]

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from place start of the file on."""
        most, out = self.length * BATCH, []
        while n:
            b, j = divmod(start, most)
            if b != self.at:
                self.at, self.flat = b, self.file.get_batch(b).column(0).values.to_numpy()
            out.append(self.flat[j : j + n])
            start, n = start + len(out[-1]), n - len(out[-1])
        return out[0] if len(out) == 1 else np.concatenate(out or [np.empty(0, "<u4")])


def write_tokens(docs: DataFrame, path: str, folder: str, end: int = END, sequence: int = SEQUENCE) -> DataFrame:
    """Writes the ids of docs, in order of doc_id, to Arrow files in `folder`; returns their index: doc_id, file, at, n_tokens, start.

    Each task has a range of ids and writes one file, of a name of its own for
    each attempt; only the files that the index names count. `at` is a place in
    the file, `start` one in all files together.
    """

    def write(batches):
        code = encoder(path, True)
        small = code.library.get_vocab_size() <= 1 << 16
        name, out, at = f"{folder}/{uuid.uuid4().hex}.arrow", None, 0
        for batch in batches:
            starts, sizes = [], []
            for text in batch["text"]:
                ids = np.frombuffer(code.ids(text.as_py()) + end.to_bytes(4, "little"), "<u4")
                out = out or Writer(name, sequence, small)
                out.add(ids)
                starts.append(at)
                sizes.append(len(ids))
                at += len(ids)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([name] * len(sizes)), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "file", "at", "n_tokens"])
        if out:
            out.close()

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = no_text_is_empty(docs)
    # a repeated id, or none, may hold most rows: then these are dealt by their texts too
    deal = ["doc_id", *([F.xxhash64("text")] if ids_repeat(rows) else [])]
    rows = rows.repartitionByRange(parts, *deal).sortWithinPartitions("doc_id", F.xxhash64("text"))
    index = written(rows.mapInArrow(write, "doc_id long, file string, at long, n_tokens long"))
    # one row per file, of which there is one per task
    files = index.groupBy("file").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.sum("n_tokens").alias("n")).collect()
    base, total = [], 0
    for f in sorted(files, key=lambda f: (f["first"], f["last"], f["file"])):
        base.append((f["file"], total))
        total += f["n"]
    bases = spark.createDataFrame(base, "file string, base long")
    return index.join(F.broadcast(bases), "file").select("doc_id", "file", "at", "n_tokens", (F.col("base") + F.col("at")).alias("start"))


def read_tokens(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of an index, from the files."""

    def read(batches):
        name, file = None, None
        for batch in batches:
            crc = []
            for f, at, n in zip(batch["file"].to_pylist(), batch["at"].to_pylist(), batch["n_tokens"].to_pylist()):
                if f != name:
                    name, file = f, Reader(f)
                crc.append(zlib.crc32(file.ids(at, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], batch["n_tokens"], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return index.repartition("file").sortWithinPartitions("file", "at").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end: int = END, sequence: int = SEQUENCE) -> DataFrame:
    """Writes docs as token files in the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text is the end id alone. Rows that repeat a doc_id stand
    side by side, in no order that a file's border would keep. An empty table gives no files
    and no rows.
    """
    out = read_tokens(write_tokens(docs, path, scratch(docs.sparkSession), end, sequence))
    return out.select(null_id(), "start", "n_tokens", "ids_crc32")
