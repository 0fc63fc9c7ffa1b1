"""Token ids in Arrow IPC files of fixed-size-list batches (operator 9).

`write_ids` puts the ids of all documents, in ascending order of the key, end to end into sequences of equal length. Each
task writes one file of its stretch of the order and, beside it, an index of its documents; a file appears under its
name only when it is whole, so a task that runs again changes nothing. `read_ids` gives the documents back.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoded_batches
from .common import documents, file_system, new_path

#: Ids in a sequence, and sequences in a record batch.
LENGTH, BATCH = 1024, 128


@dataclass(frozen=True)
class Part:
    """One file: its number, its documents and ids, and the ids in the files before it."""

    number: int
    docs: int
    tokens: int
    base: int


class _Sequences:
    """Cuts a stream of ids into record batches of fixed-size lists and their masks."""

    def __init__(self, writer, dtype: np.dtype, length: int):
        self.writer, self.dtype, self.length, self.rest, self.have = writer, dtype, length, [], 0

    def add(self, packed: bytes) -> None:
        self.rest.append(packed)
        self.have += len(packed)
        if self.have >= self.length * BATCH * self.dtype.itemsize:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.rest), self.dtype)
        step = self.length * BATCH
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            self._put(ids[at : at + step])
        if last and whole < len(ids):
            self._put(ids[whole:])
            whole = len(ids)
        self.rest = [ids[whole:].tobytes()]
        self.have = len(self.rest[0])

    def _put(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        flat, mask = np.zeros(rows * self.length, self.dtype), np.zeros(rows * self.length, bool)
        flat[: len(ids)], mask[: len(ids)] = ids, True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=ids_schema(self.dtype, self.length)))


def ids_schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


class IdFile:
    """Random access to the ids of one file, without copies within a batch; a local file is memory-mapped."""

    def __init__(self, uri: str, length: int = LENGTH):
        from pyarrow import fs

        files, path = file_system(uri)
        self.file = pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)
        self.reader, self.step, self.length, self.kept = pa.ipc.open_file(self.file), length * BATCH, length, (-1, None, 0)

    def _batch(self, k: int) -> np.ndarray:
        """A batch's ids, of which the mask says how many are of documents."""
        if self.kept[0] != k:
            batch = self.reader.get_batch(k)
            mask = batch.column(1).values
            self.kept = (k, batch.column(0).values.to_numpy(), mask.true_count)
        return self.kept[1][: self.kept[2]]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from `start` to `stop`, counted from the file's first; beyond the last document's there are none."""
        parts = [self._batch(k)[max(start - k * self.step, 0) : stop - k * self.step] for k in range(start // self.step, -(-stop // self.step))]
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, "u2"), *parts])

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The i-th sequence and its mask, views of the file where it is mapped."""
        batch = self.reader.get_batch(i // BATCH)
        at = i % BATCH * self.length
        ids, mask = (batch.column(c).values.slice(at, self.length) for c in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def write_ids(df: DataFrame, uri: str, key: str = "doc_id", text: str = "text", vocab: str | None = None, end: int = 0, length: int = LENGTH) -> list[Part]:
    """Write the ids of all texts, with `end` after each document, into files in the folder `uri`; the files, in order.

    Ascending by `key`, nulls first; rows of one key in the order of their text's hash. A null or empty text is the end id
    alone. An empty table writes no file, repeated rows are written as often as they come, and other columns have no part.
    Only (file, documents, ids) of each file comes to the driver. Texts are sorted and then encoded: ids of two bytes are as large
    as the text where words are rare, and would have to be written before the ranges of keys are known.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.col(text).alias("__text"))
    rows = rows.repartitionByRange(parts, "key", "hash").sortWithinPartitions("key", "hash").select("key", "__text")

    def run(batches):
        from pyarrow.fs import FileType

        number, files, root = TaskContext.get().partitionId(), *file_system(uri)
        files.create_dir(root, recursive=True)
        names = [f"{root}/part-{number:06d}.{kind}.arrow" for kind in ("ids", "index")]
        hidden = [f"{root}/.{uuid.uuid4().hex}.{kind}" for kind in ("ids", "index")]
        writers, docs, tokens = None, 0, 0
        for slice_, packed, dtype in encoded_batches(batches, vocab, False, end):
            if writers is None:
                index = pa.schema([pa.field(key, slice_.schema.field(0).type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                sinks = [files.open_output_stream(h) for h in hidden]
                writers = [pa.ipc.new_file(s, x) for s, x in zip(sinks, (ids_schema(dtype, length), index))]
                out = _Sequences(writers[0], dtype, length)
            counts = np.array([len(p) // dtype.itemsize for p in packed], "int64")
            starts = tokens + np.cumsum(counts) - counts
            writers[1].write_batch(pa.RecordBatch.from_arrays([slice_.column(0), pa.array(starts), pa.array(counts)], schema=index))
            for p in packed:
                out.add(p)
            docs, tokens = docs + len(packed), tokens + int(counts.sum())
        if writers is None:
            return
        out.flush(True)
        for w, s, h, name in zip(writers, sinks, hidden, names):
            w.close()
            s.close()
            if files.get_file_info(name).type != FileType.NotFound:
                files.delete_file(name)
            files.move(h, name)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (number, docs, tokens)], ["number", "docs", "tokens"])

    found = sorted(tuple(r) for r in rows.mapInArrow(run, "number long, docs long, tokens long").collect())
    bases = accumulate((t for _, _, t in found), initial=0)
    return [Part(n, d, t, b) for (n, d, t), b in zip(found, bases)]


def read_ids(spark: SparkSession, uri: str, parts: list[Part], key_type: T.DataType, key: str = "doc_id", length: int = LENGTH, ids: bool = True) -> DataFrame:
    """Documents from the files: key, `start` among all ids, `n_tokens`, `ids_crc32` (as unsigned 32-bit integers) and, if wanted, `ids`.

    Rows come as they were written: nulls and repeats included, none from no files.
    """
    todo = spark.createDataFrame([(p.number, p.base) for p in parts], "number long, base long").repartition(max(1, len(parts)))
    fields = [T.StructField(key, key_type), *(T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32"))]
    schema = T.StructType([*fields, *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{uri}/part-{row['number']:06d}"
                file = IdFile(f"{name}.ids.arrow", length)
                files, path = file_system(f"{name}.index.arrow")
                index = pa.ipc.open_file(files.open_input_file(path))
                for k in range(index.num_record_batches):
                    b = index.get_batch(k)
                    starts, counts = (b.column(i).to_numpy() for i in (1, 2))
                    found = [file.ids(s, s + n).astype("<u4") for s, n in zip(starts.tolist(), counts.tolist())]
                    crcs = [zlib.crc32(x.tobytes()) for x in found]
                    columns = [b.column(0), pa.array(starts + row["base"]), b.column(2), pa.array(crcs, pa.int64())]
                    columns += [pa.array([x.astype("int32") for x in found], pa.list_(pa.int32()))] * ids
                    yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return todo.mapInArrow(run, schema)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and digest in the files written of all documents."""
    docs = documents(spark, sf_dir)
    uri = new_path(spark, "ids")
    return read_ids(spark, uri, write_ids(docs, uri), docs.schema["doc_id"].dataType, ids=False)


QUERIES = {"op9_token_files": op9_token_files}
