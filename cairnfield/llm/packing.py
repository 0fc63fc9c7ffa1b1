"""Packing documents into sequences by the shortest pack first over the histogram of lengths (operator 1).

Documents are cut into pieces of at most `size` ids. Only the histogram, at most `size` numbers whatever the input, comes to
the driver. It places lengths longest first, each into the packs that are filled least, and counts patterns of lengths.
A piece finds its sequence by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoded_batches, id_lists
from .common import buckets_for, documents, salted_rank, staged

SIZE = 1024


def patterns_of(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a sequence) and how many sequences have each; together they use the histogram up."""
    open_by_space: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = max((s for s, packs in open_by_space.items() if packs), default=0)
            if space >= length:
                pattern, count = open_by_space[space].pop()
                if count > left:
                    open_by_space[space].append((pattern, count - left))
            else:
                space, pattern, count = size, (), left
            taken = min(count, left)
            open_by_space[space - length].append(((*pattern, length), taken))
            left -= taken
    return [p for _, packs in sorted(open_by_space.items()) for p in packs]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Columns: length, first rank, first sequence, offset; sorted. A range of ranks of a length goes to equally many sequences."""
    rows, used, sequence = [], defaultdict(int), 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return np.array(sorted(rows), "int64").reshape(-1, 4)


def cut(df: DataFrame, key: str = "doc_id", text: str = "text", vocab: str | None = None, end: int | None = 0, size: int = SIZE, ids: bool = True) -> DataFrame:
    """Pieces of at most `size` ids of every whole text: key, start, length, ids_crc32, doc_tokens and, if wanted, `ids`.

    `end` closes each document, so that a null or empty text is one piece of that id; without `end` it has no piece.
    Repeated rows stay repeated, an empty table gives an empty one, other columns are left out.
    """
    numbers = ["start", "length", "ids_crc32", "doc_tokens"]
    schema = T.StructType([df.schema[key], *(T.StructField(c, T.LongType()) for c in numbers), *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids])

    def run(batches: Iterator[pa.RecordBatch]):
        for rows, packed, dtype in encoded_batches(batches, vocab, False, end):
            at, starts, lengths, crcs, totals, parts = [], [], [], [], [], []
            for i, p in enumerate(packed):
                n = len(p) // dtype.itemsize
                wide = np.frombuffer(p, dtype).astype("<u4").tobytes()
                for s in range(0, n, size):
                    at.append(i)
                    starts.append(s)
                    lengths.append(min(size, n - s))
                    totals.append(n)
                    crcs.append(zlib.crc32(wide[4 * s : 4 * (s + size)]))
                    if ids:
                        parts.append(p[dtype.itemsize * s : dtype.itemsize * (s + size)])
            columns = [rows.column(0).take(pa.array(at, pa.int32())), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))]
            yield pa.RecordBatch.from_arrays([*columns, *[id_lists(parts, dtype)] * ids], schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def pack(pieces: DataFrame, tie: list[str], length: str = "length", size: int = SIZE) -> DataFrame:
    """`pieces`, a written table, with sequence_id and offset. Pieces need lengths from 1 to `size`, a null one raises; `tie` orders
    those of one length, and nulls in it come first. Repeated rows are pieces of their own, an empty table gives an empty one;
    a column of the table that is named sequence_id or offset must be renamed before."""
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}
    if any(not 0 < (n or 0) <= size for n in histogram):
        raise ValueError(f"lengths must be from 1 to {size}")
    table = spark.sparkContext.broadcast(places(patterns_of(histogram, size)))
    buckets = max(256, buckets_for(sum(histogram.values())))
    ranked = salted_rank(pieces, [length], tie, F.pmod(F.xxhash64(*tie), F.lit(buckets)), "__rank")
    schema = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]):
        lengths, firsts, sequences, offsets = table.value.T
        keys = lengths << 40 | firsts
        for b in batches:
            rank = b.column(b.num_columns - 1).to_numpy()
            i = np.searchsorted(keys, b.column(b.schema.get_field_index(length)).to_numpy() << 40 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequences[i] + rank - firsts[i]), pa.array(offsets[i])], schema.names)

    return ranked.select(*pieces.columns, "__rank").mapInArrow(run, schema)


def packed_documents(docs: DataFrame) -> DataFrame:
    """All documents packed: a row for each piece, with its sequence and offset. A null or empty text is one piece, its end id;
    repeated rows are packed as often as they come, an empty table gives an empty one, other columns are left out."""
    return pack(staged(cut(docs, ids=False), "pieces"), ["doc_id", "start", "ids_crc32"])


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir))


QUERIES = {"op1_packing": op1_packing}
