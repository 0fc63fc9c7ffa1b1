"""Shared folder, written tables and salted ranks that the operators of this subpackage use."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a salted bucket of a rank should hold; the number of buckets follows the input.
ROWS_PER_BUCKET = 200_000
#: Records, and bytes of their texts, that a worker goes over at a time.
ARROW_RECORDS, SLICE_BYTES = 4096, 4 << 20

#: Keys that are joined by broadcast at most; a key is hot with more than one part in so many of the rows.
HOT = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or on a local master without it one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/cairnfield-shared"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared folder and read again: cuts lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more: what came of them is written itself."""
    for t in tables:
        if path := getattr(t, "_staged", None):
            p = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def file_system(uri: str):
    """pyarrow's file system for a path of the shared folder, and the path in it."""
    from pyarrow import fs

    if urlparse(uri).scheme:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), os.path.abspath(uri)


def slices(batches, records: int = ARROW_RECORDS, size: int = SLICE_BYTES, column: int = -1):
    """Stretches of Arrow batches with at most so many rows and, but for a single longer row, so many bytes in `column`, the last one.

    Spark bounds its batches by bytes, not by what a worker makes of them; so operators go over slices, and no session
    setting is touched.
    """
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.columns[column]), 0).to_numpy(zero_copy_only=False).astype("int64"))
        at, before = 0, 0
        while at < batch.num_rows:
            end = min(at + records, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(at, end - at)
            end = min(end, batch.num_rows)
            at, before = end, int(ends[end - 1])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `documents` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def buckets_for(rows: int) -> int:
    """Salt buckets for a ranked table of `rows` rows."""
    return max(16, min(1 << 16, rows // ROWS_PER_BUCKET + 1))


def joined(left: DataFrame, right: DataFrame, key: str, weight: str, rows: int) -> DataFrame:
    """Inner join by a key that is unique in `right`, whose column `weight` tells how many of at most `rows` rows of `left` have it.

    Keys with over a HOT-th of the rows, of which there are fewer than HOT, are broadcast; so no task gets more than that of one key.
    Null keys are in no result.
    """
    limit = rows // HOT
    hot, cold = F.broadcast(right.filter(F.col(weight) > limit)), right.filter(F.col(weight) <= limit)
    return left.join(hot, key).unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def salted_rank(df: DataFrame, by: list[str], order: list[str], salt: Column, out: str, total: str | None = None) -> DataFrame:
    """Adds `out`: the row's rank from 0 within `by`; rows of one key are dealt to the buckets of `salt`, so no task holds a hot key.

    Rows are in the order of (bucket, `order`). `total`, if named, gets the number of rows of the key. `df` must give
    the same rows whenever it is read (a table). Null keys count as one key.
    """
    d = df.withColumn("__bucket", salt)
    keys = [*by, "__bucket"]
    sums = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy(*by).orderBy("__bucket")
    before = sums.select(
        *(F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)),
        (F.sum("__n").over(over) - F.col("__n")).alias("__before"),
        F.sum("__n").over(Window.partitionBy(*by)).alias("__total"),
    )
    local = d.withColumn("__local", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    on = None
    for i, c in enumerate(keys):
        same = F.col(c).eqNullSafe(F.col(f"__k{i}"))
        on = same if on is None else on & same
    j = local.join(before, on, "left").withColumn(out, (F.col("__local") + F.col("__before")).cast("long"))
    if total:
        j = j.withColumn(total, F.col("__total"))
    return j.drop("__bucket", "__local", "__before", "__total", *(f"__k{i}" for i in range(len(keys))))
