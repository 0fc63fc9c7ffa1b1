"""The persistent map as a table, in versions, and as a single exchange file."""

from __future__ import annotations

import io
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

MAP_SCHEMA = "ix int, iy int, elevation float, class tinyint, weight int"


def _folder(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a folder, so that any store that Spark writes will do."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions in a map's folder, ascending: those whose writing was committed."""
    fs, p, jvm = _folder(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    found = [int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)", n))]
    return sorted(v for v in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/v{v}/_SUCCESS")))


def save_map(cells: DataFrame, path: str, version: int | None = None, keep: int = 2) -> int:
    """Write the map as a new version beside the old ones, and drop all but the newest `keep`; returns the version.

    A version counts only once its writing is committed, so a crash leaves the version before. Writing a version again that is
    whole already changes nothing.
    """
    spark = cells.sparkSession
    have = versions(spark, path)
    number = version if version is not None else (have[-1] + 1 if have else 0)
    if number not in have:
        cells.select("ix", "iy", cells["elevation"].cast("float").alias("elevation"), cells["class"].cast("tinyint").alias("class"), cells["weight"].cast("int").alias("weight")).write.mode("overwrite").parquet(f"{path}/v{number}")
        fs, _, jvm = _folder(spark, path)
        for old in sorted({*have, number})[:-keep]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/v{old}"), True)
    return number


def load_map(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version; an empty map if there is none."""
    have = versions(spark, path)
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/v{have[-1]}") if have else spark.createDataFrame([], MAP_SCHEMA)


def map_sink(path: str, refresh_radius: float | None = None) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`: folds each batch of local cells (as in `folded_map`) into the map at `path`, a version a batch.

    A query that starts anew goes on from the newest version, and a batch that runs again finds its version and changes nothing.
    """

    def fold(batch: DataFrame, number: int) -> None:
        from ..operators.fusion import folded_in_parts

        spark = batch.sparkSession
        have = versions(spark, path)
        if number + 1 in have or have and number + 1 < have[-1]:
            return
        save_map(folded_in_parts(batch, load_map(spark, path), refresh_radius), path, number + 1)

    return fold


def map_bytes(cells: DataFrame, resolution: float, revision: int, saved_at: float, most: int = 5_000_000) -> bytes:
    """A map of at most `most` cells as one compressed array file; larger ones stay tables."""
    rows = cells.select("ix", "iy", "elevation", "class", "weight").orderBy("iy", "ix").limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} cells: use save_map")
    out = io.BytesIO()
    np.savez_compressed(
        out, format_version=np.int16(1), resolution=np.float32(resolution), revision=np.int64(revision), saved_at=np.float64(saved_at), cells=rows[["ix", "iy"]].to_numpy("int32"),
        elevation=rows["elevation"].to_numpy("float32"), classes=rows["class"].to_numpy("uint8"), observations=np.minimum(rows["weight"], 65535).to_numpy("uint16"),
    )
    return out.getvalue()


def map_from_bytes(spark: SparkSession, raw: bytes) -> DataFrame:
    with np.load(io.BytesIO(raw), allow_pickle=False) as f:
        cells, *others = f["cells"], f["elevation"], f["classes"], f["observations"]
    if cells.ndim != 2 or cells.shape[1] != 2 or any(len(o) != len(cells) for o in others):
        raise ValueError("the arrays of a map file must be of equal length")
    rows = [(int(x), int(y), float(e), int(c), int(w)) for (x, y), e, c, w in zip(cells, *others)]
    return spark.createDataFrame(rows, MAP_SCHEMA)
