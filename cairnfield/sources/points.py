"""Point files: one reader for each format, and a dispatcher by file name.

Files come through Spark's own binary and text readers, so any store that Spark reads will do. A file is decoded in slices,
so a worker holds one file's bytes and one slice of its points.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, pid long, x double, y double, z double, intensity double"
SLICE = 1 << 17
#: Scalar types by their names in a file's header (fixed values of the format).
PLY_TYPES = {
    "char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8",
    "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8",
}
#: Types by their codes in a message's fields (fixed values of the format).
FIELD_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}


def from_npy(raw: bytes, every: int = 1) -> np.ndarray:
    a = np.load(io.BytesIO(raw), allow_pickle=False)
    return np.atleast_2d(a)[::every].astype("float64")


def from_kitti(raw: bytes, every: int = 1) -> np.ndarray:
    if len(raw) % 16:
        raise ValueError("a point has four 32-bit numbers")
    return np.frombuffer(raw, "<f4").reshape(-1, 4)[::every].astype("float64")


def from_text(raw: bytes, every: int = 1, separator: str | None = None) -> np.ndarray:
    rows = [line.split(separator) for line in raw.decode().splitlines() if line.strip() and not line.lstrip().startswith("#")][::every]
    return np.array([[float(v) for v in r] for r in rows], "float64").reshape(len(rows), -1)


def from_pcd(raw: bytes, every: int = 1) -> np.ndarray:
    head, found, body = raw.partition(b"DATA")
    if not found or not body.lstrip().startswith(b"ascii"):
        raise ValueError("only ascii PCD files with a DATA line are read")
    lines = body.split(b"\n", 1)[1:] or [b""]
    rows = [line.split()[:3] for line in lines[0].decode().splitlines() if line.strip()][::every]
    return np.array(rows, "float64").reshape(len(rows), -1)


def from_ply(raw: bytes, every: int = 1) -> np.ndarray:
    """x, y, z of the vertices; elements before them are skipped by their size, so they can't have lists."""
    head, found, body = raw.partition(b"end_header")
    if not raw.startswith(b"ply") or not found:
        raise ValueError("no PLY header")
    body = body[2:] if body.startswith(b"\r\n") else body[1:]
    kind, elements = "", []
    for line in head.decode("ascii", "replace").splitlines():
        word = line.split()
        if word[:1] == ["format"]:
            kind = word[1]
        elif word[:1] == ["element"]:
            elements.append((word[1], int(word[2]), []))
        elif word[:1] == ["property"]:
            if not elements or word[1] == "list" and elements[-1][0] == "vertex":
                raise ValueError("a vertex can't have a list")
            elements[-1][2].append(("list", word[-1]) if word[1] == "list" else (PLY_TYPES[word[1]], word[2]))
    if kind not in ("ascii", "binary_little_endian", "binary_big_endian"):
        raise ValueError(f"unknown PLY format {kind!r}")
    at = 0
    lines = body.decode().splitlines() if kind == "ascii" else None
    for name, count, properties in elements:
        names = [p for _, p in properties]
        if name == "vertex":
            if missing := {"x", "y", "z"} - set(names):
                raise ValueError(f"a vertex lacks {sorted(missing)}")
            if lines is not None:
                return np.array([[float(v.split()[names.index(c)]) for c in "xyz"] for v in lines[at : at + count : every]], "float64").reshape(-1, 3)
            order = "<" if "little" in kind else ">"
            a = np.frombuffer(body, np.dtype([(p, order + t) for t, p in properties]), count, at)[::every]
            return np.stack([a[c].astype("float64") for c in "xyz"], 1)
        if lines is not None:
            at += count
        elif any(t == "list" for t, _ in properties):
            raise ValueError(f"element {name} before the vertices has a list")
        else:
            at += count * sum(np.dtype(t).itemsize for t, _ in properties)
    raise ValueError("no vertices")


def message_fields(data: bytes, fields: list[dict], point_step: int, row_step: int, width: int, height: int, big_endian: bool = False, names: tuple[str, ...] | None = None) -> np.ndarray:
    """The fields `names` (all of them, if None) of a packed cloud, as 32-bit floats by point; its message declares the fields
    (name, offset, datatype) and the padding of rows."""
    by = {f["name"]: f for f in fields}
    names = tuple(by) if names is None else names
    if missing := set(names) - set(by):
        raise ValueError(f"a point lacks {sorted(missing)}")
    order = ">" if big_endian else "<"
    kind = np.dtype({"names": list(names), "formats": [order + FIELD_TYPES[by[c]["datatype"]] for c in names], "offsets": [by[c]["offset"] for c in names], "itemsize": point_step})
    step = row_step or width * point_step
    rows = [np.frombuffer(data, kind, width, r * step) for r in range(height)] if width else []
    return np.concatenate([np.stack([a[c].astype("float32") for c in names], 1) for a in rows]) if rows else np.zeros((0, len(names)), "float32")


def from_message(data: bytes, fields: list[dict], point_step: int, row_step: int, width: int, height: int, big_endian: bool = False) -> np.ndarray:
    """Finite x, y, z of a packed cloud."""
    out = message_fields(data, fields, point_step, row_step, width, height, big_endian, ("x", "y", "z")).astype("float64")
    return out[np.isfinite(out).all(1)]


def decode_messages(messages: DataFrame, key: str = "scan_id") -> DataFrame:
    """Finite points (key, pid, x, y, z) of rows with packed clouds: data, fields (array of name, offset, datatype), point_step, row_step,
    width, height, big_endian. Rows without data give none."""
    columns = ["data", "fields", "point_step", "row_step", "width", "height", "big_endian"]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for i in range(b.num_rows):
                k, data, *rest = (b.column(j)[i].as_py() for j in range(b.num_columns))
                if data is None:
                    continue
                xyz = from_message(data, *rest)
                for at in range(0, len(xyz), SLICE):
                    part = xyz[at : at + SLICE]
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(part), b.schema.field(0).type), pa.array(np.arange(at, at + len(part))), *(pa.array(part[:, j]) for j in range(3))], [key, "pid", "x", "y", "z"])

    return messages.select(key, *columns).mapInArrow(run, f"{key} {messages.schema[key].dataType.simpleString()}, pid long, x double, y double, z double")


READERS = {".npy": from_npy, ".bin": from_kitti, ".pcd": from_pcd, ".ply": from_ply, ".xyz": from_text, ".txt": from_text, ".csv": lambda raw, every=1: from_text(raw, every, ",")}


def decode(path: str, raw: bytes, every: int = 1) -> np.ndarray:
    """Every k-th point of a file by its extension; at least three columns. What is left out of binary files is never decoded."""
    ext = os.path.splitext(path)[1].lower()
    if ext not in READERS:
        raise ValueError(f"no reader for {ext!r} files")
    a = READERS[ext](raw, every)
    if len(a) and a.shape[1] < 3:
        raise ValueError("a point needs x, y and z")
    return a.reshape(len(a), -1)


def read_points(spark: SparkSession, path: str, every: int = 1) -> DataFrame:
    """Points of the file or files at `path`: (path, pid, x, y, z, intensity); with `every`, each file's every k-th point."""
    ext = os.path.splitext(path.rstrip("/*"))[1].lower()
    if ext and ext not in READERS:
        raise ValueError(f"no reader for {ext!r} files")
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for name, raw in zip(b.column(0), b.column(1)):
                a = decode(name.as_py(), raw.as_py(), max(1, every))
                for at in range(0, len(a), SLICE):
                    part = a[at : at + SLICE]
                    extra = pa.array(part[:, 3]) if part.shape[1] > 3 else pa.nulls(len(part), pa.float64())
                    pids = np.arange(at, at + len(part)) * max(1, every)
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(part)), pa.array(pids), *(pa.array(part[:, i]) for i in range(3)), extra], ["path", "pid", "x", "y", "z", "intensity"])

    return files.mapInArrow(run, SCHEMA)


def read_video(spark: SparkSession, path: str) -> DataFrame:
    """Points of recorded videos (array files with pts, offsets, stamps and poses): (path, frame, stamp, pid, x, y, z, pose). `pose` is the
    robot's place and quaternion; frames without points have no rows. Offsets must rise from 0 to the number of points."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = ["path", "frame", "stamp", "pid", "x", "y", "z", "pose"]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for name, raw in zip(b.column(0), b.column(1)):
                with np.load(io.BytesIO(raw.as_py()), allow_pickle=False) as f:
                    pts, offsets, stamps, poses = (f[k] for k in ("pts", "offsets", "stamps", "poses"))
                if len(offsets) != len(stamps) + 1 or len(poses) != len(stamps) or offsets[0] != 0 or offsets[-1] != len(pts) or (np.diff(offsets) < 0).any():
                    raise ValueError(f"{name.as_py()}: frames, stamps and poses don't fit the points")
                for k in range(len(stamps)):
                    for at in range(int(offsets[k]), int(offsets[k + 1]), SLICE):
                        part = pts[at : min(at + SLICE, int(offsets[k + 1]))].astype("float64")
                        n = len(part)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name.as_py()] * n), pa.array([k] * n, pa.int32()), pa.array([float(stamps[k])] * n), pa.array(np.arange(at, at + n)), *(pa.array(part[:, j]) for j in range(3)), pa.array([poses[k].astype("float64").tolist()] * n)], names
                        )

    return files.mapInArrow(run, "path string, frame int, stamp double, pid long, x double, y double, z double, pose array<double>")


def scene(spark: SparkSession, points: int = 40_000, seed: int = 0) -> DataFrame:
    """A made-up scene of 10 by 10 metres: rising ground, two walls, a curb and a ramp."""
    d = spark.range(points).select(F.col("id").alias("pid"), (10 * F.rand(seed)).alias("x"), (10 * F.rand(seed + 1)).alias("y"), F.randn(seed + 2).alias("e"), F.rand(seed + 3).alias("h"))
    wall = (F.col("x").between(3, 3.6) & F.col("y").between(2, 7)) | (F.col("x").between(6, 6.6) & F.col("y").between(0, 5.5))
    ramp = F.col("x").between(7.5, 9.5) & F.col("y").between(6, 8)
    ground = 0.04 * F.col("x")
    z = (
        F.when(wall, 0.8 * F.col("h"))
        .when(F.col("x").between(1, 9) & F.col("y").between(8.6, 9), 0.12 + 0.01 * F.col("e"))
        .when(ramp, ground + 0.10 * (F.col("x") - 7.5) + 0.01 * F.col("e"))
        .otherwise(ground + 0.02 * F.col("e"))
    )
    return d.select(F.lit(0).cast("long").alias("grid_id"), "pid", "x", "y", z.alias("z"))
