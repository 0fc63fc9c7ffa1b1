"""Turning clouds upright: the up axis, the floor, and levelling by candidate planes."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def densest_bins(points: DataFrame, bins: int = 50) -> DataFrame:
    """For each axis (0 to 2) of (x, y, z): its range, the points in the densest of `bins` equal bins, and that bin (the first on ties)."""
    v = points.select(F.posexplode(F.array(*AXES)).alias("axis", "v"))
    r = F.broadcast(v.groupBy("axis").agg(F.min("v").alias("lo"), F.max("v").alias("hi")))  # three rows
    at = F.least(F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)).cast("int")
    h = v.join(r, "axis").groupBy("axis", "lo", "hi", F.coalesce(at, F.lit(0)).alias("bin")).count()
    return h.groupBy("axis", "lo", "hi").agg(F.max("count").alias("densest"), F.min_by("bin", F.struct(-F.col("count"), "bin")).alias("bin"))


def reoriented(points: DataFrame, bins: int = 50) -> DataFrame:
    """`points` with x and y along the two level axes and z as height over the floor. The up axis is the one with the densest bin
    (the first on ties); the floor is that bin's middle, and up is the longer side. Three rows come to the driver."""
    rows = sorted(densest_bins(points, bins).collect(), key=lambda r: (-r["densest"], r["axis"]))
    if not rows:
        return points
    up = rows[0]
    level = [AXES[i] for i in range(3) if i != up["axis"]]
    width = (up["hi"] - up["lo"]) / bins
    floor = up["lo"] + (up["bin"] + 0.5) * width
    sign = 1.0 if up["hi"] - floor >= floor - up["lo"] else -1.0
    height = F.lit(sign) * (F.col(AXES[up["axis"]]) - floor)
    return points.withColumns({"x": F.col(level[0]), "y": F.col(level[1]), "z": height})


def _distance(plane) -> F.Column:
    a, b, c, d = (float(v) for v in plane)
    return F.abs(a * F.col("x") + b * F.col("y") + c * F.col("z") + d)


def _through(p: np.ndarray) -> tuple[float, ...] | None:
    """The plane (unit normal and offset) of three points, or None if they are on a line."""
    n = np.cross(p[1] - p[0], p[2] - p[0])
    length = np.linalg.norm(n)
    return None if length < 1e-9 else (*(n / length), -float(n @ p[0] / length))


def refitted(points: DataFrame, planes: list[tuple[float, ...]], within: float = 0.05) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each plane the least-squares plane (normal, centre) of the points near it, and their number, in one pass of sums."""
    sums = []
    for i, p in enumerate(planes):
        near = _distance(p) < within
        sums += [F.count_if(near).alias(f"n{i}")]
        sums += [F.sum(F.when(near, F.col(a))).alias(f"{a}{i}") for a in AXES]
        sums += [F.sum(F.when(near, F.col(a) * F.col(b))).alias(f"{a}{b}{i}") for k, a in enumerate(AXES) for b in AXES[k:]]
    row = points.agg(*sums).first()
    out = []
    for i in range(len(planes)):
        n = row[f"n{i}"]
        if n < 3:
            continue
        mean = np.array([row[f"{a}{i}"] / n for a in AXES])
        cov = np.array([[row[f"{min(a, b)}{max(a, b)}{i}"] / n for b in AXES] for a in AXES]) - np.outer(mean, mean)
        out.append((np.linalg.eigh(cov)[1][:, 0], mean, n))
    return out


def rotation_to_z(n: np.ndarray) -> np.ndarray:
    """The rotation that takes a unit vector to z by the shortest way."""
    v, c = np.cross(n, (0.0, 0.0, 1.0)), float(n[2])
    if c < -1 + 1e-12:
        return np.diag([1.0, -1.0, -1.0])
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return np.eye(3) + k + k @ k / (1 + c)


def levelled(points: DataFrame, candidates: int = 300, refit: int = 30, within: float = 0.05, heights: tuple[float, float] = (0.15, 0.9), seed: int = 0, order: str = "pid") -> tuple[DataFrame, dict]:
    """`points` (order, x, y, z, in the sensor's frame) with the floor level at z = 0, and what was found: tilt in degrees, the sensor's
    height, inliers and the rotation.

    Planes through triples of a random sample of three times `candidates` points are ranked by the points within `within`, counted in
    one pass for all. The best `refit` are fitted anew; the floor is the first with the sensor at one of `heights` over it, else the
    largest. At last the mean of what stands near (over 50 points within 4 m, from 0.08 to 1.2 m high) is turned toward +x.
    """
    rng = np.random.default_rng(seed)
    rows = points.orderBy(F.xxhash64(order, F.lit(seed)), order).limit(3 * candidates).select(*AXES).collect()
    sample = np.array([tuple(r) for r in rows], float).reshape(-1, 3)
    if len(sample) < 3:
        raise ValueError("levelling needs three points")
    triples = [sample[rng.choice(len(sample), 3, replace=False)] for _ in range(candidates)]
    planes = [p for t in triples if (p := _through(t))]
    if not planes:
        raise ValueError("all points are on a line")
    counts = points.agg(*(F.count_if(_distance(p) < within).alias(str(i)) for i, p in enumerate(planes))).first()
    ranked = [planes[i] for i in sorted(range(len(planes)), key=lambda i: (-counts[i], i))]
    chosen = None
    for normal, centre, n in refitted(points, ranked[:refit], within):
        normal = -normal if -centre @ normal < 0 else normal
        found = (normal, centre, float(-centre @ normal), n)
        chosen = chosen or found
        if heights[0] <= found[2] <= heights[1]:
            chosen = found
            break
    normal, centre, height, n = chosen
    turn = rotation_to_z(normal)
    moved = _turned(points, turn, centre)
    near = (F.hypot("x", "y") < 4.0) & (F.col("z") > 0.08) & (F.col("z") < 1.2)
    ahead = moved.agg(F.count_if(near).alias("n"), *(F.avg(F.when(near, F.col(c))).alias(c) for c in "xy")).first()
    if ahead["n"] > 50:
        yaw = math.atan2(ahead["y"], ahead["x"])
        turn = np.array([[math.cos(yaw), math.sin(yaw), 0], [-math.sin(yaw), math.cos(yaw), 0], [0, 0, 1]]) @ turn
        moved = _turned(points, turn, centre)
    return moved, {"tilt_deg": math.degrees(math.acos(min(1.0, abs(normal[2])))), "height": height, "inliers": n, "rotation": turn}


def _turned(points: DataFrame, turn: np.ndarray, centre: np.ndarray) -> DataFrame:
    row = lambda r: reduce(lambda a, b: a + b, (float(r[i]) * (F.col(AXES[i]) - float(centre[i])) for i in range(3)))
    return points.withColumns(dict(zip(AXES, map(row, turn))))
