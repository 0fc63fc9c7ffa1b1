"""Stateful streams, keyed by robot: rate limits, rolling windows, watchdogs, motor requests.

State is bounded: a rate limiter keeps one time, a watchdog one time and a flag, a rolling window the scans of its buffer. Late
rows beyond the watermark are dropped by Spark; within it, a row older than the newest never moves a clock back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import GridConfig, NavConfig, RobotLimits
from ..operators import grid
from ..sources.export import MOVE, STILL, STOP

NO, BY_EVENTS = GroupStateTimeout.NoTimeout, GroupStateTimeout.EventTimeTimeout


def rate_limited(events: DataFrame, by: str, stamp: str, tie: str, period: float) -> DataFrame:
    """Events at least `period` seconds after the last one let through, by key."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(frames).sort_values([stamp, tie])
        out = []
        for t, i in zip(rows[stamp], rows[tie]):
            if last is None or t - last >= period:
                out.append((key[0], t, i))
                last = t
        if last is not None:
            state.update((float(last),))
        yield pd.DataFrame(out, columns=[by, stamp, tie])

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    return events.groupBy(by).applyInPandasWithState(step, f"{by} {kinds[by]}, {stamp} {kinds[stamp]}, {tie} {kinds[tie]}", "last double", "append", NO)


def stop_after_gap(commands: DataFrame, by: str, at: str, gap: str) -> DataFrame:
    """One stop for each silence longer than `gap` (an interval): when it began, by key; emitted as the watermark passes."""
    w = F.session_window(at, gap)
    return commands.withWatermark(at, gap).groupBy(by, w.alias("w")).agg(F.count(F.lit(1)).alias("commands")).select(by, F.col("w.end").alias("stop_at"), "commands")


def motor_requests(commands: DataFrame, by: str, at: str, gap: float, delay: str = "0 seconds") -> DataFrame:
    """(by, stamp, api) of speeds (by, at, vx, vy, wz): a move for each, one stop when they come to rest, and one stop when none came
    for more than `gap` seconds (its stamp is when the gap was over), emitted as the watermark passes; never two stops in a row."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, stopped = state.get if state.exists else (None, False)
        out = []
        if state.hasTimedOut:
            if not stopped:
                out.append((key[0], last + gap, STOP))
            state.update((last, True))
        else:
            for r in pd.concat(frames).sort_values(at).itertuples():
                t = getattr(r, at).timestamp()
                if last is not None and not stopped and t - last > gap:
                    out.append((key[0], last + gap, STOP))
                    stopped = True
                still = max(abs(r.vx), abs(r.vy), abs(r.wz)) < STILL
                if not (still and stopped):
                    out.append((key[0], t, STOP if still else MOVE))
                last, stopped = max(t, last or t), still
            state.update((last, stopped))
            if not stopped:
                state.setTimeoutTimestamp(max(int((last + gap) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[by, "stamp", "api"])

    kinds = {f.name: f.dataType.simpleString() for f in commands.schema}
    return commands.withWatermark(at, delay).groupBy(by).applyInPandasWithState(step, f"{by} {kinds[by]}, stamp double, api int", "last double, stopped boolean", "append", BY_EVENTS)


def stale_scans(scans: DataFrame, by: str, at: str, timeout: float, delay: str = "0 seconds") -> DataFrame:
    """(by, stale_at): when a robot's newest scan became older than `timeout` seconds; once for each silence, as the watermark passes."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            out.append((key[0], state.get[0] + timeout))
            state.remove()
        else:
            times = sorted(t.timestamp() for f in frames for t in f[at])
            last = state.get[0] if state.exists else times[0]
            for t in times:
                if t - last > timeout:
                    out.append((key[0], last + timeout))
                last = max(last, t)
            state.update((last,))
            state.setTimeoutTimestamp(max(int((last + timeout) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[by, "stale_at"])

    kind = scans.schema[by].dataType.simpleString()
    return scans.withWatermark(at, delay).groupBy(by).applyInPandasWithState(step, f"{by} {kind}, stale_at double", "last double", "append", BY_EVENTS)


def rolling_buffers(scans: DataFrame, by: str, stamp: str, seconds: float) -> DataFrame:
    """Each scan (key, stamp, points) with the points of the scans in the last `seconds`: (key, stamp, scans, points)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stamps, counts = (list(x) for x in state.get) if state.exists else ([], [])
        out = []
        rows = pd.concat(frames).sort_values(stamp)
        for t, n in zip(rows[stamp], rows["points"]):
            kept = [(a, b) for a, b in zip(stamps, counts) if a >= t - seconds] + [(float(t), int(n))]
            stamps, counts = [a for a, _ in kept], [b for _, b in kept]
            out.append((key[0], t, len(kept), sum(counts)))
        state.update((stamps, counts))
        yield pd.DataFrame(out, columns=[by, stamp, "scans", "points"])

    kinds = {f.name: f.dataType.simpleString() for f in scans.schema}
    return scans.groupBy(by).applyInPandasWithState(step, f"{by} {kinds[by]}, {stamp} {kinds[stamp]}, scans long, points long", "stamps array<double>, counts array<bigint>", "append", NO)


def _window_cells(xyz: np.ndarray, x: float, y: float, nav: NavConfig) -> pd.DataFrame:
    """Cell statistics of the points in the window around a robot; row and col count from its corner."""
    half, n = nav.map_size / 2, int(np.ceil(nav.map_size / nav.resolution))
    xyz = xyz[(xyz[:, 2] >= nav.z_clip[0]) & (xyz[:, 2] <= nav.z_clip[1])]
    col, row = (np.floor((xyz[:, i] - (o - half)) / nav.resolution).astype(int) for i, o in ((0, x), (1, y)))
    ok = (col >= 0) & (col < n) & (row >= 0) & (row < n)
    d = pd.DataFrame({"row": row[ok].astype("int32"), "col": col[ok].astype("int32"), "z": xyz[ok, 2]})
    return d.assign(zz=d["z"] ** 2).groupby(["row", "col"], as_index=False).agg(n=("z", "size"), sz=("z", "sum"), szz=("zz", "sum"), zmin=("z", "min"), zmax=("z", "max"))


def rolling_cells(scans: DataFrame, by: str = "robot_id", nav: NavConfig = NavConfig()) -> DataFrame:
    """Cell statistics (by, stamp, row, col, n, sz, szz, zmin, zmax) of the window around the robot at each scan (by, stamp, px, py, xs, ys, zs).

    Points within `min_range` of the robot at their own scan are dropped; the scans of the last `buffer_s` seconds count, by the
    arriving scan's stamp. A scan whose buffer has no point in the window gives nothing, so a reader keeps the grid before.
    State is the buffer: the scans of a few seconds.
    """
    kinds = {f.name: f.dataType.simpleString() for f in scans.schema}
    columns = [by, "stamp", "row", "col", "n", "sz", "szz", "zmin", "zmax"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [(t, np.array(p, float).reshape(-1, 3)) for t, p in zip(*state.get)] if state.exists else []
        for r in pd.concat(frames).sort_values("stamp").itertuples():
            xyz = np.stack([np.asarray(c, float) for c in (r.xs, r.ys, r.zs)], 1).reshape(-1, 3)
            if nav.min_range > 0:
                xyz = xyz[(xyz[:, 0] - r.px) ** 2 + (xyz[:, 1] - r.py) ** 2 > nav.min_range**2]
            held = [(t, p) for t, p in [*held, (float(r.stamp), xyz)] if t >= r.stamp - nav.buffer_s and (nav.buffer_s > 0 or p is xyz)]
            cells = _window_cells(np.concatenate([p for _, p in held]), r.px, r.py, nav)
            if len(cells):
                yield cells.assign(**{by: key[0], "stamp": r.stamp})[columns]
        state.update(([t for t, _ in held], [p.ravel().tolist() for _, p in held]))

    out = f"{by} {kinds[by]}, stamp {kinds['stamp']}, row int, col int, n long, sz double, szz double, zmin double, zmax double"
    return scans.groupBy(by).applyInPandasWithState(step, out, "stamps array<double>, points array<array<double>>", "append", NO)


def rolling_grids(cells: DataFrame, robot: RobotLimits = RobotLimits(), nav: NavConfig = NavConfig()) -> DataFrame:
    """Terrain grids of rolling cells (a batch of them): a grid for each robot and scan, `grid_id` being a hash of both."""
    by = cells.columns[0]
    named = cells.withColumn("grid_id", F.xxhash64(by, "stamp"))
    d = grid.terrain(named, robot, GridConfig(resolution=nav.resolution, smooth_passes=nav.smooth_passes))
    return d.join(named.select("grid_id", by, "stamp").distinct(), "grid_id")


def grid_sink(write: Callable[[DataFrame, int], None], robot: RobotLimits = RobotLimits(), nav: NavConfig = NavConfig()) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch` on rolling cells: makes their terrain grids with the engine's operators and gives them to `write`."""
    return lambda batch, number: write(rolling_grids(batch, robot, nav), number)


def latest(rows: DataFrame, by: str, stamp: str, values: list[str]) -> DataFrame:
    """The newest row of each key, for a late subscriber (output mode complete or update)."""
    return rows.groupBy(by).agg(F.max_by(F.struct(stamp, *values), stamp).alias("v")).select(by, "v.*")
