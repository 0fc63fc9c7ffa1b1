"""Closed-loop runs: a robot that sees only what is near drives over a grid by replanning and following its path."""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import NavConfig
from .graph import CROSS, _costs, _flood, dealt, least_cost

Cell = tuple[int, int]


def nearest_free(cost: dict[Cell, float], cell: Cell, radius: int) -> Cell | None:
    """The free cell nearest by the larger of both distances, below `radius`; first by row and column on ties."""
    for k in range(radius):
        ring = [(cell[0] + dr, cell[1] + dc) for dr in range(-k, k + 1) for dc in range(-k, k + 1) if max(abs(dr), abs(dc)) == k]
        if found := next((c for c in ring if c in cost), None):
            return found
    return None


@dataclass
class Navigator:
    """One robot's goal, path and clock, with the same decisions as `navigate.replanned` and `motion.command`."""

    nav: NavConfig
    goal: tuple[float, float] | None
    path: list[tuple[float, float]] = field(default_factory=list)
    seen_at: float = -math.inf
    status: str = "waiting for goal"

    def replan(self, cost: dict[Cell, float], x: float, y: float, now: float) -> None:
        """A path over the cells that are known to be free, as they were seen now."""
        nav, res = self.nav, self.nav.resolution
        self.seen_at, self.path = now, []
        if self.goal is None:
            return
        cell = lambda px, py: (math.trunc(py / res), math.trunc(px / res))
        start = nearest_free(cost, cell(x, y), nav.snap_radius)
        if start is None:
            self.status = "no free space near robot"
            return
        half, dx, dy = nav.map_size / 2 - 3 * res, self.goal[0] - x, self.goal[1] - y
        scale = max(abs(dx) / half, abs(dy) / half, 1.0)
        gx, gy = x + dx / scale, y + dy / scale
        target = nearest_free(cost, cell(gx, gy), nav.snap_radius)
        reached = set(_flood([start], set(cost), CROSS))
        if target not in reached:
            away = lambda c: (((c[1] + 0.5) * res - gx) ** 2 + ((c[0] + 0.5) * res - gy) ** 2, c)
            target = min(reached, key=away)
        found = least_cost(cost, start, target)
        self.path = [((c + 0.5) * res, (r + 0.5) * res) for r, c in found[1]]
        self.status = "following path" if target != start else "no progress possible from here"

    def carrot(self, x: float, y: float) -> tuple[float, float]:
        """The path's point that is `lookahead` further along than the nearest one, else its last."""
        arcs = list(accumulate(map(math.dist, self.path, self.path[1:]), initial=0.0))
        near = min(range(len(arcs)), key=lambda i: math.dist(self.path[i], (x, y)))
        return self.path[min(bisect_left(arcs, arcs[near] + self.nav.lookahead), len(arcs) - 1)]

    def command(self, x: float, y: float, yaw: float, now: float) -> tuple[float, float, str]:
        """Speed, turning rate and status."""
        nav, there = self.nav, self.goal is not None and math.dist(self.goal, (x, y)) <= self.nav.goal_tol
        reasons = [(self.goal is None, "waiting for goal"), (there, "goal reached"), (now - self.seen_at > nav.scan_timeout, "scan timeout - stopped"), (not self.path, self.status)]
        if stop := next((name for holds, name in reasons if holds), None):
            return 0.0, 0.0, stop
        cx, cy = self.carrot(x, y)
        off = math.remainder(math.atan2(cy - y, cx - x) - yaw, math.tau)
        turn = math.copysign(min(nav.yaw_gain * abs(off), nav.max_yaw_rate), off)
        turning = abs(off) > nav.turn_threshold
        return (0.0, turn, "rotating to heading") if turning else (nav.max_speed * max(0.0, math.cos(off)), turn, "following path")


def visible(cost: dict[Cell, float], x: float, y: float, nav: NavConfig, reach: float) -> dict[Cell, float]:
    """The cells of the window around the robot whose centres are within `reach` of it; what isn't seen is no way."""
    res, half = nav.resolution, nav.map_size / 2
    rows = range(math.floor((y - half) / res), math.ceil((y + half) / res))
    cols = range(math.floor((x - half) / res), math.ceil((x + half) / res))
    near = lambda r, c: math.hypot((c + 0.5) * res - x, (r + 0.5) * res - y) < reach
    return {(r, c): cost[r, c] for r in rows for c in cols if (r, c) in cost and near(r, c)}


def driven(cost: dict[Cell, float], start: tuple[float, float, float], goal: tuple[float, float] | None, nav: NavConfig = NavConfig(), steps: int = 3000, every: int = 3, reach: float = 5.0, dt: float = 0.1) -> list[tuple]:
    """(x, y, yaw, status) before each step of a run: a scan and a plan every so many steps; the robot turns first, then moves."""
    (x, y, yaw), robot, out = start, Navigator(nav, goal), []
    for k in range(steps):
        if k % every == 0:
            robot.replan(visible(cost, x, y, nav, reach), x, y, k * dt)
        vx, wz, status = robot.command(x, y, yaw, k * dt)
        out.append((x, y, yaw, status))
        if status in ("goal reached", "waiting for goal"):
            break
        yaw += wz * dt
        x, y = x + vx * math.cos(yaw) * dt, y + vx * math.sin(yaw) * dt
    return out


def closed_loops(cells: DataFrame, agents: DataFrame, nav: NavConfig = NavConfig(), steps: int = 3000, every: int = 3, reach: float = 5.0, spread: int = 1) -> DataFrame:
    """Runs of (agent_id, grid_id, x, y, yaw, goal_x, goal_y) over cells with a cost: (agent_id, seq, x, y, yaw, status). A null goal waits.
    A grid's agents make `spread` tasks; each run is sequential."""
    columns = ["agent_id", "seq", "x", "y", "yaw", "status"]

    def kernel(key, grid: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        cost, rows = _costs(grid), []
        for a in asked.itertuples():
            goal = None if pd.isna(a.goal_x) or pd.isna(a.goal_y) else (a.goal_x, a.goal_y)
            rows += [(a.agent_id, i, *r) for i, r in enumerate(driven(cost, (a.x, a.y, a.yaw), goal, nav, steps, every, reach))]
        return pd.DataFrame(rows, columns=columns)

    free = cells.filter(F.col("cost").isNotNull()).select("grid_id", "row", "col", "cost")
    grids, dealt_ = dealt(free, agents, "agent_id", spread)
    return grids.cogroup(dealt_).applyInPandas(kernel, "agent_id long, seq int, x double, y double, yaw double, status string")
