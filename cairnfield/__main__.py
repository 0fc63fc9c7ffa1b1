"""Command line: `python -m cairnfield grid POINTS OUT` writes the terrain grid of point files as a table, and
`python -m cairnfield plan POINTS --start X,Y --goal X,Y` prints a path over it as JSON, in metres."""

from __future__ import annotations

import argparse
import json
import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import GridConfig, RobotLimits
from .operators import graph, grid
from .sources.points import read_points


def pair(text: str) -> tuple[float, float]:
    x, y = text.split(",")
    return float(x), float(y)


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="cairnfield", description=__doc__)
    p.add_argument("what", choices=("grid", "plan"))
    p.add_argument("points", help="a file or a pattern that Spark reads")
    p.add_argument("out", nargs="?", help="where the grid goes, as Parquet")
    p.add_argument("--resolution", type=float, default=0.1)
    p.add_argument("--z-clip", type=pair, help="least and largest height that count")
    p.add_argument("--smooth", type=int, default=1, help="passes of smoothing")
    p.add_argument("--every", type=int, default=1, help="read every k-th point of a file")
    p.add_argument("--radius", type=float, default=0.3)
    p.add_argument("--max-step", type=float, default=0.18)
    p.add_argument("--max-slope", type=float, default=30.0, help="degrees")
    p.add_argument("--start", type=pair)
    p.add_argument("--goal", type=pair)
    p.add_argument("--weight", type=float, default=1.0, help="of the estimate; 0 searches by cost alone")
    a = p.parse_args(argv)
    if a.what == "grid" and not a.out or a.what == "plan" and not (a.start and a.goal):
        p.error("grid needs OUT; plan needs --start and --goal")
    return a


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = arguments(argv)
    spark = spark or SparkSession.builder.appName("cairnfield").getOrCreate()
    points = read_points(spark, a.points, a.every).select(F.lit(0).cast("long").alias("grid_id"), "x", "y", "z")
    if a.z_clip:
        points = points.filter(F.col("z").between(*a.z_clip))
    low = grid.auto_bounds(points).first()
    if low is None:
        raise ValueError("no points")
    robot = RobotLimits(radius=a.radius, max_step=a.max_step, max_slope_deg=a.max_slope)
    bounds = (low["xmin"], low["ymin"], low["xmax"] + 1e-9, low["ymax"] + 1e-9)
    cells = grid.discretize(points, robot, GridConfig(resolution=a.resolution, bounds=bounds, smooth_passes=a.smooth))
    if a.what == "grid":
        cells.write.mode("errorifexists").parquet(a.out)
        return {"cells": spark.read.parquet(a.out).count(), "origin": [low["xmin"], low["ymin"]]}
    cell = lambda p: (math.floor((p[1] - low["ymin"]) / a.resolution), math.floor((p[0] - low["xmin"]) / a.resolution))
    ends = spark.createDataFrame([(e, 0, *cell(p)) for e, p in enumerate((a.start, a.goal))], "query_id long, grid_id long, row int, col int")
    free = cells.filter("cost IS NOT NULL")
    near = {r.query_id: (r.snap_row, r.snap_col) for r in graph.snapped(free, ends, 20).collect()}
    if len(near) < 2:
        return {"status": "blocked", "cost": None, "path": None}
    asked = spark.createDataFrame([(0, 0, *near[0], *near[1])], "query_id long, grid_id long, start_row int, start_col int, goal_row int, goal_col int")
    found = graph.plan_paths(free, asked, a.weight).first()
    centre = lambda c: [round(low["xmin"] + (c["col"] + 0.5) * a.resolution, 6), round(low["ymin"] + (c["row"] + 0.5) * a.resolution, 6)]
    return {"status": found.status, "cost": found.cost, "path": found.path and [centre(c) for c in found.path]}


if __name__ == "__main__":
    print(json.dumps(main()))
