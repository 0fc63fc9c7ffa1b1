"""From scans to plans: points in the world, unknown space, and replanning with its fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import UNKNOWN, NavConfig
from ..functions import geometry as geo
from . import graph, grid, timed


def enough_points(points: DataFrame, least: int = 100, by: str = "scan_id") -> DataFrame:
    """The points of scans with at least `least` finite ones; the rest of such a scan's points are dropped."""
    ok = points.filter(geo.finite("x", "y", "z"))
    return ok.join(ok.groupBy(by).count().filter(F.col("count") >= least).select(by), by, "left_semi")


def median_windows(points: DataFrame, size: float, by: str = "grid_id") -> DataFrame:
    """Bounds of a square window around the medians of each grid's x and y."""
    m = points.groupBy(by).agg(F.median("x").alias("x"), F.median("y").alias("y"))
    return m.select(by, *((F.col(c) + s * size / 2).alias(f"{c}{n}") for n, s in (("min", -1), ("max", 1)) for c in ("x", "y")))


def in_world(points: DataFrame, poses: DataFrame, by: str = "robot_id", mount: tuple[float, float, float] | None = None, min_range: float = 0.0) -> DataFrame:
    """Points (robot, t, scan_id, x, y, z) of sensors, in the world by the last pose (robot, t, tie, px, py, pz, qx, qy, qz, qw) at or before
    the scan; points without a pose yet are dropped, and so is what is within `min_range` of the robot. `mount`: roll, pitch and yaw of the sensor, in radians."""
    pose = ["px", "py", "pz", "qx", "qy", "qz", "qw"]
    scans = points.select(by, "t", "scan_id").distinct()
    known = timed.latest_before(scans, poses, by, "t", "scan_id", pose, tie_right="tie").filter("px IS NOT NULL")
    p = points.join(known, [by, "t", "scan_id"])
    x, y, z = geo.rotated(geo.rpy_rows(*mount), "x", "y", "z") if mount and any(mount) else (F.col(c) for c in "xyz")
    wx, wy, wz = geo.quaternion_rotated("qx", "qy", "qz", "qw", x, y, z)
    p = p.withColumns({"x": wx + F.col("px"), "y": wy + F.col("py"), "z": wz + F.col("pz")})
    return p.filter(geo.away_from_body("x", "y", "px", "py", min_range)).drop(*pose)


def with_unknown(cells: DataFrame, grids: DataFrame, cost: float = 50.0, lethal: bool = False, as_free: bool = False) -> DataFrame:
    """All cells of the grids (grid_id, rows, cols): unknown ones cost `cost`, or 1 `as_free`, or nothing passes them if `lethal`."""
    d = grid.dense(cells.withColumn("__seen", F.lit(True)), grids)
    value = F.lit(None).cast("double") if lethal else F.lit(1.0 if as_free else float(cost))
    seen = F.col("__seen").isNotNull()
    return d.withColumns({"cost": F.when(seen, F.col("cost")).otherwise(value), "class": F.when(seen, F.col("class")).otherwise(F.lit(UNKNOWN)).cast("tinyint")}).drop("__seen")


def replanned(cells: DataFrame, requests: DataFrame, nav: NavConfig = NavConfig(), spread: int = 1) -> DataFrame:
    """For (query_id, grid_id, x, y, goal_x, goal_y), in metres from the grid's corner: status, cost, and path over cells with a cost.

    The robot's cell and the goal, pulled into the window, go to the nearest free cells. A target that can't be reached is replaced
    by the reachable cell nearest to the pulled goal. Statuses, in this order: waiting for goal, no free space near robot,
    no progress possible from here (a path of one cell), following path.
    """
    res, free = nav.resolution, cells.filter("cost IS NOT NULL")
    labels = graph.components(free, graph.CROSS).select(*grid.KEY, "component")
    gx, gy = geo.projected_goal("goal_x", "goal_y", "x", "y", nav.map_size, res)
    asked = requests.withColumns({"gx": gx, "gy": gy})
    at = lambda x, y: (geo.world_to_cell(y, 0.0, res).alias("row"), geo.world_to_cell(x, 0.0, res).alias("col"))
    routes = asked
    for end, (x, y) in {"start": ("x", "y"), "goal": ("gx", "gy")}.items():
        near = graph.snapped(free, asked.filter("goal_x IS NOT NULL").select("query_id", "grid_id", *at(x, y)), nav.snap_radius)
        near = near.join(asked.select("query_id", "grid_id"), "query_id").join(labels.withColumnsRenamed({"row": "snap_row", "col": "snap_col"}), ["grid_id", "snap_row", "snap_col"])
        routes = routes.join(near.select("query_id", F.col("snap_row").alias(f"{end}_row"), F.col("snap_col").alias(f"{end}_col"), F.col("component").alias(f"{end}_in")), "query_id", "left")
    lost = routes.filter("start_in IS NOT NULL AND (goal_in IS NULL OR goal_in <> start_in)").select("query_id", "grid_id", "gx", "gy", F.col("start_in").alias("component"))
    d = lambda c, g: ((F.col(c) + 0.5) * res - F.col(g)) * ((F.col(c) + 0.5) * res - F.col(g))
    best = lost.join(labels, ["grid_id", "component"]).groupBy("query_id").agg(F.min(F.struct((d("col", "gx") + d("row", "gy")).alias("d"), "row", "col")).alias("b"))
    routes = routes.join(best, "query_id", "left").withColumns({"goal_row": F.coalesce("b.row", "goal_row"), "goal_col": F.coalesce("b.col", "goal_col")})
    same = (F.col("start_row") == F.col("goal_row")) & (F.col("start_col") == F.col("goal_col"))
    status = F.when(F.col("goal_x").isNull(), "waiting for goal").when(F.col("start_in").isNull(), "no free space near robot").when(same, "no progress possible from here").otherwise("following path")
    routes = routes.select("query_id", "grid_id", "start_row", "start_col", "goal_row", "goal_col", status.alias("status"))
    open_ = F.col("status").isin("no progress possible from here", "following path")
    paths = graph.plan_paths(free, routes.filter(open_), spread=spread).select("query_id", "cost", "path")
    return routes.join(paths, "query_id", "left").select("query_id", "grid_id", "status", "goal_row", "goal_col", "cost", "path")


def draped(paths: DataFrame, cells: DataFrame, resolution: float, lift: float = 0.0, most: int | None = None) -> DataFrame:
    """Cell paths (query_id, grid_id, seq, row, col) as x, y, z: the cell's height, or the grid's least where it has none, and `lift`.
    With `most`, the first so many points of each path."""
    lows = cells.groupBy("grid_id").agg(F.min("elevation").alias("low"))
    p = paths if most is None else paths.filter(F.col("seq") < most)
    j = p.join(cells.select(*grid.KEY, "elevation"), grid.KEY, "left").join(lows, "grid_id", "left")
    z = F.coalesce("elevation", "low", F.lit(0.0)) + lift
    return j.select("query_id", "seq", geo.cell_centre("col", 0.0, resolution).alias("x"), geo.cell_centre("row", 0.0, resolution).alias("y"), z.alias("z"))


def gaps(one: DataFrame, other: DataFrame, by: str = "agent_id") -> DataFrame:
    """Mean and last distance between two trajectories (by, seq, x, y), step by step."""
    o = other.select(by, "seq", F.col("x").alias("ox"), F.col("y").alias("oy"))
    d = F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))
    return one.join(o, [by, "seq"]).withColumn("d", d).groupBy(by).agg(F.count(F.lit(1)).alias("steps"), F.avg("d").alias("mean_gap"), F.max_by("d", "seq").alias("last_gap"))


def current_goals(ticks: DataFrame, waypoints: DataFrame, runtime: DataFrame | None = None, by: str = "robot_id") -> DataFrame:
    """Ticks (robot, t, status) with the goal in force: the queue's next waypoint (robot, seq from 0, x, y) after each `goal reached`
    before the tick, or the last runtime goal (robot, t, tie, x, y) at or before it, which ends the queue."""
    w = Window.partitionBy(by).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    t = ticks.withColumn("seq", F.coalesce(F.sum(F.when(F.col("status") == "goal reached", 1).otherwise(0)).over(w), F.lit(0)).cast("int"))
    t = t.join(waypoints.select(by, "seq", F.col("x").alias("goal_x"), F.col("y").alias("goal_y")), [by, "seq"], "left")
    if runtime is None:
        return t.drop("seq")
    t = timed.latest_before(t, runtime.select(by, "t", "tie", F.col("x").alias("rx"), F.col("y").alias("ry")), by, "t", "seq", ["rx", "ry"], tie_right="tie")
    over = F.col("rx").isNotNull()
    return t.withColumns({"goal_x": F.when(over, F.col("rx")).otherwise(F.col("goal_x")), "goal_y": F.when(over, F.col("ry")).otherwise(F.col("goal_y"))}).drop("rx", "ry", "seq")


def waypoint_queue(rows: DataFrame, by: str = "robot_id", flat: str = "waypoints") -> DataFrame:
    """A flat array x1, y1, x2, y2, ... as rows (by, seq, x, y); an odd last number is left out."""
    pairs = F.transform(F.expr(f"sequence(0, size({flat}) div 2 - 1)"), lambda i: F.struct(i.alias("seq"), F.get(F.col(flat), 2 * i).alias("x"), F.get(F.col(flat), 2 * i + 1).alias("y")))
    return rows.filter(F.size(flat) >= 2).select(by, F.explode(pairs).alias("p")).select(by, "p.*")
