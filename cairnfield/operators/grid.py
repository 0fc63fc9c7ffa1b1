"""From points to terrain grids: cell statistics, stencils, classes and costs.

A grid is sparse: one row for each observed cell, keyed by (grid_id, row, col). A stencil sends each cell to the cells that
look at it and aggregates there, so that every step is one exchange with map-side combining, and no self-join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FREE, LETHAL, UNKNOWN, GridConfig, RobotLimits
from ..functions.geometry import bin_index

KEY = ["grid_id", "row", "col"]
#: Tasks that a grid's points are dealt to where they meet its bounds.
SALT = 32
BOX = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]


def disk(radius: int) -> list[tuple[int, int]]:
    span = range(-radius, radius + 1)
    return [(dr, dc) for dr in span for dc in span if dr * dr + dc * dc <= radius * radius]


def sent(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each cell once for every offset, at (row + dr, col + dc); `dr` and `dc` tell how it came there."""
    o = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets)))
    return cells.withColumn("__o", o).withColumns({"row": F.col("row") + F.col("__o.dr"), "col": F.col("col") + F.col("__o.dc"), "dr": F.col("__o.dr"), "dc": F.col("__o.dc")}).drop("__o")


def here(c: str = "dr") -> Column:
    return (F.col("dr") == 0) & (F.col("dc") == 0)


def auto_bounds(points: DataFrame) -> DataFrame:
    """Least and largest x and y of each grid's points."""
    return points.groupBy("grid_id").agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))


def binned(points: DataFrame, cfg: GridConfig) -> DataFrame:
    """Points with row and col. Given bounds drop what is outside; a grid's own bounds keep its last edge in the last cell."""
    if cfg.z_clip:
        points = points.filter(F.col("z").between(*cfg.z_clip))
    res = cfg.resolution
    if cfg.bounds:
        x0, y0, x1, y1 = cfg.bounds
        cols, rows = max(1, math.ceil((x1 - x0) / res)), max(1, math.ceil((y1 - y0) / res))
        p = points.withColumns({"col": bin_index("x", x0, res), "row": bin_index("y", y0, res)})
        return p.filter((F.col("col") >= 0) & (F.col("col") < cols) & (F.col("row") >= 0) & (F.col("row") < rows))
    # A grid's points are dealt to SALT tasks, each with a copy of its bounds, so that a large grid is no hot key.
    bounds = auto_bounds(points).withColumn("__salt", F.explode(F.expr(f"sequence(0, {SALT - 1})")))
    p = points.withColumn("__salt", F.pmod(F.xxhash64("x", "y", "z"), F.lit(SALT)).cast("int")).join(bounds, ["grid_id", "__salt"]).drop("__salt")
    last = lambda lo, hi: F.greatest(F.lit(1), F.ceil((F.col(hi) - F.col(lo)) / res)).cast("int") - 1
    return p.withColumns({"col": F.least(bin_index("x", "xmin", res), last("xmin", "xmax")), "row": F.least(bin_index("y", "ymin", res), last("ymin", "ymax"))}).drop("xmin", "xmax", "ymin", "ymax")


def cell_stats(binned_points: DataFrame) -> DataFrame:
    """count, sum, sum of squares, least and largest z by cell."""
    z = F.col("z")
    return binned_points.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum(z).alias("sz"), F.sum(z * z).alias("szz"), F.min(z).alias("zmin"), F.max(z).alias("zmax"))


def layers(stats: DataFrame, scale: float = 1.0) -> DataFrame:
    """Mean and population deviation of z in metres; `scale` is metres in a unit of z (exact for integer z)."""
    mean = F.col("sz") / F.col("n")
    var = F.greatest(F.lit(0.0), F.col("szz") / F.col("n") - mean * mean)
    return stats.select(*KEY, "n", (mean * scale).alias("elevation"), (F.sqrt(var) * scale).alias("roughness"))


def smoothed(cells: DataFrame, passes: int, column: str = "elevation") -> DataFrame:
    """`column` as the mean of the observed cells among the nine around, `passes` times; unobserved cells stay so."""
    keep = [c for c in cells.columns if c not in (*KEY, column)]
    for _ in range(passes):
        own = [F.max(F.when(here(), F.col(c))).alias(c) for c in keep]
        mean = sent(cells, BOX).groupBy(*KEY).agg(F.avg(column).alias(column), F.max(here()).alias("__own"), *own)
        cells = mean.filter("__own").select(*KEY, column, *keep)
    return cells


def gradients(cells: DataFrame, resolution: float) -> DataFrame:
    """Adds slope (tangent) and step (largest rise to the four neighbours; none to unknown ones)."""
    look = {"e": (0, -1), "w": (0, 1), "n": (-1, 0), "s": (1, 0)}
    keep = [c for c in cells.columns if c not in KEY]
    at = lambda o: (F.col("dr") == o[0]) & (F.col("dc") == o[1])
    got = sent(cells, [(0, 0), *look.values()]).groupBy(*KEY).agg(
        F.max(here()).alias("__own"),
        *(F.max(F.when(here(), F.col(c))).alias(c) for c in keep),
        *(F.max(F.when(at(o), F.col("elevation"))).alias(f"__{k}") for k, o in look.items()),
    )
    z, res = F.col("elevation"), F.lit(resolution)
    part = lambda f, b: F.coalesce((F.col(f) - F.col(b)) / (2 * res), (F.col(f) - z) / res, (z - F.col(b)) / res, F.lit(0.0))
    gx, gy = part("__e", "__w"), part("__n", "__s")
    step = F.greatest(*(F.coalesce(F.abs(F.col(f"__{k}") - z), F.lit(0.0)) for k in look))
    return got.filter("__own").select(*KEY, *keep, F.sqrt(gx * gx + gy * gy).alias("slope"), step.alias("step"))


def lethal(cells: DataFrame, robot: RobotLimits) -> DataFrame:
    """Adds `lethal`: too rough, too steep, or too high a step; all strictly."""
    return cells.withColumn("lethal", (F.col("roughness") > robot.max_roughness) | (F.col("slope") > robot.max_slope_tan) | (F.col("step") > robot.max_step))


def without_specks(cells: DataFrame, least: int) -> DataFrame:
    """`lethal` without 8-connected groups of fewer than `least` cells.

    A group has `least` cells exactly if some cell within `least` - 2 steps has seen so many; sets of at most `least` cells
    travel that far, so work follows the cells and never the size of a group.
    """
    if least <= 1:
        return cells
    keep = [c for c in cells.columns if c not in KEY]
    own = [F.max(F.when(here(), F.col(c))).alias(c) for c in keep]
    ball = F.array(F.struct("row", "col"))
    d = cells.withColumn("__ball", F.when(F.col("lethal"), ball))
    for _ in range(least - 1):
        got = sent(d, BOX).groupBy(*KEY).agg(F.max(here()).alias("__own"), *own, F.max(F.when(here(), F.col("lethal"))).alias("__l"), F.collect_list("__ball").alias("__balls"))
        d = got.filter("__own").withColumn("__ball", F.when(F.col("__l"), F.slice(F.array_distinct(F.flatten("__balls")), 1, least)))
        d = d.select(*KEY, *keep, "__ball")
    return d.withColumn("lethal", F.col("lethal") & (F.size("__ball") >= least)).select(*KEY, *keep)


def dilated(cells: DataFrame, radius: int, column: str = "lethal", out: str = "lethal") -> DataFrame:
    """`out`: whether a cell with `column` is within `radius` cells; observed cells alone."""
    if radius <= 0:
        return cells.withColumn(out, F.col(column))
    keep = [c for c in cells.columns if c not in (*KEY, out)]
    zero = F.struct(F.lit(0).alias("dr"), F.lit(0).alias("dc"))
    around = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in disk(radius)))
    o = cells.withColumn("__o", F.explode(F.when(F.col(column), around).otherwise(F.array(zero)))).withColumn("__hit", F.col(column))
    o = o.withColumns({"row": F.col("row") + F.col("__o.dr"), "col": F.col("col") + F.col("__o.dc"), "dr": F.col("__o.dr"), "dc": F.col("__o.dc")})
    got = o.groupBy(*KEY).agg(F.max(here()).alias("__own"), *(F.max(F.when(here(), F.col(c))).alias(c) for c in keep), F.max("__hit").alias("__out"))
    return got.filter("__own").withColumn(out, F.col("__out")).select(*KEY, *keep, *[out] * (out not in keep))


def dense(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """All cells of the grids (grid_id, rows, cols); what isn't observed has nulls."""
    all_ = grids.select("grid_id", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), "cols").select("grid_id", "row", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
    return all_.join(cells, KEY, "left")


def eroded(mask: DataFrame, grids: DataFrame, radius: int) -> DataFrame:
    """Cells of a mask (rows are its cells) with no cell outside the mask within `radius`; the grid's edge isn't outside."""
    d = dense(mask.select(*KEY, F.lit(True).alias("on")), grids).withColumn("off", F.col("on").isNull())
    return dilated(d, radius, "off", "near").filter("on AND NOT near").select(*KEY)


def classified(cells: DataFrame, robot: RobotLimits, cfg: GridConfig) -> DataFrame:
    """Adds class and cost (null where lethal) from roughness, slope and `lethal`."""
    cost = 1.0 + 3.0 * F.coalesce(F.col("roughness"), F.lit(0.0)) / robot.max_roughness + 3.0 * F.coalesce(F.col("slope"), F.lit(0.0)) / robot.max_slope_tan
    return cells.withColumns({"class": F.when(F.col("lethal"), LETHAL).otherwise(FREE).cast("tinyint"), "cost": F.when(~F.col("lethal"), cost)})


def terrain(stats: DataFrame, robot: RobotLimits, cfg: GridConfig, scale: float = 1.0) -> DataFrame:
    """Cell statistics to elevation, roughness, slope, step, class and cost."""
    d = lethal(gradients(smoothed(layers(stats, scale), cfg.smooth_passes), cfg.resolution), robot)
    d = without_specks(d, cfg.min_obstacle_cells)
    if cfg.inflate_obstacles:
        d = dilated(d, math.ceil(robot.radius / cfg.resolution))
    return classified(d, robot, cfg)


def discretize(points: DataFrame, robot: RobotLimits = RobotLimits(), cfg: GridConfig = GridConfig()) -> DataFrame:
    """The terrain grid of points (grid_id, x, y, z): one row for each observed cell. An empty table gives an empty grid."""
    return terrain(cell_stats(binned(points, cfg)), robot, cfg)


def occupancy(cells: DataFrame, grids: DataFrame, cap: float | None = None) -> DataFrame:
    """value by cell of the whole grid: -1 unknown, 1 to 99 by cost, 100 lethal. Costs scale to `cap`, else to the 99th percentile."""
    if cap is None:
        high = cells.groupBy("grid_id").agg(F.greatest(F.expr("percentile(cost, 0.99)"), F.lit(1.000001)).alias("high"))
        d = dense(cells, grids).join(high, "grid_id", "left")
    else:
        d = dense(cells, grids).withColumn("high", F.lit(max(cap, 1.000001)))
    soft = F.greatest(F.lit(1.0), F.least(F.lit(99.0), F.rint((F.col("cost") - 1.0) / (F.col("high") - 1.0) * 98.0) + 1.0))
    value = F.when(F.col("class").isNull() | (F.col("class") == UNKNOWN), -1).when(F.col("class") == LETHAL, 100).otherwise(soft)
    return d.select(*KEY, value.cast("int").alias("value"))


def packed(values: DataFrame) -> DataFrame:
    """The values of a grid as one array in row-major order."""
    return values.groupBy("grid_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "value"))), lambda x: x["value"]).alias("data"))
