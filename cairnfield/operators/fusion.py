"""Fusing scans: information sums, sequential filters, and the persistent sparse map."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FREE, LETHAL, UNKNOWN, KalmanConfig, RobotLimits
from .graph import checkpointed
from .grid import KEY, dilated, gradients, smoothed, without_specks

#: Weights of a map cell: of one observation, of what was known, and in all.
NEW_CAP, OLD_CAP, TOTAL_CAP = 20, 80, 100


def scan_measures(points: DataFrame, cfg: KalmanConfig, scale: float = 1.0) -> DataFrame:
    """By scan and cell: z and variance of its points' information sums, and hits. Points have sx, sy, sz of the sensor."""
    dx, dy, dz = (F.col(a) - F.col(b) for a, b in (("x", "sx"), ("y", "sy"), ("z", "sz")))
    noise = cfg.sensor_var + cfg.range_coeff * (dx * dx + dy * dy + dz * dz)
    sums = points.withColumn("w", 1.0 / noise).groupBy("scan_id", *KEY).agg(F.sum(F.col("z") * F.col("w")).alias("zw"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("hits"))
    return sums.select("scan_id", *KEY, (F.col("zw") / F.col("w")).alias("z"), (1.0 / F.col("w")).alias("var"), "hits")


def fused(measures: DataFrame) -> DataFrame:
    """Height and variance by cell when nothing is added between scans: the filter equals sums of information, in any order."""
    s = measures.groupBy(*KEY).agg(F.sum(F.col("z") / F.col("var")).alias("zw"), F.sum(1.0 / F.col("var")).alias("w"), F.sum("hits").alias("hits"))
    return s.select(*KEY, (F.col("zw") / F.col("w")).alias("height"), (1.0 / F.col("w")).alias("variance"), "hits")


def fused_with_process(measures: DataFrame, process_var: float, last_scan: int, known: DataFrame | None = None) -> DataFrame:
    """The same with `process_var` added to every cell at each scan: a fold over the cell's measures by scan, up to `last_scan`.

    `known` (cells with height, variance and scan, the scan that they are of) goes first; the result can be the next one's.
    """
    steps = F.array_sort(F.collect_list(F.struct("scan_id", "z", "var", "hits")))
    g = measures.groupBy(*KEY).agg(steps.alias("steps"))
    start = "CAST(NULL AS struct<h: double, p: double, k: bigint>)"
    if known is not None:
        k = known.select(*KEY, F.struct(F.col("height").cast("double").alias("h"), F.col("variance").cast("double").alias("p"), F.col("scan").cast("bigint").alias("k")).alias("old"))
        g = g.join(k, KEY, "full").withColumn("steps", F.coalesce("steps", F.expr("array()").cast(g.schema["steps"].dataType)))
        start = "old"
    now = f"(a.p + {process_var!r}D * (x.scan_id - a.k))"
    folded = g.withColumn(
        "f",
        F.expr(
            f"""aggregate(steps, {start}, (a, x) -> IF(a.h IS NULL, struct(x.z AS h, x.var AS p, CAST(x.scan_id AS bigint) AS k),
            struct(a.h + {now} / ({now} + x.var) * (x.z - a.h) AS h, (1D - {now} / ({now} + x.var)) * {now} AS p, CAST(x.scan_id AS bigint) AS k)))"""
        ),
    )
    return folded.select(*KEY, F.col("f.h").alias("height"), (F.col("f.p") + process_var * (F.lit(last_scan) - F.col("f.k"))).alias("variance"), F.lit(last_scan).cast("long").alias("scan"))


def fused_in_parts(measures: DataFrame, process_var: float, last_scan: int, most: int = 10_000) -> DataFrame:
    """`fused_with_process` for any number of scans: stretches of at most `most` are folded one after the other, each into the
    checkpointed cells of those before, so that a row never holds more measures than that."""
    first = measures.agg(F.min("scan_id")).first()[0]
    known = None
    for at in range(first if first is not None else last_scan, last_scan + 1, most):
        end = min(at + most - 1, last_scan)
        known = fused_with_process(measures.filter(F.col("scan_id").between(at, end)), process_var, end, known)
        known = checkpointed(known) if end < last_scan else known
    return known


def fused_grid(cells: DataFrame, robot: RobotLimits, cfg: KalmanConfig) -> DataFrame:
    """Classes and costs of fused heights: lethal by slope and step of the smoothed heights, then inflated; unknown where the
    variance is too large. A lethal cell stays lethal whatever its variance."""
    d = gradients(smoothed(cells.withColumnRenamed("height", "elevation"), cfg.smooth_passes), cfg.resolution)
    d = d.withColumn("lethal", (F.col("slope") > robot.max_slope_tan) | (F.col("step") > robot.max_step))
    d = without_specks(d, cfg.min_obstacle_cells)
    if cfg.inflate_obstacles:
        d = dilated(d, math.ceil(robot.radius / cfg.resolution))
    kind = F.when(F.col("lethal"), LETHAL).when(F.col("variance") > cfg.max_variance, UNKNOWN).otherwise(FREE)
    cost = F.when(F.col("lethal"), F.lit(None)).when(kind == UNKNOWN, cfg.unknown_cost).otherwise(1.0 + 3.0 * F.col("slope") / robot.max_slope_tan + 2.0 * F.sqrt("variance"))
    return d.withColumns({"class": kind.cast("tinyint"), "cost": cost, "roughness": F.sqrt("variance")})


def _fold(steps: Column, start: str) -> Column:
    """Known observations in order: heights weighted, weights capped, the latest class."""
    return F.aggregate(
        steps,
        F.expr(start),
        lambda a, x: F.struct(
            F.when(a["weight"] > 0, (a["elevation"] * F.least(a["weight"], F.lit(OLD_CAP)) + x["elevation"] * _new(x)) / (F.least(a["weight"], F.lit(OLD_CAP)) + _new(x))).otherwise(x["elevation"]).alias("elevation"),
            x["class"].cast("tinyint").alias("class"),
            F.least(F.when(a["weight"] > 0, F.least(a["weight"], F.lit(OLD_CAP)) + _new(x)).otherwise(_new(x)), F.lit(TOTAL_CAP)).cast("int").alias("weight"),
        ),
    )


def _new(x: Column) -> Column:
    return F.least(F.greatest(x["n"], F.lit(1)), F.lit(NEW_CAP)).cast("int")


def checked(resolution: float, grid_resolution: float, refresh_radius: float | None = None, sensor: tuple[float, float] | None = None) -> None:
    """Raises ValueError if a grid can't be fused into a map: other cells, a radius below zero, or one without the sensor's place."""
    if abs(grid_resolution - resolution) > 1e-6:
        raise ValueError("the grid's resolution is not the map's")
    if refresh_radius is not None and refresh_radius < 0:
        raise ValueError("the refresh radius must not be negative")
    if refresh_radius is not None and sensor is None:
        raise ValueError("a refresh radius needs the sensor's place")


def folded_in_parts(local: DataFrame, known: DataFrame | None = None, refresh_radius: float | None = None, most: int = 10_000) -> DataFrame:
    """`folded_map` for any number of observations: stretches of at most `most` seqs, so of a cell's observations in one row, are
    folded one after the other, each into the checkpointed map of those before."""
    ends = local.agg(F.min("seq").alias("a"), F.max("seq").alias("b")).first()
    if ends["a"] is None or ends["b"] - ends["a"] < most:
        return folded_map(local, known, refresh_radius)
    for at in range(ends["a"], ends["b"] + 1, most):
        known = checkpointed(folded_map(local.filter(F.col("seq").between(at, at + most - 1)), known, refresh_radius))
    return known


def folded_map(local: DataFrame, known: DataFrame | None = None, refresh_radius: float | None = None) -> DataFrame:
    """The sparse map (ix, iy, elevation, class, weight) after local cells (seq, row, col, ix, iy, elevation, class, n, distance).

    Unknown cells and missing heights never erase. With a refresh radius, a cell that is known already changes only within
    it (inclusive, by `distance` from the sensor). `known` is the map before. Order: seq, then row-major.
    """
    ok = local.filter((F.col("class") != UNKNOWN) & F.col("elevation").isNotNull() & ~F.isnan("elevation"))
    step = F.struct("seq", "row", "col", F.col("elevation").cast("double").alias("elevation"), "class", F.col("n").cast("int").alias("n"), (F.col("distance") if refresh_radius is not None else F.lit(0.0)).alias("distance"))
    g = ok.groupBy("ix", "iy").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    empty = "CAST(struct(0D AS elevation, 0Y AS class, 0 AS weight) AS struct<elevation: double, class: tinyint, weight: int>)"
    if known is not None:
        k = known.select("ix", "iy", F.struct(F.col("elevation").cast("double").alias("elevation"), F.col("class").cast("tinyint").alias("class"), F.col("weight").cast("int").alias("weight")).alias("old"))
        g = g.join(k, ["ix", "iy"], "full").withColumn("steps", F.coalesce("steps", F.expr("array()").cast(g.schema["steps"].dataType)))
        start = f"coalesce(old, {empty})"
        admitted = F.when(F.col("old").isNotNull(), F.lit(0)).otherwise(F.lit(1))
    else:
        start, admitted = empty, F.lit(1)
    if refresh_radius is not None:
        g = g.withColumn("__first", admitted).withColumn("steps", F.filter("steps", lambda x, i: (x["distance"] <= refresh_radius) | (i < F.col("__first"))))
    return g.withColumn("m", _fold(F.col("steps"), start)).select("ix", "iy", "m.elevation", "m.class", "m.weight")


def snapshot(cells: DataFrame) -> DataFrame:
    """The map in the order of (iy, ix)."""
    return cells.select("ix", "iy", F.col("elevation").cast("float").alias("elevation"), "class", "weight").orderBy("iy", "ix")


def mean_variance(cells: DataFrame) -> DataFrame:
    """The mean variance of the observed cells; one row, null without any."""
    return cells.agg(F.avg("variance").alias("mean_variance"))


def changes(local: DataFrame, known: DataFrame | None = None, refresh_radius: float | None = None, revision: int = 0) -> DataFrame:
    """By seq of local cells (as in `folded_map`): how many the map takes, and its revision after, which rises only where it takes some.

    Cells that are new are taken, known ones only within the refresh radius.
    """
    ok = local.filter((F.col("class") != UNKNOWN) & F.col("elevation").isNotNull() & ~F.isnan("elevation"))
    first = ok.groupBy("ix", "iy").agg(F.min(F.struct("seq", "row", "col")).alias("first"))
    d = ok.join(first, ["ix", "iy"])
    new = F.struct("seq", "row", "col") == F.col("first")
    if known is not None:
        d = d.join(known.select("ix", "iy", F.lit(True).alias("__known")), ["ix", "iy"], "left")
        new = new & F.col("__known").isNull()
    taken = F.lit(True) if refresh_radius is None else new | (F.col("distance") <= refresh_radius)
    by = local.select("seq").distinct().join(d.filter(taken).groupBy("seq").agg(F.count(F.lit(1)).alias("changed")), "seq", "left").select("seq", F.coalesce("changed", F.lit(0)).alias("changed"))
    w = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)  # a row for each grid that was fused
    return by.withColumn("revision", (F.sum(F.when(F.col("changed") > 0, 1).otherwise(0)).over(w) + revision).cast("long"))
