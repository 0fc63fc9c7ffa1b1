"""The engine's queries over the driver's tables, each with SQL for DuckDB where SQL can express it.

The cloud is made of integers from `lineitem`, so sums are exact in any order; results are rounded once, at the end.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ApfConfig, GridConfig, KalmanConfig, NavConfig, RobotLimits
from ..functions import geometry as geo
from ..operators import fusion, graph, grid, motion, navigate, orient, timed
from ..sources import export

ROBOT, CFG, KALMAN, NAV, APF = RobotLimits(), GridConfig(), KalmanConfig(), NavConfig(), ApfConfig()
SIDE = 100

_X = "(l_orderkey*7919 + l_partkey*31 + l_suppkey*613 + l_linenumber*104729) % 10000"
_Y = "(l_partkey*6101 + l_suppkey*7057 + l_orderkey*17 + l_linenumber*1299709) % 10000"
_Z = """CASE WHEN (x_mm BETWEEN 3000 AND 3599 AND y_mm BETWEEN 2000 AND 6999) OR (x_mm BETWEEN 6000 AND 6599 AND y_mm BETWEEN 0 AND 5499) THEN q*16
 WHEN x_mm BETWEEN 1000 AND 8999 AND y_mm BETWEEN 8600 AND 8999 THEN 110 + q % 21 ELSE CAST(floor(x_mm*4e-2) AS BIGINT) + (q % 41) - 20 END"""


def cloud(spark: SparkSession, d: str) -> DataFrame:
    """Points in integer millimetres: scan_id, x_mm, y_mm, z_mm; the seven line numbers are seven scans."""
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    t = t.selectExpr("l_linenumber AS scan_id", "l_orderkey", f"{_X} AS x_mm", f"{_Y} AS y_mm", "CAST(l_quantity AS BIGINT) AS q")
    return t.selectExpr("CAST(scan_id AS BIGINT) AS scan_id", "l_orderkey", "x_mm", "y_mm", f"{_Z} AS z_mm")


def stats(spark: SparkSession, d: str, each: bool = False) -> DataFrame:
    """Cell statistics of the whole cloud: as one grid, or with `each` as a grid for each scan."""
    return grid.cell_stats(cloud(spark, d).selectExpr("scan_id AS grid_id" if each else "0L AS grid_id", "CAST(y_mm DIV 100 AS INT) AS row", "CAST(x_mm DIV 100 AS INT) AS col", "z_mm AS z"))


def metres(spark: SparkSession, d: str) -> DataFrame:
    return cloud(spark, d).selectExpr("scan_id", "l_orderkey", "0L AS grid_id", "x_mm / 1e3 AS x", "y_mm / 1e3 AS y", "z_mm / 1e3 AS z")


def terrain(spark: SparkSession, d: str, each: bool = False) -> DataFrame:
    return grid.terrain(stats(spark, d, each), ROBOT, CFG, 1e-3)


_CLOUD = f"""b AS (SELECT CAST(l_linenumber AS BIGINT) scan_id, l_orderkey, {_X} x_mm, {_Y} y_mm, CAST(l_quantity AS BIGINT) q FROM lineitem),
cloud AS (SELECT scan_id, l_orderkey, x_mm, y_mm, {_Z} z_mm FROM b)"""


_OFFSETS = "off AS (SELECT CAST(a.i AS INT) dr, CAST(b.i AS INT) dc FROM range(-3, 4) a(i), range(-3, 4) b(i)), box AS (SELECT * FROM off WHERE abs(dr) <= 1 AND abs(dc) <= 1)"


def _stats(each: bool = False) -> str:
    # Grids are stacked, 1000 rows apart, so that a stencil joins on r and c alone.
    return f"""{_CLOUD}, st AS (SELECT {"scan_id" if each else "0::BIGINT"} g, CAST({"1000 * scan_id + " if each else ""}y_mm // 100 AS INT) r, CAST(x_mm // 100 AS INT) c, count(*) n, CAST(sum(z_mm) AS BIGINT) sz, CAST(sum(z_mm*z_mm) AS BIGINT) szz, min(z_mm) zmin, max(z_mm) zmax
 FROM cloud GROUP BY ALL),
e0 AS (SELECT g, r, c, n, (sz / n) * 1e-3 e, sqrt(greatest(0e0, szz / n - (sz / n) * (sz / n))) * 1e-3 rough FROM st),
{_OFFSETS}"""


def _smooth(n: int) -> str:
    return "".join(f", e{k} AS (SELECT a.g, a.r, a.c, any_value(a.n) n, avg(b.e) e, any_value(a.rough) rough FROM e{k - 1} a, box, e{k - 1} b WHERE b.r = a.r + dr AND b.c = a.c + dc GROUP BY a.g, a.r, a.c)" for k in range(1, n + 1))


_TAN = "tan(radians(3e1))"


def _derived(test: str, cost: str) -> str:
    """From smoothed cells e1 on: slope and step, the raw test for lethal cells, specks, inflation and cost."""
    part = lambda f, b: f"coalesce(({f}.e - {b}.e) / 2e-1, ({f}.e - a.e) / 1e-1, (a.e - {b}.e) / 1e-1, 0e0)"
    joins = " ".join(f"LEFT JOIN e1 {k} ON {k}.r = a.r + {dr} AND {k}.c = a.c + {dc}" for k, dr, dc in (("ea", 0, 1), ("we", 0, -1), ("no", 1, 0), ("so", -1, 0)))
    return f"""gr AS (SELECT a.*, sqrt({part("ea", "we")} ** 2 + {part("no", "so")} ** 2) slope,
 greatest({", ".join(f"coalesce(abs({k}.e - a.e), 0e0)" for k in ("ea", "we", "no", "so"))}) step FROM e1 a {joins}),
l0 AS (SELECT *, {test} AS lethal FROM gr),
deg AS (SELECT a.g, a.r, a.c, count(*) k FROM l0 a, box, l0 b WHERE a.lethal AND b.lethal AND b.r = a.r + dr AND b.c = a.c + dc GROUP BY a.g, a.r, a.c),
big AS (SELECT DISTINCT a.g, a.r, a.c FROM deg a, box, deg b WHERE b.r = a.r + dr AND b.c = a.c + dc AND b.k >= 3),
hot AS (SELECT DISTINCT b.g, b.r + dr r, b.c + dc c FROM big b, off WHERE dr*dr + dc*dc <= 9),
cells AS (SELECT l0.g, l0.r, l0.c, n, e, rough, slope, step, l0.lethal raw, big.r IS NOT NULL deblobbed, hot.r IS NOT NULL lethal,
 CASE WHEN hot.r IS NULL THEN {cost} END cost FROM l0 LEFT JOIN big USING (g, r, c) LEFT JOIN hot USING (g, r, c))"""


def _chain(each: bool = False) -> str:
    return f"{_stats(each)}{_smooth(1)}, " + _derived(f"rough > 5e-2 OR slope > {_TAN} OR step > 18e-2", f"1e0 + 3e0 * rough / 5e-2 + 3e0 * slope / {_TAN}")


QUERIES, ORACLE_SQL = {}, {}
#: Added before rounding on both sides: means of integers are often halfway between two roundings.
NUDGE = 1.234e-10


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = re.sub(r"\bround\(", f"round({NUDGE!r} + ", sql)
        return f

    return add


def _round(c: str, n: int = 6):
    return _rounded(F.col(c), n).alias(c)


def _rounded(x, n: int = 6):
    return F.round(F.lit(NUDGE) + x, n)


@query(f"WITH {_chain()} SELECT CAST(CASE WHEN lethal THEN 1 ELSE 0 END AS TINYINT) AS class, count(*) AS cells, CAST(sum(n) AS BIGINT) AS points, round(sum(cost), 3) AS total_cost, round(max(cost), 5) AS max_cost FROM cells GROUP BY 1")
def class_summary(spark, d):
    return terrain(spark, d).groupBy("class").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("points"), _rounded(F.sum("cost"), 3).alias("total_cost"), _rounded(F.max("cost"), 5).alias("max_cost"))


@query(f"WITH {_stats()} SELECT r AS row, c AS col, n, sz, szz, zmin, zmax FROM st")
def cell_stats(spark, d):
    return stats(spark, d).drop("grid_id")


@query(f"WITH {_stats()} SELECT r AS row, c AS col, n, round(e, 6) AS elevation, round(rough, 6) AS roughness FROM e0")
def cell_roughness(spark, d):
    return grid.layers(stats(spark, d), 1e-3).select("row", "col", "n", _round("elevation"), _round("roughness"))


@query(f"WITH {_CLOUD} SELECT scan_id AS grid_id, min(x_mm) / 1e3 AS xmin, max(x_mm) / 1e3 AS xmax, min(y_mm) / 1e3 AS ymin, max(y_mm) / 1e3 AS ymax FROM cloud WHERE z_mm BETWEEN -10 AND 500 GROUP BY 1")
def auto_bounds(spark, d):
    return grid.auto_bounds(metres(spark, d).withColumn("grid_id", F.col("scan_id")).filter(F.col("z").between(-0.01, 0.5)))


@query(
    f"""WITH {_CLOUD}, p AS (SELECT scan_id, x_mm / 1e3 x, y_mm / 1e3 y, z_mm / 1e3 z FROM cloud WHERE z_mm / 1e3 BETWEEN -1e-2 AND 5e-1), q AS (SELECT scan_id, min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM p GROUP BY 1)
SELECT scan_id AS grid_id, CAST(least(floor((y - y0) / 25e-2), greatest(1, ceil((y1 - y0) / 25e-2)) - 1) AS INT) AS row, CAST(least(floor((x - x0) / 25e-2), greatest(1, ceil((x1 - x0) / 25e-2)) - 1) AS INT) AS col,
 count(*) AS n, min(z) AS zmin, max(z) AS zmax FROM p JOIN q USING (scan_id) GROUP BY 1, 2, 3"""
)
def auto_bounds_grid(spark, d):
    p = metres(spark, d).withColumn("grid_id", F.col("scan_id"))
    return grid.cell_stats(grid.binned(p, GridConfig(resolution=0.25, z_clip=(-0.01, 0.5)))).select("grid_id", "row", "col", "n", "zmin", "zmax")


@query(
    f"""WITH {_CLOUD} SELECT CAST(floor((y_mm / 1e3 - 1e0) / 5e-1) AS INT) AS row, CAST(floor((x_mm / 1e3 - 2e0) / 5e-1) AS INT) AS col, count(*) AS n FROM cloud
WHERE z_mm / 1e3 BETWEEN 0 AND 4e-1 AND floor((y_mm / 1e3 - 1e0) / 5e-1) BETWEEN 0 AND 9 AND floor((x_mm / 1e3 - 2e0) / 5e-1) BETWEEN 0 AND 11 GROUP BY 1, 2"""
)
def bounded_grid(spark, d):
    cfg = GridConfig(resolution=0.5, z_clip=(0.0, 0.4), bounds=(2.0, 1.0, 8.0, 6.0))
    return grid.cell_stats(grid.binned(metres(spark, d), cfg)).select("row", "col", "n")


@query(
    f"WITH {_CLOUD}, p AS (SELECT scan_id, x_mm, y_mm FROM cloud) SELECT scan_id, CAST(floor((x_mm - 5000) / 1e2) AS INT) AS bin, CAST(trunc((x_mm - 5000) / 1e2) AS INT) AS cell, count(*) AS n FROM p GROUP BY 1, 2, 3"
)
def world_to_cell(spark, d):
    return cloud(spark, d).groupBy("scan_id", geo.bin_index("x_mm", 5000, 100.0).alias("bin"), geo.world_to_cell("x_mm", 5000, 100.0).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_CLOUD}, p AS (SELECT scan_id, x_mm / 1e3 - 5 x, y_mm / 1e3 - 5 y, z_mm / 1e3 z FROM cloud)
SELECT scan_id, count(*) AS n, count(*) FILTER (WHERE sqrt(x*x + y*y + z*z) > 5e-1 AND sqrt(x*x + y*y + z*z) < 4e0) AS in_range, count(*) FILTER (WHERE x*x + y*y > 45e-2 * 45e-2) AS off_body FROM p GROUP BY 1"""
)
def range_filter(spark, d):
    p = metres(spark, d).withColumns({"x": F.col("x") - 5, "y": F.col("y") - 5})
    return p.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(geo.within_range("x", "y", "z", 0.5, 4.0)).alias("in_range"), F.count_if(geo.away_from_body("x", "y", 0.0, 0.0, 0.45)).alias("off_body"))


@query(f"WITH {_CLOUD} SELECT CAST(greatest(least(round_even(z_mm / 1e3 * 100, 0), 32000), -32000) AS SMALLINT) AS cm, count(*) AS n FROM cloud GROUP BY 1")
def quantize_cm(spark, d):
    return metres(spark, d).groupBy(geo.to_cm("z").alias("cm")).agg(F.count(F.lit(1)).alias("n"))


_Q = (0.1, -0.2, 0.3, math.sqrt(1 - 0.14))
_R = [
    [1 - 2 * (_Q[1] ** 2 + _Q[2] ** 2), 2 * (_Q[0] * _Q[1] - _Q[2] * _Q[3]), 2 * (_Q[0] * _Q[2] + _Q[1] * _Q[3])],
    [2 * (_Q[0] * _Q[1] + _Q[2] * _Q[3]), 1 - 2 * (_Q[0] ** 2 + _Q[2] ** 2), 2 * (_Q[1] * _Q[2] - _Q[0] * _Q[3])],
    [2 * (_Q[0] * _Q[2] - _Q[1] * _Q[3]), 2 * (_Q[1] * _Q[2] + _Q[0] * _Q[3]), 1 - 2 * (_Q[0] ** 2 + _Q[1] ** 2)],
]


@query(
    f"""WITH {_CLOUD} SELECT scan_id, l_orderkey, x_mm, y_mm, {", ".join(f"round({a!r} * (x_mm / 1e3) + {b!r} * (y_mm / 1e3) + {c!r} * (z_mm / 1e3), 6) AS {n}" for n, (a, b, c) in zip(("rx", "ry", "rz"), _R))},
 {round(math.atan2(2 * (_Q[3] * _Q[2] + _Q[0] * _Q[1]), 1 - 2 * (_Q[1] ** 2 + _Q[2] ** 2)), 6)!r}::DOUBLE AS yaw FROM cloud"""
)
def rigid_transform(spark, d):
    q = [F.lit(v) for v in _Q]
    c = cloud(spark, d)
    x, y, z = geo.quaternion_rotated(*q, F.col("x_mm") / 1e3, F.col("y_mm") / 1e3, F.col("z_mm") / 1e3)
    return c.select("scan_id", "l_orderkey", "x_mm", "y_mm", _rounded(x).alias("rx"), _rounded(y).alias("ry"), _rounded(z).alias("rz"), _rounded(geo.yaw_of(*q)).alias("yaw"))


@query(f"WITH {_CLOUD} SELECT scan_id, count(*) AS n, CAST(sum(z_mm) AS BIGINT) AS sz FROM cloud WHERE l_orderkey % 7 = 0 GROUP BY 1")
def stride_sample(spark, d):
    return cloud(spark, d).filter("l_orderkey % 7 = 0").groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"), F.sum("z_mm").alias("sz"))


@query(f"WITH {_stats()}{_smooth(3)} SELECT a.r AS row, a.c AS col, round(a.e, 6) AS once, round(b.e, 6) AS thrice FROM e1 a JOIN e3 b USING (g, r, c)")
def smooth(spark, d):
    base = grid.layers(stats(spark, d), 1e-3).select("grid_id", "row", "col", F.col("elevation"))
    one = grid.smoothed(base, 1)
    return one.join(grid.smoothed(one, 2).withColumnRenamed("elevation", "thrice"), grid.KEY).select("row", "col", _rounded(F.col("elevation"), 6).alias("once"), _round("thrice"))


@query(f"WITH {_chain()} SELECT r AS row, c AS col, n, round(e, 6) AS elevation, round(slope, 6) AS slope, round(step, 6) AS step, lethal, round(cost, 6) AS cost FROM cells")
def cost_grid(spark, d):
    return terrain(spark, d).select("row", "col", "n", _round("elevation"), _round("slope"), _round("step"), "lethal", _round("cost"))


@query(f"WITH {_chain(True)} SELECT g AS grid_id, r % 1000 AS row, c AS col, raw, deblobbed, lethal AS inflated FROM cells")
def lethal_steps(spark, d):
    raw = grid.lethal(grid.gradients(grid.smoothed(grid.layers(stats(spark, d, True), 1e-3), 1), 0.1), ROBOT).withColumn("raw", F.col("lethal"))
    clean = grid.without_specks(raw, 3).withColumn("deblobbed", F.col("lethal"))
    return grid.dilated(clean, 3).select("grid_id", "row", "col", "raw", "deblobbed", F.col("lethal").alias("inflated"))


def _grids(spark, d) -> DataFrame:
    """The grid of each scan."""
    return cloud(spark, d).select(F.col("scan_id").alias("grid_id")).distinct().select("grid_id", F.lit(SIDE).alias("rows"), F.lit(SIDE).alias("cols"))


_ALL = "allc AS (SELECT g, CAST(1000 * g + a.i AS INT) r, CAST(b.i AS INT) c FROM (SELECT DISTINCT scan_id g FROM cloud), range(0, 100) a(i), range(0, 100) b(i))"


@query(f"WITH {_chain(True)}, {_ALL} SELECT g AS grid_id, count(*) AS cells, count(*) FILTER (WHERE n IS NULL) AS unknown, count(*) FILTER (WHERE lethal) AS lethal, CAST(coalesce(sum(n), 0) AS BIGINT) AS points FROM allc LEFT JOIN cells USING (g, r, c) GROUP BY 1")
def grid_meta(spark, d):
    all_ = grid.dense(terrain(spark, d, True), _grids(spark, d))
    return all_.groupBy("grid_id").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("n").isNull()).alias("unknown"), F.count_if("lethal").alias("lethal"), F.coalesce(F.sum("n"), F.lit(0)).alias("points"))


@query(
    f"""WITH {_chain(True)}, {_ALL}, h AS (SELECT g, greatest(quantile_cont(cost, 0.99), 1000001e-6) hi FROM cells GROUP BY g)
SELECT g AS grid_id, r % 1000 AS row, c AS col, CAST(CASE WHEN n IS NULL THEN -1 WHEN lethal THEN 100 ELSE greatest(1e0, least(99e0, round_even((cost - 1e0) / (hi - 1e0) * 98e0, 0) + 1e0)) END AS INT) AS value FROM allc LEFT JOIN cells USING (g, r, c) LEFT JOIN h USING (g)"""
)
def occupancy(spark, d):
    return grid.occupancy(terrain(spark, d, True), _grids(spark, d)).select("grid_id", "row", "col", "value")


@query(
    f"""WITH {_chain(True)}, {_ALL}, f AS (SELECT g, r, c FROM cells WHERE NOT lethal), nf AS (SELECT g, r, c FROM allc ANTI JOIN f USING (g, r, c))
SELECT g AS grid_id, r % 1000 AS row, c AS col FROM f ANTI JOIN (SELECT DISTINCT nf.g, nf.r + dr r, nf.c + dc c FROM nf, off WHERE dr*dr + dc*dc <= 1) x USING (g, r, c)"""
)
def erode_mask(spark, d):
    return grid.eroded(terrain(spark, d, True).filter("NOT lethal"), _grids(spark, d), 1).select("grid_id", "row", "col")


_MEASURES = f"""{_CLOUD}, w AS (SELECT scan_id, CAST(y_mm // 100 AS INT) r, CAST(x_mm // 100 AS INT) c, z_mm / 1e3 z, 9e-4 + 4e-4 * ((x_mm / 1e3 - 5) ** 2 + (y_mm / 1e3 - 5) ** 2 + (z_mm / 1e3 - 15e-1) ** 2) v FROM cloud),
m AS (SELECT scan_id, r, c, sum(z / v) / sum(1e0 / v) z, 1e0 / sum(1e0 / v) v, count(*) hits FROM w GROUP BY ALL)"""


def measures(spark, d) -> DataFrame:
    p = metres(spark, d).withColumns({"row": F.floor(F.round(F.col("y") * 1000) / 100).cast("int"), "col": F.floor(F.round(F.col("x") * 1000) / 100).cast("int"), "sx": F.lit(5.0), "sy": F.lit(5.0), "sz": F.lit(1.5)})
    return fusion.scan_measures(p, KALMAN)


@query(f"WITH {_MEASURES} SELECT scan_id, r AS row, c AS col, round(z, 6) AS z, round(v, 8) AS var, hits FROM m")
def kalman_scan_measure(spark, d):
    return measures(spark, d).select("scan_id", "row", "col", _round("z"), _round("var", 8), "hits")


@query(f"WITH {_MEASURES} SELECT r AS row, c AS col, round(sum(z / v) / sum(1e0 / v), 6) AS height, round(1e0 / sum(1e0 / v), 8) AS variance, CAST(sum(hits) AS BIGINT) AS hits FROM m GROUP BY 1, 2")
def kalman_fused(spark, d):
    return fusion.fused(measures(spark, d)).select("row", "col", _round("height"), _round("variance", 8), "hits")


_QV = "1e-4"


@query(
    f"""WITH RECURSIVE {_MEASURES}, k AS (SELECT 0 s, r, c, NULL::DOUBLE h, NULL::DOUBLE p FROM (SELECT DISTINCT r, c FROM m)
UNION ALL SELECT k.s + 1, k.r, k.c, CASE WHEN m.z IS NULL THEN h WHEN h IS NULL THEN m.z ELSE h + (p + {_QV}) / (p + {_QV} + m.v) * (m.z - h) END,
 CASE WHEN m.z IS NULL THEN p + {_QV} WHEN h IS NULL THEN m.v ELSE (1 - (p + {_QV}) / (p + {_QV} + m.v)) * (p + {_QV}) END FROM k LEFT JOIN m ON m.scan_id = k.s + 1 AND m.r = k.r AND m.c = k.c WHERE k.s < 7)
SELECT r AS row, c AS col, round(h, 6) AS height, round(p, 8) AS variance FROM k WHERE s = 7"""
)
def kalman_with_predict(spark, d):
    return fusion.fused_with_process(measures(spark, d), KALMAN.process_var, 7).select("row", "col", _round("height"), _round("variance", 8))


@query(
    f"""WITH {_MEASURES}, {_OFFSETS}, e0 AS (SELECT 0::BIGINT g, r, c, sum(hits) n, sum(z / v) / sum(1e0 / v) e, sqrt(1e0 / sum(1e0 / v)) rough FROM m GROUP BY r, c){_smooth(1)},
{_derived(f"slope > {_TAN} OR step > 18e-2", f"CASE WHEN rough * rough > 5e-2 THEN 50e0 ELSE 1e0 + 3e0 * slope / {_TAN} + 2e0 * rough END")}
SELECT r AS row, c AS col, CAST(CASE WHEN lethal THEN 1 WHEN rough * rough > 5e-2 THEN 2 ELSE 0 END AS TINYINT) AS class, round(cost, 6) AS cost, round(rough, 6) AS roughness FROM cells"""
)
def kalman_cost_grid(spark, d):
    return fusion.fused_grid(fusion.fused(measures(spark, d)), ROBOT, KALMAN).select("row", "col", "class", _round("cost"), _round("roughness"))


_LOCAL = f"{_CLOUD}, lo AS (SELECT scan_id s, CAST(y_mm // 100 AS INT) r, CAST(x_mm // 100 AS INT) c, CAST(sum(z_mm) AS BIGINT) / count(*) * 1e-3 e, CASE WHEN max(z_mm) > 600 THEN 1 ELSE 0 END k, least(greatest(count(*), 1), 20) n FROM cloud GROUP BY ALL)"


@query(
    f"""WITH RECURSIVE {_LOCAL}, f AS (SELECT 0 s, r, c, 0e0 e, 0 k, 0 w FROM (SELECT DISTINCT r, c FROM lo)
UNION ALL SELECT f.s + 1, f.r, f.c, CASE WHEN lo.e IS NULL THEN f.e WHEN w = 0 THEN lo.e ELSE (f.e * least(w, 80) + lo.e * n) / (least(w, 80) + n) END, coalesce(lo.k, f.k),
 CASE WHEN lo.e IS NULL THEN w ELSE CAST(least(least(w, 80) + n, 100) AS INT) END FROM f LEFT JOIN lo ON lo.s = f.s + 1 AND lo.r = f.r AND lo.c = f.c WHERE f.s < 7)
SELECT c AS ix, r AS iy, round(e, 6) AS elevation, CAST(k AS TINYINT) AS class, w AS weight FROM f WHERE s = 7"""
)
def global_map(spark, d):
    c = cloud(spark, d).groupBy(F.col("scan_id").alias("seq"), F.floor(F.col("y_mm") / 100).cast("int").alias("row"), F.floor(F.col("x_mm") / 100).cast("int").alias("col"))
    local = c.agg((F.sum("z_mm") / F.count(F.lit(1)) * 1e-3).alias("elevation"), F.when(F.max("z_mm") > 600, 1).otherwise(0).cast("tinyint").alias("class"), F.count(F.lit(1)).cast("int").alias("n"))
    return fusion.folded_map(local.withColumns({"ix": F.col("col"), "iy": F.col("row"), "distance": F.lit(0.0)})).select("ix", "iy", _round("elevation"), "class", "weight")


_FREE = f"{_chain(True)}, f AS MATERIALIZED (SELECT g, r, c, cost FROM cells WHERE NOT lethal)"


def free(spark, d) -> DataFrame:
    """Free cells of each scan's grid."""
    return terrain(spark, d, True).filter("NOT lethal").select("grid_id", "row", "col", "elevation", "cost")


def firsts(f: DataFrame) -> DataFrame:
    """The first free cell of each grid."""
    return f.groupBy("grid_id").agg(F.min(F.struct("row", "col")).alias("s")).select("grid_id", "s.row", "s.col")


def _labels(ways: str = "TRUE") -> str:
    """The least cell id of the group of each free cell, over the neighbours that `ways` allows."""
    return f"""{_FREE}, k(g, r, c, id) USING KEY (g, r, c) AS (SELECT g, r, c, r * 100 + c FROM f
UNION SELECT b.g, b.r, b.c, min(k.id) FROM k, box, f b, recurring.k o WHERE {ways} AND b.r = k.r + dr AND b.c = k.c + dc AND o.r = b.r AND o.c = b.c AND k.id < o.id GROUP BY b.g, b.r, b.c)"""


_LABELS = _labels()


@query(f"WITH RECURSIVE {_LABELS} SELECT g AS grid_id, r % 1000 AS row, c AS col, CAST(id // 100 % 1000 AS INT) AS root_row, CAST(id % 100 AS INT) AS root_col FROM k")
def components(spark, d):
    return graph.components(free(spark, d)).select("grid_id", "row", "col", F.col("component.row").alias("root_row"), F.col("component.col").alias("root_col"))


@query(
    f"""WITH RECURSIVE {_LABELS}, z AS (SELECT g, id, count(*) n FROM k GROUP BY g, id), best AS (SELECT g, first(id ORDER BY n DESC, id) id, max(n) n FROM z GROUP BY g), j AS (SELECT k.g, k.r % 1000 r, k.c, best.n FROM k JOIN best USING (g, id))
SELECT g AS grid_id, any_value(n) AS cells, first(r ORDER BY r + c, r, c) AS start_row, first(c ORDER BY r + c, r, c) AS start_col, first(r ORDER BY r + c DESC, r, c) AS goal_row, first(c ORDER BY r + c DESC, r, c) AS goal_col FROM j GROUP BY g"""
)
def largest_component(spark, d):
    return graph.largest_component(free(spark, d))


@query(
    f"""WITH RECURSIVE {_FREE}, k AS (SELECT g, CAST(min(r * 100 + c) // 100 AS INT) r, CAST(min(r * 100 + c) % 100 AS INT) c FROM f GROUP BY g
UNION SELECT b.g, b.r, b.c FROM k, box, f b WHERE abs(dr) + abs(dc) = 1 AND b.r = k.r + dr AND b.c = k.c + dc) SELECT g AS grid_id, r % 1000 AS row, c AS col FROM k"""
)
def reachable(spark, d):
    f = free(spark, d)
    return graph.reachable(f, firsts(f)).select("grid_id", "row", "col")


_EDGES = """edges AS MATERIALIZED (SELECT a.g, a.r, a.c, b.r r2, b.c c2, CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(2e0) ELSE 1e0 END * 5e-1 * (a.cost + b.cost) w FROM f a JOIN box ON dr <> 0 OR dc <> 0 JOIN f b ON b.r = a.r + dr AND b.c = a.c + dc
 LEFT JOIN f u ON u.r = a.r AND u.c = a.c + dc LEFT JOIN f v ON v.r = a.r + dr AND v.c = a.c WHERE dr = 0 OR dc = 0 OR (u.r IS NOT NULL AND v.r IS NOT NULL))"""


@query(
    f"""WITH RECURSIVE {_FREE}, {_EDGES}, s0 AS (SELECT g, min(r * 100 + c) id FROM f GROUP BY g),
k(g, r, c, t) USING KEY (g, r, c) AS (SELECT f.g, r, c, CASE WHEN r * 100 + c = id THEN 0e0 ELSE 'Infinity'::DOUBLE END FROM f JOIN s0 USING (g)
UNION SELECT e.g, e.r2, e.c2, min(k.t + w) FROM k JOIN edges e ON e.r = k.r AND e.c = k.c JOIN recurring.k o ON o.g = e.g AND o.r = e.r2 AND o.c = e.c2 WHERE k.t + w < o.t GROUP BY 1, 2, 3)
SELECT g AS grid_id, r % 1000 AS row, c AS col, round(t, 6) AS total FROM k WHERE t < 'Infinity'::DOUBLE"""
)
def shortest_cost(spark, d):
    f = free(spark, d)
    starts = firsts(f).withColumnsRenamed({"row": "start_row", "col": "start_col"})
    return graph.cost_field(f, starts).select("grid_id", "row", "col", _round("total"))


_GOALS = "q AS (SELECT o_orderkey query_id, 1 + o_orderkey % 7 g, CAST(o_orderkey * 37 % 100 AS INT) r0, CAST(o_custkey * 53 % 100 AS INT) c0, CAST(o_custkey * 71 % 100 AS INT) r1, CAST(o_orderkey * 91 % 100 AS INT) c1 FROM orders)"


def goals(spark, d) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.selectExpr("o_orderkey AS query_id", "1 + o_orderkey % 7 AS grid_id", "CAST(o_orderkey * 37 % 100 AS INT) AS start_row", "CAST(o_custkey * 53 % 100 AS INT) AS start_col", "CAST(o_custkey * 71 % 100 AS INT) AS goal_row", "CAST(o_orderkey * 91 % 100 AS INT) AS goal_col")


@query(
    f"""WITH {_FREE}, {_GOALS}, j AS (SELECT query_id, greatest(abs(f.r % 1000 - r0), abs(f.c - c0)) k, f.r % 1000 r, f.c, r0, c0 FROM q, f WHERE f.g = q.g AND abs(f.r % 1000 - r0) < 25 AND abs(f.c - c0) < 25)
SELECT query_id, first(r ORDER BY k, r - r0, c - c0) AS snap_row, first(c ORDER BY k, r - r0, c - c0) AS snap_col FROM j GROUP BY 1"""
)
def snap_free(spark, d):
    return graph.snapped(free(spark, d), goals(spark, d).select("query_id", "grid_id", F.col("start_row").alias("row"), F.col("start_col").alias("col")), 25)


@query(
    f"""WITH {_chain(True)}, {_ALL}, o AS (SELECT g, r, c FROM cells WHERE lethal)
SELECT a.g AS grid_id, a.r % 1000 AS row, a.c AS col, round(coalesce(min(greatest(abs(a.r - o.r), abs(a.c - o.c)) + (sqrt(2e0) - 1) * least(abs(a.r - o.r), abs(a.c - o.c))), 400), 6) AS distance FROM allc a LEFT JOIN o ON o.g = a.g GROUP BY 1, 2, 3"""
)
def chamfer(spark, d):
    return graph.chamfer(terrain(spark, d, True).filter("lethal"), _grids(spark, d)).select("grid_id", "row", "col", _round("distance"))


@query(
    f"""WITH {_GOALS}, s AS (SELECT query_id, c0 / 1e1 px, r0 / 1e1 py, (c1 - c0) / 1e1 dx, (r1 - r0) / 1e1 dy FROM q)
SELECT query_id, round(px + dx / greatest(greatest(abs(dx), abs(dy)) / 37e-1, 1e0), 6) AS gx, round(py + dy / greatest(greatest(abs(dx), abs(dy)) / 37e-1, 1e0), 6) AS gy FROM s"""
)
def goal_projection(spark, d):
    g = goals(spark, d).select("query_id", *((F.col(a) / 10.0).alias(b) for a, b in (("start_col", "px"), ("start_row", "py"), ("goal_col", "gx"), ("goal_row", "gy"))))
    x, y = geo.projected_goal("gx", "gy", "px", "py", NAV.map_size, NAV.resolution)
    return g.select("query_id", _rounded(x).alias("gx"), _rounded(y).alias("gy"))


_PATH = "p AS (SELECT l_orderkey query_id, CAST(l_linenumber AS INT) seq, min(l_partkey * 13 % 1000) / 1e2 x, min(l_suppkey * 7 % 1000) / 1e2 y FROM lineitem GROUP BY 1, 2)"
_ARC = f"{_PATH}, dd AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0e0) dl FROM p WINDOW w AS (PARTITION BY query_id ORDER BY seq)), arc AS (SELECT *, sum(dl) OVER (PARTITION BY query_id ORDER BY seq ROWS UNBOUNDED PRECEDING) arc FROM dd)"


def polylines(spark, d) -> DataFrame:
    t = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("int").alias("seq"))
    return t.agg(F.expr("min(l_partkey * 13 % 1000) / 1e2").alias("x"), F.expr("min(l_suppkey * 7 % 1000) / 1e2").alias("y"))


@query(f"WITH {_ARC} SELECT query_id, round(sum(dl), 6) AS length FROM arc GROUP BY 1")
def path_length(spark, d):
    return motion.path_lengths(polylines(spark, d)).select("query_id", _round("length"))


@query(
    f"""WITH {_ARC}, nr AS (SELECT query_id, first(seq ORDER BY sqrt((x - 5) ** 2 + (y - 5) ** 2), seq) s0, first(arc ORDER BY sqrt((x - 5) ** 2 + (y - 5) ** 2), seq) a0 FROM arc GROUP BY 1),
ah AS (SELECT arc.*, arc - a0 >= 2e0 far FROM arc JOIN nr USING (query_id) WHERE seq >= s0)
SELECT query_id, coalesce(min(seq) FILTER (WHERE far), max(seq)) AS seq FROM ah GROUP BY 1"""
)
def carrot(spark, d):
    p = polylines(spark, d)
    return motion.carrots(p, p.select("query_id").distinct().withColumns({"px": F.lit(5.0), "py": F.lit(5.0)}), 2.0).select("query_id", "seq")


@query(
    f"""WITH {_ARC}, t AS (SELECT query_id, max(arc) total FROM arc GROUP BY 1), nx AS (SELECT *, lead(x) OVER w x2, lead(y) OVER w y2, lead(arc) OVER w a2 FROM arc WINDOW w AS (PARTITION BY query_id ORDER BY seq))
SELECT query_id, 3e0 AS s, round(x + coalesce(CASE WHEN a2 > arc THEN (least(3e0, total) - arc) / (a2 - arc) ELSE 0 END * (x2 - x), 0), 6) AS x, round(y + coalesce(CASE WHEN a2 > arc THEN (least(3e0, total) - arc) / (a2 - arc) ELSE 0 END * (y2 - y), 0), 6) AS y
FROM nx JOIN t USING (query_id) WHERE arc <= least(3e0, total) AND (a2 > least(3e0, total) OR a2 IS NULL)"""
)
def arc_interp(spark, d):
    p = polylines(spark, d)
    return motion.arc_interpolated(p, p.select("query_id").distinct().withColumn("s", F.lit(3.0))).select("query_id", "s", _round("x"), _round("y"))


_POSE = """s AS (SELECT o_orderkey query_id, o_orderkey * 37 % 100 / 1e1 x, o_custkey * 53 % 100 / 1e1 y, (o_orderkey % 63) / 1e1 yaw, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey * 71 % 100 / 1e1 END goal_x,
 o_orderkey * 91 % 100 / 1e1 goal_y, (o_custkey % 13) / 1e1 scan_age, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE (o_custkey + 3) * 71 % 100 / 1e1 END carrot_x, (o_orderkey + 3) * 91 % 100 / 1e1 carrot_y FROM orders)"""


@query(
    f"""WITH {_POSE}, e AS (SELECT *, atan2(sin(atan2(carrot_y - y, carrot_x - x) - yaw), cos(atan2(carrot_y - y, carrot_x - x) - yaw)) err,
 CASE WHEN goal_x IS NULL THEN 'waiting for goal' WHEN sqrt((goal_x - x) ** 2 + (goal_y - y) ** 2) <= 25e-2 THEN 'goal reached' WHEN scan_age > 1 THEN 'scan timeout - stopped' WHEN carrot_x IS NULL THEN 'no path' END st FROM s)
SELECT query_id, round(CASE WHEN st IS NOT NULL OR abs(err) > 1e0 THEN 0e0 ELSE 5e-1 * greatest(0e0, cos(err)) END, 6) AS vx, round(CASE WHEN st IS NOT NULL THEN 0e0 ELSE greatest(-12e-1, least(12e-1, err * 2e0)) END, 6) AS wz,
 coalesce(st, CASE WHEN abs(err) > 1e0 THEN 'rotating to heading' ELSE 'following path' END) AS status FROM e"""
)
def command(spark, d):
    s = spark.read.parquet(f"{d}/orders.parquet").selectExpr(
        "o_orderkey AS query_id", "o_orderkey * 37 % 100 / 1e1 AS x", "o_custkey * 53 % 100 / 1e1 AS y", "(o_orderkey % 63) / 1e1 AS yaw", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey * 71 % 100 / 1e1 END AS goal_x",
        "o_orderkey * 91 % 100 / 1e1 AS goal_y", "(o_custkey % 13) / 1e1 AS scan_age", "CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE (o_custkey + 3) * 71 % 100 / 1e1 END AS carrot_x", "(o_orderkey + 3) * 91 % 100 / 1e1 AS carrot_y",
    )
    vx, wz, status = motion.command(NAV)
    return s.select("query_id", vx, wz, status).select("query_id", _round("vx"), _round("wz"), "status")


_FIELD = "fl AS (SELECT vec_id, embedding[1]::DOUBLE * 4 x, embedding[2]::DOUBLE * 4 y, abs(embedding[3]::DOUBLE) rho, embedding[4]::DOUBLE gx, embedding[5]::DOUBLE gy FROM embeddings)"


@query(
    f"""WITH {_FIELD}, a AS (SELECT *, 1 - x dx, 2 - y dy, sqrt((1 - x) ** 2 + (2 - y) ** 2) dd, sqrt(gx * gx + gy * gy) g FROM fl),
b AS (SELECT *, CASE WHEN dd > 2 THEN 2 / dd ELSE 1 END pull, CASE WHEN rho > 0 AND rho <= 8e-1 THEN least(6e-1 * (1 / rho - 1 / 8e-1) / (rho * rho), 50) ELSE 0 END push FROM a)
SELECT vec_id, round(pull * dx + push * CASE WHEN g > 1e-6 THEN gx / g ELSE 0 END, 4) AS fx, round(pull * dy + push * CASE WHEN g > 1e-6 THEN gy / g ELSE 0 END, 4) AS fy FROM b"""
)
def apf_force(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    v = lambda i: F.col("embedding")[i].cast("double")
    f = e.select("vec_id", (v(0) * 4).alias("x"), (v(1) * 4).alias("y"), F.abs(v(2)).alias("rho"), v(3).alias("gx"), v(4).alias("gy"), F.lit(1.0).alias("goal_x"), F.lit(2.0).alias("goal_y"))
    return motion.forces(f, APF).select("vec_id", _rounded(F.col("fx"), 4).alias("fx"), _rounded(F.col("fy"), 4).alias("fy"))


_EV = "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 t FROM events)"


def events(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


@query(f"WITH {_EV} SELECT event_id, count(*) OVER w AS scans, round(sum(value) OVER w, 4) AS total FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400e0 PRECEDING AND CURRENT ROW)")
def scan_buffer(spark, d):
    return timed.buffered(events(spark, d), "user_id", "t", 86400.0, [("scans", F.count(F.lit(1))), ("total", F.sum("value"))]).select("event_id", "scans", _rounded(F.col("total"), 4).alias("total"))


@query(
    f"""WITH {_EV}, l AS (SELECT * FROM ev WHERE event_type = (SELECT min(event_type) FROM events)), r AS (SELECT * FROM ev WHERE event_type <> (SELECT min(event_type) FROM events)),
j AS (SELECT l.event_id, r.event_id pid, r.value pv, row_number() OVER (PARTITION BY l.event_id ORDER BY r.t DESC, r.event_id DESC) k FROM l LEFT JOIN r ON r.user_id = l.user_id AND r.t <= l.t)
SELECT event_id, pid AS pose_id, pv AS pose_value FROM j WHERE k = 1"""
)
def asof_pose(spark, d):
    e = events(spark, d)
    first = e.agg(F.min("event_type")).scalar()
    right = e.filter(F.col("event_type") != first).select("user_id", "t", "event_id", F.col("event_id").alias("pose_id"), F.col("value").alias("pose_value"))
    return timed.latest_before(e.filter(F.col("event_type") == first).select("user_id", "t", "event_id"), right, "user_id", "t", "event_id", ["pose_id", "pose_value"]).select("event_id", "pose_id", "pose_value")


@query(f"WITH {_EV}, k AS (SELECT *, sum(event_id % 50) OVER w tot, row_number() OVER w rn FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING)) SELECT event_id, user_id FROM k WHERE tot <= 200 OR rn = 1")
def point_budget(spark, d):
    return timed.within_budget(events(spark, d).withColumn("points", F.col("event_id") % 50), "user_id", "event_id", "points", 200).select("event_id", "user_id")


@query(
    f"""WITH RECURSIVE {_EV}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) k FROM ev),
f AS (SELECT user_id, event_id, k, t last, true ok FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.event_id, o.k, CASE WHEN o.t - last >= 43200 THEN o.t ELSE last END, o.t - last >= 43200 FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, event_id FROM f WHERE ok"""
)
def rate_limit(spark, d):
    return timed.rate_limited(events(spark, d), "user_id", "t", "event_id", 43200.0).select("user_id", "event_id")


@query(
    f"""WITH {_CLOUD}, v AS (SELECT 0 axis, x_mm v FROM cloud UNION ALL SELECT 1, y_mm FROM cloud UNION ALL SELECT 2, z_mm FROM cloud), r AS (SELECT axis, min(v) lo, max(v) hi FROM v GROUP BY 1),
h AS (SELECT axis, CAST(least(floor((v - lo) * 50 / (hi - lo)), 49) AS INT) bin, count(*) n FROM v JOIN r USING (axis) GROUP BY 1, 2) SELECT axis, max(n) AS densest, first(bin ORDER BY n DESC, bin) AS bin FROM h GROUP BY 1"""
)
def up_axis(spark, d):
    points = cloud(spark, d).selectExpr("x_mm AS x", "y_mm AS y", "z_mm AS z")
    return orient.densest_bins(points).select("axis", "densest", "bin")


_PLANES = [(0.0, 0.0, 1.0, 0.0), (-0.04, 0.0, 0.9992, 0.0), (1.0, 0.0, 0.0, -3.0), (0.0, 0.0, 1.0, -0.12)]


@query(f"WITH {_CLOUD}, pl AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE, {e!r}::DOUBLE)' for i, (a, b, c, e) in enumerate(_PLANES))}) t(plane, a, b, c, e)) SELECT plane, count(*) FILTER (WHERE abs(a * (x_mm / 1e3) + b * (y_mm / 1e3) + c * (z_mm / 1e3) + e) < 50001e-6) AS inliers FROM pl, cloud GROUP BY 1")
def plane_inliers(spark, d):
    c = metres(spark, d)
    return c.agg(*(F.count_if(F.abs(a * F.col("x") + b * F.col("y") + k * F.col("z") + e) < 0.050001).alias(str(i)) for i, (a, b, k, e) in enumerate(_PLANES))).select(
        F.explode(F.array(*(F.struct(F.lit(i).alias("plane"), F.col(str(i)).alias("inliers")) for i in range(len(_PLANES))))).alias("p")
    ).select("p.*")


#: Tasks among which the queries of a grid are dealt.
SPREAD = 4


def planned(spark, d) -> tuple[DataFrame, DataFrame]:
    """Free cells, and the paths of all suppliers' routes between free cells next to their ends."""
    f = free(spark, d)
    ends = {"start": ("37 * s_suppkey", "53 * s_suppkey + 11 * s_nationkey"), "goal": ("71 * s_suppkey + 50", "91 * s_suppkey + 29 * s_nationkey + 50")}
    asked = spark.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey AS query_id", "1 + s_suppkey % 7 AS grid_id", *(f"CAST(({x}) % 100 AS INT) AS {end}_{axis}" for end, xs in ends.items() for axis, x in zip(("row", "col"), xs)))
    for end in ends:
        near = graph.snapped(f, asked.select("query_id", "grid_id", F.col(f"{end}_row").alias("row"), F.col(f"{end}_col").alias("col")), 25)
        asked = asked.join(near, "query_id", "left").withColumns({f"{end}_{axis}": F.coalesce(f"snap_{axis}", f"{end}_{axis}") for axis in ("row", "col")}).drop("snap_row", "snap_col")
    return f, graph.plan_paths(f, asked, spread=SPREAD)


#: A diagonal step needs both cells beside it, so what can be reached is a group over four neighbours.
_ROUTES = f"""{_labels("abs(dr) + abs(dc) = 1")}, {_EDGES}, ask AS (SELECT s_suppkey q, 1 + s_suppkey % 7 g, CAST(37 * s_suppkey % 100 AS INT) r0, CAST((53 * s_suppkey + 11 * s_nationkey) % 100 AS INT) c0, CAST((71 * s_suppkey + 50) % 100 AS INT) r1, CAST((91 * s_suppkey + 29 * s_nationkey + 50) % 100 AS INT) c1 FROM supplier),
{", ".join(f"""n{e} AS (SELECT q, first(f.r % 1000 ORDER BY greatest(abs(f.r % 1000 - r{e}), abs(f.c - c{e})), f.r % 1000 - r{e}, f.c - c{e}) r, first(c ORDER BY greatest(abs(f.r % 1000 - r{e}), abs(f.c - c{e})), f.r % 1000 - r{e}, f.c - c{e}) c
 FROM ask, f WHERE f.g = ask.g AND abs(f.r % 1000 - r{e}) < 25 AND abs(f.c - c{e}) < 25 GROUP BY q)""" for e in (0, 1))},
route AS MATERIALIZED (SELECT ask.q, ask.g, n0.r r0, n0.c c0, n1.r r1, n1.c c1, a.id = b.id AS near FROM ask LEFT JOIN n0 ON n0.q = ask.q LEFT JOIN n1 ON n1.q = ask.q LEFT JOIN k a ON a.r = 1000 * ask.g + n0.r AND a.c = n0.c LEFT JOIN k b ON b.r = 1000 * ask.g + n1.r AND b.c = n1.c)"""


def _search(routes: str) -> str:
    """Least costs t of the cells around, with the cell before, from the starts of some routes (q, g, r0, c0, near: whether both ends are in one group of cells)."""
    return f"""sp(q, g, r, c, t, pr, pc) USING KEY (q, r, c) AS (SELECT q, b.g, b.r, b.c, CASE WHEN b.r = a.r AND b.c = a.c THEN 0e0 ELSE 'Infinity'::DOUBLE END, -1, -1 FROM {routes} JOIN k a ON a.r = 1000 * {routes}.g + r0 AND a.c = c0 JOIN k b ON b.g = a.g AND b.id = a.id WHERE near
UNION SELECT sp.q, e.g, e.r2, e.c2, min(sp.t + w), arg_min(e.r, sp.t + w), arg_min(e.c, sp.t + w) FROM sp JOIN edges e ON e.r = sp.r AND e.c = sp.c JOIN recurring.sp o ON o.q = sp.q AND o.r = e.r2 AND o.c = e.c2 WHERE sp.t + w < o.t GROUP BY sp.q, e.g, e.r2, e.c2)"""


@query(
    f"""WITH RECURSIVE {_ROUTES}, {_search("route")}
SELECT route.q AS query_id, CASE WHEN r0 IS NULL OR r1 IS NULL THEN 'blocked' WHEN t < 'Infinity'::DOUBLE THEN 'found' ELSE 'unreachable' END AS status, round(CASE WHEN t < 'Infinity'::DOUBLE THEN t END, 6) AS cost
FROM route LEFT JOIN sp ON sp.q = route.q AND sp.r % 1000 = r1 AND sp.c = c1"""
)
def plan_paths(spark, d):
    return planned(spark, d)[1].select("query_id", "status", _round("cost"))


#: Distances and gradients of the free cells' grids, as far as their largest row and column.
_DISTANCES = """side AS (SELECT g, max(r % 1000) + 1 h, max(c) + 1 w FROM f GROUP BY g), whole AS MATERIALIZED (SELECT g, CAST(1000 * g + a.i AS INT) r, CAST(b.i AS INT) c, CAST(h + 0 * a.i AS INT) h, CAST(w + 0 * b.i AS INT) w FROM side, range(0, h) a(i), range(0, w) b(i)),
wall AS MATERIALIZED (SELECT x.g, x.r, x.c, h, w, CASE WHEN f.cost IS NULL THEN x.r END o FROM whole x LEFT JOIN f ON f.g = x.g AND f.r = x.r AND f.c = x.c),
up AS MATERIALIZED (SELECT g, r, c, h, w, least(r - max(o) OVER (PARTITION BY g, c ORDER BY r), min(o) OVER (PARTITION BY g, c ORDER BY r DESC) - r) v FROM wall),
ds AS MATERIALIZED (SELECT a.g, a.r, a.c, any_value(a.h) h, any_value(a.w) w, coalesce(min(greatest(b.v, abs(a.c - b.c)) + (sqrt(2e0) - 1e0) * least(b.v, abs(a.c - b.c))), 2e0 * (any_value(a.h) + any_value(a.w))) * 1e-1 d
 FROM up a LEFT JOIN (SELECT g, r, c, v FROM up WHERE v IS NOT NULL) b ON b.g = a.g AND b.r = a.r GROUP BY a.g, a.r, a.c),
fl AS MATERIALIZED (SELECT a.*, CASE WHEN n.d IS NULL THEN (a.d - s.d) / 1e-1 WHEN s.d IS NULL THEN (n.d - a.d) / 1e-1 ELSE (n.d - s.d) / 2e-1 END gy, CASE WHEN e.d IS NULL THEN (a.d - v.d) / 1e-1 WHEN v.d IS NULL THEN (e.d - a.d) / 1e-1 ELSE (e.d - v.d) / 2e-1 END gx
 FROM ds a LEFT JOIN ds n ON n.g = a.g AND n.r = a.r + 1 AND n.c = a.c LEFT JOIN ds s ON s.g = a.g AND s.r = a.r - 1 AND s.c = a.c LEFT JOIN ds e ON e.g = a.g AND e.r = a.r AND e.c = a.c + 1 LEFT JOIN ds v ON v.g = a.g AND v.r = a.r AND v.c = a.c - 1)"""
_AT = "a.r = 1000 * {p}.g + greatest(0, least(h - 1, CAST(round_even({p}.y / 1e-1 - 5e-1, 0) AS INT))) AND a.c = greatest(0, least(w - 1, CAST(round_even({p}.x / 1e-1 - 5e-1, 0) AS INT)))"

_PUSH = "CASE WHEN d < 5e-1 AND sqrt(gx * gx + gy * gy) > 1e-6 THEN 15e-2 * ((5e-1 - d) / 5e-1) / sqrt(gx * gx + gy * gy) ELSE 0e0 END"


_BACK = """bt(q, g, n, r, c) AS (SELECT route.q, route.g, 0, sp.r, sp.c FROM route JOIN sp ON sp.q = route.q AND sp.r % 1000 = r1 AND sp.c = c1 WHERE t < 'Infinity'::DOUBLE
UNION ALL SELECT bt.q, bt.g, n + 1, pr, pc FROM bt JOIN sp ON sp.q = bt.q AND sp.r = bt.r AND sp.c = bt.c WHERE pr >= 0), pc AS MATERIALIZED (SELECT q, g, max(n) OVER (PARTITION BY q) - n seq, max(n) OVER (PARTITION BY q) top, r, c FROM bt)"""


def _round_of_band(k: int) -> str:
    """Points b{k} after one more round; written out for each, as joins of a growing recursion are brittle."""
    to = lambda v, n: f"greatest(0, least({n} - 1, CAST(trunc({v} / 1e-1) AS INT)))"
    return f"""b{k} AS MATERIALIZED (SELECT q, m.g, seq, top, CASE WHEN fr.r IS NOT NULL AND seq BETWEEN 1 AND top - 1 THEN mx ELSE x END x, CASE WHEN fr.r IS NOT NULL AND seq BETWEEN 1 AND top - 1 THEN my ELSE y END y FROM
 (SELECT p.*, h, w, p.x + 3e-1 * (5e-1 * (xp + xn) - p.x) + {_PUSH} * gx mx, p.y + 3e-1 * (5e-1 * (yp + yn) - p.y) + {_PUSH} * gy my
  FROM (SELECT *, lag(x) OVER o xp, lead(x) OVER o xn, lag(y) OVER o yp, lead(y) OVER o yn FROM b{k - 1} WINDOW o AS (PARTITION BY q ORDER BY seq)) p JOIN fl a ON {_AT.format(p="p")}) m
 LEFT JOIN f fr ON fr.r = 1000 * m.g + {to("my", "h")} AND fr.c = {to("mx", "w")})"""


@query(
    f"""WITH RECURSIVE {_ROUTES}, {_search("route")}, {_BACK}, {_DISTANCES}, b0 AS MATERIALIZED (SELECT q, g, seq, top, (c + 5e-1) * 1e-1 x, (r % 1000 + 5e-1) * 1e-1 y FROM pc),
{", ".join(_round_of_band(k) for k in range(1, 81))}
SELECT q AS query_id, CAST(seq AS INT) AS seq, round(x, 6) AS x, round(y, 6) AS y FROM b80"""
)
def smooth_paths(spark, d):
    f, p = planned(spark, d)
    return motion.smooth_paths(f, p.withColumn("grid_id", 1 + F.col("query_id") % 7), 0.1, spread=SPREAD).select("query_id", "seq", _round("x"), _round("y"))


#: A step in the field from (x, y) toward (tx, ty): speeds vx, vy and how large the force was.
_MOVE = f"""SELECT *, fx * CASE WHEN sp > 6e-1 THEN 6e-1 / sp ELSE 1e0 END vx, fy * CASE WHEN sp > 6e-1 THEN 6e-1 / sp ELSE 1e0 END vy FROM (SELECT *, sqrt(fx * fx + fy * fy) sp FROM (
 SELECT *, CASE WHEN push IS NULL THEN pull * dx ELSE pull * dx + push * gx / gn END fx, CASE WHEN push IS NULL THEN pull * dy ELSE pull * dy + push * gy / gn END fy FROM (SELECT *, CASE WHEN dd > 2e0 THEN 2e0 / dd ELSE 1e0 END pull,
 CASE WHEN rho > 0 AND rho <= 8e-1 AND gn > 1e-6 THEN least(6e-1 * (1e0 / rho - 1e0 / 8e-1) / (rho * rho), 50e0) END push FROM (SELECT p.*, sqrt(dx * dx + dy * dy) dd, a.d rho, gx, gy, sqrt(gx * gx + gy * gy) gn FROM (SELECT *, tx - x dx, ty - y dy FROM ag) p JOIN fl a ON a.g = p.g AND {_AT.format(p="p")}))))"""


def agents(spark, d) -> DataFrame:
    at = lambda k: f"s_suppkey * {k} % 100 / 1e1"
    return spark.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey AS agent_id", "1 + s_suppkey % 7 AS grid_id", f"{at(53)} AS x", f"{at(37)} AS y", f"array(struct({at(91)} AS x, {at(71)} AS y)) AS goals")


@query(
    f"""WITH {_FREE}, {_DISTANCES}, ag AS (SELECT s_suppkey q, 1 + s_suppkey % 7 g, s_suppkey * 53 % 100 / 1e1 x, s_suppkey * 37 % 100 / 1e1 y, s_suppkey * 91 % 100 / 1e1 tx, s_suppkey * 71 % 100 / 1e1 ty FROM supplier)
SELECT q AS agent_id, round(CASE WHEN dd > 15e-2 THEN x + vx * 1e-1 ELSE x END, 6) AS x, round(CASE WHEN dd > 15e-2 THEN y + vy * 1e-1 ELSE y END, 6) AS y FROM ({_MOVE})"""
)
def apf_step(spark, d):
    """Every agent after its first step in the field."""
    t = motion.rollouts(free(spark, d), agents(spark, d), 0.1, steps=1, spread=SPREAD).groupBy("agent_id")
    return t.agg(_rounded(F.max_by("x", "seq")).alias("x"), _rounded(F.max_by("y", "seq")).alias("y"))


@query()
def apf_rollouts(spark, d):
    t = motion.rollouts(free(spark, d), agents(spark, d), 0.1, spread=SPREAD).groupBy("agent_id")
    last = lambda c: _rounded(F.max_by(c, "seq"), 4).alias(c)
    return t.agg(F.count(F.lit(1)).alias("steps"), last("x"), last("y"), _rounded(F.sum(F.col("x") + 2.0 * F.col("y")), 3).alias("trace"))


# Navigation: requests of suppliers, whose goals may lie outside the grid.
_ASKED = """rq AS (SELECT s_suppkey q, 1 + s_suppkey % 7 g, s_suppkey * 53 % 100 / 1e1 + 5e-2 x, s_suppkey * 37 % 100 / 1e1 + 5e-2 y, CASE WHEN s_suppkey % 17 <> 0 THEN s_suppkey * 91 % 200 / 1e1 - 5 END gx, s_suppkey * 71 % 200 / 1e1 - 5 gy FROM supplier),
pj AS (SELECT *, greatest(greatest(abs(gx - x), abs(gy - y)) / 37e-1, 1e0) sc FROM rq), tg AS (SELECT *, x + (gx - x) / sc tx, y + (gy - y) / sc ty FROM pj)"""
_NEAR = """SELECT tg.q, first(f.r % 1000 ORDER BY greatest(abs(f.r % 1000 - {r}), abs(f.c - {c})), f.r % 1000 - {r}, f.c - {c}) r, first(f.c ORDER BY greatest(abs(f.r % 1000 - {r}), abs(f.c - {c})), f.r % 1000 - {r}, f.c - {c}) c
 FROM tg JOIN f ON f.g = tg.g AND abs(f.r % 1000 - {r}) < 25 AND abs(f.c - {c}) < 25 WHERE gx IS NOT NULL GROUP BY tg.q"""
_CELL = lambda v: f"CAST(trunc({v} / 1e-1) AS INT)"


def requests(spark, d) -> DataFrame:
    at = lambda k: f"s_suppkey * {k} % 100 / 1e1 + 5e-2"
    return spark.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey AS query_id", "1 + s_suppkey % 7 AS grid_id", f"{at(53)} AS x", f"{at(37)} AS y", "CASE WHEN s_suppkey % 17 <> 0 THEN s_suppkey * 91 % 200 / 1e1 - 5 END AS goal_x", "s_suppkey * 71 % 200 / 1e1 - 5 AS goal_y")


@query(
    f"""WITH RECURSIVE {_labels("abs(dr) + abs(dc) = 1")}, {_EDGES}, {_ASKED}, na AS ({_NEAR.format(r=_CELL("y"), c=_CELL("x"))}), nb AS ({_NEAR.format(r=_CELL("ty"), c=_CELL("tx"))}),
en AS (SELECT tg.*, na.r r0, na.c c0, nb.r rb, nb.c cb, a.id ia, b.id ib FROM tg LEFT JOIN na USING (q) LEFT JOIN nb USING (q) LEFT JOIN k a ON a.r = 1000 * tg.g + na.r AND a.c = na.c LEFT JOIN k b ON b.r = 1000 * tg.g + nb.r AND b.c = nb.c),
fb AS (SELECT en.q, arg_min(struct_pack(r := k.r % 1000, c := k.c), struct_pack(d := ((k.c + 5e-1) * 1e-1 - tx) * ((k.c + 5e-1) * 1e-1 - tx) + ((k.r % 1000 + 5e-1) * 1e-1 - ty) * ((k.r % 1000 + 5e-1) * 1e-1 - ty), r := k.r, c := k.c)) b FROM en JOIN k ON k.g = en.g AND k.id = en.ia WHERE ia IS NOT NULL AND (ib IS NULL OR ib <> ia) GROUP BY en.q),
route AS MATERIALIZED (SELECT en.q, en.g, gx, r0, c0, coalesce(fb.b.r, rb) r1, coalesce(fb.b.c, cb) c1, ia IS NOT NULL AS near FROM en LEFT JOIN fb ON fb.q = en.q), {_search("route")}
SELECT route.q AS query_id, CASE WHEN gx IS NULL THEN 'waiting for goal' WHEN r0 IS NULL THEN 'no free space near robot' WHEN r0 = r1 AND c0 = c1 THEN 'no progress possible from here' ELSE 'following path' END AS status, CAST(r1 AS INT) AS goal_row, CAST(c1 AS INT) AS goal_col, round(t, 6) AS cost
FROM route LEFT JOIN sp ON sp.q = route.q AND sp.r % 1000 = r1 AND sp.c = c1"""
)
def replan(spark, d):
    return navigate.replanned(free(spark, d), requests(spark, d), NAV, SPREAD).select("query_id", "status", "goal_row", "goal_col", _round("cost"))


@query(
    f"""WITH {_chain(True)}, {_ALL} SELECT g AS grid_id, r % 1000 AS row, c AS col, CAST(CASE WHEN n IS NULL THEN 2 WHEN lethal THEN 1 ELSE 0 END AS TINYINT) AS class, round(CASE WHEN n IS NULL THEN 50e0 ELSE cost END, 6) AS cost, round(CASE WHEN n IS NULL THEN 1e0 ELSE cost END, 6) AS as_free, round(cost, 6) AS as_lethal FROM allc LEFT JOIN cells USING (g, r, c)"""
)
def unknown_costs(spark, d):
    t, g = terrain(spark, d, True).select("grid_id", "row", "col", "class", "cost"), _grids(spark, d)
    made = navigate.with_unknown(t, g, CFG.unknown_cost)
    for name, more in (("as_free", {"as_free": True}), ("as_lethal", {"lethal": True})):
        made = made.join(navigate.with_unknown(t, g, **more).select(*grid.KEY, F.col("cost").alias(name)), grid.KEY)
    return made.select(*grid.KEY, "class", _round("cost"), _round("as_free"), _round("as_lethal"))


@query(f"WITH {_FREE}, z AS (SELECT g, r % 1000 r, c FROM f) SELECT g AS grid_id, first(r ORDER BY r + c, r, c) AS start_row, first(c ORDER BY r + c, r, c) AS start_col, first(r ORDER BY r + c DESC, r, c) AS goal_row, first(c ORDER BY r + c DESC, r, c) AS goal_col FROM z GROUP BY g HAVING count(*) > 1")
def extreme_ends(spark, d):
    return graph.extreme_ends(free(spark, d))


@query(f"WITH {_CLOUD} SELECT scan_id AS grid_id, round(median(x_mm / 1e3) - 4, 6) AS xmin, round(median(y_mm / 1e3) - 4, 6) AS ymin, round(median(x_mm / 1e3) + 4, 6) AS xmax, round(median(y_mm / 1e3) + 4, 6) AS ymax FROM cloud GROUP BY 1")
def median_window(spark, d):
    return navigate.median_windows(metres(spark, d).withColumn("grid_id", F.col("scan_id")), 8.0).select("grid_id", _round("xmin"), _round("ymin"), _round("xmax"), _round("ymax"))


@query("SELECT l_suppkey AS scan_id, count(*) AS n FROM lineitem WHERE l_quantity > 5 GROUP BY 1 HAVING count(*) >= 500")
def enough_points(spark, d):
    p = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_suppkey AS scan_id", "CASE WHEN l_quantity > 5 THEN l_quantity ELSE double('nan') END AS x", "l_tax AS y", "l_discount AS z")
    return navigate.enough_points(p, 500).groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_MEASURES}, v AS (SELECT 1e0 / sum(1e0 / v) v FROM m GROUP BY r, c) SELECT round(avg(v), 9) AS mean_variance FROM v")
def mean_variance(spark, d):
    return fusion.mean_variance(fusion.fused(measures(spark, d))).select(_round("mean_variance", 9))


_REACH = "sqrt(((c + 5e-1) * 1e-1 - 5) ** 2 + ((r + 5e-1) * 1e-1 - 5) ** 2)"


@query(
    f"""WITH {_LOCAL}, fi AS (SELECT r, c, min(s) s0 FROM lo GROUP BY r, c), ch AS (SELECT s, count(*) FILTER (WHERE s = s0 OR {_REACH} <= 15e-1) n FROM lo JOIN fi USING (r, c) GROUP BY s)
SELECT s AS seq, n AS changed, CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER (ORDER BY s) AS BIGINT) AS revision FROM ch"""
)
def map_changes(spark, d):
    c = cloud(spark, d).groupBy(F.col("scan_id").alias("seq"), F.floor(F.col("y_mm") / 100).cast("int").alias("row"), F.floor(F.col("x_mm") / 100).cast("int").alias("col"))
    local = c.agg((F.sum("z_mm") / F.count(F.lit(1)) * 1e-3).alias("elevation"), F.lit(0).alias("class"), F.count(F.lit(1)).alias("n"))
    at = lambda c: F.pow((F.col(c) + 0.5) * 0.1 - 5, F.lit(2))
    return fusion.changes(local.withColumns({"ix": F.col("col"), "iy": F.col("row"), "distance": F.sqrt(at("col") + at("row"))}), refresh_radius=1.5)


@query(
    f"""WITH {_CLOUD} SELECT CAST(x_mm // 100 AS INT) AS col, round(-5e0 + (x_mm // 100 + 5e-1) * 1e-1, 6) AS centre, CAST(floor((-5e0 + (x_mm // 100 + 5e-1) * 1e-1) / 1e-1) AS INT) AS ix, x_mm // 100 BETWEEN 10 AND 59 AS inside, count(*) AS n FROM cloud GROUP BY ALL"""
)
def world_index(spark, d):
    c = cloud(spark, d).select(F.expr("CAST(x_mm DIV 100 AS INT)").alias("col"))
    c = c.select("col", _rounded(geo.cell_centre("col", -5.0, 0.1)).alias("centre"), geo.world_index("col", -5.0, 0.1).alias("ix"), geo.in_grid(F.lit(0), F.col("col") - 10, F.lit(1), F.lit(50)).alias("inside"))
    return c.groupBy("col", "centre", "ix", "inside").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_CLOUD}, r AS (SELECT min(z_mm / 1e3) lo, max(z_mm / 1e3) hi FROM cloud), h AS (SELECT coalesce(CAST(least(floor((z_mm / 1e3 - lo) * 50 / (hi - lo)), 49) AS INT), 0) bin, lo, hi, count(*) n FROM cloud, r GROUP BY ALL), fl AS (SELECT first(lo + (bin + 5e-1) * ((hi - lo) / 50) ORDER BY n DESC, bin) AS floor, any_value(lo) lo, any_value(hi) hi FROM h)
SELECT scan_id, l_orderkey, round(x_mm / 1e3, 6) AS x, round(y_mm / 1e3, 6) AS y, round(CASE WHEN hi - floor >= floor - lo THEN 1e0 ELSE -1e0 END * (z_mm / 1e3 - floor), 6) AS z FROM cloud, fl"""
)
def reorient(spark, d):
    return orient.reoriented(metres(spark, d)).select("scan_id", "l_orderkey", _round("x"), _round("y"), _round("z"))


def path_cells(spark, d) -> tuple[DataFrame, DataFrame]:
    """Free cells, and the cells of all found paths: query_id, grid_id, seq, row, col."""
    f, p = planned(spark, d)
    return f, p.select("query_id", (1 + F.col("query_id") % 7).alias("grid_id"), F.posexplode("path").alias("seq", "p")).select("query_id", "grid_id", "seq", "p.row", "p.col")


@query(
    f"""WITH RECURSIVE {_ROUTES}, {_search("route")}, {_BACK}, low AS (SELECT g, min(e) lo FROM cells WHERE NOT lethal GROUP BY g)
SELECT q AS query_id, CAST(seq AS INT) AS seq, round((pc.c + 5e-1) * 1e-1, 6) AS x, round((pc.r % 1000 + 5e-1) * 1e-1, 6) AS y, round(coalesce(e, lo) + 5e-2, 6) AS z FROM pc LEFT JOIN cells ON cells.r = pc.r AND cells.c = pc.c JOIN low ON low.g = pc.g WHERE seq < 40"""
)
def draped_paths(spark, d):
    f, p = path_cells(spark, d)
    return navigate.draped(p, f, 0.1, 0.05, 40).select("query_id", "seq", _round("x"), _round("y"), _round("z"))


@query(
    f"""WITH RECURSIVE {_ROUTES}, {_search("route")}
SELECT route.q AS query_id, round(t, 6) AS cost FROM route JOIN sp ON sp.q = route.q AND sp.r % 1000 = r1 AND sp.c = c1 WHERE t < 'Infinity'::DOUBLE"""
)
def path_cost(spark, d):
    f, p = path_cells(spark, d)
    return motion.path_costs(p, f).select("query_id", _round("cost"))


@query()
def followed_paths(spark, d):
    f, p = planned(spark, d)
    points = F.transform("path", lambda c: F.struct(((c["col"] + 0.5) * 0.1).alias("x"), ((c["row"] + 0.5) * 0.1).alias("y")))
    t = motion.follow_paths(f, p.filter(F.size("path") > 1).select("query_id", (1 + F.col("query_id") % 7).alias("grid_id"), points.alias("points")), 0.1, spread=SPREAD).groupBy("query_id")
    last = lambda c: _rounded(F.max_by(c, "seq"), 4).alias(c)
    return t.agg(F.count(F.lit(1)).alias("steps"), last("x"), last("y"), _rounded(F.sum(F.col("x") + 2.0 * F.col("y")), 3).alias("trace"))


@query(f"WITH {_PATH}, o AS (SELECT query_id + 1 AS query_id, seq, y AS ox, x AS oy FROM p), j AS (SELECT query_id, seq, sqrt((x - ox) ** 2 + (y - oy) ** 2) d FROM p JOIN o USING (query_id, seq)) SELECT query_id AS agent_id, count(*) AS steps, round(avg(d), 6) AS mean_gap, round(arg_max(d, seq), 6) AS last_gap FROM j GROUP BY 1")
def gap_statistics(spark, d):
    p = polylines(spark, d).withColumnRenamed("query_id", "agent_id")
    other = p.select((F.col("agent_id") + 1).alias("agent_id"), "seq", F.col("y").alias("x"), F.col("x").alias("y"))
    return navigate.gaps(p, other).select("agent_id", "steps", _round("mean_gap"), _round("last_gap"))


_KINDS = "kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 kind FROM (SELECT DISTINCT event_type FROM events))"


def kinds(e: DataFrame) -> DataFrame:
    """Events with `kind`, the number of their type in the order of names; types are few."""
    from pyspark.sql import Window

    names = e.select("event_type").distinct().withColumn("kind", F.row_number().over(Window.orderBy("event_type")) - 1)
    return e.join(F.broadcast(names), "event_type")


@query(
    f"""WITH {_EV}, {_KINDS}, tk AS (SELECT user_id, event_id, t, kind = 0 reached FROM ev JOIN kinds USING (event_type) WHERE kind <= 1), sq AS (SELECT *, coalesce(sum(CASE WHEN reached THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) s FROM tk),
rt AS (SELECT user_id, t, event_id tie, value rx, -value ry FROM ev JOIN kinds USING (event_type) WHERE kind = 2 AND event_id % 5 = 0), j AS (SELECT sq.*, rt.rx, rt.ry, row_number() OVER (PARTITION BY sq.event_id ORDER BY rt.t DESC, rt.tie DESC) k FROM sq LEFT JOIN rt ON rt.user_id = sq.user_id AND rt.t <= sq.t)
SELECT event_id, round(CASE WHEN rx IS NOT NULL THEN rx WHEN s < 4 THEN user_id + s END, 6) AS goal_x, round(CASE WHEN rx IS NOT NULL THEN ry WHEN s < 4 THEN user_id - s END, 6) AS goal_y FROM j WHERE k = 1"""
)
def current_goal(spark, d):
    e = kinds(events(spark, d)).withColumnRenamed("user_id", "robot_id")
    ticks = e.filter("kind <= 1").select("robot_id", "t", "event_id", F.when(F.col("kind") == 0, "goal reached").otherwise("following path").alias("status"))
    robots = e.select("robot_id").distinct()
    flat = F.array(*(F.col("robot_id") + s * (1 - 2 * k) + 0.0 for s in range(4) for k in range(2)))
    runtime = e.filter("kind = 2 AND event_id % 5 = 0").select("robot_id", "t", F.col("event_id").alias("tie"), F.col("value").alias("x"), (-F.col("value")).alias("y"))
    return navigate.current_goals(ticks, navigate.waypoint_queue(robots.withColumn("waypoints", flat)), runtime).select("event_id", _round("goal_x"), _round("goal_y"))


@query(
    f"""WITH {_EV}, {_KINDS}, c AS (SELECT user_id, event_id, t, CASE WHEN kind <= 1 THEN 0e0 ELSE greatest(-6e-1, least(6e-1, value / 1e2)) END x, CASE WHEN kind = 0 THEN 0e0 ELSE greatest(-15e-1, least(15e-1, -value / 5e1)) END z FROM ev JOIN kinds USING (event_type)),
l AS (SELECT *, abs(x) < 1e-3 AND abs(z) < 1e-3 AS still FROM c), w AS (SELECT *, coalesce(lag(still) OVER (PARTITION BY user_id ORDER BY t, event_id), false) was FROM l)
SELECT user_id, round(t, 6) AS t, CASE WHEN still THEN 1003 ELSE 1008 END AS api, round(CASE WHEN NOT still THEN x END, 6) AS x, round(CASE WHEN NOT still THEN z END, 6) AS z FROM w WHERE NOT (still AND was)"""
)
def motor_requests(spark, d):
    e = kinds(events(spark, d))
    c = e.select("user_id", "t", F.col("event_id").alias("tie"), F.when(F.col("kind") <= 1, 0.0).otherwise(F.col("value") / 1e2).alias("vx"), F.lit(None).cast("double").alias("vy"), F.when(F.col("kind") == 0, 0.0).otherwise(-F.col("value") / 5e1).alias("wz"))
    m = export.motor_requests(c, "user_id").withColumn("p", F.from_json("parameter", "x double, y double, z double"))
    return m.select("user_id", _round("t"), "api", _rounded(F.col("p.x")).alias("x"), _rounded(F.col("p.z")).alias("z"))


@query(
    f"""WITH {_chain(True)}, {_ALL}, h AS (SELECT g, greatest(quantile_cont(cost, 0.99), 1000001e-6) hi FROM cells GROUP BY g), v AS (SELECT g, r, c, CAST(CASE WHEN n IS NULL THEN -1 WHEN lethal THEN 100 ELSE greatest(1e0, least(99e0, round_even((cost - 1e0) / (hi - 1e0) * 98e0, 0) + 1e0)) END AS INT) v FROM allc LEFT JOIN cells USING (g, r, c) LEFT JOIN h USING (g))
SELECT g AS grid_id, 100 AS width, 100 AS height, md5(string_agg(CAST(v AS VARCHAR), ',' ORDER BY r, c)) AS data FROM v GROUP BY g"""
)
def occupancy_message(spark, d):
    g = _grids(spark, d).withColumns({"origin_x": F.lit(0.0), "origin_y": F.lit(0.0)})
    m = export.occupancy_messages(grid.occupancy(terrain(spark, d, True), g), g, 0.1)
    return m.select("grid_id", "width", "height", F.md5(F.array_join("data", ",").cast("binary")).alias("data"))


@query(f"WITH {_PATH} SELECT query_id, count(*) AS points, round(first(x ORDER BY seq), 6) AS x0, round(first(y ORDER BY seq DESC), 6) AS y1 FROM p GROUP BY 1")
def path_message(spark, d):
    m = export.path_messages(polylines(spark, d))
    return m.select("query_id", F.size("poses").cast("long").alias("points"), _rounded(F.col("poses")[0]["x"]).alias("x0"), _rounded(F.element_at("poses", -1)["y"]).alias("y1"))


@query(
    f"""WITH {_chain(True)}, {_ALL}, v AS (SELECT g, r, c, CASE WHEN e IS NULL THEN -32768 ELSE CAST(greatest(least(round_even((e + {NUDGE!r}) * 100, 0), 32000), -32000) AS INT) END & 65535 h, CASE WHEN n IS NULL THEN 2 WHEN lethal THEN 1 ELSE 0 END k FROM allc LEFT JOIN cells USING (g, r, c))
SELECT g AS grid_id, 100 AS h, 100 AS w, to_base64(unhex(string_agg(printf('%02X%02X', h & 255, h >> 8), '' ORDER BY r, c))) AS elev, to_base64(unhex(string_agg(printf('%02X', k), '' ORDER BY r, c))) AS cls FROM v GROUP BY g"""
)
def grid_frame(spark, d):
    g = _grids(spark, d).withColumns({"origin_x": F.lit(0.0), "origin_y": F.lit(0.0), "seq": F.lit(1)})
    all_ = navigate.with_unknown(terrain(spark, d, True).select(*grid.KEY, (F.col("elevation") + NUDGE).alias("elevation"), "class", "cost"), g, lethal=True)
    f = export.grid_frames(all_, g, 0.1).withColumn("f", F.from_json("frame", "h int, w int, elev string, cls string"))
    return f.select("grid_id", "f.*")


@query(
    f"""WITH {_EV}, sp AS (SELECT user_id, min(t) a, max(t) b FROM ev GROUP BY 1), tk AS (SELECT user_id, CAST(unnest(range(0, CAST(floor((b - a) / 864e2) AS BIGINT) + 1)) AS INT) tick, a FROM sp), t2 AS (SELECT user_id, tick, a + tick * 864e2 t FROM tk),
j AS (SELECT t2.user_id, tick, ev.value, row_number() OVER (PARTITION BY t2.user_id, tick ORDER BY ev.t DESC, ev.event_id DESC) k FROM t2 LEFT JOIN ev ON ev.user_id = t2.user_id AND ev.t <= t2.t)
SELECT user_id, tick, round(value, 6) AS value FROM j WHERE k = 1"""
)
def tick_values(spark, d):
    e = events(spark, d)
    spans = e.groupBy("user_id").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    t = timed.ticks(spans, "user_id", 86400.0)
    return timed.latest_before(t, e, "user_id", "t", "tick", ["value"], tie_right="event_id").select("user_id", "tick", _round("value"))


@query("SELECT event_id, user_id FROM events WHERE event_id > 100 ORDER BY event_id DESC LIMIT 1")
def newest_frame(spark, d):
    return timed.newer_than(events(spark, d).select("event_id", "user_id"), 100, "event_id")


_MOUNT = (0.1, -0.2, 0.3)
_RPY = geo.rpy_rows(*_MOUNT)
_TURN = lambda a: " + ".join(f"{v!r}::DOUBLE * {c}" for v, c in zip(a, ("x", "y", "z")))


@query(
    f"""WITH {_CLOUD}, {_EV}, ps AS (SELECT 1 + user_id % 7 rob, event_id % 50000 t, event_id tie, value px, -value py FROM ev), pt AS (SELECT scan_id rob, l_orderkey t, x_mm / 1e3 - 5 x, y_mm / 1e3 - 5 y, z_mm / 1e3 z FROM cloud),
sc AS (SELECT DISTINCT rob, t FROM pt), ka AS (SELECT sc.rob, sc.t, px, py, row_number() OVER (PARTITION BY sc.rob, sc.t ORDER BY ps.t DESC, tie DESC) k FROM sc JOIN ps ON ps.rob = sc.rob AND ps.t <= sc.t),
mo AS (SELECT pt.rob, pt.t, px, py, {_TURN(_RPY[0])} AS mx, {_TURN(_RPY[1])} AS my, {_TURN(_RPY[2])} AS mz FROM pt JOIN ka USING (rob, t) WHERE k = 1),
wo AS (SELECT rob, px, py, {_R[0][0]!r} * mx + {_R[0][1]!r} * my + {_R[0][2]!r} * mz + px wx, {_R[1][0]!r} * mx + {_R[1][1]!r} * my + {_R[1][2]!r} * mz + py wy, {_R[2][0]!r} * mx + {_R[2][1]!r} * my + {_R[2][2]!r} * mz + 5e-1 wz FROM mo)
SELECT rob AS robot_id, count(*) AS n, round(sum(wx), 3) AS x, round(sum(wy), 3) AS y, round(sum(wz), 3) AS z FROM wo WHERE (wx - px) ** 2 + (wy - py) ** 2 > 45e-2 ** 2 GROUP BY 1"""
)
def scans_in_world(spark, d):
    e = events(spark, d)
    poses = e.select((1 + F.col("user_id") % 7).alias("robot_id"), (F.col("event_id") % 50000).cast("double").alias("t"), F.col("event_id").alias("tie"), F.col("value").alias("px"), (-F.col("value")).alias("py"), F.lit(0.5).alias("pz"), *(F.lit(v).alias(n) for v, n in zip(_Q, ("qx", "qy", "qz", "qw"))))
    p = cloud(spark, d).select(F.col("scan_id").alias("robot_id"), F.col("l_orderkey").cast("double").alias("t"), F.col("l_orderkey").alias("scan_id"), (F.col("x_mm") / 1e3 - 5).alias("x"), (F.col("y_mm") / 1e3 - 5).alias("y"), (F.col("z_mm") / 1e3).alias("z"))
    w = navigate.in_world(p, poses, mount=_MOUNT, min_range=0.45).groupBy("robot_id")
    return w.agg(F.count(F.lit(1)).alias("n"), *(_rounded(F.sum(c), 3).alias(c) for c in "xyz"))
