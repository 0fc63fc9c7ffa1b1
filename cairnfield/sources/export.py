"""What the engine hands out, as relations: occupancy and path messages, motor commands, frames for viewers, point files.

A message is one row; who sends it on is no matter of the engine.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import to_cm

#: Numbers of the motor interface's calls, and its limit for sideways speed (fixed values of the interface).
MOVE, STOP, MOST_VY = 1008, 1003, 0.4
#: A speed below this is none, and the value that stands for no height.
STILL, NO_HEIGHT = 1e-3, -32768


def _in_order(*columns: Column, by=("row", "col")) -> Column:
    """The values of a grid's cells in row-major order, as an array of structs; a grid's cells are a window's."""
    return F.array_sort(F.collect_list(F.struct(*by, *columns)))


def occupancy_messages(values: DataFrame, grids: DataFrame, resolution: float) -> DataFrame:
    """(grid_id, resolution, width, height, origin_x, origin_y, data) of values by cell (as in `grid.occupancy`) and grids (grid_id, rows, cols, origin_x, origin_y)."""
    data = values.groupBy("grid_id").agg(F.transform(_in_order("value"), lambda x: x["value"]).alias("data"))
    return grids.join(data, "grid_id").select("grid_id", F.lit(float(resolution)).alias("resolution"), F.col("cols").alias("width"), F.col("rows").alias("height"), "origin_x", "origin_y", "data")


def path_messages(points: DataFrame) -> DataFrame:
    """(query_id, poses) of path points (query_id, seq, x, y): an array of x, y in order."""
    poses = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return points.groupBy("query_id").agg(poses.alias("poses"))


def motor_requests(commands: DataFrame, by: str = "robot_id", max_vx: float = 0.6, max_wz: float = 1.5) -> DataFrame:
    """(by, t, api, parameter) of commands (by, t, tie, vx, vy, wz): a move for each within the limits, and one stop when they come to rest."""
    within = lambda c, m: F.greatest(F.lit(-m), F.least(F.lit(m), F.coalesce(F.col(c), F.lit(0.0))))
    d = commands.select(by, "t", "tie", within("vx", max_vx).alias("x"), within("vy", MOST_VY).alias("y"), within("wz", max_wz).alias("z"))
    d = d.withColumn("still", (F.abs("x") < STILL) & (F.abs("y") < STILL) & (F.abs("z") < STILL))
    w = Window.partitionBy(by).orderBy("t", "tie")
    d = d.withColumn("was", F.coalesce(F.lag("still").over(w), F.lit(False))).filter("NOT (still AND was)")
    return d.select(by, "t", F.when(F.col("still"), STOP).otherwise(MOVE).alias("api"), F.when(F.col("still"), F.lit("{}")).otherwise(F.to_json(F.struct("x", "y", "z"))).alias("parameter"))


def _base64(values: Column, size: int) -> Column:
    """Integers as little-endian bytes of `size`, in base64."""
    one = lambda v: F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(v, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(size)))
    return F.regexp_replace(F.base64(F.unhex(F.array_join(F.transform(values, lambda v: one(v.cast("int"))), ""))), "\\s", "")


def grid_frames(cells: DataFrame, grids: DataFrame, resolution: float) -> DataFrame:
    """(grid_id, frame): a JSON frame for viewers of all cells (elevation, class, cost; null where unknown) of grids (grid_id, rows, cols, seq,
    origin_x, origin_y). Heights are hundredths in 16 bits, classes bytes, both in base64 and row-major; costs have three places, -1 where nothing passes."""
    height = F.when(F.col("elevation").isNotNull(), to_cm("elevation").cast("int")).otherwise(NO_HEIGHT)
    cost = F.coalesce(F.round("cost", 3), F.lit(-1.0))
    all_ = cells.groupBy("grid_id").agg(_in_order(height.alias("e"), F.col("class").cast("int").alias("k"), cost.alias("c")).alias("a"))
    pick = lambda c: F.transform("a", lambda x: x[c])
    frame = F.struct(
        "seq", F.array(F.round("origin_x", 3), F.round("origin_y", 3)).alias("origin"), F.lit(float(resolution)).alias("res"), F.col("rows").alias("h"), F.col("cols").alias("w"),
        _base64(pick("e"), 2).alias("elev"), _base64(pick("k"), 1).alias("cls"), pick("c").alias("cost"),
    )
    return grids.join(all_, "grid_id").select("grid_id", "seq", F.to_json(frame).alias("frame"))


def point_file(points: DataFrame, order: str = "pid", most: int = 20_000_000) -> bytes:
    """At most `most` points as an array file of 32-bit x, y, z in order; more are a table's matter."""
    rows = points.select(order, "x", "y", "z").orderBy(order).limit(most + 1).drop(order).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"more than {most} points: write a table")
    out = io.BytesIO()
    np.save(out, np.stack([rows[c].to_numpy().astype("float32") for c in "xyz"], 1) if rows.num_rows else np.zeros((0, 3), "float32"))
    return out.getvalue()
