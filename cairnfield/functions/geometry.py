"""Scalar functions on points, cells and poses, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_index(x, origin, resolution: float) -> Column:
    """The cell of a coordinate: floor."""
    return F.floor((_c(x) - _c(origin)) / F.lit(resolution)).cast("int")


def world_to_cell(x, origin, resolution: float) -> Column:
    """The cell of a lookup: truncation toward zero, so just below the origin is cell 0."""
    return ((_c(x) - _c(origin)) / F.lit(resolution)).cast("int")


def cell_centre(i, origin, resolution: float) -> Column:
    return _c(origin) + (_c(i) + 0.5) * F.lit(resolution)


def world_index(i, origin, resolution: float) -> Column:
    """The index of a cell's centre in a map that begins at 0."""
    return F.floor(cell_centre(i, origin, resolution) / F.lit(resolution)).cast("int")


def in_grid(row, col, rows, cols) -> Column:
    return (_c(row) >= 0) & (_c(row) < _c(rows)) & (_c(col) >= 0) & (_c(col) < _c(cols))


def finite(*xs) -> Column:
    out = F.lit(True)
    for x in xs:
        out = out & _c(x).isNotNull() & ~F.isnan(_c(x).cast("double")) & (F.abs(_c(x)) < float("inf"))
    return out


def within_range(x, y, z, least: float = 0.5, most: float = 12.0) -> Column:
    """Strictly between two distances from the sensor."""
    d = F.sqrt(_c(x) * _c(x) + _c(y) * _c(y) + _c(z) * _c(z))
    return (d > least) & (d < most)


def away_from_body(x, y, px, py, least: float) -> Column:
    """Keeps points beyond `least` of the robot; 0 or less keeps all."""
    if least <= 0:
        return F.lit(True)
    dx, dy = _c(x) - _c(px), _c(y) - _c(py)
    return dx * dx + dy * dy > least * least


def rpy_rows(roll: float, pitch: float, yaw: float) -> list[list[float]]:
    """Rotation about x, then y, then z."""
    from math import cos, sin

    cr, sr, cp, sp, cy, sy = cos(roll), sin(roll), cos(pitch), sin(pitch), cos(yaw), sin(yaw)
    return [[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]]


def rotated(rows, x, y, z) -> list[Column]:
    return [F.lit(r[0]) * _c(x) + F.lit(r[1]) * _c(y) + F.lit(r[2]) * _c(z) for r in rows]


def quaternion_rotated(qx, qy, qz, qw, x, y, z) -> list[Column]:
    """p + 2 w (v x p) + 2 v x (v x p) for the unit quaternion (v, w)."""
    qx, qy, qz, qw, x, y, z = map(_c, (qx, qy, qz, qw, x, y, z))
    tx, ty, tz = 2 * (qy * z - qz * y), 2 * (qz * x - qx * z), 2 * (qx * y - qy * x)
    return [x + qw * tx + qy * tz - qz * ty, y + qw * ty + qz * tx - qx * tz, z + qw * tz + qx * ty - qy * tx]


def yaw_of(qx, qy, qz, qw) -> Column:
    qx, qy, qz, qw = map(_c, (qx, qy, qz, qw))
    return F.atan2(2 * (qw * qz + qx * qy), 1 - 2 * (qy * qy + qz * qz))


def wrapped(angle) -> Column:
    return F.atan2(F.sin(_c(angle)), F.cos(_c(angle)))


def clamped(x, least, most) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), _c(x)))


def to_cm(v) -> Column:
    """Hundredths as 16-bit integers, half to even, within 32000."""
    return F.greatest(F.least(F.rint(_c(v) * 100), F.lit(32000.0)), F.lit(-32000.0)).cast("smallint")


def projected_goal(gx, gy, px, py, map_size: float, resolution: float) -> list[Column]:
    """A goal beyond the window is pulled to its edge, in the same direction."""
    half = map_size / 2 - 3 * resolution
    dx, dy = _c(gx) - _c(px), _c(gy) - _c(py)
    scale = F.greatest(F.greatest(F.abs(dx), F.abs(dy)) / half, F.lit(1.0))
    return [_c(px) + dx / scale, _c(py) + dy / scale]


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)
