"""Settings of grids, robots, fusion, navigation and potential fields."""

from __future__ import annotations

import math
from dataclasses import dataclass

FREE, LETHAL, UNKNOWN = 0, 1, 2


@dataclass(frozen=True)
class RobotLimits:
    radius: float = 0.30
    max_step: float = 0.18
    max_slope_deg: float = 30.0
    max_roughness: float = 0.05

    @property
    def max_slope_tan(self) -> float:
        return math.tan(math.radians(self.max_slope_deg))


@dataclass(frozen=True)
class GridConfig:
    """`bounds` is (xmin, ymin, xmax, ymax); without it each grid gets those of its own points."""

    resolution: float = 0.10
    bounds: tuple[float, float, float, float] | None = None
    z_clip: tuple[float, float] | None = None
    unknown_cost: float = 50.0
    cost_unknown_as_free: bool = False
    min_obstacle_cells: int = 3
    inflate_obstacles: bool = True
    smooth_passes: int = 1


@dataclass(frozen=True)
class KalmanConfig:
    resolution: float = 0.10
    sensor_var: float = 9e-4
    range_coeff: float = 4e-4
    process_var: float = 1e-4
    max_variance: float = 0.05
    unknown_cost: float = 50.0
    min_obstacle_cells: int = 3
    smooth_passes: int = 1
    inflate_obstacles: bool = True


@dataclass(frozen=True)
class NavConfig:
    map_size: float = 8.0
    resolution: float = 0.10
    z_clip: tuple[float, float] = (-1.0, 1.5)
    goal_tol: float = 0.25
    lookahead: float = 0.6
    max_speed: float = 0.5
    max_yaw_rate: float = 1.2
    yaw_gain: float = 2.0
    turn_threshold: float = 1.0
    unknown_is_lethal: bool = True
    unknown_cost: float = 20.0
    scan_timeout: float = 1.0
    buffer_s: float = 2.0
    min_range: float = 0.45
    snap_radius: int = 25
    smooth_passes: int = 1


@dataclass(frozen=True)
class ApfConfig:
    k_att: float = 1.0
    k_rep: float = 0.6
    rho0: float = 0.8
    conic: float = 2.0
    cap: float = 50.0
    max_speed: float = 0.6
    dt: float = 0.1
    goal_tol: float = 0.15
    lookahead: float = 0.7
