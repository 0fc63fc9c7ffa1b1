"""Terrain-grid analytics on Spark."""

from .config import ApfConfig, GridConfig, KalmanConfig, NavConfig, RobotLimits
from .operators.fusion import fused, fused_grid, scan_measures
from .operators.graph import cost_field, plan_paths
from .operators.grid import discretize, occupancy
from .operators.motion import follow_paths, rollouts, smooth_paths
from .operators.navigate import replanned
from .sources.points import read_points

__all__ = [
    "ApfConfig", "GridConfig", "KalmanConfig", "NavConfig", "RobotLimits", "cost_field", "discretize", "follow_paths", "fused", "fused_grid", "occupancy", "plan_paths", "read_points", "replanned", "rollouts", "scan_measures", "smooth_paths",
]
