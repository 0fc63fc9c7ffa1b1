"""Part of the terrain-grid engine."""
