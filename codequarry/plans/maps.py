"""Points on a map: coordinates, clusters, names and the box they fill."""

from __future__ import annotations

from pyspark.sql import DataFrame

from codequarry.operators.aggregates import extents, raster_counts
from codequarry.operators.joins import hydrate, join_coords


def map_points(coords: DataFrame, clusters: DataFrame, functions: DataFrame) -> DataFrame:
    """Coordinates with cluster, name and body; what is missing is NULL."""
    return hydrate(join_coords(coords, clusters), functions.select("id", "name", "body"))


def map_box(points: DataFrame) -> DataFrame:
    """Smallest and largest value of each coordinate."""
    return extents(points, [axis for axis in ("x", "y", "z") if axis in points.columns])


def map_raster(points: DataFrame, width: int = 800, height: int = 600) -> DataFrame:
    """Points per pixel and cluster."""
    return raster_counts(points, "x", "y", "cluster", width, height)
