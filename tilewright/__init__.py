"""Geospatial dataset operators on Spark: point clouds, rasters, chips, labels, splits, scoring."""

__version__ = "0.1.0"
