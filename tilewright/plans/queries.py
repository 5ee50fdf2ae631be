"""All registered queries."""

from . import queries_labels, queries_points, queries_rasters, queries_workflows  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
