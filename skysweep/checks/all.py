"""Importing this module registers every query."""

from skysweep.checks import classify_queries, clean_queries, cluster_queries, eval_queries, frame_queries, grid_queries, ground_queries, post_queries  # noqa: F401
from skysweep.checks.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
