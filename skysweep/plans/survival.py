"""Share of every obstacle class that survives ground removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from skysweep.operators import frames, ground
from skysweep.schema import FRAME
from skysweep.session import cut_lineage


def survival_report(
    returns: DataFrame, thresholds: Sequence[float] = (2, 5), tile_size: float = 5.0, percentile: float = 5.0
) -> DataFrame:
    """Raw returns to the wide survival table, one row per (scene, threshold)."""
    # Stored once: extents, tiles and heights each read the points.
    points = cut_lineage(frames.points_of(returns).select(*FRAME, "class_id", "class_label", "x", "y", "z"))
    heights = ground.hag(points, tile_size, percentile)
    return ground.survival_metrics(ground.survival_counts(heights, thresholds))
