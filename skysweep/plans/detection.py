"""Class-free detection of objects in every frame of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysweep.operators import boxfit, cluster
from skysweep.schema import FRAME
from skysweep.session import cut_lineage

# Default settings of the detector.
SETTINGS = {
    "min_cluster_size": 30,
    "min_samples": 5,
    "epsilon": 0.5,
    "min_height": 0.5,
    "min_elongation": 8.0,
    "merge_distance": 10.0,
}


def detect(points: DataFrame, reach: float | None = None, **settings) -> DataFrame:
    """Points to detections: height filter, clustering, box, features, rules, merged cables; all frames at once.

    With ``reach`` clusters are those of the density hierarchy up to that distance, else of one cut at ``epsilon``.
    """
    s = SETTINGS | settings
    high = cluster.height_prefilter(points, s["min_height"], s["min_cluster_size"])
    size = (s["epsilon"], s["min_samples"], s["min_cluster_size"])
    found = cluster.density_cut(high, *size) if reach is None else cluster.hierarchy_cut(cut_lineage(high), reach, *size)
    clustered = cut_lineage(found)
    return boxfit.detect_objects(clustered, FRAME, s["min_elongation"], s["merge_distance"])


def detection_report(detections: DataFrame, frames: DataFrame) -> DataFrame:
    """Detections per frame and predicted class, including frames without any."""
    counts = detections.groupBy(*FRAME, "predicted_class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_points").alias("points")
    )
    joined = frames.select(*FRAME).join(counts, FRAME, "left")
    return joined.select(
        *FRAME,
        F.coalesce("predicted_class", F.lit("none")).alias("predicted_class"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("points", F.lit(0)).alias("points"),
    )
