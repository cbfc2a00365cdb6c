"""Post-processing of predicted boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skysweep.functions.columns import pick_by_class
from skysweep.functions.iou import iou_aabb
from skysweep.functions.ranks import wide_percentiles
from skysweep.operators.graph import greedy_suppression
from skysweep.operators.near import Space, near_components
from skysweep.schema import CLASS_NAMES, DIM_LIMITS, FRAME, MERGE_DISTANCE_OTHER, MERGE_DISTANCES, POST_LIMITS

GROUP = [*FRAME, "class_label"]


def conf_filter(boxes: DataFrame, limits: dict = POST_LIMITS) -> DataFrame:
    """Known classes with at least the smallest confidence of their class."""
    smallest = pick_by_class({k: v["min_confidence"] for k, v in limits.items()})
    return boxes.filter(F.col("confidence") >= smallest)


def dim_filter(boxes: DataFrame, limits: dict = DIM_LIMITS) -> DataFrame:
    """Boxes whose sides lie in the closed ranges of their class; other classes pass."""
    inside: Column | None = None
    for label, sides in limits.items():
        ok = F.lit(True)
        for side, (low, high) in sides.items():
            ok = ok & F.col(f"bbox_{side}").between(F.lit(low), F.lit(high))
        is_class = F.col("class_label") == label
        inside = F.when(is_class, ok) if inside is None else inside.when(is_class, ok)
    return boxes.filter(inside.otherwise(True))


def nms_3d(boxes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Greedy suppression per frame and class; equal confidence is ordered by box_id."""
    return greedy_suppression(boxes, GROUP, iou_aabb(), threshold, [("confidence", True), ("box_id", False)])


def frame_topk(boxes: DataFrame, limits: dict = POST_LIMITS) -> DataFrame:
    """The most confident boxes per frame and class, up to the limit of the class; other classes are dropped."""
    most = max(v["max_per_frame"] for v in limits.values())
    order = W.partitionBy(*GROUP).orderBy(F.desc("confidence"), "box_id")
    ranked = boxes.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= most)
    return ranked.filter(F.col("__rank") <= pick_by_class({k: v["max_per_frame"] for k, v in limits.items()})).drop("__rank")


def postprocess(boxes: DataFrame, threshold: float = 0.3) -> DataFrame:
    return frame_topk(nms_3d(dim_filter(conf_filter(boxes)), threshold))


def class_confidence(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("class_label").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"))


def merge_boxes(boxes: DataFrame, distances: dict[str, float] = MERGE_DISTANCES, other: float = MERGE_DISTANCE_OTHER) -> DataFrame:
    """Merge boxes of a frame and class that are linked by centre distance, directly or through others.

    Centre = mean, sides = largest, yaw of the most confident member, confidence = largest, other columns of the first
    member by box_id. Without confidences the yaw is that of the first member. Labels without a distance use ``other``.
    """
    radius = pick_by_class(distances, other) if distances else F.lit(other)
    centre = ("bbox_center_x", "bbox_center_y", "bbox_center_z")
    labelled = near_components(boxes, GROUP, "box_id", [Space(centre, radius, strict=True)], "merged_id")
    aggregates = [F.avg(c).alias(c) for c in centre]
    aggregates += [F.max(c).alias(c) for c in ("bbox_width", "bbox_length", "bbox_height")]
    if "confidence" in boxes.columns:
        lead = F.struct(F.col("confidence"), (-F.col("box_id")).alias("first"))
        aggregates += [F.max_by("bbox_yaw", lead).alias("bbox_yaw"), F.max("confidence").alias("confidence")]
    else:
        aggregates.append(F.min_by("bbox_yaw", "box_id").alias("bbox_yaw"))
    done = {*GROUP, *centre, "bbox_width", "bbox_length", "bbox_height", "bbox_yaw", "confidence", "box_id"}
    first = [F.min_by(c, "box_id").alias(c) for c in boxes.columns if c not in done]
    merged = labelled.groupBy(*GROUP, "merged_id").agg(*aggregates, *first, F.count(F.lit(1)).alias("n_merged"))
    return merged.withColumnRenamed("merged_id", "box_id").select(*boxes.columns, "n_merged")


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Boxes per class before and after a step and the reduction in percent."""
    count = lambda df, name: df.groupBy("class_label").agg(F.count(F.lit(1)).alias(name))
    both = count(before, "n_before").join(count(after, "n_after"), "class_label", "left").fillna(0, ["n_after"])
    return both.withColumn("reduction_pct", 100.0 * (1 - F.col("n_after") / F.col("n_before")))


def detection_summary(boxes: DataFrame) -> DataFrame:
    """Totals, boxes per class, confidence range and boxes per frame, in one row."""
    per_frame = boxes.groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("confidence").alias("sum"),
        F.min("confidence").alias("min"),
        F.max("confidence").alias("max"),
        *[F.count_if(F.col("class_label") == c).alias(c) for c in CLASS_NAMES],
    )
    return per_frame.agg(
        F.sum("n").alias("total"),
        *[F.sum(F.col(f"`{c}`")).alias(f"n_{c.lower().replace(' ', '_')}") for c in CLASS_NAMES],
        (F.sum("sum") / F.sum("n")).alias("confidence_mean"),
        F.min("min").alias("confidence_min"),
        F.max("max").alias("confidence_max"),
        F.avg("n").alias("per_frame_mean"),
        F.max("n").alias("per_frame_max"),
    )


def confidence_describe(boxes: DataFrame) -> DataFrame:
    """Count, mean, deviation and quartiles of the confidence per class."""
    base = boxes.groupBy("class_label").agg(
        F.count("confidence").alias("count"),
        F.avg("confidence").alias("mean"),
        F.stddev_samp("confidence").alias("std"),
        F.min("confidence").alias("min"),
        F.max("confidence").alias("max"),
    )
    marks = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    stats = wide_percentiles(boxes, ["class_label"], ["confidence"], list(marks))
    picked = [F.max(F.when(F.col("p") == F.lit(p), F.col("value"))).alias(name) for p, name in marks.items()]
    return base.join(stats.groupBy("class_label").agg(*picked), "class_label")
