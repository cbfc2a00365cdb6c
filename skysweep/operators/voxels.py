"""World-frame voxels gathered over many frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysweep.functions.columns import draw, label_of
from skysweep.operators.frames import elevation_angle, local_to_world
from skysweep.schema import CLASS_NAMES

VOXEL = ["scene", "vx", "vy", "vz"]


def voxel_cells(points: DataFrame, size: float = 0.5) -> DataFrame:
    """World position, voxel index and elevation angle of every point."""
    world = local_to_world(points)
    cells = {f"v{a}": F.floor(F.col(f"{a}_world") / F.lit(float(size))).cast("int") for a in "xyz"}
    return world.withColumns(cells).withColumn("elevation", elevation_angle())


def running_sums() -> list[Column]:
    """Mergeable statistics of a voxel, without the frame count."""
    z, ref = F.col("z_world"), F.col("reflectivity").cast("double")
    votes = [F.count_if(F.col("class_id") == i).alias(f"votes_{i}") for i in range(len(CLASS_NAMES))]
    return [
        F.count(F.lit(1)).alias("hit_count"),
        F.sum(ref).alias("ref_sum"),
        F.sum(ref * ref).alias("ref_sumsq"),
        F.sum(z).alias("z_sum"),
        F.sum(z * z).alias("z_sumsq"),
        F.min(z).alias("z_min"),
        F.max(z).alias("z_max"),
        F.sum("elevation").alias("elev_sum"),
        *votes,
        F.count_if(F.col("class_id") < 0).alias("votes_bg"),
    ]


def merged_sums() -> list[Column]:
    """The same statistics merged from partial ones."""
    added = ["hit_count", "ref_sum", "ref_sumsq", "z_sum", "z_sumsq", "elev_sum", *[f"votes_{i}" for i in range(len(CLASS_NAMES))], "votes_bg"]
    return [F.sum(c).alias(c) for c in added] + [F.min("z_min").alias("z_min"), F.max("z_max").alias("z_max")]


def voxel_accumulate(points: DataFrame, size: float = 0.5) -> DataFrame:
    """Hits, distinct frames, sums and class votes per voxel.

    Two steps, first per (voxel, frame) and then per voxel, so that the frames of a voxel are counted and not kept.
    """
    per_frame = voxel_cells(points, size).groupBy(*VOXEL, "pose_index").agg(*running_sums())
    return per_frame.groupBy(*VOXEL).agg(F.count(F.lit(1)).alias("frame_count"), *merged_sums())


def voxel_table(sums: DataFrame, size: float = 0.5, expected_frames: int = 100) -> DataFrame:
    """Centres, ratios, means and deviations from the running sums."""
    n = F.col("hit_count")

    def spread(name: str) -> Column:
        mean = F.col(f"{name}_sum") / n
        return F.sqrt(F.greatest(F.col(f"{name}_sumsq") / n - mean * mean, F.lit(0.0)))

    return sums.select(
        *VOXEL,
        *[((F.col(f"v{a}") + 0.5) * F.lit(float(size))).alias(f"world_{a}") for a in "xyz"],
        "hit_count",
        "frame_count",
        (F.col("frame_count") / F.lit(float(expected_frames))).alias("observation_ratio"),
        (F.col("ref_sum") / n).alias("ref_mean"),
        spread("ref").alias("ref_std"),
        "z_min",
        "z_max",
        (F.col("z_max") - F.col("z_min")).alias("z_range"),
        (F.col("z_sum") / n).alias("z_mean"),
        spread("z").alias("z_std"),
        (F.col("elev_sum") / n).alias("elev_mean"),
    )


def voxel_labels(sums: DataFrame) -> DataFrame:
    """Majority class among the obstacle votes; ties go to the lowest id, no vote means background."""
    names = [f"votes_{i}" for i in range(len(CLASS_NAMES))]
    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    best = F.greatest(*names)
    class_id = F.lit(len(names) - 1)
    for i in reversed(range(len(names) - 1)):
        class_id = F.when(F.col(names[i]) == best, i).otherwise(class_id)
    seen = total > 0
    return sums.select(
        *VOXEL,
        F.when(seen, class_id).otherwise(-1).alias("class_id"),
        F.when(seen, best / F.greatest(total, F.lit(1))).otherwise(1.0).alias("class_confidence"),
        seen.alias("is_obstacle"),
        *[(F.col(c) / F.col("hit_count")).alias(f"vote_frac_{i}") for i, c in enumerate(names)],
        (F.col("votes_bg") / F.col("hit_count")).alias("bg_frac"),
    )


def scene_export_points(voxels: DataFrame, obstacles_only: bool = False, max_points: int | None = None) -> DataFrame:
    """Voxel centres with a class name, at most ``max_points`` of them by a repeatable draw.

    Obstacles are told by ``is_obstacle`` or, without that column, by the class.
    """
    names = [F.col(c) for c in ("label", "class_label") if c in voxels.columns]
    label = F.coalesce(*names, *([label_of()] if "class_id" in voxels.columns else []))
    chosen = "is_obstacle" if "is_obstacle" in voxels.columns else "class_id >= 0"
    rows = voxels.filter(chosen) if obstacles_only else voxels
    rows = rows.select(*VOXEL, F.col("world_x").alias("x"), F.col("world_y").alias("y"), F.col("world_z").alias("z"), label.alias("label"))
    if max_points is None:
        return rows
    return rows.orderBy(draw("export", *VOXEL), *VOXEL).limit(max_points)
