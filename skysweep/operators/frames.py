"""Frame identity, coordinate frames, manifests and box geometry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skysweep.functions.columns import class_id_of, label_of, rnd
from skysweep.schema import BEV, CLASS_NAMES, FRAME, POSE, VALIDATION_SCENES


def frame_index(returns: DataFrame) -> DataFrame:
    """Number the distinct poses of every scene from 0 in ascending pose order; invalid beams count."""
    poses = returns.dropna(subset=POSE).groupBy("scene", *POSE).agg(F.count(F.lit(1)).alias("num_points"))
    order = W.partitionBy("scene").orderBy(*POSE)
    return poses.select("scene", (F.row_number().over(order) - 1).alias("pose_index"), *POSE, "num_points")


def frame_points(returns: DataFrame, frames: DataFrame) -> DataFrame:
    """Attach the frame number to every return by equality of the pose; all frames in one join."""
    return returns.join(frames.select("scene", *POSE, "pose_index"), ["scene", *POSE])


def drop_invalid(returns: DataFrame) -> DataFrame:
    return returns.filter(F.col("distance_cm") > 0)


def to_cartesian(returns: DataFrame, digits: int | None = 4) -> DataFrame:
    """Spherical sensor readings to metres, left-handed, z up."""
    distance = F.col("distance_cm") / 100
    azimuth, elevation = F.radians(F.col("azimuth_raw") / 100), F.radians(F.col("elevation_raw") / 100)
    xyz = {
        "x": distance * F.cos(elevation) * F.cos(azimuth),
        "y": -(distance * F.cos(elevation) * F.sin(azimuth)),
        "z": distance * F.sin(elevation),
    }
    if digits is not None:
        xyz = {name: rnd(column, digits) for name, column in xyz.items()}
    return returns.withColumns(xyz).drop("distance_cm", "azimuth_raw", "elevation_raw")


def assign_class(points: DataFrame) -> DataFrame:
    """Exact colour to class id and label; any other colour is background."""
    return points.withColumn("class_id", class_id_of()).withColumn("class_label", label_of())


def points_of(returns: DataFrame) -> DataFrame:
    """Valid, classed, Cartesian points with their frame number."""
    return assign_class(to_cartesian(frame_points(drop_invalid(returns), frame_index(returns))))


def world_columns(x: str = "x", y: str = "y", z: str = "z") -> dict[str, Column]:
    yaw = F.radians("ego_yaw")
    return {
        "x_world": F.col(x) * F.cos(yaw) - F.col(y) * F.sin(yaw) + F.col("ego_x") / 100,
        "y_world": F.col(x) * F.sin(yaw) + F.col(y) * F.cos(yaw) + F.col("ego_y") / 100,
        "z_world": F.col(z) + F.col("ego_z") / 100,
    }


def local_to_world(points: DataFrame) -> DataFrame:
    """Turn by the sensor yaw (degrees) and move by the sensor position (centimetres)."""
    return points.withColumns(world_columns())


def world_to_local(points: DataFrame) -> DataFrame:
    """Inverse of ``local_to_world``; adds x_local, y_local, z_local."""
    yaw = F.radians("ego_yaw")
    dx, dy = F.col("x_world") - F.col("ego_x") / 100, F.col("y_world") - F.col("ego_y") / 100
    return points.withColumns(
        {
            "x_local": dx * F.cos(yaw) + dy * F.sin(yaw),
            "y_local": dy * F.cos(yaw) - dx * F.sin(yaw),
            "z_local": F.col("z_world") - F.col("ego_z") / 100,
        }
    )


def box_to_world(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns(world_columns("bbox_center_x", "bbox_center_y", "bbox_center_z")).withColumn(
        "yaw_world", F.radians("ego_yaw") + F.col("bbox_yaw")
    )


def elevation_angle() -> Column:
    return F.atan2(F.col("z"), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) + F.lit(1e-8))


def norm_reflectivity() -> Column:
    return F.col("reflectivity") / F.lit(255.0)


def frame_manifest(returns: DataFrame, folder: str = "processed") -> DataFrame:
    """One row per frame that keeps a valid beam: counts, share of valid beams and file name.

    Counted per pose in one aggregation; the frames are numbered on its result, those without a valid beam included.
    """
    counts = returns.dropna(subset=POSE).groupBy("scene", *POSE).agg(
        F.count(F.lit(1)).alias("num_points_raw"), F.count_if(F.col("distance_cm") > 0).alias("num_points_valid")
    )
    number = F.row_number().over(W.partitionBy("scene").orderBy(*POSE)) - 1
    return (
        counts.select("scene", number.alias("pose_index"), *POSE, "num_points_raw", "num_points_valid")
        .filter("num_points_valid > 0")
        .withColumn("num_invalid_dropped", F.col("num_points_raw") - F.col("num_points_valid"))
        .withColumn("valid_pct", 100.0 * F.col("num_points_valid") / F.col("num_points_raw"))
        .withColumn(
            "file", F.concat(F.lit(f"{folder}/"), "scene", F.format_string("/frame_%03d.parquet", F.col("pose_index")))
        )
    )


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """Frames and points per scene and over all (scene NULL); dropped share only over frames with a known raw count."""
    known = F.col("num_points_raw") > 0
    return manifest.rollup("scene").agg(
        F.count(F.lit(1)).alias("frames"),
        F.sum("num_points_valid").alias("total_points"),
        F.avg("num_points_valid").alias("mean_points"),
        F.try_divide(
            100.0 * F.sum(F.when(known, F.col("num_invalid_dropped"))),
            F.sum(F.when(known, F.col("num_points_raw"))),
        ).alias("invalid_pct"),
    )


def manifest_fixup(clean_manifest: DataFrame) -> DataFrame:
    """Bring the manifest of cleaned frames to the training layout; the raw count is an estimate."""
    raw = (F.col("num_points_original") * F.lit(1.2)).cast("long")
    return clean_manifest.select(
        *FRAME,
        *POSE,
        raw.alias("num_points_raw"),
        F.col("num_points_cleaned").alias("num_points_valid"),
        (raw - F.col("num_points_cleaned")).alias("num_invalid_dropped"),
        F.col("cleaned_path").alias("file"),
    )


def rewrite_paths(boxes: DataFrame, old: str = "processed/", new: str = "cleaned/") -> DataFrame:
    return boxes.withColumn("frame_file", F.replace("frame_file", F.lit(old), F.lit(new)))


def split_by_scene(df: DataFrame, split: str, held_out: Sequence[str] = VALIDATION_SCENES) -> DataFrame:
    if split == "all":
        return df
    held = F.col("scene").isin(list(held_out))
    return df.filter(held if split == "val" else ~held)


def boxes_by_frame(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """Every frame with its known-class boxes, one row per box; a frame without boxes keeps one row of NULLs."""
    known = boxes.filter(F.col("class_label").isin(CLASS_NAMES)).drop(*POSE)
    return frames.select(*FRAME).join(known, FRAME, "left")


def _turned(dx: Column, dy: Column) -> tuple[Column, Column]:
    yaw = F.col("bbox_yaw")
    return (
        F.col("bbox_center_x") + dx * F.cos(yaw) - dy * F.sin(yaw),
        F.col("bbox_center_y") + dx * F.sin(yaw) + dy * F.cos(yaw),
    )


def _signed_corners(signs: Sequence[Sequence[int]]) -> Column:
    names = ["sx", "sy", "sz"]
    return F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("corner"), *[F.lit(s).alias(n) for s, n in zip(sign, names)])
                for i, sign in enumerate(signs)
            ]
        )
    )


def box_corners_bev(boxes: DataFrame) -> DataFrame:
    """Closed ring of the five footprint corners of every box."""
    ring = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]
    rows = boxes.withColumn("c", _signed_corners(ring))
    x, y = _turned(F.col("c.sx") * F.col("bbox_width") / 2, F.col("c.sy") * F.col("bbox_length") / 2)
    return rows.select("box_id", F.col("c.corner"), x.alias("corner_x"), y.alias("corner_y"))


def box_corners_3d(boxes: DataFrame, convention: str = "l_major") -> DataFrame:
    """Eight corners. ``l_major`` lays the length along local x, ``wl_axis`` the width."""
    signs = [(sx, sy, sz) for sx in (-1, 1) for sy in (-1, 1) for sz in (-1, 1)]
    along, across = ("bbox_length", "bbox_width") if convention == "l_major" else ("bbox_width", "bbox_length")
    rows = boxes.withColumn("c", _signed_corners(signs))
    x, y = _turned(F.col("c.sx") * F.col(along) / 2, F.col("c.sy") * F.col(across) / 2)
    z = F.col("bbox_center_z") + F.col("c.sz") * F.col("bbox_height") / 2
    return rows.select("box_id", F.col("c.corner"), x.alias("corner_x"), y.alias("corner_y"), z.alias("corner_z"))


def box_edges_3d(boxes: DataFrame) -> DataFrame:
    """Twelve wireframe edges of every box as segment end points."""
    base = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    corners = [(sx, sy, sz) for sz in (-1, 1) for sx, sy in base]
    ring = [(i, (i + 1) % 4) for i in range(4)]
    edges = ring + [(i + 4, j + 4) for i, j in ring] + [(i, i + 4) for i in range(4)]
    spec = [
        F.struct(
            F.lit(number).alias("edge"),
            *[F.lit(s).alias(f"a{axis}") for s, axis in zip(corners[i], "xyz")],
            *[F.lit(s).alias(f"b{axis}") for s, axis in zip(corners[j], "xyz")],
        )
        for number, (i, j) in enumerate(edges)
    ]
    rows = boxes.withColumn("e", F.explode(F.array(*spec)))
    ends = [F.col("e.edge").alias("edge")]
    for end, number in (("a", 1), ("b", 2)):
        x, y = _turned(F.col(f"e.{end}x") * F.col("bbox_width") / 2, F.col(f"e.{end}y") * F.col("bbox_length") / 2)
        z = F.col("bbox_center_z") + F.col(f"e.{end}z") * F.col("bbox_height") / 2
        ends += [x.alias(f"x{number}"), y.alias(f"y{number}"), z.alias(f"z{number}")]
    return rows.select("box_id", *ends)


def box_side_rect(boxes: DataFrame) -> DataFrame:
    """Projection to the x-z plane, without regard to yaw."""
    half_w, half_h = F.col("bbox_width") / 2, F.col("bbox_height") / 2
    return boxes.select(
        "box_id",
        (F.col("bbox_center_x") - half_w).alias("x_low"),
        (F.col("bbox_center_x") + half_w).alias("x_high"),
        (F.col("bbox_center_z") - half_h).alias("z_low"),
        (F.col("bbox_center_z") + half_h).alias("z_high"),
    )


def obstacles_only(points: DataFrame) -> DataFrame:
    return points.filter("class_id >= 0")


def range_clip(points: DataFrame, limits: dict = BEV) -> DataFrame:
    """Keep points inside the half-open range box."""
    for axis in "xyz":
        points = points.filter(
            (F.col(axis) >= F.lit(limits[f"{axis}_min"])) & (F.col(axis) < F.lit(limits[f"{axis}_max"]))
        )
    return points


def frame_summary(points: DataFrame) -> DataFrame:
    """Count, extents and points per class of every frame, in one aggregation."""
    extents = [f(axis).alias(f"{axis}_{name}") for axis in "xyz" for f, name in ((F.min, "min"), (F.max, "max"))]
    per_class = [
        F.count_if(F.col("class_label") == label).alias(f"n_{label.lower().replace(' ', '_')}")
        for label in [*CLASS_NAMES, "Background"]
    ]
    return points.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("num_points"), *extents, *per_class)


def first_n_frames(frames: DataFrame, n: int) -> DataFrame:
    """The first ``n`` frames in (scene, pose_index) order: a top-n sort of the small frame table."""
    return frames.orderBy(*FRAME).limit(n)
