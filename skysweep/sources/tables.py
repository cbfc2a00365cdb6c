"""Readers, writers and resumption of partly finished runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from skysweep.operators.frames import frame_index
from skysweep.schema import BOXES_SCHEMA, FRAME, POSE, RETURNS_SCHEMA, SUBMISSION_COLUMNS
from skysweep.session import cut_lineage


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def scan_returns(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Read raw returns; the scene is taken from the file name where the data do not carry it.

    Columns are chosen by name in every format; a missing one is an error.
    """
    reader = spark.read.format(file_format)
    raw = (reader.option("header", True) if file_format == "csv" else reader).load(path)
    require_columns(raw, [name for name in RETURNS_SCHEMA.names if name not in ("scene", "point_id")])
    stem = F.nullif(F.regexp_extract("_metadata.file_path", r"(scene_[^/.]+)", 1), F.lit(""))
    raw = raw.withColumn("scene", F.coalesce(F.col("scene"), stem) if "scene" in raw.columns else stem)
    kept = [name for name in RETURNS_SCHEMA.names if name in raw.columns]
    return raw.select(*[F.col(name).cast(RETURNS_SCHEMA[name].dataType).alias(name) for name in kept])


def scan_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Read prediction files of the thirteen-column layout, whose frames are keyed by pose.

    The scene comes from the file name, frames are numbered by ascending pose, boxes in file order. Files without a
    ``confidence`` column give every box 1.
    """
    raw = spark.read.option("header", True).csv(path)
    require_columns(raw, SUBMISSION_COLUMNS)
    kinds = {**{f.name: f.dataType for f in BOXES_SCHEMA}, "confidence": DoubleType()}
    columns = [*SUBMISSION_COLUMNS, *(["confidence"] if "confidence" in raw.columns else [])]
    # Numbered once, so that every later step sees the same ids.
    boxes = cut_lineage(
        raw.select(
            F.monotonically_increasing_id().alias("box_id"),
            F.regexp_extract("_metadata.file_path", r"([^/]+)\.csv", 1).alias("scene"),
            *[F.col(c).cast(kinds[c]).alias(c) for c in columns],
        )
    )
    boxes = boxes if "confidence" in columns else boxes.withColumn("confidence", F.lit(1.0))
    frames = frame_index(boxes).select("scene", *POSE, "pose_index")
    return boxes.join(frames, ["scene", *POSE]).withColumnRenamed("class_ID", "class_id")


def scan_boxes(
    spark: SparkSession, path: str, scene: str | None = None, pose_index: int | None = None
) -> DataFrame:
    """Read a box CSV with the fixed schema; filters reach the scan."""
    boxes = spark.read.schema(BOXES_SCHEMA).option("header", True).option("enforceSchema", False).csv(path)
    return filter_boxes(boxes, scene, pose_index)


def filter_boxes(boxes: DataFrame, scene: str | None = None, pose_index: int | None = None) -> DataFrame:
    if scene is not None:
        boxes = boxes.filter(F.col("scene") == scene)
    if pose_index is not None:
        boxes = boxes.filter(F.col("pose_index") == pose_index)
    return boxes


def scan_frame(points: DataFrame, scene: str, pose_index: int) -> DataFrame:
    """Points of one frame; on a table partitioned by scene only that partition is read."""
    return points.filter((F.col("scene") == scene) & (F.col("pose_index") == pose_index))


def scenes_subset(df: DataFrame, scenes: Sequence[str] | None = None) -> DataFrame:
    if scenes is None:
        return df.filter(F.col("scene").startswith("scene_"))
    return df.filter(F.col("scene").isin(list(scenes)))


def write_points(points: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write point rows by scene, clustered by frame inside the files.

    Range partitioning splits a frame that outgrows one task over several files, which a hash on the frame cannot do.
    """
    (
        points.repartitionByRange("scene", "pose_index", "point_id")
        .sortWithinPartitions("scene", "pose_index", "point_id")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("scene")
        .parquet(path)
    )


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.orderBy(*FRAME).write.mode("overwrite").option("header", True).csv(path)


def submission(boxes: DataFrame) -> DataFrame:
    """Exactly the thirteen submission columns, in order."""
    if "class_ID" not in boxes.columns and "class_id" in boxes.columns:
        boxes = boxes.withColumnRenamed("class_id", "class_ID")
    return require_columns(boxes, SUBMISSION_COLUMNS).select(*SUBMISSION_COLUMNS)


def write_submission(boxes: DataFrame, path: str) -> None:
    submission(boxes).write.mode("overwrite").option("header", True).csv(path)


def write_run_summary(metrics: DataFrame, summary: DataFrame, path: str) -> None:
    """Metrics per scene and combined as CSV, run summary rows as JSON."""
    csv = metrics.withColumn("scene_name", F.col("scene"))
    csv.write.mode("overwrite").option("header", True).partitionBy("scene").csv(f"{path}/scene_metrics")
    metrics.orderBy("scene", "threshold_m").write.mode("overwrite").option("header", True).csv(f"{path}/all_metrics")
    summary.write.mode("overwrite").json(f"{path}/summary")


def drop_missing_frames(manifest: DataFrame, frames: DataFrame) -> DataFrame:
    return manifest.join(frames.select(*FRAME).distinct(), FRAME, "left_semi")


def count_missing_frames(manifest: DataFrame, frames: DataFrame) -> DataFrame:
    """How many manifest rows of every scene have no frame data."""
    lost = manifest.join(frames.select(*FRAME).distinct(), FRAME, "left_anti")
    return lost.groupBy("scene").agg(F.count(F.lit(1)).alias("missing_frames"))


def pending_frames(frames: DataFrame, done: DataFrame) -> DataFrame:
    return frames.join(done.select(*FRAME).distinct(), FRAME, "left_anti")


def incremental_manifest(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """Manifest of a resumed run.

    New frames keep their counts. Frames already present keep their valid count, rebuilt from the stored points;
    their raw and dropped counts are unknown (-1).
    """
    unknown = F.lit(-1).cast("long")
    columns = [name for name in manifest.columns if name in done.columns or name.startswith("num_")]
    rebuilt = done.withColumn("num_points_raw", unknown).withColumn("num_invalid_dropped", unknown)
    return pending_frames(manifest, done).select(*columns).unionByName(rebuilt.select(*columns))


def skip_existing_scenes(scenes: DataFrame, finished: DataFrame, force: bool = False) -> DataFrame:
    if force:
        return scenes
    return scenes.join(finished.select("scene").distinct(), "scene", "left_anti")
