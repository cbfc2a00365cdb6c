"""Readers, writers, resumption, parameters and the voxel stream."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skysweep import schema
from skysweep.operators import augment, bev, frames, ground, post, voxels
from skysweep.sources import driver_tables, tables
from skysweep.streaming import voxel_stream

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def returns(spark):
    return driver_tables.returns(spark, FOLDER).cache()


@pytest.fixture(scope="module")
def points(returns):
    return frames.points_of(returns).cache()


def test_returns_survive_parquet_and_csv(spark, returns, tmp_path):
    returns.drop("scene").write.parquet(str(tmp_path / "scene_5.parquet"))
    read = tables.scan_returns(spark, str(tmp_path / "scene_5.parquet"))
    assert read.count() == returns.count() and {r.scene for r in read.select("scene").distinct().collect()} == {"scene_5"}
    measured = returns.drop("scene", "point_id")
    measured.select(*reversed(measured.columns)).write.option("header", True).csv(str(tmp_path / "scene_evalA_25.csv"))
    read = tables.scan_returns(spark, str(tmp_path / "scene_evalA_25.csv"), "csv")
    assert {r.scene for r in read.select("scene").distinct().collect()} == {"scene_evalA_25"}
    assert read.schema["distance_cm"].dataType == returns.schema["distance_cm"].dataType
    assert read.drop("scene").exceptAll(measured.select(*read.drop("scene").columns)).count() == 0 and read.count() == returns.count()
    returns.drop("distance_cm").write.parquet(str(tmp_path / "bad"))
    returns.drop("distance_cm").write.option("header", True).csv(str(tmp_path / "bad_csv"))
    for name, kind in (("bad", "parquet"), ("bad_csv", "csv")):
        with pytest.raises(ValueError, match="distance_cm"):
            tables.scan_returns(spark, str(tmp_path / name), kind)


def test_predictions_keyed_by_pose_go_through_post_processing(spark, tmp_path):
    pole = [30.0, 0.0, 10.0, 4.0, 4.0, 20.0, 0.1, 2, "Electric Pole"]
    moved = [pole[0] + 0.1, *pole[1:]]
    near = [pole[0] + 9.0, *pole[1:]]
    rows = [(p, 0.0, 140.0, 5.0, *box) for p in (200.0, 100.0) for box in (pole, moved, near)]
    frame = spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c == 'class_ID' else 'string' if c == 'class_label' else 'double'}" for c in schema.SUBMISSION_COLUMNS))
    frame.coalesce(1).write.option("header", True).csv(str(tmp_path / "files"))
    (part,) = [p for p in (tmp_path / "files").iterdir() if p.suffix == ".csv"]
    (tmp_path / "scene_evalA_25.csv").write_bytes(part.read_bytes())
    boxes = tables.scan_predictions(spark, str(tmp_path / "scene_evalA_25.csv"))
    assert {(r.scene, r.pose_index, r.ego_x) for r in boxes.collect()} == {("scene_evalA_25", 0, 100.0), ("scene_evalA_25", 1, 200.0)}
    kept = post.frame_topk(post.nms_3d(boxes))
    assert kept.count() == 4
    # 9 m apart: one pole, as poles merge below 15 m.
    assert {r.n_merged for r in post.merge_boxes(boxes).collect()} == {3}
    assert tables.submission(post.merge_boxes(boxes)).columns == schema.SUBMISSION_COLUMNS


def _flat_points(spark, rows):
    kinds = "scene string, pose_index int, point_id long, x double, y double, z double, ego_x double, ego_y double, ego_z double, ego_yaw double"
    return spark.createDataFrame([("s", p, i, x, y, z, ex, 0.0, 0.0, 0.0) for i, (p, x, y, z, ex) in enumerate(rows)], kinds)


def test_scene_ground_reads_every_frame_and_stays_sparse(spark):
    # Sixty frames along a line, each 10 m further on.
    points = _flat_points(spark, [(p, 0.0, 0.0, 1.0 * p, 1000.0 * p) for p in range(60)])
    found = ground.scene_ground_lookup(points)
    assert found.filter("hag <> 0 or hag is null").count() == 0
    far = _flat_points(spark, [(0, 0.0, 0.0, 5.0, 0.0), (0, 20_000.0, 20_000.0, 7.0, 0.0)])
    model = ground.scene_ground_model(far).collect()
    assert 2 <= len(model) <= 18 and {r.ground_z for r in model} == {5.0, 7.0}


def test_draws_are_independent_and_take_any_scene(spark):
    frames_ = spark.range(10_000).select(F.concat(F.lit("scene_evalA_"), (F.col("id") % 7).cast("string"), F.lit("x")).alias("scene"), F.col("id").cast("int").alias("pose_index"))
    drawn = augment.frame_draws(frames_).selectExpr("cast(flip as double) flip", "angle_deg", "scale", "keep_ratio", "sign(angle_deg) side").cache()
    for a, b in (("flip", "angle_deg"), ("flip", "side"), ("flip", "scale"), ("flip", "keep_ratio"), ("angle_deg", "scale"), ("scale", "keep_ratio")):
        assert abs(drawn.stat.corr(a, b)) < 0.05
    shares = {r.keep_ratio: r["count"] / 10_000 for r in drawn.groupBy("keep_ratio").count().collect()}
    assert abs(shares[1.0] - 0.5) < 0.03 and all(abs(shares[r] - 1 / 6) < 0.03 for r in (0.75, 0.5, 0.25))
    many = frames_.filter("pose_index < 4").crossJoin(spark.range(1500).withColumnRenamed("id", "point_id")).selectExpr("*", "0d x", "0d y", "0d z")
    noise = augment.aug_jitter(many).cache()
    assert noise.select("x").distinct().count() > 0.999 * noise.count()
    assert abs(noise.stat.corr("x", "y")) < 0.05 and abs(noise.stat.corr("y", "z")) < 0.05


def test_points_are_stored_by_scene(spark, points, tmp_path):
    tables.write_points(points, str(tmp_path / "points"))
    read = spark.read.parquet(str(tmp_path / "points"))
    assert read.count() == points.count()
    one = tables.scan_frame(read, "scene_2", 0)
    assert "PartitionFilters: [isnotnull(scene" in one._jdf.queryExecution().toString()


def test_manifest_submission_and_summary(spark, returns, points, tmp_path):
    manifest = frames.frame_manifest(returns)
    tables.write_manifest(manifest, str(tmp_path / "manifest"))
    back = spark.read.option("header", True).csv(str(tmp_path / "manifest"))
    assert back.columns == manifest.columns and back.count() == 10
    boxes = driver_tables.boxes(spark, FOLDER)
    tables.write_submission(boxes, str(tmp_path / "submission"))
    assert spark.read.option("header", True).csv(str(tmp_path / "submission")).columns == schema.SUBMISSION_COLUMNS
    with pytest.raises(ValueError):
        tables.submission(boxes.drop("bbox_yaw"))
    heights = ground.hag(points)
    metrics = ground.survival_metrics(ground.survival_counts(heights))
    tables.write_run_summary(metrics, ground.run_totals(heights), str(tmp_path / "run"))
    assert spark.read.json(str(tmp_path / "run/summary")).count() == 11


def test_boxes_csv_round_trip(spark, tmp_path):
    boxes = driver_tables.boxes(spark, FOLDER).withColumn("frame_file", F.lit("f")).withColumnRenamed("class_id", "class_ID")
    boxes.select(*schema.BOXES_SCHEMA.names).write.option("header", True).csv(str(tmp_path / "boxes"))
    read = tables.scan_boxes(spark, str(tmp_path / "boxes"), scene="scene_3")
    assert read.schema == schema.BOXES_SCHEMA and read.count() == boxes.filter("scene = 'scene_3'").count()


def test_force_and_resume(spark, returns):
    manifest = frames.frame_manifest(returns)
    assert tables.skip_existing_scenes(manifest, manifest).count() == 0
    assert tables.skip_existing_scenes(manifest, manifest, force=True).count() == 10
    done = manifest.limit(4).select(*schema.FRAME, *schema.POSE, "num_points_valid")
    merged = tables.incremental_manifest(manifest.select(*schema.FRAME, *schema.POSE, "num_points_raw", "num_points_valid", "num_invalid_dropped"), done)
    assert merged.count() == 10 and merged.filter("num_points_raw = -1").count() == 4


def test_empty_frame_keeps_its_index(spark):
    rows = [("s", 0, 0.0, x) for x in (1.0,)] + [("s", 1, 100.0, x) for x in (2.0,)]
    base = spark.createDataFrame(rows, "scene string, point_id long, distance_cm double, ego_x double")
    extra = {c: F.lit(0.0) for c in ("azimuth_raw", "elevation_raw", "ego_y", "ego_z", "ego_yaw")} | {c: F.lit(128) for c in "rgb"}
    assert [r.pose_index for r in frames.points_of(base.withColumns(extra)).collect()] == [1]


def test_parameter_overlay():
    merged = schema.overlay_parameters(schema.RUN_TUNED)
    assert merged["dbscan"]["Electric Pole"] == {"eps": 5.0, "min_samples": 10}
    assert merged["voxel_size"] == 0.2 and merged["max_points_for_dbscan"] == 25000
    assert schema.overlay_parameters({"voxel_size": 0.7})["voxel_size"] == 0.7
    assert schema.BEV["grid_x"] % 8 == 0 and schema.BEV["grid_y"] % 8 == 0


def test_invariants_of_ground_removal(points):
    heights = ground.hag(points).cache()
    kept = ground.ground_filter(heights, 2.0)
    assert kept.agg(F.min("hag")).first()[0] > 2.0
    assert kept.count() + heights.filter("hag <= 2").count() == points.count()


def test_stream_matches_batch(spark, points, tmp_path):
    points.repartition(4).write.parquet(str(tmp_path / "points"))
    source = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "points"))
    batch = voxels.voxel_accumulate(points, 4.0)
    voxel_stream.start_voxel_parts(source, str(tmp_path / "parts"), str(tmp_path / "state2"), 4.0).awaitTermination()
    exact = voxel_stream.voxels_from_parts(spark.read.parquet(str(tmp_path / "parts")))
    columns = [*voxels.VOXEL, "hit_count", "frame_count", "votes_3"]
    assert exact.select(*columns).exceptAll(batch.select(*columns)).count() == 0 and exact.count() == batch.count()


def test_empty_frames_get_a_zero_pillar_and_packing(spark, points, returns):
    features = bev.pillar_features(points.filter("scene <> 'scene_2'"))
    whole = bev.with_empty_frames(features, frames.frame_index(returns))
    assert whole.filter("scene = 'scene_2'").count() == 1
    packed = bev.pack_pillars(features)
    assert packed.agg(F.sum("n_points")).first()[0] == features.count()
