"""Box fitting, matching, ranks and quality figures on hand-made data."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skysweep.functions.ranks import rank_in_group, wide_percentiles
from skysweep.operators import boxfit, evaluate, ground


def rectangle(angle_deg, n=200):
    rng = np.random.default_rng(1)
    local = np.column_stack([rng.uniform(-5, 5, n), rng.uniform(-2, 2, n), rng.uniform(0, 6, n)])
    corners = np.array([[sx * 5, sy * 2, z] for sx in (-1, 1) for sy in (-1, 1) for z in (0, 6)], dtype=float)
    a = np.radians(angle_deg)
    turn = np.array([[np.cos(a), np.sin(a), 0], [-np.sin(a), np.cos(a), 0], [0, 0, 1]])
    return np.vstack([local, corners]) @ turn + [100, 50, 0]


def frame(spark, xyz, key=1):
    pdf = pd.DataFrame(xyz, columns=["x", "y", "z"])
    pdf.insert(0, "cluster", key)
    return spark.createDataFrame(pdf)


def test_min_area_box_of_a_turned_rectangle(spark):
    row = boxfit.obb_min_area(frame(spark, rectangle(30)), ["cluster"]).first()
    assert row.bbox_length == pytest.approx(10, abs=1e-9) and row.bbox_width == pytest.approx(4, abs=1e-9)
    assert row.bbox_height == pytest.approx(6) and row.n_points == 208
    assert np.sin(row.bbox_yaw - np.radians(30)) == pytest.approx(0, abs=1e-9)
    assert (row.bbox_center_x, row.bbox_center_y) == (pytest.approx(100), pytest.approx(50))


def test_flat_hull_takes_the_principal_axes(spark):
    t = np.linspace(0, 9, 10)
    line = np.column_stack([t, np.zeros(10), 0.5 * t])
    row = boxfit.obb_min_area(frame(spark, line), ["cluster"]).first()
    assert row.bbox_length == pytest.approx(np.hypot(9, 4.5)) and row.bbox_width == pytest.approx(0, abs=1e-9)


def test_small_clusters_are_fitted_many_to_a_call(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"s{c % 3}", c, *p) for c in range(300) for p in rng.integers(-20, 20, (int(rng.integers(2, 40)), 3)).astype(float).tolist()]
    rows += [("s0", 500, float(i), 2.0, float(i % 3)) for i in range(6)] + [("s1", 501, 1.0, 1.0, 1.0)] * 5
    rows += [("s1", 502, 0.0, 0.0, 0.0), ("s1", 502, 4.0, 0.0, 1.0), ("s1", 502, 0.0, 3.0, 0.0), ("s1", 502, None, 9.0, 2.0)]
    rows += [(None, 503, float(i), float(i * i), 0.0) for i in range(6)]
    points = spark.createDataFrame(rows, "scene string, cluster long, x double, y double, z double")

    def boxes():
        found = boxfit.obb_min_area(points, ["scene", "cluster"]).collect()
        return {(r.scene, r.cluster): (r.n_points, r.bbox_length, r.bbox_width, r.bbox_height, r.bbox_center_x, r.bbox_center_z) for r in found}

    with monkeypatch.context() as patched:
        # Clusters of a few points need no stages of their own for the corners of hulls.
        patched.setattr(boxfit, "hull_corners", None)
        small = boxes()
    monkeypatch.setattr(boxfit, "WHOLE_GROUP", 12)
    mixed = boxes()
    sizes = {}
    for scene, cluster, *_ in rows:
        if scene is not None:
            sizes[scene, cluster] = sizes.get((scene, cluster), 0) + 1
    assert {k: v[0] for k, v in small.items()} == {k: n for k, n in sizes.items() if n >= 4}
    assert small["s1", 502][:4] == (4, pytest.approx(4), pytest.approx(3), pytest.approx(2))
    assert mixed.keys() == small.keys()
    for key, box in small.items():
        assert box[:4] == pytest.approx(mixed[key][:4], abs=1e-9)


def test_yaw_box_and_padding(spark):
    row = boxfit.obb_yaw_pca(frame(spark, rectangle(30)), ["cluster"], 0.5).first()
    assert row.bbox_height == pytest.approx(7.0)
    assert abs(row.bbox_yaw - np.radians(30)) < 0.1


def test_two_points_stay_axis_aligned(spark):
    row = boxfit.obb_yaw_pca(frame(spark, [[0.0, 0.0, 0.0], [2.0, 1.0, 0.0]]), ["cluster"]).first()
    assert (row.bbox_yaw, row.bbox_width, row.bbox_length) == (0.0, 2.0, 1.0)
    assert row.bbox_height == pytest.approx(0.1)


def test_principal_axes_match_numpy(spark):
    xyz = rectangle(20)
    row = boxfit.principal_direction(frame(spark, xyz), ["cluster"]).first()
    expected = np.linalg.eigh(np.cov(xyz.T))[1][:, -1]
    assert abs(np.dot([row.dx, row.dy, row.dz], expected)) == pytest.approx(1, abs=1e-6)
    box = boxfit.obb_pca3d(frame(spark, xyz), ["cluster"]).first()
    projected = (xyz - xyz.mean(axis=0)) @ np.linalg.eigh(np.cov(xyz.T))[1][:, ::-1]
    assert box.bbox_volume == pytest.approx(np.prod(np.ptp(projected, axis=0)), rel=1e-6)


def test_assignment_is_best_in_total():
    rng = np.random.default_rng(4)
    for rows, cols in ((3, 3), (2, 4), (4, 2), (5, 5)):
        gain = np.round(rng.uniform(0, 1, (rows, cols)), 3) * (rng.uniform(0, 1, (rows, cols)) > 0.3)
        found = sum(gain[r, c] for r, c in evaluate._assign(gain))
        small, large = (gain, cols) if rows <= cols else (gain.T, rows)
        best = max(sum(small[i, p] for i, p in enumerate(perm)) for perm in itertools.permutations(range(large), len(small)))
        assert found == pytest.approx(best)


def test_matching_prefers_the_larger_total(spark):
    schema = (
        "box_id long, scene string, pose_index int, class_label string, bbox_center_x double, bbox_center_y double, "
        "bbox_center_z double, bbox_width double, bbox_length double, bbox_height double, confidence double"
    )
    box = lambda i, x, f=0: (i, "s", f, "Cable", x, 0.0, 0.0, 10.0, 1.0, 1.0, 0.5)
    detections = spark.createDataFrame([box(1, 0.0), box(2, 3.0), box(3, 90.0)], schema)
    truth = spark.createDataFrame([box(1, 2.0), box(2, 5.0), box(3, 0.0, 7)], schema)
    counts = {r.pose_index: (r.tp, r.fp, r.fn) for r in evaluate.match_boxes(detections, truth, 0.3).collect()}
    assert counts == {0: (2, 1, 0), 7: (0, 0, 1)}
    assert [r.pose_index for r in evaluate.match_boxes(detections, truth, 0.3, all_frames=False).collect()] == [0]


def test_ranks_and_percentiles_of_wide_groups(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 30000), "v": np.round(rng.exponential(3, 30000), 2), "i": np.arange(30000)})
    df = spark.createDataFrame(pdf)
    ranked = rank_in_group(df, ["g"], F.floor("v"), 1, ["v", "i"]).toPandas().sort_values("i")
    expected = pdf.sort_values(["v", "i"]).groupby("g").cumcount().sort_index() + 1
    assert ranked["rank"].tolist() == expected.tolist()
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    stats = wide_percentiles(df, ["g"], ["v"], probs).collect()
    assert len(stats) == 12
    for row in stats:
        assert row.value == pytest.approx(np.percentile(pdf.loc[pdf.g == row.g, "v"], row.p * 100))


# Survival shares of three made-up scenes.
SHARES = [
    ("scene_a", 2.0, 80.0, 85.0, 80.0),
    ("scene_a", 5.0, 55.0, 75.0, 80.0),
    ("scene_b", 2.0, 90.0, None, 90.0),
    ("scene_b", 5.0, 61.0, None, 76.0),
    ("scene_c", 2.0, 10.0, 10.0, 10.0),
    ("scene_c", 5.0, 5.0, 5.0, 5.0),
]


def test_threshold_rules(spark):
    metrics = spark.createDataFrame(
        SHARES, "scene string, threshold_m double, antenna_survival_pct double, electric_pole_survival_pct double, wind_turbine_survival_pct double"
    )
    chosen = {r.scene: r.threshold_m for r in ground.threshold_highest_ok(metrics).collect()}
    assert chosen == {"scene_a": 2.0, "scene_b": 5.0, "scene_c": 2.0}
    assert ground.threshold_first_ok(metrics).first().threshold_m == 2.0
    unlabelled = metrics.select("scene", "threshold_m", *[F.lit(None).cast("double").alias(c) for c in metrics.columns[2:]])
    assert ground.threshold_first_ok(unlabelled).first().threshold_m is None


# Published survival of antennas, poles and turbines (percent) at 2 m and 5 m and kept points, per scene.
PUBLISHED = [
    ("scene_1", 2.0, 79.7706, 90.3220, 83.8226, 24912785, 10292814),
    ("scene_1", 5.0, 63.7008, 83.7202, 73.5113, 24912785, 6510142),
    ("scene_10", 2.0, 80.0689, 78.2920, 85.1474, 26121125, 9060437),
    ("scene_10", 5.0, 64.9508, 56.3170, 73.1365, 26121125, 4848058),
    ("scene_2", 2.0, 85.5353, 83.0915, 87.9132, 27583426, 9629733),
    ("scene_2", 5.0, 74.2303, 60.0852, 79.2677, 27583426, 5535400),
    ("scene_3", 2.0, 82.1338, 81.6762, 84.6770, 24616866, 10318429),
    ("scene_3", 5.0, 66.8766, 73.0967, 73.0383, 24616866, 6549738),
    ("scene_4", 2.0, 85.3857, 82.4924, 86.7371, 25883739, 8237114),
    ("scene_4", 5.0, 73.8913, 71.3830, 78.9750, 25883739, 4499522),
    ("scene_5", 2.0, 83.3238, None, 78.5320, 28073465, 10208257),
    ("scene_5", 5.0, 71.7101, None, 63.7646, 28073465, 5314962),
    ("scene_6", 2.0, 81.1649, 73.0010, 76.1939, 25543677, 8794739),
    ("scene_6", 5.0, 65.1876, 51.9989, 67.1499, 25543677, 5268191),
    ("scene_7", 2.0, 80.7506, 75.8620, 81.6113, 27040696, 8732045),
    ("scene_7", 5.0, 67.9016, 64.3678, 70.9251, 27040696, 4688954),
    ("scene_8", 2.0, 86.0852, 91.2531, 75.6749, 25279996, 9262023),
    ("scene_8", 5.0, 74.3900, 74.9627, 58.4802, 25279996, 5130166),
    ("scene_9", 2.0, 76.6261, 93.9850, 80.9148, 26459726, 9807303),
    ("scene_9", 5.0, 54.8985, 84.5547, 67.3395, 26459726, 5685901),
]


def test_published_scenes_choose_their_thresholds(spark):
    metrics = spark.createDataFrame(
        PUBLISHED,
        "scene string, threshold_m double, antenna_survival_pct double, electric_pole_survival_pct double, "
        "wind_turbine_survival_pct double, total long, survived long",
    )
    chosen = ground.threshold_highest_ok(metrics)
    assert {r.scene for r in chosen.filter("threshold_m = 5").collect()} == {"scene_4"} and chosen.count() == 10
    kept = metrics.join(chosen, ["scene", "threshold_m"])
    assert {r.scene: r.survived for r in kept.collect()}["scene_4"] == 4499522
    sums = metrics.groupBy("threshold_m").agg(F.sum("total").alias("total"), F.sum("survived").alias("survived"))
    assert {r.threshold_m: (r.total, r.survived) for r in sums.collect()} == {
        2.0: (261515501, 94342894),
        5.0: (261515501, 54031034),
    }


def test_tiny_frame_and_edge_tile(spark):
    rows = [("s", 0, i, float(i), 0.0, float(i)) for i in range(9)] + [("s", 1, i, float(i), 0.0, float(i % 3)) for i in range(11)]
    points = spark.createDataFrame(rows, "scene string, pose_index int, point_id long, x double, y double, z double")
    tiles = ground.tile_ground(points, 5.0).toPandas()
    tiny = tiles[tiles.pose_index == 0]
    assert len(tiny) == 1 and tiny.ground_z.iloc[0] == pytest.approx(np.percentile(range(9), 5))
    # x = 10 lies on the far edge of an extent of two whole tiles and belongs to the second one.
    assert sorted(tiles[tiles.pose_index == 1].tile_points) == [5, 6]
