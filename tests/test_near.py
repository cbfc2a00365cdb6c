"""Neighbour search, components, clustering and suppression against brute force."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skysweep.functions.iou import iou_aabb
from skysweep.operators import cluster, graph, near
from skysweep.operators.boxfit import merge_fragments
from skysweep.operators.post import merge_boxes


def brute_components(n, linked):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(n), 2):
        if linked(i, j):
            a, b = sorted((root(i), root(j)))
            label[b] = a
    return [root(i) for i in range(n)]


def brute_dbscan(xyz, eps, least):
    d2 = ((xyz[:, None, :] - xyz[None, :, :]) ** 2).sum(axis=2)
    close = d2 <= eps * eps
    core = close.sum(axis=1) >= least
    label = brute_components(len(xyz), lambda i, j: core[i] and core[j] and close[i, j])
    smallest = {}
    for i in np.flatnonzero(core):
        smallest.setdefault(label[i], i)
    out = []
    for i in range(len(xyz)):
        if core[i]:
            out.append(smallest[label[i]])
        else:
            near_core = [(d2[i, j], j) for j in np.flatnonzero(core & close[i])]
            out.append(smallest[label[min(near_core)[1]]] if near_core else -1)
    return out


def points_frame(spark, xyz, frame=0):
    pdf = pd.DataFrame(xyz, columns=["x", "y", "z"])
    pdf.insert(0, "point_id", np.arange(len(pdf)))
    pdf.insert(0, "pose_index", frame)
    pdf.insert(0, "scene", "scene_1")
    return spark.createDataFrame(pdf)


def run_dbscan(spark, xyz, eps, least):
    found = cluster.dbscan(points_frame(spark, xyz), ["scene", "pose_index"], F.lit(float(eps)), F.lit(least)).toPandas()
    return found.sort_values("point_id")["cluster"].tolist()


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(0, i) for i in range(1, 40)]
    edges = spark.createDataFrame(chain + star, "src long, dst long")
    nodes = spark.range(0, 170)
    found = {r.id: r.component for r in graph.connected_components(nodes, edges).collect()}
    assert all(found[i] == 100 for i in range(100, 161))
    assert all(found[i] == 0 for i in range(40))
    assert found[165] == 165


def test_dbscan_border_and_noise(spark):
    core = [(0.0, 0.0, 0.0), (0.1, 0.0, 0.0), (0.0, 0.1, 0.0), (0.1, 0.1, 0.0)]
    xyz = np.array([*core, (1.1, 0.0, 0.0), (9.0, 9.0, 9.0)])
    assert run_dbscan(spark, xyz, 1.0, 4) == [0, 0, 0, 0, 0, -1]


def test_dbscan_matches_brute_force_with_crowded_cells(spark, monkeypatch):
    # Low limits force the splitting of cells that a small fixture would otherwise never reach.
    monkeypatch.setattr(near, "DIRECT_PAIRS", 4)
    monkeypatch.setattr(near, "DIRECT_ROWS", 2)
    rng = np.random.default_rng(5)
    blobs = [rng.normal(c, 0.35, (60, 3)) for c in ((0, 0, 0), (1.9, 0, 0), (6, 6, 0))]
    copies = np.repeat([[3.3, 0.2, 0.1]], 25, axis=0)
    xyz = np.round(np.vstack([*blobs, copies, rng.uniform(-3, 9, (60, 3))]), 4)
    assert run_dbscan(spark, xyz, 0.8, 5) == brute_dbscan(xyz, 0.8, 5)


def test_merge_is_transitive_and_strict(spark):
    rows = [(1, 0.0, 0.9, 0.5), (2, 8.0, 0.7, 0.1), (3, 16.0, 0.8, 0.2), (4, 26.0, 0.3, 0.3)]
    boxes = spark.createDataFrame(
        [(i, "scene_1", 0, "Unknown", x, 0.0, 0.0, 1.0 + i, 1.0, 1.0, yaw, conf) for i, x, conf, yaw in rows],
        "box_id long, scene string, pose_index int, class_label string, bbox_center_x double, bbox_center_y double, "
        "bbox_center_z double, bbox_width double, bbox_length double, bbox_height double, bbox_yaw double, confidence double",
    )
    merged = {r.box_id: r for r in merge_boxes(boxes).collect()}
    # 16 and 26 are exactly ten apart, which is not nearer than ten.
    assert set(merged) == {1, 4}
    assert merged[1].n_merged == 3 and merged[1].bbox_center_x == pytest.approx(8.0)
    assert merged[1].bbox_width == 4.0 and merged[1].bbox_yaw == 0.5 and merged[1].confidence == 0.9


def test_components_split_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(near, "DIRECT_PAIRS", 4)
    rng = np.random.default_rng(3)
    xyz = np.round(np.vstack([rng.uniform(0, 1, (80, 3)), rng.uniform(1.4, 2.4, (80, 3)), rng.uniform(5, 6, (40, 3))]), 4)
    space = near.Space(("x", "y", "z"), F.lit(0.45), strict=True)
    found = near.near_components(points_frame(spark, xyz), ["scene", "pose_index"], "point_id", [space]).toPandas()
    expected = brute_components(len(xyz), lambda i, j: ((xyz[i] - xyz[j]) ** 2).sum() < 0.45**2)
    assert found.sort_values("point_id")["component"].tolist() == expected


def test_fragments_need_distance_and_angle(spark):
    rng = np.random.default_rng(8)
    n = 60
    centre = np.round(rng.uniform(0, 30, (n, 3)), 3)
    axis = rng.normal(size=(n, 3))
    axis /= np.linalg.norm(axis, axis=1)[:, None]
    pdf = pd.DataFrame(np.hstack([centre, axis]), columns=["bbox_center_x", "bbox_center_y", "bbox_center_z", "dx", "dy", "dz"])
    pdf.insert(0, "cluster", np.arange(n))
    pdf.insert(0, "scene", "s")
    found = merge_fragments(spark.createDataFrame(pdf), ["scene"], "cluster", 9.0, 30.0).toPandas()
    linked = lambda i, j: np.linalg.norm(centre[i] - centre[j]) <= 9 and np.degrees(np.arccos(min(abs(axis[i] @ axis[j]), 1))) <= 30
    assert found.sort_values("cluster")["fragment_group"].tolist() == brute_components(n, linked)


def brute_suppression(boxes, threshold):
    def iou(a, b):
        shared = 1.0
        for c, s in (("bbox_center_x", "bbox_width"), ("bbox_center_y", "bbox_length"), ("bbox_center_z", "bbox_height")):
            shared *= max(min(a[c] + a[s] / 2, b[c] + b[s] / 2) - max(a[c] - a[s] / 2, b[c] - b[s] / 2), 0)
        volume = lambda q: q["bbox_width"] * q["bbox_length"] * q["bbox_height"]
        return shared / (volume(a) + volume(b) - shared + 1e-10)

    kept = []
    for row in sorted(boxes, key=lambda q: (-q["confidence"], q["box_id"])):
        if all(iou(k, row) <= threshold for k in kept):
            kept.append(row)
    return sorted(k["box_id"] for k in kept)


@pytest.mark.parametrize("best_per_cell", [2, 64])
def test_suppression_of_piles_and_chains(spark, best_per_cell):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(110):
        pile = i < 50
        x, y = (5 + 0.01 * i, 5.0) if pile else rng.uniform(0, 40, 2)
        w, l = (4.0, 4.0) if pile else rng.uniform(0.5, 14, 2)
        rows.append((i, "s", float(np.round(x, 3)), float(np.round(y, 3)), 0.0, float(w), float(l), 5.0, float(np.round(rng.uniform(), 2))))
    names = ["box_id", "scene", "bbox_center_x", "bbox_center_y", "bbox_center_z", "bbox_width", "bbox_length", "bbox_height", "confidence"]
    boxes = spark.createDataFrame(rows, names)
    order = [("confidence", True), ("box_id", False)]
    kept = graph.greedy_suppression(boxes, ["scene"], iou_aabb(), 0.3, order, best_per_cell=best_per_cell)
    expected = brute_suppression([dict(zip(names, r)) for r in rows], 0.3)
    assert sorted(r.box_id for r in kept.select("box_id").collect()) == expected


def test_large_groups_are_sampled_and_given_back(spark):
    rng = np.random.default_rng(2)
    xyz = np.round(np.vstack([rng.normal((0, 0, 0), 0.4, (120, 3)), rng.normal((20, 0, 0), 0.4, (120, 3))]), 4)
    points = points_frame(spark, xyz).withColumns({"class_id": F.lit(0), "class_label": F.lit("Antenna")})
    user = {"max_points_for_dbscan": 50, "voxel_size": 0.2, "dbscan": {"Antenna": {"eps": 3.0, "min_samples": 5}}}
    for thin in (True, False):
        sizes = cluster.cluster_points(points, user, thin_large=thin).groupBy("cluster").count().toPandas()
        assert sizes["count"].tolist() == [120, 120]
    # By default every point of a large group is clustered, so its boxes do not depend on the limit.
    boxes = cluster.extract_boxes(points, user).toPandas().sort_values("bbox_center_x")
    assert boxes["num_points"].tolist() == [120, 120]
    assert boxes["bbox_center_x"].round().tolist() == [0.0, 20.0]


def test_core_clusters_of_several_densities_search_once(spark, monkeypatch):
    rng = np.random.default_rng(11)
    # A crowded cell, a loose cloud and strays: cells above, between and below the densities.
    xyz = np.round(np.vstack([rng.normal(0, 0.1, (40, 3)), rng.normal((6, 0, 0), 0.9, (60, 3)), rng.uniform(-20, 20, (15, 3))]), 3)
    points = points_frame(spark, xyz).withColumn("epsilon", F.explode(F.array(F.lit(0.8), F.lit(1.5))))
    keys, densities = ["scene", "pose_index", "epsilon"], [4, 9, 20]
    expected = set()
    for least in densities:
        cored = cluster.dbscan(points, keys, F.col("epsilon"), F.lit(least), borders=False).filter("cluster >= 0")
        expected |= {(r.epsilon, least, r.point_id, r.cluster) for r in cored.collect()}
    searches = []
    search = cluster.rows_within
    monkeypatch.setattr(cluster, "rows_within", lambda *a, **k: searches.append(1) or search(*a, **k))
    found = cluster.core_clusters(points, keys, F.col("epsilon"), densities)
    assert {(r.epsilon, r.min_samples, r.point_id, r.cluster) for r in found.collect()} == expected
    assert len(searches) == 1 and found.count() == len(expected) > 0
