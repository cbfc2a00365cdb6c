"""Small groups are worked on as a whole, large ones over link cells, with the same results."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skysweep import schema
from skysweep.operators import cluster, near
from skysweep.operators.near import Space

COLUMNS = "scene string, pose_index int, class_id int, class_label string, point_id long, x double, y double, z double"


def rows_of(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(7)
    rows = []
    for frame in range(4):
        for class_id, label in enumerate(schema.CLASS_NAMES):
            spread = rng.choice([6, 15, 30])
            # Places on a grid, so that distances tie; some points share a place.
            places = [[rng.randrange(spread) * 1.0 for _ in "xyz"] for _ in range(60)]
            rows += [("s", frame, class_id, label, 3 * i, *p) for i, p in enumerate([*places, *places[:5]])]
    rows += [("s", 9, 0, "Antenna", 1, None, 0.0, 0.0), (None, 9, 0, "Antenna", 2, 0.0, 0.0, 0.0), (None, 9, 0, "Antenna", 5, 0.0, 0.0, 0.0)]
    return spark.createDataFrame(rows, COLUMNS).cache()


def limit(monkeypatch, rows):
    monkeypatch.setattr(near, "WHOLE_GROUP", rows)
    monkeypatch.setattr(cluster, "WHOLE_GROUP", rows)


@pytest.mark.parametrize("borders", [True, False])
def test_density_clusters_are_the_same_either_way(points, monkeypatch, borders):
    keys, eps = cluster.CLASS_KEYS, F.when(F.col("class_id") == 0, 2.0).otherwise(3.0)
    found = []
    for rows in (0, 64, 1024):  # all over cells, some so (groups have 65 points or fewer), none so
        limit(monkeypatch, rows)
        found.append(rows_of(cluster.dbscan(points, keys, eps, F.lit(5), borders=borders), *keys, "point_id", "cluster"))
    assert found[0] == found[1] == found[2]
    assert len({r[-1] for r in found[0]}) > 5 and any(r[-1] == -1 for r in found[0])


def test_components_are_the_same_either_way(points, monkeypatch):
    keys = cluster.CLASS_KEYS
    for strict in (False, True):
        spaces = [Space(("x", "y"), F.lit(2.0), strict), Space(("z",), F.lit(3.0))]
        found = []
        for rows in (0, 1024):
            limit(monkeypatch, rows)
            found.append(rows_of(near.near_components(points, keys, "point_id", spaces), *points.columns, "component"))
        assert found[0] == found[1] and len({r[-1] for r in found[0]}) > 5


def test_reassigned_points_are_the_same_either_way(points, monkeypatch):
    params = schema.overlay_parameters(schema.RUN_TUNED)
    clustered = points.withColumn("cluster", F.col("point_id") % 8).localCheckpoint()
    found = []
    for few in (0, 7, 64):
        monkeypatch.setattr(cluster, "FEW_CENTROIDS", few)
        found.append(rows_of(cluster.reassign_points(points, clustered, params), *cluster.CLASS_KEYS, "point_id", "cluster"))
    assert found[0] == found[1] == found[2] and len({r[-1] for r in found[0]}) > 5


def test_small_groups_need_no_cells(points, monkeypatch):
    def refused(*_):
        raise AssertionError("link cells for small groups")

    for module in (near, cluster):
        monkeypatch.setattr(module, "link_cells", refused)
    clustered = cluster.class_dbscan(points, schema.overlay_parameters(schema.RUN_TUNED)).localCheckpoint()
    params = schema.overlay_parameters(schema.RUN_TUNED)
    merged = cluster.merge_clusters(clustered, params)
    assert cluster.reassign_points(points, merged, params).count() == merged.count() == points.count()
    nothing = points.limit(0)
    assert cluster.class_dbscan(nothing, params).count() == 0
