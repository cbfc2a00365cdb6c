"""Steps that read their points once, and their values."""

from __future__ import annotations

import pytest

import __spark_entry__
from skysweep.operators import bev

SMALL = "/root/testdata/sf0.001"


def test_means_of_a_pillar_are_taken_beside_its_points(spark):
    g = bev.BEV | {"max_points": 3}
    rows = [("s", 0, i, 1.0 + i / 100, 2.0, i / 7, 51) for i in range(5)] + [("s", 1, 0, 1.0, 2.0, None, 51)]
    points = spark.createDataFrame(rows, "scene string, pose_index int, point_id long, x double, y double, z double, reflectivity int")
    features = bev.pillar_features(points, g)
    # The only join gives the pillars that are kept.
    assert features._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    found = {(r.pose_index, r.slot): r for r in features.collect()}
    kept = [r for r in rows if r[1] == 0][:3]
    for slot, row in enumerate(kept):
        assert found[0, slot].x_c == pytest.approx(row[3] - sum(r[3] for r in kept) / 3, abs=2e-6)
        assert found[0, slot].z_c == pytest.approx(row[5] - sum(r[5] for r in kept) / 3, abs=2e-6)
    assert (1, 0) not in found or found[1, 0].z_c is None


def test_height_filter_reads_stored_points(spark):
    plan = __spark_entry__.QUERIES["height_prefilter"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan
