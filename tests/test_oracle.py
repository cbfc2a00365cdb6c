"""Registered queries against DuckDB at the smallest scale; slow clustering queries have tests of their own."""

from __future__ import annotations

import os

import pytest

from skysweep.checks.all import QUERIES, SQL
from skysweep.checks.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
SLOW = {
    "cluster_centroids", "merge_clusters", "reassign_points", "min_cluster_filter", "gt_boxes_run", "gt_boxes_run_stats",
    "density_cut", "cluster_profile", "cluster_features", "object_like", "geo_classify", "postprocess_report",
    "postprocess_summary", "scene_stability", "density_robustness",
}
KEYS = [k for k in SQL if k not in SLOW or os.environ.get("ALL_QUERIES")]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_sql(spark, duck, key):
    assert difference(QUERIES[key](spark, FOLDER).toPandas(), duck.execute(SQL[key]).fetchdf()) is None
