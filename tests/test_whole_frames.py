"""Small frames are filtered and clustered as a whole, with the results of the steps for large ones."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysweep import schema
from skysweep.operators import cluster, evaluate, near

COLUMNS = "scene string, pose_index int, class_id int, class_label string, point_id long, x double, y double, z double"


def rows_of(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(3)
    rows = []
    for frame in range(5):
        for i in range(30 + 25 * frame):
            class_id = rng.randrange(4)
            place = [float(rng.randrange(12)) for _ in "xy"] + [rng.randrange(40) / 10]
            rows.append(("s", frame, class_id, schema.CLASS_NAMES[class_id], 2 * i, *place))
    rows += [("s", 4, 0, "Antenna", 901, 1.0, 1.0, None), ("s", 4, 0, "Antenna", 903, None, 1.0, 3.0), (None, 2, 0, "Antenna", 5, 1.0, 1.0, 3.0)]
    rows += [("s", 8, 0, "Antenna", i, 0.0, 0.0, None) for i in range(40)]
    return spark.createDataFrame(rows, COLUMNS).cache()


def limit(monkeypatch, rows):
    monkeypatch.setattr(cluster, "WHOLE_GROUP", rows)
    monkeypatch.setattr(cluster, "WHOLE_FRAME", rows)


def test_frames_are_filtered_and_cut_the_same_either_way(points, monkeypatch):
    heights, cuts = [], []
    for rows in (0, 80, 1024):
        limit(monkeypatch, rows)
        high = cluster.height_prefilter(points, 0.5, 30)
        heights.append(rows_of(high, *points.columns))
        cuts.append(rows_of(cluster.density_cut(high, 2.0, 4, 6), *schema.FRAME, "point_id", "cluster"))
    assert heights[0] == heights[1] == heights[2] and cuts[0] == cuts[1] == cuts[2]
    assert len(heights[0]) > 200 and len({r[-1] for r in cuts[0]}) > 3 and any(r[-1] == -1 for r in cuts[0])
    for frame in range(1, 4):
        z = [r.z for r in points.filter(F.col("pose_index") == frame).filter("scene is not null").collect()]
        assert sum(r[1] == frame for r in heights[0]) == sum(v - np.quantile(z, 0.05) > 0.5 for v in z)


def test_whole_frames_need_no_percentiles_and_no_stored_clusters(points, monkeypatch):
    """The steps for large frames, several shuffles of all points each, are left out."""
    monkeypatch.setattr(cluster, "wide_percentiles", lambda *_: pytest.fail("percentiles by steps"))
    high = cluster.height_prefilter(points, 0.5, 30)
    monkeypatch.setattr(cluster, "cut_lineage", lambda *_: pytest.fail("clusters are stored"))
    assert cluster.density_cut(high, 2.0, 4, 6).filter("cluster >= 0").count() > 100


def test_core_clusters_of_whole_groups_search_no_cells(points, monkeypatch):
    known = points.dropna().withColumn("epsilon", F.explode(F.array(F.lit(1.5), F.lit(2.5))))
    keys, names = [*schema.FRAME, "epsilon"], [*schema.FRAME, "epsilon", "min_samples", "point_id", "x", "class_id", "cluster"]
    given = (known, keys, F.col("epsilon"), [8, 3, 5], ["class_id"])
    expected = rows_of(cluster.core_clusters(*given), *names)
    limit(monkeypatch, 80)
    assert rows_of(cluster.core_clusters_of_groups(*given), *names) == expected
    limit(monkeypatch, 1024)
    for name in ("link_cells", "core_clusters"):
        monkeypatch.setattr(cluster, name, lambda *_: pytest.fail("cells"))
    assert rows_of(evaluate.cluster.core_clusters_of_groups(*given), *names) == expected and len(expected) > 300


def test_close_pairs_are_those_of_the_table_of_distances():
    rng = np.random.default_rng(5)
    places = [rng.integers(0, 6, 80).astype(float) for _ in "xyz"]
    places[1][7], places[2][9] = np.nan, np.inf
    for radius in (0.0, 1.0, 2.5, -1.0, np.nan, np.inf):
        with np.errstate(invalid="ignore"):
            expected = {(int(i), int(j)) for i, j in zip(*np.nonzero(near.squared_distances(places) <= radius * radius))}
            table = near.squared_distances(places)
            a, b, squared = near.close_pairs(places, radius)
        assert len(a) == len(expected) and {(int(i), int(j)) for i, j in zip(a, b)} == expected
        assert all(squared == table[a, b])
