"""Heat at the box centres."""

from __future__ import annotations

import pytest

from skysweep.operators import bev

COLUMNS = "scene string, pose_index int, class_id int, class_label string, bbox_center_x double, bbox_center_y double, bbox_width double, bbox_length double"


def test_check_of_a_map_joins_nothing(spark):
    rows = [
        ("s", 1, 0, "Antenna", 0.1, 0.1, 3.0, 4.0),
        ("s", 1, 0, "Antenna", 90.0, 90.0, 3.0, 4.0),
        ("s", 2, 1, "Cable", 5.0, 5.0, 9.0, 2.0),
        # No frame, and a class without a map of its own.
        (None, 1, 0, "Antenna", 0.1, 0.1, 3.0, 4.0),
        ("s", 2, -1, "Unknown", 5.0, 5.0, 9.0, 2.0),
    ]
    boxes = spark.createDataFrame(rows, COLUMNS)
    heat = bev.heatmap_splat(boxes).cache()
    # One centre of the first frame loses its cell.
    lost = bev.box_cells(boxes).filter("bbox_center_x = 90").first()
    cut = heat.filter((heat.hx != lost.hx) | (heat.hy != lost.hy))
    checked = bev.heatmap_check(boxes, cut)
    found = {(r.scene, r.pose_index, r.class_id): r for r in checked.collect()}
    assert set(found) == {("s", 1, 0), ("s", 2, 1)}
    first, second = found["s", 1, 0], found["s", 2, 1]
    assert (first.boxes, first.peak, first.lowest_centre) == (2, pytest.approx(1), 0.0)
    assert (second.boxes, second.peak, second.lowest_centre) == (1, pytest.approx(1), pytest.approx(1))
    assert first.hot_cells == cut.filter("scene = 's' and pose_index = 1 and heat > 0.5").count()
    # The map is far larger than its boxes; a join planned by their size broadcasts it through the driver.
    assert "Join" not in checked._jdf.queryExecution().optimizedPlan().toString()
