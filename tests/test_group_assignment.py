"""Assignment in whole groups against the table of pairs."""

from __future__ import annotations

import numpy as np
import pytest

from skysweep.operators import evaluate
from skysweep.operators.evaluate import _assign, _assign_many, assign_pairs, best_pairs, iou_pairs

KEYS = ["scene", "pose_index"]
BOXES = "scene string, pose_index int, box_id long, " + ", ".join(f"{c} double" for c in evaluate.SHAPE)


def boxes(rng, frames, most, start):
    """Boxes on a coarse grid, so that many pairs have the same iou."""
    rows = []
    for frame in range(frames):
        for _ in range(int(rng.integers(0, most + 1))):
            rows.append(("s", frame, start + len(rows), *map(float, rng.integers(0, 5, 3)), *map(float, rng.integers(1, 4, 3))))
    return rows


def found(df):
    return sorted((r.scene, r.pose_index, r.box_id_a, r.box_id_b, r.iou) for r in df.collect())


def test_whole_groups_give_the_same_pairs_without_a_table_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    left, right = boxes(rng, 60, 14, 0), boxes(rng, 60, 11, 1 << 40)
    # Boxes that come twice, and a lone pair that does.
    left, right = left + left[::9] + [("t", 1, 5000, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)] * 2, right + right[::7] + [("t", 1, 5000, 0.5, 0.0, 0.0, 1.0, 1.0, 1.0)] * 2
    left += [(None, 1, 5001, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)]
    right += [(None, 1, 5001, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)]
    left, right = spark.createDataFrame(left, BOXES), spark.createDataFrame(right, BOXES)
    expected = found(assign_pairs(iou_pairs(left, right, "major", KEYS), KEYS))
    monkeypatch.setattr(evaluate, "MEASURED", 300)
    monkeypatch.setattr(evaluate, "SIDE_BY_SIDE", 1000)
    monkeypatch.setattr(evaluate, "iou_pairs", lambda *_: pytest.fail("a table of pairs"))
    assert len(expected) > 150 and found(best_pairs(left, right, KEYS)) == expected
    assert {r.tp for r in evaluate.match_boxes(left, right, 0.3).filter("scene = 't'").collect()} == {4}


def test_large_and_odd_groups_go_over_the_table_of_pairs(spark):
    rng = np.random.default_rng(12)
    left, right = boxes(rng, 30, 12, 0), boxes(rng, 30, 12, 5000)
    # One id in two frames, a missing place, one that is not a number, and a missing id.
    left += [("s", 3, 900, *[1.0] * 6), ("s", 7, 900, *[1.0] * 6), ("s", 9, 901, 1.0, 1.0, None, 2.0, 2.0, 2.0), ("s", 11, None, *[2.0] * 6)]
    right += [("s", 13, 9000, 1.0, float("nan"), 1.0, 2.0, 2.0, 2.0)]
    left, right = spark.createDataFrame(left, BOXES), spark.createDataFrame(right, BOXES)
    expected = found(assign_pairs(iou_pairs(left, right, "major", KEYS), KEYS))
    for most in (10, 1024):
        assert found(best_pairs(left, right, KEYS, most)) == expected


def test_no_boxes(spark):
    none = spark.createDataFrame([], BOXES)
    some = spark.createDataFrame([("s", 1, 1, *[1.0] * 6)], BOXES)
    assert [best_pairs(a, b, KEYS).count() for a, b in ((none, none), (some, none), (none, some))] == [0, 0, 0]


def test_tables_side_by_side_equal_the_solver():
    rng = np.random.default_rng(13)
    rows, columns = rng.integers(1, 7, 200), rng.integers(6, 12, 200)
    gains = np.zeros((200, 6, 11))
    for gain, n, m in zip(gains, rows, columns):
        gain[:n, :m] = rng.integers(0, 5, (n, m)) / 5.0
    for gain, n, m, owner in zip(gains, rows, columns, _assign_many(gains, rows, columns)):
        assert sorted((int(r), c) for c, r in enumerate(owner) if r >= 0) == sorted(_assign(gain[:n, :m]))
