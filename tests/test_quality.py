"""Matching scores, the parameter sweep and the classifiers against plain Python and invariants."""

from __future__ import annotations

import threading
from itertools import permutations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from skysweep.functions.iou import iou_aabb
from skysweep.operators import classify, evaluate
from skysweep.schema import CLASS_NAMES

SIZES = "bbox_width double, bbox_length double, bbox_height double"
KINDS = f"box_id long, scene string, pose_index int, class_label string, bbox_center_x double, bbox_center_y double, bbox_center_z double, {SIZES}, confidence double"


def boxes(spark, rng, n, start, spread=6.0):
    rows = []
    for i in range(n):
        x, y, z = np.round(rng.uniform(0, spread, 3), 2).tolist()
        w, l, h = np.round(rng.uniform(1, 4, 3), 2).tolist()
        rows.append((start + i, "s", int(rng.integers(3)), CLASS_NAMES[int(rng.integers(2))], x, y, z, w, l, h, float(np.round(rng.uniform(), 3))))
    return spark.createDataFrame(rows, KINDS)


def iou(a, b, major):
    shared, volumes = 1.0, []
    sizes = []
    for r in (a, b):
        w, l = (max(r.bbox_width, r.bbox_length), min(r.bbox_width, r.bbox_length)) if major else (r.bbox_width, r.bbox_length)
        sizes.append((w, l, r.bbox_height))
        volumes.append(w * l * r.bbox_height)
    for i, axis in enumerate("xyz"):
        ca, cb = (r[f"bbox_center_{axis}"] for r in (a, b))
        shared *= max(min(ca + sizes[0][i] / 2, cb + sizes[1][i] / 2) - max(ca - sizes[0][i] / 2, cb - sizes[1][i] / 2), 0.0)
    return shared / (sum(volumes) - shared)


def best_match(left, right, threshold):
    """True positives of the assignment of largest total iou, by trying all."""
    if len(left) > len(right):
        left, right = right, left
    gains = [[iou(a, b, True) for b in right] for a in left]
    best = max(permutations(range(len(right)), len(left)), key=lambda p: sum(gains[i][j] for i, j in enumerate(p)), default=())
    return sum(gains[i][j] >= threshold for i, j in enumerate(best))


@pytest.fixture(scope="module")
def pair(spark):
    rng = np.random.default_rng(4)
    return boxes(spark, rng, 16, 0).cache(), boxes(spark, rng, 15, 100).cache()


def test_scores_follow_the_best_assignment(pair):
    detections, truth = pair
    found = evaluate.pr_metrics(detections, truth, 0.25, 0.2).collect()
    left, right = detections.collect(), truth.collect()
    for row in found:
        keep = lambda r: row.class_label in ("all", r.class_label)  # noqa: E731, B023
        tp = 0
        for pose in range(3):
            a, b = ([r for r in side if r.pose_index == pose and keep(r)] for side in (left, right))
            tp += best_match(a, b, 0.25 if row.class_label == "all" else 0.2)
        assert (row.tp, row.tp + row.fp, row.tp + row.fn) == (tp, sum(map(keep, left)), sum(map(keep, right)))
        assert row.precision == row.tp / max(row.tp + row.fp, 1)
    whole = {r.class_label: r for r in evaluate.cluster_eval(detections.withColumn("gt_class", F.col("class_label")), truth, 0.25).collect()}
    assert whole["all"].tp == next(r.tp for r in found if r.class_label == "all") and 0 < whole["all"].mean_iou <= 1
    assert whole["all"].clusters == 16 and whole["all"].objects == 15


def test_a_least_iou_shrinks_the_search_and_loses_nothing(spark):
    rng = np.random.default_rng(5)
    left, right = boxes(spark, rng, 150, 0, 9.0), boxes(spark, rng, 150, 1000, 9.0)
    # An exact threshold: the same box, and one that overlaps in just half of the union.
    row = left.first()
    right = right.unionByName(left.limit(1).withColumn("box_id", F.lit(5000).cast("long")))
    for least in (0.0, 0.3, 0.5, 1.0):
        got = {(r.box_id_a, r.box_id_b) for r in evaluate.iou_pairs(left, right, "aabb", least=least).collect()}
        all_pairs = evaluate.iou_pairs(left, right, "aabb").filter(F.col("iou") >= least).collect()
        assert got == {(r.box_id_a, r.box_id_b) for r in all_pairs}
    assert (row.box_id, 5000) in {(r.box_id_a, r.box_id_b) for r in evaluate.iou_pairs(left, right, "aabb", least=0.999).collect()}
    assert iou_aabb() is not None


def test_sweep_returns_every_combination(spark):
    rng = np.random.default_rng(6)
    rows, i = [], 0
    for c, centre in enumerate(((0, 0, 0), (30, 0, 0), (0, 40, 5))):
        for p in rng.normal(centre, 0.5, (60, 3)):
            rows.append(("s", 0, c % 2, CLASS_NAMES[c % 2], i, *np.round(p, 3).tolist()))
            i += 1
    points = spark.createDataFrame(rows, "scene string, pose_index int, class_id int, class_label string, point_id long, x double, y double, z double")
    truth = points.groupBy("scene", "pose_index", "class_label", F.floor(F.col("point_id") / 60).alias("box_id")).agg(
        *[((F.min(a) + F.max(a)) / 2).alias(f"bbox_center_{a}") for a in "xyz"],
        (F.max("x") - F.min("x")).alias("bbox_width"), (F.max("y") - F.min("y")).alias("bbox_length"), (F.max("z") - F.min("z")).alias("bbox_height"),
    )
    swept = evaluate.param_sweep(points, truth, [10, 500], [3, 5], [2.0, 3.0]).collect()
    assert len(swept) == 8 and [r.f1 for r in swept] == sorted((r.f1 for r in swept), reverse=True)
    assert all(r.n_clusters == (3 if r.min_cluster_size == 10 else 0) for r in swept)
    assert all((r.f1 > 0.5 and r.f1_antenna > 0 and r.mean_iou > 0.3) == (r.min_cluster_size == 10) for r in swept)
    assert all(r.f1_turbine == 0 for r in swept)


def test_forest_finds_the_telling_feature(spark):
    rng = np.random.default_rng(7)
    columns = ["box_id", "class_id", "class_label", *classify.FEATURES]
    rows = []
    for i in range(400):
        c = i % 4
        values = {f: float(rng.normal()) for f in classify.FEATURES} | {"height": 10.0 * c + float(rng.normal()), "footprint": 1.0}
        rows.append((i, c, CLASS_NAMES[c], *(values[f] for f in classify.FEATURES)))
    features = spark.createDataFrame(rows, columns).withColumn("class_id", F.col("class_id").cast("int"))
    folds = classify.prepared(features).groupBy("label", "fold").count().collect()
    assert len(folds) == 20 and {r["count"] for r in folds} == {20}
    graded = classify.rf_cv(features, trees=40, depth=6).collect()
    assert len(graded) == 5 and all(r.accuracy > 0.9 for r in graded)
    model, test = classify.holdout(features, trees=40, depth=6)
    loss = {r.feature: r.importance for r in classify.perm_importance(model, test, repeats=3).collect()}
    assert set(loss) == set(classify.FEATURES)
    assert loss["height"] > 0.3 and max(loss, key=loss.get) == "height" and loss["footprint"] == 0.0


class Stub:
    """An estimator whose fits only return when two run at a time."""

    def __init__(self, barrier):
        self.barrier = barrier

    def copy(self):
        return self

    def fit(self, rows):
        self.barrier.wait(timeout=60)
        self.transform = lambda df: df.withColumn("prediction", F.lit(1.0))
        return self


def test_folds_are_fitted_side_by_side_from_the_rows_given(spark, monkeypatch):
    def written_again(_):
        raise AssertionError("the rows are written once more")

    monkeypatch.setattr(classify, "cut_lineage", written_again)
    rows = spark.range(40).select((F.col("id") % 4).cast("int").alias("fold"), (F.col("id") % 2).cast("double").alias("label"))
    counts = classify.cross_validated(rows, Stub(threading.Barrier(2)), 4).collect()
    assert sum(r.n for r in counts) == 40
    assert classify.forest().getCacheNodeIds()


def test_shuffles_multiply_donors_but_no_rows(spark):
    """Only the single values of donors are laid out per shuffle; rows with their vectors join by rank."""
    rng = np.random.default_rng(8)
    rows = [(i, float(i % 2), Vectors.dense([float(i % 2), float(rng.normal())])) for i in range(60)]
    test = spark.createDataFrame(rows, ["box_id", "label", "features"])

    class Model:
        plans: list[str] = []

        def transform(self, df):
            self.plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            return df.withColumn("prediction", vector_to_array("features")[0])

    model = Model()
    found = {r.feature: (r.importance, r.std) for r in classify.perm_importance(model, test, 4, ["told", "noise"]).collect()}
    assert found["noise"] == (0.0, 0.0) and 0.2 < found["told"][0] < 0.8
    # Donors once, and once more for the sizes of their buckets.
    assert model.plans[0].count("Generate explode") == 2
