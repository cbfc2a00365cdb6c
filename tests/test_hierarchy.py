"""Density hierarchy against its definition in plain Python."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from skysweep.operators import hierarchy, near

KEYS = ["scene", "pose_index"]


def parts_of(members, far, linked):
    """Connected parts of ``members`` over the pairs for which ``linked`` holds."""
    left, parts = set(members), []
    while left:
        part = {left.pop()}
        fresh = set(part)
        while fresh:
            i = fresh.pop()
            met = {j for j in left if linked(far[i, j])}
            left -= met
            part |= met
            fresh |= met
        parts.append(sorted(part))
    return sorted(parts)


def brute_hierarchy(xyz, reach, min_samples, smallest, epsilon=0.0, whole=True):
    n = len(xyz)
    far = ((xyz[:, None, :] - xyz[None, :, :]) ** 2).sum(axis=2)
    core = np.sort(far, axis=1)[:, min_samples] if n > min_samples else np.full(n, np.inf)
    far = np.maximum(far, np.maximum(core[:, None], core[None, :]))
    weight = lambda d2: 1 / math.sqrt(max(d2, 1e-18))

    def grow(members, birth2):
        node = {"members": members, "birth": math.sqrt(birth2), "gain": 0.0, "parts": []}
        while True:
            lengths = np.unique(far[np.ix_(members, members)])
            low, high = 0, len(lengths) - 1
            while low < high:
                mid = (low + high) // 2
                if len(parts_of(members, far, lambda d, m=mid: d <= lengths[m])) == 1:
                    high = mid
                else:
                    low = mid + 1
            at = lengths[low]
            parts = parts_of(members, far, lambda d: d < at)
            # A single point is a part of itself whatever its core distance.
            big = [p for p in parts if len(p) >= smallest]
            lost = len(members) - sum(map(len, big))
            node["gain"] += lost * weight(at)
            if len(big) == 1:
                members = big[0]
                continue
            node["gain"] += sum(map(len, big)) * weight(at)
            node["parts"] = [grow(p, at) for p in big]
            return node | {"stable": node["gain"] - len(node["members"]) * weight(birth2)}

    def best(node, top):
        inner = [best(p, False) for p in node["parts"]]
        below = sum(v for v, _ in inner)
        if (not node["parts"] or node["stable"] >= below - 1e-9 * abs(below)) and (whole or not top):
            return max(node["stable"], 0.0), [node]
        return below, [c for _, chosen in inner for c in chosen]

    out = [-1] * n
    usable = [i for i in range(n) if core[i] <= reach * reach]
    for tree in parts_of(usable, far, lambda d: d <= reach * reach):
        if len(tree) < smallest:
            continue
        top = grow(tree, reach * reach)
        above = {}

        def walk(node, above=above):
            for p in node["parts"]:
                above[id(p)] = node
                walk(p)

        walk(top)
        for chosen in best(top, True)[1]:
            while chosen["birth"] <= epsilon and id(chosen) in above and (whole or id(above[id(chosen)]) in above):
                chosen = above[id(chosen)]
            for i in chosen["members"]:
                out[i] = min(chosen["members"])
    return out


def run(spark, xyz, reach, min_samples, smallest, epsilon=0.0, whole=True):
    table = pd.DataFrame(xyz, columns=["x", "y", "z"])
    table.insert(0, "point_id", np.arange(len(table)))
    points = spark.createDataFrame(table).withColumns({"scene": F.lit("s"), "pose_index": F.lit(0)})
    found = hierarchy.density_hierarchy(points, KEYS, reach, min_samples, smallest, epsilon, whole).toPandas()
    return found.sort_values("point_id")["cluster"].tolist()


def clouds(seed):
    """Clusters of unlike density, a chain between two of them, a pile of copies and stray points."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal((0, 0, 0), 0.3, (30, 3)), rng.normal((2.5, 0, 0), 0.1, (20, 3)), rng.normal((12, 4, 0), 2.0, (40, 3))]
    chain = np.column_stack([np.linspace(0, 10, 12), np.linspace(0, 4, 12), np.zeros(12)])
    pile = np.repeat([[5.0, -4.0, 0.0]], 9, axis=0)
    return np.round(np.vstack([*parts, chain, pile, rng.uniform(-6, 16, (20, 3))]), 3)


def test_hierarchy_of_unlike_densities(spark):
    xyz = clouds(3)
    expected = brute_hierarchy(xyz, 8.0, 3, 6, 1.0, False)
    assert len(set(expected)) > 3
    assert run(spark, xyz, 8.0, 3, 6, 1.0, False) == expected


def test_hierarchy_with_ties_and_split_work(spark, monkeypatch):
    # Low limits and a forced cut take paths that a small fixture would otherwise never reach.
    monkeypatch.setattr(near, "DIRECT_PAIRS", 36)
    monkeypatch.setattr(near, "DIRECT_ROWS", 6)
    monkeypatch.setattr(hierarchy, "steps", lambda edges: [(4.0, False), (4.0, True), (None, False)])
    rng = np.random.default_rng(8)
    xyz = np.vstack([rng.integers(0, 5, (50, 3)), rng.integers(8, 12, (40, 3)), rng.integers(0, 30, (25, 3))]).astype(float)
    expected = brute_hierarchy(xyz, 6.0, 4, 5)
    assert len(set(expected)) > 2
    assert run(spark, xyz, 6.0, 4, 5) == expected


def test_steps_follow_the_largest_component(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "MOST_EDGES", 10)
    small = [(100 * t + 1, 100 * t + 2, 1.0) for t in range(1, 30)]
    edges = spark.createDataFrame(small, "src long, dst long, length2 double")
    assert hierarchy.steps(edges) == [(None, False)]
    path = spark.createDataFrame([(i, i + 1, float(i)) for i in range(20)], edges.schema)
    cuts = hierarchy.steps(edges.unionByName(path))
    assert cuts[-1] == (None, False) and [c for c, _ in cuts[:-1]] == [cuts[0][0]] * 2 and 8 <= cuts[0][0] <= 11


def test_hierarchy_of_odd_rows_and_nothing(spark):
    layout = "scene string, pose_index int, point_id long, x double, y double, z double"
    rows = [("s", 0, i, 0.1 * i, 0.0, 0.0) for i in range(8)] + [("s", 0, 8, None, 0.0, 0.0), ("s", 0, 9, math.nan, 0.0, 0.0)]
    found = hierarchy.density_hierarchy(spark.createDataFrame(rows, layout), KEYS, 5.0, 2, 4).collect()
    assert {r.point_id: r.cluster for r in found} == {**dict.fromkeys(range(8), 0), 8: -1, 9: -1}
    assert hierarchy.density_hierarchy(spark.createDataFrame([], layout), KEYS, 5.0, 2, 4).collect() == []
