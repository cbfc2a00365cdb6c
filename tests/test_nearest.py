"""The nearest-row join against plain Python: ties, piles of copies, a crowded cell, empty sides."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skysweep.operators import near
from skysweep.operators.near import Space

XYZ = ("x", "y", "z")


def frame(spark, xyz, name):
    pdf = pd.DataFrame(np.asarray(xyz, dtype=float).reshape(-1, 3), columns=list(XYZ))
    pdf.insert(0, name, np.arange(len(pdf)))
    pdf.insert(0, "g", 1)
    return spark.createDataFrame(pdf, f"g long, {name} long, x double, y double, z double")


def run(spark, probes, rows, radius, strict=False):
    space = Space(XYZ, F.lit(float(radius)), strict)
    placed, nodes = near.link_cells(frame(spark, rows, "rid").withColumn("tag", F.col("rid") * 10), ["g"], "rid", [space])
    found = near.nearest_within(frame(spark, probes, "pid"), placed, nodes, ["g"], "pid", "rid", ["tag"], space).collect()
    assert all(r.tag_b == r.rid_b * 10 for r in found)
    assert len({r.pid_a for r in found}) == len(found)
    return {r.pid_a: (r.rid_b, r.distance2) for r in found}


def brute(probes, rows, radius, strict=False):
    out = {}
    for i, p in enumerate(np.asarray(probes, dtype=float)):
        d = np.asarray(rows, dtype=float) - p
        d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
        j = int(d2.argmin())
        if d2[j] < radius * radius or (not strict and d2[j] == radius * radius):
            out[i] = (j, d2[j])
    return out


@pytest.mark.parametrize("strict", [False, True])
def test_equals_plain_python_with_ties(spark, strict):
    rng = np.random.default_rng(5)
    rows, probes = rng.integers(0, 14, (400, 3)), rng.integers(-2, 16, (250, 3))
    assert run(spark, probes, rows, 2.0, strict) == brute(probes, rows, 2.0, strict)


def test_crowded_cells_and_piles(spark):
    rng = np.random.default_rng(6)
    crowd = rng.normal(0, 0.3, (3000, 3))
    pile = np.tile([[1.0, 1.0, 1.0]], (900, 1))
    line = np.stack([np.linspace(-5, 5, 400), np.zeros(400), np.zeros(400)], axis=1)
    rows = np.concatenate([pile, crowd, line])
    probes = np.concatenate([rng.normal(0, 2, (200, 3)), [[1.0, 1.0, 1.0], [0.5, 0.5, 0.5], [50, 0, 0]]])
    assert run(spark, probes, rows, 3.0) == brute(probes, rows, 3.0)


def test_empty_sides(spark):
    assert run(spark, [], [[0, 0, 0]], 1.0) == {}
    assert run(spark, [[0, 0, 0]], [], 1.0) == {}


def test_a_million_rows_in_one_cell(spark):
    """Half of them at one place; what meets a probe is a bounded number of parts, not the rows."""
    n = 1_000_000
    spread = lambda step: F.pmod(F.col("rid") * step, F.lit(999_983)) / 999_983.0
    even = F.col("rid") % 2 == 0
    rows = spark.range(n).select(F.lit(1).cast("long").alias("g"), F.col("id").alias("rid"))
    rows = rows.withColumns({c: F.when(even, 0.5).otherwise(spread(s)) for c, s in zip(XYZ, (7919, 104_729, 611_953))})
    space = Space(XYZ, F.lit(2.0))
    placed, nodes = near.link_cells(rows, ["g"], "rid", [space])
    assert nodes.count() == 1
    probes = np.random.default_rng(7).uniform(-0.2, 1.2, (60, 3))
    found = near.nearest_within(frame(spark, probes, "pid"), placed, nodes, ["g"], "pid", "rid", [], space).collect()
    ids = np.arange(n)
    xyz = np.stack([np.where(ids % 2 == 0, 0.5, ids * s % 999_983 / 999_983.0) for s in (7919, 104_729, 611_953)], axis=1)
    assert {r.pid_a: (r.rid_b, r.distance2) for r in found} == brute(probes, xyz, 2.0)
