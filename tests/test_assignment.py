"""One-to-one assignment: the auction against the exact solver and plain enumeration."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from skysweep.operators import evaluate
from skysweep.operators.evaluate import _assign, assign_pairs


def components(seed, count, most, coarse):
    """Random tables of gains, no two of which share a box; zero is no pair."""
    rng = np.random.default_rng(seed)
    for _ in range(count):
        shape = rng.integers(1, most + 1, 2)
        gain = rng.integers(1, 5, shape) / 5.0 if coarse else np.round(rng.uniform(0.05, 1, shape), 6)
        yield np.where(rng.uniform(size=shape) < 0.25, 0.0, gain)


def as_pairs(spark, tables):
    rows = []
    for k, gain in enumerate(tables):
        rows += [("s", k, int(100 * k + i), int(100 * k + j), float(gain[i, j])) for i, j in zip(*np.nonzero(gain))]
    return spark.createDataFrame(rows, "scene string, pose_index long, box_id_a long, box_id_b long, iou double")


def totals(found, n):
    rows = found.collect()
    for side in ("box_id_a", "box_id_b"):
        assert len({r[side] for r in rows}) == len(rows)
    sums = np.zeros(n)
    for r in rows:
        sums[r.pose_index] += r.iou
    return sums


def exact(gain):
    return sum(gain[r, c] for r, c in _assign(gain))


@pytest.mark.parametrize("coarse", [False, True])
def test_auction_total_equals_the_exact_solver(spark, coarse):
    tables = list(components(3, 12, 7, coarse))
    pairs = as_pairs(spark, tables)
    expected = [exact(g) for g in tables]
    for found in (assign_pairs(pairs, ["scene", "pose_index"], matrix=0), assign_pairs(pairs, ["scene", "pose_index"])):
        assert np.allclose(totals(found, len(tables)), expected, atol=1e-9)


def test_auction_of_one_component_in_several_blocks(spark, monkeypatch):
    """Gains in tenths, which the coarser unit holds exactly, so few rounds settle the contest of the blocks."""
    monkeypatch.setattr(evaluate, "GAIN_UNITS", 10)
    gain = np.random.default_rng(9).integers(3, 10, (6, 5)) / 10.0
    found = assign_pairs(as_pairs(spark, [gain]), ["scene", "pose_index"], matrix=0, block=20)
    assert np.allclose(totals(found, 1), [exact(gain)], atol=1e-9)


def test_exact_solver_equals_enumeration():
    for gain in components(4, 40, 5, False):
        wide = gain if gain.shape[0] <= gain.shape[1] else gain.T
        n, m = wide.shape
        best = max(sum(wide[i, c] for i, c in enumerate(order)) for order in itertools.permutations(range(m), n))
        assert abs(exact(gain) - best) < 1e-12


def test_large_components_leave_the_grouped_step(spark, monkeypatch):
    """Only a component over the bound is auctioned; the others are solved in their task."""
    crowded = np.round(np.random.default_rng(8).uniform(0.3, 1, (20, 18)), 6)
    tables = [crowded, np.array([[0.5, 0.4], [0.45, 0.0]]), np.array([[0.7]])]
    seen = []
    auction = evaluate._auction
    monkeypatch.setattr(evaluate, "_auction", lambda pairs, boxes, block: seen.append((pairs.count(), boxes)) or auction(pairs, boxes, block))
    found = assign_pairs(as_pairs(spark, tables), ["scene", "pose_index"], matrix=100)
    assert np.allclose(totals(found, 3), [exact(g) for g in tables], atol=1e-9)
    assert seen == [(360, 38)]


def test_no_pairs(spark):
    assert assign_pairs(as_pairs(spark, []), ["scene", "pose_index"], matrix=0).count() == 0


def test_one_call_solves_many_small_components(spark):
    tables = list(components(8, 30, 6, False))
    pairs = as_pairs(spark, tables)
    # Rows of the components are mixed, as they come from a shuffle.
    pdf = pairs.toPandas().sample(frac=1, random_state=1)
    solved = evaluate._solved(pdf.assign(component=pdf["pose_index"]))
    sums = solved.groupby("pose_index")["iou"].sum().reindex(range(len(tables)), fill_value=0)
    assert np.allclose(sums, [exact(g) for g in tables]) and not solved["box_id_a"].duplicated().any() and not solved["box_id_b"].duplicated().any()
    found = assign_pairs(pairs, ["scene", "pose_index"])
    assert np.allclose(totals(found, len(tables)), [exact(g) for g in tables], atol=1e-9)
    # Grouped by part, not by component.
    assert "FlatMapGroupsInPandas" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "FlatMapGroupsInPandas [component" not in plan
