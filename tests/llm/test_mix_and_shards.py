"""Source mixing and sharding against plain Python."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from conftest_llm import CLASHES, ODD_ROWS

from skysweep.llm import mixing, sharding


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, free, budget = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if budget * weight[s] / total > 3 * sizes[s]}
        if not above:
            return target | {s: budget * weight[s] / total for s in free}
        target |= {s: 3.0 * sizes[s] for s in above}
        budget -= sum(target[s] for s in above)
        free -= above
    return target


def mixed(frame):
    return frame.select("doc_id", "size", "source_size", "target", "taken", "copies").collect()


def test_mix_meets_targets_and_repeats_itself(make_docs):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 5, 5, rng.randrange(60)])), rng.choice(["a", "a", "a", "b", "é", "z", None])) for i in range(2000)]
    rows += ODD_ROWS
    frame = make_docs(rows, CLASHES)
    found = mixed(mixing.mix_sources(frame))
    assert Counter(found) == Counter(mixed(mixing.mix_sources(frame.repartition(5))))
    size = lambda t: len([w for w in (t or "").encode().split()])
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size(text)
    targets = brute_targets(sizes)
    assert Counter((r.doc_id, r.size) for r in found) == Counter((i, size(t)) for i, t, _ in rows)
    by_target = defaultdict(int)
    for r in found:
        by_target[round(r.target, 6), r.source_size] += r.taken
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
    for source, target in targets.items():
        # The long text of this source does not fit; everything else is taken three times.
        most = 3 * (sizes[source] - 30_000) if source == "b" else target
        assert abs(by_target[round(target, 6), sizes[source]] - min(target, most)) <= 1
    chosen = Counter(r.doc_id for r in mixing.mixed_documents(frame).collect())
    assert chosen == Counter({i: n for i, n in _copies(found).items() if n})


def _copies(found):
    copies = Counter()
    for r in found:
        copies[r.doc_id] += r.copies
    return copies


def test_large_groups_of_equal_length_are_cut_by_hash(make_docs, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED_ROWS", 16)
    rows = [(i, "one two", "ab"[i % 8 == 0]) for i in range(2000)]
    found = mixed(mixing.mix_sources(make_docs(rows)))
    taken = Counter()
    for r in found:
        taken[r.target] += r.taken
    assert all(abs(t - n) <= 2 for t, n in taken.items()) and len(taken) == 2


def test_bounded_subset_is_the_best_possible():
    rng = random.Random(2)
    for _ in range(60):
        lengths = np.array(rng.sample(range(1, 15), 4))
        counts = np.array([rng.randrange(4) for _ in range(4)])
        budget = rng.randrange(60)
        sums = {0}
        for length, n in zip(lengths.tolist(), counts.tolist()):
            sums = {s + k * length for s in sums for k in range(n + 1)}
        taken, best = mixing.bounded_subset(lengths, counts, budget)
        assert best == max(s for s in sums if s <= budget) == int((taken * lengths).sum())
        assert (taken <= counts).all()


def test_budgets_are_met_whatever_the_lengths():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        lengths = np.sort(rng.choice(2000, n, replace=False))
        counts = rng.integers(1, 40, n)
        words = int((lengths * counts).sum())
        target = float(rng.uniform(0, 3) * words)
        copies, extra = mixing.fit_budget(lengths, counts, target, fitted=int(rng.choice([10, 500, 20_000])))
        assert ((0 <= extra) & (copies * counts + extra <= 3 * counts)).all()
        taken = int((lengths * (copies * counts + extra)).sum())
        assert taken <= target + 1
        # Never a document that would still fit is left out.
        free = (copies * counts + extra < 3 * counts) & (lengths > 0)
        assert target - taken <= lengths[free].min(initial=10**9) + 1


def test_a_budget_is_passed_if_that_is_nearer(make_docs):
    one = lambda target: mixing.fit_budget(np.array([100]), np.array([1]), target, over=True)
    assert [c + int(e[0]) for c, e in map(one, (40, 95, 149, 160, 290))] == [0, 1, 1, 2, 3]
    lengths, counts = np.array([7, 10]), np.array([1, 1])
    copies, extra = mixing.fit_budget(lengths, counts, 9.0, over=True)
    assert int((lengths * (copies * counts + extra)).sum()) == 10
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 6))
        lengths = np.sort(rng.choice(300, n, replace=False))
        counts = rng.integers(1, 4, n)
        target = float(rng.uniform(0, 3) * (lengths * counts).sum())
        gap = []
        for over in (False, True):
            copies, extra = mixing.fit_budget(lengths, counts, target, over=over)
            assert ((0 <= extra) & (copies * counts + extra <= 3 * counts)).all()
            gap.append(abs(int((lengths * (copies * counts + extra)).sum()) - target))
        assert gap[1] <= gap[0] + 1
    # The only text of a source does not vanish.
    rows = [(1, "w " * 100, "a"), *((i, "w " * 2, "b") for i in range(2, 22)), (30, "w " * 20, "c")]
    found = {r.doc_id: r for r in mixed(mixing.mix_sources(make_docs(rows)))}
    assert all(abs(found[i].taken - found[i].target) <= found[i].size / 2 for i in (1, 30))


def test_shards_are_lawful(make_docs):
    rows = [(i, f"text {i}") for i in range(100, 4100)] + [(r[0], r[1]) for r in ODD_ROWS]
    found = sharding.assign_shards(make_docs(rows, CLASHES)).collect()
    text = {i: t for i, t in rows}
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in rows)
    slots, placed = defaultdict(list), defaultdict(set)
    for r in found:
        slots[r.shard].append(r.slot)
        placed[r.doc_id].add((r.shard, r.grown_shard))
        assert r.law == "key" and r.grown_shard in (r.shard, 8)
        if r.doc_id != 3:
            assert (r.size, r.text_crc32) == (len((text[r.doc_id] or "").encode()) + 1, zlib.crc32((text[r.doc_id] or "").encode()))
    assert all(len(p) == 1 for p in placed.values())
    assert sorted(slots) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) < 1.3 * min(map(len, slots.values()))
    assert 0.07 < sum(r.grown_shard == 8 for r in found) / len(found) < 0.16


def test_heavier_racks_take_rows_only_into_their_region(spark):
    from pyspark.sql import functions as F

    tree = sharding.topology()
    heavy = [[dict(rack) for rack in racks] for racks in tree]
    heavy[1][0][4] = 3.0
    pairs = spark.range(5000).select(sharding.descend(F.col("id"), tree).alias("a"), sharding.descend(F.col("id"), heavy).alias("b")).collect()
    moved = [(r.a, r.b) for r in pairs if r.a != r.b]
    assert moved and all(b >= 4 for _, b in moved)
    # Inside the region only the changed rack gains.
    assert all(b in (4, 5) for a, b in moved if a >= 4)


def test_empty_tables(make_docs):
    assert mixing.mix_sources(make_docs([])).count() == 0
    assert mixing.mixed_documents(make_docs([])).count() == 0
    assert sharding.assign_shards(make_docs([])).count() == 0
