"""Near copies by shingles against plain Python."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import corpus_pipeline
import numpy as np
from conftest_llm import CLASHES, ODD_ROWS

from skysweep.llm import shingle_dedup


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_kept(rows):
    """One (id, text) of every component, the smallest id, null last."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or both / max(len(sets[i] | sets[j]), 1) >= 0.8:
            parent[root(i)] = root(j)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        best.setdefault(root(i), []).append((doc_id is None, doc_id or 0))
    return Counter(None if none else doc_id for none, doc_id in map(min, best.values()))


def changed(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"x{rng.randrange(10**9)}"
    return words


def test_stage_keeps_one_of_every_similar_group(spark, make_docs, monkeypatch):
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = [(r[0], r[1]) for r in ODD_ROWS]
    # Pairs on either side of the least similarity; far more than two of 64 fingerprint bits differ.
    for i in range(60):
        base = [word() for _ in range(rng.randrange(100, 400))]
        rows += [(100 + 2 * i, " ".join(base)), (101 + 2 * i, " ".join(changed(rng, base, round(len(base) * rng.choice([0.01, 0.02, 0.04])))))]
    # A pile of near copies, and texts that share a passage.
    base, passage = [word() for _ in range(300)], [word() for _ in range(150)]
    rows += [(500 + i, " ".join(changed(rng, base, 2))) for i in range(40)]
    rows += [(600 + i, " ".join([*passage, *(word() for _ in range(60))])) for i in range(40)]
    # Unrelated texts with one id, and one component of null ids.
    rows += [(700, "one text of its own here and now"), (700, "a wholly different sentence with the same number")]
    rows += [(None, " ".join(changed(rng, passage, 1))) for _ in range(3)]
    docs = make_docs(rows, CLASHES)
    want = brute_kept(rows)
    for chosen in (1, 4):
        monkeypatch.setattr(shingle_dedup.shingle_labels, "__defaults__", (0.8, chosen))
        kept = corpus_pipeline.near_dedup(spark, docs, "")
        assert kept.columns == docs.columns
        assert Counter(r.doc_id for r in kept.collect()) == want
    assert want[700] == 2 and shingle_dedup.drop_similar(make_docs([])).count() == 0


def test_similar_sets_share_a_band():
    rng = random.Random(2)
    met = near = 0
    while near < 1500:
        base = [str(rng.randrange(10**6)) for _ in range(200)]
        a, b = " ".join(base), " ".join(changed(rng, base, rng.randrange(2, 6)))
        both = len(shingles(a) & shingles(b))
        if 0.8 <= both / len(shingles(a) | shingles(b)) < 0.9:
            near += 1
            met += bool(set(shingle_dedup.band_keys(shingle_dedup.shingle_set(a))) & set(shingle_dedup.band_keys(shingle_dedup.shingle_set(b))))
    print("recall", met, near)
    assert met >= near - 1


def test_texts_of_one_template_take_few_rounds(spark, make_docs, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(i, " ".join(changed(rng, base, 5))) for i in range(400)]
    rounds = []
    real = shingle_dedup.verified
    monkeypatch.setattr(shingle_dedup, "verified", lambda *a: rounds.append(1) or real(*a))
    kept = shingle_dedup.drop_similar(make_docs(rows))
    assert Counter(r.doc_id for r in kept.collect()) == brute_kept(rows)
    assert len(rounds) <= 6


def test_sketches_of_similar_sets_are_near():
    rng = random.Random(4)
    near = met = far = passed = 0
    while near < 1500 or far < 300:
        base = [str(rng.randrange(10**6)) for _ in range(200)]
        a, b = " ".join(base), " ".join(changed(rng, base, rng.choice([3, 4, 5, 40])))
        both = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        bits = [shingle_dedup.sketch(shingle_dedup.minima(shingle_dedup.shingle_set(t))) for t in (a, b)]
        words = -(-shingle_dedup.BANDS * shingle_dedup.MINIMA // 64)
        planes = (bits[0] ^ bits[1]).view(np.uint64).reshape(shingle_dedup.PLANES, words)
        differ = int(np.bitwise_count(np.bitwise_or.reduce(planes)).sum())
        if both >= 0.8:
            near, met = near + 1, met + (differ <= shingle_dedup.SKETCH_DIFFERS)
        elif both < 0.4:
            far, passed = far + 1, passed + (differ <= shingle_dedup.SKETCH_DIFFERS)
    print("near", met, near, "far", passed, far)
    assert met == near and passed < far / 10


def test_texts_that_only_share_bands_with_a_pile_are_not_compared_with_it(spark, make_docs, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = [(i, " ".join(changed(rng, base, 1 if i < 200 else 5))) for i in range(400)]
    pairs = []
    real = shingle_dedup.verified
    monkeypatch.setattr(shingle_dedup, "verified", lambda p, *a: pairs.append(p.count()) or real(p, *a))
    kept = shingle_dedup.drop_similar(make_docs(rows))
    assert Counter(r.doc_id for r in kept.collect()) == brute_kept(rows)
    assert sum(pairs) < 4000


def test_close_fingerprints_join_copies_before_any_band(spark, make_docs, monkeypatch):
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    # Copies with one change, whose fingerprints are mostly close, and a text of its own.
    rows = [(i, " ".join(changed(rng, base, 1))) for i in range(30)] + [(90, " ".join(f"v{i}" for i in range(50)))]
    found = []
    real = shingle_dedup.shingle_labels
    monkeypatch.setattr(shingle_dedup, "shingle_labels", lambda *a, known: found.append(known.collect()) or real(*a, known=known))
    kept = shingle_dedup.drop_similar(make_docs(rows))
    assert Counter(r.doc_id for r in kept.collect()) == brute_kept(rows) == Counter([0, 90])
    assert len(found) == 1 and len(found[0]) >= 5
