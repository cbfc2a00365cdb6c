"""Exact and near duplicates against plain Python."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import xxhash
from conftest_llm import CLASHES, ODD_ROWS

from skysweep.llm import exact_dedup, near_dedup
from skysweep.llm.near_dedup import Golay


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[lowered(text)].append(i)
    out = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        kept = True
        for i in sorted(ids, key=lambda i: -(i if i is not None else -1)):
            out.append((i, best, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
            kept = False
    return Counter(out)


def test_exact_duplicates_match_plain_python(make_docs):
    rng = random.Random(4)
    rows = [(i, rng.choice(["Hot", "hOT"]) if i % 3 == 0 else f"t{rng.randrange(150)}") for i in range(900)]
    rows += [(r[0], r[1]) for r in ODD_ROWS]
    for counters in (4, 1024):
        found = exact_dedup.exact_duplicates(make_docs(rows, CLASHES), counters=counters)
        assert Counter(map(tuple, found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == brute_exact(rows)


def test_misra_gries_keeps_what_is_frequent():
    rng = random.Random(5)
    stream = [b"hot" if rng.random() < 0.3 else b"%d" % rng.randrange(500) for _ in range(4000)]
    summary = {}
    for start in range(0, len(stream), 333):
        summary = exact_dedup.merge_summary(summary, stream[start : start + 333], 9)
    true = Counter(stream)
    assert len(summary) <= 9
    assert all(true[k] - len(stream) / 10 <= n <= true[k] for k, n in summary.items())
    assert b"hot" in summary


def test_exact_stage_keeps_one_row_of_a_text_and_all_columns(make_docs):
    docs = make_docs(ODD_ROWS, CLASHES)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, lowered(r.text)) for r in kept.collect()) == Counter({(i, t) for i, t in _winners()})


def _winners():
    best = {}
    for i, text, *_ in ODD_ROWS:
        key = lowered(text)
        best[key] = max(best.get(key, -1), -1 if i is None else i)
    return [(i if i >= 0 else None, t) for t, i in best.items()]


def test_empty_tables(make_docs):
    docs = make_docs([])
    assert exact_dedup.exact_duplicates(docs).count() == 0
    assert near_dedup.near_duplicates(docs).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs).count() == 0
    assert near_dedup.drop_near_duplicates(docs).count() == 0


def brute_fingerprint(text):
    words = lowered(text).encode().split()
    if not words:
        return 0
    shingles = [words] if len(words) < 3 else [words[i : i + 3] for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_plain_python():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(0, 40))) for _ in range(200)]
    for text in [*texts, None, "", "One", "É two", "a b c", "  a\tb\x0bc  d "]:
        assert near_dedup.fingerprint(text) == brute_fingerprint(text)
    long = " ".join(str(rng.randrange(50)) for _ in range(2 * near_dedup._BLOCK + 7))
    assert near_dedup.fingerprint(long) == brute_fingerprint(long)


def test_golay_decodes_to_the_nearest_codeword():
    golay = Golay()
    rng = random.Random(7)
    for _ in range(500):
        message = rng.randrange(1 << 12)
        word = message << 11 | int(golay.parity[message])
        for _ in range(rng.randrange(4)):
            word ^= 1 << rng.randrange(23)
        assert golay.decode(np.array([word]))[0] == message
    words = np.array([rng.randrange(1 << 23) for _ in range(500)])
    assert {len(set(row)) for row in golay.nearby(words, 23).tolist()} <= {1, 6}


def brute_components(fps):
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in combinations(fps, 2):
        if bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
            parent[root(a)] = root(b)
    groups = defaultdict(set)
    for f in fps:
        groups[root(f)].add(f)
    return {frozenset(g) for g in groups.values()}


def test_links_give_all_components_for_sparse_and_crowded_keys(spark):
    rng = random.Random(8)
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    fps = set()
    for _ in range(120):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(rng.randrange(4)):
            f ^= 1 << rng.randrange(64)
            f ^= 1 << rng.randrange(64) if rng.random() < 0.6 else 0
            fps.add(f)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(250)}
    fps = sorted(map(signed, fps))
    frame = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(4)
    want = brute_components(fps)
    for compared in (0, 3, 24, 10**6):
        links = [(r.src, r.dst) for r in near_dedup.near_links(frame, compared).collect()]
        parent = {f: f for f in fps}

        def root(f):
            while parent[f] != f:
                f = parent[f]
            return f

        for a, b in links:
            parent[root(a)] = root(b)
        groups = defaultdict(set)
        for f in fps:
            groups[root(f)].add(f)
        assert {frozenset(g) for g in groups.values()} == want


def test_near_duplicates_match_plain_python(make_docs):
    rng = random.Random(9)
    base = [rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(30)) for _ in range(400)]
    rows = [(r[0], r[1]) for r in ODD_ROWS]
    for i in range(10, 60):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(400)] = "other"
        rows.append((i, " ".join(words) if i % 2 else f"single {i}"))
    found = near_dedup.near_duplicates(make_docs(rows, CLASHES)).collect()
    fps = {brute_fingerprint(t) for _, t in rows}
    smallest = {}
    for group in brute_components(sorted(fps)):
        ids = [i for i, t in rows if i is not None and brute_fingerprint(t) in group]
        smallest.update({f: min(ids, default=None) for f in group})
    want = Counter((i, f"{brute_fingerprint(t):016x}", smallest[brute_fingerprint(t)]) for i, t in rows)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == want
    kept = near_dedup.drop_near_duplicates(make_docs(rows, CLASHES))
    assert Counter(r.doc_id for r in kept.collect()) == Counter(set(smallest.values()))
