"""Importance resampling against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from conftest_llm import CLASHES, ODD_ROWS

from skysweep.llm import resampling
from skysweep.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def features(text, buckets):
    found = words(text)
    return [crc32(" ".join(found[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(found) - n + 1)]


def brute(docs, target, buckets=10_000, share=5, least=20):
    """Rows without the rank, and the ranks by (score, id)."""
    raw, wanted = Counter(), Counter()
    for _, text in docs:
        raw.update(features(text, buckets))
    for text in target:
        wanted.update(features(text, buckets))
    s_all, t_all = sum(raw.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets))))
    rows = []
    for doc_id, text in docs:
        found = features(text, buckets)
        weight = sum(map(gain, found))
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(found), weight, score, len(words(text)) >= least))
    enough = sorted((-r[3], r[0] is not None, r[0] or 0, r[2]) for r in rows if r[4])
    drawn = enough[: share * len(enough) // 100]
    return Counter(r[:4] for r in rows), [(d[2] if d[1] else None, -d[0]) for d in drawn]


def check(found, docs, target, **settings):
    rows, drawn = brute(docs, target, **settings)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in found) == rows
    ranks = sorted((r.rank, r.doc_id, r.score) for r in found if r.rank is not None)
    assert [(i, s) for _, i, s in ranks] == drawn
    assert [r for r, _, _ in ranks] == list(range(1, len(drawn) + 1))


def test_query_equals_plain_python(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    result = QUERIES["op11_importance_resampling"](spark, folder)
    assert all(t == "bigint" for _, t in result.dtypes)
    check(result.collect(), docs, target)


@pytest.mark.parametrize("size", [1 << 20, 7])
def test_odd_rows(spark, make_docs, monkeypatch, size):
    monkeypatch.setattr(resampling, "SLICE", size)
    rng = random.Random(1)
    rows = [(r[0], r[1]) for r in ODD_ROWS]
    rows += [(20 + i, " ".join(rng.choice(["A", "b", "é9", "x.y", "\0", "Zz"]) for _ in range(rng.randrange(80)))) for i in range(200)]
    rows += [(500, "same old words " * 10)] * 7 + [(501, "same old words " * 10)]
    goals = ["a b é9 zz", None, "", "same old words"]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(goals)], "item_id long, text string")
    docs = make_docs(rows, [*CLASHES, "rank", "weight", "n"])
    settings = {"buckets": 50, "share": 40, "least_words": 3}
    found = resampling.resample(docs, target, **settings).collect()
    check(found, rows, goals, buckets=50, share=40, least=3)
    drawn = resampling.drawn_documents(docs, target, **settings)
    assert drawn.columns == docs.columns
    assert Counter(r.doc_id for r in drawn.collect()) == Counter(r.doc_id for r in found if r.rank)
    check(resampling.resample(docs, target.limit(0)).collect(), rows, [])
    assert resampling.resample(make_docs([]), target).count() == 0


def test_slices_of_a_text(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice("abc  .9é") for _ in range(5000))
    for size in (1, 10, 1000):
        monkeypatch.setattr(resampling, "SLICE", size)
        parts = list(resampling.run_buckets(text.encode(), 97))
        assert sum(n for n, _ in parts) == len(words(text))
        assert sorted(b for _, p in parts for b in p) == sorted(features(text, 97))
