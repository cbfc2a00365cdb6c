"""Toxicity, personal data, urls and search against plain Python, and the pipeline as a whole."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import CLASHES, ODD_ROWS

from skysweep.checks.compare import connect, difference
from skysweep.llm import metric_search, private_data, toxicity, url_filter
from skysweep.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
#: The smallest tables have too few labels for a lexicon.
LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_sql(spark, key):
    assert difference(QUERIES[key](spark, FOLDER).toPandas(), connect(FOLDER).execute(SQL[key]).fetchdf()) is None


# --- personal data -----------------------------------------------------------------------------------------------


def brute_spans(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c not in " -"][::-1]
        if 16 <= len(digits) <= 19 and sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


PARTS = ["a", "b.c", "@", "@x.y", "1", "12", "255", "256", ".", "1.2.3.4", "001.02.3.4", "4041894974608795", "4041 8949 7460 8795", "-", " ", "+", "+1 (456) 555-2186", "(", "foo@bar.com", "é", "\n", "%", "9" * 7]


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(3)
    for _ in range(6000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(25)))
        assert private_data.base_spans(text) == brute_spans(text)


def brute_marginals(doc, potentials):
    n, size = len(doc.spans), len(private_data.LABELS)
    unary = np.array([potentials.shapes.get(s, potentials.unseen) for s in doc.shapes])
    unary[doc.open_left] += potentials.chain[0]
    unary[doc.open_right] += potentials.chain[:, 0]
    total = np.zeros((n, size))
    for labels in itertools.product(range(size), repeat=n):
        if any(k and labels[i] != k for i, k in enumerate(doc.labels.tolist())):
            continue
        score = sum(unary[i, k] for i, k in enumerate(labels) if not doc.labels[i])
        score += sum(potentials.chain[labels[a], labels[b]] for a, b in doc.chain) + sum(potentials.skip[labels[a], labels[b]] for a, b in doc.skip)
        for i, k in enumerate(labels):
            total[i, k] += math.exp(score)
    return total / total.sum(axis=1, keepdims=True)


def potentials():
    train = ["Call +1 (456) 555-2186 now", "card 4041894974608795 here", "see 1.2.3.4 and 17 or 2.0. then 300", "write foo@bar.com please", "x1 y2 12345678"] * 5
    counts = Counter()
    for text in [*train, "twice +1 (456) 555-2186 and +1 (456) 555-2186 end"]:
        counts.update(private_data.observed(private_data.parse(text)))
    return private_data.fit(counts)


def test_messages_are_exact_without_loops_and_close_with_them():
    fitted = potentials()
    tree = private_data.parse("at 555-2186 then +1 (456) 555-2186 end 77 or x9")
    assert np.allclose(private_data.marginals(tree, fitted, rounds=200), brute_marginals(tree, fitted), atol=1e-3)
    loop = private_data.parse("9876 555-2186 and 9876 555-2186 and 98765 123456 q 98765 123456")
    assert len(loop.skip) > 1
    found, want = private_data.marginals(loop, fitted, rounds=200), brute_marginals(loop, fitted)
    assert (found.argmax(axis=1) == want.argmax(axis=1)).all() and np.abs(found - want).max() < 0.2


def test_messages_settle_however_long_the_chain():
    fitted = potentials()
    text = "Call +1 (456) 555-2186 now. " + " and then ".join(["(456) 555-2186 q 98765 123456"] * 60)
    doc = private_data.parse(text)
    assert private_data._longest(np.concatenate([doc.chain, doc.skip]), len(doc.spans)) > 100
    settled = private_data.marginals(doc, fitted)
    # Patience without end changes nothing: the messages had come to rest.
    assert np.allclose(settled, private_data.marginals(doc, fitted, rounds=100_000), atol=1e-6)
    assert np.allclose(settled, private_data.marginals(doc, fitted, rounds=1), atol=0.02)


def test_repeats_of_a_mention_are_found_far_away():
    text = "Call +1 (456) 555-2186 now. " + "filler words " * 300 + "then (456) 555-2186 again"
    doc = private_data.parse(text)
    added = private_data.added_spans(doc, potentials())
    assert any("555-2186" in text[a:b] and k == 3 for k, a, b in added)


def test_private_data_query_takes_odd_rows(make_docs):
    rows = [(r[0], r[1]) for r in ODD_ROWS] + [(20, "é foo@bar.com 1.2.3.4 +1 (456) 555-2186"), (21, "4041894974608795")]
    for r in private_data.find_private_data(make_docs(rows, CLASHES)).collect():
        base = brute_spans(dict(rows)[r.doc_id] or "") if r.doc_id != 3 else []
        names = [f"{private_data.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert set(names) <= set(r.spans.split(",")) | ({""} if not names else set())
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in base) for i in range(4)]
    assert private_data.find_private_data(make_docs([])).count() == 0


# --- toxicity ----------------------------------------------------------------------------------------------------


def toxic_corpus(n=700):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(10, 120))]
        toxic = int(i % 4 == 0)
        for _ in range(rng.randrange(2, 5) * toxic):
            text[rng.randrange(len(text))] = rng.choice(["zorgon", "zorgish", "wuxling", "Zorgon!"])
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    return rows, labels


def test_toxicity_holds_on_unseen_documents(spark, make_docs):
    rows, labels = toxic_corpus()
    frame = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    found = toxicity.score_toxicity(make_docs([*rows, *[(r[0], r[1]) for r in ODD_ROWS]], CLASHES), frame).collect()
    truth = dict(labels)
    assert len(found) == len(rows) + len(ODD_ROWS)
    for r in found:
        assert 0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in found if r.held_out and r.doc_id > 8]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    kept = toxicity.drop_toxic(make_docs(rows, CLASHES), frame)
    assert kept.columns == make_docs([], CLASHES).columns
    assert abs(kept.count() - 525) < 15


def test_toxicity_without_labels_of_both_kinds(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_toxicity(make_docs(ODD_ROWS), none).collect()} == {0.0}
    assert toxicity.score_toxicity(make_docs([]), none).count() == 0


def test_reader_sees_through_masks_and_distance():
    reader = toxicity.Reader({"idiot": 5.0, "zorg-": 3.0})
    value = lambda text: dict(zip(toxicity.FEATURES, reader.features(text)))
    assert value("you 1d10t")["hidden_hits"] > 0 and value("you id-iot")["hidden_hits"] > 0
    assert value("a zorgish b")["best_weight"] == 3.0
    assert value("you idiot")["closest_second_person"] == 1.0 and value("idiot")["closest_second_person"] == 0.0
    assert value("x " * 20 + "idiot")["near_second_person"] == 0.0
    assert value("SHOUT now!")["capital_words"] == 0.5
    assert value(None) == value("") == dict.fromkeys(toxicity.FEATURES, 0.0)


# --- urls --------------------------------------------------------------------------------------------------------


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_urls_are_parsed_and_ruled(spark):
    urls = [None, "", "nothing", "http://", "http://A.Example.COM/en/x", "https://www.example.com/en/", "ftp://x.net/es/1#a", "x://net/fr/?q", "http://anet/fr/", "http://com", "http://com/", "a://b://c/d?e", "http://x.org?u=/net/es/", "http://É.com/\n/x", "http://x.net/es"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, urls[4], "y"), (4, urls[4], "y")], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(1, True), (1, False), (None, True), (2, None)], "page_id long, bad boolean")
    found = url_filter.judge_urls(pages, outcomes).collect()
    assert len(found) == len(urls) + 2
    for r in found:
        if r.page_id is None:
            continue
        host, path = brute_parts(urls[r.page_id])
        fits = [(v, t) for v, t in url_filter.RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith(t[t.index("/") :])]
        best = max(fits, key=lambda x: len(x[1]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, best[1])
        assert r.verdict == best[0] if best[0] else r.verdict in ("allow", "block")
    assert url_filter.judge_urls(pages.limit(0), outcomes).count() == 0


def test_bad_hosts_are_blocked_and_small_ones_shrunk(spark):
    pages = [(i, f"http://bad.evil.io/{i}") for i in range(200)] + [(200 + i, f"http://good.fine.io/{i}") for i in range(200)]
    pages += [(400, "http://new.evil.io/"), (401, "http://new.fine.io/"), (402, "http://lone.org/")] + [(500 + i, f"http://h{i}.fine.io/") for i in range(30)]
    outcomes = [(i, i < 195 or i == 402) for i in range(403) if i not in (400, 401)] + [(500 + i, False) for i in range(30)]
    found = url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad boolean"))
    verdict = {r.page_id: r.verdict for r in found.collect()}
    assert verdict[0] == "block" and verdict[300] == "allow" and verdict[401] == "allow"
    # One bad page of an unknown host is no proof.
    assert verdict[402] == "allow"


# --- search ------------------------------------------------------------------------------------------------------


def brute_top(rows, k):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return Counter(out)


def test_search_is_exact_for_clusters_ties_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] * (1 + i % 3) + rng.normal(size=8) * 0.05]) for i in range(700)]
    rows += [(1000 + i, [0.5] * 8) for i in range(90)]
    rows += [(2000, None), (2020, []), (2040, [None] * 8), (2060, [float("nan")] * 8), (2080, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (2100, [0.0] * 8), (2120, [1e7, -1e7] * 4)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, row string").repartition(3)
    for pivots, block, together in ((1, 4096, 512), (7, 40, 5)):
        monkeypatch.setattr(metric_search, "PER_PIVOT", 10**6 if pivots == 1 else 100)
        monkeypatch.setattr(metric_search, "BLOCK", block)
        monkeypatch.setattr(metric_search, "TOGETHER", together)
        assert Counter(map(tuple, metric_search.top_products(frame, k=7).collect())) == brute_top(rows, 7)
    assert metric_search.top_products(frame.limit(0)).count() == 0
    few = frame.filter("vec_id in (0, 1, 2)")
    assert Counter(map(tuple, metric_search.top_products(few).collect())) == brute_top(rows[:3], 20)


def test_search_leaves_pages_unopened(monkeypatch):
    rng = np.random.default_rng(6)
    x = np.floor(np.repeat(rng.normal(size=(40, 16)) * 64, 50, axis=0) + rng.normal(size=(2000, 16)))
    most = float((x * x).sum(axis=1).max())
    monkeypatch.setattr(metric_search, "PAGE", 48)
    tree = metric_search.build_tree(np.arange(2000), x, most)
    computed = 0
    true_products = metric_search.products

    def counted(q, some):
        nonlocal computed
        computed += len(q) * len(some)
        return true_products(q, some)

    monkeypatch.setattr(metric_search, "products", counted)
    scores, _ = metric_search.search(tree, np.arange(0, 2000, 20), x[::20], np.full(100, -np.inf), 20)
    want = x[::20] @ x.T
    want[np.arange(100), np.arange(0, 2000, 20)] = -1e15
    assert (scores == -np.sort(-want, axis=1)[:, :20]).all()
    assert computed < 0.6 * 100 * 2000


# --- the pipeline ------------------------------------------------------------------------------------------------


def test_pipeline_takes_its_decisions(spark, tmp_path):
    import corpus_pipeline

    from skysweep.llm.common import written

    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    columns = docs.columns
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, LARGER), str(tmp_path / name))
        sizes[name] = docs.count()
        if name != "encode":
            assert docs.columns == columns
            assert docs.exceptAll(before).select("doc_id").distinct().join(before, "doc_id", "left_anti").count() == 0
    texts = [r.text.encode().lower() for r in before.collect()]
    assert all(n <= 3 for n in Counter(texts).values())
    assert docs.filter("not lossless").count() == 0 and sizes["encode"] == sizes["mix"]
    assert sizes["exact_dedup"] < sizes["toxicity"] < spark.read.parquet(f"{LARGER}/documents.parquet").count()


def test_pipeline_takes_clashing_columns_odd_rows_and_nothing(spark, make_docs, tmp_path):
    import corpus_pipeline

    from skysweep.llm.common import written

    clashes = [*CLASHES, "copy_number", "label", "component"]
    for part, rows in (("odd", [(r[0], r[1]) for r in ODD_ROWS]), ("none", [])):
        docs = make_docs(rows, clashes)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, LARGER), str(tmp_path / f"{part}-{name}"))
            assert name == "encode" or docs.columns == columns
        assert (docs.count() > 0) == bool(rows) and docs.filter("not lossless").count() == 0
