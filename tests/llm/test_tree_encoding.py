"""Tokens by a tree of halves against the public library."""

from __future__ import annotations

import random
from collections import Counter

import public_tokenizers
import pytest
from conftest_llm import CLASHES, ODD_ROWS
from test_tokens import texts

from skysweep.llm import tree_encoding
from skysweep.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def long_words():
    rng = random.Random(7)
    made = ["x" * 20_001, "ab" * 777 + "<|endoftext|>" + "é" * 999 + "!" * 1001, "thisisaverylongword" * 300, "^_^-=" * 500, "你好" * 800 + "'ll"]
    return made + ["".join(rng.choice(letters) for _ in range(rng.randrange(60, 3000))) for letters in ("abcdefgeinthstrou", "aab", "éeè", ".,;-=", "xy") for _ in range(20)]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_encodes_and_decodes_as_the_library(tokenizer, monkeypatch):
    given = [*texts(11, 2000), "", None, *long_words()]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in given]
    for leaf in (64, 2, 5):
        monkeypatch.setattr(tree_encoding, "LEAF", leaf)
        bpe = tree_encoding.TreeBpe(PATH)
        found = [bpe.encode(t).tolist() for t in given]
        assert found == want
    assert [bpe.decode(f) for f in found] == [tokenizer.decode(w, skip_special_tokens=False) for w in want]


def test_any_cut_joins_exactly():
    bpe = tree_encoding.TreeBpe(PATH)
    rng = random.Random(8)
    for word in long_words():
        raw = word[:400].encode()
        whole = bpe.merge(bpe.symbols(raw))
        for cut in rng.sample(range(1, len(raw)), 5):
            assert bpe.join(bpe.merge(bpe.symbols(raw[:cut], ends=False)), bpe.merge(bpe.symbols(raw[cut:]))) == whole


@pytest.mark.parametrize("split_over", [1 << 22, 500])
def test_documents_equal_the_library(make_docs, tokenizer, split_over):
    rows = [(r[0], r[1]) for r in ODD_ROWS] + [(100 + i, t) for i, t in enumerate(long_words())]
    rows += [(300, "<|startoftext|>" * 300), (301, " " * 2000), (302, ("word " * 90 + "z" * 700 + "<|endoftext|>") * 3)]
    found = tree_encoding.encode_documents(make_docs(rows, [*CLASHES, "ids", "decoded", "part"]), PATH, split_over=split_over).collect()

    def want(text):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        return tuple(ids), tokenizer.decode(ids, skip_special_tokens=False)

    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in found) == Counter((i, *want(t)) for i, t in rows)
    assert tree_encoding.encode_documents(make_docs([]), PATH, split_over=split_over).count() == 0


def test_query_has_the_digests(spark, tokenizer):
    import hashlib

    folder = "/root/testdata/sf0.001"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = tokenizer.encode(row.text or "", add_special_tokens=False).ids
        want[row.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, QUERIES["op12_tree_encoding"](spark, folder).collect())) == want
