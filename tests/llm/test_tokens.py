"""Token counts and pieces against the public libraries."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter

import public_tokenizers
import pytest
from conftest_llm import CLASHES, ODD_ROWS

from skysweep.llm import piece_dropout, token_counts

PARTS = ["a", "b", "th", "e", "r", "'", "'s", "'ll", " ", "  ", "\n", "\t", "1", "23", "é", "É", "ß", "İ", "Σ", "你", "好", "\u0301", "😀", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<|", "!", "...", "A", "LL", "\0", "ﬁ", "Å", "½", "aaaa", "the ", "ing"]
COUNTS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def texts(seed, n, parts=PARTS):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(45))) for _ in range(n)]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(COUNTS)


def test_counts_equal_the_library(tokenizer, monkeypatch):
    bpe = token_counts.WordBpe(COUNTS)
    given = [*texts(1, 3000), "", None, "a" * 5000, "word " * 3000]
    want = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in given]
    assert bpe.counts(given) == want
    monkeypatch.setattr(token_counts, "SLICE", 16)
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    assert token_counts.WordBpe(COUNTS).counts(given) == want


def test_count_query_takes_odd_rows(make_docs, tokenizer):
    rows = [(r[0], r[1]) for r in ODD_ROWS]
    found = token_counts.token_counts(make_docs(rows, CLASHES), COUNTS, limit=10).collect()
    count = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    assert Counter(map(tuple, found)) == Counter((i, len((t or "").encode()), count(t), count(t) > 10) for i, t in rows)
    assert token_counts.token_counts(make_docs([]), COUNTS).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return piece_dropout.PieceModel(PIECES)


def test_pieces_without_dropout_are_the_models_own(pieces):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    given = [*texts(2, 2000), "x" * 3000]
    assert pieces.encode_texts(given, [1] * len(given), 0.0) == [own.encode(t) for t in given]


def test_dropout_is_lossless_seeded_and_varied(pieces):
    given = [*texts(3, 1500, [*PARTS, "▁", "hello world "]), " ", "  a", "▁", "y" * 2000]
    first = pieces.encode_texts(given, [5] * len(given), 0.3)
    assert [pieces.decode(p) for p in first] == given
    assert piece_dropout.PieceModel(PIECES).encode_texts(given, [5] * len(given), 0.3) == first
    assert pieces.encode_texts(given, [6] * len(given), 0.3) != first
    assert sum(map(len, first)) > sum(map(len, pieces.encode_texts(given, [5] * len(given), 0.0)))
    # Everything is passed over: single letters remain.
    assert pieces.encode_chunks([" hello"], 5, 1.1) == [tuple(pieces.ids[c] for c in " hello")]


def test_both_agendas_agree(pieces):
    chunks = [c for t in texts(4, 1500) for c in pieces.chunk.findall(" " + t)]
    assert pieces.encode_chunks(chunks, 9, 0.3) == [pieces.encode_long(c, 9, 0.3) for c in chunks]


def plain_run(pieces, chunk, dropped):
    """Pieces by the words of the method: the best candidate not passed over is merged, until there is none."""
    row = [(i, i + 1) for i in range(len(chunk))]
    while True:
        offers = []
        for (a, b), (_, c) in zip(row, row[1:]):
            piece = pieces.ids.get(chunk[a:c])
            parts = (pieces.ids.get(chunk[a:b]), pieces.ids.get(chunk[b:c]))
            if piece is not None and None not in parts and not dropped(a, b, c):
                offers.append((pieces.order[piece], a, b, c))
        if not offers:
            break
        _, a, b, c = min(offers)
        at = row.index((a, b))
        row[at : at + 2] = [(a, c)]
    made = []
    for a, b in row:
        text = chunk[a:b]
        made += [pieces.ids[text]] if text in pieces.ids else [pieces.bytes[x] for x in text.encode()]
    return tuple(made)


def test_remembered_runs_equal_the_agenda(pieces, monkeypatch):
    import numpy as np

    rng = random.Random(6)
    words = [c for t in texts(7, 400, [*PARTS, "hello", " international", "tion", " of the "]) for c in pieces.chunk.findall(" " + t)]
    chunks = [rng.choice(words) for _ in range(10_000)] + ["ab" * 200, "international " * 9, "x" * 200]
    keys = np.array([rng.getrandbits(64) for _ in chunks], dtype=np.uint64)

    def rows(runs, start=0, stop=len(chunks)):
        sizes, flat = runs.encode(chunks[start:stop], keys[start:stop], dropout)
        return [tuple(r.tolist()) for r in np.split(flat, np.cumsum(sizes)[:-1])]

    for dropout in (0.1, 0.5):
        want = [pieces.encode_long(c, int(k), dropout) for c, k in zip(chunks, keys)]
        assert rows(piece_dropout.Runs(pieces)) == want == pieces.encode_chunks(chunks, keys, dropout)
        few = piece_dropout.Runs(pieces)
        monkeypatch.setattr(piece_dropout, "REMEMBERED", 100)
        monkeypatch.setattr(piece_dropout, "WIDEST", 3)
        assert [r for i in range(0, len(chunks), 700) for r in rows(few, i, i + 700)] == want
        monkeypatch.undo()
        for chunk, key, row in list(zip(chunks, keys, want))[:1500]:
            draw = lambda a, b, c: bool(pieces.dropped(np.array([key]), *(np.array([v]) for v in (a, b, c)), dropout)[0])
            assert plain_run(pieces, chunk, draw) == row


def test_slices_change_nothing(pieces, monkeypatch):
    given = texts(5, 300)
    want = pieces.encode_texts(given, [2] * len(given), 0.2)
    monkeypatch.setattr(piece_dropout, "SLICE", 8)
    assert piece_dropout.PieceModel(PIECES).encode_texts(given, [2] * len(given), 0.2) == want


def test_a_worker_remembers_little(pieces):
    """Words that hardly ever come again: what a task holds stays small."""
    rng = random.Random(12)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(3_000)) for _ in range(80)]
    pieces.runs.clear()
    tracemalloc.start()
    pieces.encode_arrays(texts, list(range(len(texts))), 0.1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pieces.runs.clear()
    assert peak < 90e6


def test_piece_query_takes_odd_rows(make_docs):
    rows = [(r[0], r[1]) for r in ODD_ROWS]
    found = piece_dropout.encode_documents(make_docs(rows, CLASHES), PIECES).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in rows)
    assert all(r.lossless and r.n_pieces == len(r.pieces) for r in found)
    assert piece_dropout.encode_documents(make_docs([]), PIECES).count() == 0


def test_every_occurrence_and_copy_draws_anew(pieces, make_docs):
    from pyspark.sql import functions as F

    word = " international"
    chunk = [tuple(pieces.encode_chunks([word], key, 0.1)[0]) for key in range(200)]
    assert len(set(chunk)) > 4
    # One text: the same word is not cut the same way everywhere.
    (row,) = pieces.encode_texts([word[1:] + word * 399], [5], 0.1)
    cut, part = Counter(), []
    for p in row:
        if pieces.content[p].startswith(b" ") and part:
            cut[tuple(part)] += 1
            part = []
        part.append(p)
    assert len(cut) > 4
    docs = make_docs([(1, "the international community " * 40)]).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    found = piece_dropout.encode_documents(docs, PIECES, copy="n").collect()
    assert len({tuple(r.pieces) for r in found}) == 3 and all(r.lossless for r in found)
