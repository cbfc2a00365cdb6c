"""Encoding and decoding with a word-end BPE vocabulary, long words by a tree of halves.

A row of tokens is the encoding of its text exactly if every two neighbours are the encoding of their own joined text. So two
encoded halves are joined by encoding a window around the join anew: once its first token is the token of the left half that stood
there and its last that of the right half, all neighbours fit and the tokens outside stay. A side that differs gets a wider window.
Words do not act on each other, so only words longer than a leaf take the tree. Texts above a size are cut into
parts that are encoded by different tasks.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysweep.llm.common import arrow_pass, bound_batches, fresh, stored, with_row
from skysweep.llm.token_counts import SLICE, WordBpe, _byte_letters, slices

#: Symbols of a leaf of the tree.
LEAF = 64
#: Texts of more characters are cut into parts of about this size, which several tasks encode.
SPLIT_OVER = 1 << 22
#: Words whose tokens a task remembers.
REMEMBERED = 1 << 18


class _Memo(dict):
    """Tokens of the words seen so far; a new word is encoded."""

    def __init__(self, encode: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> tuple[int, ...]:
        made = self.encode(word)
        if len(word) <= LEAF:
            self[word] = made
        return made


class TreeBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        # The normaliser and the pattern that cuts texts into words.
        self.cutter = WordBpe(path)
        vocabulary, self.suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        letters = _byte_letters()
        self.plain = [vocabulary[c] for c in letters]
        self.final = [vocabulary[c + self.suffix] for c in letters]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocabulary[a], vocabulary[b]] = (rank, vocabulary[a + b])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.content = dict(zip(vocabulary.values(), vocabulary)) | {i: c for c, i in self.added.items()}
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.known = _Memo(lambda word: tuple(self.encode_word(word.encode())))

    def symbols(self, word: bytes, ends: bool = True) -> list[int]:
        """First symbols of a word, or of a part of one that does not reach its end."""
        made = [self.plain[b] for b in word]
        if ends and word:
            made[-1] = self.final[word[-1]]
        return made

    def spelled(self, token: int) -> list[int]:
        """First symbols of a token."""
        name = self.content[token]
        ends = name.endswith(self.suffix)
        return self.symbols(bytes(self.byte_of[c] for c in (name.removesuffix(self.suffix) if ends else name)), ends)

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the pair of the lowest rank, the leftmost of equals, until none is left."""
        row: list[int | None] = list(symbols)
        n = len(row)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        heap = [(found[0], i, found[1], row[i], row[i + 1]) for i in range(n - 1) if (found := merges.get((row[i], row[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, made, left, right = heapq.heappop(heap)
            j = after[i]
            if row[i] != left or j >= n or row[j] != right:
                continue
            row[i], row[j] = made, None
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                found = merges.get((made, row[j]))
                if found is not None:
                    heapq.heappush(heap, (found[0], i, found[1], made, row[j]))
            h = before[i]
            if h >= 0:
                found = merges.get((row[h], made))
                if found is not None:
                    heapq.heappush(heap, (found[0], h, found[1], row[h], made))
        return [s for s in row if s is not None]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the joined text of two encoded parts of one word."""
        if not left or not right:
            return left + right
        back, on = 1, 1
        while True:
            window = self.merge(list(chain.from_iterable(map(self.spelled, left[-back:] + right[:on]))))
            left_fits = back >= len(left) or window[0] == left[-back]
            right_fits = on >= len(right) or window[-1] == right[on - 1]
            if left_fits and right_fits:
                return left[: max(len(left) - back, 0)] + window + right[on:]
            back, on = (back if left_fits else 2 * back), (on if right_fits else 2 * on)

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """Join neighbours, level by level, up to the root."""
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def encode_word(self, word: bytes, ends: bool = True) -> list[int]:
        row = self.symbols(word, ends)
        if len(row) <= LEAF:
            return self.merge(row)
        # The leaves of a repetitive text are few.
        leaves: dict[tuple[int, ...], list[int]] = {}
        parts = []
        for start in range(0, len(row), LEAF):
            leaf = tuple(row[start : start + LEAF])
            if leaf not in leaves:
                leaves[leaf] = self.merge(list(leaf))
            parts.append(leaves[leaf])
        return self.join_all(parts)

    def pieces(self, text: str) -> Iterator[list[str] | int]:
        """Words of a text in order, in lists, and the ids of added tokens between them."""
        for part in slices(text, SLICE):
            if self.cutter.added is None or "<" not in part:
                yield self.cutter.words(part)
                continue
            start = 0
            for match in self.cutter.added.finditer(part):
                yield self.cutter.words(part[start : match.start()])
                yield self.added[match.group()]
                start = match.end()
            yield self.cutter.words(part[start:])

    def encode(self, text: str | None) -> np.ndarray:
        parts = []
        for piece in self.pieces(text or ""):
            if isinstance(piece, int):
                parts.append(np.array([piece], dtype=np.int32))
                continue
            if len(self.known) > REMEMBERED:
                self.known.clear()
            parts.append(np.fromiter(chain.from_iterable(map(self.known.__getitem__, piece)), dtype=np.int32))
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary has no decoder of its own: the written forms of the tokens, added ones included, joined by blanks."""
        return " ".join(map(self.content.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def load(path: str) -> TreeBpe:
    return TreeBpe(path)


_FIELDS = [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())]


def _cut_texts(long_texts: DataFrame, path: str, size: int) -> DataFrame:
    """Parts of long texts: ``row``, ``part``, ``words`` or the ``added`` token, ``inner`` where the part's only word goes on in the next part."""
    bound_batches(long_texts.sparkSession)
    schema = "row long, part long, words array<binary>, added int, inner boolean"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        types = [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.int32(), pa.bool_()]

        def batch_of(made: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(made, types)], names=["row", "part", "words", "added", "inner"])

        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                number = 0
                for piece in bpe.pieces(text.as_py()):
                    if isinstance(piece, int):
                        yield batch_of((row, number, None, piece, False))
                        number += 1
                        continue
                    held: list[bytes] = []
                    weight = 0
                    for word in map(str.encode, piece):
                        if weight + len(word) > size and held:
                            yield batch_of((row, number, held, None, False))
                            number, held, weight = number + 1, [], 0
                        if len(word) > size:
                            for start in range(0, len(word), size):
                                yield batch_of((row, number, [word[start : start + size]], None, start + size < len(word)))
                                number += 1
                            continue
                        held.append(word)
                        weight += len(word)
                    if held:
                        yield batch_of((row, number, held, None, False))
                        number += 1

    return long_texts.mapInArrow(run, schema)


def _encode_long(texts: DataFrame, path: str, size: int) -> DataFrame:
    """``row``, ``ids`` and ``decoded`` of long texts (``row``, ``text``): parts in parallel, then joined per text."""
    parts = stored(_cut_texts(texts.select("row", "text"), path, size))
    narrow = parts.select("row", "part", "inner", F.struct("words", "added", "inner").alias("piece")).repartition(F.col("row"), F.col("part"))

    def work(batches: Iterator[list]) -> Iterator[Sequence[list]]:
        bpe = load(path)
        for pieces in batches:
            yield [[_part_ids(bpe, p["words"], p["added"], p["inner"]) for p in pieces]]

    encoded = arrow_pass(narrow, ["row", "part", "inner"], "piece", work, [("ids", T.ArrayType(T.IntegerType()))])

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        bpe = load(path)
        rows = rows.sort_values("part")
        found: list[np.ndarray] = []
        word: list[list[int]] = []
        for inner, ids in zip(rows["inner"], rows["ids"]):
            if inner or word:
                word.append(list(map(int, ids)))
            else:
                found.append(np.asarray(ids, dtype=np.int32))
            if word and not inner:
                found.append(np.array(bpe.join_all(word), dtype=np.int32))
                word = []
        ids = np.concatenate(found) if found else np.zeros(0, dtype=np.int32)
        return pd.DataFrame({"row": [rows["row"].iloc[0]], "ids": [ids], "decoded": [bpe.decode(ids.tolist())]})

    # A group is the tokens of one text, which its row of the result holds anyway.
    return encoded.groupBy("row").applyInPandas(joined, "row long, ids array<int>, decoded string")


def _part_ids(bpe: TreeBpe, words: Sequence[bytes] | None, added: int | None, inner: bool) -> list[int]:
    if added is not None:
        return [added]
    if inner:
        return bpe.encode_word(words[0], ends=False)
    return list(chain.from_iterable(bpe.encode_word(w) for w in words))


def encode_documents(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = (), split_over: int = SPLIT_OVER
) -> DataFrame:
    """One row per document: ``doc_id``, ``ids``, ``decoded`` (from the ids) and the ``carry`` columns.

    ``path`` names the vocabulary file on every worker. Added tokens inside a text are found as the library finds them; nothing
    is added, cut or padded. A null text is an empty text: no ids, decoded to an empty text. Repeated rows and ids stay, an
    empty table gives an empty result, other columns do not matter. Texts of more than ``split_over`` characters are cut into
    parts that different tasks encode; the result is the same.
    """
    own = [c for c in carry if c != doc_id]
    text_column, row = fresh(docs.select(doc_id, *own), "__text", "row")
    narrow = docs.select(F.col(doc_id), *own, F.col(text).alias(text_column))
    is_long = F.coalesce(F.length(text_column) > split_over, F.lit(False))

    def work(batches: Iterator[list]) -> Iterator[Sequence[list]]:
        bpe = load(path)
        for texts in batches:
            ids = [bpe.encode(t) for t in texts]
            yield ids, [bpe.decode(i.tolist()) for i in ids]
        # The worker lives on after the task; what it remembers must not.
        bpe.known.clear()

    short = arrow_pass(narrow.filter(~is_long), [doc_id, *own], text_column, work, _FIELDS)
    numbered = stored(with_row(narrow.filter(is_long), row))
    if numbered.isEmpty():
        return short
    made = _encode_long(numbered.select(F.col(row).alias("row"), F.col(text_column).alias("text")), path, split_over)
    made = made.withColumnRenamed("row", row)
    # A text without words has no parts.
    known = numbered.drop(text_column).join(made, row, "left").drop(row)
    nothing = {"ids": F.coalesce("ids", F.array().cast("array<int>")), "decoded": F.coalesce("decoded", F.lit(""))}
    return short.unionByName(known.withColumns(nothing))
