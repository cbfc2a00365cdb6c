"""Token counts of a word-end BPE vocabulary by rank-synchronous merging of ragged numpy arrays."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysweep.llm.common import arrow_pass

LIMIT = 2048
#: Characters of text whose words are held at a time.
SLICE = 1 << 20
#: Words whose counts a task remembers.
REMEMBERED = 1 << 19
#: The white space of the vocabulary's pattern, and the pattern over normalised text.
WHITE = "\t-\r \x85\xa0  -     　"
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
#: Outside these characters the library's own normaliser runs; inside, normal form C changes nothing.
_UNUSUAL = re.compile("[^\0-ɏ‐-‧€]")
_NEVER = np.iinfo(np.int64).max


class WordBpe:
    """Counts the symbols that are left of a word when no more merges apply."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.normalizer = Tokenizer.from_file(path).normalizer
        vocabulary, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        letters = _byte_letters()
        self.plain = np.array([vocabulary[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocabulary[c + suffix] for c in letters], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.width = len(vocabulary)
        keys = np.array([vocabulary[a] * self.width + vocabulary[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        self.known: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def symbols(self, words: Sequence[bytes]) -> np.ndarray:
        """Surviving symbols of every word (none empty).

        All words lie in one array. In a round every word looks for its lowest rank and merges all places that have it, from
        the left; words without a merge leave with their length.
        """
        counts = np.zeros(len(words), dtype=np.int64)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols, ends = self.plain[raw], np.cumsum(sizes)
        symbols[ends - 1] = self.final[raw[ends - 1]]
        names = np.arange(len(words))
        last = np.zeros(len(symbols), dtype=bool)
        last[ends - 1] = True
        ranks = np.full(len(symbols), _NEVER)
        if len(symbols) > 1:
            ranks[:-1] = self.rank(symbols[:-1], symbols[1:])
        ranks[last] = _NEVER
        while len(names):
            ends = np.flatnonzero(last)
            starts = np.concatenate([[0], ends[:-1] + 1])
            sizes = ends - starts + 1
            lowest = np.minimum.reduceat(ranks, starts)
            live = lowest != _NEVER
            if not live.all():
                counts[names[~live]] = sizes[~live]
                stay = np.repeat(live, sizes)
                symbols, last, ranks = symbols[stay], last[stay], ranks[stay]
                names, sizes, lowest = names[live], sizes[live], lowest[live]
                if not len(names):
                    break
            hit = ranks == np.repeat(lowest, sizes)
            # In a run such as aaaa the places overlap: every second one counts, from the left.
            places = np.flatnonzero(hit)
            new_run = np.concatenate([[True], np.diff(places) > 1])
            if not new_run.all():
                offset = np.arange(len(places)) - np.maximum.accumulate(np.where(new_run, np.arange(len(places)), 0))
                places = places[offset % 2 == 0]
            symbols[places] = self.merged[ranks[places]]
            last[places] = last[places + 1]
            keep = np.ones(len(symbols), dtype=bool)
            keep[places + 1] = False
            ranks[places] = -1
            before = places[places > 0] - 1
            # The symbol before may have been merged into its own left neighbour.
            before = np.where(keep[before], before, before - 1)
            ranks[before] = np.where(last[before], ranks[before], -1)
            symbols, last, ranks = symbols[keep], last[keep], ranks[keep]
            stale = np.flatnonzero((ranks == -1) & ~last)
            ranks[ranks == -1] = _NEVER
            ranks[stale] = self.rank(symbols[stale], symbols[stale + 1])
        return counts

    def words(self, text: str) -> list[str]:
        """Normalised pre-tokens of a text without added tokens."""
        if text.isascii():
            return _ASCII_WORDS.findall(text.lower())
        return _WORDS.findall(self.normalizer.normalize_str(text) if _UNUSUAL.search(text) else text.lower())

    def counts(self, texts: Sequence[str | None]) -> list[int]:
        """Tokens of every text. Words are gathered over many texts, or a slice of a long one, and merged together."""
        totals = [0] * len(texts)
        held: list[tuple[int, list[str]]] = []
        size = 0

        def settle() -> None:
            missing = list({w for _, words in held for w in words}.difference(self.known))
            if len(self.known) + len(missing) > REMEMBERED:
                self.known.clear()
                missing = list({w for _, words in held for w in words})
            if missing:
                self.known.update(zip(missing, self.symbols([w.encode() for w in missing]).tolist()))
            for i, words in held:
                totals[i] += sum(map(self.known.__getitem__, words))
            held.clear()

        for i, text in enumerate(texts):
            for piece in slices(text or "", SLICE):
                parts = [piece]
                if self.added is not None and "<" in piece:
                    parts = self.added.split(piece)
                    totals[i] += len(parts) - 1
                held += [(i, self.words(part)) for part in parts]
                size += len(piece)
                if size >= SLICE:
                    settle()
                    size = 0
        settle()
        return totals


def _byte_letters() -> list[str]:
    """The printable letter that stands for every byte: itself if printable, else the next free code point from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in shown)
    moved = {b: 256 + i for i, b in enumerate(hidden)}
    return [chr(moved.get(b, b)) for b in range(256)]


def slices(text: str, size: int) -> Iterator[str]:
    """Cut a long text before white space, where no word, added token or combined character goes on."""
    start = 0
    while len(text) - start > size:
        cut = text.find(" ", start + size)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:] if start else text


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` and the ``carry`` columns.

    ``path`` names the vocabulary file on every worker. Added tokens inside a text count as one token each; nothing is added,
    cut or padded. A null text is an empty text with no tokens. Repeated rows stay. An empty table gives an empty result.
    """
    own = [c for c in carry if c != doc_id]
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"), *own)

    def work(batches: Iterator[list]) -> Iterator[Sequence[list]]:
        bpe = load(path)
        for texts in batches:
            counts = bpe.counts(texts)
            yield [len((t or "").encode()) for t in texts], counts, [n > limit for n in counts]
        # The worker lives on after the task; what it remembers must not.
        bpe.known.clear()

    fields = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())]
    made = arrow_pass(narrow, ["doc_id", *own], "__text", work, fields)
    return made.select(F.col("doc_id").alias(doc_id), *own, "n_bytes", "n_tokens", "over_limit")
