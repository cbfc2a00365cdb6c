"""Encoding into merge-type pieces with seeded merge-dropout, and lossless decoding.

The agenda of a chunk of text holds its candidate merges, best piece score first and then leftmost. A candidate whose keyed hash
falls below the dropout is passed over, so another seed gives another segmentation of the same text.

Passing over a candidate that a run of the agenda never takes changes nothing. So the runs of a chunk are remembered with the merges they
take: where the draws pass over none of these, the run's pieces stand; else the run without those merges is looked at in the
same way, until one stands. Every occurrence of a chunk still draws for itself.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysweep.llm.common import arrow_pass

DROPOUT = 0.1
SEED = 31_337
#: Chunks with more characters run through an agenda of their own.
LONG = 256
#: Characters of text whose chunks are held at a time, and chunks whose agendas move at once.
SLICE = 1 << 18
TOGETHER = 1 << 12
#: Runs that a task remembers, and most merges of a run that is remembered.
REMEMBERED = 1 << 17
WIDEST = 63
#: Pairs that make a piece are looked up in two to this many hash buckets.
SLOT_BITS = 20
_NEVER = np.iinfo(np.int32).max
_MASK = (1 << 64) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    """Finisher of a 64-bit hash on whole arrays (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Numbers(dict):
    """Numbers of keys in the order of their first use; ``new`` holds the keys not yet seen to, ``count`` all numbers given."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []
        self.count = 0

    def __missing__(self, key) -> int:
        number = self[key] = self.count
        self.count += 1
        self.new.append(key)
        return number


class _Rows:
    """Rows of whole numbers of any lengths in one growing array per column."""

    def __init__(self, *types: type) -> None:
        self.starts, self.sizes = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
        self.columns = [np.zeros(4096, dtype=t) for t in types]
        self.count = self.filled = 0

    def add(self, sizes: np.ndarray, *values: np.ndarray) -> None:
        count, filled = self.count + len(sizes), self.filled + len(values[0])
        self.starts, self.sizes = _room(self.starts, count), _room(self.sizes, count)
        self.starts[self.count : count] = self.filled + np.cumsum(sizes) - sizes
        self.sizes[self.count : count] = sizes
        for i, v in enumerate(values):
            self.columns[i] = _room(self.columns[i], filled)
            self.columns[i][self.filled : filled] = v
        self.count, self.filled = count, filled

    def get(self, rows: np.ndarray, first: np.ndarray | None = None, sizes: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Sizes, places inside the row and values of ``rows`` one after the other, or of ``sizes`` values from ``first`` on."""
        sizes = self.sizes[rows] if sizes is None else sizes
        local = _places(sizes) if first is None else _places(sizes) + np.repeat(first, sizes)
        at = np.repeat(self.starts[rows], sizes) + local
        return (sizes, local, *(c[at] for c in self.columns))


def _places(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... for every size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


class Runs:
    """Runs of the agendas of chunks, each with the merges it was not allowed, those it took and its pieces."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        #: Run of a chunk (no merge is barred), and of another run and the merges of it that are barred besides, as bits of one number.
        self.numbers = _Numbers()
        self.chunks: list[str] = []
        self.merges = _Rows(np.uint64, np.int64)
        #: Merges at the start of a run that it shares with the run it came from.
        self.shared = np.zeros(1024, dtype=np.int64)
        self.barred = _Rows(np.uint64)
        self.pieces = _Rows(np.int32)

    def see(self) -> None:
        """Run the agendas of the new keys."""
        new, self.numbers.new = self.numbers.new, []
        # The keys of one call are all chunks or all of the other kind.
        for at in range(0, len(new), TOGETHER):
            keys = new[at : at + TOGETHER]
            if isinstance(keys[0], str):
                none = np.zeros(len(keys), dtype=np.int64)
                self.add(keys, none, np.zeros(0, dtype=np.uint64), none, None)
            else:
                self.bar(keys)

    def bar(self, keys: list[int]) -> None:
        """Runs that go another way than known ones from the first barred merge on."""
        of, bits = np.array([k >> 64 for k in keys]), np.array([k & _MASK for k in keys])
        sizes, local, spans, _ = self.merges.get(of)
        chosen = (np.repeat(bits, sizes) >> local) & 1 == 1
        owner = np.repeat(np.arange(len(of)), sizes)[chosen]
        more, known, (before,) = spans[chosen], self.barred.sizes[of], self.barred.get(of)[2:]
        both = np.concatenate([np.repeat(np.arange(len(of)), known), owner])
        order = np.argsort(both, kind="stable")
        barred = np.concatenate([before, more])[order]
        first = np.bitwise_count((bits & -bits) - 1).astype(np.int64)
        self.add([self.chunks[i] for i in of.tolist()], known + np.bincount(owner, minlength=len(of)), barred, first, of)

    def add(self, chunks: list[str], bars: np.ndarray, barred: np.ndarray, shared: np.ndarray, of: np.ndarray | None) -> None:
        # Chunks are short, so their number and span fit one whole number.
        code = lambda name, begin, middle, end: (name.astype(np.int64) << 36) | (begin.astype(np.int64) << 24) | (middle << 12) | end
        codes = np.append(np.sort(code(np.repeat(np.arange(len(bars)), bars), *_unpacked(barred))), -1)

        def passed(name: np.ndarray, *at: np.ndarray) -> np.ndarray:
            wanted = code(name, *at)
            return codes[np.searchsorted(codes[:-1], wanted)] == wanted

        head = None if of is None else self.merges.get(of, np.zeros(len(of), dtype=np.int64), shared)
        given = None if head is None else (np.repeat(np.arange(len(of)), shared), head[2], head[3])
        counts, pieces, sizes, spans, made = self.model.run(chunks, None if of is None else passed, given)
        if given is not None:
            owner = np.concatenate([given[0], np.repeat(np.arange(len(sizes)), sizes)])
            order = np.argsort(owner, kind="stable")
            spans, made, sizes = np.concatenate([given[1], spans])[order], np.concatenate([given[2], made])[order], sizes + shared
        self.shared = _room(self.shared, self.merges.count + len(sizes))
        self.shared[self.merges.count : self.merges.count + len(sizes)] = shared
        self.chunks += chunks
        self.merges.add(sizes, spans, made)
        self.barred.add(bars, barred)
        self.pieces.add(counts, pieces)

    def hold(self, rows: list[tuple[int, ...]]) -> np.ndarray:
        """Numbers of rows of pieces that stand for nothing else."""
        first = self.numbers.count
        self.numbers.count += len(rows)
        none = np.zeros(len(rows), dtype=np.int64)
        self.shared = _room(self.shared, first + len(rows))
        self.chunks += [""] * len(rows)
        self.merges.add(none, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        self.barred.add(none, np.zeros(0, dtype=np.uint64))
        self.pieces.add(np.array([len(r) for r in rows], dtype=np.int64), np.array(list(chain.from_iterable(rows)), dtype=np.int32))
        return np.arange(first, first + len(rows))

    def encode(self, chunks: Sequence[str], keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """Number of pieces of every chunk under its key, and all pieces."""
        if self.numbers.count > REMEMBERED:
            self.clear()
        model, numbers = self.model, self.numbers
        lengths = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        short = np.flatnonzero(lengths <= LONG)
        run = np.zeros(len(chunks), dtype=np.int64)
        known = map(numbers.__getitem__, chunks if len(short) == len(chunks) else [chunks[i] for i in short.tolist()])
        run[short] = np.fromiter(known, dtype=np.int64, count=len(short))
        self.see()
        alone = [np.flatnonzero(lengths > LONG)]
        asked = short
        while len(asked):
            # A run that takes more merges than bits goes through an agenda of its own.
            wide = self.merges.sizes[run[asked]] > WIDEST
            alone.append(asked[wide])
            asked = asked[~wide]
            of = run[asked]
            # Merges shared with the run before were looked at there.
            sizes, local, spans, _ = self.merges.get(of, self.shared[of], self.merges.sizes[of] - self.shared[of])
            hit = np.flatnonzero(model.drawn(np.repeat(keys[asked], sizes), spans, dropout))
            if not len(hit):
                break
            owner = np.searchsorted(np.cumsum(sizes), hit, side="right")
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            bits = np.bitwise_or.reduceat(np.int64(1) << local[hit], first)
            asked = asked[owner[first]]
            run[asked] = [numbers[r << 64 | b] for r, b in zip(run[asked].tolist(), bits.tolist())]
            self.see()
        rest = np.concatenate(alone)
        if len(rest):
            run[rest] = self.hold(model.encode_chunks([chunks[i] for i in rest.tolist()], keys[rest], dropout))
        sizes, _, pieces = self.pieces.get(run)
        return sizes, pieces


def _unpacked(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, middle and end of spans."""
    spans = spans.astype(np.int64)
    mask = (1 << 21) - 1
    return spans >> 42, (spans >> 21) & mask, spans & mask


def _by_owner(parts: list[tuple[np.ndarray, ...]], types: list[type]) -> list[np.ndarray]:
    """Columns of all parts in the order of the first one, equal ones as they come."""
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, dtype=t) for i, t in enumerate(types)]
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or a longer copy, with places for ``size`` values."""
    if size <= len(array):
        return array
    longer = np.zeros(max(size, 2 * len(array)), dtype=array.dtype)
    longer[: len(array)] = array
    return longer


class PieceModel:
    """Pieces, scores and byte pieces of a merge-type model whose texts are not normalised; blanks stand for its blank mark."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes = [0] * 256
        self.ids: dict[str, int] = {}
        self.content: list[bytes] = [b""] * size
        score = np.zeros(size)
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value], self.content[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace("▁", " ")
                self.ids[text], self.content[i] = i, text.encode()
                score[i] = model.get_score(i)
        self.order = np.empty(size, dtype=np.int32)
        self.order[np.argsort(-score, kind="stable")] = np.arange(size)
        self.width = size + 1
        merges = {}
        for text, i in self.ids.items():
            for cut in range(1, len(text)):
                left, right = self.ids.get(text[:cut]), self.ids.get(text[cut:])
                if left is not None and right is not None:
                    merges[left * self.width + right] = i
        # Pairs by hash bucket, so that a look-up is one step for nearly all.
        keys = np.array(list(merges), dtype=np.int64)
        slots = self.slot(keys)
        by_slot = np.argsort(slots, kind="stable")
        self.keys = np.append(keys[by_slot], -1)
        self.results = np.append(np.array(list(merges.values()), dtype=np.int32)[by_slot], np.int32(-1))
        self.buckets = np.searchsorted(slots[by_slot], np.arange((1 << SLOT_BITS) + 1)).astype(np.int32)
        self.unknown = size
        #: Piece of every code point.
        self.letters = np.full(0x110000, size, dtype=np.int32)
        for text, i in self.ids.items():
            if len(text) == 1:
                self.letters[ord(text)] = i
        self.runs = Runs(self)
        #: Contents of all pieces one after the other.
        self.written_bytes = np.frombuffer(b"".join(self.content), dtype=np.uint8)
        self.written_sizes = np.array([len(c) for c in self.content], dtype=np.int64)
        self.written_starts = np.cumsum(self.written_sizes) - self.written_sizes
        # No merge crosses from a letter to a following blank; if no piece holds a line break, none crosses one either.
        if any(" " in t.lstrip(" ") for t in self.ids):
            self.chunk = re.compile(r"(?s).+")
        elif any("\n" in t for t in self.ids):
            self.chunk = re.compile(r" *[^ ]+| +")
        else:
            self.chunk = re.compile(r" *[^ \n]+| +|\n")

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece of two joined symbols, -1 where there is none."""
        key = left.astype(np.int64) * self.width + right
        slot = self.slot(key)
        at = self.buckets[slot]
        found = np.where(self.keys[at] == key, self.results[at], np.int32(-1))
        rest = np.flatnonzero(found < 0)
        ends = self.buckets[slot[rest] + 1]
        at = at[rest] + 1
        while len(rest):
            inside = at < ends
            rest, at, ends = rest[inside], at[inside], ends[inside]
            hit = self.keys[at] == key[rest]
            found[rest[hit]] = self.results[at[hit]]
            at += 1
        return found

    def encode_chunks(self, chunks: Sequence[str], key: int | np.ndarray, dropout: float) -> list[tuple[int, ...]]:
        """Pieces of every chunk under one key or a key each, each by an agenda of its own."""
        keys = np.broadcast_to(np.asarray(key, dtype=np.uint64), len(chunks))
        found: list[tuple[int, ...]] = [()] * len(chunks)
        short = [i for i, c in enumerate(chunks) if len(c) <= LONG]
        for i in set(range(len(chunks))).difference(short):
            found[i] = self.encode_long(chunks[i], int(keys[i]), dropout)
        own = keys[short]
        sizes, flat, *_ = self.run([chunks[i] for i in short], lambda name, *span: self.dropped(own[name], *span, dropout))
        flat, at = flat.tolist(), 0
        for i, n in zip(short, sizes.tolist()):
            found[i] = tuple(flat[at : at + n])
            at += n
        return found

    def run(
        self, texts: Sequence[str], passed: Callable[..., np.ndarray] | None, given: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of pieces of every chunk, all pieces; number of merges taken, their spans and what they made.

        All agendas move at once: a round pops the best of every chunk. ``passed`` gets arrays of the number of a chunk and of begin, middle
        and end of a candidate and tells which are passed over. ``given`` are merges (chunk, span, piece made) already taken.
        """
        sizes = np.array([len(c) for c in texts], dtype=np.int64)
        symbols = self.letters[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        starts = np.cumsum(sizes) - sizes
        owner, begin = np.repeat(np.arange(len(texts), dtype=np.int32), sizes), _places(sizes).astype(np.int32)
        if given is not None:
            name, spans, made = given
            first, middle, _ = _unpacked(spans)
            # Of merges that begin at one place the last one counts.
            symbols[starts[name] + first] = made
            stays = np.ones(len(symbols), dtype=bool)
            stays[starts[name] + middle] = False
            symbols, owner, begin = symbols[stays], owner[stays], begin[stays]
        last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, dtype=bool)
        end = np.where(last, sizes[owner], np.append(begin[1:], 0)).astype(np.int32) if len(owner) else begin
        pieces, ranks = np.full(len(symbols), -1, dtype=np.int32), np.full(len(symbols), _NEVER, dtype=np.int32)
        taken: list[tuple[np.ndarray, ...]] = []
        done: list[tuple[np.ndarray, ...]] = []

        def renew(at: np.ndarray) -> None:
            """Put the pairs that begin at ``at`` on the agenda, unless there is no such piece or it is passed over."""
            piece = self.merged(symbols[at], symbols[at + 1])
            live = piece >= 0
            if passed is not None:
                live &= ~passed(owner[at], begin[at], end[at], end[at + 1])
            pieces[at] = piece
            ranks[at] = np.where(live, self.order[np.maximum(piece, 0)], _NEVER)

        renew(np.flatnonzero(~last))
        while len(symbols):
            ends = np.flatnonzero(last)
            starts = np.concatenate([[0], ends[:-1] + 1])
            sizes = ends - starts + 1
            lowest = np.minimum.reduceat(ranks, starts)
            live = lowest != _NEVER
            if not live.all():
                stay = np.repeat(live, sizes)
                done.append((owner[~stay], symbols[~stay], begin[~stay]))
                symbols, begin, end, last = symbols[stay], begin[stay], end[stay], last[stay]
                owner, pieces, ranks = owner[stay], pieces[stay], ranks[stay]
                sizes, lowest = sizes[live], lowest[live]
                if not len(symbols):
                    break
            best = np.flatnonzero(ranks == np.repeat(lowest, sizes))
            word = owner[best]
            places = best[np.append(True, word[1:] != word[:-1])]
            taken.append((owner[places], self.span(begin[places], end[places], end[places + 1]), pieces[places]))
            symbols[places] = pieces[places]
            end[places], last[places] = end[places + 1], last[places + 1]
            keep = np.ones(len(symbols), dtype=bool)
            keep[places + 1] = False
            renewed = np.zeros(len(symbols), dtype=bool)
            renewed[places] = True
            before = places[places > 0] - 1
            renewed[before] |= ~last[before]
            ranks[places] = _NEVER
            symbols, begin, end, last = symbols[keep], begin[keep], end[keep], last[keep]
            owner, pieces, ranks, renewed = owner[keep], pieces[keep], ranks[keep], renewed[keep]
            renew(np.flatnonzero(renewed & ~last))
        of, row, at = _by_owner(done, [np.int64] * 3)
        counts, row = self.spelt_all(texts, of, row, at)
        name, spans, made = _by_owner(taken, [np.int64, np.uint64, np.int64])
        return counts, row, np.bincount(name, minlength=len(texts)), spans, made

    def spelt_all(self, texts: Sequence[str], of: np.ndarray, row: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of pieces per chunk and pieces, with characters without a piece replaced by the pieces of their bytes."""
        lost = np.flatnonzero(row == self.unknown)
        if len(lost):
            spelling = [[self.bytes[b] for b in texts[i][j].encode()] for i, j in zip(of[lost].tolist(), begin[lost].tolist())]
            times = np.ones(len(row), dtype=np.int64)
            times[lost] = [len(p) for p in spelling]
            of, row = np.repeat(of, times), np.repeat(row, times)
            row[row == self.unknown] = list(chain.from_iterable(spelling))
        return np.bincount(of, minlength=len(texts)), row.astype(np.int32)

    @staticmethod
    def span(begin: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (begin.astype(np.uint64) << np.uint64(42)) ^ (middle.astype(np.uint64) << np.uint64(21)) ^ end.astype(np.uint64)

    @staticmethod
    def drawn(hashed: np.ndarray, span: np.ndarray, dropout: float) -> np.ndarray:
        """Whether the keyed hash of a span passes it over."""
        draw = _mix(hashed ^ _mix(span + np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(11)
        return draw.astype(np.float64) * 2.0**-53 < dropout

    @staticmethod
    def dropped(hashed: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray, dropout: float) -> np.ndarray:
        """Whether the candidate that joins [begin, middle) and [middle, end) of a chunk is passed over."""
        return PieceModel.drawn(hashed, PieceModel.span(begin, middle, end), dropout)

    def encode_long(self, chunk: str, key: int, dropout: float) -> tuple[int, ...]:
        """The same agenda for one chunk of any length, as a heap over a linked list of symbols."""
        symbols = [self.ids.get(c, self.unknown) for c in chunk]
        n = len(symbols)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        hashed = np.array([key], dtype=np.uint64)
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(at: list[int]) -> None:
            at = [i for i in at if 0 <= i and after[i] < n]
            if not at:
                return
            nexts = [after[i] for i in at]
            piece = self.merged(np.array([symbols[i] for i in at]), np.array([symbols[j] for j in nexts]))
            ends = [end[j] for j in nexts]
            passed = self.dropped(hashed, np.array(at), np.array(nexts), np.array(ends), dropout)
            for i, j, e, p, skip in zip(at, nexts, ends, piece.tolist(), passed.tolist()):
                if p >= 0 and not skip:
                    heapq.heappush(agenda, (int(self.order[p]), i, j, e, p))

        offer(list(range(n)))
        while agenda:
            _, i, j, e, p = heapq.heappop(agenda)
            # Stale if either side has changed since.
            if symbols[i] < 0 or after[i] != j or symbols[j] < 0 or end[j] != e:
                continue
            symbols[i], symbols[j] = p, -1
            end[i], after[i] = e, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer([before[i], i])
        begin = [i for i in range(n) if symbols[i] >= 0]
        return tuple(self.spelt(chunk, [symbols[i] for i in begin], begin))

    def spelt(self, chunk: str, row: list[int], begin: list[int]) -> list[int]:
        """Replace characters without a piece by the pieces of their bytes."""
        parts = ([s] if s != self.unknown else [self.bytes[b] for b in chunk[i].encode()] for s, i in zip(row, begin))
        return list(chain.from_iterable(parts))

    def encode_texts(self, texts: Sequence[str | None], keys: Sequence[int], dropout: float) -> list[list[int]]:
        return [row.tolist() for row in self.encode_arrays(texts, keys, dropout)]

    def encode_arrays(self, texts: Sequence[str | None], keys: Sequence[int], dropout: float) -> list[np.ndarray]:
        """Pieces of every text under its key. A text starts with a blank of its own, which ``decode`` takes away.

        The key of a chunk is made of the key of its text and its place in it, so no two chunks share their draws.
        """
        rows: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, int, list[str]]] = []
        size = 0

        def settle() -> None:
            counts = np.array([len(chunks) for _, _, chunks in held], dtype=np.int64)
            starts = np.repeat(np.array([first for _, first, _ in held], dtype=np.int64) - np.cumsum(counts) + counts, counts)
            place = (starts + np.arange(len(starts)) + 1).astype(np.uint64)
            own = np.repeat(np.array([keys[i] & _MASK for i, _, _ in held], dtype=np.uint64), counts)
            keyed = _mix(_mix(own) + place * np.uint64(0x9E3779B97F4A7C15))
            flat = list(chain.from_iterable(c for _, _, c in held))
            sizes, made = self.runs.encode(flat, keyed, dropout)
            ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))].tolist()
            for k, (i, _, _) in enumerate(held):
                rows[i].append(made[ends[k] : ends[k + 1]])
            held.clear()

        for i, text in enumerate(texts):
            first = 0
            for piece in self.slices(" " + text if text else ""):
                chunks = self.chunk.findall(piece)
                held.append((i, first, chunks))
                first += len(chunks)
                size += len(piece)
                if size >= SLICE:
                    settle()
                    size = 0
        settle()
        return [np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32) for parts in rows]

    def slices(self, text: str) -> Iterator[str]:
        """Cut a long text where a chunk ends: between another character and a blank."""
        start = 0
        cut = re.compile(r"(?<=[^ ]) ") if self.chunk.pattern != r"(?s).+" else None
        while cut is not None and len(text) - start > SLICE:
            match = cut.search(text, start + SLICE)
            if match is None:
                break
            yield text[start : match.start()]
            start = match.start()
        if start < len(text):
            yield text[start:] if start else text

    def written(self, ids: np.ndarray) -> bytes:
        """The text of a row of pieces in UTF-8, the blank in front included."""
        sizes = self.written_sizes[ids]
        return self.written_bytes[np.repeat(self.written_starts[ids], sizes) + _places(sizes)].tobytes()

    def decode(self, ids: Sequence[int]) -> str:
        """The text of a row of pieces, without the blank that encoding put in front."""
        return b"".join(map(self.content.__getitem__, ids)).decode()[1:]


@functools.lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(
    docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = (), copy: str | None = None
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_pieces``, ``pieces`` (ids), ``lossless`` and the ``carry`` columns.

    Every chunk draws by the seed, the id, the number in column ``copy`` (if named) and its place in the text. So a word is segmented
    anew wherever it occurs, a rerun gives the same pieces, and repeated rows give the same unless ``copy`` tells them apart.
    ``lossless`` tells whether decoding the pieces gives back the text to the letter, blank marks and unknown letters
    included (they go through byte pieces). A null text is an empty text without pieces. An empty table gives an empty result.
    ``path`` names the model file on every worker; without dropout the pieces are the model's own.
    """
    own = [c for c in carry if c != doc_id]
    key = F.xxhash64(F.lit(seed), F.col(doc_id), *([] if copy is None else [F.col(copy)]))
    narrow = docs.select(F.col(doc_id).alias("doc_id"), *own, F.struct(F.col(text).alias("text"), key.alias("key")).alias("__text"))

    def work(batches: Iterator[list]) -> Iterator[Sequence[list]]:
        model = load(path)
        for rows in batches:
            texts = [r["text"] for r in rows]
            made = model.encode_arrays(texts, [r["key"] for r in rows], dropout)
            yield [len(m) for m in made], made, [model.written(m)[1:] == (t or "").encode() for m, t in zip(made, texts)]
        # The worker lives on after the task; what it remembers must not.
        model.runs.clear()

    fields = [("n_pieces", T.LongType()), ("pieces", T.ArrayType(T.IntegerType())), ("lossless", T.BooleanType())]
    result = arrow_pass(narrow, ["doc_id", *own], "__text", work, fields)
    return result.select(F.col("doc_id").alias(doc_id), *own, "n_pieces", "pieces", "lossless")
