"""Personal data in texts: exact base patterns, and a skip-chain conditional random field that finds further mentions.

The field labels tokens with a digit or an at sign. Neighbouring tokens are linked, and so are tokens that repeat the same
digits, local part or word anywhere in the document, each with its previous occurrence, so links grow with the
text. Base spans are evidence. Loopy message passing carries their labels along both kinds of links, so a mention that no
pattern fits gets the label of its twins.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysweep.llm.common import arrow_pass

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: Marginal probability from which a token counts as personal data.
CERTAIN = 0.5
DAMPING, SETTLED = 0.5, 1e-4
#: Rounds, besides two for each link of the longest connected stretch, after which messages that still change move by half as much.
ROUNDS = 50
#: Tokens with fewer digits and no letters are too common to be linked by their digits.
LINK_DIGITS = 5
_BLOCK = 1 << 15
_SOME = re.compile("[0-9@]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]*")
# Digits match to the end of their run, so a match begins only where a run begins; this keeps the scan linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TAIL = re.compile(r"[0-9@]\S*")
_EDGE = " \t.,;:!?\"'()[]{}<>"
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from the at signs: the local part is the run before, from the last match on."""
    done = 0
    at = text.find("@")
    while at >= 0:
        if at >= done:
            # The run of local characters before the sign, read backwards.
            run = _LOCAL_TAIL.match(text[max(done, at - 64) : at][::-1]).end()
            if run == 64:
                run = _LOCAL_TAIL.match(text[done:at][::-1]).end()
            match = _DOMAIN.match(text, at) if run else None
            if match:
                yield at - run, match.end()
                done = match.end()
            else:
                done = at + 1
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the base patterns, kinds in order, leftmost and without overlap inside a kind."""
    if not _SOME.search(text):
        return []
    found = [(0, a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        # Leading zeros do not matter; longer parts without them are over the limit anyway.
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m[0])) <= 15:
            found.append((3, m.start(), m.end()))
    return found


def tokens(text: str) -> tuple[list[tuple[int, int]], list[bool], list[bool]]:
    """Candidate tokens: core span, whether the token before is a candidate too, whether words stand on either side."""
    spans, joined, outer = [], [], []
    last_end = 0
    for m in _TAIL.finditer(text):
        start = m.start()
        while start > last_end and not text[start - 1].isspace():
            start -= 1
        gap = text[last_end:start]
        joined.append(bool(spans) and (not gap or gap.isspace()))
        outer.append(not gap.isspace() and bool(gap))
        last_end = m.end()
        core = m.string[start : m.end()]
        left = len(core) - len(core.lstrip(_EDGE))
        right = len(core.rstrip(_EDGE))
        spans.append((start + left, start + max(right, left + 1)))
    return spans, joined, outer


def _valid(core: str) -> bool:
    """Whether the digits pass the checks of a card or an address, where the token looks like one."""
    parts = core.split(".")
    if len(parts) == 4 and all(map(str.isdecimal, parts)):
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    digits = "".join(c for c in core if c.isascii() and c.isdigit())
    return 16 <= len(digits) <= 19 and luhn(digits)


def shape(core: str) -> str:
    """A coarse form of a token; there are under 6,000 of them."""
    digits = sum(map(str.isdigit, core))
    bucket = next((i for i, most in enumerate((0, 2, 4, 6, 8, 15, 19)) if digits <= most), 7)
    letters = any(map(str.isalpha, core))
    return f"{bucket}{int(letters)}{int('@' in core)}{min(core.count('.'), 4)}{int('-' in core)}{int('+' in core)}{int('(' in core or ')' in core)}{int('=' in core or ':' in core)}{int(_valid(core))}"


def likeness(core: str) -> str | None:
    """What tokens that mean the same have in common: local part of an address, the digits, or the word."""
    if "@" in core:
        return core.partition("@")[0].lower() or None
    if any(map(str.isalpha, core)):
        return core.lower()
    digits = "".join(filter(str.isdigit, core))
    return digits if len(digits) >= LINK_DIGITS else None


@dataclass
class Document:
    """Tokens of a text as nodes of the field, with their links and what the base spans tell."""

    spans: list[tuple[int, int]]
    shapes: list[str]
    labels: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    open_left: np.ndarray
    open_right: np.ndarray
    base: list[Span] = field(default_factory=list)


def parse(text: str) -> Document:
    base = base_spans(text)
    spans, joined, outer = tokens(text) if _SOME.search(text) else ([], [], [])
    n = len(spans)
    labels = np.zeros(n, dtype=np.int64)
    starts = np.array([a for a, _ in spans], dtype=np.int64)
    ends = np.array([b for _, b in spans], dtype=np.int64)
    for kind, a, b in base:
        labels[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b, side="left")] = kind + 1
    at = np.flatnonzero(joined)
    chain = np.stack([at - 1, at], axis=1) if n else np.zeros((0, 2), dtype=np.int64)
    seen: dict[str, int] = {}
    skip = []
    for i, (a, b) in enumerate(spans):
        like = likeness(text[a:b])
        if like is not None:
            if like in seen:
                skip.append((seen[like], i))
            seen[like] = i
    outer = np.array(outer, dtype=bool)
    after = np.zeros(n, dtype=bool)
    after[:-1] = outer[1:]
    if n:
        after[-1] = bool(text[spans[-1][1] :].strip(_EDGE + "\n\r"))
    return Document(spans, [shape(text[a:b]) for a, b in spans], labels, chain, np.array(skip, dtype=np.int64).reshape(-1, 2), outer, after, base)


@dataclass
class Potentials:
    """Log potentials of shapes, of neighbours and of alike tokens."""

    shapes: dict[str, np.ndarray]
    unseen: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def fit(counts: dict[str, int]) -> Potentials:
    """Piecewise training: every factor gets its own normalised log-frequencies, smoothed by one observation each."""
    size = len(LABELS)
    prior = np.ones(size)
    shapes: dict[str, np.ndarray] = {}
    pairs, alike = np.ones((size, size)), np.ones(2)
    for key, n in counts.items():
        kind, *rest = key.split("|")
        if kind == "shape":
            shapes.setdefault(rest[0], np.zeros(size))[int(rest[1])] += n
            prior[int(rest[1])] += n
        elif kind == "chain":
            pairs[int(rest[0]), int(rest[1])] += n
        else:
            alike[int(rest[0])] += n
    prior /= prior.sum()
    unary = {s: np.log((c + prior) / (c.sum() + 1)) for s, c in shapes.items()}
    expected = pairs.sum(axis=1, keepdims=True) * pairs.sum(axis=0, keepdims=True) / pairs.sum()
    agree = float(np.clip(np.log(alike[1] / alike[0]), 0.0, 8.0))
    return Potentials(unary, np.log(prior), np.log(pairs / expected), agree * np.eye(size))


def observed(doc: Document) -> Counter[str]:
    """What a document adds to the counts that the potentials are fitted to."""
    seen: Counter[str] = Counter(f"shape|{s}|{k}" for s, k in zip(doc.shapes, doc.labels.tolist()))
    seen.update(f"chain|{a}|{b}" for a, b in doc.labels[doc.chain].tolist())
    seen.update(f"chain|0|{k}" for k in doc.labels[doc.open_left].tolist())
    seen.update(f"chain|{k}|0" for k in doc.labels[doc.open_right].tolist())
    # How often alike tokens agree, where one of them is personal data.
    seen.update(f"alike|{int(a == b)}" for a, b in doc.labels[doc.skip].tolist() if a or b)
    return seen


def _longest(links: np.ndarray, n: int) -> int:
    """Links of the largest connected set of tokens, no less than the links of its longest path."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links.tolist():
        parent[root(a)] = root(b)
    return max(Counter(root(a) for a, _ in links.tolist()).values(), default=0)


def marginals(doc: Document, potentials: Potentials, rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities of every token by loopy message passing; exact where the links form no loop.

    Rounds go on until the messages have settled. A label moves one link a round, so the rounds before the first slowing grow with the
    links that hang together; then steps halve, so that messages that swing come to rest.
    """
    n, size = len(doc.spans), len(LABELS)
    unary = np.array([potentials.shapes.get(s, potentials.unseen) for s in doc.shapes]).reshape(n, size).copy()
    unary[doc.open_left] += potentials.chain[0]
    unary[doc.open_right] += potentials.chain[:, 0]
    known = np.flatnonzero(doc.labels)
    unary[known] = -1e3
    unary[known, doc.labels[known]] = 0.0
    # Directed edges: every link in both directions, its reverse at the other half.
    links = np.concatenate([doc.chain, doc.skip])
    source, target = np.concatenate([links[:, 0], links[:, 1]]), np.concatenate([links[:, 1], links[:, 0]])
    half, c = len(links), len(doc.chain)
    kinds = [(slice(0, c), potentials.chain), (slice(c, half), potentials.skip), (slice(half, half + c), potentials.chain.T), (slice(half + c, 2 * half), potentials.skip)]
    messages = np.zeros((2 * half, size))
    belief = unary.copy()
    step, patience, done = 1 - DAMPING, rounds + 2 * _longest(links, n), 0
    while half:
        outgoing = belief[source] - np.concatenate([messages[half:], messages[:half]])
        new = np.empty_like(messages)
        for part, potential in kinds:
            for start in range(part.start, part.stop, _BLOCK):
                rows = slice(start, min(start + _BLOCK, part.stop))
                joint = outgoing[rows][:, :, None] + potential[None]
                top = joint.max(axis=1)
                new[rows] = top + np.log(np.exp(joint - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        new = (1 - step) * messages + step * new
        change = np.abs(new - messages).max()
        messages = new
        belief = unary.copy()
        np.add.at(belief, target, messages)
        if change < SETTLED:
            break
        done += 1
        if done % patience == 0:
            step /= 2
    belief = np.exp(belief - belief.max(axis=1, keepdims=True))
    return belief / belief.sum(axis=1, keepdims=True)


def added_spans(doc: Document, potentials: Potentials, certain: float = CERTAIN) -> list[Span]:
    """Spans of tokens that the field finds besides the base spans; neighbours of one label become one span."""
    if not len(doc.spans) or doc.labels.all():
        return []
    probable = marginals(doc, potentials)
    label = probable.argmax(axis=1)
    label[(probable.max(axis=1) < certain) | (doc.labels > 0)] = 0
    joined = set(doc.chain[:, 1].tolist())
    found: list[Span] = []
    previous = 0
    for i, k in enumerate(label.tolist()):
        a, b = doc.spans[i]
        if k and k == previous and i in joined:
            found[-1] = (k - 1, found[-1][1], b)
        elif k:
            found.append((k - 1, a, b))
        previous = k
    return found


def written(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def fit_potentials(docs: DataFrame, text: str = "text") -> Potentials:
    """Potentials from all documents: counts are added up per batch, then per key, of which there are a few thousand."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                if t and _SOME.search(t):
                    seen.update(observed(parse(t)))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["key", "n"])

    counts = docs.select(text).mapInArrow(count, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return fit({r["key"]: r["n"] for r in counts.collect()})


def find_private_data(docs: DataFrame, potentials: Potentials | None = None, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans``, ``n_added``, ``carry``.

    The counts and the digest are those of the base patterns; ``spans`` also has what the field adds. Positions are code points,
    the end exclusive. A null or empty text has no spans, the digest of the empty string and an empty ``spans``. Repeated
    rows stay. An empty table gives an empty result. Without ``potentials`` they are fitted to ``docs`` first.
    """
    own = [c for c in carry if c != doc_id]
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"), *own)
    work = partial(_label, potentials=potentials or fit_potentials(narrow, "__text"))
    counts = [f"n_{k}" for k in KINDS]
    fields = [*((c, T.LongType()) for c in counts), ("base_sha256", T.StringType()), ("spans", T.StringType()), ("n_added", T.LongType())]
    made = arrow_pass(narrow, ["doc_id", *own], "__text", work, fields)
    return made.select(F.col("doc_id").alias(doc_id), *own, *(c for c, _ in fields))


def _label(batches: Iterator[list], potentials: Potentials) -> Iterator[Sequence[list]]:
    nothing = hashlib.sha256(b"").hexdigest()
    for texts in batches:
        rows = []
        for t in texts:
            if not t or not _SOME.search(t):
                rows.append((0, 0, 0, 0, nothing, "", 0))
                continue
            doc = parse(t)
            added = added_spans(doc, potentials)
            kinds = Counter(k for k, _, _ in doc.base)
            digest = hashlib.sha256(written(doc.base).encode()).hexdigest()
            rows.append((*(kinds[k] for k in range(len(KINDS))), digest, written([*doc.base, *added]), len(added)))
        yield [list(column) for column in zip(*rows)] if rows else [[] for _ in range(7)]
