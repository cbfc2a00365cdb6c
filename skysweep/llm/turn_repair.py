"""Repair of damaged conversations by cheapest edits, found by bidirectional Dijkstra over the lattice of turns and role states.

A place in the lattice is (rows used, state of ``(s?(ua)+)?``). A row is kept, given another role or deleted, a turn may be inserted. A search
from the front and one from the back meet; once no cheaper meeting is possible and all of the least cost are known, the least
joined audit is taken. Parts of a conversation have a cost and an audit per pair of states, and parts are joined by trying the
state between them, so a conversation of any length is solved in blocks, and one with many rows by many tasks.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from skysweep.llm.common import bound_batches, stored

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn. Nothing and after an assistant may be the end.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, ENDS = (START, SYSTEM, USER, ASSISTANT), (START, ASSISTANT)
_STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The one letter that a turn of a new role or an inserted one can have in a state.
_WRITTEN = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
_ROLES = {"u": "user", "a": "assistant"}
#: A row is written as two letters: its role's initial (``-`` for any other) and its fault.
SOUND, BLANK, DUPLICATE, TRUNCATED = "kbdt"
#: Rows that one search takes.
BLOCK = 128
_FILLED = re.compile(r"[^\x20\x09-\x0D]")
_LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")

Label = tuple[int, str]
#: Cost and audit from every state to every state that can be reached.
Spans = dict[tuple[int, int], Label]


def _edits(code: str, i: int, state: int) -> Iterator[tuple[int, int, str, int]]:
    """Edits at a place: rows used and state after it, letter, cost."""
    yield i, _STEP[state, _WRITTEN[state]], "I", INSERT
    if 2 * i == len(code):
        return
    role, fault = code[2 * i], code[2 * i + 1]
    yield i + 1, state, "D", DELETE
    if fault in (SOUND, TRUNCATED):
        more = UNFINISHED if fault == TRUNCATED else 0
        yield i + 1, _STEP[state, _WRITTEN[state]], "R", REROLE + more
        if (state, role) in _STEP:
            yield i + 1, _STEP[state, role], "K", KEEP + more


def _edits_back(code: str, i: int, state: int) -> Iterator[tuple[int, int, str, int]]:
    """The edits that lead to a place, with the place before them."""
    for j in (i, i - 1) if i else (i,):
        for start in STATES:
            for at, after, letter, cost in _edits(code, j, start):
                if (at, after) == (i, state):
                    yield j, start, letter, cost


@functools.lru_cache(maxsize=1 << 16)
def search(code: str, start: int = START, ends: tuple[int, ...] = ENDS) -> Label | None:
    """Least cost and the least audit of that cost from ``start`` before the rows of ``code`` to one of ``ends`` behind them.

    Only keeping can be free, and it uses a row. So among labels of one cost those with fewer rows used (from the back: more) are final
    first, and a label is final when it is taken from its heap. Of two audits of one cost to one place none begins the other, so the
    least ones joined are the least joined one.
    """
    n = len(code) // 2
    labels: tuple[dict, dict] = ({(0, start): (0, "")}, {(n, end): (0, "") for end in ends})
    final: tuple[dict, dict] = ({}, {})
    heaps: tuple[list, list] = ([(0, 0, start)], [(0, -n, end) for end in ends])
    best: int | None = None
    while heaps[0] and heaps[1]:
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best:
            break
        side = 0 if heaps[0][0] <= heaps[1][0] else 1
        cost, at, state = heapq.heappop(heaps[side])
        place = (abs(at), state)
        if place in final[side]:
            continue
        final[side][place] = label = labels[side][place]
        if place in labels[1 - side]:
            met = cost + labels[1 - side][place][0]
            best = met if best is None else min(best, met)
        for j, other, letter, more in (_edits_back if side else _edits)(code, *place):
            there = (j, other)
            offer = (cost + more, letter + label[1] if side else label[1] + letter)
            if there not in final[side] and (there not in labels[side] or offer < labels[side][there]):
                labels[side][there] = offer
                heapq.heappush(heaps[side], (offer[0], -j if side else j, other))
    if best is None:
        return None
    # Every cheapest row of edits has an edit from a place final in front to one final behind, or is empty. Nothing beats the empty
    # audits of the first and last places, so these are final from the start.
    front = {(0, start): (0, "")} | final[0]
    behind = {(n, end): (0, "") for end in ends} | final[1]
    joined = [audit for place, (cost, audit) in front.items() if place[0] == n and place[1] in ends and cost == best]
    for place, (cost, audit) in front.items():
        for j, other, letter, more in _edits(code, *place):
            rest = behind.get((j, other))
            if rest is not None and cost + more + rest[0] == best:
                joined.append(audit + letter + rest[1])
    return best, min(joined)


def join_spans(left: Spans, right: Spans) -> Spans:
    made: Spans = {}
    for (p, q), (cost, audit) in left.items():
        for r in STATES:
            rest = right.get((q, r))
            if rest is not None:
                offer = (cost + rest[0], audit + rest[1])
                if (p, r) not in made or offer < made[p, r]:
                    made[p, r] = offer
    return made


def join_all(parts: Sequence[Spans]) -> Spans:
    while len(parts) > 1:
        parts = [join_spans(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def spans(code: str) -> Spans:
    """Costs and audits of a part of a conversation, in blocks that are joined pairwise."""
    blocks = [code[i : i + 2 * BLOCK] for i in range(0, len(code), 2 * BLOCK)] or [""]
    return join_all([{(p, q): found for p in STATES for q in STATES if (found := search(b, p, (q,))) is not None} for b in blocks])


def cheapest(code: str) -> Label:
    """Cost and audit of a whole conversation."""
    if len(code) <= 2 * BLOCK:
        return search(code)
    known = spans(code)
    return min(known[START, end] for end in ENDS if (START, end) in known)


def repaired_lines(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[str]:
    """``role:text`` of the repaired turns; ``rows`` are (role, text) in order."""
    state, given = START, iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(given)
        if letter == "D":
            continue
        initial = role[:1] if letter == "K" else _WRITTEN[state]
        state = _STEP[state, initial]
        yield f"{role if letter == 'K' else _ROLES[initial]}:{text}"


class _LineHash:
    """Digest of lines joined by line breaks, one at a time."""

    def __init__(self) -> None:
        self.sha, self.first = hashlib.sha256(), True

    def add(self, line: str) -> None:
        self.sha.update((line if self.first else "\n" + line).encode())
        self.first = False


# --- rows ---------------------------------------------------------------------------------------------------------


def damage(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Seeded damage: ``conv_id``, ``turn``, ``role``, ``text`` and whether a row is ``dropped`` (its role and text are then empty).

    The checksum of ``conv_id:turn`` modulo 20 drops a row (0), empties its text (1), takes out its full stops, exclamation and question marks
    (2), repeats it (3) or makes it a user's (4). A null role, text or part of the checksum counts as one blank; the ids and turns returned stay null.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv_id), F.lit(":"), blank(turn)).cast("binary")) % 20
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"), kind.alias("kind")
    )
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    gone = F.col("kind") == 0
    return rows.withColumn("__time", times).select(
        "conv_id",
        "turn",
        F.when(gone, "").when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone | (F.col("kind") == 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        gone.alias("dropped"),
    )


def _order() -> list[Column]:
    return [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("number")]


def flag_repeats(rows: DataFrame) -> DataFrame:
    """Add ``repeated``: whether an earlier row of the conversation has the same role and text.

    Only a digest, turn and number of each row are grouped, combined before the shuffle; few groups have more than one row.
    """
    conv = F.col("conv_id").cast("string")
    sizes = F.to_json(F.struct(F.length(conv), F.length("role")), {"ignoreNullFields": "false"})
    parts = F.concat(sizes, F.coalesce(conv, F.lit("")), "role", "text")
    marked = rows.withColumn("digest", F.when(F.col("dropped"), F.unhex(F.md5(F.col("number").cast("string").cast("binary")))).otherwise(F.unhex(F.sha2(parts, 256))))
    # Dropped rows have digests of their own, so that they spread. A null turn comes first, as it does in a struct.
    at = F.struct(F.col("turn"), F.col("number"))
    firsts = marked.filter(~F.col("dropped")).groupBy("digest").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("members"))
    several = firsts.filter("members > 1").select("digest", "first")
    known = marked.join(several, "digest", "left")
    return known.withColumn("repeated", F.coalesce(F.col("first.number") != F.col("number"), F.lit(False))).drop("digest", "first")


def _fault(text: str, repeated: bool) -> str:
    if not _FILLED.search(text):
        return BLANK
    if repeated:
        return DUPLICATE
    return SOUND if _LAST.search(text).group(1) in ".!?" else TRUNCATED


class _Part:
    """What is known of consecutive rows of one conversation."""

    __slots__ = ("conv_id", "codes", "rows", "low", "high", "first_turn", "turns", "illegal")

    def __init__(self, conv_id) -> None:
        self.conv_id, self.codes, self.rows = conv_id, [], []
        self.low = self.high = None
        self.turns = self.illegal = 0

    def add(self, turn, role: str, text: str, repeated: bool) -> None:
        initial = role[:1]
        if self.rows and _bad(self.rows[-1][0][:1], initial):
            self.illegal += 1
        self.rows.append((role, text))
        self.codes.append((initial if initial in ("s", "u", "a") else "-") + _fault(text, repeated))
        if turn is not None:
            if self.high is None or turn != self.high:
                self.turns += 1
            self.low, self.high = (turn if self.low is None else self.low), turn

    def counts(self) -> tuple[int, int, int]:
        faults = "".join(c[1] for c in self.codes)
        return faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED)


def _bad(before: str, after: str) -> bool:
    return before + after not in ("su", "ua", "au")


def _gaps(low, high, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PART = "part long, low long, high long, turns long, before string, after string, span_from array<int>, span_to array<int>, span_cost array<long>, span_audit array<string>"


def _solve(ordered: DataFrame) -> DataFrame:
    """Whole conversations inside a range are finished, the first and the last of a range are left as parts.

    The result has the columns of both; ``part`` is null in finished rows.
    """
    conv_type = ordered.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv_type}, {_RESULT}, {_PART}"
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        held: list[tuple] = []

        def finished(part: _Part) -> tuple:
            cost, audit = cheapest("".join(part.codes))
            lines = _LineHash()
            for line in repaired_lines(audit, part.rows):
                lines.add(line)
            found = (_gaps(part.low, part.high, part.turns), *part.counts(), part.illegal, cost, audit, lines.sha.hexdigest())
            return (part.conv_id, *found, *[None] * 10)

        def open_part(part: _Part) -> tuple:
            known = sorted(spans("".join(part.codes)).items()) if part.codes else []
            ends = (part.rows[0][0][:1], part.rows[-1][0][:1]) if part.rows else (None, None)
            pairs = [[p for (p, _), _ in known], [q for (_, q), _ in known], [c for _, (c, _) in known], [a for _, (_, a) in known]]
            return (part.conv_id, None, *part.counts(), part.illegal, None, None, None, number, part.low, part.high, part.turns, *ends, *pairs)

        def flush() -> pa.RecordBatch:
            columns = [pa.array(v, f.type) for v, f in zip(zip(*held), arrow)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        part: _Part | None = None
        first = True
        for batch in batches:
            for conv, turn, role, text, dropped, repeated in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if part is None or part.conv_id != conv:
                    if part is not None:
                        held.append(open_part(part) if first else finished(part))
                        first = False
                        if len(held) >= 1000:
                            yield flush()
                    part = _Part(conv)
                if not dropped:
                    part.add(turn, role, text, repeated)
        if part is not None:
            held.append(open_part(part))
        if held:
            yield flush()

    bound_batches(ordered.sparkSession)
    return ordered.select("conv_id", "turn", "role", "text", "dropped", "repeated").mapInArrow(run, schema)


def _join_parts(parts: DataFrame) -> DataFrame:
    """Results of the conversations that were left as parts, all but the digest of their turns.

    A group has one row per range of the sort that the conversation lies in.
    """
    conv_type = parts.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv_type}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        # Whole numbers that may be null come as text, so that none passes through a float.
        rows = rows.sort_values("part")
        conv = rows["conv"].iloc[0]
        low = high = last = None
        turns = illegal = 0
        known: list[Spans] = []
        for r in rows.itertuples(index=False):
            illegal += int(r.illegal)
            if not isinstance(r.before, str):
                continue
            illegal += last is not None and _bad(last, r.before)
            last = r.after
            if isinstance(r.low, str):
                turns += int(r.turns) - (high == int(r.low))
                low, high = (int(r.low) if low is None else low), int(r.high)
            known.append({(int(p), int(q)): (int(c), a) for p, q, c, a in zip(r.span_from, r.span_to, r.span_cost, r.span_audit)})
        total = join_all(known) if known else {(START, START): (0, "")}
        cost, audit = min(total[START, end] for end in ENDS if (START, end) in total)
        counts = [int(rows[c].sum()) for c in ("blank", "duplicate", "truncated")]
        return pd.DataFrame([[conv, _gaps(low, high, turns), *counts, illegal, cost, audit]], columns=["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    texts = [F.col(c).cast("string").alias(c) for c in ("low", "high")]
    given = parts.select(F.col("conv_id").cast("string").alias("conv"), "blank", "duplicate", "truncated", "illegal", "part", *texts, "turns", "before", "after", "span_from", "span_to", "span_cost", "span_audit")
    made = given.groupBy("conv").applyInPandas(joined, schema.replace(f"conv_id {conv_type}", "conv string"))
    return made.withColumn("conv_id", F.col("conv").cast(conv_type)).drop("conv")


def _digests(audits: DataFrame, rows: DataFrame) -> DataFrame:
    """``conv_id`` and ``repaired_sha256``: the turns of each conversation stream past its audit in order."""
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    first = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("number"))
    known = audits.select("conv_id")
    some = rows.filter(~F.col("dropped")).join(known.withColumnRenamed("conv_id", "__conv"), F.col("conv_id").eqNullSafe(F.col("__conv")), "left_semi")
    stream = first.unionByName(some.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "number"))
    stream = stream.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "kind", *_order()[1:])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convs: list = []
        digests: list[str] = []

        def rows_of() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(4)))

        given = rows_of()
        head = next(given, None)
        while head is not None:
            conv, _, _, audit = head
            head = None

            def turns() -> Iterator[tuple[str, str]]:
                nonlocal head
                for other, kind, role, text in given:
                    if kind == 0:
                        head = (other, kind, role, text)
                        return
                    yield role, text

            lines, left = _LineHash(), turns()
            for line in repaired_lines(audit, left):
                lines.add(line)
            # Every row has a letter, so all that is left is the next conversation's head.
            for _ in left:
                raise RuntimeError("a turn without an edit")
            convs.append(conv)
            digests.append(lines.sha.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(convs, arrow), pa.array(digests, pa.string())], names=["conv_id", "repaired_sha256"])

    arrow = to_arrow_type(rows.schema["conv_id"].dataType)
    return stream.select("conv_id", "kind", "role", "text").mapInArrow(run, f"conv_id {conv_type}, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (``conv_id``, ``turn``, ``role``, ``text``, ``dropped``): faults, cheapest repair and its digest.

    Rows count in the order of turn (null first), role, text. ``gaps`` are missing turn numbers, ``blank``, ``duplicate`` and ``truncated`` count the first
    fault of each row, ``illegal`` the neighbours whose roles may not follow each other. ``cost`` is that of the cheapest edits, ``audit`` their
    initials, the least in ASCII order, ``repaired_sha256`` the digest of the repaired ``role:text`` lines. A conversation of dropped rows
    only has zeros, an empty audit and the digest of an empty text; a null ``conv_id`` is a conversation like any other.
    """
    rows = stored(rows.select("conv_id", "turn", "role", "text", "dropped").withColumn("number", F.monotonically_increasing_id()))
    order = _order()
    # Ranges part a conversation of very many rows; each task sees consecutive rows.
    ordered = flag_repeats(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    solved = stored(_solve(ordered))
    results = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    parted = stored(_join_parts(solved.filter("part is not null")))
    digests = _digests(parted, rows).withColumnRenamed("conv_id", "__conv")
    late = parted.join(digests, F.col("conv_id").eqNullSafe(F.col("__conv"))).select(*results)
    return solved.filter("part is null").select(*results).unionByName(late)


def repair_conversations(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``repair`` of the ``damage`` of a table of conversations; other columns do not matter, an empty table gives an empty result."""
    made = repair(damage(conversations, conv_id, turn, role, text))
    return made.withColumnRenamed("conv_id", conv_id)


def repaired_turns(code_rows: Sequence[tuple[str, str, bool]]) -> list[str]:
    """The repaired lines of one short conversation in order: (role, text, repeated) of every row."""
    code = "".join((role[:1] if role[:1] in ("s", "u", "a") else "-") + _fault(text, repeated) for role, text, repeated in code_rows)
    return list(repaired_lines(cheapest(code)[1], [(role, text) for role, text, _ in code_rows]))
