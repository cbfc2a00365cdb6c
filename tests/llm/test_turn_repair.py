"""Repair of conversations against a plain table of cheapest edits."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from itertools import product
from zlib import crc32

import pytest
from pyspark.sql import types as T

from skysweep.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, number string, digest string, kind string"
LEGAL = re.compile(r"(s?(ua)+)?\Z")
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(code):
    """Cost and audit by plain backward tables; states are the last letter written."""
    rows = [code[i : i + 2] for i in range(0, len(code), 2)]
    states = ["", "s", "u", "a"]
    never = (10**9, "")
    table = {q: (0, "") if q in ("", "a") else never for q in states}
    for at in range(len(rows), -1, -1):
        new = {}
        if at == len(rows):
            new = dict(table)
        else:
            role, fault = rows[at]
            for q in states:
                offers = [(table[q][0] + 4, "D" + table[q][1])]
                if fault not in "bd":
                    extra = 3 if fault == "t" else 0
                    for letter in NEXT[q]:
                        cost, audit = table[letter]
                        if letter == role:
                            offers.append((cost + extra, "K" + audit))
                        if letter != "s":
                            offers.append((cost + extra + 3, "R" + audit))
                new[q] = min(offers)
        for _ in range(4):
            for q in states:
                for letter in NEXT[q]:
                    if letter != "s":
                        new[q] = min(new[q], (new[letter][0] + 3, "I" + new[letter][1]))
        table = new
    return table[""]


def brute(rows):
    """The contract, row by row; ``rows`` are (conv_id, turn, role, text)."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        group = groups[conv]
        blank = lambda v: " " if v is None else str(v)
        kind = crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        group += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    found = {}
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, code, illegal, counts = set(), "", 0, dict.fromkeys("bdt", 0)
        for i, (turn, role, text) in enumerate(group):
            inner = text.strip(" \t\n\v\f\r")
            fault = "b" if not inner else "d" if (role, text) in seen else "k" if inner[-1] in ".!?" else "t"
            seen.add((role, text))
            counts[fault] = counts.get(fault, 0) + 1
            code += (role[:1] if role[:1] in ("s", "u", "a") else "-") + fault
            illegal += i > 0 and group[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        turns = [t for t, _, _ in group if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = cheapest(code)
        lines, given, state = [], iter(group), ""
        for letter in audit:
            _, role, text = (None, None, "") if letter == "I" else next(given)
            if letter != "D":
                if letter in "IR":
                    role = "assistant" if state == "u" else "user"
                state = role[0]
                lines.append(f"{role}:{text}")
        assert LEGAL.match("".join(line[0] for line in lines))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        found[conv] = (gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, digest)
    return found


def test_search_is_the_cheapest_and_least():
    letters = ["".join(p) for p in product("sua-", "kbdt")]
    for n in range(3):
        for rows in product(letters, repeat=n):
            assert turn_repair.search("".join(rows)) == cheapest("".join(rows))
    rng = random.Random(1)
    for _ in range(3000):
        code = "".join(rng.choice(letters) for _ in range(rng.randrange(3, 30)))
        assert turn_repair.search(code) == cheapest(code)


def test_blocks_change_nothing(monkeypatch):
    rng = random.Random(2)
    letters = ["sk", "uk", "uk", "ak", "ak", "ut", "at", "ab", "ud", "-k"]
    codes = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 120))) for _ in range(60)]
    want = [cheapest(c) for c in codes]
    for block in (1, 3, 16):
        monkeypatch.setattr(turn_repair, "BLOCK", block)
        assert [turn_repair.cheapest(c) for c in codes] == want


def odd_rows():
    rng = random.Random(3)
    texts = ["Yes.", "No", "", " \n\t", "Why? ", "Same!", "a.b", " ", "é!", None, "x" * 50_000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown", "User"]
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randrange(1, 12)):
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3, -2]), rng.choice(roles), rng.choice(texts)))
    rows += [rows[5]] * 3
    # Conversations of which nothing is left.
    rows += [(conv, 0, "user", "Gone.") for conv in range(2000, 2060)]
    # One conversation of very many rows, which ranges part, with copies of one row far apart.
    for turn in range(1500):
        rows.append((1000, turn, ["user", "assistant"][turn % 2 if turn % 7 else 0], f"Text {turn % 400}" + "." * (turn % 3)))
    rows += [(1000, 77, "user", "Again.")] * 40
    return rows


@pytest.mark.parametrize("ranges", [1, 8, 40])
def test_repair_equals_plain_python(spark, ranges):
    rows = odd_rows()
    want = brute(rows)
    assert any(v[6] == "" for v in want.values()) and None in want
    given = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = turn_repair.repair_conversations(given).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == len(want)
    assert {r.conv_id: tuple(r)[1:] for r in found} == want


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turn_repair.repair_conversations(empty).count() == 0
    names = T.StructType.fromDDL("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    assert [f.simpleString() for f in turn_repair.repair_conversations(empty).schema] == [f.simpleString() for f in names]


def test_repaired_turns():
    rows = [("user", "Hello.", False), ("user", "Are you there?", False), ("assistant", "Yes", False), ("user", " ", False)]
    assert turn_repair.repaired_turns(rows) == ["user:Hello.", "assistant:", "user:Are you there?", "assistant:Yes"]
