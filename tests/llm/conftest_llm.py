"""Rows that every operator has to take."""

from __future__ import annotations

#: Null, empty and long texts, repeated rows, an id for two texts, a null id.
ODD_ROWS = [
    (1, None, None),
    (2, "", "a"),
    (3, "Same Text here", "a"),
    (3, "Same Text here", "a"),
    (3, "another text", "b"),
    (None, "same text HERE", "b"),
    (4, "word " * 30_000, "b"),
    (5, "x" * 120_000, None),
    (6, "É é SAME", "c"),
    (7, "é É same", "c"),
    (8, " \t\n ", "c"),
]
CLASHES = ["row", "size", "digest", "fp", "__row", "score", "copies", "kept", "key", "Dense"]
