"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has three segments of at most 23 bits. Of two fingerprints with at most two differing bits one segment is equal
and another differs in one bit or none. The perfect Golay code decodes every 23-bit word to one codeword; a word decodes,
with each of its bits flipped in turn, to one or six codewords, and the codeword of any word at distance one is among
them. So one side looks up (equal segment, codeword) under all its codewords, the other is filed under its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysweep.llm.common import arrow_pass, filter_by_row, stored
from skysweep.operators.graph import connected_components

SHINGLE = 3
SEED = 42
MOST_BITS = 2
#: (lowest bit, bits) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints filed under one key that are compared one by one; larger groups meet through their flipped bits instead.
COMPARED = 24
_BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the shingles of a text, repeats included: a bit is 1 if it is set in over half of the hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, _BLOCK):
        part = words[start : min(start + _BLOCK, n) + shingle - 1]
        parts = zip(*(part[k:] for k in range(shingle))) if len(part) >= shingle else [part]
        hashes = np.array([digest(b" ".join(p), SEED) for p in parts], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, carry: Sequence[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``carry`` and the 64-bit ``fp`` of every text; a null text has the fingerprint of an empty one, zero."""

    def work(batches: Iterator[list]) -> Iterator[list]:
        for texts in batches:
            yield [np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)]

    return arrow_pass(docs, carry, text, work, [("fp", T.LongType())])


class Golay:
    """The perfect (23, 12) code with three correctable bits; a word is message << 11 | parity."""

    #: Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
    GENERATOR = 0b101011100011

    def __init__(self) -> None:
        self.parity = np.array([self._remainder(m << 11) for m in range(1 << 12)], dtype=np.int64)
        #: Message bits that the error with a given syndrome changes.
        self.fix = np.zeros(1 << 11, dtype=np.int64)
        bits = [1 << i for i in range(23)]
        for a in range(23):
            for b in range(a, 23):
                for c in range(b, 23):
                    error = bits[a] | bits[b] | bits[c]
                    self.fix[self.syndrome(np.int64(error))] = error >> 11
        self.flips = [(b >> 11, int(self.syndrome(np.int64(b)))) for b in bits]

    def _remainder(self, word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= self.GENERATOR << (bit - 11)
        return word

    def syndrome(self, words):
        return (words & 0x7FF) ^ self.parity[words >> 11]

    def decode(self, words: np.ndarray) -> np.ndarray:
        """Index of the nearest codeword."""
        return (words >> 11) ^ self.fix[self.syndrome(words)]

    def nearby(self, words: np.ndarray, bits: int) -> np.ndarray:
        """Codeword indices of every word and of the words with one of its lowest ``bits`` flipped: (words, bits + 1)."""
        syndromes, messages = self.syndrome(words), words >> 11
        found = [messages ^ self.fix[syndromes]]
        found += [messages ^ message ^ self.fix[syndromes ^ s] for message, s in self.flips[:bits]]
        return np.stack(found, axis=1)


def file_keys(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Look-up keys of fingerprints: (row, key, whether the fingerprint is filed under it)."""
    values = fps.view(np.uint64)
    parts = [((values >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS]
    rows, keys, filed = [], [], []
    for j, (_, bits) in enumerate(SEGMENTS):
        near = golay.nearby(parts[j], bits)
        own = near[:, 0].copy()
        near.sort(axis=1)
        new = np.ones(near.shape, dtype=bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        row, column = np.nonzero(new)
        codeword = near[row, column]
        for i in range(len(SEGMENTS)):
            if i != j:
                keys.append(((3 * i + j) << 34) | (parts[i][row] << 12) | codeword)
                rows.append(row)
                filed.append(codeword == own[row])
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(filed)


def lookup_keys(fps: DataFrame) -> DataFrame:
    """``fp``, ``key``, ``filed``: all keys under which a fingerprint looks, and whether it is filed there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            all_values = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(all_values), _BLOCK):
                values = all_values[start : start + _BLOCK]
                rows, keys, filed = file_keys(values, golay)
                yield pa.RecordBatch.from_arrays([pa.array(values[rows]), pa.array(keys), pa.array(filed)], names=["fp", "key", "filed"])

    return fps.select("fp").mapInArrow(run, "fp long, key long, filed boolean")


def near_links(fps: DataFrame, most_compared: int = COMPARED) -> DataFrame:
    """Links between distinct fingerprints (column ``fp``, each once) that join just those within two bits, perhaps by steps.

    Under a key with at most ``most_compared`` fingerprints all candidates are verified one by one. Fingerprints that look
    under a fuller key meet through the words they turn into by flipping one bit or none: two fingerprints share such a
    word just when they differ in at most two bits, and at most 65 fingerprints share one. So a pile costs 65 rows each.
    """
    keys = stored(lookup_keys(fps))
    filed = keys.filter("filed").select("key", F.col("fp").alias("other"))
    full = stored(filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_compared).select("key"))
    few = filed.join(full, "key", "left_anti")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= MOST_BITS
    compared = keys.select("fp", "key").join(few, "key").filter((F.col("fp") != F.col("other")) & close)
    links = compared.select(F.least("fp", "other").alias("src"), F.greatest("fp", "other").alias("dst"))
    crowded = keys.select("fp", "key").join(full, "key", "left_semi").select("fp").distinct()
    masks = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), b) for b in range(64)])
    words = crowded.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("word"))
    met = words.select("fp", F.min("fp").over(W.partitionBy("word")).alias("src")).filter("src <> fp")
    return links.unionByName(met.select("src", F.col("fp").alias("dst"))).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = (), shingle: int = SHINGLE) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (hexadecimal), ``component_id`` and the ``carry`` columns.

    Fingerprints link at two or fewer differing bits; ``component_id`` is the smallest id reachable over links, null only if
    all ids of a component are null. A null text is an empty text, empty texts have the fingerprint zero and link like any
    other. Repeated rows stay, each with its result. An empty table gives an empty result.
    """
    own = [c for c in carry if c != doc_id]
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"), *own)
    rows = stored(fingerprints(narrow, ["doc_id", *own], "__text", shingle))
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("smallest")))
    links = stored(near_links(distinct))
    # Only linked fingerprints take part in the rounds.
    linked = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    labels = stored(connected_components(linked, links).select(F.col("id").alias("fp"), "component"))
    named = distinct.join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    # Written out, so that the join below may split a fingerprint that many rows share.
    found = stored(named.join(smallest, "component").select("fp", "component_id"))
    return rows.join(found, "fp").select(F.col("doc_id").alias(doc_id), *own, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of every component: the smallest id, and of rows that share it the first."""

    def kept(copy: DataFrame, row: str) -> DataFrame:
        found = near_duplicates(copy, carry=[row])
        first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        # Rows that repeat the smallest id of a component.
        return first.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("other")).agg(F.min(row).alias(row))

    return filter_by_row(docs, kept)
