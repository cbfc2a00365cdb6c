"""Exact deduplication with a split for heavy hitters.

A Misra-Gries summary of every partition names the digests that may be frequent. Their exact winners are few by proof and
are broadcast, so rows of large groups are settled where they lie; all other digests take an ordinary shuffle.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysweep.llm.common import arrow_pass, filter_by_row, stored, with_row

#: Counters of a Misra-Gries summary. At most COUNTERS + 1 digests are broadcast, whatever the input.
COUNTERS = 1024


def text_digests(docs: DataFrame, carry: Sequence[str], text: str = "text") -> DataFrame:
    """``carry`` and ``digest``: SHA-256 of the UTF-8 text with A-Z lower-cased; null counts as empty."""

    def work(batches: Iterator[list]) -> Iterator[list]:
        for texts in batches:
            # bytes.lower() changes A-Z only.
            yield [[hashlib.sha256((t or "").encode().lower()).digest() for t in texts]]

    return arrow_pass(docs, carry, text, work, [("digest", T.BinaryType())])


def merge_summary(summary: dict[bytes, int], more: Iterable[bytes], counters: int) -> dict[bytes, int]:
    """Misra-Gries: add counts, then subtract the (counters + 1)-th largest from all and drop what is not positive.

    A count is too small by at most (rows seen) / (counters + 1), never too large.
    """
    total = Counter(summary)
    total.update(more)
    if len(total) <= counters:
        return dict(total)
    cut = sorted(total.values(), reverse=True)[counters]
    return {k: n - cut for k, n in total.items() if n > cut}


def frequent_candidates(rows: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """Values of the binary column ``key`` that may be frequent: at most ``counters`` + 1 rows.

    Every value on more than 2 n / (counters + 1) of the n rows is among them. The summaries undercount by n / (counters
    + 1) at most in total, and their sum is at most n, which bounds the number of values above that.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary: dict[bytes, int] = {}
        for batch in batches:
            summary = merge_summary(summary, batch.column(0).to_pylist(), counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(summary), pa.binary()), pa.array(list(summary.values()), pa.int64())], names=[key, "seen"]
        )

    total = rows.count()
    merged = rows.select(key).mapInArrow(run, f"{key} binary, seen long").groupBy(key).agg(F.sum("seen").alias("seen"))
    return merged.filter(F.col("seen") * F.lit(counters + 1) > F.lit(total)).select(key)


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = (), counters: int = COUNTERS) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` and the ``carry`` columns.

    Texts are equal when they are identical after lower-casing A-Z. Of equal texts the row with the largest ``doc_id`` is
    kept (a null id is smaller than any other); of rows that also share the id exactly one. A null text is an empty text, and
    empty texts are equal to each other. An empty table gives an empty result.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"), *[c for c in carry if c != doc_id])
    rows = stored(with_row(text_digests(narrow, ["doc_id", *[c for c in carry if c != doc_id]], "__text"), "__row"))
    # COUNTERS + 1 rows at most, by proof.
    candidates = F.broadcast(stored(frequent_candidates(rows, "digest", counters)))
    best, count = F.max(F.struct("doc_id", "__row")), F.count(F.lit(1))
    winners = rows.join(candidates, "digest", "left_semi").groupBy("digest").agg(best.alias("best"), count.alias("group_size"))
    heavy = rows.join(F.broadcast(winners), "digest")
    group = W.partitionBy("digest")
    rest = rows.join(candidates, "digest", "left_anti").select("*", best.over(group).alias("best"), count.over(group).alias("group_size"))
    return heavy.unionByName(rest).select(
        *[c for c in carry if c != doc_id],
        F.col("doc_id").alias(doc_id),
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("best.__row") == F.col("__row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``docs`` with one row for every text, all columns as they are."""

    def kept(copy: DataFrame, row: str) -> DataFrame:
        return exact_duplicates(copy, carry=[row], counters=counters).filter("kept")

    return filter_by_row(docs, kept)
