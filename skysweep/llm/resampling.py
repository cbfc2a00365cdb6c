"""Importance resampling towards a target corpus by hashed runs of words.

Texts are handled as UTF-8 bytes: a table of 256 bytes lower-cases and blanks what separates words, ``bytes.split`` gives the words,
and the checksum of a run is the seed of the checksum of the next longer one. Counters per task are summed by Spark.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysweep.llm.common import arrow_pass, bound_batches, filter_by_row, small_parts, stored

#: Longest run of words, buckets of the runs, documents of at least so many words that are drawn from, share of them in percent.
LONGEST, BUCKETS, LEAST_WORDS, SHARE, SEED = 3, 10_000, 20, 5, 42
#: Bytes of a text whose words are held at a time.
SLICE = 1 << 20


def _byte_table() -> bytes:
    """Digits, small letters and bytes from 0x80 on stay, capitals become small, all else becomes a blank."""
    stays = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes(b if b in stays else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


_TABLE = _byte_table()


def _slices(clean: bytes) -> Iterator[bytes]:
    """Cut a translated text at blanks."""
    start = 0
    while len(clean) - start > SLICE:
        cut = clean.find(b" ", start + SLICE)
        if cut < 0:
            break
        yield clean[start:cut]
        start = cut
    yield clean[start:] if start else clean


def run_buckets(text: bytes | None, buckets: int = BUCKETS, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray]]:
    """Words, and buckets of the runs that end at them, of one slice of a text after the other."""
    before: list[bytes] = []
    for part in _slices((text or b"").translate(_TABLE)):
        new = part.split()
        words = before + new
        spaced = [b" " + w for w in words]
        sums = list(map(crc32, words))
        found = sums[len(before) :]
        for size in range(1, longest):
            sums = list(map(crc32, spaced[size:], sums))
            # Runs that end before the slice were given with the slice before.
            found += sums[max(0, len(before) - size) :]
        yield len(new), np.array(found, dtype=np.int64) % buckets
        before = words[-(longest - 1) :] if longest > 1 else []


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``bucket`` and ``n``: runs of words of all texts per bucket; buckets without runs are left out."""
    bound_batches(texts.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for part in small_parts(batch):
                for value in part.column(0).to_pylist():
                    for _, found in run_buckets(value, buckets, longest):
                        total.update(found.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], names=["bucket", "n"])

    parts = texts.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share in ``target`` to its share in ``docs``, one count added to each bucket.

    Only these ``buckets`` numbers reach the driver.
    """
    tables = []
    for frame, column in ((docs, text), (target, target_text)):
        counts = np.zeros(buckets, dtype=np.int64)
        for row in bucket_counts(frame, column, buckets, longest).collect():
            counts[row.bucket] = row.n
        tables.append(counts)
    raw, wanted = tables
    all_raw, all_wanted = int(raw.sum()), int(wanted.sum())
    ratios = (((t + 1) * (all_raw + buckets)) / ((s + 1) * (all_wanted + buckets)) for s, t in zip(map(float, raw), map(float, wanted)))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], dtype=np.int64)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a standard Gumbel draw that depends on the seed and the id (a null id counts as an empty one)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    return F.floor(-1000 * F.log(-F.log(share))).cast("long")


def ranked(rows: DataFrame, order: Sequence[Column], rank: str) -> DataFrame:
    """``rows`` with their place (from 1) in ``order``, which must tell all rows apart.

    Sorted by ranges, numbered within each and moved up by the sizes of the ranges before, one number per range.
    """
    place = "__place"
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    placed = stored(placed)
    part = F.shiftright(F.col(place), 33)
    sizes = sorted(placed.groupBy(part.alias("part")).count().collect())
    before, starts = 0, []
    for number, n in sizes:
        starts.append((number, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts, "__part long, __before long")
    known = placed.join(F.broadcast(offsets), part == F.col("__part"))
    return known.withColumn(rank, F.col("__before") + F.col(place).bitwiseAND((1 << 33) - 1) + 1).drop(place, "__part", "__before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    share: int = SHARE,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    seed: int = SEED,
    row: str | None = None,
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank``, null for documents not drawn.

    Drawn are the highest scores, ``share`` percent of the documents with at least ``least_words`` words, so without
    replacement and with chances in proportion to exp(weight / 1000). Ties go to the smaller id (null first), of rows that share the id to the
    smaller weight, then any. Null and empty texts have no features and weight 0. Repeated rows stay. Empty tables, also an empty
    target, are fine. Other columns do not matter; a column named by ``row`` is returned too.
    """
    gains = bucket_gains(docs, target, text, target_text, buckets, longest)
    own = [] if row is None else [row]
    narrow = docs.select(F.col(doc_id).alias("doc_id"), *own, F.col(text).cast("binary").alias("__text"))

    def work(batches: Iterator[list]) -> Iterator[Sequence[list]]:
        for texts in batches:
            found = []
            for value in texts:
                words = features = weight = 0
                for new, runs in run_buckets(value, buckets, longest):
                    words, features, weight = words + new, features + len(runs), weight + int(gains[runs].sum())
                found.append((words, features, weight))
            yield tuple(zip(*found)) if found else ([], [], [])

    fields = [("__words", T.LongType()), ("n_features", T.LongType()), ("weight", T.LongType())]
    weighed = arrow_pass(narrow, ["doc_id", *own], "__text", work, fields).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    # The number makes the order strict, so that ranges can part any ties.
    weighed = stored(weighed.withColumn("__number", F.monotonically_increasing_id()))
    enough = F.col("__words") >= least_words
    drawn = weighed.filter(enough).count() * share // 100
    order = [F.desc("score"), F.asc("doc_id"), F.asc("weight"), F.asc("__number")]
    placed = ranked(weighed.filter(enough), order, "rank")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    every = placed.unionByName(weighed.filter(~enough).withColumn("rank", F.lit(None).cast("long")))
    return every.select(F.col("doc_id").alias(doc_id), *own, "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that ``resample`` draws, with all their columns."""

    def kept(copy: DataFrame, row: str) -> DataFrame:
        return resample(copy, target, doc_id, text, row=row, **settings).filter("rank is not null")

    return filter_by_row(docs, kept)
