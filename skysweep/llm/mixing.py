"""Mix sources to target weights: per source, fit a word budget exactly from the counts of documents by length."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysweep.llm.common import arrow_pass, filter_by_row, stored, with_row

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most this many times its words, and a document at most this many copies.
MOST = 3
SEED = 9_173
#: Words that the dynamic programme fits; the rest of a budget is spread over all lengths before.
FITTED_WORDS = 20_000
#: Rows of equal length that are ranked together; larger groups are cut by hash range.
RANKED_ROWS = 512


def word_counts(docs: DataFrame, carry: Sequence[str], text: str) -> DataFrame:
    """``carry`` and ``size``, the number of words between ASCII white space; null: 0."""

    def work(batches: Iterator[list]) -> Iterator[list]:
        for texts in batches:
            # bytes.split() cuts at ASCII white space only.
            yield [[len(t.encode().split()) if t else 0 for t in texts]]

    return arrow_pass(docs, carry, text, work, [("size", T.LongType())])


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of every source; the targets add up to all words.

    The budget is shared by weight; a source above ``most`` times its words stops there and the excess is shared again. A
    source stops when the words per unit of weight exceed its cap, so a round is one sum over the table of sources.
    """
    total = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")))
    # Number the sources in code-point order, null last, by ranges.
    spread = stored(
        total.repartitionByRange(F.col("source").isNull(), F.col("source")).select("*", F.spark_partition_id().alias("part"))
    )
    inside = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1
    # A row per partition.
    counts = spread.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.col("start") + inside
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = stored(spread.join(starts, "part").select("source", "source_size", weight.alias("weight")))
    cap = F.col("source_size") * F.lit(float(most))
    budget = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        stops = cap < F.lit(level) * F.col("weight")
        fixed, left = ranked.agg(F.sum(F.when(stops, cap)), F.sum(F.when(stops, 0.0).otherwise(F.col("weight")))).first()
        raised = (budget - (fixed or 0.0)) / left if left else level
        if raised <= level:
            break
        level = raised
    return ranked.select("source", "source_size", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def bounded_subset(lengths: np.ndarray, counts: np.ndarray, budget: int, above: int = 0) -> tuple[np.ndarray, int]:
    """How many documents of each length to take so that their words come as near to ``budget`` as possible, at most ``above`` over it.

    Bounded knapsack: the count of a length is cut into powers of two, and ``first[s]`` is the first such lot with which the sum
    s is reached. A sum's lot follows on sums reached by earlier lots, so walking back uses every lot once.
    """
    taken = np.zeros(len(lengths), dtype=np.int64)
    top = budget + above
    first = np.full(top + 1, -1, dtype=np.int64)
    reached = np.zeros(top + 1, dtype=bool)
    reached[0] = True
    lots: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        left, lot = min(int(counts[i]), top // length if length else 0), 1
        while left > 0 and not reached[budget]:
            lot = min(lot, left)
            words = lot * length
            new = np.zeros(top + 1, dtype=bool)
            new[words:] = reached[: top + 1 - words]
            new &= ~reached
            first[new] = len(lots)
            reached |= new
            lots.append((int(i), lot))
            left -= lot
            lot *= 2
    sums = np.flatnonzero(reached)
    best = int(sums[np.argmin(np.abs(sums - budget))])
    s = best
    while s:
        i, lot = lots[first[s]]
        taken[i] += lot
        s -= lot * int(lengths[i])
    return taken, best


def fit_budget(lengths: np.ndarray, counts: np.ndarray, target: float, most: int = MOST, fitted: int = FITTED_WORDS, over: bool = False) -> tuple[int, np.ndarray]:
    """Whole copies of every document, and how many copies more the documents of each length get together.

    The budget beyond whole copies goes to documents that fit into it: whole rounds of them while there is budget for a round
    (as when a giant document is too long for it), then one copy of a share of each length, fractions being carried on from
    long to short; the last ``fitted`` words or more are fitted by ``bounded_subset``. No document gets over ``most`` copies.
    A budget that cannot be met from below may be passed if ``over`` is set and that comes nearer to it.
    """
    extra = np.zeros(len(lengths), dtype=np.int64)
    words = int((lengths * counts).sum())
    if words == 0:
        return 1, extra
    copies = min(int(target // words), most)
    left = 0 if copies == most else int(round(target - copies * words))
    empty = lengths == 0
    extra[empty] = np.floor(counts[empty] * (left / words)).astype(np.int64)
    while True:
        room = ~empty & (lengths <= left) & (extra < counts * (most - copies))
        in_round = int((lengths * counts)[room].sum())
        if in_round == 0 or in_round > left:
            break
        rounds = min(left // in_round, int((most - copies - extra[room] // counts[room]).min()))
        extra[room] += rounds * counts[room]
        left -= rounds * in_round
    if in_round == 0:
        longer = np.flatnonzero(~empty & (extra < counts * (most - copies)))
        best, gap = extra, left
        for i in longer[np.argsort(lengths[longer])] if over else []:
            if gap == 0:
                break
            # One copy more of a document that does not fit, and back what that is too much.
            excess = int(lengths[i]) - left
            back, found = bounded_subset(lengths, np.where(empty, 0, extra), excess, gap - 1)
            if abs(excess - found) < gap:
                best, gap = extra - back, abs(excess - found)
                best[i] += 1
        extra = best
        return copies, extra
    share = left / in_round
    more = np.where(room, np.floor(counts * share), 0).astype(np.int64)
    left -= int((more * lengths).sum())
    carried = 0.0
    for i in np.argsort(-lengths, kind="stable"):
        if left <= fitted:
            break
        if room[i]:
            carried += float(lengths[i]) * (float(counts[i]) * share - float(more[i]))
            taken = int(min(counts[i] - more[i], carried // lengths[i], left // lengths[i]))
            more[i] += max(taken, 0)
            carried -= max(taken, 0) * float(lengths[i])
            left -= max(taken, 0) * int(lengths[i])
    before, budget = more.copy(), left
    # First documents that have no copy of this round yet, then any that may have one more.
    for limit in (np.where(room, counts, 0), np.where(empty, 0, counts * (most - copies) - extra)):
        if left > 0:
            chosen, found = bounded_subset(lengths, limit - more, left)
            more += chosen
            left -= found
    if over and left > 0:
        chosen, found = bounded_subset(lengths, np.where(empty, 0, counts * (most - copies) - extra) - before, budget, left - 1)
        if abs(found - budget) < left:
            more = before + chosen
    return copies, extra + more


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: int = SEED, doc_id: str = "doc_id", source: str = "source", text: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``, ``copies`` and ``carry``.

    Every source takes whole copies of all its documents and one copy more of some, chosen per length by a seeded hash of the
    id. A null source is a source, the last one; a null or empty text has no words and takes none. A source without words
    has the target 0 and keeps one copy of each row. Repeated rows count as documents of their own. An empty table gives an
    empty result. A histogram by length is small: d lengths need d * d / 2 words.
    """
    own = [c for c in carry if c not in (doc_id, source)]
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("__text"), *own)
    sizes = stored(with_row(word_counts(narrow, ["doc_id", "source", *own], "__text"), "__row"))
    targets = stored(source_targets(sizes, weights, most))
    # Nulls never join, so the source gets a key that marks them.
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("__source")
    histogram = stored(sizes.groupBy(key, "size").agg(F.count(F.lit(1)).alias("rows")))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size")
        copies, extra = fit_budget(frame["size"].to_numpy(), frame["rows"].to_numpy(), float(frame["target"].iloc[0]), most, over=True)
        return frame.assign(copies=copies, extra=extra)[["__source", "size", "rows", "source_size", "target", "copies", "extra"]]

    wanted = histogram.join(targets.select(key, "source_size", "target"), "__source")
    fitted = stored(
        wanted.groupBy("__source").applyInPandas(fit, "__source string, size long, rows long, source_size long, target double, copies int, extra long")
    )
    # Rank the documents of a length by hash; a large group is cut into hash ranges that are ranked one by one.
    ranges = F.ceil(F.col("rows") / RANKED_ROWS)
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11)
    ranged = sizes.withColumn("__source", key).join(fitted, ["__source", "size"]).withColumn("__hash", hashed)
    ranged = stored(ranged.withColumn("__range", F.floor(F.col("__hash") * F.lit(2.0**-53) * ranges)))
    group = ["__source", "size"]
    held = ranged.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__held"))
    before = W.partitionBy(*group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = held.select(*group, "__range", F.coalesce(F.sum("__held").over(before), F.lit(0)).alias("__start"))
    rank = F.col("__start") + F.row_number().over(W.partitionBy(*group, "__range").orderBy("__hash", "doc_id", "__row"))
    rounds = F.floor(F.col("extra") / F.col("rows"))
    copies = (F.col("copies") + rounds + (rank <= F.col("extra") - rounds * F.col("rows")).cast("int")).cast("int").alias("copies")
    return (
        ranged.join(starts, [*group, "__range"])
        .select("doc_id", "source", *own, "size", "source_size", "target", copies)
        .select(
            *[F.col("doc_id").alias(doc_id)] if doc_id not in own else [],
            *own,
            "size",
            "source_size",
            "target",
            (F.col("copies") * F.col("size")).cast("long").alias("taken"),
            "copies",
        )
    )


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: int = SEED, number: str | None = None) -> DataFrame:
    """``docs`` as the mix takes them: a row for every copy, no row for a document that gets none.

    Column ``number``, if named, counts the copies of a row from one.
    """
    def kept(copy: DataFrame, row: str) -> DataFrame:
        mix = mix_sources(copy, weights, most, seed, carry=[row]).filter("copies > 0")
        return mix.select(row, F.explode(F.sequence(F.lit(1), "copies")).alias(number or "__copy"))

    return filter_by_row(docs, kept, [] if number is None else [number])
