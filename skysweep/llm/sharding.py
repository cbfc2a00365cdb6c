"""Shards from a weighted hash tree: every document descends from region to rack to shard by weighted hash draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skysweep.llm.common import stored

#: regions > racks > {shard: weight}. Names of nodes are their positions, so they stay when regions, racks or shards follow.
Topology = list[list[dict[int, float]]]
SHARDS = 8
SEED = 20_011


def topology(shards: int = SHARDS) -> Topology:
    """The first eight shards lie in two regions of two racks; every further shard opens a region of its own.

    A new region takes rows only into itself, so one more shard moves nothing between the old ones.
    """
    tree: Topology = [[{} for _ in range(2)] for _ in range(2)]
    for s in range(min(shards, 8)):
        tree[s // 4][s // 2 % 2][s] = 1.0
    return [*tree, *[[{s: 1.0}] for s in range(8, shards)]]


def _weight(node) -> float:
    return sum(node.values()) if isinstance(node, dict) else sum(_weight(child) for child in node)


def _draw(key: Column, path: str, weight: float) -> Column:
    """An exponential time with rate ``weight`` from the hash of key and node; the smallest time wins.

    Raising the weight of a node shortens its own time only, so keys move into that node and nowhere else.
    """
    mixed = F.xxhash64(key, F.lit(path))
    uniform = (F.shiftrightunsigned(mixed, 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.log(uniform) / F.lit(float(weight))


def _first(times: Sequence[tuple[Column, int]]) -> Column:
    return F.least(*[F.struct(t.alias("t"), F.lit(i).alias("i")) for t, i in times])["i"] if len(times) > 1 else F.lit(times[0][1])


def _pick(index: Column, branches: Sequence[tuple[int, Column]]) -> Column:
    column = None
    for i, branch in branches:
        column = F.when(index == i, branch) if column is None else column.when(index == i, branch)
    return column


def descend(key: Column, tree: Topology, seed: int = SEED) -> Column:
    """Shard of ``key``: one draw among the regions, one among the racks of that region, one among the shards of that rack."""

    def shard_in(path: str, rack: dict[int, float]) -> Column:
        return _first([(_draw(key, f"{path}/{s}", w), s) for s, w in sorted(rack.items()) if w > 0])

    def within(path: str, racks: list[dict[int, float]]) -> Column:
        live = [(k, r) for k, r in enumerate(racks) if _weight(r) > 0]
        rack = _first([(_draw(key, f"{path}/{k}", _weight(r)), k) for k, r in live])
        return _pick(rack, [(k, shard_in(f"{path}/{k}", r)) for k, r in live])

    live = [(g, racks) for g, racks in enumerate(tree) if _weight(racks) > 0]
    region = _first([(_draw(key, f"{seed}/{g}", _weight(racks)), g) for g, racks in live])
    return _pick(region, [(g, within(f"{seed}/{g}", racks)) for g, racks in live])


def assign_shards(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its shard, its slot in the shard and the shard it would have with one shard more.

    The law is ``key``: id and number of shards decide, so repeated ids share a shard and a null id has one too. ``size`` is
    the number of UTF-8 bytes plus one; a null text has none and the checksum of an empty text. Slots count from 0 without
    gaps in the order of the input partitions; they are numbered inside (partition, shard) and moved up by the rows of
    earlier partitions, so no task sees a whole shard. An empty table gives an empty result.
    """
    key = F.col(doc_id)
    rows = stored(
        docs.select(
            key.alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
            descend(key, topology(shards)).alias("shard"),
            descend(key, topology(shards + 1)).alias("grown_shard"),
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("at"),
        )
    )
    counts = rows.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(W.partitionBy("part", "shard").orderBy("at")) - 1
    return rows.join(starts, ["part", "shard"]).select(
        F.col("doc_id").alias(doc_id), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + number).alias("slot"), "grown_shard"
    )
