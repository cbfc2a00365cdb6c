"""Connected components and greedy suppression as rounds of joins and mergeable aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skysweep.operators.grid import cell_of, cells_between, suffixed
from skysweep.session import cut_lineage


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Smallest member id of the component of every node: columns ``id`` and ``component``.

    ``nodes`` has ``id``, ``edges`` has ``src`` and ``dst``. Each round hangs trees of labels below smaller labels and
    halves their depth. All updates are minima, which combine before the shuffle, so a node with very many neighbours
    costs one row per task.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = cut_lineage(both.filter("src <> dst").distinct())
    # Nodes without neighbours are their own component and stay out of the rounds.
    labels = cut_lineage(both.groupBy("src").agg(F.min("dst").alias("near")).select(F.col("src").alias("id"), F.least("src", "near").alias("f")))
    for _ in range(max_rounds):
        parents = labels.select(F.col("id").alias("f"), F.col("f").alias("gf"))
        known = labels.join(parents, "f").select("id", "f", "gf")
        offers = both.join(known.select(F.col("id").alias("dst"), "gf"), "dst").groupBy("src").agg(F.min("gf").alias("m"))
        told = known.join(offers.withColumnRenamed("src", "id"), "id")
        proposals = F.array(
            F.struct(F.col("id").alias("id"), F.least("f", "gf", "m").alias("g")),
            F.struct(F.col("f").alias("id"), F.least("gf", "m").alias("g")),
        )
        lowest = told.select(F.explode(proposals).alias("p")).groupBy(F.col("p.id").alias("id")).agg(F.min("p.g").alias("g"))
        updated = labels.join(lowest, "id").select("id", F.least("f", "g").alias("f"), (F.col("g") < F.col("f")).alias("changed"))
        updated = cut_lineage(updated)
        labels = updated.select("id", "f")
        if updated.filter("changed").isEmpty():
            return nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("f", "id").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


# --- greedy suppression ------------------------------------------------------------------------------------------


def greedy_suppression(
    boxes: DataFrame,
    keys: Sequence[str],
    overlap: Column,
    threshold: float,
    order: Sequence[tuple[str, bool]],
    best_per_cell: int = 64,
    max_rounds: int = 10000,
) -> DataFrame:
    """Keep the boxes that sequential greedy suppression keeps: best first, dropping those that overlap a kept one.

    ``overlap`` reads columns suffixed ``_a`` and ``_b``; ``order`` lists (column, descending), the last one unique.

    Overlap above ``threshold`` needs sides alike within the factor 1/threshold and near centres, so a box meets only
    boxes of its own and the two adjoining size bins, in cells four times their size. A box is compared with at most
    the best ``best_per_cell`` of each cell. Where a cell holds more, a worse box counts as open until the better ones
    are settled, so results stay exact while a pile of copies costs a fixed number of comparisons per box.
    """
    ratio = 1.0 / threshold
    size = F.greatest("bbox_width", "bbox_length", F.lit(1e-6))
    bin_of = F.floor(F.log(size) / F.log(F.lit(ratio))).cast("int")
    bin_top = lambda b: F.pow(F.lit(ratio), b + 1)
    home = boxes.withColumns({"__size": size, "__bin": bin_of})
    home = home.withColumns(
        {f"__c{a}": cell_of(F.col(f"bbox_center_{a}"), 4 * bin_top(F.col("__bin"))) for a in "xy"}
    )
    shape = [f"bbox_center_{a}" for a in "xyz"] + ["bbox_width", "bbox_length", "bbox_height"]
    rank_columns = [name for name, _ in order]
    unique = rank_columns[-1]
    cell = [*keys, "__bin", "__cx", "__cy"]
    undecided = cut_lineage(home.select(*cell, "__size", *shape, *rank_columns))
    kept_parts: list[DataFrame] = []
    sort = [F.desc(c) if down else F.asc(c) for c, down in order]

    def better(x: str, y: str) -> Column:
        """Whether the row suffixed ``x`` precedes the row suffixed ``y``."""
        result, equal = F.lit(False), F.lit(True)
        for column, down in order:
            cx, cy = F.col(f"{column}{x}"), F.col(f"{column}{y}")
            result = result | (equal & (cx > cy if down else cx < cy))
            equal = equal & (cx == cy)
        return result

    for _ in range(max_rounds):
        ranked = undecided.withColumn("__rank", F.row_number().over(W.partitionBy(*cell).orderBy(*sort)))
        best = ranked.filter(F.col("__rank") <= best_per_cell + 1)
        # One row more than is compared tells whether the cell holds further boxes.
        best = cut_lineage(best)
        bins = F.array(*[F.col("__bin") + d for d in (-1, 0, 1)])
        probes = undecided.drop("__cx", "__cy").withColumn("__bin", F.explode(bins))
        reach = (F.col("__size") + bin_top(F.col("__bin"))) / 2
        side = 4 * bin_top(F.col("__bin"))
        for a in "xy":
            centre = F.col(f"bbox_center_{a}")
            probes = probes.withColumn(f"__c{a}", F.explode(cells_between(centre - reach, centre + reach, side)))
        met = suffixed(probes, "_b", cell).join(suffixed(best, "_a", cell), cell)
        past_best = F.col("__rank_a") > best_per_cell
        # The marker row waits as well: as it suppresses nobody in this round, it must not be kept in it.
        marker = past_best & (F.col(f"{unique}_a") == F.col(f"{unique}_b"))
        ahead = met.filter(better("_a", "_b") | marker)
        blocked = ahead.filter(past_best | (overlap > F.lit(threshold))).select(
            F.col(f"{unique}_b").alias("loser"),
            F.when(~past_best, F.col(f"{unique}_a")).alias("winner"),
        )
        pairs = cut_lineage(blocked.distinct())
        undecided, kept = _settle(undecided, pairs, unique)
        kept_parts.append(kept)
        if undecided.isEmpty():
            kept_ids = reduce(DataFrame.unionByName, kept_parts)
            return boxes.join(kept_ids, unique, "left_semi")
    raise RuntimeError(f"suppression did not settle in {max_rounds} rounds")


def _settle(undecided: DataFrame, pairs: DataFrame, unique: str) -> tuple[DataFrame, DataFrame]:
    """Apply the known comparisons until nothing more follows from them.

    A pair without a winner stands for better boxes not compared yet: its loser cannot be kept in this round.
    """
    kept = undecided.select(unique).join(pairs.select(F.col("loser").alias(unique)), unique, "left_anti")
    kept_all = cut_lineage(kept)
    fresh = kept_all
    dropped_all: DataFrame | None = None
    live = pairs
    while True:
        hit = live.join(fresh.select(F.col(unique).alias("winner")), "winner", "left_semi")
        dropped = cut_lineage(hit.select(F.col("loser").alias(unique)).distinct())
        dropped_all = dropped if dropped_all is None else dropped_all.unionByName(dropped)
        if dropped.isEmpty():
            break
        gone = dropped.select(F.col(unique).alias("gone"))
        # Pairs of a dropped loser are settled; a dropped winner no longer blocks.
        rest = live.join(gone, live.loser == gone.gone, "left_anti")
        before = rest.select("loser").distinct()
        live = cut_lineage(rest.join(gone, rest.winner == gone.gone, "left_anti"))
        fresh = cut_lineage(before.join(live.select("loser").distinct(), "loser", "left_anti").select(F.col("loser").alias(unique)))
        kept_all = kept_all.unionByName(fresh)
        if fresh.isEmpty():
            break
    decided = kept_all.select(unique).unionByName(dropped_all)
    return cut_lineage(undecided.join(decided, unique, "left_anti")), kept_all
