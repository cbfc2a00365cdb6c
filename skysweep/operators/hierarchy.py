"""Density hierarchy: clusters of unlike density, chosen by their stability over all distances up to a reach.

Two points are as far apart as their mutual reachability, the largest of their distance and their two core distances. The
hierarchy is built from small distances to large ones. At every scale the parts of different components that lie in one
link cell are one node, and their number is bounded by the density that made them components; the closest pairs of nodes are the
edges of the scale. Components of a scale are merged by tasks of bounded size, and equal distances merge at once, so
results do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skysweep.operators.graph import connected_components
from skysweep.operators.grid import cell_of
from skysweep.operators.near import Space, closest_between, kth_distances, link_cells
from skysweep.session import cut_lineage

XYZ = ("x", "y", "z")
NOISE = -1
# Rows of the most crowded link cell at the smallest scale, and edges that one task merges.
MOST_ROWS = 32
MOST_EDGES = 200_000
MAX_SCALES = 40
# Distances below a nanometre count as one.
LEAST_SQUARE = 1e-18

EVENTS = "kind string, node long, cluster long, size long, length2 double"


def density_hierarchy(
    points: DataFrame,
    keys: Sequence[str],
    reach: float,
    min_samples: int = 5,
    min_cluster_size: int = 30,
    epsilon: float = 0.0,
    whole_trees: bool = True,
) -> DataFrame:
    """Adds ``cluster`` per key: the smallest point_id of the cluster, or -1 for noise.

    The core distance of a point is that to its ``min_samples``-th nearest other point. Going down from ``reach``, a component
    that falls into two or more parts of at least ``min_cluster_size`` points ends there and the parts are new clusters; smaller
    parts leave it. The stability of a cluster is the sum over its points of 1/distance at which they leave, less 1/distance at
    its birth. A cluster is taken if it is at least as stable as the best choice among its parts. Taken clusters born at
    ``epsilon`` or less give way to the nearest cluster above that was born beyond it.

    Components that are ``reach`` apart are trees of their own, born at ``reach``; ``whole_trees=False`` takes none of them whole.
    Points whose core distance exceeds ``reach`` are noise, as are those with a null or non-finite coordinate.
    """
    keys = list(keys)
    named = cut_lineage(points.select(*keys, "point_id", *XYZ).withColumn("uid", F.monotonically_increasing_id()))
    finite = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf")) & ~F.isnan(c) for c in XYZ])
    placed = with_core(named.filter(finite), keys, reach, min_samples)
    falls, merges, tops = merge_events(placed, keys, reach, min_cluster_size)
    tree = cluster_tree(falls, merges, tops, reach)
    chosen = choose(tree, epsilon, whole_trees)
    members = falls.join(chosen, "cluster").select("uid", "selected")
    labelled = named.join(members, "uid").select(*keys, "point_id", "selected")
    first = labelled.groupBy("selected").agg(F.min("point_id").alias("cluster"))
    found = labelled.join(first, "selected").select(*keys, "point_id", "cluster")
    return points.join(found, [*keys, "point_id"], "left").withColumn("cluster", F.coalesce("cluster", F.lit(NOISE).cast("long")))


def with_core(points: DataFrame, keys: Sequence[str], reach: float, min_samples: int) -> DataFrame:
    """Points with their squared core distance ``core2``, where it is at most ``reach``."""
    space = Space(XYZ, F.lit(float(reach)))
    rows, nodes = link_cells(points, keys, "uid", [space])
    rows = cut_lineage(rows)
    # A point is its own nearest row.
    core = kth_distances(rows, rows, nodes, keys, "uid", min_samples + 1, space)
    core = core.select(F.col("uid_a").alias("uid"), F.col("distance2").alias("core2"))
    return cut_lineage(points.join(core, "uid"))


def scales(placed: DataFrame, keys: Sequence[str], reach: float) -> list[float]:
    """Radii from ``reach`` down by halves until no link cell is crowded, smallest first."""
    found = [float(reach)]
    while len(found) < MAX_SCALES:
        side = found[-1] / 3**0.5 * (1 - 1e-9)
        cell = [cell_of(F.col(c), side).alias(f"c{c}") for c in XYZ]
        inner = placed.filter((F.col("core2") <= found[-1] ** 2) & (F.col("comp") == F.col("uid")))
        if inner.groupBy(*keys, *cell).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_ROWS).isEmpty():
            break
        found.append(found[-1] / 2)
    return found[::-1]


def merge_events(placed: DataFrame, keys: Sequence[str], reach: float, smallest: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All merges up to ``reach``: points that leave a cluster, clusters that end in a larger one, and the last clusters.

    ``falls`` has uid, cluster, length2; ``merges`` child, cluster, size, length2; ``tops`` cluster and size.
    """
    here = W.partitionBy(*keys, *XYZ)
    at_place = F.col("core2") == 0
    rows = placed.withColumn("comp", F.when(at_place, F.min("uid").over(here)).otherwise(F.col("uid")))
    rows = cut_lineage(rows)
    # Copies that are core at distance nought are components from the start, and clusters if they are many enough.
    nodes = rows.groupBy("comp").agg(F.count(F.lit(1)).alias("size"), F.max("uid").alias("last"))
    nodes = nodes.select(F.col("comp").alias("node"), "size", F.when(F.col("size") >= smallest, F.col("last")).alias("cluster"))
    nodes = cut_lineage(nodes)
    piles = nodes.filter("cluster is not null").select(F.col("node").alias("comp"), "cluster")
    rows = cut_lineage(rows.join(piles, "comp", "left").withColumn("free", F.col("cluster").isNull()))
    falls = [rows.filter("not free").select("uid", "cluster", F.lit(0.0).alias("length2"))]
    rows = rows.drop("cluster")
    merges = []
    for radius in scales(rows, keys, reach):
        inner = rows.filter(F.col("core2") <= radius**2)
        edges = cut_lineage(closest_between(inner, keys, "comp", "core2", Space(XYZ, F.lit(radius))))
        for limit, equal in steps(edges):
            light = edges if limit is None else edges.filter(F.col("length2") <= limit if equal else F.col("length2") < limit)
            if light.isEmpty():
                continue
            roots = rooted(light)
            joined = nodes.join(roots, "node")
            events = cut_lineage(merge_equal(joined, limit, smallest) if equal else merge_ordered(joined, light, roots, smallest))
            left = events.filter("kind = 'fall'").select(F.col("node").alias("comp"), "cluster", "length2")
            falls.append(rows.filter("free").join(left, "comp").select("uid", "cluster", "length2"))
            merges.append(events.filter("kind = 'merge'").select(F.col("node").alias("child"), "cluster", "size", "length2"))
            tops = events.filter("kind = 'top'").select("node", "size", "cluster")
            nodes = cut_lineage(nodes.join(roots, "node", "left_anti").unionByName(tops))
            fallen = left.select("comp", F.lit(True).alias("fallen"))
            rows = rows.join(fallen, "comp", "left").withColumn("free", F.col("free") & F.col("fallen").isNull()).drop("fallen")
            rows = cut_lineage(relabelled(rows, "comp", roots))
            if limit is not None:
                moved = relabelled(relabelled(edges, "src", roots), "dst", roots).filter("src <> dst")
                order = {"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")}
                edges = cut_lineage(moved.withColumns(order).groupBy("src", "dst").agg(F.min("length2").alias("length2")))
    empty = rows.sparkSession.createDataFrame([], "child long, cluster long, size long, length2 double")
    tops = nodes.filter("cluster is not null").select("cluster", "size")
    return cut_lineage(reduce(DataFrame.unionByName, falls)), cut_lineage(reduce(DataFrame.unionByName, merges, empty)), tops


def relabelled(df: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """The labels of ``column`` replaced by those of the components that they now belong to."""
    named = roots.select(F.col("node").alias(column), F.col("root").alias("__root"))
    return df.join(named, column, "left").withColumn(column, F.coalesce("__root", column)).drop("__root")


def rooted(edges: DataFrame) -> DataFrame:
    """Every end of an edge (``node``) with the smallest label of its component (``root``)."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return cut_lineage(connected_components(ends, edges).withColumnsRenamed({"id": "node", "component": "root"}))


def steps(edges: DataFrame) -> list[tuple[float | None, bool]]:
    """Lengths at which the merges of a scale are cut so that a task gets a bounded number of edges.

    ``(None, False)`` stands for all edges at once. Each cut takes the shorter edges first and then those that equal it, so a
    length that very many edges share is merged by aggregates alone. Cuts follow the largest component, not the number of all edges.
    """
    if edges.count() <= MOST_EDGES:
        return [(None, False)]
    of_root = edges.join(rooted(edges).withColumnRenamed("node", "src"), "src")
    large = of_root.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_EDGES)
    most = large.agg(F.max("n")).first()[0]
    if most is None:
        return [(None, False)]
    pieces = -(-most // MOST_EDGES)
    crowded = of_root.join(large, "root", "left_semi")
    shares = [i / pieces for i in range(1, pieces)]
    cuts = crowded.groupBy("root").agg(F.percentile_approx("length2", shares, 100 * pieces).alias("cuts"))
    cuts = cuts.select(F.explode("cuts").alias("cut")).agg(F.percentile_approx("cut", shares, 100 * pieces)).first()[0]
    return [(float(c), equal) for c in sorted(set(cuts)) for equal in (False, True)] + [(None, False)]


def merge_equal(joined: DataFrame, length2: float, smallest: int) -> DataFrame:
    """Events of merges at one length, which every edge has."""
    big = F.col("size") >= smallest
    whole = joined.groupBy("root").agg(
        F.sum("size").alias("total"), F.sum(big.cast("int")).alias("bigs"), F.max(F.when(big, F.col("cluster"))).alias("only"), F.max("node").alias("last")
    )
    kept = F.when(F.col("total") < smallest, F.lit(None)).when(F.col("bigs") == 1, F.col("only")).otherwise(F.col("last"))
    whole = whole.withColumns({"into": kept, "length2": F.lit(length2)})
    parts = joined.join(whole, "root").filter("into is not null")
    falls = parts.filter(~big).select(F.lit("fall").alias("kind"), "node", F.col("into").alias("cluster"), "size", "length2")
    ends = parts.filter(big & (F.col("bigs") > 1))
    ends = ends.select(F.lit("merge").alias("kind"), F.col("cluster").alias("node"), F.col("into").alias("cluster"), "size", "length2")
    tops = whole.select(F.lit("top").alias("kind"), F.col("root").alias("node"), F.col("into").alias("cluster"), F.col("total").alias("size"), "length2")
    return falls.unionByName(ends).unionByName(tops)


def merge_ordered(joined: DataFrame, edges: DataFrame, roots: DataFrame, smallest: int) -> DataFrame:
    """Events of merges by increasing length, one task per component of the step."""
    named = roots.select(F.col("node").alias("src"), F.col("root").alias("tree"))
    links_by_root = edges.join(named, "src").select("tree", "src", "dst", "length2").groupBy("tree")
    nodes = joined.select("root", "node", "size", "cluster")

    def solve(parts: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        return merged(parts, links, smallest)

    return nodes.groupBy("root").cogroup(links_by_root).applyInPandas(solve, EVENTS)


def merged(parts: pd.DataFrame, links: pd.DataFrame, smallest: int) -> pd.DataFrame:
    """Events of one component. A cluster is named by the largest label that ends in the merge that makes it."""
    size = dict(zip(parts["node"], parts["size"]))
    cluster = {n: None if pd.isna(c) else int(c) for n, c in zip(parts["node"], parts["cluster"])}
    head = {n: n for n in size}
    small_nodes = {n: [(n, s)] for n, s in size.items() if s < smallest}
    events: list[tuple] = []

    def find(n):
        while head[n] != n:
            head[n] = head[head[n]]
            n = head[n]
        return n

    links = links.sort_values("length2", kind="stable")
    lengths = links["length2"].to_numpy()
    ends = links[["src", "dst"]].to_numpy()
    cuts = np.flatnonzero(np.diff(lengths)) + 1
    for start, stop in zip([0, *cuts], [*cuts, len(lengths)]):
        length = float(lengths[start])
        touched: dict[int, None] = {}
        for a, b in ends[start:stop]:
            ra, rb = find(a), find(b)
            if ra != rb:
                touched[ra] = touched[rb] = None
                head[max(ra, rb)] = min(ra, rb)
        met: dict[int, list[int]] = {}
        for old in touched:
            met.setdefault(find(old), []).append(old)
        for root, olds in met.items():
            total = sum(size[o] for o in olds)
            bigs = [o for o in olds if size[o] >= smallest]
            if total < smallest:
                small_nodes[root] = [m for o in olds for m in small_nodes.pop(o)]
            else:
                into = cluster[bigs[0]] if len(bigs) == 1 else int(max(olds))
                if len(bigs) > 1:
                    events += [("merge", cluster[o], into, size[o], length) for o in bigs]
                for o in olds:
                    if size[o] < smallest:
                        events += [("fall", n, into, s, length) for n, s in small_nodes.pop(o)]
                cluster[root] = into
            size[root] = total
    last = int(parts["root"].iloc[0])
    events.append(("top", last, cluster[last], size[last], 0.0))
    out = pd.DataFrame(events, columns=["kind", "node", "cluster", "size", "length2"])
    return out.astype({"node": "int64", "cluster": "Int64", "size": "int64", "length2": "float64"})


def cluster_tree(falls: DataFrame, merges: DataFrame, tops: DataFrame, reach: float) -> DataFrame:
    """Per cluster its ``parent``, the ``birth`` distance and its ``stability``."""
    weight = lambda length2: F.lit(1.0) / F.sqrt(F.greatest(length2, F.lit(LEAST_SQUARE)))
    gains = falls.select("cluster", weight(F.col("length2")).alias("gain"))
    gains = gains.unionByName(merges.select("cluster", (F.col("size") * weight(F.col("length2"))).alias("gain")))
    gained = gains.groupBy("cluster").agg(F.sum("gain").alias("gain"))
    born = merges.select(F.col("child").alias("cluster"), F.col("cluster").alias("parent"), "size", "length2")
    trees = tops.select("cluster", F.lit(None).cast("long").alias("parent"), "size", F.lit(float(reach) ** 2).alias("length2"))
    tree = born.unionByName(trees).join(gained, "cluster")
    stability = F.col("gain") - F.col("size") * weight(F.col("length2"))
    return cut_lineage(tree.select("cluster", "parent", F.sqrt("length2").alias("birth"), stability.alias("stability")))


def choose(tree: DataFrame, epsilon: float, whole_trees: bool = True) -> DataFrame:
    """The taken cluster (``selected``) that each cluster lies in; clusters outside all taken ones are left out."""
    # Of taken clusters above one another the uppermost counts.
    upper = marked_above(tree, most_stable(tree, whole_trees), uppermost=True)
    if epsilon <= 0:
        return upper.withColumnRenamed("marked", "selected")
    wide = F.col("birth") > F.lit(float(epsilon))
    if whole_trees:
        wide_enough = tree.filter(wide | F.col("parent").isNull())
    else:
        trees = tree.filter("parent is null").select(F.col("cluster").alias("parent"))
        wide_enough = tree.filter(wide & F.col("parent").isNotNull()).select("cluster")
        wide_enough = wide_enough.unionByName(tree.join(trees, "parent", "left_semi").select("cluster")).distinct()
    taken = upper.select(F.col("marked").alias("cluster")).distinct()
    raised = marked_above(tree, wide_enough.select("cluster")).join(taken, "cluster", "left_semi")
    final = raised.select(F.col("marked").alias("cluster")).distinct()
    return marked_above(tree, final).withColumnRenamed("marked", "selected")


def most_stable(tree: DataFrame, whole_trees: bool) -> DataFrame:
    """Clusters at least as stable as the best choice among their parts, from the leaves up."""
    counts = tree.filter("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.count(F.lit(1)).alias("parts"))
    start = tree.join(counts, "cluster", "left").withColumn("parts", F.coalesce("parts", F.lit(0)))
    # Sums of the same parts may differ in the last digits.
    own = (F.col("parts") == 0) | (F.col("stability") >= F.col("inner") - F.lit(1e-9) * F.abs("inner"))
    if not whole_trees:
        own = own & F.col("parent").isNotNull()
    state = cut_lineage(start.withColumns({"value": F.lit(None).cast("double"), "own": F.lit(False)}))
    while not state.filter("value is null").isEmpty():
        below = state.filter("parent is not null and value is not null").groupBy(F.col("parent").alias("cluster"))
        below = below.agg(F.sum("value").alias("inner"), F.count(F.lit(1)).alias("settled"))
        known = state.join(below, "cluster", "left").withColumns({"inner": F.coalesce("inner", F.lit(0.0)), "settled": F.coalesce("settled", F.lit(0))})
        ready = F.col("value").isNull() & (F.col("settled") == F.col("parts"))
        decided = known.withColumn("own", F.when(ready, own).otherwise(F.col("own")))
        worth = F.when(F.col("own"), F.greatest("stability", F.lit(0.0))).otherwise(F.col("inner"))
        state = cut_lineage(decided.withColumn("value", F.when(ready, worth).otherwise(F.col("value"))).select(*state.columns))
    return state.filter("own").select("cluster")


def marked_above(tree: DataFrame, marks: DataFrame, uppermost: bool = False) -> DataFrame:
    """The nearest cluster of ``marks`` at or above each cluster (``marked``), or the uppermost, by doubled jumps.

    Clusters without one are left out.
    """
    flagged = tree.select("cluster", "parent").join(marks.select("cluster", F.col("cluster").alias("marked")), "cluster", "left")
    onward = F.col("parent") if uppermost else F.when(F.col("marked").isNull(), F.col("parent"))
    state = cut_lineage(flagged.select("cluster", "marked", onward.alias("jump")))
    while not state.filter("jump is not null").isEmpty():
        further = state.select(F.col("cluster").alias("jump"), F.col("marked").alias("m2"), F.col("jump").alias("j2"))
        marked = F.coalesce("m2", "marked") if uppermost else F.coalesce("marked", "m2")
        state = cut_lineage(state.join(further, "jump", "left").select("cluster", marked.alias("marked"), F.col("j2").alias("jump")))
    return state.filter("marked is not null").select("cluster", "marked")
