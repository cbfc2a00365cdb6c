"""Voxel sampling, density clustering and the reference-box run."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysweep.functions.columns import label_of, pick_by_class
from skysweep.functions.ranks import pivot_percentiles, wide_percentiles
from skysweep.operators.boxfit import obb_yaw_pca
from skysweep.operators.hierarchy import density_hierarchy
from skysweep.operators.near import (
    WHOLE_GROUP,
    Space,
    cell_bounds,
    close_pairs,
    components_of_cells,
    first_of_component,
    link_cells,
    near_components,
    nearest_within,
    part_of,
    per_small_group,
    rows_by_group,
    rows_within,
    split_groups,
)
from skysweep.schema import FRAME, POSE, overlay_parameters
from skysweep.session import cut_lineage

XYZ = ("x", "y", "z")
CLASS_KEYS = [*FRAME, "class_id", "class_label"]
NOISE = -1
# Most centroids of a group that go along with each of its points.
FEW_CENTROIDS = 64
# Most points of a frame whose heights are gathered in one row (8 MB), and the share of them that counts as low.
WHOLE_FRAME = 1_000_000
LOW_SHARE = 0.05


def voxel_downsample(points: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """The first point, by point_id, of every voxel cell."""
    cell = [F.floor(F.col(a) / F.lit(float(size))).cast("long").alias(f"v{a}") for a in XYZ]
    rest = [c for c in points.columns if c not in keys]
    first = points.groupBy(*keys, *cell).agg(F.min_by(F.struct(*rest), "point_id").alias("p"))
    return first.select(*keys, "p.*").select(*points.columns)


def split_large(points: DataFrame, keys: Sequence[str], max_points: int) -> tuple[DataFrame, DataFrame]:
    """Points of groups up to and above the limit."""
    large = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > max_points).select(*keys)
    return points.join(large, list(keys), "left_anti"), points.join(large, list(keys), "left_semi")


def voxel_if_large(points: DataFrame, keys: Sequence[str], max_points: int, size: float) -> DataFrame:
    """Downsample only groups of more than ``max_points`` points."""
    small, large = split_large(points, keys, max_points)
    return small.unionByName(voxel_downsample(large, keys, size))


def _neighbour_counts(probes: DataFrame, rows: DataFrame, nodes: DataFrame, keys: Sequence[str], space: Space) -> DataFrame:
    """Keys, ``point_id`` and ``neighbours`` (rows within the radius, itself included) of every probe."""
    pairs, counted = rows_within(probes, rows, nodes, keys, "point_id", [], space, whole_cells=True)
    neighbours = pairs.groupBy(*keys, "point_id_a").agg(F.count(F.lit(1)).alias("n")).unionByName(counted)
    return neighbours.groupBy(*keys, F.col("point_id_a").alias("point_id")).agg(F.sum("n").alias("neighbours"))


def dbscan(points: DataFrame, keys: Sequence[str], eps: Column, min_samples: Column, borders: bool = True) -> DataFrame:
    """Density clusters per key: adds ``cluster`` (smallest core point_id, or -1 for noise).

    A point counts itself; the radius is inclusive. Border points take the cluster of their nearest core point. With
    ``borders=False`` only core points are clustered. ``eps`` and ``min_samples`` may read key columns.

    Groups of at most WHOLE_GROUP points are clustered as a whole, many to a call, larger ones over link cells.
    """
    clustered, large = _dbscan_of_small(points, keys, eps, min_samples, borders)
    clustered = cut_lineage(clustered)
    return clustered if large is None else clustered.unionByName(_dbscan_by_cells(large, keys, eps, min_samples, borders))


def _dbscan_of_small(
    points: DataFrame, keys: Sequence[str], eps: Column, min_samples: Column, borders: bool, smallest: int = 1
) -> tuple[DataFrame, DataFrame | None]:
    """``dbscan`` of the small groups, in which clusters of under ``smallest`` points are noise, and the points of the others."""
    small, large, total = split_groups(points, keys, WHOLE_GROUP)

    def work(group: dict[str, np.ndarray]) -> np.ndarray:
        order = np.argsort(group["id"], kind="stable")
        ids = group["id"][order]
        a, b, squared = close_pairs([group[c][order] for c in XYZ], group["eps"][0])
        core = np.bincount(a, minlength=len(ids)) >= np.maximum(group["least"][0], 1)
        linked = core[a] & core[b]
        cluster = np.where(core, ids[first_of_component(len(ids), a[linked], b[linked])], NOISE)
        if borders and core.any():
            edge = ~core[a] & core[b]
            a, b, squared = a[edge], b[edge], squared[edge]
            # Of equally near core points the first has the smallest id.
            by_row = np.lexsort((b, squared, a))
            found, first = np.unique(a[by_row], return_index=True)
            cluster[found] = cluster[b[by_row][first]]
        if smallest > 1:
            _, of, count = np.unique(cluster, return_inverse=True, return_counts=True)
            cluster = np.where(count[of] >= smallest, cluster, NOISE)
        result = np.empty_like(cluster)
        result[order] = cluster
        return result

    # A group without one of its keys has no radius, so its points are noise.
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    columns = {"id": F.col("point_id").cast("long"), "eps": F.when(known, eps.cast("double")), "least": min_samples.cast("double")}
    columns |= {a: F.col(a).cast("double") for a in XYZ}
    return per_small_group(small, keys, total, columns, work, "cluster"), large


def _dbscan_by_cells(points: DataFrame, keys: Sequence[str], eps: Column, min_samples: Column, borders: bool) -> DataFrame:
    """``dbscan`` of groups of any size.

    A link cell holding ``min_samples`` points is core as a whole, so only points of thinner cells search around them.
    """
    space = Space(XYZ, eps)
    rows, nodes = link_cells(points.select(*keys, "point_id", *XYZ), keys, "point_id", [space])
    rows = cut_lineage(rows)
    dense = F.col("cell_rows") >= min_samples
    thin = rows.filter(~dense)
    identity = [*keys, "point_id"]
    thin_core = _neighbour_counts(thin, rows, nodes, keys, space).filter(F.col("neighbours") >= min_samples).select(*identity)
    # Core points stay in the link cells they already have.
    core_rows = cut_lineage(rows.filter(dense).unionByName(thin.join(thin_core, identity, "left_semi").select(*rows.columns)))
    core_nodes = core_rows.groupBy(*keys, "node").agg(*cell_bounds("point_id", [space]))
    clustered = components_of_cells(core_rows, core_nodes, keys, [space], "cluster")
    if not borders:
        found = clustered.select(*identity, "cluster")
    else:
        clustered = cut_lineage(clustered)
        edge = thin.join(thin_core, identity, "left_anti")
        near = nearest_within(edge, clustered, core_nodes, keys, "point_id", "point_id", ["cluster"], space)
        near = near.select(*keys, F.col("point_id_a").alias("point_id"), F.col("cluster_b").alias("cluster"))
        found = clustered.select(*identity, "cluster").unionByName(near)
    return points.join(found, identity, "left").withColumn("cluster", F.coalesce("cluster", F.lit(NOISE).cast("long")))


def core_clusters(points: DataFrame, keys: Sequence[str], eps: Column, densities: Sequence[int], carry: Sequence[str] = ()) -> DataFrame:
    """Clusters of core points for several ``densities`` at once: keys, ``min_samples``, point_id, place, ``carry`` columns and ``cluster``.

    The same as ``dbscan`` with ``borders=False`` for each density, without noise. Link cells and neighbours do not depend on the
    density, so they are found once; only core points are repeated, once for every density that they reach.
    """
    space = Space(XYZ, eps)
    columns = [*keys, "point_id", *XYZ, *carry]
    rows, nodes = link_cells(points.select(*columns), keys, "point_id", [space])
    rows = cut_lineage(rows)
    wanted = sorted(set(densities))
    dense = F.col("cell_rows") >= F.lit(wanted[-1])
    thin = rows.filter(~dense)
    counts = _neighbour_counts(thin, rows, nodes, keys, space).filter(F.col("neighbours") >= F.lit(wanted[0]))
    known = rows.filter(dense).withColumn("neighbours", F.col("cell_rows")).unionByName(thin.join(counts, [*keys, "point_id"]).select(*rows.columns, "neighbours"))
    levels = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("min_samples")) for i, m in enumerate(wanted)])
    reached = F.filter(levels, lambda level: level["min_samples"] <= F.col("neighbours"))
    cores = known.withColumn("level", F.explode(reached))
    # A link cell is a node of its own for every density.
    node = F.col("node") * F.lit(len(wanted)) + F.col("level.i")
    cores = cut_lineage(cores.select(*columns, node.alias("node"), F.col("level.min_samples").alias("min_samples")))
    by = [*keys, "min_samples"]
    cells = cores.groupBy(*by, "node").agg(*cell_bounds("point_id", [space]))
    return components_of_cells(cores, cells, by, [space], "cluster").drop("node")


def core_clusters_of_groups(points: DataFrame, keys: Sequence[str], eps: Column, densities: Sequence[int], carry: Sequence[str] = ()) -> DataFrame:
    """``core_clusters``, with groups of at most WHOLE_GROUP points clustered as a whole, many to a call."""
    columns = [*keys, "point_id", *XYZ, *carry]
    points = points.select(*columns)
    small, large, total = split_groups(points, keys, WHOLE_GROUP)
    wanted = sorted(set(densities))
    schema = T.StructType([*points.schema.fields, T.StructField("min_samples", T.IntegerType()), T.StructField("cluster", T.LongType())])
    by = list(keys)

    def run(table: pa.Table) -> pa.Table:
        values = {c: table.column(f"__{c}").to_numpy() for c in ("id", "eps", *XYZ)}
        rows, labels = {m: [] for m in wanted}, {m: [] for m in wanted}
        for at in rows_by_group(table, by):
            at = at[np.argsort(values["id"][at], kind="stable")]
            ids = values["id"][at]
            a, b, _ = close_pairs([values[c][at] for c in XYZ], values["eps"][at[0]])
            neighbours = np.bincount(a, minlength=len(at))
            for m in wanted:
                core = neighbours >= max(m, 1)
                linked = core[a] & core[b]
                rows[m].append(at[core])
                labels[m].append(ids[first_of_component(len(at), a[linked], b[linked])][core])
        given = table.select(columns).take(pa.array(np.concatenate([r for m in wanted for r in rows[m]])))
        level = np.repeat(np.array(wanted, dtype=np.int32), [sum(map(len, rows[m])) for m in wanted])
        given = given.append_column("min_samples", pa.array(level))
        return given.append_column("cluster", pa.array(np.concatenate([v for m in wanted for v in labels[m]])))

    # Rows without a key, an id or a place have no neighbours.
    complete = small.dropna(subset=[*keys, "point_id", *XYZ])
    read = {"id": F.col("point_id").cast("long"), "eps": eps.cast("double")} | {a: F.col(a).cast("double") for a in XYZ}
    given = complete.select(*columns, *[c.alias(f"__{name}") for name, c in read.items()])
    whole = given.groupBy(part_of(keys, total)).applyInArrow(run, schema)
    return whole if large is None else whole.unionByName(core_clusters(large, keys, eps, wanted, carry))


def class_dbscan(points: DataFrame, params: dict[str, Any]) -> DataFrame:
    """Clusters per frame and class with the radius and density of the class."""
    setting = lambda name: pick_by_class({c: v[name] for c, v in params["dbscan"].items()})
    return dbscan(points.filter("class_id >= 0"), CLASS_KEYS, setting("eps").cast("double"), setting("min_samples"))


def cluster_centroids(clustered: DataFrame, keys: Sequence[str]) -> DataFrame:
    members = clustered.filter(F.col("cluster") != NOISE)
    return members.groupBy(*keys, "cluster").agg(*[F.avg(a).alias(a) for a in XYZ], F.count(F.lit(1)).alias("n"))


def merge_clusters(clustered: DataFrame, params: dict[str, Any]) -> DataFrame:
    """Unite clusters of a frame and class whose centroids are nearer than the class distance, also through others."""
    distances = {c: float(v["merge_distance"]) for c, v in params["merge"].items() if v["enabled"] and v["merge_distance"] > 0}
    if not distances:
        return clustered
    centroids = cluster_centroids(clustered, CLASS_KEYS).filter(F.col("class_label").isin(list(distances)))
    space = Space(XYZ, pick_by_class(distances), strict=True)
    merged = near_components(centroids, CLASS_KEYS, "cluster", [space], "merged").select(*CLASS_KEYS, "cluster", "merged")
    relabelled = clustered.join(merged, [*CLASS_KEYS, "cluster"], "left")
    return relabelled.withColumn("cluster", F.coalesce("merged", "cluster")).drop("merged")


def reassign_points(points: DataFrame, clustered: DataFrame, params: dict[str, Any]) -> DataFrame:
    """Give every original point the cluster with the nearest centroid, if nearer than a multiple of the radius."""
    multiple = float(params["reassign_radius_multiplier"])
    radius = pick_by_class({c: float(v["eps"]) * multiple for c, v in params["dbscan"].items()})
    space = Space(XYZ, radius, strict=True)
    centroids = cut_lineage(cluster_centroids(clustered, CLASS_KEYS).select(*CLASS_KEYS, "cluster", *XYZ))
    few, many, _ = split_groups(centroids, CLASS_KEYS, FEW_CENTROIDS)
    bare = points.drop("cluster")
    noise = F.lit(NOISE).cast("long")

    def distance(centroid: Column) -> Column:
        gaps = [F.col(a) - centroid[a] for a in XYZ]
        squared = reduce(lambda s, g: s + g * g, gaps[1:], gaps[0] * gaps[0])
        return F.struct(squared.alias("distance2"), centroid["cluster"].alias("cluster"))

    lists = few.groupBy(*CLASS_KEYS).agg(F.collect_list(F.struct(*XYZ, "cluster")).alias("__centroids"))
    within = F.filter(F.transform("__centroids", distance), lambda c: space.linked(c["distance2"]))
    met = bare.join(lists, CLASS_KEYS, "left")
    nearest = met.withColumn("cluster", F.coalesce(F.array_min(within)["cluster"], noise)).drop("__centroids")
    if many is None:
        return nearest
    # Points of groups with many centroids search among their cells.
    crowded = cut_lineage(many.select(*CLASS_KEYS).distinct())
    rows, nodes = link_cells(many, CLASS_KEYS, "cluster", [space])
    probes = bare.join(crowded, CLASS_KEYS, "left_semi")
    near = nearest_within(probes, rows, nodes, CLASS_KEYS, "point_id", "cluster", [], space)
    named = near.select(*CLASS_KEYS, F.col("point_id_a").alias("point_id"), F.col("cluster_b").alias("cluster"))
    found = probes.join(named, [*CLASS_KEYS, "point_id"], "left").withColumn("cluster", F.coalesce("cluster", noise))
    return nearest.join(crowded, CLASS_KEYS, "left_anti").unionByName(found)


def min_cluster_filter(clustered: DataFrame, keys: Sequence[str], smallest: Column) -> DataFrame:
    """Points of clusters that hold at least ``smallest`` points; noise goes."""
    members = clustered.filter(F.col("cluster") != NOISE)
    big = members.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= smallest)
    return members.join(big.select(*keys, "cluster"), [*keys, "cluster"], "left_semi")


def cluster_points(points: DataFrame, user: dict[str, Any] | None = None, thin_large: bool = False) -> DataFrame:
    """Obstacle points with their final cluster: cluster, merge, drop small clusters.

    All points are clustered. With ``thin_large`` groups above ``max_points_for_dbscan`` are voxel-sampled first and their
    points given back by nearest centroid, which is coarser.
    """
    params = overlay_parameters(user)
    bare = points.filter("class_id >= 0").select(*CLASS_KEYS, "point_id", *XYZ)
    if thin_large:
        small, large = split_large(bare, CLASS_KEYS, params["max_points_for_dbscan"])
        sampled = small.withColumn("sampled", F.lit(False)).unionByName(
            voxel_downsample(large, CLASS_KEYS, params["voxel_size"]).withColumn("sampled", F.lit(True))
        )
        merged = cut_lineage(merge_clusters(class_dbscan(sampled, params), params))
        given_back = reassign_points(large, merged.filter("sampled"), params)
        labelled = merged.filter("not sampled").drop("sampled").unionByName(given_back)
    else:
        labelled = cut_lineage(merge_clusters(class_dbscan(cut_lineage(bare), params), params))
    return min_cluster_filter(labelled, CLASS_KEYS, pick_by_class(params["min_cluster_points"]))


def extract_boxes(points: DataFrame, user: dict[str, Any] | None = None) -> DataFrame:
    """Oriented boxes of all obstacle clusters of all frames."""
    params = overlay_parameters(user)
    padding = pick_by_class({c: float(v) for c, v in params["bbox_padding"].items()})
    return obb_yaw_pca(cluster_points(points, user), [*CLASS_KEYS, "cluster"], padding)


def gt_boxes_run(points: DataFrame, frames: DataFrame, user: dict[str, Any] | None = None) -> DataFrame:
    """The seventeen-column box table of a run."""
    boxes = extract_boxes(points, user).join(frames.select(*FRAME, *POSE), FRAME)
    file = F.concat(F.lit("processed/"), "scene", F.format_string("/frame_%03d.parquet", F.col("pose_index")))
    return boxes.select(
        *FRAME,
        file.alias("frame_file"),
        *POSE,
        *[f"bbox_center_{a}" for a in XYZ],
        "bbox_width",
        "bbox_length",
        "bbox_height",
        "bbox_yaw",
        F.col("class_id").alias("class_ID"),
        label_of().alias("class_label"),
        "num_points",
    )


def run_statistics(boxes: DataFrame) -> DataFrame:
    """Per class of a run: boxes, mean, median and largest sides, points, and boxes per frame that has any."""
    sides = ("width", "length", "height")
    named = boxes.select("class_label", *FRAME, "num_points", *[F.col(f"bbox_{d}").alias(d) for d in sides])
    means = named.groupBy("class_label").agg(
        F.count(F.lit(1)).alias("n_boxes"),
        *[f(d).alias(f"{name}_{d}") for d in sides for name, f in (("mean", F.avg), ("max", F.max))],
        F.avg("num_points").alias("mean_points"),
    )
    medians = pivot_percentiles(
        wide_percentiles(named, ["class_label"], sides, [0.5]), ["class_label"], {(d, 0.5): f"median_{d}" for d in sides}
    )
    per_frame = named.groupBy("class_label", *FRAME).agg(F.count(F.lit(1)).alias("n"))
    objects = per_frame.groupBy("class_label").agg(F.avg("n").alias("mean_per_frame"), F.max("n").alias("max_per_frame"))
    return means.join(medians, "class_label").join(objects, "class_label")


def height_prefilter(points: DataFrame, min_height: float = 0.5, min_cluster_size: int = 30) -> DataFrame:
    """Points more than ``min_height`` above the 5th percentile of their frame.

    Frames with fewer points than the smallest cluster, before or after, are left out.
    """
    low = cut_lineage(_heights(points, min_height).filter((F.col("__n") >= min_cluster_size) & (F.col("__high") >= min_cluster_size)))
    return points.join(low.select(*FRAME, "__z"), FRAME).filter(F.col("z") - F.col("__z") > F.lit(min_height)).drop("__z")


def _heights(points: DataFrame, min_height: float) -> DataFrame:
    """Frames with their number of points, 5th percentile of height, and points more than ``min_height`` above it.

    Frames of at most WHOLE_FRAME points gather their heights in one row; larger ones are counted by steps.
    """
    heights = points.select(*FRAME, "z")
    small, large, _ = split_groups(heights, FRAME, WHOLE_FRAME)
    gathered = small.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("__n"), F.array_sort(F.collect_list("z")).alias("__s"))
    rank = F.lit(LOW_SHARE) * (F.size("__s") - 1)
    at = lambda place: F.get("__s", place.cast("int"))
    low = at(F.floor(rank)) + (at(F.ceil(rank)) - at(F.floor(rank))) * (rank - F.floor(rank))
    placed = gathered.filter(F.size("__s") > 0).withColumn("__z", low)
    above = F.size(F.filter("__s", lambda z: z - F.col("__z") > F.lit(min_height))).cast("long")
    found = placed.select(*FRAME, "__n", "__z", above.alias("__high"))
    if large is None:
        return found
    stats = wide_percentiles(large, FRAME, ["z"], [LOW_SHARE])
    met = large.join(pivot_percentiles(stats, FRAME, {("z", LOW_SHARE): "__z"}), FRAME)
    high = F.count_if(F.col("z") - F.col("__z") > F.lit(min_height)).alias("__high")
    return found.unionByName(met.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("__n"), F.first("__z").alias("__z"), high))


def density_cut(points: DataFrame, epsilon: float = 0.5, min_samples: int = 5, min_cluster_size: int = 30) -> DataFrame:
    """Class-free clusters of core points at one distance; clusters under ``min_cluster_size`` are noise."""
    eps, least = F.lit(float(epsilon)), F.lit(min_samples)
    whole, large = _dbscan_of_small(points, FRAME, eps, least, False, min_cluster_size)
    if large is None:
        return whole
    cored = _dbscan_by_cells(large, FRAME, eps, least, False)
    sizes = cored.groupBy(*FRAME, "cluster").agg(F.count(F.lit(1)).alias("__n"))
    sized = cored.join(sizes, [*FRAME, "cluster"])
    big = (F.col("cluster") != NOISE) & (F.col("__n") >= min_cluster_size)
    sized = sized.withColumn("cluster", F.when(big, F.col("cluster")).otherwise(F.lit(NOISE).cast("long"))).drop("__n")
    return whole.unionByName(sized)


def hierarchy_cut(points: DataFrame, reach: float, epsilon: float = 0.5, min_samples: int = 5, min_cluster_size: int = 30) -> DataFrame:
    """Class-free clusters of unlike density in every frame: the most stable ones of the density hierarchy up to ``reach``."""
    return density_hierarchy(points, FRAME, reach, min_samples, min_cluster_size, epsilon)
