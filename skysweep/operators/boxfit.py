"""Oriented boxes of clusters, their features, geometric rules and cable detection."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysweep.functions.columns import rnd, wrap_angle
from skysweep.operators.near import WHOLE_GROUP, Space, near_components, part_of, rows_by_group, split_groups
from skysweep.schema import BACKGROUND_ID, CLASS_NAMES
from skysweep.session import cut_lineage

# Covariances are rounded here so that a cluster without a direction has none in any order of summation.
COV_DIGITS = 9
# Centre, sides and edge angle of a rectangle.
_RECTANGLE = ("cx", "cy", "along", "across", "angle")


def obb_yaw_pca(points: DataFrame, keys: Sequence[str], padding: Column | float = 0.0) -> DataFrame:
    """Box along the main horizontal axis of every cluster; under three points along the coordinate axes."""
    keys = list(keys)
    moments = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_points"),
        F.var_samp("x").alias("cxx"),
        F.var_samp("y").alias("cyy"),
        F.covar_samp("x", "y").alias("cxy"),
    )
    cxx, cyy, cxy = (rnd(c, COV_DIGITS) for c in ("cxx", "cyy", "cxy"))
    yaw = F.when(F.col("num_points") < 3, 0.0).otherwise(0.5 * F.atan2(2 * cxy, cxx - cyy))
    turned = points.join(moments.select(*keys, "num_points", yaw.alias("bbox_yaw")), keys)
    c, s = F.cos("bbox_yaw"), F.sin("bbox_yaw")
    along, across = F.col("x") * c + F.col("y") * s, F.col("y") * c - F.col("x") * s
    spans = {"u": along, "v": across, "z": F.col("z")}
    extents = turned.withColumns({"u": spans["u"], "v": spans["v"]}).groupBy(*keys, "num_points", "bbox_yaw").agg(
        *[f(a).alias(f"{a}_{n}") for a in spans for f, n in ((F.min, "lo"), (F.max, "hi"))]
    )
    pad = 2 * (padding if isinstance(padding, Column) else F.lit(float(padding)))
    middle = {a: (F.col(f"{a}_lo") + F.col(f"{a}_hi")) / 2 for a in spans}
    side = {a: F.greatest(F.col(f"{a}_hi") - F.col(f"{a}_lo"), F.lit(0.1)) + pad for a in spans}
    return extents.select(
        *keys,
        (middle["u"] * c - middle["v"] * s).alias("bbox_center_x"),
        (middle["u"] * s + middle["v"] * c).alias("bbox_center_y"),
        middle["z"].alias("bbox_center_z"),
        side["u"].alias("bbox_width"),
        side["v"].alias("bbox_length"),
        side["z"].alias("bbox_height"),
        "bbox_yaw",
        "num_points",
    )


# --- minimum-area rectangle --------------------------------------------------------------------------------------


def _hull(xy: np.ndarray) -> np.ndarray:
    """Corner points of the convex hull, counter-clockwise."""
    known = xy[~np.isnan(xy).any(axis=1)]
    ordered = known[np.lexsort((known[:, 1], known[:, 0]))]
    ordered = ordered[np.r_[True, (np.diff(ordered, axis=0) != 0).any(axis=1)][: len(ordered)]]
    if len(ordered) < 3:
        return ordered

    def half(chain: list[list[float]]) -> list[list[float]]:
        corners: list[list[float]] = []
        for p in chain:
            while len(corners) > 1:
                (ox, oy), (ex, ey) = corners[-2], corners[-1]
                if (ex - ox) * (p[1] - ey) - (ey - oy) * (p[0] - ex) > 0:
                    break
                corners.pop()
            corners.append(p)
        return corners[:-1]

    chain = ordered.tolist()
    return np.array(half(chain) + half(chain[::-1]))


def _smallest_rectangle(corners: np.ndarray) -> tuple[float, float, float, float, float] | None:
    """Centre x and y, side along the edge, side across it and edge angle; None for a flat hull."""
    if len(corners) < 3:
        return None
    edges = np.roll(corners, -1, axis=0) - corners
    angles = np.arctan2(edges[:, 1], edges[:, 0])
    c, s = np.cos(angles), np.sin(angles)
    # Corners by edges: the extent of all corners along and across every edge.
    u = corners[:, :1] * c + corners[:, 1:] * s
    v = corners[:, 1:] * c - corners[:, :1] * s
    i = int((np.ptp(u, axis=0) * np.ptp(v, axis=0)).argmin())
    mu, mv = (u[:, i].min() + u[:, i].max()) / 2, (v[:, i].min() + v[:, i].max()) / 2
    best = (mu * c[i] - mv * s[i], mu * s[i] + mv * c[i], np.ptp(u[:, i]), np.ptp(v[:, i]), angles[i])
    return tuple(float(value) for value in best)


def outer_points(points: DataFrame, keys: Sequence[str], directions: int = 16) -> DataFrame:
    """Points that may be corners of the hull of their cluster: those not inside the polygon of the extreme points.

    The polygon joins the farthest points in evenly spaced directions, found by mergeable maxima, so few points of a
    large cluster remain.
    """
    turns = [2 * math.pi * k / directions for k in range(directions)]
    farthest = [
        F.max_by(F.struct("x", "y"), F.col("x") * F.lit(math.cos(t)) + F.col("y") * F.lit(math.sin(t))).alias(f"__e{k}") for k, t in enumerate(turns)
    ]
    bounded = points.join(points.groupBy(*keys).agg(*farthest), list(keys))
    inside, has_edge = F.lit(True), F.lit(False)
    for k in range(directions):
        start, end = F.col(f"__e{k}"), F.col(f"__e{(k + 1) % directions}")
        to_left = (end["x"] - start["x"]) * (F.col("y") - start["y"]) - (end["y"] - start["y"]) * (F.col("x") - start["x"]) > F.lit(1e-9)
        inside, has_edge = inside & ((start == end) | to_left), has_edge | (start != end)
    # A cluster of copies of one point has no polygon.
    return bounded.filter(~(inside & has_edge)).drop(*[f"__e{k}" for k in range(directions)])


def hull_corners(points: DataFrame, keys: Sequence[str], shards: int = 32) -> DataFrame:
    """Corner points of the horizontal convex hull of every cluster.

    Inner points are dropped first. The hull of hulls is the hull: every Arrow batch and then every shard of a cluster is reduced to its corners, so the
    last step sees a few corner points per cluster however many points the cluster holds.
    """
    keys = list(keys)
    schema = points.select(*keys, "x", "y").schema
    names = schema.names

    def reduce_frame(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for key, group in pdf.groupby(keys, sort=False, dropna=False):
            corners = _hull(group[["x", "y"]].to_numpy())
            part = pd.DataFrame(corners, columns=["x", "y"])
            for name, value in zip(keys, key if isinstance(key, tuple) else (key,)):
                part[name] = value
            parts.append(part[names])
        return pd.concat(parts) if parts else pdf[names]

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield reduce_frame(pdf)

    partial = outer_points(points.select(*names), keys).mapInPandas(per_batch, schema)
    sharded = partial.withColumn("__shard", F.spark_partition_id() % shards)
    return sharded.groupBy(*keys, "__shard").applyInPandas(lambda pdf: reduce_frame(pdf), schema)


def _rectangles_of_small(points: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Keys, ``n_points``, heights and smallest rectangle of every cluster of four or more points; many clusters go to one call."""
    fields = [f for f in points.schema.fields if f.name in keys]
    kept = [f.name for f in fields]
    numbers = [T.StructField(name, T.DoubleType()) for name in ("__z0", "__z1", *_RECTANGLE)]
    schema = T.StructType([*fields, T.StructField("n_points", T.LongType()), *numbers])

    def run(table: pa.Table) -> pa.Table:
        x, y, z = (table.column(a).to_numpy() for a in "xyz")
        xy = np.stack([x, y], axis=1)
        clusters = [at for at in rows_by_group(table, kept) if len(at) >= 4]
        found = [(np.fmin.reduce(z[at]), np.fmax.reduce(z[at]), *(_smallest_rectangle(_hull(xy[at])) or (None,) * 5)) for at in clusters]
        named = table.select(kept).take(pa.array([at[0] for at in clusters], pa.int64()))
        named = named.append_column("n_points", pa.array([len(at) for at in clusters], pa.int64()))
        for i, number in enumerate(numbers):
            named = named.append_column(number.name, pa.array([row[i] for row in found], pa.float64(), from_pandas=True))
        return named

    return points.groupBy(part_of(kept, rows)).applyInArrow(run, schema)


def _rectangles_of_large(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for clusters of any size, over the corners of their hulls."""
    sums = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"), F.min("z").alias("__z0"), F.max("z").alias("__z1")
    ).filter("n_points >= 4")
    corners = hull_corners(points.join(sums.select(*keys), keys, "left_semi"), keys)
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.select(*keys).schema)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _smallest_rectangle(_hull(pdf[["x", "y"]].to_numpy()))
        row = {name: pdf[name].iloc[0] for name in keys}
        row |= dict(zip(_RECTANGLE, found or (None,) * 5))
        return pd.DataFrame([row])

    rectangles = corners.groupBy(*keys).applyInPandas(fit, ", ".join([key_schema, *[f"{name} double" for name in _RECTANGLE]]))
    return sums.join(rectangles, keys)


def obb_min_area(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest-area upright box of every cluster of four or more points; the longer side is the length.

    A cluster whose points lie on one horizontal line takes its principal-axes box. Clusters of at most WHOLE_GROUP points are
    fitted many to a call, larger ones over the corners of their hulls.
    """
    keys = list(keys)
    points = points.select(*keys, *[F.col(a).cast("double").alias(a) for a in "xyz"]).dropna(subset=keys)
    small, large, total = split_groups(points, keys, WHOLE_GROUP)
    both = _rectangles_of_small(small, keys, total)
    if large is not None:
        both = both.unionByName(_rectangles_of_large(large, keys))
    # Read twice, for upright and for flat clusters.
    both = cut_lineage(both)
    turn = F.when(F.col("across") > F.col("along"), F.col("angle") + F.pi() / 2).otherwise(F.col("angle"))
    length, width = F.greatest("along", "across"), F.least("along", "across")
    height = F.col("__z1") - F.col("__z0")
    upright = both.filter(F.col("cx").isNotNull()).select(
        *keys,
        F.col("cx").alias("bbox_center_x"),
        F.col("cy").alias("bbox_center_y"),
        ((F.col("__z0") + F.col("__z1")) / 2).alias("bbox_center_z"),
        length.alias("bbox_length"),
        width.alias("bbox_width"),
        height.alias("bbox_height"),
        wrap_angle(turn).alias("bbox_yaw"),
        (length * width * height).alias("bbox_volume"),
        "n_points",
    )
    flat = both.filter(F.col("cx").isNull()).select(*keys)
    return upright.unionByName(obb_pca3d(points.join(flat, keys, "left_semi"), keys))


# --- principal axes ----------------------------------------------------------------------------------------------

_SECOND = ["xx", "xy", "xz", "yy", "yz", "zz"]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _axes(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.Series:
    """Eigenvectors of symmetric 3x3 matrices, largest eigenvalue first, each with its largest entry positive."""
    m = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], axis=1).reshape(-1, 3, 3)
    vectors = np.linalg.eigh(m)[1][:, :, ::-1]
    lead = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=1)[:, None, :], axis=1)
    vectors = vectors * np.where(lead < 0, -1.0, 1.0)
    return pd.Series(list(vectors.transpose(0, 2, 1).reshape(-1, 9)))


def principal_axes(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean point and the three axes of every cluster; axis ``k`` is ``axes[3k .. 3k+2]``."""
    moments = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"),
        *[F.avg(a).alias(f"mean_{a}") for a in "xyz"],
        *[F.covar_samp(p[0], p[1]).alias(p) for p in _SECOND],
    )
    axes = _axes(*[rnd(p, COV_DIGITS) for p in _SECOND])
    return moments.filter("n_points > 1").select(*keys, "n_points", *[f"mean_{a}" for a in "xyz"], axes.alias("axes"))


def principal_direction(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First principal axis of every cluster; the sign is fixed by its largest entry."""
    axes = principal_axes(points, keys)
    return axes.select(*keys, "n_points", *[F.col("axes")[i].alias(f"d{a}") for i, a in enumerate("xyz")])


def obb_pca3d(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Box along the three principal axes of every cluster of four or more points."""
    keys = list(keys)
    axes = principal_axes(points, keys).filter("n_points >= 4")
    placed = points.select(*keys, "x", "y", "z").join(axes, keys)
    step = {a: F.col(a) - F.col(f"mean_{a}") for a in "xyz"}
    along = {
        f"p{k}": sum((step[a] * F.col("axes")[3 * k + i] for i, a in enumerate("xyz")), F.lit(0.0)) for k in range(3)
    }
    extents = placed.withColumns(along).groupBy(*keys).agg(
        F.first("n_points").alias("n_points"),
        F.first("axes").alias("axes"),
        *[F.first(f"mean_{a}").alias(f"mean_{a}") for a in "xyz"],
        *[f(p).alias(f"{p}_{n}") for p in along for f, n in ((F.min, "lo"), (F.max, "hi"))],
    )
    side = [F.col(f"p{k}_hi") - F.col(f"p{k}_lo") for k in range(3)]
    middle = [(F.col(f"p{k}_hi") + F.col(f"p{k}_lo")) / 2 for k in range(3)]
    centre = [
        F.col(f"mean_{a}") + sum((middle[k] * F.col("axes")[3 * k + i] for k in range(3)), F.lit(0.0))
        for i, a in enumerate("xyz")
    ]
    yaw = F.atan2(F.col("axes")[1], F.col("axes")[0])
    yaw = F.when(side[1] > side[0], yaw + F.pi() / 2).otherwise(yaw)
    return extents.select(
        *keys,
        *[centre[i].alias(f"bbox_center_{a}") for i, a in enumerate("xyz")],
        F.greatest(side[0], side[1]).alias("bbox_length"),
        F.least(side[0], side[1]).alias("bbox_width"),
        side[2].alias("bbox_height"),
        wrap_angle(yaw).alias("bbox_yaw"),
        (side[0] * side[1] * side[2]).alias("bbox_volume"),
        "n_points",
    )


# --- features and rules ------------------------------------------------------------------------------------------


def cluster_features(points: DataFrame, boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Eighteen features per cluster from its box and the heights of its points."""
    heights = points.groupBy(*keys).agg(
        F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.avg("z").alias("z_mean"), F.stddev_pop("z").alias("z_std")
    )
    floor = lambda c: F.greatest(c, F.lit(0.01))
    length, width, height = F.col("bbox_length"), F.col("bbox_width"), F.col("bbox_height")
    return boxes.join(heights, list(keys)).withColumns(
        {
            "aspect_lw": length / floor(width),
            "aspect_lh": length / floor(height),
            "aspect_wh": width / floor(height),
            "elongation": length / floor(F.least(width, height)),
            "flatness": F.least(width, height) / floor(length),
            "density": F.col("n_points") / floor(F.col("bbox_volume")),
            "z_above_ground": F.col("z_min"),
            "vertical_ratio": height / F.greatest(length, width, F.lit(0.01)),
            "xy_extent": F.sqrt(length * length + width * width),
        }
    )


def dominant_class(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most frequent obstacle class per cluster; NULL where none is labelled, ties go to the lower id."""
    counts = points.groupBy(*keys, "class_id").agg(F.count(F.lit(1)).alias("n"))
    labelled = F.col("class_id") != BACKGROUND_ID
    best = F.max_by("class_id", F.when(labelled, F.struct(F.col("n"), -F.col("class_id"))))
    dominant = counts.groupBy(*keys).agg(best.alias("dominant_id"))
    label = F.lit(None).cast("string")
    for number, name in enumerate(CLASS_NAMES):
        label = F.when(F.col("dominant_id") == number, name).otherwise(label)
    return dominant.select(*keys, label.alias("gt_class"))


def reject_reason() -> Column:
    """Why a cluster does not look like an object, or ``ok``; needs the feature columns."""
    return (
        F.when(F.col("z_max") - F.col("z_min") < 1.0, "z_range")
        .when((F.col("flatness") > 0.8) & (F.col("bbox_height") < 2.0), "too_flat")
        .when(F.col("n_points") < 30, "too_few_points")
        .otherwise("ok")
    )


def object_like(features: DataFrame) -> DataFrame:
    return features.withColumn("reason", reject_reason()).withColumn("is_object", F.col("reason") == "ok")


# Per class the limits a box should meet and the factor on its score when it does not.
GEOMETRY_RULES = {
    "Antenna": [
        ("bbox_height", "<", 5.0, 0.1),
        ("bbox_height", ">", 100.0, 0.1),
        ("elongation", "<", 1.0, 0.1),
        ("elongation", ">", 20.0, 0.1),
        ("vertical_ratio", "<", 0.5, 0.3),
    ],
    "Cable": [
        ("bbox_height", "<", 0.1, 0.1),
        ("bbox_height", ">", 15.0, 0.1),
        ("elongation", "<", 5.0, 0.1),
        ("elongation", ">", 10.0, 2.0),
        ("elongation", ">", 2000.0, 0.1),
        ("bbox_length", "<", 5.0, 0.2),
    ],
    "Electric Pole": [
        ("bbox_height", "<", 3.0, 0.1),
        ("bbox_height", ">", 50.0, 0.1),
        ("elongation", "<", 1.0, 0.1),
        ("elongation", ">", 15.0, 0.1),
        ("vertical_ratio", "<", 0.3, 0.3),
    ],
    "Wind Turbine": [
        ("bbox_height", "<", 10.0, 0.1),
        ("bbox_height", ">", 200.0, 0.1),
        ("bbox_volume", "<", 50.0, 0.1),
    ],
}


def geo_classify(features: DataFrame) -> DataFrame:
    """Class with the best rule score and its share of all scores; ties go to the earlier class."""
    scores = {}
    for label, rules in GEOMETRY_RULES.items():
        score = F.lit(1.0)
        for column, side, limit, factor in rules:
            hit = F.col(column) < limit if side == "<" else F.col(column) > limit
            score = score * F.when(hit, F.lit(factor)).otherwise(1.0)
        scores[f"score_{label.lower().replace(' ', '_')}"] = score
    scored = features.withColumns(scores)
    names = list(scores)
    best = F.greatest(*names)
    label = F.lit(CLASS_NAMES[-1])
    for name, column in reversed(list(zip(CLASS_NAMES, names))):
        label = F.when(F.col(column) == best, name).otherwise(label)
    total = sum((F.col(n) for n in names[1:]), F.col(names[0])) + F.lit(0.001)
    return scored.withColumn("predicted_class", label).withColumn("geo_confidence", best / total).drop(*names)


# --- cables ------------------------------------------------------------------------------------------------------


def merge_fragments(fragments: DataFrame, keys: Sequence[str], id_column: str, max_distance: float = 5.0, max_angle: float = 30.0) -> DataFrame:
    """Group fragments whose centres are near and whose axes enclose a small angle, also through others.

    Adds ``fragment_group``, the smallest id of the group. An axis has no sign, so every fragment enters with both
    directions; two unit vectors enclose at most the angle when their tips are no further apart than its chord.
    """
    chord = 2 * float(np.sin(np.radians(max_angle) / 2))
    centre = ("bbox_center_x", "bbox_center_y", "bbox_center_z")
    both = fragments.select(*keys, id_column, *centre, "dx", "dy", "dz", F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("__sign"))
    both = both.withColumns({d: F.col(d) * F.col("__sign") for d in ("dx", "dy", "dz")}).drop("__sign")
    spaces = [Space(centre, F.lit(float(max_distance))), Space(("dx", "dy", "dz"), F.lit(chord))]
    grouped = near_components(both, keys, id_column, spaces, "fragment_group")
    found = grouped.groupBy(*keys, id_column).agg(F.min("fragment_group").alias("fragment_group"))
    return fragments.join(found, [*keys, id_column])


def measured_clusters(clustered: DataFrame, keys: Sequence[str], min_points: int = 20) -> tuple[DataFrame, DataFrame]:
    """Points of the clusters large enough to judge, and the features of those clusters; both are stored."""
    by_cluster = [*keys, "cluster"]
    members = clustered.filter(F.col("cluster") != -1)
    sizes = members.groupBy(*by_cluster).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_points)
    members = cut_lineage(members.join(sizes.select(*by_cluster), by_cluster, "left_semi"))
    return members, cut_lineage(cluster_features(members, obb_min_area(members, by_cluster), by_cluster))


def detect_cables(members: DataFrame, features: DataFrame, keys: Sequence[str], min_elongation: float = 8.0, merge_distance: float = 10.0) -> DataFrame:
    """Cables: elongated clusters, near and collinear ones refitted as one box."""
    keys = list(keys)
    by_cluster = [*keys, "cluster"]
    elongated = features.filter(F.col("elongation") >= F.lit(float(min_elongation)))
    directions = principal_direction(members, by_cluster).drop("n_points")
    directed = cut_lineage(elongated.join(directions, by_cluster))
    grouped = cut_lineage(merge_fragments(directed, keys, "cluster", merge_distance).select(*by_cluster, "fragment_group"))
    counts = grouped.groupBy(*keys, "fragment_group").agg(F.count(F.lit(1)).alias("n_fragments"))
    whole = members.join(grouped, by_cluster).drop("cluster").withColumnRenamed("fragment_group", "cluster")
    whole = cut_lineage(whole)
    refit = cluster_features(whole, obb_min_area(whole, by_cluster), by_cluster)
    return (
        refit.join(counts.withColumnRenamed("fragment_group", "cluster"), by_cluster)
        .withColumn("predicted_class", F.lit("Cable"))
        .withColumn("geo_confidence", F.lit(0.8))
    )


def detect_objects(clustered: DataFrame, keys: Sequence[str], min_elongation: float = 8.0, merge_distance: float = 10.0) -> DataFrame:
    """Object-like clusters with class by geometry; cables are replaced by merged cables."""
    keys = list(keys)
    by_cluster = [*keys, "cluster"]
    members, features = measured_clusters(clustered, keys)
    likely = object_like(features).filter("is_object").drop("reason", "is_object")
    classed = geo_classify(likely).join(dominant_class(members, by_cluster), by_cluster)
    others = classed.filter(F.col("predicted_class") != "Cable")
    cables = detect_cables(members, features, keys, min_elongation, merge_distance)
    return others.unionByName(cables, allowMissingColumns=True)
