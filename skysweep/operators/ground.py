"""Ground estimation by tile percentiles, ground removal and its quality figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skysweep.functions.columns import label_of
from skysweep.functions.ranks import pivot_percentiles, wide_percentiles
from skysweep.operators.frames import first_n_frames, local_to_world
from skysweep.schema import CLASS_NAMES, FRAME, MIN_SURVIVAL, POSE
from skysweep.session import cut_lineage

TILE = ["tile_x", "tile_y"]


def _prefix(label: str) -> str:
    return label.lower().replace(" ", "_")


def with_tiles(points: DataFrame, tile_size: float = 5.0) -> DataFrame:
    """Attach the tile index, anchored at the smallest x and y of the frame.

    The last tile is closed at the far edge. A frame of fewer than ten points is one single tile.
    """
    extents = points.groupBy(*FRAME).agg(
        F.min("x").alias("__x0"),
        F.max("x").alias("__x1"),
        F.min("y").alias("__y0"),
        F.max("y").alias("__y1"),
        F.count(F.lit(1)).alias("__n"),
    )

    def index(axis: str) -> Column:
        start, end, size = F.col(f"__{axis}0"), F.col(f"__{axis}1"), F.lit(float(tile_size))
        last = F.greatest(F.ceil((end - start) / size).cast("int"), F.lit(1)) - 1
        tile = F.least(F.floor((F.col(axis) - start) / size).cast("int"), last)
        return F.when(F.col("__n") < 10, 0).otherwise(tile)

    return (
        points.join(extents, FRAME)
        .withColumns({"tile_x": index("x"), "tile_y": index("y")})
        .drop("__x0", "__x1", "__y0", "__y1", "__n")
    )


def tile_ground(points: DataFrame, tile_size: float = 5.0, percentile: float = 5.0) -> DataFrame:
    """Ground height per (frame, tile): the linear percentile of z.

    The exact percentile keeps one counter per distinct z of a tile, built up before the shuffle, so its size follows
    the height range of the tile at the stored resolution and not the number of points.
    """
    return _ground_of(with_tiles(points, tile_size), percentile)


def _ground_of(tiled: DataFrame, percentile: float) -> DataFrame:
    return tiled.groupBy(*FRAME, *TILE).agg(
        F.percentile("z", percentile / 100.0).alias("ground_z"), F.count(F.lit(1)).alias("tile_points")
    )


def hag(points: DataFrame, tile_size: float = 5.0, percentile: float = 5.0, digits: int | None = 6) -> DataFrame:
    """Add ``ground_z`` and the height above it to every point."""
    tiled = with_tiles(points, tile_size)
    ground = _ground_of(tiled, percentile).drop("tile_points")
    joined = tiled.join(ground, [*FRAME, *TILE]).drop(*TILE)
    height = F.col("z") - F.col("ground_z")
    return joined.withColumn("hag", height if digits is None else F.round(height, digits) + F.lit(0.0))


def ground_filter(points_hag: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Points strictly above the threshold; the original index stays as ``kept_index``."""
    return points_hag.filter(F.col("hag") > F.lit(float(threshold))).withColumnRenamed("point_id", "kept_index")


def clean_manifest(points_hag: DataFrame, threshold: float = 2.0, folder: str = "cleaned") -> DataFrame:
    """Original and kept counts per frame, in all and per class."""
    kept = F.col("hag") > F.lit(float(threshold))
    per_class = []
    for label in CLASS_NAMES:
        is_class = F.col("class_label") == label
        per_class += [
            F.count_if(is_class).alias(f"{_prefix(label)}_original"),
            F.count_if(is_class & kept).alias(f"{_prefix(label)}_cleaned"),
        ]
    return (
        points_hag.groupBy(*FRAME, *POSE)
        .agg(
            F.count(F.lit(1)).alias("num_points_original"),
            F.count_if(kept).alias("num_points_cleaned"),
            *per_class,
        )
        .withColumn(
            "points_removed_pct", 100.0 * (1 - F.col("num_points_cleaned") / F.col("num_points_original"))
        )
        .withColumn(
            "cleaned_path",
            F.concat(F.lit(f"{folder}/"), "scene", F.format_string("/frame_%03d.parquet", F.col("pose_index"))),
        )
    )


def clean_manifest_ext(points_hag: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Extended frame inventory: ground and height ranges, extents of the kept points, noise counts."""
    kept = F.col("hag") > F.lit(float(threshold))
    noise = F.col("class_id") < 0
    spans = [(f, axis) for axis in "xyz" for f in ("min", "max")]
    return points_hag.groupBy(*FRAME, *POSE).agg(
        F.count(F.lit(1)).alias("num_points_original"),
        F.count_if(kept).alias("num_points_cleaned"),
        (100.0 * (1 - F.count_if(kept) / F.count(F.lit(1)))).alias("points_removed_pct"),
        F.min("ground_z").alias("ground_z_min"),
        F.max("ground_z").alias("ground_z_max"),
        F.avg("ground_z").alias("ground_z_mean"),
        F.min(F.when(kept, F.col("hag"))).alias("hag_min"),
        F.max(F.when(kept, F.col("hag"))).alias("hag_max"),
        F.avg(F.when(kept, F.col("hag"))).alias("hag_mean"),
        *[getattr(F, f)(F.when(kept, F.col(axis))).alias(f"{axis}_{f}") for f, axis in spans],
        F.count_if(noise).alias("noise_original"),
        F.count_if(noise & kept).alias("noise_cleaned"),
        F.lit(float(threshold)).alias("threshold_m"),
    )


def survival_counts(points_hag: DataFrame, thresholds: Sequence[float] = (2, 5)) -> DataFrame:
    """Total and survived points per (scene, threshold, class); noise is the background class.

    One aggregate per threshold in a single pass, unpivoted afterwards, so points are never multiplied.
    """
    counted = points_hag.groupBy("scene", "class_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("hag") > F.lit(float(t))).alias(f"__s{i}") for i, t in enumerate(thresholds)],
    )
    per_threshold = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold_m"), F.col(f"__s{i}").alias("survived"))
            for i, t in enumerate(thresholds)
        ]
    )
    return counted.select("scene", label_of(other="noise").alias("class_label"), "total", F.explode(per_threshold).alias("t")).select(
        "scene", "t.threshold_m", "class_label", "total", "t.survived"
    )


def survival_metrics(counts: DataFrame) -> DataFrame:
    """Wide survival table; the share of an absent class is NULL."""
    columns = []
    for label in [*CLASS_NAMES, "noise"]:
        is_class = F.col("class_label") == label
        total = F.coalesce(F.sum(F.when(is_class, F.col("total"))), F.lit(0))
        survived = F.coalesce(F.sum(F.when(is_class, F.col("survived"))), F.lit(0))
        columns += [total.alias(f"{_prefix(label)}_total"), survived.alias(f"{_prefix(label)}_survived")]
    wide = counts.groupBy("scene", "threshold_m").agg(
        *columns, F.sum("total").alias("all_points_total"), F.sum("survived").alias("all_points_survived")
    )
    for label in CLASS_NAMES:
        p = _prefix(label)
        wide = wide.withColumn(f"{p}_survival_pct", F.try_divide(100.0 * F.col(f"{p}_survived"), F.col(f"{p}_total")))
    noise = F.coalesce(F.try_divide(100.0 * F.col("noise_survived"), F.col("noise_total")), F.lit(0.0))
    kept = F.coalesce(F.try_divide(100.0 * F.col("all_points_survived"), F.col("all_points_total")), F.lit(0.0))
    return wide.withColumns(
        {
            "noise_survival_pct": noise,
            "noise_removed_pct": 100.0 - noise,
            "all_points_survival_pct": kept,
            "total_removed_pct": 100.0 - kept,
        }
    )


def meets_minima(min_survival: dict[str, float] = MIN_SURVIVAL) -> Column:
    """True when no class with points falls short of its smallest survival."""
    ok = F.lit(True)
    for label, rate in min_survival.items():
        share = F.col(f"{_prefix(label)}_survival_pct")
        ok = ok & (share.isNull() | (share >= F.lit(rate * 100)))
    return ok


def threshold_status(metrics: DataFrame, min_survival: dict[str, float] = MIN_SURVIVAL) -> DataFrame:
    return metrics.select("scene", "threshold_m", meets_minima(min_survival).alias("passes"))


def threshold_first_ok(metrics: DataFrame, min_survival: dict[str, float] = MIN_SURVIVAL) -> DataFrame:
    """One threshold for the run: the first passing row in (scene, threshold) order.

    Without a passing row the first tested one; without any class points NULL.
    """
    order = F.struct("scene", "threshold_m")
    labelled = F.bool_or(F.greatest(*[F.col(f"{_prefix(c)}_survival_pct").isNotNull() for c in min_survival]))
    return metrics.agg(
        F.when(
            labelled,
            F.coalesce(
                F.min_by("threshold_m", F.when(meets_minima(min_survival), order)), F.min("threshold_m")
            ),
        ).alias("threshold_m")
    )


def threshold_highest_ok(metrics: DataFrame, min_survival: dict[str, float] = MIN_SURVIVAL) -> DataFrame:
    """Per scene the highest passing threshold, or the lowest tested one."""
    passing = F.max(F.when(meets_minima(min_survival), F.col("threshold_m")))
    return metrics.groupBy("scene").agg(F.coalesce(passing, F.min("threshold_m")).alias("threshold_m"))


def ground_qa(
    points: DataFrame, frames: DataFrame, threshold: float = 2.0, n: int = 5, minima: dict[str, float] = MIN_SURVIVAL
) -> DataFrame:
    """Checks on the first ``n`` frames of the first scene: reduction, smallest kept height, survival per class.

    Ground is estimated for these frames only.
    """
    first_scene = frames.agg(F.min("scene").alias("scene"))
    listed = first_n_frames(frames.join(first_scene, "scene", "left_semi"), n).select(*FRAME)
    kept = F.col("hag") > F.lit(float(threshold))
    columns = [
        F.count(F.lit(1)).alias("original"),
        F.count_if(kept).alias("kept"),
        (100.0 * (1 - F.count_if(kept) / F.count(F.lit(1)))).alias("removed_pct"),
        F.min(F.when(kept, F.col("hag"))).alias("min_hag"),
        F.coalesce(F.min(F.when(kept, F.col("hag"))) > F.lit(float(threshold)), F.lit(True)).alias("hag_ok"),
    ]
    for label in CLASS_NAMES:
        is_class = F.col("class_label") == label
        share = F.try_divide(F.count_if(is_class & kept), F.count_if(is_class))
        columns.append(F.coalesce(share >= F.lit(minima.get(label, 0.0)), F.lit(True)).alias(f"{_prefix(label)}_ok"))
    return hag(points.join(listed, FRAME, "left_semi")).groupBy(*FRAME).agg(*columns)


def kept_by_threshold(points_hag: DataFrame, thresholds: Sequence[float] = (2, 5, 10, 15, 20, 25)) -> DataFrame:
    """Kept count and share per frame and threshold, with the height range of the frame."""
    counted = points_hag.groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("total"),
        F.min("hag").alias("hag_min"),
        F.max("hag").alias("hag_max"),
        *[F.count_if(F.col("hag") > F.lit(float(t))).alias(f"__s{i}") for i, t in enumerate(thresholds)],
    )
    listed = F.array(
        *[F.struct(F.lit(float(t)).alias("threshold_m"), F.col(f"__s{i}").alias("kept")) for i, t in enumerate(thresholds)]
    )
    return counted.select(*FRAME, "total", "hag_min", "hag_max", F.explode(listed).alias("t")).select(
        *FRAME, "t.threshold_m", "total", "t.kept", (100.0 * F.col("t.kept") / F.col("total")).alias("kept_pct"), "hag_min", "hag_max"
    )


def _class_heights(points_hag: DataFrame) -> DataFrame:
    """Heights of the obstacle points; stored, as the percentiles read them in two passes."""
    return cut_lineage(points_hag.filter("class_id >= 0").select(*FRAME, "class_label", "hag"))


def _with_percentiles(stats: DataFrame, rows: DataFrame, keys: Sequence[str], names: dict[float, str], value: str = "hag") -> DataFrame:
    """Add percentiles of ``value`` per key, NULL for keys without a value."""
    found = wide_percentiles(rows, keys, [value], list(names))
    return stats.join(pivot_percentiles(found, keys, {(value, p): name for p, name in names.items()}), list(keys), "left")


def class_survival_frame(points_hag: DataFrame, threshold: float = 2.0) -> DataFrame:
    survived = F.count_if(F.col("hag") > F.lit(float(threshold)))
    rows, keys = _class_heights(points_hag), [*FRAME, "class_label"]
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), survived.alias("survived"), (survived / F.count(F.lit(1))).alias("rate")
    )
    return _with_percentiles(stats, rows, keys, {0.5: "median_hag"})


def run_totals(points_hag: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Original, kept and removed points per scene and over all (scene NULL)."""
    kept = F.count_if(F.col("hag") > F.lit(float(threshold)))
    return points_hag.rollup("scene").agg(
        F.count(F.lit(1)).alias("original"),
        kept.alias("kept"),
        (100.0 * (1 - kept / F.count(F.lit(1)))).alias("removed_pct"),
    )


def manifest_stats(manifest: DataFrame) -> DataFrame:
    """Run summary over the frame inventory: kept-count statistics and class totals."""
    columns = [
        F.count(F.lit(1)).alias("frames"),
        F.min("num_points_cleaned").alias("cleaned_min"),
        F.max("num_points_cleaned").alias("cleaned_max"),
        F.avg("num_points_cleaned").alias("cleaned_mean"),
    ]
    for label in CLASS_NAMES:
        cleaned = F.col(f"{_prefix(label)}_cleaned")
        columns += [
            F.sum(cleaned).alias(f"{_prefix(label)}_points"),
            F.count_if(cleaned > 0).alias(f"{_prefix(label)}_frames"),
        ]
    stored = cut_lineage(manifest)
    whole = stored.select(F.lit(0).alias("run"), "num_points_cleaned")
    totals = stored.agg(*columns).withColumn("run", F.lit(0))
    return _with_percentiles(totals, whole, ["run"], {0.5: "cleaned_median"}, "num_points_cleaned").drop("run")


# --- world-frame ground model ------------------------------------------------------------------------------------


def _world_bounds(world: DataFrame, tile_size: float) -> DataFrame:
    size = F.lit(float(tile_size))
    bounds = world.groupBy("scene").agg(
        (F.min("x_world") - size).alias("x0"),
        (F.max("x_world") + size).alias("x1"),
        (F.min("y_world") - size).alias("y0"),
        (F.max("y_world") + size).alias("y1"),
    )
    return bounds.select(
        "scene",
        "x0",
        "y0",
        F.ceil((F.col("x1") - F.col("x0")) / size).cast("int").alias("nx"),
        F.ceil((F.col("y1") - F.col("y0")) / size).cast("int").alias("ny"),
    )


def _world_tile(axis: str, tile_size: float) -> Column:
    cell = F.floor((F.col(f"{axis}_world") - F.col(f"{axis}0")) / F.lit(float(tile_size))).cast("int")
    return F.least(F.greatest(cell, F.lit(0)), F.col(f"n{axis}") - 1)


def _world(points: DataFrame, frames: int | None) -> DataFrame:
    return local_to_world(points if frames is None else points.filter(F.col("pose_index") < frames))


def _scene_model(points: DataFrame, tile_size: float, max_frames: int | None) -> tuple[DataFrame, DataFrame]:
    """Model and bounds of every scene; the bounds are stored, as every later step reads them."""
    world = _world(points, max_frames)
    bounds = cut_lineage(_world_bounds(world, tile_size))
    seen = (
        world.join(bounds, "scene")
        .groupBy("scene", "nx", "ny", _world_tile("x", tile_size).alias("tile_x"), _world_tile("y", tile_size).alias("tile_y"))
        .agg(F.min("z_world").alias("z"))
    )
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    # Every seen tile offers its height to the tiles around it.
    offers = seen.withColumn("s", F.explode(steps)).select(
        "scene", "nx", "ny", (F.col("tile_x") + F.col("s.i")).alias("tile_x"), (F.col("tile_y") + F.col("s.j")).alias("tile_y"), "s.i", "s.j", "z"
    )

    def times(axis: str, step: str) -> Column:
        """Edge tiles repeat outwards, so a clamped neighbour counts once per offset that reaches it."""
        at_edge = (F.col(f"tile_{axis}") == 0).cast("int") + (F.col(f"tile_{axis}") == F.col(f"n{axis}") - 1).cast("int")
        return 1 + F.when(F.col(step) == 0, at_edge).otherwise(0)

    inside = offers.filter("tile_x between 0 and nx - 1 and tile_y between 0 and ny - 1")
    own = F.max(F.when((F.col("i") == 0) & (F.col("j") == 0), F.col("z")))
    around = F.percentile("z", 0.5, times("x", "i") * times("y", "j"))
    model = inside.groupBy("scene", *TILE).agg(own.alias("own"), around.alias("around"))
    return model.select("scene", *TILE, F.coalesce("own", "around").alias("ground_z"), F.col("own").isNull().alias("filled")), bounds


def scene_ground_model(points: DataFrame, tile_size: float = 10.0, max_frames: int | None = None) -> DataFrame:
    """Lowest z per world tile; an empty tile next to a filled one takes the median of the filled tiles around it.

    Result: scene, tile_x, tile_y, ground_z, filled. Tiles without a filled neighbour have no height and no row, so the
    model grows with the tiles that are seen. ``max_frames`` restricts it to the first frames of a scene, if wanted.
    """
    return _scene_model(points, tile_size, max_frames)[0]


def _looked_up(rows: DataFrame, model: DataFrame, bounds: DataFrame, tile_size: float) -> DataFrame:
    located = rows.join(bounds, "scene").withColumns(
        {"tile_x": _world_tile("x", tile_size), "tile_y": _world_tile("y", tile_size)}
    )
    return located.join(model.select("scene", *TILE, "ground_z"), ["scene", *TILE], "left").drop(
        *TILE, "x0", "y0", "nx", "ny"
    )


def ground_lookup(rows: DataFrame, points: DataFrame, tile_size: float = 10.0, max_frames: int | None = None) -> DataFrame:
    """Add ``ground_z`` of the model of ``points`` at (x_world, y_world); positions outside the grid take its edge tile."""
    return _looked_up(rows, *_scene_model(points, tile_size, max_frames), tile_size)


def scene_ground_lookup(points: DataFrame, tile_size: float = 10.0, max_frames: int | None = None) -> DataFrame:
    """World-frame height above the scene ground for every point."""
    found = ground_lookup(local_to_world(points), points, tile_size, max_frames)
    return found.withColumn("hag", F.round(F.col("z_world") - F.col("ground_z"), 6) + F.lit(0.0))


def ground_coverage(points_world_hag: DataFrame) -> DataFrame:
    """Per frame: points without a ground height, and the ranges of height, ground and z."""
    missing = F.count_if(F.col("hag").isNull())
    return points_world_hag.groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("n"),
        missing.alias("n_missing"),
        (100.0 * missing / F.count(F.lit(1))).alias("missing_pct"),
        F.min("hag").alias("hag_min"),
        F.max("hag").alias("hag_max"),
        F.min("ground_z").alias("ground_min"),
        F.max("ground_z").alias("ground_max"),
        F.min("z_world").alias("z_min"),
        F.max("z_world").alias("z_max"),
    )


def ground_at_ego(frames: DataFrame, points: DataFrame, tile_size: float = 10.0, max_frames: int | None = None) -> DataFrame:
    """Ground height under the sensor of every frame."""
    at_ego = frames.withColumns({"x_world": F.col("ego_x") / 100, "y_world": F.col("ego_y") / 100})
    return ground_lookup(at_ego, points, tile_size, max_frames).select(*FRAME, "x_world", "y_world", "ground_z")


def ego_ranges(frames: DataFrame) -> DataFrame:
    spans = [getattr(F, f)(c).alias(f"{c}_{f}") for c in POSE for f in ("min", "max")]
    return frames.groupBy("scene").agg(F.count(F.lit(1)).alias("frames"), *spans)


def ego_outliers(frames: DataFrame, limit: float) -> DataFrame:
    """Frames whose sensor height exceeds the limit in size, with the pose ranges of their scene."""
    return frames.filter(F.abs("ego_z") > F.lit(float(limit))).join(ego_ranges(frames), "scene")


def frame_bounds(points: DataFrame) -> DataFrame:
    """World extents per frame and, with pose_index NULL, per scene."""
    spans = [
        getattr(F, f)(f"{axis}_world").alias(f"{axis}_{f}") for axis in "xyz" for f in ("min", "max")
    ]
    return local_to_world(points).rollup("scene", "pose_index").agg(*spans).filter(F.col("scene").isNotNull())


def frames_with_class(points: DataFrame, samples: int = 5) -> DataFrame:
    """Per class: frames holding it, points, and the first few frames by name."""
    per_frame = points.filter("class_id >= 0").groupBy("class_label", *FRAME).agg(F.count(F.lit(1)).alias("n"))
    totals = per_frame.groupBy("class_label").agg(F.count(F.lit(1)).alias("frames"), F.sum("n").alias("points"))
    first = W.partitionBy("class_label").orderBy(*FRAME)
    named = (
        per_frame.withColumn("rn", F.row_number().over(first))
        .filter(F.col("rn") <= samples)
        .groupBy("class_label")
        .agg(
            F.concat_ws(
                ",", F.array_sort(F.collect_list(F.format_string("%s/%03d", F.col("scene"), F.col("pose_index"))))
            ).alias("sample_frames")
        )
    )
    return totals.join(named, "class_label")


def worst_frames(points_world_hag: DataFrame, threshold: float = 2.0, k: int = 3) -> DataFrame:
    """Per class the ``k`` frames with the lowest survival above the scene ground."""
    survived = F.count_if(F.col("hag") > F.lit(float(threshold)))
    rows, keys = _class_heights(points_world_hag), ["class_label", *FRAME]
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        survived.alias("survived"),
        (100.0 * survived / F.count(F.lit(1))).alias("survival_pct"),
        F.min("hag").alias("hag_min"),
    )
    order = W.partitionBy("class_label").orderBy("survival_pct", *FRAME)
    worst = stats.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return _with_percentiles(worst, rows.join(worst.select(*keys), keys, "left_semi"), keys, {0.5: "hag_median"})


def hag_profile(
    points_world_hag: DataFrame, thresholds: Sequence[float] = (2, 5, 10, 15, 20, 25)
) -> DataFrame:
    """Height percentiles 5..95 and survival at several thresholds, per frame and class."""
    probs = [0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95]
    names = {p: f"hag_p{round(p * 100):02d}" for p in probs}
    rows, keys = _class_heights(points_world_hag), [*FRAME, "class_label"]
    total = F.count(F.lit(1))
    shares = [(100.0 * F.count_if(F.col("hag") > F.lit(float(t))) / total).alias(f"survival_{int(t)}m") for t in thresholds]
    stats = rows.groupBy(*keys).agg(total.alias("n"), *shares)
    return _with_percentiles(stats, rows, keys, names).select(*keys, "n", *names.values(), *[f"survival_{int(t)}m" for t in thresholds])
