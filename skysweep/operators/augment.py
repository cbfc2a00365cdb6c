"""Repeatable augmentation and density sampling.

Every random choice is a digest of its purpose and a row or frame key, so a run can be repeated and checked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysweep.functions.columns import clip, draw, uniform
from skysweep.functions.ranks import rank_in_group
from skysweep.operators.frames import split_by_scene
from skysweep.schema import FRAME

# Default strength of the augmentation.
AUGMENT = {"flip_prob": 0.5, "max_rotation_deg": 180.0, "scale_low": 0.95, "scale_high": 1.05, "jitter_sigma": 0.01}
DENSITIES = (1.0, 0.75, 0.50, 0.25)
# The share of points a training frame keeps, each as likely.
DROPOUT_RATIOS = (1.0, 1.0, 1.0, 0.75, 0.50, 0.25)


def frame_draws(frames: DataFrame, seed: int = 0, a: dict = AUGMENT) -> DataFrame:
    """Flip, angle, scale and keep ratio of every frame."""
    own = lambda what: uniform(f"{what}{seed}", *FRAME)
    span = F.lit(2 * a["max_rotation_deg"])
    ratios = F.array(*[F.lit(r) for r in DROPOUT_RATIOS])
    choice = F.floor(own("ratio") * len(DROPOUT_RATIOS)).cast("int")
    return frames.select(
        *FRAME,
        (own("flip") < F.lit(a["flip_prob"])).alias("flip"),
        (own("angle") * span - F.lit(a["max_rotation_deg"])).alias("angle_deg"),
        (F.lit(a["scale_low"]) + own("scale") * F.lit(a["scale_high"] - a["scale_low"])).alias("scale"),
        F.element_at(ratios, choice + 1).alias("keep_ratio"),
    )


def _columns(df: DataFrame) -> tuple[str, str, str]:
    return ("x", "y", "z") if "x" in df.columns else ("bbox_center_x", "bbox_center_y", "bbox_center_z")


def _moved(df: DataFrame, steps: Sequence[str]) -> dict[str, Column]:
    """Columns after the given steps, for rows that carry the draws of their frame."""
    x, y, z = _columns(df)
    now = {c: F.col(c) for c in (x, y, z, "bbox_width", "bbox_length", "bbox_height", "bbox_yaw") if c in df.columns}
    if "flip" in steps:
        sign = F.when(F.col("flip"), -1.0).otherwise(1.0)
        now |= {c: now[c] * sign for c in (y, "bbox_yaw") if c in now}
    if "rotate" in steps:
        angle = F.radians("angle_deg")
        now |= {x: now[x] * F.cos(angle) - now[y] * F.sin(angle), y: now[x] * F.sin(angle) + now[y] * F.cos(angle)}
        now |= {"bbox_yaw": now["bbox_yaw"] + angle} if "bbox_yaw" in now else {}
    if "scale" in steps:
        now |= {c: now[c] * F.col("scale") for c in now if c != "bbox_yaw"}
    return now


def _augmented(df: DataFrame, draws: DataFrame, steps: Sequence[str]) -> DataFrame:
    return df.join(draws, FRAME).withColumns(_moved(df, steps)).select(*df.columns)


def aug_flip(df: DataFrame, draws: DataFrame) -> DataFrame:
    """Mirror y of the points or boxes of flipped frames; the yaw of a box turns its sign."""
    return _augmented(df, draws, ["flip"])


def aug_rotate(df: DataFrame, draws: DataFrame) -> DataFrame:
    return _augmented(df, draws, ["rotate"])


def aug_scale(df: DataFrame, draws: DataFrame) -> DataFrame:
    return _augmented(df, draws, ["scale"])


def _noise(axis: str, sigma: float, seed: int) -> Column:
    """Normal draw from two uniform ones, cut at five deviations."""
    first, second = (uniform(f"noise{part}{axis}{seed}", *FRAME, "point_id") for part in (1, 2))
    normal = F.sqrt(-2 * F.log(F.greatest(first, F.lit(1e-12)))) * F.cos(2 * F.pi() * second)
    return clip(normal * F.lit(sigma), -5 * sigma, 5 * sigma)


def aug_jitter(points: DataFrame, sigma: float = AUGMENT["jitter_sigma"], seed: int = 0) -> DataFrame:
    """Normal noise per coordinate, cut at five deviations; points only."""
    return points.withColumns({c: F.col(c) + _noise(c, sigma, seed) for c in ("x", "y", "z")})


def _keep_lowest(points: DataFrame, seed: int, keep: Column) -> DataFrame:
    """Rows whose pseudo-random rank in their frame is at most ``keep``; the rank never sorts a whole frame in one task."""
    ordered = points.withColumn("__draw", draw(f"keep{seed}", *FRAME, "point_id"))
    ranked = rank_in_group(ordered, FRAME, F.col("__draw"), 1 << 22, ["__draw", "point_id"], "__rank")
    return ranked.filter(F.col("__rank") <= keep).drop("__draw", "__rank")


def density_sample(points: DataFrame, ratio: Column | float, seed: int = 0) -> DataFrame:
    """max(int(n * ratio), 1) pseudo-random points of every frame; ``ratio`` may be a column fixed per frame."""
    ratio = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    sizes = points.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("__n"))
    keep = F.greatest((F.col("__n") * ratio).cast("long"), F.lit(1))
    return _keep_lowest(points.join(sizes, FRAME), seed, keep).drop("__n")


def density_levels(points: DataFrame, ratios: Sequence[float] = DENSITIES, seed: int = 0) -> DataFrame:
    """Points kept per frame at every density level, from one ranking."""
    sizes = points.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("__n"))
    ordered = points.select(*FRAME, "point_id", draw(f"keep{seed}", *FRAME, "point_id").alias("__draw")).join(sizes, FRAME)
    ranked = rank_in_group(ordered, FRAME, F.col("__draw"), 1 << 22, ["__draw", "point_id"], "__rank")
    levels = [
        F.when(F.col("__rank") <= F.greatest((F.col("__n") * F.lit(r)).cast("long"), F.lit(1)), F.lit(float(r))) for r in ratios
    ]
    kept = ranked.withColumn("density", F.explode(F.filter(F.array(*levels), lambda v: v.isNotNull())))
    return kept.select(*FRAME, "point_id", "density")


def cap_points(points: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` pseudo-random points of every frame."""
    return _keep_lowest(points, seed, F.lit(most))


STEPS = ("flip", "rotate", "scale")


def augment_points(points: DataFrame, frames: DataFrame, seed: int = 0) -> DataFrame:
    """Flip, turn, scale, jitter and thin the points of the training scenes; validation scenes stay untouched.

    One join with the draws and one ranking per frame.
    """
    train = split_by_scene(points, "train").join(frame_draws(frames, seed), FRAME)
    moved = train.withColumns(_moved(points, STEPS)).select(*points.columns, "keep_ratio")
    thinned = density_sample(aug_jitter(moved, seed=seed), F.col("keep_ratio"), seed)
    return thinned.select(*points.columns).unionByName(split_by_scene(points, "val"))


def augment_boxes(boxes: DataFrame, frames: DataFrame, seed: int = 0) -> DataFrame:
    """The same flip, turn and scale for the boxes."""
    train = _augmented(split_by_scene(boxes, "train"), frame_draws(frames, seed), STEPS)
    return train.unionByName(split_by_scene(boxes, "val"))
