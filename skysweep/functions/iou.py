"""Overlap measures between two boxes, as column expressions over suffixed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = {"x": "bbox_width", "y": "bbox_length", "z": "bbox_height"}


def _span(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    return F.greatest(F.least(high_a, high_b) - F.greatest(low_a, low_b), F.lit(0.0))


def extents(convention: str = "wl_axis", suffix: str = "") -> dict[str, Column]:
    """Side lengths along x, y, z. ``l_major`` puts the longer horizontal side along x."""
    width, length = F.col(f"bbox_width{suffix}"), F.col(f"bbox_length{suffix}")
    if convention == "l_major":
        width, length = F.greatest(width, length), F.least(width, length)
    return {"x": width, "y": length, "z": F.col(f"bbox_height{suffix}")}


def _overlap(convention: str, a: str, b: str) -> tuple[Column, Column, Column]:
    size_a, size_b = extents(convention, a), extents(convention, b)
    shared = F.lit(1.0)
    for axis in "xyz":
        centre_a, centre_b = F.col(f"bbox_center_{axis}{a}"), F.col(f"bbox_center_{axis}{b}")
        half_a, half_b = size_a[axis] / 2, size_b[axis] / 2
        shared = shared * _span(centre_a - half_a, centre_a + half_a, centre_b - half_b, centre_b + half_b)
    return shared, size_a["x"] * size_a["y"] * size_a["z"], size_b["x"] * size_b["y"] * size_b["z"]


def iou_aabb(a: str = "_a", b: str = "_b") -> Column:
    """Axis-aligned overlap over union, guarded by a tiny term in the divisor."""
    shared, volume_a, volume_b = _overlap("wl_axis", a, b)
    return shared / (volume_a + volume_b - shared + F.lit(1e-10))


def iou_major(a: str = "_a", b: str = "_b") -> Column:
    """Axis-aligned overlap with the longer horizontal side along x; an empty union gives 0."""
    shared, volume_a, volume_b = _overlap("l_major", a, b)
    union = volume_a + volume_b - shared
    return F.when(union > 0, F.try_divide(shared, union)).otherwise(0.0)


def add_iou_cylinder(pairs: DataFrame, a: str = "_a", b: str = "_b") -> DataFrame:
    """Add ``iou`` of upright cylinders around the boxes: circle lens times shared height.

    Radii, distance and lens are columns of their own, so that each is evaluated once per pair.
    """
    dx, dy = (F.col(f"bbox_center_{c}{a}") - F.col(f"bbox_center_{c}{b}") for c in "xy")
    low, high = ([F.col(f"bbox_center_z{s}") + side * F.col(f"bbox_height{s}") / 2 for s in (a, b)] for side in (-1, 1))
    sized = pairs.withColumns(
        {
            "r1": F.greatest(f"bbox_width{a}", f"bbox_length{a}") / 2,
            "r2": F.greatest(f"bbox_width{b}", f"bbox_length{b}") / 2,
            "d": F.sqrt(dx * dx + dy * dy),
            "dz": _span(low[0], high[0], low[1], high[1]),
        }
    ).filter("dz > 0")
    r1, r2, d = F.col("r1"), F.col("r2"), F.col("d")

    def sector(near: Column, far: Column) -> Column:
        cosine = (d * d + near * near - far * far) / (2 * d * near)
        return near * near * F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))

    kite = F.greatest((r1 + r2 - d) * (d + r1 - r2) * (d - r1 + r2) * (d + r1 + r2), F.lit(0.0))
    smaller = F.least(r1, r2)
    area = (
        F.when(d >= r1 + r2, 0.0)
        .when(d <= F.abs(r1 - r2), F.pi() * smaller * smaller)
        .otherwise(sector(r1, r2) + sector(r2, r1) - 0.5 * F.sqrt(kite))
    )
    shared = sized.withColumn("shared", area * F.col("dz"))
    union = F.pi() * (r1 * r1 * F.col(f"bbox_height{a}") + r2 * r2 * F.col(f"bbox_height{b}")) - F.col("shared")
    measured = shared.withColumn("union", union)
    return measured.withColumn("iou", F.when(F.col("union") > 0, F.try_divide(F.col("shared"), F.col("union"))).otherwise(0.0)).drop(
        "r1", "r2", "d", "dz", "shared", "union"
    )
