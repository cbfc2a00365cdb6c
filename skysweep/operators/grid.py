"""Spatial bucketing: joins by distance or overlap without comparing whole groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_of(value: Column, side: Column | float) -> Column:
    return F.floor(value / (side if isinstance(side, Column) else F.lit(float(side)))).cast("long")


def cells_between(low: Column, high: Column, side: Column | float) -> Column:
    """All cell numbers that the closed interval touches."""
    return F.sequence(cell_of(low, side), cell_of(high, side))


def suffixed(df: DataFrame, suffix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(f"{c}{suffix}") for c in df.columns])


def overlapping_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_half: tuple[Column, Column],
    right_half: tuple[Column, Column],
    side: float = 32.0,
) -> DataFrame:
    """Pairs of boxes of the same key whose footprints overlap; columns end in ``_a`` and ``_b``.

    Both sides are laid into every cell their footprint touches and meet there. A pair is reported only in the
    cell of the corner where its overlap begins, so it appears once however many cells the two boxes share.
    """

    def placed(df: DataFrame, half: tuple[Column, Column]) -> DataFrame:
        x, y = F.col("bbox_center_x"), F.col("bbox_center_y")
        bounded = df.withColumns(
            {"__x0": x - half[0], "__x1": x + half[0], "__y0": y - half[1], "__y1": y + half[1]}
        )
        across = bounded.withColumn("__cx", F.explode(cells_between(F.col("__x0"), F.col("__x1"), side)))
        return across.withColumn("__cy", F.explode(cells_between(F.col("__y0"), F.col("__y1"), side)))

    kept = [*keys, "__cx", "__cy"]
    a, b = suffixed(placed(left, left_half), "_a", kept), suffixed(placed(right, right_half), "_b", kept)
    meet_x, meet_y = F.greatest("__x0_a", "__x0_b"), F.greatest("__y0_a", "__y0_b")
    met = a.join(b, kept).filter(
        (meet_x < F.least("__x1_a", "__x1_b"))
        & (meet_y < F.least("__y1_a", "__y1_b"))
        & (cell_of(meet_x, side) == F.col("__cx"))
        & (cell_of(meet_y, side) == F.col("__cy"))
    )
    return met.drop(*[f"__{e}_{s}" for e in ("x0", "x1", "y0", "y1") for s in "ab"], "__cx", "__cy")
