"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skysweep.schema import BACKGROUND, BACKGROUND_ID, CLASSES


def rnd(value: Column | str, digits: int) -> Column:
    """Round and turn a negative zero into a plain zero."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column, digits) + F.lit(0.0)


def clip(value: Column, low: Column | float, high: Column | float) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(value, low), high)


def wrap_angle(angle: Column) -> Column:
    """Bring an angle to (-pi, pi]."""
    return F.atan2(F.sin(angle), F.cos(angle))


def half_turn(angle: Column) -> Column:
    """Representative in (-pi/2, pi/2] of an axis direction, which is only defined modulo pi."""
    wrapped = wrap_angle(angle)
    half_pi = F.pi() / 2
    return (
        F.when(wrapped > half_pi, wrapped - F.pi()).when(wrapped <= -half_pi, wrapped + F.pi()).otherwise(wrapped)
    )


def pick_by_class(values: dict[str, float], other: float | None = None, label: str = "class_label") -> Column:
    """Look a per-class number up from a fixed table by class label."""
    column = None
    for name, value in values.items():
        condition = F.col(label) == name
        column = F.when(condition, F.lit(value)) if column is None else column.when(condition, F.lit(value))
    return column if other is None else column.otherwise(F.lit(other))


def class_id_of(r: str = "r", g: str = "g", b: str = "b") -> Column:
    """Class id of an exact colour, or the background id."""
    column = None
    for class_id, _, red, green, blue in CLASSES:
        condition = (F.col(r) == red) & (F.col(g) == green) & (F.col(b) == blue)
        column = F.when(condition, class_id) if column is None else column.when(condition, class_id)
    return column.otherwise(BACKGROUND_ID)


def label_of(class_id: str = "class_id", other: str = BACKGROUND) -> Column:
    column = None
    for number, label, *_ in CLASSES:
        condition = F.col(class_id) == number
        column = F.when(condition, label) if column is None else column.when(condition, label)
    return column.otherwise(other)


def draw(purpose: str, *keys: Column | str) -> Column:
    """Repeatable whole-number draw in [0, 2^31) for a purpose and the values of the keys.

    It is the head of a digest of both, so draws for other purposes or keys are unrelated, and any key will do.
    """
    digest = F.md5(F.concat_ws("|", F.lit(purpose), *keys))
    return F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / 2)


def uniform(purpose: str, *keys: Column | str) -> Column:
    return draw(purpose, *keys) / F.lit(2147483648.0)
