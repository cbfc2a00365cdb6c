"""Exact ranks and percentiles for groups that may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rank_in_group(
    df: DataFrame, keys: Sequence[str], lead: Column, width: int, order: Sequence[Column], name: str = "rank"
) -> DataFrame:
    """``row_number`` per group, 1-based, without sorting a whole group in one task.

    ``lead`` is the first ordering value, a whole number. It is cut into buckets of ``width``; rows are numbered
    inside (group, bucket) and moved up by the size of the smaller buckets of the group.
    """
    slot = f"__{name}_bucket"
    base = f"__{name}_base"
    slotted = df.withColumn(slot, F.floor(lead / F.lit(width)).cast("long"))
    sizes = slotted.groupBy(*keys, slot).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys).orderBy(slot).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, slot, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(base))
    inside = W.partitionBy(*keys, slot).orderBy(*order)
    return (
        slotted.join(starts, [*keys, slot])
        .withColumn(name, F.row_number().over(inside) + F.col(base))
        .drop(slot, base)
    )


#: Equal steps of the bracket of a rank.
STEPS = 4096


def wide_percentiles(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], probabilities: Sequence[float], accuracy: int = 2000
) -> DataFrame:
    """Exact linear percentiles per (key, value column) for groups as large as a share of the table.

    A bounded sketch brackets every wanted rank first. The second pass counts the rows below the bracket and in each of
    ``STEPS`` equal steps of it, and looks only at the distinct values inside the steps that hold the rank. So no task holds
    a whole group or a whole bracket, of which a group of billions of rows would leave millions of values.
    Result: keys, ``metric``, ``p``, ``value``.
    """
    stacked = df.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])
        ).alias("m"),
    ).select(*keys, "m.metric", "m.value")
    # Copies of a value collapse before anything is ranked.
    counts = stacked.filter(F.col("value").isNotNull()).groupBy(*keys, "metric", "value").agg(
        F.count(F.lit(1)).alias("__n")
    )
    slack = 4.0 / accuracy
    probes = sorted({round(min(max(p + s, 0.0), 1.0), 12) for p in probabilities for s in (-slack, slack)})
    group = [*keys, "metric"]
    sketch = stacked.groupBy(*group).agg(
        F.percentile_approx("value", probes, accuracy).alias("__q"),
        F.count("value").alias("__total"),
        F.min("value").alias("__min"),
        F.max("value").alias("__max"),
    )
    # Where the slack is less than a few rows the whole group is the bracket.
    thin = F.col("__total") < 4 * accuracy

    def edge(p: float, end: str) -> Column:
        if not 0 < p < 1:
            return F.col(end)
        return F.when(thin, F.col(end)).otherwise(F.element_at("__q", probes.index(round(p, 12)) + 1))

    wanted = [
        F.struct(
            F.lit(float(p)).alias("p"),
            (F.lit(float(p)) * (F.col("__total") - 1)).alias("rank"),
            edge(p - slack, "__min").alias("low"),
            edge(p + slack, "__max").alias("high"),
        )
        for p in probabilities
    ]
    brackets = sketch.filter(F.col("__total") > 0).select(*group, F.explode(F.array(*wanted)).alias("b")).select(
        *group, "b.p", "b.rank", "b.low", "b.high"
    )
    bracketed = counts.join(brackets, group)
    # Step -1 stands for all values below the bracket; those above it are left out.
    share = (F.col("value") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    inner = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * STEPS), F.lit(STEPS - 1)).cast("int")
    stepped = bracketed.filter(F.col("value") <= F.col("high")).withColumn("__step", F.when(F.col("value") < F.col("low"), -1).otherwise(inner))
    steps = stepped.groupBy(*group, "p", "rank", "__step").agg(F.sum("__n").alias("__sum"))
    # At most STEPS + 1 rows per rank.
    before = W.partitionBy(*group, "p").orderBy("__step").rowsBetween(W.unboundedPreceding, -1)
    based = steps.withColumn("__below", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    holds = (F.col("__below") <= F.ceil("rank")) & (F.floor("rank") < F.col("__below") + F.col("__sum"))
    holding = based.filter(holds).select(*group, "p", "__step", "__below")
    upto = W.partitionBy(*group, "p", "__step").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    ranked = (
        stepped.join(holding, [*group, "p", "__step"])
        .withColumn("__end", F.col("__below") + F.sum("__n").over(upto))
        .withColumn("__start", F.col("__end") - F.col("__n"))
    )
    at = lambda position: (F.col("__start") <= position) & (position < F.col("__end"))
    return (
        ranked.groupBy(*group, "p", "rank")
        .agg(
            F.max(F.when(at(F.floor("rank")), F.col("value"))).alias("__lo"),
            F.max(F.when(at(F.ceil("rank")), F.col("value"))).alias("__hi"),
        )
        .select(
            *group,
            "p",
            F.coalesce(
                F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (F.col("rank") - F.floor("rank")),
                F.raise_error(F.lit("percentile bracket missed its rank")).cast("double"),
            ).alias("value"),
        )
    )


def pivot_percentiles(stats: DataFrame, keys: Sequence[str], names: dict[tuple[str, float], str]) -> DataFrame:
    """Turn the long result of ``wide_percentiles`` into one row per key with named columns."""
    picked = [
        F.max(F.when((F.col("metric") == metric) & (F.col("p") == F.lit(float(p))), F.col("value"))).alias(name)
        for (metric, p), name in names.items()
    ]
    return stats.groupBy(*keys).agg(*picked) if keys else stats.agg(*picked)
