"""Rule-based cleaning of boxes, audit of what was dropped, and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skysweep.functions.columns import pick_by_class
from skysweep.functions.ranks import pivot_percentiles, wide_percentiles
from skysweep.schema import CLASS_NAMES, CLEAN_LIMITS, CLEAN_LIMITS_OTHER, FRAME

RULES = ["num_points", "max_dim", "min_vol", "aspect"]
DIMS = ["bbox_width", "bbox_length", "bbox_height"]


def _short(label: str) -> str:
    return label.lower().replace(" ", "_")


def box_stats(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns(
        {
            "volume": F.col("bbox_width") * F.col("bbox_length") * F.col("bbox_height"),
            "max_dim": F.greatest(*DIMS),
            "min_dim": F.least(*DIMS),
            "aspect_ratio": F.greatest(*DIMS) / F.greatest(F.least(*DIMS), F.lit(0.01)),
        }
    )


def failed_rules(limits: dict | None = None) -> dict[str, Column]:
    """Boolean column per rule, true where a box with ``box_stats`` columns breaks it."""
    limits = limits or CLEAN_LIMITS
    limit = lambda name: pick_by_class({k: v[name] for k, v in limits.items()}, CLEAN_LIMITS_OTHER[name])
    return {
        "num_points": F.col("num_points") < limit("min_points"),
        "max_dim": F.col("max_dim") > limit("max_dim"),
        "min_vol": (limit("min_volume") > 0) & (F.col("volume") < limit("min_volume")),
        "aspect": F.col("aspect_ratio") > limit("max_aspect"),
    }


def _broken(limits: dict | None) -> Column:
    """Names of the broken rules of a box, in rule order."""
    marks = [F.when(broken, F.lit(rule)) for rule, broken in failed_rules(limits).items()]
    return F.filter(F.array(*marks), lambda mark: mark.isNotNull())


def _any_broken(limits: dict | None) -> Column:
    first, *rest = failed_rules(limits).values()
    for broken in rest:
        first = first | broken
    return first


def clean_boxes(boxes: DataFrame, limits: dict | None = None) -> DataFrame:
    return box_stats(boxes).filter(~_any_broken(limits)).select(*boxes.columns)


def drop_log(boxes: DataFrame, limits: dict | None = None) -> DataFrame:
    """One row per box and broken rule, with the value that broke it."""
    value = (
        F.when(F.col("reason") == "num_points", F.col("num_points").cast("double"))
        .when(F.col("reason") == "max_dim", F.col("max_dim"))
        .when(F.col("reason") == "min_vol", F.col("volume"))
        .otherwise(F.col("aspect_ratio"))
    )
    return (
        box_stats(boxes)
        .withColumn("reason", F.explode(_broken(limits)))
        .select("box_id", *FRAME, "class_label", "reason", value.alias("value"))
    )


def drop_breakdown(boxes: DataFrame, limits: dict | None = None) -> DataFrame:
    """Drops per class and rule with their share of the class, in one pass over the boxes."""
    rules = failed_rules(limits)
    counted = box_stats(boxes).groupBy("class_label").agg(
        F.count(F.lit(1)).alias("n_class"), *[F.count_if(c).alias(name) for name, c in rules.items()]
    )
    listed = F.array(*[F.struct(F.lit(n).alias("reason"), F.col(n).alias("n_dropped")) for n in rules])
    return (
        counted.select("class_label", "n_class", F.explode(listed).alias("d"))
        .select("class_label", "d.reason", "d.n_dropped", (100.0 * F.col("d.n_dropped") / F.col("n_class")).alias("pct"))
        .filter("n_dropped > 0")
    )


def frame_drops(boxes: DataFrame, limits: dict | None = None) -> DataFrame:
    kept = F.count_if(~_any_broken(limits))
    total = F.count(F.lit(1))
    return box_stats(boxes).groupBy(*FRAME).agg(
        total.alias("n_original"),
        kept.alias("n_kept"),
        (total - kept).alias("n_dropped"),
        (100.0 * (total - kept) / total).alias("drop_pct"),
        (kept == 0).alias("all_lost"),
    )


def lost_frames(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Frames that had boxes before cleaning and none after."""
    return raw.select(*FRAME).distinct().join(clean.select(*FRAME).distinct(), FRAME, "left_anti")


def box_qa_overview(boxes: DataFrame) -> DataFrame:
    per_frame = boxes.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n"))
    per_scene = per_frame.groupBy("scene").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("frames"))
    return per_scene.agg(
        F.sum("n").alias("total_boxes"), F.count(F.lit(1)).alias("scenes"), F.sum("frames").alias("frames_with_objects")
    )


def box_qa_by_class(boxes: DataFrame) -> DataFrame:
    """Count, share and median size per class; the medians stay exact for classes of any size."""
    known = boxes.filter(F.col("class_label").isin(CLASS_NAMES))
    counts = boxes.groupBy("class_label").agg(F.count(F.lit(1)).alias("n"))
    share = counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy()))
    values = ["num_points", *DIMS]
    medians = wide_percentiles(known, ["class_label"], values, [0.5])
    names = {(v, 0.5): f"median_{v.replace('bbox_', '')}" for v in values}
    return share.join(pivot_percentiles(medians, ["class_label"], names), "class_label")


def objects_per_frame(boxes: DataFrame) -> DataFrame:
    """Mean, median, largest and smallest number of boxes of the frames that have any."""
    sizes = boxes.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n"))
    # Few distinct sizes exist, so the median is taken over sizes weighted by their frames.
    histogram = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("frames"))
    return histogram.agg(
        F.sum("frames").alias("frames"),
        (F.sum(F.col("n") * F.col("frames")) / F.sum("frames")).alias("mean"),
        F.percentile("n", 0.5, F.col("frames")).alias("median"),
        F.max("n").alias("max"),
        F.min("n").alias("min"),
    )


def objects_matrix(boxes: DataFrame) -> DataFrame:
    """Boxes per frame and class, one column per class."""
    per_class = [F.count_if(F.col("class_label") == c).alias(f"n_{_short(c)}") for c in CLASS_NAMES]
    return boxes.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n"), *per_class)


def class_balance(boxes: DataFrame) -> DataFrame:
    counts = boxes.groupBy("scene").pivot("class_label", CLASS_NAMES).count().fillna(0)
    total = boxes.groupBy("scene").agg(F.count(F.lit(1)).alias("total"))
    return counts.select("scene", *[F.col(c).alias(_short(c)) for c in CLASS_NAMES]).join(total, "scene")


def box_issues(boxes: DataFrame) -> DataFrame:
    """Issue table (issue, class_label, value): few points, huge boxes, imbalance, crowded frames."""
    stats = box_stats(boxes)
    everything = F.lit("all").alias("class_label")
    by_class = stats.groupBy("class_label").agg(
        F.count_if(F.col("num_points") < 20).alias("low"),
        F.count_if(F.col("max_dim") > 150).alias("huge"),
        F.count(F.lit(1)).alias("n"),
    )
    low = by_class.filter("low > 0").select(
        F.lit("low_points").alias("issue"), "class_label", F.col("low").cast("double").alias("value")
    )
    huge = by_class.agg(F.sum("huge").alias("v")).filter("v > 0").select(
        F.lit("huge_boxes").alias("issue"), everything, F.col("v").cast("double").alias("value")
    )
    ratio = by_class.agg((F.max("n") / F.min("n")).alias("v")).filter("v > 10").select(
        F.lit("class_imbalance").alias("issue"), everything, F.col("v").alias("value")
    )
    crowded = boxes.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 30).alias("v"))
    crowded = crowded.filter("v > 0").select(
        F.lit("crowded_frames").alias("issue"), everything, F.col("v").cast("double").alias("value")
    )
    return low.unionByName(huge).unionByName(ratio).unionByName(crowded)


def readiness(boxes: DataFrame) -> DataFrame:
    """Six checks before training: check name and verdict."""
    bad = lambda c: c.isNull() | F.isnan(c)
    any_bad = lambda names: F.count_if(F.array_contains(F.array(*[bad(F.col(n)) for n in names]), True)) == 0
    # Scenes and labels are few: group first, count the groups after.
    pairs = boxes.groupBy("scene", "class_label").agg(
        F.count(F.lit(1)).alias("n"),
        any_bad(["bbox_center_x", "bbox_center_y", "bbox_center_z"]).alias("centres"),
        any_bad(DIMS).alias("dims"),
        (F.count_if(F.least(*DIMS) <= 0) == 0).alias("positive"),
    )
    verdicts = pairs.agg(
        (F.count_distinct("class_label") == 4).alias("four_classes"),
        (F.count_distinct("scene") >= 5).alias("multiple_scenes"),
        (F.sum("n") > 500).alias("enough_boxes"),
        F.bool_and("centres").alias("no_missing_centres"),
        F.bool_and("dims").alias("no_missing_dims"),
        F.bool_and("positive").alias("positive_dims"),
    )
    return verdicts.unpivot([], verdicts.columns, "check_name", "passed")


def inspect_frame(boxes: DataFrame, scene: str, pose_index: int, limits: dict | None = None) -> DataFrame:
    """Verdict of every rule on every box of one frame."""
    frame = box_stats(boxes.filter((F.col("scene") == scene) & (F.col("pose_index") == pose_index)))
    rules = failed_rules(limits)
    return frame.select(
        "box_id",
        *FRAME,
        "class_label",
        *[(~broken).alias(f"{name}_ok") for name, broken in rules.items()],
        F.when(_any_broken(limits), "DROP").otherwise("KEEP").alias("verdict"),
        F.concat_ws(",", _broken(limits)).alias("failed"),
    )


def inspect_worst(boxes: DataFrame, n: int = 10, limits: dict | None = None) -> DataFrame:
    drops = frame_drops(boxes, limits)
    return drops.orderBy(F.desc("all_lost"), F.desc("drop_pct"), *FRAME).limit(n)


def list_drops(raw: DataFrame, clean: DataFrame, class_label: str, reason: str, limits: dict | None = None) -> DataFrame:
    """Boxes of a class dropped for one rule: its frame's box count of the class and whether the class survives there."""
    if reason not in RULES:
        raise ValueError(f"reason must be one of {', '.join(RULES)}")
    of_class = box_stats(raw.filter(F.col("class_label") == class_label))
    dropped = of_class.filter(failed_rules(limits)[reason])
    in_frame = of_class.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n_in_frame"))
    left = (
        clean.filter(F.col("class_label") == class_label).select(*FRAME).distinct().withColumn("survives", F.lit(True))
    )
    return (
        dropped.join(in_frame, FRAME)
        .join(left, FRAME, "left")
        .select(
            "box_id",
            *FRAME,
            "num_points",
            "max_dim",
            "volume",
            "aspect_ratio",
            "n_in_frame",
            F.coalesce("survives", F.lit(False)).alias("class_survives"),
        )
    )


def frame_completeness(frames: DataFrame, expected: int = 100) -> DataFrame:
    present = frames.select(*FRAME).distinct().groupBy("scene").agg(F.count(F.lit(1)).alias("frames"))
    return present.select("scene", "frames", F.lit(expected).alias("expected"), (F.col("frames") == expected).alias("complete"))


def box_outliers(boxes: DataFrame) -> DataFrame:
    """Every box that is tiny, huge or thin on points, or stands in a crowded frame; one row per finding."""
    crowded = (
        boxes.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n")).filter("n > 30").select(*FRAME, F.lit(True).alias("crowded"))
    )
    findings = {
        "tiny": F.greatest(*DIMS) < 0.5,
        "huge": F.greatest(*DIMS) > 200,
        "low_points": F.col("num_points") < 20,
        "crowded": F.coalesce("crowded", F.lit(False)),
    }
    marks = F.array(*[F.when(hit, F.lit(name)) for name, hit in findings.items()])
    return (
        boxes.join(crowded, FRAME, "left")
        .withColumn("finding", F.explode(F.filter(marks, lambda m: m.isNotNull())))
        .select("box_id", *FRAME, "class_label", "finding", *DIMS, "num_points")
    )


def empty_frames(manifest: DataFrame, boxes: DataFrame) -> DataFrame:
    return manifest.select(*FRAME).join(boxes.select(*FRAME).distinct(), FRAME, "left_anti")


def size_distribution(boxes: DataFrame) -> DataFrame:
    """Five-number summary of width, length and height per class."""
    marks = {0.0: "min", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "max"}
    stats = wide_percentiles(boxes, ["class_label"], DIMS, list(marks))
    picked = [F.max(F.when(F.col("p") == F.lit(p), F.col("value"))).alias(name) for p, name in marks.items()]
    return stats.groupBy("class_label", F.col("metric").alias("dimension")).agg(*picked)


def points_distribution(boxes: DataFrame) -> DataFrame:
    marks = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    stats = wide_percentiles(boxes, ["class_label"], ["num_points"], list(marks))
    quartiles = pivot_percentiles(stats, ["class_label"], {("num_points", p): name for p, name in marks.items()})
    spread = boxes.groupBy("class_label").agg(
        F.count(F.lit(1)).alias("n"), F.min("num_points").alias("min"), F.max("num_points").alias("max")
    )
    return spread.join(quartiles, "class_label")


def compare_runs(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """Boxes per class in two runs and their difference, with a TOTAL row."""
    tagged = run_a.select("class_label", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        run_b.select("class_label", F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    return (
        tagged.rollup("class_label")
        .agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
        .select(F.coalesce("class_label", F.lit("TOTAL")).alias("class_label"), "n_a", "n_b", (F.col("n_b") - F.col("n_a")).alias("delta"))
    )


def compare_runs_frames(run_a: DataFrame, run_b: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` frames whose box count differs most between two runs; a missing frame counts 0."""
    count = lambda df, name: df.groupBy(*FRAME).agg(F.count(F.lit(1)).alias(name))
    both = count(run_a, "n_a").join(count(run_b, "n_b"), FRAME, "full_outer").fillna(0, ["n_a", "n_b"])
    return (
        both.withColumn("difference", F.abs(F.col("n_b") - F.col("n_a")))
        .orderBy(F.desc("difference"), *FRAME)
        .limit(n)
    )
