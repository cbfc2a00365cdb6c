"""Bird's-eye-view pillars, training targets and decoding of score maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skysweep.functions.columns import clip, draw, label_of, pick_by_class
from skysweep.operators.frames import norm_reflectivity, range_clip
from skysweep.schema import BEV, CLASS_NAMES, FRAME, GAUSSIAN_MIN_RADIUS, POSE

PILLAR = [*FRAME, "gx", "gy"]
CELL = [*FRAME, "class_id", "hx", "hy"]


def pillar_index(points: DataFrame, g: dict = BEV) -> DataFrame:
    """Points inside the range with their grid cell."""
    cell = lambda axis: F.floor((F.col(axis) - F.lit(g[f"{axis}_min"])) / F.lit(g["pillar"])).cast("int")
    clipped = range_clip(points, g)
    return clipped.withColumns({"gx": clip(cell("x"), 0, g["grid_x"] - 1), "gy": clip(cell("y"), 0, g["grid_y"] - 1)})


def pillar_occupancy(points: DataFrame, g: dict = BEV) -> DataFrame:
    return pillar_index(points, g).groupBy(*PILLAR).agg(F.count(F.lit(1)).alias("n_points"))


def pillar_cap(points: DataFrame, g: dict = BEV) -> DataFrame:
    """At most ``max_pillars`` pseudo-random pillars per frame and the first ``max_points`` points of each.

    A frame has at most grid_x * grid_y pillars, so ranking them is bounded by the grid.
    """
    indexed = pillar_index(points, g)
    pillars = indexed.groupBy(*PILLAR).agg(F.count(F.lit(1)).alias("pillar_points"))
    flat = F.col("gx") * g["grid_y"] + F.col("gy")
    chosen = W.partitionBy(*FRAME).orderBy(draw("pillar", flat), flat)
    kept = pillars.withColumn("__rank", F.row_number().over(chosen)).filter(F.col("__rank") <= g["max_pillars"]).drop("__rank")
    first = W.partitionBy(*PILLAR).orderBy("point_id")
    # The plain rank filter lets Spark drop the surplus of a pillar before the shuffle.
    slotted = indexed.withColumn("__rn", F.row_number().over(first)).filter(F.col("__rn") <= g["max_points"])
    return slotted.withColumn("slot", F.col("__rn") - 1).drop("__rn").join(kept, PILLAR)


def pillar_features(points: DataFrame, g: dict = BEV) -> DataFrame:
    """Nine features per kept point: position, reflectivity, offsets from the pillar mean and from the cell centre.

    Means are taken over whole micrometres, so they do not depend on the order of the points. A pillar holds at most
    ``max_points`` of them and is sorted already, so its means are taken beside its points.
    """
    capped = pillar_cap(points, g)
    pillar = W.partitionBy(*PILLAR)
    whole = lambda a: F.sum(F.round(F.col(a) * 1000000).cast("long")).over(pillar)
    means = {f"m{a}": whole(a) / F.count(F.lit(1)).over(pillar) / 1000000 for a in "xyz"}
    centre = lambda axis: F.lit(g[f"{axis}_min"]) + (F.col(f"g{axis}") + 0.5) * F.lit(g["pillar"])
    return capped.withColumns(means).select(
        *PILLAR,
        "point_id",
        "slot",
        "x",
        "y",
        "z",
        norm_reflectivity().alias("r"),
        *[(F.col(a) - F.col(f"m{a}")).alias(f"{a}_c") for a in "xyz"],
        *[(F.col(a) - centre(a)).alias(f"{a}_p") for a in "xy"],
    )


def with_empty_frames(features: DataFrame, frames: DataFrame) -> DataFrame:
    """Give every frame without a pillar one zero pillar."""
    empty = frames.select(*FRAME).join(features.select(*FRAME).distinct(), FRAME, "left_anti")
    zero = [F.lit(0).cast(f.dataType).alias(f.name) for f in features.schema if f.name not in FRAME]
    return features.unionByName(empty.select(*FRAME, *zero))


def pack_pillars(features: DataFrame, g: dict = BEV) -> DataFrame:
    """One row per pillar with its features as an array of at most ``max_points`` rows in slot order."""
    names = ["x", "y", "z", "r", "x_c", "y_c", "z_c", "x_p", "y_p"]
    row = F.struct("slot", F.array(*[F.col(n).cast("float") for n in names]).alias("f"))
    packed = features.groupBy(*PILLAR).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return packed.select(*PILLAR, F.size("rows").alias("n_points"), F.transform("rows", lambda s: s["f"]).alias("features"))


def gaussian_radius(width: Column, length: Column, min_overlap: float = BEV["min_overlap"]) -> Column:
    """Heatmap radius of a footprint in cells: smallest of three root terms (without the usual divisor)."""
    area, around, m = width * length, width + length, F.lit(min_overlap)
    term = lambda b, ac4: (b + F.sqrt(b * b - ac4)) / 2
    return F.least(
        term(around, 4 * area * (1 - m) / (1 + m)),
        term(2 * around, 16 * (1 - m) * area),
        term(-2 * m * around, 16 * m * (m - 1) * area),
    )


def box_cells(boxes: DataFrame, g: dict = BEV) -> DataFrame:
    """Known-class boxes inside the map with exact and whole cell positions and the heatmap radius."""
    at = lambda axis: (F.col(f"bbox_center_{axis}") - F.lit(g[f"{axis}_min"])) / F.lit(g["cell"])
    size = gaussian_radius(F.col("bbox_width") / F.lit(g["cell"]), F.col("bbox_length") / F.lit(g["cell"]))
    placed = boxes.filter(F.col("class_label").isin(CLASS_NAMES)).withColumns({"px": at("x"), "py": at("y")})
    placed = placed.withColumns({"hx": F.floor("px").cast("int"), "hy": F.floor("py").cast("int")})
    inside = F.col("hx").between(0, g["hm_w"] - 1) & F.col("hy").between(0, g["hm_h"] - 1)
    return placed.filter(inside).withColumn("radius", F.greatest(size.cast("int"), pick_by_class(GAUSSIAN_MIN_RADIUS)))


def box_targets(boxes: DataFrame, g: dict = BEV) -> DataFrame:
    """Regression targets per cell; of several boxes in a cell the last one counts.

    ``object_index`` numbers the boxes of a frame in order; only the first ``max_objects`` carry one, others have -1.
    """
    placed = box_cells(boxes, g)
    last = F.max_by(
        F.struct(
            "box_id",
            (F.col("px") - F.col("hx")).alias("offset_x"),
            (F.col("py") - F.col("hy")).alias("offset_y"),
            F.col("bbox_center_z").alias("z"),
            *[F.log(F.greatest(F.col(f"bbox_{d}"), F.lit(0.1))).alias(f"log_{d}") for d in ("width", "length", "height")],
            F.sin("bbox_yaw").alias("sin_yaw"),
            F.cos("bbox_yaw").alias("cos_yaw"),
        ),
        "box_id",
    )
    cells = placed.groupBy(*FRAME, "hx", "hy").agg(last.alias("t"))
    first = W.partitionBy(*FRAME).orderBy("box_id")
    numbered = placed.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= g["max_objects"])
    index = numbered.select(*FRAME, "box_id", (F.col("rn") - 1).alias("object_index"))
    return (
        cells.select(*FRAME, "hx", "hy", "t.*")
        .join(index, [*FRAME, "box_id"], "left")
        .withColumn("object_index", F.coalesce("object_index", F.lit(-1)))
        .withColumn("mask", F.lit(1.0))
    )


def heatmap_splat(boxes: DataFrame, g: dict = BEV) -> DataFrame:
    """Sparse class heatmaps: per cell the largest of the Gaussians drawn around the box centres."""
    span = lambda at, limit: F.sequence(F.greatest(at - F.col("radius"), F.lit(0)), F.least(at + F.col("radius"), F.lit(limit - 1)))
    # Boxes of a cell and radius draw the same Gaussian once.
    drawn = box_cells(boxes, g).select(*FRAME, "class_id", F.col("hx").alias("ox"), F.col("hy").alias("oy"), "radius").distinct()
    cells = drawn.withColumn("hx", F.explode(span(F.col("ox"), g["hm_w"])))
    cells = cells.withColumn("hy", F.explode(span(F.col("oy"), g["hm_h"])))
    sigma = (2 * F.col("radius") + 1) / F.lit(6.0)
    dx, dy = F.col("hx") - F.col("ox"), F.col("hy") - F.col("oy")
    heat = F.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma))
    floor = F.lit(2.220446049250313e-16)
    return cells.withColumn("heat", heat).filter(F.col("heat") >= floor).groupBy(*CELL).agg(F.max("heat").alias("heat"))


def heatmap_check(boxes: DataFrame, heatmap: DataFrame, g: dict = BEV) -> DataFrame:
    """Peak, cells above one half and mean heat at the box centres, per frame and class.

    Heat and box centres meet in one aggregation by cell: the map is far larger than the boxes it is drawn from, so a join
    planned by the size of those would broadcast it.
    """
    group = [*FRAME, "class_id"]
    heat = heatmap.select(*CELL, "heat", F.lit(0).cast("long").alias("boxes"))
    centres = box_cells(boxes, g).select(*CELL, F.lit(None).cast("double").alias("heat"), F.lit(1).cast("long").alias("boxes"))
    cells = heat.unionByName(centres).dropna(subset=CELL).groupBy(*CELL).agg(F.max("heat").alias("heat"), F.sum("boxes").alias("boxes"))
    checked = cells.groupBy(*group).agg(
        F.max("heat").alias("peak"),
        F.count_if(F.col("heat") > 0.5).alias("hot_cells"),
        F.sum("boxes").alias("boxes"),
        F.min(F.when(F.col("boxes") > 0, F.coalesce("heat", F.lit(0.0)))).alias("lowest_centre"),
    )
    return checked.filter(F.col("peak").isNotNull() & (F.col("boxes") > 0))


def heatmap_nms(heatmap: DataFrame) -> DataFrame:
    """Cells that equal the largest value of their 3x3 surroundings."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = heatmap.withColumn("s", F.explode(steps)).select(
        *FRAME, "class_id", (F.col("hx") + F.col("s.i")).alias("hx"), (F.col("hy") + F.col("s.j")).alias("hy"),
        "heat", ((F.col("s.i") == 0) & (F.col("s.j") == 0)).alias("own"),
    )
    around = spread.groupBy(*CELL).agg(F.max("heat").alias("most"), F.max(F.when(F.col("own"), F.col("heat"))).alias("heat"))
    return around.filter(F.col("heat") == F.col("most")).select(*CELL, "heat")


def decode_boxes(heatmap: DataFrame, regressions: DataFrame, g: dict = BEV) -> DataFrame:
    """Boxes from score maps: local peaks above the threshold, the best per frame, with their regression cells."""
    peaks = heatmap_nms(heatmap).filter(F.col("heat") > F.lit(g["score_threshold"]))
    best = W.partitionBy(*FRAME).orderBy(F.desc("heat"), "class_id", "hy", "hx")
    top = peaks.withColumn("__rank", F.row_number().over(best)).filter(F.col("__rank") <= g["max_detections"]).drop("__rank")
    met = top.join(regressions, [*FRAME, "hx", "hy"])
    side = lambda d: F.least(F.exp(f"log_{d}"), F.lit(g["max_dim"])).alias(f"bbox_{d}")
    return met.select(
        *CELL,
        F.col("heat").alias("confidence"),
        ((F.col("hx") + F.col("offset_x")) * F.lit(g["cell"]) + F.lit(g["x_min"])).alias("bbox_center_x"),
        ((F.col("hy") + F.col("offset_y")) * F.lit(g["cell"]) + F.lit(g["y_min"])).alias("bbox_center_y"),
        F.col("z").alias("bbox_center_z"),
        side("width"),
        side("length"),
        side("height"),
        F.atan2("sin_yaw", "cos_yaw").alias("bbox_yaw"),
    )


def predictions_table(decoded: DataFrame, frames: DataFrame) -> DataFrame:
    """Decoded boxes with their frame pose and class label."""
    return decoded.join(frames, FRAME).select(
        *FRAME,
        *POSE,
        *[f"bbox_center_{a}" for a in "xyz"],
        "bbox_width",
        "bbox_length",
        "bbox_height",
        "bbox_yaw",
        F.col("class_id").alias("class_ID"),
        label_of().alias("class_label"),
        "confidence",
    )
