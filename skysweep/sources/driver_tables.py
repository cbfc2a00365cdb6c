"""Lidar tables derived from the supplied order tables, for tests, checks and the bench.

``lineitem`` stands in for raw sensor returns (one frame per supplier) and ``orders`` for predicted boxes (one frame
per customer). All values come from whole-number arithmetic, so any engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysweep.functions.ranks import rank_in_group

POINT_ORDER = [
    "l_orderkey",
    "l_partkey",
    "l_linenumber",
    "l_extendedprice",
    "l_quantity",
    "l_discount",
    "l_tax",
    "l_shipdate",
]
_MARKS = {1: (38, 23, 180), 2: (177, 132, 47), 3: (129, 81, 97), 4: (66, 132, 9)}


def _mark(channel: int):
    column = F.lit(128)
    for number, colour in _MARKS.items():
        column = F.when(F.col("l_linenumber") == number, colour[channel]).otherwise(column)
    return column


def returns(spark: SparkSession, folder: str, numbered: bool = True) -> DataFrame:
    """Raw returns. ``numbered=False`` leaves out ``point_id`` and the ranking it costs."""
    items = spark.read.parquet(f"{folder}/lineitem.parquet")
    columns = [
        F.concat(F.lit("scene_"), (F.col("l_suppkey") % 10 + 1).cast("string")).alias("scene"),
        (F.col("l_suppkey") * 137).cast("double").alias("ego_x"),
        (F.col("l_suppkey") * 71).cast("double").alias("ego_y"),
        F.lit(14000.0).alias("ego_z"),
        (F.col("l_suppkey") * 29 % 360 - 180).cast("double").alias("ego_yaw"),
        F.when(F.col("l_linenumber") == 7, 0.0)
        .otherwise((F.floor("l_extendedprice").cast("long") % 30000).cast("double"))
        .alias("distance_cm"),
        (F.col("l_partkey") * 37 % 12000 - 6000).cast("double").alias("azimuth_raw"),
        (F.col("l_orderkey") * 13 % 3000 - 1500).cast("double").alias("elevation_raw"),
        (F.col("l_quantity") * 5).cast("int").alias("reflectivity"),
        _mark(0).alias("r"),
        _mark(1).alias("g"),
        _mark(2).alias("b"),
    ]
    if not numbered:
        return items.select(*columns)
    ranked = rank_in_group(
        items.select("l_suppkey", *POINT_ORDER), ["l_suppkey"], F.col("l_orderkey"), 65536, POINT_ORDER, "__rn"
    )
    return ranked.select(*columns[:5], (F.col("__rn").cast("long") - 1).alias("point_id"), *columns[5:])


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted boxes with confidence; priority 5 gives an unknown class."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    key, customer, price = F.col("o_orderkey"), F.col("o_custkey"), F.floor("o_totalprice").cast("long")
    priority = F.substring("o_orderpriority", 1, 1)
    cents = lambda whole: whole / F.lit(100.0)
    class_id = F.when(priority.isin("1", "2", "3", "4"), priority.try_cast("int") - 1).otherwise(-1)
    label = (
        F.when(priority == "1", "Antenna")
        .when(priority == "2", "Cable")
        .when(priority == "3", "Electric Pole")
        .when(priority == "4", "Wind Turbine")
        .otherwise("Unknown")
    )
    return orders.select(
        key.alias("box_id"),
        F.concat(F.lit("scene_"), (customer % 10 + 1).cast("string")).alias("scene"),
        F.floor(customer / 10).cast("int").alias("pose_index"),
        (customer * 137).cast("double").alias("ego_x"),
        (customer * 71).cast("double").alias("ego_y"),
        F.lit(14000.0).alias("ego_z"),
        (customer * 29 % 360 - 180).cast("double").alias("ego_yaw"),
        cents(key * 37 % 2000).alias("bbox_center_x"),
        cents(key * 53 % 2000 - 1000).alias("bbox_center_y"),
        cents(key * 17 % 1000).alias("bbox_center_z"),
        cents(key * 13 % 3000 + 50).alias("bbox_width"),
        cents(key * 7 % 2000 + 30).alias("bbox_length"),
        cents(price % 6000 + 30).alias("bbox_height"),
        cents(key * 11 % 628 - 314).alias("bbox_yaw"),
        class_id.alias("class_id"),
        label.alias("class_label"),
        (price % 200).alias("num_points"),
        ((key * 29 % 1000) / F.lit(1000.0)).alias("confidence"),
    )


def ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    """Reference boxes: six in seven of the predictions, moved by 0.4 m along x."""
    return (
        boxes(spark, folder)
        .filter(F.col("box_id") % 7 != 0)
        .withColumn("bbox_center_x", F.col("bbox_center_x") + F.lit(0.4))
    )
