"""Collects the registered queries, their inputs and the SQL each one is checked against."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from skysweep.operators import frames
from skysweep.sources import driver_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Inputs:
    """The lidar tables of one data folder, planned on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @cached_property
    def work_folder(self) -> str:
        """A new folder for queries that write, next to the checkpoints of the session."""
        shared = self.spark.conf.get("spark.checkpoint.dir", None)
        if shared is not None:
            return f"{shared}/work-{uuid.uuid4().hex}"
        if not self.spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        return tempfile.mkdtemp(prefix="skysweep-work-")

    @cached_property
    def returns(self) -> DataFrame:
        return driver_tables.returns(self.spark, self.folder)

    @cached_property
    def returns_unnumbered(self) -> DataFrame:
        return driver_tables.returns(self.spark, self.folder, numbered=False)

    @cached_property
    def frames(self) -> DataFrame:
        return frames.frame_index(self.returns_unnumbered)

    @cached_property
    def points(self) -> DataFrame:
        valid = frames.drop_invalid(self.returns)
        return frames.assign_class(frames.to_cartesian(frames.frame_points(valid, self.frames)))

    @cached_property
    def points_unnumbered(self) -> DataFrame:
        return frames.points_of(self.returns_unnumbered)

    @cached_property
    def boxes(self) -> DataFrame:
        return driver_tables.boxes(self.spark, self.folder)

    @cached_property
    def ground_truth(self) -> DataFrame:
        return driver_tables.ground_truth(self.spark, self.folder)


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` must give the same rows and column names."""

    def register(build: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Inputs(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return build

    return register
