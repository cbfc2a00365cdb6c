"""Voxel consolidation fed frame by frame with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skysweep.operators.voxels import VOXEL, merged_sums, running_sums, voxel_cells


def start_voxel_parts(points: DataFrame, path: str, checkpoint: str, size: float = 0.5) -> StreamingQuery:
    """Append partial sums per (voxel, frame) batch by batch; ``voxels_from_parts`` counts frames exactly.

    A batch that is run again writes the same folder again, so a restart adds nothing twice. No state is kept.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        partial = voxel_cells(batch, size).groupBy(*VOXEL, "pose_index").agg(*running_sums())
        partial.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = points.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def voxels_from_parts(parts: DataFrame) -> DataFrame:
    per_frame = parts.groupBy(*VOXEL, "pose_index").agg(*merged_sums())
    return per_frame.groupBy(*VOXEL).agg(F.count(F.lit(1)).alias("frame_count"), *merged_sums())
