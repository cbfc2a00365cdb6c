"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from skysweep.checks.all import QUERIES
from skysweep.session import local_session

HEADLINE = [
    "frame_manifest",
    "to_cartesian",
    "tile_ground",
    "survival_metrics",
    "clean_manifest_ext",
    "voxel_table",
    "pillar_features",
    "clean_boxes",
    "box_qa_by_class",
    "postprocess",
    "merge_boxes",
    "extract_boxes",
    "map_at_iou",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        if name not in QUERIES:
            continue
        started = time.time()
        # The sink takes every column of every row, so nothing is pruned away.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
