"""Sources, frames and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysweep import schema
from skysweep.checks.registry import Inputs, query
from skysweep.checks.sqltext import r, with_ctes
from skysweep.functions.columns import half_turn, rnd, wrap_angle
from skysweep.operators import frames
from skysweep.sources import tables

BOX_COLUMNS = [
    "box_id", "scene", "pose_index", "ego_x", "ego_y", "ego_z", "ego_yaw", "bbox_center_x", "bbox_center_y",
    "bbox_center_z", "bbox_width", "bbox_length", "bbox_height", "bbox_yaw", "class_id", "class_label", "num_points",
    "confidence",
]


def _round_trip(inp: Inputs, df, name: str, file_format: str = "csv") -> str:
    """Write a table for a reader to read."""
    path = f"{inp.work_folder}/{name}"
    df.write.option("header", True).format(file_format).save(path)
    return path


def _wide(df):
    """Small whole numbers as DuckDB has them."""
    return df.withColumns({c: F.col(c).cast("int") for c in ("reflectivity", "r", "g", "b")})


@query("scan_returns", with_ctes("returns", "select * from returns"))
def _(inp: Inputs):
    return _wide(tables.scan_returns(inp.spark, _round_trip(inp, inp.returns, "returns", "parquet")))


@query("scan_returns_csv", with_ctes("returns", "select * from returns"))
def _(inp: Inputs):
    # In another order and with a column too many: columns are found by name.
    shuffled = inp.returns.select(F.lit(1).alias("extra"), *reversed(inp.returns.columns))
    return _wide(tables.scan_returns(inp.spark, _round_trip(inp, shuffled, "returns"), "csv"))


_SCANNED = """select scene, pose_index, 'f' as frame_file, ego_x, ego_y, ego_z, ego_yaw, bbox_center_x, bbox_center_y, bbox_center_z, bbox_width, bbox_length,
bbox_height, bbox_yaw, class_id as "class_ID", class_label, num_points from boxes"""


def _box_file(inp: Inputs) -> str:
    named = inp.boxes.withColumn("frame_file", F.lit("f")).withColumnRenamed("class_id", "class_ID")
    return _round_trip(inp, named.select(*schema.BOXES_SCHEMA.names), "boxes")


@query("scan_boxes", with_ctes("boxes", _SCANNED))
def _(inp: Inputs):
    return tables.scan_boxes(inp.spark, _box_file(inp))


@query("scan_boxes_frame", with_ctes("boxes", f"{_SCANNED} where scene = 'scene_3' and pose_index = 7"))
def _(inp: Inputs):
    return tables.scan_boxes(inp.spark, _box_file(inp), "scene_3", 7)


@query(
    "scan_frame",
    with_ctes("points", "select * from points where scene = 'scene_2' and pose_index = 0"),
)
def _(inp: Inputs):
    return tables.scan_frame(inp.points, "scene_2", 0)


@query("scenes_subset", with_ctes("frames", "select * from frames where scene in ('scene_2', 'scene_5')"))
def _(inp: Inputs):
    return tables.scenes_subset(inp.frames, ["scene_2", "scene_5"])


@query("first_n_frames", with_ctes("frames", "select * from frames order by scene, pose_index limit 7"))
def _(inp: Inputs):
    return frames.first_n_frames(inp.frames, 7)


@query(
    "write_submission",
    with_ctes(
        "boxes",
        """select ego_x, ego_y, ego_z, ego_yaw, bbox_center_x, bbox_center_y, bbox_center_z, bbox_width, bbox_length,
bbox_height, bbox_yaw, class_id as "class_ID", class_label from boxes""",
    ),
)
def _(inp: Inputs):
    path = f"{inp.work_folder}/submission"
    tables.write_submission(inp.boxes, path)
    kinds = tables.submission(inp.boxes).schema
    return inp.spark.read.schema(kinds).option("header", True).option("enforceSchema", False).csv(path)


MANIFEST = """manifest as (select scene, pose_index, ego_x, ego_y, ego_z, ego_yaw, count(*) as num_points_raw,
  count(*) filter (distance_cm > 0) as num_points_valid, count(*) filter (distance_cm <= 0) as num_invalid_dropped
from returns join frames using (scene, ego_x, ego_y, ego_z, ego_yaw) group by all having num_points_valid > 0)"""


@query(
    "incremental_frames",
    with_ctes(
        "frames",
        """select scene, pose_index, ego_x, ego_y, ego_z, ego_yaw, num_points_raw, num_points_valid, num_invalid_dropped
from manifest where pose_index % 3 <> 0
union all select scene, pose_index, ego_x, ego_y, ego_z, ego_yaw, -1, num_points_valid, -1
from manifest where pose_index % 3 = 0""",
        extra=MANIFEST,
    ),
)
def _(inp: Inputs):
    manifest = frames.frame_manifest(inp.returns_unnumbered)
    counted = [*schema.FRAME, *schema.POSE, "num_points_raw", "num_points_valid", "num_invalid_dropped"]
    done = manifest.filter("pose_index % 3 = 0").select(*schema.FRAME, *schema.POSE, "num_points_valid")
    return tables.incremental_manifest(manifest.select(*counted), done)


@query(
    "skip_existing_scenes",
    with_ctes("frames", "select distinct scene from frames where scene not in ('scene_1', 'scene_4')"),
)
def _(inp: Inputs):
    scenes = inp.frames.select("scene").distinct()
    return tables.skip_existing_scenes(scenes, inp.frames.filter(F.col("scene").isin("scene_1", "scene_4")))


@query(
    "drop_missing_frames",
    with_ctes(
        "frames boxes",
        """select distinct b.scene, b.pose_index from boxes b
where exists (select 1 from frames f where f.scene = b.scene and f.pose_index = b.pose_index)""",
    ),
)
def _(inp: Inputs):
    listed = inp.boxes.select(*schema.FRAME).distinct()
    return tables.drop_missing_frames(listed, inp.frames)


@query(
    "drop_missing_frames_count",
    with_ctes(
        "frames boxes",
        """select scene, count(*) as missing_frames from (select distinct b.scene, b.pose_index from boxes b) b
where not exists (select 1 from frames f where f.scene = b.scene and f.pose_index = b.pose_index) group by scene""",
    ),
)
def _(inp: Inputs):
    listed = inp.boxes.select(*schema.FRAME).distinct()
    return tables.count_missing_frames(listed, inp.frames)


@query(
    "class_params",
    with_ctes(
        "points",
        """select p.class_label, count(*) as n_points, v.eps, v.min_samples, v.min_cluster_points, v.bbox_padding,
  v.merge_enabled, v.merge_distance, v.max_points, v.voxel_size, v.reassign_multiplier
from points p join (values ('Antenna', 5e0, 10, 8, 0.5e0, true, 30e0), ('Cable', 8e0, 3, 5, 0.4e0, true, 0.4e0),
  ('Electric Pole', 5e0, 10, 8, 0.5e0, true, 15e0), ('Wind Turbine', 8e0, 15, 15, 1e0, true, 50e0)) c(class_label, eps,
  min_samples, min_cluster_points, bbox_padding, merge_enabled, merge_distance) using (class_label),
  lateral (select c.eps, c.min_samples, c.min_cluster_points, c.bbox_padding, c.merge_enabled, c.merge_distance,
  25000 as max_points, 0.2e0 as voxel_size, 3e0 as reassign_multiplier) v group by all""",
    ),
)
def _(inp: Inputs):
    params = schema.class_params(inp.spark, schema.RUN_TUNED)
    counts = inp.points_unnumbered.groupBy("class_label").agg(F.count(F.lit(1)).alias("n_points"))
    return counts.join(params.drop("class_id"), "class_label")


@query("frame_index", with_ctes("frames", "select * from frames"))
def _(inp: Inputs):
    return inp.frames


@query(
    "frame_points",
    with_ctes("frames", "select * exclude (num_points) from returns join frames using (scene, ego_x, ego_y, ego_z, ego_yaw)"),
)
def _(inp: Inputs):
    return frames.frame_points(inp.returns, inp.frames)


@query("drop_invalid", with_ctes("returns", "select * from returns where distance_cm > 0"))
def _(inp: Inputs):
    return frames.drop_invalid(inp.returns)


@query(
    "to_cartesian",
    with_ctes("points", "select * exclude (pose_index, class_id, class_label) from points"),
)
def _(inp: Inputs):
    return frames.to_cartesian(frames.drop_invalid(inp.returns))


@query(
    "assign_class",
    with_ctes("points", "select scene, point_id, ego_x, r, g, b, class_id, class_label from points"),
)
def _(inp: Inputs):
    valid = frames.drop_invalid(inp.returns)
    return frames.assign_class(valid).select("scene", "point_id", "ego_x", "r", "g", "b", "class_id", "class_label")


def _ids(*names: str) -> str:
    return ", ".join(["scene", "pose_index", "point_id", *names])


@query(
    "local_to_world",
    with_ctes("world", f"select {_ids(*[f'{r(c, 4)} as {c}' for c in ('x_world', 'y_world', 'z_world')])} from world"),
)
def _(inp: Inputs):
    world = frames.local_to_world(inp.points)
    return world.select(*schema.FRAME, "point_id", *[rnd(c, 4).alias(c) for c in ("x_world", "y_world", "z_world")])


@query(
    "world_to_local",
    with_ctes("world", f"select {_ids(r('x', 3) + ' as x_local', r('y', 3) + ' as y_local', r('z', 3) + ' as z_local')} from back",
        extra="""back as (select scene, pose_index, point_id,
  (x_world - ego_x/100)*cos(radians(ego_yaw)) + (y_world - ego_y/100)*sin(radians(ego_yaw)) + 1e-9 as x,
  -(x_world - ego_x/100)*sin(radians(ego_yaw)) + (y_world - ego_y/100)*cos(radians(ego_yaw)) + 1e-9 as y,
  z_world - ego_z/100 + 1e-9 as z from world)"""),
)
def _(inp: Inputs):
    # Coordinates carry four decimals; the tiny shift keeps exact half steps from rounding either way.
    local = frames.world_to_local(frames.local_to_world(inp.points))
    shifted = [rnd(F.col(c) + F.lit(1e-9), 3).alias(c) for c in ("x_local", "y_local", "z_local")]
    return local.select(*schema.FRAME, "point_id", *shifted)


@query(
    "box_to_world",
    with_ctes(
        "boxes",
        f"""select box_id,
{r('bbox_center_x*cos(radians(ego_yaw)) - bbox_center_y*sin(radians(ego_yaw)) + ego_x/100', 4)} as x_world,
{r('bbox_center_x*sin(radians(ego_yaw)) + bbox_center_y*cos(radians(ego_yaw)) + ego_y/100', 4)} as y_world,
{r('bbox_center_z + ego_z/100', 4)} as z_world, {r('radians(ego_yaw) + bbox_yaw', 6)} as yaw_world from boxes""",
    ),
)
def _(inp: Inputs):
    world = frames.box_to_world(inp.boxes)
    metric = [rnd(c, 4).alias(c) for c in ("x_world", "y_world", "z_world")]
    return world.select("box_id", *metric, rnd("yaw_world", 6).alias("yaw_world"))


@query(
    "elevation_angle",
    with_ctes("points", f"select {_ids(r('atan2(z, sqrt(x*x + y*y) + 1e-8)', 6) + ' as elevation')} from points"),
)
def _(inp: Inputs):
    return inp.points.select(*schema.FRAME, "point_id", rnd(frames.elevation_angle(), 6).alias("elevation"))


@query(
    "norm_reflectivity",
    with_ctes("points", f"select {_ids(r('reflectivity / 255e0', 6) + ' as reflectivity_norm')} from points"),
)
def _(inp: Inputs):
    return inp.points.select(*schema.FRAME, "point_id", rnd(frames.norm_reflectivity(), 6).alias("reflectivity_norm"))


@query(
    "frame_manifest",
    with_ctes(
        "frames",
        f"""select *, {r('100e0*num_points_valid/num_points_raw', 6)} as valid_pct,
concat('processed/', scene, '/frame_', lpad(cast(pose_index as varchar), 3, '0'), '.parquet') as file from manifest""",
        extra=MANIFEST,
    ),
)
def _(inp: Inputs):
    return frames.frame_manifest(inp.returns_unnumbered).withColumn("valid_pct", rnd("valid_pct", 6))


@query(
    "manifest_summary",
    with_ctes(
        "frames",
        f"""select scene, count(*) as frames, cast(sum(num_points_valid) as bigint) as total_points,
{r('avg(num_points_valid)', 6)} as mean_points,
{r('100e0*sum(num_invalid_dropped)/sum(num_points_raw)', 6)} as invalid_pct from manifest group by rollup (scene)""",
        extra=MANIFEST,
    ),
)
def _(inp: Inputs):
    summary = frames.manifest_summary(frames.frame_manifest(inp.returns_unnumbered))
    return summary.withColumns({c: rnd(c, 6) for c in ("mean_points", "invalid_pct")})


@query(
    "rewrite_paths",
    with_ctes("boxes", "select box_id, replace(concat('processed/', scene, '/', cast(pose_index as varchar)), 'processed/', 'cleaned/') as frame_file from boxes"),
)
def _(inp: Inputs):
    path = F.concat(F.lit("processed/"), "scene", F.lit("/"), F.col("pose_index").cast("string"))
    return frames.rewrite_paths(inp.boxes.select("box_id", path.alias("frame_file")))


@query(
    "split_by_scene",
    with_ctes(
        "frames",
        """select scene, pose_index, case when scene in ('scene_9', 'scene_10') then 'val' else 'train' end as split
from frames""",
    ),
)
def _(inp: Inputs):
    parts = [frames.split_by_scene(inp.frames, s).select(*schema.FRAME, F.lit(s).alias("split")) for s in ("train", "val")]
    return parts[0].unionByName(parts[1])


@query(
    "boxes_by_frame",
    with_ctes(
        "frames boxes",
        f"""select f.scene, f.pose_index, {', '.join('b.' + c for c in BOX_COLUMNS if c not in ('scene', 'pose_index') and not c.startswith('ego'))}
from frames f left join (select * from boxes where class_id >= 0) b on b.scene = f.scene and b.pose_index = f.pose_index""",
    ),
)
def _(inp: Inputs):
    return frames.boxes_by_frame(inp.frames, inp.boxes)


_TURN_X = "bbox_center_x + {dx}*cos(bbox_yaw) - {dy}*sin(bbox_yaw)"
_TURN_Y = "bbox_center_y + {dx}*sin(bbox_yaw) + {dy}*cos(bbox_yaw)"


def _turn(dx: str, dy: str, digits: int = 6) -> tuple[str, str]:
    return r(_TURN_X.format(dx=dx, dy=dy), digits), r(_TURN_Y.format(dx=dx, dy=dy), digits)


_BEV = _turn("(sx*bbox_width/2)", "(sy*bbox_length/2)")


@query(
    "box_corners_bev",
    with_ctes(
        "boxes",
        f"""select box_id, corner, {_BEV[0]} as corner_x, {_BEV[1]} as corner_y from boxes,
(values (0,-1,-1), (1,1,-1), (2,1,1), (3,-1,1), (4,-1,-1)) c(corner, sx, sy)""",
    ),
)
def _(inp: Inputs):
    corners = frames.box_corners_bev(inp.boxes)
    return corners.withColumns({c: rnd(c, 6) for c in ("corner_x", "corner_y")})


_C3 = _turn("(sx*bbox_length/2)", "(sy*bbox_width/2)")


@query(
    "box_corners_3d",
    with_ctes(
        "boxes",
        f"""select box_id, corner, {_C3[0]} as corner_x, {_C3[1]} as corner_y,
{r('bbox_center_z + sz*bbox_height/2', 6)} as corner_z from boxes,
(values (0,-1,-1,-1), (1,-1,-1,1), (2,-1,1,-1), (3,-1,1,1), (4,1,-1,-1), (5,1,-1,1), (6,1,1,-1), (7,1,1,1)) c(corner, sx, sy, sz)""",
    ),
)
def _(inp: Inputs):
    corners = frames.box_corners_3d(inp.boxes)
    return corners.withColumns({c: rnd(c, 6) for c in ("corner_x", "corner_y", "corner_z")})


_EA = _turn("(a.sx*bbox_width/2)", "(a.sy*bbox_length/2)")
_EB = _turn("(b.sx*bbox_width/2)", "(b.sy*bbox_length/2)")


@query(
    "box_edges_3d",
    with_ctes(
        "boxes",
        f"""select box_id, edge, {_EA[0]} as x1, {_EA[1]} as y1, {r('bbox_center_z + a.sz*bbox_height/2', 6)} as z1,
{_EB[0]} as x2, {_EB[1]} as y2, {r('bbox_center_z + b.sz*bbox_height/2', 6)} as z2
from boxes, (values (0,0,1), (1,1,2), (2,2,3), (3,3,0), (4,4,5), (5,5,6), (6,6,7), (7,7,4), (8,0,4), (9,1,5), (10,2,6), (11,3,7)) e(edge, i, j)
join c a on a.corner = i join c b on b.corner = j""",
        extra="c as (select * from (values (0,-1,-1,-1), (1,1,-1,-1), (2,1,1,-1), (3,-1,1,-1), (4,-1,-1,1), (5,1,-1,1), (6,1,1,1), (7,-1,1,1)) t(corner, sx, sy, sz))",
    ),
)
def _(inp: Inputs):
    edges = frames.box_edges_3d(inp.boxes)
    return edges.withColumns({c: rnd(c, 6) for c in ("x1", "y1", "z1", "x2", "y2", "z2")})


@query(
    "box_side_rect",
    with_ctes(
        "boxes",
        f"""select box_id, {r('bbox_center_x - bbox_width/2', 6)} as x_low, {r('bbox_center_x + bbox_width/2', 6)} as x_high,
{r('bbox_center_z - bbox_height/2', 6)} as z_low, {r('bbox_center_z + bbox_height/2', 6)} as z_high from boxes""",
    ),
)
def _(inp: Inputs):
    return frames.box_side_rect(inp.boxes).withColumns({c: rnd(c, 6) for c in ("x_low", "x_high", "z_low", "z_high")})


@query("obstacles_only", with_ctes("points", "select * from points where class_id >= 0"))
def _(inp: Inputs):
    return frames.obstacles_only(inp.points)


@query(
    "range_clip",
    with_ctes(
        "points",
        """select * from points where x >= -20 and x < 312.8e0 and y >= -224 and y < 224 and z >= -100 and z < 120""",
    ),
)
def _(inp: Inputs):
    return frames.range_clip(inp.points)


@query(
    "frame_summary",
    with_ctes(
        "points",
        """select scene, pose_index, count(*) as num_points, min(x) as x_min, max(x) as x_max, min(y) as y_min, max(y) as y_max,
min(z) as z_min, max(z) as z_max, count(*) filter (class_id = 0) as n_antenna, count(*) filter (class_id = 1) as n_cable,
count(*) filter (class_id = 2) as n_electric_pole, count(*) filter (class_id = 3) as n_wind_turbine,
count(*) filter (class_id = -1) as n_background from points group by scene, pose_index""",
    ),
)
def _(inp: Inputs):
    return frames.frame_summary(inp.points_unnumbered)


@query(
    "fn_geometry",
    with_ctes(
        "points",
        f"select {_ids(r('sqrt(x*x + y*y + z*z)', 4) + ' as distance', r('degrees(atan2(y, x))', 4) + ' as azimuth', r('exp(-least(greatest(abs(z), 0), 10))', 6) + ' as decay', r('ln(1 + sqrt(x*x + y*y))', 6) + ' as log_range', 'cast(ceil(z) as bigint) as z_up')} from points",
    ),
)
def _(inp: Inputs):
    square = lambda *axes: sum((F.col(a) * F.col(a) for a in axes[1:]), F.col(axes[0]) * F.col(axes[0]))
    return inp.points.select(
        *schema.FRAME,
        "point_id",
        rnd(F.sqrt(square("x", "y", "z")), 4).alias("distance"),
        rnd(F.degrees(F.atan2("y", "x")), 4).alias("azimuth"),
        rnd(F.exp(-F.least(F.greatest(F.abs("z"), F.lit(0.0)), F.lit(10.0))), 6).alias("decay"),
        rnd(F.log(1 + F.sqrt(square("x", "y"))), 6).alias("log_range"),
        F.ceil("z").alias("z_up"),
    )


@query(
    "fn_angle",
    with_ctes(
        "boxes",
        f"""select box_id, {r('wrapped', 6)} as wrapped,
{r('case when wrapped > pi()/2 then wrapped - pi() when wrapped <= -pi()/2 then wrapped + pi() else wrapped end', 6)} as axis
from (select box_id, atan2(sin(bbox_yaw + radians(ego_yaw)), cos(bbox_yaw + radians(ego_yaw))) as wrapped from boxes) b""",
    ),
)
def _(inp: Inputs):
    yaw = F.col("bbox_yaw") + F.radians("ego_yaw")
    return inp.boxes.select("box_id", rnd(wrap_angle(yaw), 6).alias("wrapped"), rnd(half_turn(yaw), 6).alias("axis"))


@query(
    "fn_frame_name",
    with_ctes(
        "frames",
        """select scene, pose_index, concat('frame_', lpad(cast(pose_index as varchar), 3, '0')) as frame,
cast(split_part(scene, '_', 2) as int) as scene_number from frames""",
    ),
)
def _(inp: Inputs):
    return inp.frames.select(
        *schema.FRAME,
        F.format_string("frame_%03d", F.col("pose_index")).alias("frame"),
        F.split("scene", "_")[1].cast("int").alias("scene_number"),
    )
