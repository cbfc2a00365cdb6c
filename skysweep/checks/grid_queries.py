"""Voxel consolidation, bird's-eye-view preparation, augmentation and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysweep import schema
from skysweep.checks.ground_queries import rounded
from skysweep.checks.registry import Inputs, query
from skysweep.checks.sqltext import cte, draw_sql, r, uniform_sql, with_ctes
from skysweep.functions.columns import rnd
from skysweep.operators import augment, bev, frames, voxels
from skysweep.streaming.voxel_stream import start_voxel_parts, voxels_from_parts

SIZE = 0.5
cte(
    "vworld",
    ["world"],
    """select *, cast(floor(x_world/0.5e0) as int) as vx, cast(floor(y_world/0.5e0) as int) as vy, cast(floor(z_world/0.5e0) as int) as vz,
  atan2(z, sqrt(x*x + y*y) + 1e-8) as elevation from world""",
)
cte(
    "vsums",
    ["vworld"],
    """select scene, vx, vy, vz, count(*) as hit_count, count(distinct pose_index) as frame_count, cast(sum(reflectivity) as double) as ref_sum,
  cast(sum(reflectivity*reflectivity) as double) as ref_sumsq, sum(z_world) as z_sum, sum(z_world*z_world) as z_sumsq, min(z_world) as z_min, max(z_world) as z_max,
  sum(elevation) as elev_sum, count(*) filter (class_id = 0) as votes_0, count(*) filter (class_id = 1) as votes_1, count(*) filter (class_id = 2) as votes_2,
  count(*) filter (class_id = 3) as votes_3, count(*) filter (class_id < 0) as votes_bg from vworld group by scene, vx, vy, vz""",
)
SUMS = ["z_sum", "z_sumsq", "z_min", "z_max", "elev_sum"]


def _sums(inp: Inputs):
    return voxels.voxel_accumulate(inp.points_unnumbered, SIZE)


@query(
    "voxel_accumulate",
    with_ctes("vsums", f"select * replace ({', '.join(f'{r(c, 4)} as {c}' for c in SUMS)}) from vsums"),
)
def _(inp: Inputs):
    return rounded(_sums(inp), SUMS, 4)


@query(
    "voxel_table",
    with_ctes(
        "vsums",
        f"""select scene, vx, vy, vz, (vx + 0.5e0)*0.5e0 as world_x, (vy + 0.5e0)*0.5e0 as world_y, (vz + 0.5e0)*0.5e0 as world_z, hit_count, frame_count,
{r('frame_count/100e0', 6)} as observation_ratio, {r('ref_sum/hit_count', 6)} as ref_mean,
{r('sqrt(greatest(ref_sumsq/hit_count - (ref_sum/hit_count)*(ref_sum/hit_count), 0))', 4)} as ref_std, {r('z_min', 4)} as z_min, {r('z_max', 4)} as z_max,
{r('z_max - z_min', 4)} as z_range, {r('z_sum/hit_count', 6)} as z_mean,
{r('sqrt(greatest(z_sumsq/hit_count - (z_sum/hit_count)*(z_sum/hit_count), 0))', 2)} as z_std, {r('elev_sum/hit_count', 6)} as elev_mean from vsums""",
    ),
)
def _(inp: Inputs):
    table = voxels.voxel_table(_sums(inp), SIZE)
    table = rounded(table, ["observation_ratio", "ref_mean", "z_mean", "elev_mean"])
    # The deviation from sums of squares keeps about half the digits of the squares.
    return rounded(rounded(table, ["ref_std", "z_min", "z_max", "z_range"], 4), ["z_std"], 2)


_VLABEL = """case when votes_0 + votes_1 + votes_2 + votes_3 = 0 then -1 when votes_0 = greatest(votes_0, votes_1, votes_2, votes_3) then 0
  when votes_1 = greatest(votes_1, votes_2, votes_3) then 1 when votes_2 >= votes_3 then 2 else 3 end"""
_FRACS = [f"vote_frac_{i}" for i in range(4)] + ["bg_frac", "class_confidence"]


@query(
    "voxel_labels",
    with_ctes(
        "vsums",
        f"""select scene, vx, vy, vz, {_VLABEL} as class_id, {r('case when votes_0 + votes_1 + votes_2 + votes_3 = 0 then 1e0 else greatest(votes_0, votes_1, votes_2, votes_3)/cast(votes_0 + votes_1 + votes_2 + votes_3 as double) end', 6)} as class_confidence,
votes_0 + votes_1 + votes_2 + votes_3 > 0 as is_obstacle, {', '.join(f"{r(f'votes_{i}/cast(hit_count as double)', 6)} as vote_frac_{i}" for i in range(4))},
{r('votes_bg/cast(hit_count as double)', 6)} as bg_frac from vsums""",
    ),
)
def _(inp: Inputs):
    return rounded(voxels.voxel_labels(_sums(inp)), _FRACS)


_EXPORT = f"""select scene, vx, vy, vz, (vx + 0.5e0)*0.5e0 as x, (vy + 0.5e0)*0.5e0 as y, (vz + 0.5e0)*0.5e0 as z,
case {_VLABEL} when 0 then 'Antenna' when 1 then 'Cable' when 2 then 'Electric Pole' when 3 then 'Wind Turbine' else 'Background' end as label from vsums"""


def _labelled(inp: Inputs):
    sums = _sums(inp)
    labels = voxels.voxel_labels(sums).select(*voxels.VOXEL, "class_id", "is_obstacle")
    return voxels.voxel_table(sums, SIZE).join(labels, voxels.VOXEL)


@query("scene_export_points", with_ctes("vsums", _EXPORT))
def _(inp: Inputs):
    return voxels.scene_export_points(_labelled(inp))


@query(
    "scene_export_sample",
    with_ctes("vsums", f"{_EXPORT} where votes_0 + votes_1 + votes_2 + votes_3 > 0 order by {draw_sql('export', 'scene', 'vx', 'vy', 'vz')}, scene, vx, vy, vz limit 2000"),
)
def _(inp: Inputs):
    return voxels.scene_export_points(_labelled(inp), obstacles_only=True, max_points=2000)


@query("voxel_stream", with_ctes("vsums", f"select * replace ({', '.join(f'{r(c, 4)} as {c}' for c in SUMS)}) from vsums"))
def _(inp: Inputs):
    work = inp.work_folder
    points = inp.points_unnumbered
    points.write.mode("overwrite").parquet(f"{work}/points")
    stream = inp.spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 2).parquet(f"{work}/points")
    start_voxel_parts(stream, f"{work}/parts", f"{work}/state", SIZE).awaitTermination()
    return rounded(voxels_from_parts(inp.spark.read.parquet(f"{work}/parts").drop("batch")), SUMS, 4)


# --- pillars and targets -----------------------------------------------------------------------------------------

cte(
    "pil",
    ["points"],
    """select *, cast(floor((x + 20)/0.8e0) as int) as gx, cast(floor((y + 224)/0.8e0) as int) as gy from points
  where x >= -20 and x < 312.8e0 and y >= -224 and y < 224 and z >= -100 and z < 120""",
)
_PKEY = "scene, pose_index, gx, gy"


@query("pillar_index", with_ctes("pil", f"select {_PKEY}, point_id from (select * replace (least(greatest(gx, 0), 415) as gx, least(greatest(gy, 0), 559) as gy) from pil) p"))
def _(inp: Inputs):
    return bev.pillar_index(inp.points).select(*bev.PILLAR, "point_id")


@query("pillar_occupancy", with_ctes("pil", f"select {_PKEY}, count(*) as n_points from pil group by {_PKEY}"))
def _(inp: Inputs):
    return bev.pillar_occupancy(inp.points_unnumbered)


# The limits of the grid do not bind on the thin stand-in data; wide cells and small limits do.
COARSE = schema.BEV | {"pillar": 8.0, "grid_x": 42, "grid_y": 56, "max_points": 2, "max_pillars": 150}
cte(
    "coarse",
    ["points"],
    """select *, cast(floor((x + 20)/8e0) as int) as gx, cast(floor((y + 224)/8e0) as int) as gy from points
  where x >= -20 and x < 312.8e0 and y >= -224 and y < 224 and z >= -100 and z < 120""",
)
for _name, _source, _grid in (("pil_capped", "pil", schema.BEV), ("capped", "coarse", COARSE)):
    _flat = f"gx*{_grid['grid_y']} + gy"
    cte(
        _name,
        [_source],
        f"""select c.* exclude (slot), cast(slot as int) as slot, p.n as pillar_points from (select *, row_number() over (partition by {_PKEY} order by point_id) - 1 as slot from {_source}) c
join (select {_PKEY}, count(*) as n from {_source} group by {_PKEY} qualify row_number() over (partition by scene, pose_index
  order by {draw_sql('pillar', _flat)}, {_flat}) <= {_grid['max_pillars']}) p using ({_PKEY}) where slot < {_grid['max_points']}""",
    )


def _features_sql(source: str, grid: dict) -> str:
    side = f"{grid['pillar']}e0"
    return with_ctes(
        source,
        f"""select {_PKEY}, point_id, slot, x, y, z, {r('reflectivity/255e0', 6)} as r, {', '.join(f"{r(f'{a} - sum(cast(round({a}*1000000) as bigint)) over w / count(*) over w / 1000000', 5)} as {a}_c" for a in 'xyz')},
{r(f'x - (-20 + (gx + 0.5e0)*{side})', 5)} as x_p, {r(f'y - (-224 + (gy + 0.5e0)*{side})', 5)} as y_p from {source} window w as (partition by {_PKEY})""",
    )


def _features(inp: Inputs, grid: dict):
    features = rounded(bev.pillar_features(inp.points, grid), ["r"])
    return rounded(features, ["x_c", "y_c", "z_c", "x_p", "y_p"], 5)


@query("pillar_cap", with_ctes("pil_capped", f"select {_PKEY}, point_id, slot, pillar_points from pil_capped"))
def _(inp: Inputs):
    return bev.pillar_cap(inp.points).select(*bev.PILLAR, "point_id", "slot", "pillar_points")


@query("pillar_cap_small", with_ctes("capped", f"select {_PKEY}, point_id, slot, pillar_points from capped"))
def _(inp: Inputs):
    return bev.pillar_cap(inp.points, COARSE).select(*bev.PILLAR, "point_id", "slot", "pillar_points")


@query("pillar_features", _features_sql("pil_capped", schema.BEV))
def _(inp: Inputs):
    return _features(inp, schema.BEV)


@query("pillar_features_small", _features_sql("capped", COARSE))
def _(inp: Inputs):
    return _features(inp, COARSE)


_RADIUS = """least((bl + bw + sqrt((bl+bw)*(bl+bw) - 4*bw*bl*(1 - 0.7e0)/(1 + 0.7e0)))/2, (2*(bl+bw) + sqrt(4*(bl+bw)*(bl+bw) - 16*(1 - 0.7e0)*bw*bl))/2,
  (-2*0.7e0*(bl+bw) + sqrt(4*0.7e0*0.7e0*(bl+bw)*(bl+bw) - 16*0.7e0*(0.7e0 - 1)*bw*bl))/2)"""


@query("gaussian_radius", with_ctes("boxes", f"select box_id, {r(_RADIUS, 5)} as radius from (select box_id, bbox_width/1.6e0 as bw, bbox_length/1.6e0 as bl from boxes) b"))
def _(inp: Inputs):
    radius = bev.gaussian_radius(F.col("bbox_width") / 1.6, F.col("bbox_length") / 1.6)
    return inp.boxes.select("box_id", rnd(radius, 5).alias("radius"))


cte(
    "bcell",
    ["boxes"],
    f"""select *, greatest(cast(trunc({_RADIUS}) as int), case class_id when 1 then 3 when 3 then 3 else 2 end) as radius from (select *, bbox_width/1.6e0 as bw, bbox_length/1.6e0 as bl,
  (bbox_center_x + 20)/1.6e0 as px, (bbox_center_y + 224)/1.6e0 as py, cast(floor((bbox_center_x + 20)/1.6e0) as int) as hx, cast(floor((bbox_center_y + 224)/1.6e0) as int) as hy
  from boxes where class_id >= 0) b where hx between 0 and 207 and hy between 0 and 279""",
)
_T = ["offset_x", "offset_y", "z", "log_width", "log_length", "log_height", "sin_yaw", "cos_yaw"]
cte(
    "targets",
    ["bcell"],
    """select *, px - hx as offset_x, py - hy as offset_y, bbox_center_z as z, ln(greatest(bbox_width, 0.1e0)) as log_width, ln(greatest(bbox_length, 0.1e0)) as log_length,
  ln(greatest(bbox_height, 0.1e0)) as log_height, sin(bbox_yaw) as sin_yaw, cos(bbox_yaw) as cos_yaw from (select *, cast(case when row_number() over (partition by scene, pose_index order by box_id) <= 64
  then row_number() over (partition by scene, pose_index order by box_id) - 1 else -1 end as int) as object_index from bcell) b qualify row_number() over (partition by scene, pose_index, hx, hy order by box_id desc) = 1""",
)


@query("box_targets", with_ctes("targets", f"select scene, pose_index, hx, hy, box_id, {', '.join(f'{r(c, 5)} as {c}' for c in _T)}, object_index, 1e0 as mask from targets"))
def _(inp: Inputs):
    return rounded(bev.box_targets(inp.boxes), _T, 5)


cte(
    "heat",
    ["bcell"],
    """select scene, pose_index, class_id, hx + i as hx, hy + j as hy, max(exp(-(cast(i as double)*i + j*j)/(2*((2*radius + 1)/6e0)*((2*radius + 1)/6e0)))) as heat
  from bcell, lateral (select unnest(range(-radius, radius + 1)) as i) a, lateral (select unnest(range(-radius, radius + 1)) as j) b
  where hx + i between 0 and 207 and hy + j between 0 and 279 group by all""",
)
_HKEY = "scene, pose_index, class_id, cast(hx as int) as hx, cast(hy as int) as hy"


@query("heatmap_splat", with_ctes("heat", f"select {_HKEY}, {r('heat', 8)} as heat from heat where heat >= 2.220446049250313e-16"))
def _(inp: Inputs):
    return rounded(bev.heatmap_splat(inp.boxes), ["heat"], 8)


@query(
    "heatmap_check",
    with_ctes(
        "heat",
        f"""select scene, pose_index, class_id, {r('peak', 8)} as peak, hot_cells, boxes, {r('lowest', 8)} as lowest_centre from
(select scene, pose_index, class_id, max(heat) as peak, count(*) filter (heat > 0.5) as hot_cells from heat group by all) p join
(select b.scene, b.pose_index, b.class_id, count(*) as boxes, min(coalesce(h.heat, 0)) as lowest from bcell b left join heat h using (scene, pose_index, class_id, hx, hy) group by all) c
using (scene, pose_index, class_id)""",
    ),
)
def _(inp: Inputs):
    return rounded(bev.heatmap_check(inp.boxes, bev.heatmap_splat(inp.boxes)), ["peak", "lowest_centre"], 8)


# Confidence at the box cells stands in for a predicted score map.
cte("score", ["bcell"], "select scene, pose_index, class_id, hx, hy, max(confidence) as heat from bcell group by all")
cte(
    "peaks",
    ["score"],
    """select s.* from score s where not exists (select 1 from score n where n.scene = s.scene and n.pose_index = s.pose_index and n.class_id = s.class_id
  and abs(n.hx - s.hx) <= 1 and abs(n.hy - s.hy) <= 1 and n.heat > s.heat)""",
)


def _score(inp: Inputs):
    return bev.box_cells(inp.boxes).groupBy(*bev.CELL).agg(F.max("confidence").alias("heat"))


@query("heatmap_nms", with_ctes("peaks", "select * from peaks"))
def _(inp: Inputs):
    return bev.heatmap_nms(_score(inp))


LIMITED = schema.BEV | {"max_detections": 3}
_D = [f"bbox_center_{a}" for a in "xyz"] + ["bbox_width", "bbox_length", "bbox_height", "bbox_yaw"]


def _decoded(most: int) -> str:
    return f"""decoded as (select p.scene, p.pose_index, p.class_id, p.hx, p.hy, p.heat as confidence, (p.hx + offset_x)*1.6e0 - 20 as bbox_center_x, (p.hy + offset_y)*1.6e0 - 224 as bbox_center_y,
  z as bbox_center_z, least(exp(log_width), 500) as bbox_width, least(exp(log_length), 500) as bbox_length, least(exp(log_height), 500) as bbox_height, atan2(sin_yaw, cos_yaw) as bbox_yaw
  from (select * from peaks where heat > 0.3 qualify row_number() over (partition by scene, pose_index order by heat desc, class_id, hy, hx) <= {most}) p
  join targets t using (scene, pose_index, hx, hy))"""


def _decode_sql(most: int) -> str:
    return with_ctes("peaks targets", f"select scene, pose_index, class_id, hx, hy, confidence, {', '.join(f'{r(c, 4)} as {c}' for c in _D)} from decoded", extra=_decoded(most))


def _decode(inp: Inputs, grid: dict):
    return bev.decode_boxes(_score(inp), bev.box_targets(inp.boxes).select(*schema.FRAME, "hx", "hy", *_T), grid)


@query("decode_boxes", _decode_sql(schema.BEV["max_detections"]))
def _(inp: Inputs):
    return rounded(_decode(inp, schema.BEV), _D, 4)


@query("decode_boxes_small", _decode_sql(3))
def _(inp: Inputs):
    return rounded(_decode(inp, LIMITED), _D, 4)


@query(
    "predictions_table",
    with_ctes(
        "peaks targets",
        f"""select d.scene, d.pose_index, {', '.join(f'b.{c}' for c in schema.POSE)}, {', '.join(f'{r(f"d.{c}", 4)} as {c}' for c in _D)}, d.class_id as "class_ID",
case d.class_id when 0 then 'Antenna' when 1 then 'Cable' when 2 then 'Electric Pole' else 'Wind Turbine' end as class_label, d.confidence
from decoded d join (select distinct scene, pose_index, {', '.join(schema.POSE)} from boxes) b using (scene, pose_index)""",
        extra=_decoded(schema.BEV["max_detections"]),
    ),
)
def _(inp: Inputs):
    poses = inp.boxes.select(*schema.FRAME, *schema.POSE).distinct()
    return rounded(bev.predictions_table(_decode(inp, schema.BEV), poses), _D, 4)


# --- augmentation and sampling -----------------------------------------------------------------------------------

_FRAME = ("scene", "pose_index")
cte(
    "draws",
    ["frames"],
    f"""select scene, pose_index, {uniform_sql('flip0', *_FRAME)} < 0.5 as flip, {uniform_sql('angle0', *_FRAME)}*360 - 180 as angle_deg,
  0.95e0 + {uniform_sql('scale0', *_FRAME)}*(1.05e0 - 0.95e0) as scale, ([1e0, 1e0, 1e0, 0.75e0, 0.5e0, 0.25e0])[cast(floor({uniform_sql('ratio0', *_FRAME)}*6) as int) + 1] as keep_ratio from frames""",
)
_P = "scene, pose_index, point_id"


@query("aug_flip", with_ctes("points draws", f"select {_P}, x, case when flip then -y else y end + cast(0 as double) as y, z from points join draws using (scene, pose_index)"))
def _(inp: Inputs):
    flipped = augment.aug_flip(inp.points, augment.frame_draws(inp.frames))
    return flipped.select(*schema.FRAME, "point_id", "x", (F.col("y") + F.lit(0.0)).alias("y"), "z")


@query(
    "aug_rotate",
    with_ctes("points draws", f"select {_P}, {r('x*cos(radians(angle_deg)) - y*sin(radians(angle_deg))', 5)} as x, {r('x*sin(radians(angle_deg)) + y*cos(radians(angle_deg))', 5)} as y, z from points join draws using (scene, pose_index)"),
)
def _(inp: Inputs):
    turned = augment.aug_rotate(inp.points, augment.frame_draws(inp.frames))
    return rounded(turned, ["x", "y"], 5).select(*schema.FRAME, "point_id", "x", "y", "z")


@query("aug_scale", with_ctes("points draws", f"select {_P}, {', '.join(f'{r(f"{a}*scale", 5)} as {a}' for a in 'xyz')} from points join draws using (scene, pose_index)"))
def _(inp: Inputs):
    scaled = augment.aug_scale(inp.points, augment.frame_draws(inp.frames))
    return rounded(scaled, ["x", "y", "z"], 5).select(*schema.FRAME, "point_id", "x", "y", "z")


def _noise(axis: str) -> str:
    first, second = (uniform_sql(f"noise{part}{axis}0", *_FRAME, "point_id") for part in (1, 2))
    return f"least(greatest(sqrt(-2*ln(greatest({first}, 1e-12)))*cos(2*pi()*{second})*0.01e0, -0.05e0), 0.05e0)"


@query("aug_jitter", with_ctes("points", f"select {_P}, {', '.join(f'{r(f"{a} + {_noise(a)}", 6)} as {a}' for a in 'xyz')} from points"))
def _(inp: Inputs):
    return rounded(augment.aug_jitter(inp.points), ["x", "y", "z"]).select(*schema.FRAME, "point_id", "x", "y", "z")


_BY_DRAW = f"row_number() over (partition by scene, pose_index order by {draw_sql('keep0', *_FRAME, 'point_id')}, point_id)"
_RANKED = f"ranked as (select scene, pose_index, point_id, x, y, z, count(*) over (partition by scene, pose_index) as n, {_BY_DRAW} as rk from points)"


@query(
    "density_sample",
    with_ctes("points", "select scene, pose_index, point_id, density from ranked, (values (1e0), (0.75e0), (0.5e0), (0.25e0)) d(density) where rk <= greatest(cast(trunc(n*density) as bigint), 1)", extra=_RANKED),
)
def _(inp: Inputs):
    return augment.density_levels(inp.points)


@query("density_sample_half", with_ctes("points", "select scene, pose_index, point_id from ranked where rk <= greatest(cast(trunc(n*0.5e0) as bigint), 1)", extra=_RANKED))
def _(inp: Inputs):
    return augment.density_sample(inp.points, 0.5).select(*schema.FRAME, "point_id")


@query("cap_points", with_ctes("points", "select scene, pose_index, point_id, x, y, z from ranked where rk <= 200", extra=_RANKED))
def _(inp: Inputs):
    return augment.cap_points(inp.points, 200).select(*schema.FRAME, "point_id", "x", "y", "z")


_TURNED = """turned as (select t.* exclude (y), x*cos(radians(angle_deg)) - fy*sin(radians(angle_deg)) as tx, x*sin(radians(angle_deg)) + fy*cos(radians(angle_deg)) as ty
  from (select p.*, d.* exclude (scene, pose_index), case when flip then -y else y end as fy from points p join draws d using (scene, pose_index) where scene not in ('scene_9', 'scene_10')) t),
thinned as (select * from (select *, count(*) over (partition by scene, pose_index) as n, {} as rk from turned) t where rk <= greatest(cast(trunc(n*keep_ratio) as bigint), 1))""".format(_BY_DRAW)


@query(
    "augment_dataset",
    with_ctes(
        "points draws",
        f"""select {_P}, {', '.join(f"{r(f'{e}*scale + {_noise(a)}', 5)} as {a}" for a, e in (('x', 'tx'), ('y', 'ty'), ('z', 'z')))}, class_id from thinned
union all select {_P}, {', '.join(f"{r(a, 5)} as {a}" for a in 'xyz')}, class_id from points where scene in ('scene_9', 'scene_10')""",
        extra=_TURNED,
        materialized=True,
    ),
)
def _(inp: Inputs):
    done = augment.augment_points(inp.points, inp.frames)
    return rounded(done, ["x", "y", "z"], 5).select(*schema.FRAME, "point_id", "x", "y", "z", "class_id")


_B = ["bbox_center_x", "bbox_center_y", "bbox_center_z", "bbox_width", "bbox_length", "bbox_height", "bbox_yaw"]
_BOX_MOVED = {
    "bbox_center_x": "(bbox_center_x*cos(radians(angle_deg)) - sgn*bbox_center_y*sin(radians(angle_deg)))*scale",
    "bbox_center_y": "(bbox_center_x*sin(radians(angle_deg)) + sgn*bbox_center_y*cos(radians(angle_deg)))*scale",
    "bbox_yaw": "bbox_yaw*sgn + radians(angle_deg)",
} | {c: f"{c}*scale" for c in ("bbox_center_z", "bbox_width", "bbox_length", "bbox_height")}


@query(
    "augment_boxes",
    with_ctes(
        "boxes draws",
        f"""select b.* replace ({', '.join(f"{r(_BOX_MOVED[c], 5)} as {c}" for c in _B)}) from boxes b
join (select *, case when flip then -1 else 1 end as sgn from draws) d using (scene, pose_index) where scene not in ('scene_9', 'scene_10')
union all select * replace ({', '.join(f"{r(c, 5)} as {c}" for c in _B)}) from boxes where scene in ('scene_9', 'scene_10')""",
    ),
)
def _(inp: Inputs):
    return rounded(augment.augment_boxes(inp.boxes, inp.frames), _B, 5)
