"""Post-processing of predictions."""

from __future__ import annotations

from skysweep.checks.clean_queries import _BOX
from skysweep.checks.ground_queries import rounded
from skysweep.checks.registry import Inputs, query
from skysweep.checks.sqltext import cte, r, with_ctes
from skysweep.operators import post

cte(
    "confident",
    ["boxes"],
    """select * from boxes where confidence >= case class_label when 'Antenna' then 0.4e0 when 'Cable' then 0.28e0
  when 'Electric Pole' then 0.35e0 when 'Wind Turbine' then 0.25e0 end""",
)
_DIMS = """case class_label
  when 'Antenna' then bbox_width between 2 and 25 and bbox_length between 2 and 25 and bbox_height between 10 and 80
  when 'Cable' then bbox_width between 5 and 100 and bbox_length between 0.3e0 and 15 and bbox_height between 0.3e0 and 15
  when 'Electric Pole' then bbox_width between 2 and 40 and bbox_length between 2 and 25 and bbox_height between 15 and 80
  when 'Wind Turbine' then bbox_width between 15 and 150 and bbox_length between 3 and 50 and bbox_height between 20 and 200
  else true end"""


def suppressed_sql(source: str) -> str:
    """Greedy suppression by a walk down the ranks of every group that carries the kept boxes."""
    box = "{x: bbox_center_x, y: bbox_center_y, z: bbox_center_z, w: bbox_width, l: bbox_length, h: bbox_height}"
    span = "greatest(least(k.{a} + k.{s}/2, b.{a} + b.{s}/2) - greatest(k.{a} - k.{s}/2, b.{a} - b.{s}/2), 0)"
    inter = " * ".join(span.format(a=a, s=s) for a, s in (("x", "w"), ("y", "l"), ("z", "h")))
    iou = f"({inter}) / (k.w*k.l*k.h + b.w*b.l*b.h - ({inter}) + 1e-10)"
    iou = iou.replace("k.", "kk.").replace("b.", "ranked.box.")
    return f"""ranked as (select box_id, scene, pose_index, class_label, {box} as box,
  row_number() over (partition by scene, pose_index, class_label order by confidence desc, box_id) as rk from {source}),
walk as (select scene, pose_index, class_label, rk, [box] as kept, true as keep, box_id from ranked where rk = 1
  union all
  select ranked.scene, ranked.pose_index, ranked.class_label, ranked.rk,
    case when len(list_filter(walk.kept, lambda kk: {iou} > 0.3e0)) = 0 then list_append(walk.kept, ranked.box) else walk.kept end,
    len(list_filter(walk.kept, lambda kk: {iou} > 0.3e0)) = 0, ranked.box_id
  from walk join ranked on ranked.scene = walk.scene and ranked.pose_index = walk.pose_index
    and ranked.class_label = walk.class_label and ranked.rk = walk.rk + 1)"""


@query("conf_filter", with_ctes("confident", f"select {_BOX} from confident"))
def _(inp: Inputs):
    return post.conf_filter(inp.boxes)


@query("dim_filter", with_ctes("boxes", f"select {_BOX} from boxes where {_DIMS}"))
def _(inp: Inputs):
    return post.dim_filter(inp.boxes)


@query(
    "nms_3d",
    with_ctes("boxes", f"select {_BOX} from boxes where box_id in (select box_id from walk where keep)", recursive=True, extra=suppressed_sql("boxes")),
)
def _(inp: Inputs):
    return post.nms_3d(inp.boxes).select(*_BOX.split(", "))


_TOP = """row_number() over (partition by scene, pose_index, class_label order by confidence desc, box_id) <=
case class_label when 'Antenna' then 10 when 'Cable' then 30 when 'Electric Pole' then 8 when 'Wind Turbine' then 10 end"""


@query("frame_topk", with_ctes("boxes", f"select {_BOX} from boxes qualify {_TOP}"))
def _(inp: Inputs):
    return post.frame_topk(inp.boxes)


_POST = f"""filtered as (select * from confident where {_DIMS}),
{suppressed_sql('filtered')},
posted as (select * from filtered where box_id in (select box_id from walk where keep) qualify {_TOP})"""


@query("postprocess", with_ctes("confident", f"select {_BOX} from posted", recursive=True, extra=_POST))
def _(inp: Inputs):
    return post.postprocess(inp.boxes).select(*_BOX.split(", "))


@query(
    "postprocess_summary",
    with_ctes("confident", f"select class_label, count(*) as n, {r('avg(confidence)', 6)} as mean_confidence from posted group by class_label", recursive=True, extra=_POST),
)
def _(inp: Inputs):
    return rounded(post.class_confidence(post.postprocess(inp.boxes)), ["mean_confidence"])


MERGE_SQL = """linked as (select a.box_id as src, b.box_id as dst from boxes a join boxes b on a.scene = b.scene and a.pose_index = b.pose_index
  and a.class_label = b.class_label and power(a.bbox_center_x - b.bbox_center_x, 2) + power(a.bbox_center_y - b.bbox_center_y, 2)
  + power(a.bbox_center_z - b.bbox_center_z, 2)
  < power(case a.class_label when 'Antenna' then 30e0 when 'Cable' then 0.5e0 when 'Electric Pole' then 15e0 when 'Wind Turbine' then 50e0 else 10e0 end, 2)),
reached as (select box_id as src, box_id as dst from boxes union select reached.src, linked.dst from reached join linked on linked.src = reached.dst),
grouped as (select src as box_id, min(dst) as merged_id from reached group by src),
merged as (select g.merged_id as box_id, arg_min(scene, b.box_id) as scene, arg_min(pose_index, b.box_id) as pose_index, arg_min(ego_x, b.box_id) as ego_x,
  arg_min(ego_y, b.box_id) as ego_y, arg_min(ego_z, b.box_id) as ego_z, arg_min(ego_yaw, b.box_id) as ego_yaw,
  {x} as bbox_center_x, {y} as bbox_center_y, {z} as bbox_center_z, max(bbox_width) as bbox_width, max(bbox_length) as bbox_length,
  max(bbox_height) as bbox_height, arg_max(bbox_yaw, (confidence, -b.box_id)) as bbox_yaw, arg_min(class_id, b.box_id) as class_id,
  arg_min(class_label, b.box_id) as class_label, arg_min(num_points, b.box_id) as num_points, max(confidence) as confidence,
  count(*) as n_merged from boxes b join grouped g on g.box_id = b.box_id group by g.merged_id)""".format(
    x=r("avg(bbox_center_x)", 6), y=r("avg(bbox_center_y)", 6), z=r("avg(bbox_center_z)", 6)
)


@query("merge_boxes", with_ctes("boxes", "select * from merged", recursive=True, extra=MERGE_SQL))
def _(inp: Inputs):
    return rounded(post.merge_boxes(inp.boxes), ["bbox_center_x", "bbox_center_y", "bbox_center_z"])


@query(
    "postprocess_report",
    with_ctes(
        "boxes",
        f"""select class_label, n_before, coalesce(n_after, 0) as n_after, {r('100e0*(1 - coalesce(n_after, 0)/n_before)', 6)} as reduction_pct
from (select class_label, count(*) as n_before from boxes group by class_label) x left join (select class_label, count(*) as n_after from merged group by class_label) y using (class_label)""",
        recursive=True,
        extra=MERGE_SQL,
    ),
)
def _(inp: Inputs):
    return rounded(post.before_after(inp.boxes, post.merge_boxes(inp.boxes)), ["reduction_pct"])


@query(
    "detection_summary",
    with_ctes(
        "boxes",
        f"""select count(*) as total, count(*) filter (class_id = 0) as n_antenna, count(*) filter (class_id = 1) as n_cable,
count(*) filter (class_id = 2) as n_electric_pole, count(*) filter (class_id = 3) as n_wind_turbine, {r('avg(confidence)', 6)} as confidence_mean,
min(confidence) as confidence_min, max(confidence) as confidence_max, {r('count(*) / count(distinct (scene, pose_index))', 6)} as per_frame_mean,
(select max(n) from (select count(*) as n from boxes group by scene, pose_index) f) as per_frame_max from boxes""",
    ),
)
def _(inp: Inputs):
    return rounded(post.detection_summary(inp.boxes), ["confidence_mean", "per_frame_mean"])


@query(
    "confidence_describe",
    with_ctes(
        "boxes",
        f"""select class_label, count(confidence) as count, {r('avg(confidence)', 6)} as mean, {r('stddev_samp(confidence)', 6)} as std,
min(confidence) as min, {r('quantile_cont(confidence, 0.25)', 6)} as q1, {r('quantile_cont(confidence, 0.5)', 6)} as median,
{r('quantile_cont(confidence, 0.75)', 6)} as q3, max(confidence) as max from boxes group by class_label""",
    ),
)
def _(inp: Inputs):
    return rounded(post.confidence_describe(inp.boxes), ["mean", "std", "q1", "median", "q3"])
