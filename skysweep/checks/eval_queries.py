"""Overlap, matching and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysweep import schema
from skysweep.checks import cluster_queries
from skysweep.checks.cluster_queries import FEATURES
from skysweep.checks.ground_queries import rounded
from skysweep.checks.registry import Inputs, query
from skysweep.checks.sqltext import r, uniform_sql, with_ctes
from skysweep.functions.columns import uniform
from skysweep.operators import boxfit, evaluate
from skysweep.session import cut_lineage

_SPAN = "greatest(least(a.{c} + a.{h}, b.{c} + b.{h}) - greatest(a.{c} - a.{h}, b.{c} - b.{h}), 0)"
_PAIR = "from bx a join gx b on a.scene = b.scene and a.pose_index = b.pose_index"


def _sides(major: bool) -> str:
    x, y = ("greatest(bbox_width, bbox_length)/2", "least(bbox_width, bbox_length)/2") if major else ("bbox_width/2", "bbox_length/2")
    columns = f"*, bbox_center_x as cx, bbox_center_y as cy, bbox_center_z as cz, {x} as hx, {y} as hy, bbox_height/2 as hz"
    return f"bx as (select {columns} from boxes), gx as (select {columns} from gt)"


_INTER = " * ".join(_SPAN.format(c=f"c{i}", h=f"h{i}") for i in "xyz")
_VOL = "(8*{0}.hx*{0}.hy*{0}.hz)"
AABB = f"({_INTER})/({_VOL.format('a')} + {_VOL.format('b')} - ({_INTER}) + 1e-10)"
MAJOR = f"({_INTER})/({_VOL.format('a')} + {_VOL.format('b')} - ({_INTER}))"
_OUT = "select a.scene, a.pose_index, a.box_id as box_id_a, b.box_id as box_id_b"


@query("iou_aabb", with_ctes("gt", f"{_OUT}, {r(AABB, 8)} as iou {_PAIR} where {AABB} > 0", extra=_sides(False)))
def _(inp: Inputs):
    return rounded(evaluate.iou_pairs(inp.boxes, inp.ground_truth, "aabb"), ["iou"], 8)


@query("iou_major", with_ctes("gt", f"{_OUT}, {r(MAJOR, 8)} as iou {_PAIR} where {MAJOR} > 0", extra=_sides(True)))
def _(inp: Inputs):
    return rounded(evaluate.iou_pairs(inp.boxes, inp.ground_truth, "major"), ["iou"], 8)


_CYL = """cyl as (select a.scene, a.pose_index, a.box_id as box_id_a, b.box_id as box_id_b, greatest(a.bbox_width, a.bbox_length)/2 as r1, greatest(b.bbox_width, b.bbox_length)/2 as r2,
  sqrt(power(a.bbox_center_x - b.bbox_center_x, 2) + power(a.bbox_center_y - b.bbox_center_y, 2)) as d, a.bbox_height as h1, b.bbox_height as h2,
  greatest(least(a.bbox_center_z + a.bbox_height/2, b.bbox_center_z + b.bbox_height/2) - greatest(a.bbox_center_z - a.bbox_height/2, b.bbox_center_z - b.bbox_height/2), 0) as dz
  from boxes a join gt b on a.scene = b.scene and a.pose_index = b.pose_index),
lens as (select *, case when d >= r1 + r2 then 0 when d <= abs(r1 - r2) then pi()*least(r1, r2)*least(r1, r2) else
  r1*r1*acos(least(greatest((d*d + r1*r1 - r2*r2)/(2*d*r1), -1), 1)) + r2*r2*acos(least(greatest((d*d + r2*r2 - r1*r1)/(2*d*r2), -1), 1))
  - 0.5*sqrt(greatest((-d+r1+r2)*(d+r1-r2)*(d-r1+r2)*(d+r1+r2), 0)) end * dz as shared from cyl),
cio as (select scene, pose_index, box_id_a, box_id_b, shared/(pi()*r1*r1*h1 + pi()*r2*r2*h2 - shared) as iou from lens)"""


@query("iou_cylinder", with_ctes("gt", f"select scene, pose_index, box_id_a, box_id_b, {r('iou', 8)} as iou from cio where iou > 1e-9", extra=_CYL))
def _(inp: Inputs):
    pairs = evaluate.iou_pairs(inp.boxes, inp.ground_truth, "cylinder").filter("iou > 1e-9")
    return rounded(pairs, ["iou"], 8)


@query("match_boxes")
def _(inp: Inputs):
    return rounded(evaluate.match_boxes(inp.boxes, inp.ground_truth), ["mean_iou"])


@query("pr_metrics")
def _(inp: Inputs):
    return rounded(evaluate.pr_metrics(inp.boxes, inp.ground_truth), ["precision", "recall", "f1"])


@query("cluster_eval")
def _(inp: Inputs):
    detections = inp.boxes.withColumn("gt_class", F.col("class_label"))
    return rounded(evaluate.cluster_eval(detections, inp.ground_truth), ["precision", "recall", "f1", "mean_iou"])


@query("param_sweep")
def _(inp: Inputs):
    points = cluster_queries.all_points(inp)
    truth = boxfit.obb_yaw_pca(points.filter("class_id >= 0"), cluster_queries.GROUP)
    truth = cut_lineage(truth.withColumn("box_id", F.monotonically_increasing_id()))
    swept = evaluate.param_sweep(points, truth, [20, 30, 50, 75, 100], [5, 10, 15, 20], [8.0, 10.0, 12.0, 14.0])
    return rounded(swept, ["precision", "recall", "f1", "mean_iou", "f1_antenna", "f1_cable", "f1_pole", "f1_turbine"])


@query(
    "cluster_profile",
    with_ctes(
        "cpoints",
        f"""select class_label, count(*) as n, {r('avg(n_points)', 6)} as mean_points, min(n_points) as min_points, max(n_points) as max_points, {r('avg(hei)', 4)} as mean_height,
{r('avg(elongation)', 4)} as mean_elongation, {r('min(elongation)', 4)} as min_elongation, {r('max(elongation)', 4)} as max_elongation, {r('quantile_cont(n_points, 0.5)', 6)} as median_points, {r('quantile_cont(elongation, 0.25)', 4)} as elongation_q1,
{r('quantile_cont(elongation, 0.5)', 4)} as elongation_median, {r('quantile_cont(elongation, 0.75)', 4)} as elongation_q3
from (select case class_id when 0 then 'Antenna' when 1 then 'Cable' when 2 then 'Electric Pole' else 'Wind Turbine' end as class_label, n_points, hei, elongation from feat
union all select 'all', n_points, hei, elongation from feat) f group by class_label""",
        extra=FEATURES,
    ),
)
def _(inp: Inputs):
    points = cluster_queries.unnumbered_obstacles(inp)
    features = cut_lineage(boxfit.cluster_features(points, boxfit.obb_min_area(points, cluster_queries.GROUP), cluster_queries.GROUP))
    profile = rounded(evaluate.cluster_profile(features), ["mean_points", "median_points"])
    return rounded(profile, ["mean_height", "mean_elongation", "min_elongation", "max_elongation", "elongation_q1", "elongation_median", "elongation_q3"], 4)


def ap_sql(detections: str, truth: str, extra: str = "") -> str:
    """Table expression ``ap`` with the average precision per class and the extra key."""
    e = f"{extra}, " if extra else ""
    on = "a.scene = b.scene and a.pose_index = b.pose_index and a.class_label = b.class_label" + (f" and a.{extra} = b.{extra}" if extra else "")
    a = f"a.{extra}, " if extra else ""
    half = "*, bbox_center_x as cx, bbox_center_y as cy, bbox_center_z as cz, bbox_width/2 as hx, bbox_length/2 as hy, bbox_height/2 as hz"
    return f"""da as (select {half} from {detections} where class_label <> 'Unknown'), ga as (select {half} from {truth} where class_label <> 'Unknown'),
hitpairs as (select {a}a.class_label, a.box_id, a.confidence, b.box_id as gt_id, {AABB} as iou from da a join ga b on {on} where {AABB} >= 0.5e0),
bestgt as (select * from hitpairs qualify row_number() over (partition by {e}box_id order by iou desc, gt_id) = 1),
tps as (select * from bestgt qualify row_number() over (partition by {e}gt_id order by confidence desc, box_id) = 1),
steps as (select {e}class_label, confidence, count(*) as n, count(hit) as tp from (select {', '.join(f'd.{c}' for c in [*([extra] if extra else []), 'class_label', 'confidence'])}, t.box_id as hit
  from da d left join tps t on t.box_id = d.box_id{f' and t.{extra} = d.{extra}' if extra else ''}) m group by all),
curve as (select *, sum(tp) over w / sum(n) over w as precision from steps window w as (partition by {e}class_label order by confidence desc)),
env as (select *, max(precision) over (partition by {e}class_label order by confidence rows between unbounded preceding and current row) as envelope from curve),
areas as (select {e}class_label, sum(tp*envelope) as area from env group by all),
ap as (select {e}class_label, n_gt, coalesce(area, 0)/n_gt as ap from (select {e}class_label, count(*) as n_gt from ga group by all) g left join areas using ({e}class_label))"""


@query(
    "map_at_iou",
    with_ctes("gt", f"select class_label, n_gt, {r('ap', 6)} as ap from ap union all select 'mAP', cast(sum(n_gt) as bigint), {r('avg(ap)', 6)} from ap", extra=ap_sql("boxes", "gt")),
)
def _(inp: Inputs):
    return rounded(evaluate.map_at_iou(inp.boxes, inp.ground_truth), ["ap"])


@query("mean_iou_correct", with_ctes("gt", f"select count(*) as matches, {r('avg(iou)', 6)} as mean_iou from tps", extra=ap_sql("boxes", "gt")))
def _(inp: Inputs):
    known = F.col("class_label").isin(schema.CLASS_NAMES)
    return rounded(evaluate.mean_iou_correct(inp.boxes.filter(known), inp.ground_truth.filter(known)), ["mean_iou"])


# Thinned predictions stand in for the detections made at a lower input density.
_THIN = f"""thin as (select b.*, density from boxes b, (values (1e0), (0.75e0), (0.5e0), (0.25e0)) d(density) where {uniform_sql('density', 'box_id')} < density),
thin_gt as (select g.*, density from gt g, (values (1e0), (0.75e0), (0.5e0), (0.25e0)) d(density))"""


@query(
    "density_robustness",
    with_ctes(
        "gt",
        f"select density, {r('ap', 6)} as ap, {r('(first(ap) over w - ap)/first(ap) over w', 6)} as drop from (select density, avg(ap) as ap from ap group by density) m window w as (order by density desc)",
        extra=_THIN + ",\n" + ap_sql("thin", "thin_gt", "density"),
    ),
)
def _(inp: Inputs):
    share = uniform("density", "box_id")
    levels = F.filter(F.array(*[F.lit(v) for v in (1.0, 0.75, 0.5, 0.25)]), lambda v: share < v)
    thinned = inp.boxes.withColumn("density", F.explode(levels))
    return rounded(evaluate.density_robustness(thinned, inp.ground_truth), ["ap", "drop"])


@query(
    "scene_stability",
    with_ctes(
        "gt",
        f"select scene_key as scene, {r('ap', 6)} as ap, {r('avg(ap) over ()', 6)} as mean_ap, {r('stddev_pop(ap) over ()', 6)} as spread from (select scene_key, avg(ap) as ap from ap group by scene_key) m",
        extra="sb as (select *, scene as scene_key from boxes), sg as (select *, scene as scene_key from gt),\n" + ap_sql("sb", "sg", "scene_key"),
    ),
)
def _(inp: Inputs):
    return rounded(evaluate.scene_stability(inp.boxes, inp.ground_truth), ["ap", "mean_ap", "spread"])
