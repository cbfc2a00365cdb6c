"""Box cleaning and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysweep.checks.ground_queries import rounded
from skysweep.checks.registry import Inputs, query
from skysweep.checks.sqltext import cte, r, with_ctes
from skysweep.operators import clean

cte(
    "limits",
    [],
    """select * from (values ('Antenna', 15, 180, 0.5e0, 30), ('Cable', 10, 150, 0e0, 500), ('Electric Pole', 15, 80, 0.5e0, 30),
  ('Wind Turbine', 15, 170, 1e0, 30), ('Unknown', 10, 200, 0e0, 100)) l(class_label, min_points, dim_limit, min_volume, max_aspect)""",
)
cte(
    "stats",
    ["boxes", "limits"],
    """select *, num_points < min_points as f1, max_dim > dim_limit as f2, min_volume > 0 and volume < min_volume as f3,
  aspect_ratio > max_aspect as f4 from (select *, bbox_width*bbox_length*bbox_height as volume,
  greatest(bbox_width, bbox_length, bbox_height) as max_dim, least(bbox_width, bbox_length, bbox_height) as min_dim,
  greatest(bbox_width, bbox_length, bbox_height) / greatest(least(bbox_width, bbox_length, bbox_height), 0.01e0) as aspect_ratio
  from boxes) b join limits using (class_label)""",
)
cte("kept", ["stats"], "select * from stats where not (f1 or f2 or f3 or f4)")
_BOX = (
    "box_id scene pose_index ego_x ego_y ego_z ego_yaw bbox_center_x bbox_center_y bbox_center_z bbox_width bbox_length "
    "bbox_height bbox_yaw class_id class_label num_points confidence"
).replace(" ", ", ")


@query(
    "box_stats",
    with_ctes("stats", f"select box_id, {r('volume', 6)} as volume, max_dim, min_dim, {r('aspect_ratio', 6)} as aspect_ratio from stats"),
)
def _(inp: Inputs):
    stats = rounded(rounded(clean.box_stats(inp.boxes), ["volume"]), ["aspect_ratio"])
    return stats.select("box_id", "volume", "max_dim", "min_dim", "aspect_ratio")


@query("clean_boxes", with_ctes("kept", f"select {_BOX} from kept"))
def _(inp: Inputs):
    return clean.clean_boxes(inp.boxes)


_LOG = """log as (select box_id, scene, pose_index, class_label, 'num_points' as reason, cast(num_points as double) as value from stats where f1
union all select box_id, scene, pose_index, class_label, 'max_dim', max_dim from stats where f2
union all select box_id, scene, pose_index, class_label, 'min_vol', volume from stats where f3
union all select box_id, scene, pose_index, class_label, 'aspect', aspect_ratio from stats where f4)"""


@query("drop_log", with_ctes("stats", f"select * replace ({r('value', 6)} as value) from log", extra=_LOG))
def _(inp: Inputs):
    return rounded(clean.drop_log(inp.boxes), ["value"])


@query(
    "drop_breakdown",
    with_ctes(
        "stats",
        f"""select l.class_label, reason, count(*) as n_dropped, {r('100e0*count(*)/any_value(n)', 6)} as pct from log l
join (select class_label, count(*) as n from stats group by class_label) c using (class_label) group by l.class_label, reason""",
        extra=_LOG,
    ),
)
def _(inp: Inputs):
    return rounded(clean.drop_breakdown(inp.boxes), ["pct"])


@query(
    "lost_frames",
    with_ctes("kept", "select distinct scene, pose_index from stats except select scene, pose_index from kept"),
)
def _(inp: Inputs):
    return clean.lost_frames(inp.boxes, clean.clean_boxes(inp.boxes))


@query(
    "box_qa_overview",
    with_ctes("boxes", "select count(*) as total_boxes, count(distinct scene) as scenes, count(distinct (scene, pose_index)) as frames_with_objects from boxes"),
)
def _(inp: Inputs):
    return clean.box_qa_overview(inp.boxes)


@query(
    "box_qa_by_class",
    with_ctes(
        "boxes",
        f"""select class_label, count(*) as n, {r('100e0*count(*)/(select count(*) from boxes)', 6)} as pct,
{r('quantile_cont(num_points, 0.5)', 6)} as median_num_points, {r('quantile_cont(bbox_width, 0.5)', 6)} as median_width,
{r('quantile_cont(bbox_length, 0.5)', 6)} as median_length, {r('quantile_cont(bbox_height, 0.5)', 6)} as median_height
from boxes where class_id >= 0 group by class_label""",
    ),
)
def _(inp: Inputs):
    medians = [f"median_{c}" for c in ("num_points", "width", "length", "height")]
    return rounded(clean.box_qa_by_class(inp.boxes), ["pct", *medians])


_PER_FRAME = "per_frame as (select scene, pose_index, count(*) as n from boxes group by scene, pose_index)"


@query(
    "objects_per_frame",
    with_ctes("boxes", f"select count(*) as frames, {r('avg(n)', 6)} as mean, {r('quantile_cont(n, 0.5)', 6)} as median, max(n) as max, min(n) as min from per_frame", extra=_PER_FRAME),
)
def _(inp: Inputs):
    return rounded(clean.objects_per_frame(inp.boxes), ["mean", "median"])


_CLASS_COUNTS = ", ".join(
    f"count(*) filter (class_id = {i}) as {{p}}{n}" for i, n in enumerate(("antenna", "cable", "electric_pole", "wind_turbine"))
)


@query(
    "objects_matrix",
    with_ctes("boxes", f"select scene, pose_index, count(*) as n, {_CLASS_COUNTS.format(p='n_')} from boxes group by scene, pose_index"),
)
def _(inp: Inputs):
    return clean.objects_matrix(inp.boxes)


@query("class_balance", with_ctes("boxes", f"select scene, {_CLASS_COUNTS.format(p='')}, count(*) as total from boxes group by scene"))
def _(inp: Inputs):
    return clean.class_balance(inp.boxes)


@query(
    "box_issues",
    with_ctes(
        "stats",
        """select 'low_points' as issue, class_label, cast(count(*) as double) as value from stats where num_points < 20 group by class_label
union all select 'huge_boxes', 'all', count(*) from stats where max_dim > 150 having count(*) > 0
union all select 'class_imbalance', 'all', max(n) / cast(min(n) as double) from (select count(*) as n from stats group by class_label) c having max(n) > 10 * min(n)
union all select 'crowded_frames', 'all', count(*) from per_frame where n > 30 having count(*) > 0""",
        extra=_PER_FRAME,
    ),
)
def _(inp: Inputs):
    return clean.box_issues(inp.boxes)


@query(
    "readiness",
    with_ctes(
        "boxes",
        """select 'four_classes' as check_name, count(distinct class_label) = 4 as passed from boxes
union all select 'multiple_scenes', count(distinct scene) >= 5 from boxes union all select 'enough_boxes', count(*) > 500 from boxes
union all select 'no_missing_centres', count(*) filter (bbox_center_x is null or bbox_center_y is null or bbox_center_z is null) = 0 from boxes
union all select 'no_missing_dims', count(*) filter (bbox_width is null or bbox_length is null or bbox_height is null) = 0 from boxes
union all select 'positive_dims', count(*) filter (bbox_width <= 0 or bbox_length <= 0 or bbox_height <= 0) = 0 from boxes""",
    ),
)
def _(inp: Inputs):
    return clean.readiness(inp.boxes)


@query(
    "inspect_frame",
    with_ctes(
        "stats",
        """select box_id, scene, pose_index, class_label, not f1 as num_points_ok, not f2 as max_dim_ok, not f3 as min_vol_ok, not f4 as aspect_ok,
case when f1 or f2 or f3 or f4 then 'DROP' else 'KEEP' end as verdict, concat_ws(',', case when f1 then 'num_points' end,
case when f2 then 'max_dim' end, case when f3 then 'min_vol' end, case when f4 then 'aspect' end) as failed
from stats where scene = 'scene_3' and pose_index = 7""",
    ),
)
def _(inp: Inputs):
    return clean.inspect_frame(inp.boxes, "scene_3", 7)


cte(
    "frame_drops",
    ["stats"],
    f"""select scene, pose_index, count(*) as n_original, count(*) filter (not (f1 or f2 or f3 or f4)) as n_kept,
  count(*) filter (f1 or f2 or f3 or f4) as n_dropped, {r('100e0*count(*) filter (f1 or f2 or f3 or f4)/count(*)', 6)} as drop_pct,
  count(*) filter (not (f1 or f2 or f3 or f4)) = 0 as all_lost from stats group by scene, pose_index""",
)


@query(
    "inspect_worst",
    with_ctes("frame_drops", "select * from frame_drops order by all_lost desc, drop_pct desc, scene, pose_index limit 10"),
)
def _(inp: Inputs):
    return rounded(clean.inspect_worst(inp.boxes), ["drop_pct"])


@query(
    "list_drops",
    with_ctes(
        "kept",
        f"""select box_id, scene, pose_index, num_points, max_dim, {r('volume', 6)} as volume, {r('aspect_ratio', 6)} as aspect_ratio,
(select count(*) from boxes b where b.class_label = 'Antenna' and b.scene = s.scene and b.pose_index = s.pose_index) as n_in_frame,
exists (select 1 from kept k where k.class_label = 'Antenna' and k.scene = s.scene and k.pose_index = s.pose_index) as class_survives
from stats s where class_label = 'Antenna' and f1""",
    ),
)
def _(inp: Inputs):
    drops = clean.list_drops(inp.boxes, clean.clean_boxes(inp.boxes), "Antenna", "num_points")
    return rounded(rounded(drops, ["volume"]), ["aspect_ratio"])


@query(
    "frame_completeness",
    with_ctes("frames", "select scene, count(*) as frames, 100 as expected, count(*) = 100 as complete from frames group by scene"),
)
def _(inp: Inputs):
    return clean.frame_completeness(inp.frames)


_OUT = "box_id, scene, pose_index, class_label, '{0}' as finding, bbox_width, bbox_length, bbox_height, num_points from boxes"


@query(
    "box_outliers",
    with_ctes(
        "boxes",
        f"""select {_OUT.format('tiny')} where bbox_width < 0.5 and bbox_length < 0.5 and bbox_height < 0.5
union all select {_OUT.format('huge')} where bbox_width > 200 or bbox_length > 200 or bbox_height > 200
union all select {_OUT.format('low_points')} where num_points < 20
union all select {_OUT.format('crowded')} join per_frame using (scene, pose_index) where n > 30""",
        extra=_PER_FRAME,
    ),
)
def _(inp: Inputs):
    return clean.box_outliers(inp.boxes)


@query("empty_frames", with_ctes("frames boxes", "select scene, pose_index from frames except select scene, pose_index from boxes"))
def _(inp: Inputs):
    return clean.empty_frames(inp.frames, inp.boxes)


@query(
    "size_distribution",
    with_ctes(
        "boxes",
        f"""select class_label, dimension, min(v) as min, {r('quantile_cont(v, 0.25)', 6)} as q1, {r('quantile_cont(v, 0.5)', 6)} as median,
{r('quantile_cont(v, 0.75)', 6)} as q3, max(v) as max from (select class_label, 'bbox_width' as dimension, bbox_width as v from boxes
union all select class_label, 'bbox_length', bbox_length from boxes union all select class_label, 'bbox_height', bbox_height from boxes) d
group by class_label, dimension""",
    ),
)
def _(inp: Inputs):
    return rounded(clean.size_distribution(inp.boxes), ["q1", "median", "q3"])


@query(
    "points_distribution",
    with_ctes(
        "boxes",
        f"""select class_label, count(*) as n, min(num_points) as min, max(num_points) as max, {r('quantile_cont(num_points, 0.25)', 6)} as q1,
{r('quantile_cont(num_points, 0.5)', 6)} as median, {r('quantile_cont(num_points, 0.75)', 6)} as q3 from boxes group by class_label""",
    ),
)
def _(inp: Inputs):
    return rounded(clean.points_distribution(inp.boxes), ["q1", "median", "q3"])


@query(
    "compare_runs",
    with_ctes(
        "gt",
        """select coalesce(class_label, 'TOTAL') as class_label, cast(sum(a) as bigint) as n_a, cast(sum(b) as bigint) as n_b,
cast(sum(b) - sum(a) as bigint) as delta from (select class_label as class_label, 1 as a, 0 as b from boxes union all select class_label, 0, 1 from gt) t
group by rollup (t.class_label)""",
    ),
)
def _(inp: Inputs):
    return clean.compare_runs(inp.boxes, inp.ground_truth)


@query(
    "compare_runs_frames",
    with_ctes(
        "gt",
        """select scene, pose_index, coalesce(n_a, 0) as n_a, coalesce(n_b, 0) as n_b, abs(coalesce(n_b, 0) - coalesce(n_a, 0)) as difference
from (select scene, pose_index, count(*) as n_a from boxes group by all) a full join (select scene, pose_index, count(*) as n_b from gt group by all) b
using (scene, pose_index) order by difference desc, scene, pose_index limit 10""",
    ),
)
def _(inp: Inputs):
    return clean.compare_runs_frames(inp.boxes, inp.ground_truth)
