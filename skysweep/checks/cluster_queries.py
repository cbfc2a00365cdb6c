"""Voxels, density clusters, boxes, features and detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysweep import schema
from skysweep.checks.ground_queries import rounded
from skysweep.checks.registry import Inputs, query
from skysweep.checks.sqltext import cte, r, with_ctes
from skysweep.functions.columns import half_turn, rnd
from skysweep.operators import boxfit, cluster
from skysweep.plans import detection
from skysweep.session import cut_lineage

TUNED = schema.overlay_parameters(schema.RUN_TUNED)
# The stand-in points are thin, so detection is run with a wide radius.
WIDE = {"epsilon": 14.0, "min_samples": 5, "min_cluster_size": 20, "min_elongation": 3.0, "merge_distance": 60.0}
GROUP = [*schema.FRAME, "class_id", "class_label"]
XYZ = ["x", "y", "z"]


def stored(df):
    """The clustering operators read their input several times, as they would read a stored point table."""
    return cut_lineage(df)


def obstacles(inp: Inputs):
    return stored(inp.points.filter("class_id >= 0").select(*GROUP, "point_id", *XYZ))


def unnumbered_obstacles(inp: Inputs):
    return stored(inp.points_unnumbered.filter("class_id >= 0").select(*GROUP, *XYZ))


def all_points(inp: Inputs):
    return stored(inp.points.select(*GROUP, "point_id", *XYZ))


cte(
    "cpoints",
    ["points"],
    """select scene, pose_index, class_id, class_label, point_id, x, y, z, row_number() over (order by scene, pose_index, point_id) as gid,
  case class_id when 1 then 8 when 3 then 8 else 5 end as eps, case class_id when 1 then 3 when 3 then 15 else 10 end as min_samples
from points where class_id >= 0""",
)
cte(
    "voxel_first",
    ["cpoints"],
    """select * from cpoints qualify row_number() over (partition by scene, pose_index, class_id, floor(x/40e0), floor(y/40e0), floor(z/40e0) order by point_id) = 1""",
)
# Neighbours, core points, components of core points and nearest core point of the others.
DBSCAN = """near as (select a.gid as p, b.gid as q, b.point_id as q_id, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) as d2
  from cpoints a join cpoints b on a.scene = b.scene and a.pose_index = b.pose_index and a.class_id = b.class_id
  where (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= a.eps*a.eps),
core as (select p from near join cpoints on gid = p group by p, min_samples having count(*) >= min_samples),
links as (select p, q from near where p in (select p from core) and q in (select p from core)),
reached as (select p as src, p as dst from core union select reached.src, links.q from reached join links on links.p = reached.dst),
core_label as (select src as gid, min(c.point_id) as cluster from reached join cpoints c on c.gid = dst group by src),
border as (select n.p as gid, arg_min(l.cluster, (n.d2, n.q_id)) as cluster from near n join core_label l on l.gid = n.q
  where n.p not in (select p from core) group by n.p),
labelled as (select c.*, coalesce(l.cluster, b.cluster, -1) as cluster from cpoints c left join core_label l using (gid) left join border b using (gid))"""
MERGED = (
    DBSCAN
    + """,
cent as (select scene, pose_index, class_id, class_label, cluster, avg(x) as x, avg(y) as y, avg(z) as z, count(*) as n
  from labelled where cluster >= 0 group by all),
dist as (select *, case class_id when 0 then 30e0 when 1 then 0.4e0 when 2 then 15e0 else 50e0 end as d from cent),
mlinks as (select a.scene, a.pose_index, a.class_id, a.cluster as p, b.cluster as q from dist a join dist b using (scene, pose_index, class_id)
  where (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) < a.d*a.d),
mreached as (select scene, pose_index, class_id, cluster as src, cluster as dst from cent
  union select m.scene, m.pose_index, m.class_id, m.src, l.q from mreached m join mlinks l on l.scene = m.scene and l.pose_index = m.pose_index
  and l.class_id = m.class_id and l.p = m.dst),
mlabel as (select scene, pose_index, class_id, src as cluster, min(dst) as merged from mreached group by all),
mpoints as (select l.* replace (coalesce(m.merged, l.cluster) as cluster) from labelled l left join mlabel m using (scene, pose_index, class_id, cluster)),
final_points as (select * from mpoints m where cluster >= 0 qualify count(*) over (partition by scene, pose_index, class_id, cluster)
  >= case class_id when 1 then 5 when 3 then 15 else 8 end)"""
)


def obb_sql(source: str, keys: str, padding: str = "0") -> str:
    """Box table ``obb`` of the clusters of ``source``."""
    c = lambda e: r(e, 9)
    return f"""mom as (select {keys}, count(*) as num_points, {c('var_samp(x)')} as cxx, {c('var_samp(y)')} as cyy, {c('covar_samp(x, y)')} as cxy from {source} group by {keys}),
yawed as (select *, case when num_points < 3 then 0 else 0.5*atan2(2*cxy, cxx - cyy) end as yaw from mom),
ext as (select {keys}, num_points, yaw, min(x*cos(yaw) + y*sin(yaw)) as u0, max(x*cos(yaw) + y*sin(yaw)) as u1, min(y*cos(yaw) - x*sin(yaw)) as v0,
  max(y*cos(yaw) - x*sin(yaw)) as v1, min(z) as z0, max(z) as z1 from {source} join yawed using ({keys}) group by {keys}, num_points, yaw),
obb as (select {keys}, {r('(u0+u1)/2*cos(yaw) - (v0+v1)/2*sin(yaw)', 5)} as bbox_center_x, {r('(u0+u1)/2*sin(yaw) + (v0+v1)/2*cos(yaw)', 5)} as bbox_center_y,
  {r('(z0+z1)/2', 5)} as bbox_center_z, {r(f'greatest(u1-u0, 0.1e0) + 2*({padding})', 5)} as bbox_width, {r(f'greatest(v1-v0, 0.1e0) + 2*({padding})', 5)} as bbox_length,
  {r(f'greatest(z1-z0, 0.1e0) + 2*({padding})', 5)} as bbox_height, {r('yaw', 5)} as bbox_yaw, num_points from ext)"""


BOX_VALUES = [f"bbox_center_{a}" for a in XYZ] + ["bbox_width", "bbox_length", "bbox_height", "bbox_yaw"]
GKEYS = "scene, pose_index, class_id, class_label"
PADDING = "case class_id when 1 then 0.4e0 when 3 then 1e0 else 0.5e0 end"


@query("voxel_downsample", with_ctes("voxel_first", f"select {GKEYS}, point_id, x, y, z from voxel_first"))
def _(inp: Inputs):
    return cluster.voxel_downsample(obstacles(inp), GROUP, 40.0)


@query(
    "voxel_if_large",
    with_ctes(
        "voxel_first",
        f"""select {GKEYS}, point_id, x, y, z from voxel_first where (scene, pose_index, class_id) in (select (scene, pose_index, class_id) from big)
union all select {GKEYS}, point_id, x, y, z from cpoints where (scene, pose_index, class_id) not in (select (scene, pose_index, class_id) from big)""",
        extra="big as (select scene, pose_index, class_id from cpoints group by all having count(*) > 85)",
    ),
)
def _(inp: Inputs):
    return cluster.voxel_if_large(obstacles(inp), GROUP, 85, 40.0)


@query("dbscan", with_ctes("cpoints", f"select {GKEYS}, point_id, cluster from labelled", recursive=True, extra=DBSCAN))
def _(inp: Inputs):
    return cluster.class_dbscan(obstacles(inp), TUNED).select(*GROUP, "point_id", "cluster")


@query(
    "cluster_centroids",
    with_ctes("cpoints", f"select {GKEYS}, cluster, {', '.join(f'{r(f'avg({a}) + 1e-9', 6)} as {a}' for a in XYZ)}, count(*) as n from labelled where cluster >= 0 group by {GKEYS}, cluster", recursive=True, extra=DBSCAN),
)
def _(inp: Inputs):
    centroids = cluster.cluster_centroids(cluster.class_dbscan(obstacles(inp), TUNED), GROUP)
    # The tiny shift keeps exact half steps from rounding either way.
    return centroids.withColumns({a: rnd(F.col(a) + F.lit(1e-9), 6) for a in XYZ})


@query("merge_clusters", with_ctes("cpoints", f"select {GKEYS}, point_id, cluster from mpoints", recursive=True, extra=MERGED))
def _(inp: Inputs):
    clustered = cluster.class_dbscan(obstacles(inp), TUNED)
    return cluster.merge_clusters(clustered, TUNED).select(*GROUP, "point_id", "cluster")


@query(
    "reassign_points",
    with_ctes(
        "cpoints",
        f"""select {GKEYS}, point_id, coalesce(c.cluster, -1) as cluster from cpoints p left join (
select p.gid, arg_min(cent.cluster, ((p.x-cent.x)*(p.x-cent.x) + (p.y-cent.y)*(p.y-cent.y) + (p.z-cent.z)*(p.z-cent.z), cent.cluster)) as cluster
from cpoints p join cent on cent.scene = p.scene and cent.pose_index = p.pose_index and cent.class_id = p.class_id
where (p.x-cent.x)*(p.x-cent.x) + (p.y-cent.y)*(p.y-cent.y) + (p.z-cent.z)*(p.z-cent.z) < (3e0*p.eps)*(3e0*p.eps) group by p.gid) c using (gid)""",
        recursive=True,
        extra=MERGED,
    ),
)
def _(inp: Inputs):
    points = obstacles(inp)
    return cluster.reassign_points(points, cluster.class_dbscan(points, TUNED), TUNED).select(*GROUP, "point_id", "cluster")


@query("min_cluster_filter", with_ctes("cpoints", f"select {GKEYS}, point_id, cluster from final_points", recursive=True, extra=MERGED))
def _(inp: Inputs):
    return cluster.cluster_points(obstacles(inp), schema.RUN_TUNED).select(*GROUP, "point_id", "cluster")


_OBB_RUN = MERGED + ",\n" + obb_sql("final_points", f"{GKEYS}, cluster", PADDING)


@query("extract_boxes", with_ctes("cpoints", f"select {GKEYS}, cluster, {', '.join(BOX_VALUES)}, num_points from obb", recursive=True, extra=_OBB_RUN))
def _(inp: Inputs):
    return rounded(cluster.extract_boxes(obstacles(inp), schema.RUN_TUNED), BOX_VALUES, 5)


@query(
    "gt_boxes_run",
    with_ctes(
        "cpoints",
        f"""select scene, pose_index, concat('processed/', scene, '/frame_', lpad(cast(pose_index as varchar), 3, '0'), '.parquet') as frame_file,
ego_x, ego_y, ego_z, ego_yaw, {', '.join(BOX_VALUES)}, class_id as "class_ID", class_label, obb.num_points from obb join frames f using (scene, pose_index)""",
        recursive=True,
        extra=_OBB_RUN,
    ),
)
def _(inp: Inputs):
    return rounded(cluster.gt_boxes_run(obstacles(inp), inp.frames, schema.RUN_TUNED), BOX_VALUES, 5)


@query(
    "gt_boxes_run_stats",
    with_ctes(
        "cpoints",
        f"""select class_label, count(*) as n_boxes, {', '.join(f"{r(f'avg(bbox_{d})', 3)} as mean_{d}, {r(f'quantile_cont(bbox_{d}, 0.5)', 3)} as median_{d}, {r(f'max(bbox_{d})', 3)} as max_{d}" for d in ('width', 'length', 'height'))},
{r('avg(num_points)', 6)} as mean_points, {r('count(*)/count(distinct (scene, pose_index))', 6)} as mean_per_frame,
(select max(n) from (select count(*) as n from obb i where i.class_label = o.class_label group by scene, pose_index) f) as max_per_frame from obb o group by class_label""",
        recursive=True,
        extra=_OBB_RUN,
    ),
)
def _(inp: Inputs):
    stats = cluster.run_statistics(cluster.gt_boxes_run(obstacles(inp), inp.frames, schema.RUN_TUNED))
    sides = [f"{s}_{d}" for s in ("mean", "median", "max") for d in ("width", "length", "height")]
    return rounded(rounded(stats, sides, 3), ["mean_points", "mean_per_frame"])


cte(
    "high",
    ["points"],
    """select p.* from points p join (select scene, pose_index, quantile_cont(z, 0.05) as z5, count(*) as n from points group by all) b using (scene, pose_index)
where n >= 30 and z - z5 > 0.5 qualify count(*) over (partition by scene, pose_index) >= 30""",
)


@query("height_prefilter", with_ctes("high", "select scene, pose_index, point_id, x, y, z from high"))
def _(inp: Inputs):
    return cluster.height_prefilter(all_points(inp)).select(*schema.FRAME, "point_id", *XYZ)


_CUT = """hpoints as (select *, row_number() over (order by scene, pose_index, point_id) as gid from high),
near as (select a.gid as p, b.gid as q from hpoints a join hpoints b on a.scene = b.scene and a.pose_index = b.pose_index
  where (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 14e0*14e0),
core as (select p from near group by p having count(*) >= 5),
links as (select p, q from near where p in (select p from core) and q in (select p from core)),
step0 as (select p as gid, min(q) as lbl from links group by p),
reached as (select p as src, p as dst from core union select reached.src, links.q from reached join links on links.p = reached.dst),
comp as (select src as gid, min(h.point_id) as cluster from reached join hpoints h on h.gid = dst group by src),
cut as (select scene, pose_index, point_id, x, y, z, class_id, class_label, case when count(*) over (partition by scene, pose_index, c.cluster) >= 20 and c.cluster is not null then c.cluster else -1 end as cluster
  from hpoints left join comp c using (gid))"""


def _cut(inp: Inputs):
    high = cluster.height_prefilter(all_points(inp), SET["min_height"], SET["min_cluster_size"])
    return cluster.density_cut(high, SET["epsilon"], SET["min_samples"], SET["min_cluster_size"])


SET = detection.SETTINGS | WIDE


@query(
    "density_cut",
    with_ctes("high", "select scene, pose_index, point_id, cluster from cut", recursive=True, extra=_CUT.replace("from high", "from high20")
        .replace("hpoints as", "high20 as (select p.* from points p join (select scene, pose_index, quantile_cont(z, 0.05) as z5, count(*) as n from points group by all) b using (scene, pose_index) where n >= 20 and z - z5 > 0.5 qualify count(*) over (partition by scene, pose_index) >= 20),\nhpoints as")),
)
def _(inp: Inputs):
    return _cut(inp).select(*schema.FRAME, "point_id", "cluster")


@query("detect_frame")
def _(inp: Inputs):
    columns = ["bbox_center_x", "bbox_center_y", "bbox_center_z", "bbox_length", "bbox_width", "bbox_height", "bbox_volume"]
    found = detection.detect(all_points(inp), **WIDE)
    return rounded(found, columns, 4).select(*schema.FRAME, "cluster", "n_points", "n_fragments", *columns, "predicted_class", "gt_class", rnd("geo_confidence", 6).alias("geo_confidence"))


@query("detect_dataset")
def _(inp: Inputs):
    return detection.detection_report(detection.detect(all_points(inp), **WIDE), inp.frames)


# --- boxes of whole (frame, class) groups ------------------------------------------------------------------------


@query("obb_yaw_pca", with_ctes("cpoints", f"select {GKEYS}, {', '.join(BOX_VALUES)}, num_points from obb", extra=obb_sql("cpoints", GKEYS)))
def _(inp: Inputs):
    boxes = boxfit.obb_yaw_pca(unnumbered_obstacles(inp), GROUP)
    return rounded(boxes.withColumn("bbox_yaw", half_turn(F.col("bbox_yaw"))), BOX_VALUES, 5)


# Every hull edge is a line through two points, so the smallest rectangle over all such lines is the smallest one.
MINRECT = """dirs as (select distinct a.scene, a.pose_index, a.class_id, atan2(b.y - a.y, b.x - a.x) as t from cpoints a join cpoints b
  on a.scene = b.scene and a.pose_index = b.pose_index and a.class_id = b.class_id and (b.x > a.x or (b.x = a.x and b.y > a.y))),
rects as (select p.scene, p.pose_index, p.class_id, t, max(x*cos(t) + y*sin(t)) as u1, min(x*cos(t) + y*sin(t)) as u0, max(y*cos(t) - x*sin(t)) as v1,
  min(y*cos(t) - x*sin(t)) as v0, max(z) - min(z) as h, (max(z) + min(z))/2 as cz, count(*) as n_points
  from cpoints p join dirs using (scene, pose_index, class_id) group by p.scene, p.pose_index, p.class_id, t),
best as (select * from rects qualify row_number() over (partition by scene, pose_index, class_id order by (u1-u0)*(v1-v0), t) = 1),
minrect as (select scene, pose_index, class_id, n_points, {cx} as bbox_center_x, {cy} as bbox_center_y, {cz} as bbox_center_z,
  {l} as bbox_length, {w} as bbox_width, {h} as bbox_height, greatest(u1-u0, v1-v0) as len, least(u1-u0, v1-v0) as wid, h as hei from best where n_points >= 4)""".format(
    cx=r("(u0+u1)/2*cos(t) - (v0+v1)/2*sin(t)", 5),
    cy=r("(u0+u1)/2*sin(t) + (v0+v1)/2*cos(t)", 5),
    cz=r("cz", 5),
    l=r("greatest(u1-u0, v1-v0)", 4),
    w=r("least(u1-u0, v1-v0)", 4),
    h=r("h", 4),
)


@query(
    "obb_min_area",
    with_ctes(
        "cpoints",
        "select scene, pose_index, class_id, n_points, bbox_center_x, bbox_center_y, bbox_center_z, bbox_length, bbox_width, bbox_height from minrect",
        extra=MINRECT,
    ),
)
def _(inp: Inputs):
    boxes = boxfit.obb_min_area(unnumbered_obstacles(inp), [*schema.FRAME, "class_id"])
    boxes = rounded(boxes, ["bbox_length", "bbox_width", "bbox_height"], 4)
    return rounded(boxes, [f"bbox_center_{a}" for a in XYZ], 5).drop("bbox_yaw", "bbox_volume")


@query("obb_pca3d")
def _(inp: Inputs):
    boxes = boxfit.obb_pca3d(unnumbered_obstacles(inp), [*schema.FRAME, "class_id"])
    return rounded(boxes, [f"bbox_center_{a}" for a in XYZ] + ["bbox_length", "bbox_width", "bbox_height", "bbox_volume"], 4)


@query("principal_direction")
def _(inp: Inputs):
    return rounded(boxfit.principal_direction(unnumbered_obstacles(inp), [*schema.FRAME, "class_id"]), ["dx", "dy", "dz"], 5)


FEATURES = MINRECT + """,
feat as (select m.scene, m.pose_index, m.class_id, m.n_points, len, wid, hei, len*wid*hei as vol, len/greatest(wid, 0.01e0) as aspect_lw, len/greatest(hei, 0.01e0) as aspect_lh,
  wid/greatest(hei, 0.01e0) as aspect_wh, len/greatest(least(wid, hei), 0.01e0) as elongation, least(wid, hei)/greatest(len, 0.01e0) as flatness,
  m.n_points/greatest(len*wid*hei, 0.01e0) as density, z_min, z_max, z_mean, z_std, z_min as z_above_ground, hei/greatest(len, wid, 0.01e0) as vertical_ratio,
  sqrt(len*len + wid*wid) as xy_extent from minrect m join (select scene, pose_index, class_id, min(z) as z_min, max(z) as z_max, avg(z) as z_mean,
  stddev_pop(z) as z_std from cpoints group by all) z using (scene, pose_index, class_id))"""
_F6 = ["aspect_lw", "aspect_lh", "aspect_wh", "elongation", "flatness", "z_std", "vertical_ratio"]
_CLUSTER = [*schema.FRAME, "class_id"]


def _features(inp: Inputs):
    points = unnumbered_obstacles(inp)
    return boxfit.cluster_features(points, boxfit.obb_min_area(points, _CLUSTER), _CLUSTER)


@query(
    "cluster_features",
    with_ctes(
        "cpoints",
        f"""select scene, pose_index, class_id, n_points, {r('len', 4)} as bbox_length, {r('wid', 4)} as bbox_width, {r('hei', 4)} as bbox_height, {r('vol', 1)} as bbox_volume,
{', '.join(f'{r(f, 5)} as {f}' for f in _F6)}, {r("density", 9)} as density, {r("z_mean + 1e-9", 6)} as z_mean, z_min, z_max, z_above_ground, {r('xy_extent', 4)} as xy_extent from feat""",
        extra=FEATURES,
    ),
)
def _(inp: Inputs):
    features = rounded(_features(inp), ["bbox_length", "bbox_width", "bbox_height", "xy_extent"], 4)
    features = rounded(rounded(features, ["bbox_volume"], 1), ["density"], 9)
    # Means of four-decimal heights can end in an exact half step; the tiny shift rounds it the same way everywhere.
    features = features.withColumn("z_mean", rnd(F.col("z_mean") + F.lit(1e-9), 6))
    return rounded(features, _F6, 5).drop(*[f"bbox_center_{a}" for a in XYZ], "bbox_yaw")


@query(
    "dominant_class",
    with_ctes(
        "points",
        """select scene, pose_index, cell, case arg_max(class_id, (n, -class_id)) filter (class_id >= 0) when 0 then 'Antenna' when 1 then 'Cable' when 2 then 'Electric Pole' when 3 then 'Wind Turbine' end as gt_class
from (select scene, pose_index, class_id, cast(floor(x/50) as bigint) as cell, count(*) as n from points group by all) c group by scene, pose_index, cell""",
    ),
)
def _(inp: Inputs):
    slabs = inp.points_unnumbered.withColumn("cell", F.floor(F.col("x") / 50))
    return boxfit.dominant_class(slabs, [*schema.FRAME, "cell"])


_REASON = """case when z_max - z_min < 1 then 'z_range' when flatness > 0.8 and hei < 2 then 'too_flat' when n_points < 30 then 'too_few_points' else 'ok' end"""


@query(
    "object_like",
    with_ctes("cpoints", f"select scene, pose_index, class_id, {_REASON} as reason, {_REASON} = 'ok' as is_object from feat", extra=FEATURES),
)
def _(inp: Inputs):
    return boxfit.object_like(_features(inp)).select(*_CLUSTER, "reason", "is_object")


def _score_sql(label: str) -> str:
    names = {"bbox_height": "hei", "bbox_length": "len", "bbox_volume": "vol"}
    terms = [f"case when {names.get(c, c)} {s} {limit}e0 then {factor}e0 else 1e0 end" for c, s, limit, factor in boxfit.GEOMETRY_RULES[label]]
    return " * ".join(terms)


_GEO = FEATURES + ",\nscored as (select *, " + ", ".join(
    f"{_score_sql(label)} as s{i}" for i, label in enumerate(schema.CLASS_NAMES)
) + " from feat)"


@query(
    "geo_classify",
    with_ctes(
        "cpoints",
        f"""select scene, pose_index, class_id, case greatest(s0, s1, s2, s3) when s0 then 'Antenna' when s1 then 'Cable' when s2 then 'Electric Pole' else 'Wind Turbine' end as predicted_class,
{r('greatest(s0, s1, s2, s3)/(s0 + s1 + s2 + s3 + 0.001e0)', 6)} as geo_confidence from scored""",
        extra=_GEO,
    ),
)
def _(inp: Inputs):
    classed = boxfit.geo_classify(_features(inp))
    return classed.select(*_CLUSTER, "predicted_class", rnd("geo_confidence", 6).alias("geo_confidence"))


# Box centres and yaw directions stand in for cable fragments.
_FRAGMENTS = """frag as (select box_id, scene, pose_index, bbox_center_x as x, bbox_center_y as y, bbox_center_z as z, cos(bbox_yaw) as dx, sin(bbox_yaw) as dy from boxes),
linked as (select a.box_id as src, b.box_id as dst from frag a join frag b using (scene, pose_index)
  where (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 64 and degrees(acos(least(abs(a.dx*b.dx + a.dy*b.dy), 1))) <= 30),
reached as (select box_id as src, box_id as dst from frag union select reached.src, linked.dst from reached join linked on linked.src = reached.dst)"""


@query(
    "merge_fragments",
    with_ctes("boxes", "select src as box_id, min(dst) as fragment_group from reached group by src", recursive=True, extra=_FRAGMENTS),
)
def _(inp: Inputs):
    directed = inp.boxes.withColumns({"dx": F.cos("bbox_yaw"), "dy": F.sin("bbox_yaw"), "dz": F.lit(0.0)})
    return boxfit.merge_fragments(directed, schema.FRAME, "box_id", 8.0, 30.0).select("box_id", "fragment_group")


@query("detect_cables")
def _(inp: Inputs):
    columns = ["bbox_center_x", "bbox_center_y", "bbox_center_z", "bbox_length", "bbox_width", "bbox_height"]
    members, features = boxfit.measured_clusters(stored(_cut(inp)), schema.FRAME)
    cables = boxfit.detect_cables(members, features, schema.FRAME, 2.0, 60.0)
    return rounded(cables, columns, 4).select(*schema.FRAME, "cluster", "n_points", "n_fragments", *columns, "predicted_class", "geo_confidence")



