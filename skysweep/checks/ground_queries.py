"""Ground estimation and removal."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysweep import schema
from skysweep.checks.registry import SQL, Inputs, query
from skysweep.checks.sqltext import cte, r, with_ctes
from skysweep.functions.columns import rnd
from skysweep.operators import frames, ground
from skysweep.plans import survival
from skysweep.session import cut_lineage
from skysweep.sources import tables

cte(
    "tiled",
    ["points"],
    """select p.*, case when n < 10 then 0 else least(cast(floor((x - x0) / 5) as int), greatest(cast(ceil((x1 - x0) / 5) as int), 1) - 1) end as tile_x,
  case when n < 10 then 0 else least(cast(floor((y - y0) / 5) as int), greatest(cast(ceil((y1 - y0) / 5) as int), 1) - 1) end as tile_y
from points p join (select scene, pose_index, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, count(*) as n
  from points group by scene, pose_index) e using (scene, pose_index)""",
)
cte(
    "tiles",
    ["tiled"],
    """select scene, pose_index, tile_x, tile_y, quantile_cont(z, 0.05) as ground_z, count(*) as tile_points
from tiled group by scene, pose_index, tile_x, tile_y""",
)
cte(
    "hag",
    ["tiles"],
    f"""select t.* exclude (tile_x, tile_y), g.ground_z, {r('z - ground_z', 6)} as hag
from tiled t join tiles g using (scene, pose_index, tile_x, tile_y)""",
)
THRESHOLDS = "(values (2e0), (5e0)) t(threshold_m)"
NAMES = {"antenna": 0, "cable": 1, "electric_pole": 2, "wind_turbine": 3}
cte(
    "survival",
    ["hag"],
    f"""select scene, threshold_m, case when class_id < 0 then 'noise' else class_label end as class_label,
  count(*) as total, count(*) filter (hag > threshold_m) as survived from hag, {THRESHOLDS} group by all""",
)


def _metrics_sql() -> str:
    labels = {"antenna": "Antenna", "cable": "Cable", "electric_pole": "Electric Pole", "wind_turbine": "Wind Turbine", "noise": "noise"}
    columns = []
    for short, label in labels.items():
        total = f"coalesce(sum(total) filter (class_label = '{label}'), 0)"
        kept = f"coalesce(sum(survived) filter (class_label = '{label}'), 0)"
        columns += [f"cast({total} as bigint) as {short}_total", f"cast({kept} as bigint) as {short}_survived"]
        share = r(f"100e0 * {kept} / nullif({total}, 0)", 6)
        columns.append(f"{share} as {short}_survival_pct" if short != "noise" else f"coalesce({share}, 0) as noise_survival_pct")
        if short == "noise":
            columns.append(f"{r(f'100 - coalesce(100e0 * {kept} / nullif({total}, 0), 0)', 6)} as noise_removed_pct")
    return f"""select scene, threshold_m, {', '.join(columns)}, cast(sum(total) as bigint) as all_points_total,
cast(sum(survived) as bigint) as all_points_survived, {r('100e0*sum(survived)/sum(total)', 6)} as all_points_survival_pct,
{r('100 - 100e0*sum(survived)/sum(total)', 6)} as total_removed_pct from survival group by scene, threshold_m"""


cte("metrics", ["survival"], _metrics_sql())
OK = """(antenna_survival_pct is null or antenna_survival_pct >= 60) and (electric_pole_survival_pct is null or electric_pole_survival_pct >= 70)
and (wind_turbine_survival_pct is null or wind_turbine_survival_pct >= 75)"""
PCT = [f"{n}_survival_pct" for n in [*NAMES, "noise", "all_points"]] + ["noise_removed_pct", "total_removed_pct"]


def rounded(df, columns, digits=6):
    return df.withColumns({c: rnd(c, digits) for c in columns})


@query("tile_ground", with_ctes("tiles", f"select * replace ({r('ground_z', 6)} as ground_z) from tiles"))
def _(inp: Inputs):
    return rounded(ground.tile_ground(inp.points_unnumbered), ["ground_z"])


@query("hag", with_ctes("hag", f"select scene, pose_index, point_id, z, {r('ground_z', 6)} as ground_z, hag from hag"))
def _(inp: Inputs):
    return rounded(ground.hag(inp.points), ["ground_z"]).select(*schema.FRAME, "point_id", "z", "ground_z", "hag")


@query(
    "ground_filter",
    with_ctes("hag", f"select scene, pose_index, point_id as kept_index, x, y, z, class_id, {r('ground_z', 6)} as ground_z, hag from hag where hag > 2"),
)
def _(inp: Inputs):
    kept = ground.ground_filter(ground.hag(inp.points), 2.0)
    return rounded(kept, ["ground_z"]).select(*schema.FRAME, "kept_index", "x", "y", "z", "class_id", "ground_z", "hag")


_PER_CLASS = ", ".join(
    f"count(*) filter (class_id = {i}) as {n}_original, count(*) filter (class_id = {i} and hag > 2) as {n}_cleaned"
    for n, i in NAMES.items()
)
cte(
    "cleaned",
    ["hag"],
    f"""select scene, pose_index, ego_x, ego_y, ego_z, ego_yaw, count(*) as num_points_original,
  count(*) filter (hag > 2) as num_points_cleaned, {_PER_CLASS}, {r('100e0*(1 - count(*) filter (hag > 2)/count(*))', 6)} as points_removed_pct,
  concat('cleaned/', scene, '/frame_', lpad(cast(pose_index as varchar), 3, '0'), '.parquet') as cleaned_path
from hag group by scene, pose_index, ego_x, ego_y, ego_z, ego_yaw""",
)


@query("clean_manifest", with_ctes("cleaned", "select * from cleaned"))
def _(inp: Inputs):
    return rounded(ground.clean_manifest(ground.hag(inp.points_unnumbered)), ["points_removed_pct"])


@query(
    "clean_manifest_ext",
    with_ctes(
        "hag",
        f"""select scene, pose_index, ego_x, ego_y, ego_z, ego_yaw, count(*) as num_points_original,
count(*) filter (hag > 2) as num_points_cleaned, {r('100e0*(1 - count(*) filter (hag > 2)/count(*))', 6)} as points_removed_pct,
{r('min(ground_z)', 6)} as ground_z_min, {r('max(ground_z)', 6)} as ground_z_max, {r('avg(ground_z)', 6)} as ground_z_mean,
min(hag) filter (hag > 2) as hag_min, max(hag) filter (hag > 2) as hag_max, {r('avg(hag) filter (hag > 2)', 6)} as hag_mean,
min(x) filter (hag > 2) as x_min, max(x) filter (hag > 2) as x_max, min(y) filter (hag > 2) as y_min,
max(y) filter (hag > 2) as y_max, min(z) filter (hag > 2) as z_min, max(z) filter (hag > 2) as z_max,
count(*) filter (class_id < 0) as noise_original, count(*) filter (class_id < 0 and hag > 2) as noise_cleaned,
2e0 as threshold_m from hag group by scene, pose_index, ego_x, ego_y, ego_z, ego_yaw""",
    ),
)
def _(inp: Inputs):
    manifest = ground.clean_manifest_ext(ground.hag(inp.points_unnumbered))
    return rounded(manifest, ["points_removed_pct", "ground_z_min", "ground_z_max", "ground_z_mean", "hag_mean"])


@query(
    "manifest_fixup",
    with_ctes(
        "cleaned",
        """select scene, pose_index, ego_x, ego_y, ego_z, ego_yaw, cast(trunc(num_points_original * 1.2e0) as bigint) as num_points_raw,
num_points_cleaned as num_points_valid, cast(trunc(num_points_original * 1.2e0) as bigint) - num_points_cleaned as num_invalid_dropped,
cleaned_path as file from cleaned""",
    ),
)
def _(inp: Inputs):
    return frames.manifest_fixup(ground.clean_manifest(ground.hag(inp.points_unnumbered)))


@query("survival_counts", with_ctes("survival", "select * from survival"))
def _(inp: Inputs):
    return ground.survival_counts(ground.hag(inp.points_unnumbered))


@query("survival_metrics", with_ctes("metrics", "select * from metrics"))
def _(inp: Inputs):
    return rounded(survival.survival_report(inp.returns_unnumbered), PCT)


@query("threshold_status", with_ctes("metrics", f"select scene, threshold_m, {OK} as passes from metrics"))
def _(inp: Inputs):
    return ground.threshold_status(survival.survival_report(inp.returns_unnumbered))


@query(
    "threshold_first_ok",
    with_ctes(
        "metrics",
        f"""select case when count(antenna_survival_pct) + count(electric_pole_survival_pct) + count(wind_turbine_survival_pct) > 0 then
coalesce(arg_min(threshold_m, (scene, threshold_m)) filter ({OK}), min(threshold_m)) end as threshold_m from metrics""",
    ),
)
def _(inp: Inputs):
    return ground.threshold_first_ok(survival.survival_report(inp.returns_unnumbered))


@query(
    "threshold_highest_ok",
    with_ctes("metrics", f"select scene, coalesce(max(threshold_m) filter ({OK}), min(threshold_m)) as threshold_m from metrics group by scene"),
)
def _(inp: Inputs):
    return ground.threshold_highest_ok(survival.survival_report(inp.returns_unnumbered))


_QA = {"antenna": 0.6, "cable": 0, "electric_pole": 0.7, "wind_turbine": 0.75}


@query(
    "ground_qa",
    with_ctes(
        "hag",
        f"""select scene, pose_index, count(*) as original, count(*) filter (hag > 2) as kept,
{r('100e0*(1 - count(*) filter (hag > 2)/count(*))', 6)} as removed_pct, min(hag) filter (hag > 2) as min_hag,
coalesce(min(hag) filter (hag > 2) > 2, true) as hag_ok,
{', '.join(f"coalesce(count(*) filter (class_id = {NAMES[n]} and hag > 2) / cast(nullif(count(*) filter (class_id = {NAMES[n]}), 0) as double) >= {m}, true) as {n}_ok" for n, m in _QA.items())}
from hag where scene = (select min(scene) from frames) and pose_index in (select pose_index from frames where
scene = (select min(scene) from frames) order by pose_index limit 5) group by scene, pose_index""",
    ),
)
def _(inp: Inputs):
    return rounded(ground.ground_qa(inp.points_unnumbered, inp.frames), ["removed_pct"])


@query(
    "kept_by_threshold",
    with_ctes(
        "hag",
        f"""select scene, pose_index, threshold_m, count(*) as total, count(*) filter (hag > threshold_m) as kept,
{r('100e0 * count(*) filter (hag > threshold_m) / count(*)', 6)} as kept_pct, min(hag) as hag_min, max(hag) as hag_max
from hag, (values (2e0), (5e0), (10e0), (15e0), (20e0), (25e0)) t(threshold_m) group by scene, pose_index, threshold_m""",
    ),
)
def _(inp: Inputs):
    return rounded(ground.kept_by_threshold(ground.hag(inp.points_unnumbered)), ["kept_pct"])


@query(
    "class_survival_frame",
    with_ctes(
        "hag",
        f"""select scene, pose_index, class_label, count(*) as n, count(*) filter (hag > 2) as survived,
{r('count(*) filter (hag > 2) / cast(count(*) as double)', 6)} as rate, {r('quantile_cont(hag, 0.5)', 8)} as median_hag
from hag where class_id >= 0 group by scene, pose_index, class_label""",
    ),
)
def _(inp: Inputs):
    stats = ground.class_survival_frame(ground.hag(inp.points_unnumbered))
    return rounded(rounded(stats, ["rate"]), ["median_hag"], 8)


@query(
    "run_totals",
    with_ctes(
        "hag",
        f"""select scene, count(*) as original, count(*) filter (hag > 2) as kept,
{r('100e0*(1 - count(*) filter (hag > 2)/count(*))', 6)} as removed_pct from hag group by rollup (scene)""",
    ),
)
def _(inp: Inputs):
    return rounded(ground.run_totals(ground.hag(inp.points_unnumbered)), ["removed_pct"])


@query(
    "manifest_stats",
    with_ctes(
        "cleaned",
        f"""select count(*) as frames, min(num_points_cleaned) as cleaned_min, max(num_points_cleaned) as cleaned_max,
{r('avg(num_points_cleaned)', 6)} as cleaned_mean, {r('quantile_cont(num_points_cleaned, 0.5)', 6)} as cleaned_median,
{', '.join(f'cast(sum({n}_cleaned) as bigint) as {n}_points, count(*) filter ({n}_cleaned > 0) as {n}_frames' for n in NAMES)} from cleaned""",
    ),
)
def _(inp: Inputs):
    stats = ground.manifest_stats(ground.clean_manifest(ground.hag(inp.points_unnumbered)))
    return rounded(stats, ["cleaned_mean", "cleaned_median"])


cte(
    "bounds",
    ["world"],
    """select scene, x0, y0, cast(ceil((x1 - x0) / 10) as int) as nx, cast(ceil((y1 - y0) / 10) as int) as ny from (
  select scene, min(x_world) - 10 as x0, max(x_world) + 10 as x1, min(y_world) - 10 as y0, max(y_world) + 10 as y1
  from world group by scene) b""",
)
_WT = """least(greatest(cast(floor((x_world - x0) / 10) as int), 0), nx - 1) as tile_x,
  least(greatest(cast(floor((y_world - y0) / 10) as int), 0), ny - 1) as tile_y"""
cte(
    "seen",
    ["bounds"],
    f"""select scene, tile_x, tile_y, min(z_world) as z from (select scene, z_world, {_WT}
  from world join bounds using (scene)) w group by scene, tile_x, tile_y""",
)
cte(
    "model",
    ["seen"],
    """select g.scene, g.tile_x, g.tile_y, coalesce(any_value(s.z), quantile_cont(n.z, 0.5)) as ground_z, any_value(s.z) is null as filled
from (select scene, nx, ny, tx.v as tile_x, ty.v as tile_y from bounds, lateral (select unnest(range(cast(nx as bigint))) as v) tx, lateral (select unnest(range(cast(ny as bigint))) as v) ty) g
cross join (values (-1), (0), (1)) a(i) cross join (values (-1), (0), (1)) b(j)
left join seen s on s.scene = g.scene and s.tile_x = g.tile_x and s.tile_y = g.tile_y
left join seen n on n.scene = g.scene and n.tile_x = least(greatest(g.tile_x + i, 0), nx - 1) and n.tile_y = least(greatest(g.tile_y + j, 0), ny - 1)
group by g.scene, g.tile_x, g.tile_y having count(s.z) + count(n.z) > 0""",
)
cte(
    "whag",
    ["model"],
    f"""select w.* exclude (tile_x, tile_y), m.ground_z, {r('z_world - ground_z', 6)} as hag
from (select w.*, {_WT} from world w join bounds using (scene)) w left join model m using (scene, tile_x, tile_y)""",
)


@query(
    "scene_ground_model",
    with_ctes("model", f"select scene, cast(tile_x as int) as tile_x, cast(tile_y as int) as tile_y, {r('ground_z', 6)} as ground_z, filled from model"),
)
def _(inp: Inputs):
    return rounded(ground.scene_ground_model(inp.points_unnumbered), ["ground_z"])


@query("scene_ground_lookup", with_ctes("whag", f"select scene, pose_index, point_id, {r('ground_z', 6)} as ground_z, hag from whag"))
def _(inp: Inputs):
    found = ground.scene_ground_lookup(inp.points)
    return rounded(found, ["ground_z"]).select(*schema.FRAME, "point_id", "ground_z", "hag")


@query(
    "ground_coverage",
    with_ctes(
        "whag",
        f"""select scene, pose_index, count(*) as n, count(*) filter (hag is null) as n_missing,
{r('100e0*count(*) filter (hag is null)/count(*)', 6)} as missing_pct, min(hag) as hag_min, max(hag) as hag_max,
{r('min(ground_z)', 6)} as ground_min, {r('max(ground_z)', 6)} as ground_max, {r('min(z_world)', 6)} as z_min,
{r('max(z_world)', 6)} as z_max from whag group by scene, pose_index""",
    ),
)
def _(inp: Inputs):
    coverage = ground.ground_coverage(ground.scene_ground_lookup(inp.points_unnumbered))
    return rounded(coverage, ["missing_pct", "ground_min", "ground_max", "z_min", "z_max"])


@query(
    "ground_at_ego",
    with_ctes(
        "model",
        f"""select scene, pose_index, {r('x_world', 6)} as x_world, {r('y_world', 6)} as y_world, {r('ground_z', 6)} as ground_z
from (select scene, pose_index, x_world, y_world, {_WT} from (select scene, pose_index, ego_x/100 as x_world, ego_y/100 as y_world from frames) f
join bounds using (scene)) f left join model using (scene, tile_x, tile_y)""",
    ),
)
def _(inp: Inputs):
    return rounded(ground.ground_at_ego(inp.frames, inp.points_unnumbered), ["x_world", "y_world", "ground_z"])


_RANGES = ", ".join(f"min({c}) as {c}_min, max({c}) as {c}_max" for c in schema.POSE)


@query(
    "ego_outliers",
    with_ctes(
        "frames",
        f"""select f.*, g.* exclude (scene) from frames f join (select scene, count(*) as frames, {_RANGES} from frames group by scene) g
using (scene) where abs(ego_z) > 13999""",
    ),
)
def _(inp: Inputs):
    return ground.ego_outliers(inp.frames, 13999)


@query(
    "frame_bounds",
    with_ctes(
        "world",
        f"""select scene, coalesce(pose_index, -1) as pose_index, {', '.join(f"{r(f'{f}({a}_world)', 4)} as {a}_{f}" for a in 'xyz' for f in ('min', 'max'))}
from world group by rollup (scene, world.pose_index) having scene is not null""",
    ),
)
def _(inp: Inputs):
    bounds = ground.frame_bounds(inp.points_unnumbered).withColumn("pose_index", F.coalesce("pose_index", F.lit(-1)))
    return rounded(bounds, [f"{a}_{f}" for a in "xyz" for f in ("min", "max")], 4)


@query(
    "frames_with_class",
    with_ctes(
        "points",
        """select class_label, count(*) as frames, cast(sum(n) as bigint) as points,
array_to_string(list_sort(list(name) filter (rn <= 5)), ',') as sample_frames from (select class_label, n,
concat(scene, '/', lpad(cast(pose_index as varchar), 3, '0')) as name, row_number() over (partition by class_label order by scene, pose_index) as rn
from (select class_label, scene, pose_index, count(*) as n from points where class_id >= 0 group by all) c) d group by class_label""",
    ),
)
def _(inp: Inputs):
    return ground.frames_with_class(inp.points_unnumbered)


@query(
    "worst_frames",
    with_ctes(
        "whag",
        f"""select class_label, scene, pose_index, n, survived, {r('survival_pct', 6)} as survival_pct, hag_min, {r('hag_median', 8)} as hag_median, cast(rank as int) as rank
from (select *, row_number() over (partition by class_label order by survival_pct, scene, pose_index) as rank from (
select class_label, scene, pose_index, count(*) as n, count(*) filter (hag > 2) as survived,
100e0*count(*) filter (hag > 2)/count(*) as survival_pct, min(hag) as hag_min, quantile_cont(hag, 0.5) as hag_median
from whag where class_id >= 0 group by class_label, scene, pose_index) s) t where rank <= 3""",
    ),
)
def _(inp: Inputs):
    worst = ground.worst_frames(ground.scene_ground_lookup(inp.points_unnumbered))
    return rounded(rounded(worst, ["survival_pct"]), ["hag_median"], 8)


_Q = {"05": 0.05, "10": 0.1, "25": 0.25, "50": 0.5, "75": 0.75, "90": 0.9, "95": 0.95}


@query(
    "hag_profile",
    with_ctes(
        "whag",
        f"""select scene, pose_index, class_label, count(*) as n, {', '.join(f"{r(f'quantile_cont(hag, {p})', 8)} as hag_p{n}" for n, p in _Q.items())},
{', '.join(f"{r(f'100e0*count(*) filter (hag > {t})/count(*)', 6)} as survival_{t}m" for t in (2, 5, 10, 15, 20, 25))}
from whag where class_id >= 0 group by scene, pose_index, class_label""",
    ),
)
def _(inp: Inputs):
    profile = ground.hag_profile(ground.scene_ground_lookup(inp.points_unnumbered))
    profile = rounded(profile, [f"hag_p{n}" for n in _Q], 8)
    return rounded(profile, [f"survival_{t}m" for t in (2, 5, 10, 15, 20, 25)])


# --- sinks: written and read back --------------------------------------------------------------------------------


@query("write_points", with_ctes("points", "select * from points"))
def _(inp: Inputs):
    tables.write_points(inp.points, f"{inp.work_folder}/points")
    return inp.spark.read.parquet(f"{inp.work_folder}/points").select(*inp.points.columns)


def read_csv(inp: Inputs, like, path: str):
    """The CSV at ``path`` with the columns and types of ``like``; fails if they are others."""
    return inp.spark.read.schema(like.schema).option("header", True).option("enforceSchema", False).csv(path)


@query("write_manifest", with_ctes("cleaned", "select * from cleaned"))
def _(inp: Inputs):
    manifest = rounded(ground.clean_manifest(ground.hag(inp.points_unnumbered)), ["points_removed_pct"])
    tables.write_manifest(manifest, f"{inp.work_folder}/manifest")
    return read_csv(inp, manifest, f"{inp.work_folder}/manifest")


def _run_summary(inp: Inputs):
    """Metrics of a run and the folder they were written to."""
    metrics = cut_lineage(rounded(survival.survival_report(inp.returns_unnumbered), PCT))
    totals = rounded(ground.run_totals(ground.hag(inp.points_unnumbered)), ["removed_pct"])
    tables.write_run_summary(metrics, totals, f"{inp.work_folder}/run")
    return metrics, f"{inp.work_folder}/run"


@query(
    "write_run_summary",
    with_ctes(
        "hag",
        f"""select scene, count(*) as original, count(*) filter (hag > 2) as kept,
{r('100e0*(1 - count(*) filter (hag > 2)/count(*))', 6)} as removed_pct from hag group by rollup (scene)""",
    ),
)
def _(inp: Inputs):
    kinds = "scene string, original long, kept long, removed_pct double"
    return inp.spark.read.schema(kinds).json(f"{_run_summary(inp)[1]}/summary")


@query("write_all_metrics", SQL["survival_metrics"])
def _(inp: Inputs):
    metrics, path = _run_summary(inp)
    return read_csv(inp, metrics, f"{path}/all_metrics")


@query("write_scene_metrics", SQL["survival_metrics"])
def _(inp: Inputs):
    metrics, path = _run_summary(inp)
    # One folder per scene; inside, the scene stands as ``scene_name``.
    inner = metrics.drop("scene").withColumn("scene_name", F.lit(""))
    stored = inp.spark.read.schema(inner.schema).option("header", True).csv(f"{path}/scene_metrics/*")
    return stored.withColumnRenamed("scene_name", "scene").select(*metrics.columns)
