"""Common table expressions of the check SQL."""

from __future__ import annotations

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], body: str) -> None:
    CTES[name] = (needs, body)


def with_ctes(names: list[str] | str, body: str, recursive: bool = False, extra: str = "", materialized: bool = False) -> str:
    """Prefix ``body`` with the named table expressions and all they need; ``extra`` adds query-own ones.

    ``materialized`` has the named ones computed once, for bodies that read them several times.
    """
    names = names.split() if isinstance(names, str) else names
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in CTES[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    once = " materialized" if materialized else ""
    parts = [f"{name} as{once} ({CTES[name][1]})" for name in ordered]
    if extra:
        parts.append(extra)
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + "\n" + body


def r(expr: str, digits: int) -> str:
    return f"(round({expr}, {digits}) + cast(0 as double))"


def draw_sql(purpose: str, *keys: str) -> str:
    """The same draw as ``functions.columns.draw``."""
    return f"(cast(concat('0x', substr(md5(concat_ws('|', '{purpose}', {', '.join(keys)})), 1, 8)) as bigint) // 2)"


def uniform_sql(purpose: str, *keys: str) -> str:
    return f"({draw_sql(purpose, *keys)}/2147483648e0)"


MARK = "case l_linenumber when 1 then {} when 2 then {} when 3 then {} when 4 then {} else 128 end"
cte(
    "returns",
    [],
    f"""select concat('scene_', cast(l_suppkey % 10 + 1 as varchar)) as scene,
  cast(l_suppkey*137 as double) as ego_x, cast(l_suppkey*71 as double) as ego_y, cast(14000 as double) as ego_z,
  cast(l_suppkey*29 % 360 - 180 as double) as ego_yaw,
  row_number() over (partition by l_suppkey order by l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_quantity,
    l_discount, l_tax, l_shipdate) - 1 as point_id,
  cast(case when l_linenumber = 7 then 0 else cast(floor(l_extendedprice) as bigint) % 30000 end as double) as distance_cm,
  cast(l_partkey*37 % 12000 - 6000 as double) as azimuth_raw,
  cast(l_orderkey*13 % 3000 - 1500 as double) as elevation_raw,
  cast(l_quantity*5 as int) as reflectivity,
  {MARK.format(38, 177, 129, 66)} as r, {MARK.format(23, 132, 81, 132)} as g, {MARK.format(180, 47, 97, 9)} as b
from lineitem""",
)
cte(
    "frames",
    ["returns"],
    """select scene, cast(row_number() over (partition by scene order by ego_x, ego_y, ego_z, ego_yaw) - 1 as int)
  as pose_index, ego_x, ego_y, ego_z, ego_yaw, num_points
from (select scene, ego_x, ego_y, ego_z, ego_yaw, count(*) as num_points from returns group by all) p""",
)
cte(
    "points",
    ["returns", "frames"],
    f"""select t.scene, f.pose_index, t.point_id, t.ego_x, t.ego_y, t.ego_z, t.ego_yaw, t.reflectivity, t.r, t.g, t.b,
  {r("distance_cm / 100 * cos(radians(elevation_raw / 100)) * cos(radians(azimuth_raw / 100))", 4)} as x,
  {r("-(distance_cm / 100 * cos(radians(elevation_raw / 100)) * sin(radians(azimuth_raw / 100)))", 4)} as y,
  {r("distance_cm / 100 * sin(radians(elevation_raw / 100))", 4)} as z,
  case when r=38 and g=23 and b=180 then 0 when r=177 and g=132 and b=47 then 1 when r=129 and g=81 and b=97 then 2
    when r=66 and g=132 and b=9 then 3 else -1 end as class_id,
  case when r=38 and g=23 and b=180 then 'Antenna' when r=177 and g=132 and b=47 then 'Cable'
    when r=129 and g=81 and b=97 then 'Electric Pole' when r=66 and g=132 and b=9 then 'Wind Turbine'
    else 'Background' end as class_label
from returns t join frames f using (scene, ego_x, ego_y, ego_z, ego_yaw) where distance_cm > 0""",
)
cte(
    "world",
    ["points"],
    """select *, x*cos(radians(ego_yaw)) - y*sin(radians(ego_yaw)) + ego_x/100 as x_world,
  x*sin(radians(ego_yaw)) + y*cos(radians(ego_yaw)) + ego_y/100 as y_world, z + ego_z/100 as z_world from points""",
)
cte(
    "boxes",
    [],
    """select o_orderkey as box_id, concat('scene_', cast(o_custkey % 10 + 1 as varchar)) as scene,
  cast(floor(o_custkey / cast(10 as double)) as int) as pose_index,
  cast(o_custkey*137 as double) as ego_x, cast(o_custkey*71 as double) as ego_y, cast(14000 as double) as ego_z,
  cast(o_custkey*29 % 360 - 180 as double) as ego_yaw,
  (o_orderkey*37 % 2000) / cast(100 as double) as bbox_center_x,
  (o_orderkey*53 % 2000 - 1000) / cast(100 as double) as bbox_center_y,
  (o_orderkey*17 % 1000) / cast(100 as double) as bbox_center_z,
  (o_orderkey*13 % 3000 + 50) / cast(100 as double) as bbox_width,
  (o_orderkey*7 % 2000 + 30) / cast(100 as double) as bbox_length,
  (cast(floor(o_totalprice) as bigint) % 6000 + 30) / cast(100 as double) as bbox_height,
  (o_orderkey*11 % 628 - 314) / cast(100 as double) as bbox_yaw,
  case substr(o_orderpriority,1,1) when '1' then 0 when '2' then 1 when '3' then 2 when '4' then 3 else -1 end as class_id,
  case substr(o_orderpriority,1,1) when '1' then 'Antenna' when '2' then 'Cable' when '3' then 'Electric Pole'
    when '4' then 'Wind Turbine' else 'Unknown' end as class_label,
  cast(floor(o_totalprice) as bigint) % 200 as num_points,
  (o_orderkey*29 % 1000) / cast(1000 as double) as confidence
from orders""",
)
cte(
    "gt",
    ["boxes"],
    "select * replace (bbox_center_x + cast(0.4 as double) as bbox_center_x) from boxes where box_id % 7 <> 0",
)
