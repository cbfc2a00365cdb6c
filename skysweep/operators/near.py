"""Neighbour search within a radius: link cells, range search and components of nearby rows.

Rows are gathered in link cells, so small that all rows of a cell lie within the radius of each other. Cells meet in
buckets four radii wide. The bounding box of a cell settles most questions; what it leaves open is compared row by row
when the cells are small and split in four per axis when they are large, until every part is settled or small. No step
therefore compares all rows of a group, however many rows share a cell. The nearest row is found under a bound that shrinks
from split to split.

Groups of at most ``WHOLE_GROUP`` rows need none of this: one table or list of distances holds them, and many such groups go to one call.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysweep.operators.graph import connected_components
from skysweep.operators.grid import cell_of, cells_between, suffixed
from skysweep.session import cut_lineage

# Largest number of row comparisons spent on one pair of cells, or on one row and one cell, before splitting.
DIRECT_PAIRS = 1024
DIRECT_ROWS = 32
SPLIT = 4
MAX_LEVELS = 24
# Most rows of a group whose distances are taken as one table (a million numbers, 8 MB), and rows of such groups that one call gets.
WHOLE_GROUP = 1024
PART_ROWS = 20_000


@dataclass(frozen=True)
class Space:
    """Coordinates that must lie within ``radius`` of each other for two rows to be linked.

    ``radius`` may read key columns only, so it is the same for all rows that can meet.
    """

    columns: tuple[str, ...]
    radius: Column
    strict: bool = False

    def linked(self, squared: Column) -> Column:
        limit = self.radius * self.radius
        return squared < limit if self.strict else squared <= limit


def _sum_of_squares(parts: Sequence[Column]) -> Column:
    return reduce(lambda s, g: s + g * g, parts[1:], parts[0] * parts[0])


def _all_linked(spaces: Sequence[Space], measure) -> Column:
    return reduce(lambda c, s: c & s.linked(measure(s.columns)), spaces[1:], spaces[0].linked(measure(spaces[0].columns)))


def _gap(columns: Sequence[str]) -> Column:
    """Smallest squared distance between the bounding boxes suffixed a and b."""
    low = lambda c: F.greatest(F.col(f"lo_{c}_b") - F.col(f"hi_{c}_a"), F.col(f"lo_{c}_a") - F.col(f"hi_{c}_b"), F.lit(0.0))
    return _sum_of_squares([low(c) for c in columns])


def _reach(columns: Sequence[str]) -> Column:
    """Largest squared distance between the bounding boxes suffixed a and b."""
    high = lambda c: F.greatest(F.col(f"hi_{c}_b") - F.col(f"lo_{c}_a"), F.col(f"hi_{c}_a") - F.col(f"lo_{c}_b"))
    return _sum_of_squares([high(c) for c in columns])


def _distance(columns: Sequence[str]) -> Column:
    return _sum_of_squares([F.col(f"{c}_a") - F.col(f"{c}_b") for c in columns])


def _coordinates(spaces: Sequence[Space]) -> list[str]:
    return [c for space in spaces for c in space.columns]


def cell_bounds(id_column: str, spaces: Sequence[Space]) -> list[Column]:
    """Aggregates that describe a cell: its smallest id, row count and bounding box."""
    return [F.min(id_column).alias("first_id"), *_bounds(spaces)]


def _bounds(spaces: Sequence[Space]) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        *[F.min(c).alias(f"lo_{c}") for c in _coordinates(spaces)],
        *[F.max(c).alias(f"hi_{c}") for c in _coordinates(spaces)],
    ]


def _as_box(df: DataFrame, spaces: Sequence[Space]) -> DataFrame:
    """Give single rows the bounding-box columns of a cell."""
    return df.withColumns({f"{e}_{c}": F.col(c) for c in _coordinates(spaces) for e in ("lo", "hi")})


def _side(space: Space) -> Column:
    return space.radius / F.lit(len(space.columns) ** 0.5) * F.lit(1 - 1e-9)


def split_groups(df: DataFrame, keys: Sequence[str], most: int) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows of groups of at most ``most`` rows, those of larger groups (None if there are none), and the number of rows."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    above = F.col("__n") > most
    total, larger = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.count(F.when(above, 1))).first()
    if not larger:
        return df, None, total
    same = [F.col(f"__own.{k}").eqNullSafe(F.col(f"__large.{k}")) for k in keys]
    on = reduce(Column.__and__, same)
    own, large = df.alias("__own"), sizes.filter(above).select(*keys).alias("__large")
    return own.join(large, on, "left_anti"), own.join(large, on, "left_semi"), total


def per_small_group(
    df: DataFrame, keys: Sequence[str], rows: int, columns: dict[str, Column], work: Callable[[dict[str, np.ndarray]], np.ndarray], label: str
) -> DataFrame:
    """Add the whole number ``label`` that ``work`` gives the rows of every group; ``columns`` are what it reads, as numbers.

    Groups are small, so one call gets many of them, in all about PART_ROWS of the ``rows``.
    """
    kept, read, by = df.columns, list(columns), list(keys)
    schema = T.StructType([*df.schema.fields, T.StructField(label, T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        values = {c: table.column(f"__{c}").to_numpy() for c in read}
        found = np.empty(len(table), dtype=np.int64)
        for at in rows_by_group(table, by):
            found[at] = work({c: v[at] for c, v in values.items()})
        return table.select(kept).append_column(label, pa.array(found))

    given = df.select(*kept, *[c.alias(f"__{name}") for name, c in columns.items()])
    return given.groupBy(part_of(keys, rows)).applyInArrow(run, schema)


def part_of(keys: Sequence[str], rows: int) -> Column:
    """Number of the part a group falls to; parts hold about PART_ROWS of the ``rows``."""
    return F.pmod(F.xxhash64(*keys), F.lit(rows // PART_ROWS + 1)).alias("__part")


def rows_by_group(table: pa.Table, keys: Sequence[str]) -> list[np.ndarray]:
    """Row numbers of every group of a part."""
    by = list(keys)
    group = table.select(by).to_pandas().groupby(by, sort=False, dropna=False).ngroup().to_numpy()
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
    return np.split(order, starts[1:])


def squared_distances(places: Sequence[np.ndarray]) -> np.ndarray:
    """Table of the squared distances between all rows of the coordinates ``places``."""
    gaps = [p[:, None] - p[None, :] for p in places]
    return reduce(lambda s, g: s + g * g, gaps[1:], gaps[0] * gaps[0])


def first_linked(linked: np.ndarray) -> np.ndarray:
    """Number of the first row that is linked to every row, directly or through others; ``linked`` is a symmetric table."""
    label = np.arange(len(linked))
    while True:
        lower = np.minimum(label, np.where(linked, label, len(label)).min(axis=1))
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def close_pairs(places: Sequence[np.ndarray], radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows within the radius of each other, as numbers ``a`` and ``b``, both ways, a row with itself too, and their squared distances.

    Rows are met in the order of their first coordinate, so only those of a strip as wide as the radius are measured.
    """
    known = np.flatnonzero(~reduce(np.logical_or, [np.isnan(p) for p in places]))
    order = known[np.argsort(places[0][known], kind="stable")]
    first, limit = places[0][order], radius * radius
    # A little wider than the radius, for the rounding of the squares.
    last = np.searchsorted(first, first + abs(radius) * (1 + 1e-9), "right") if not np.isnan(radius) else np.arange(len(first))
    met = last - np.arange(len(first))
    a = np.repeat(np.arange(len(first)), met)
    b = a + np.arange(len(a)) - np.repeat(np.cumsum(met) - met, met)
    a, b = order[a], order[b]
    gaps = [p[a] - p[b] for p in places]
    squared = reduce(lambda s, g: s + g * g, gaps[1:], gaps[0] * gaps[0])
    close = squared <= limit
    a, b, squared = a[close], b[close], squared[close]
    other = a != b
    return np.r_[a, b[other]], np.r_[b, a[other]], np.r_[squared, squared[other]]


def first_of_component(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row of the component of every one of ``count`` rows, of which ``a`` and ``b`` are linked."""
    label = np.arange(count)
    while True:
        lower = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(lower, label[a], least)
        np.minimum.at(lower, label[b], least)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def link_cells(df: DataFrame, keys: Sequence[str], id_column: str, spaces: Sequence[Space]) -> tuple[DataFrame, DataFrame]:
    """Rows with the number of their link cell (``node``) and its size (``cell_rows``), and the table of cells."""
    cell = {f"cell_{c}": cell_of(F.col(c), _side(s)) for s in spaces for c in s.columns}
    placed = df.withColumns(cell)
    nodes = placed.groupBy(*keys, *cell).agg(*cell_bounds(id_column, spaces))
    nodes = cut_lineage(nodes.withColumn("node", F.monotonically_increasing_id()))
    found = nodes.select(*keys, *cell, "node", F.col("n").alias("cell_rows"))
    rows = placed.join(found, [*keys, *cell]).drop(*cell)
    return rows, nodes


def _meet(boxes: DataFrame, nodes: DataFrame, keys: Sequence[str], space: Space, kept: Sequence[str]) -> DataFrame:
    """Boxes (suffix a) with the cells (suffix b) of the same keys that may lie within the radius."""
    bucket = 4 * space.radius
    probes = boxes
    for c in space.columns:
        low = F.col(f"lo_{c}") - space.radius - _side(space)
        probes = probes.withColumn(f"home_{c}", F.explode(cells_between(low, F.col(f"hi_{c}") + space.radius, bucket)))
    homed = nodes.withColumns({f"home_{c}": cell_of(F.col(f"lo_{c}"), bucket) for c in space.columns})
    homes = [f"home_{c}" for c in space.columns]
    return suffixed(probes, "_a", [*keys, *homes]).join(suffixed(homed, "_b", [*keys, *homes]), [*keys, *homes]).drop(*homes)


def _part_columns(spaces: Sequence[Space], level: int) -> dict[str, Column]:
    return {f"part_{c}": cell_of(F.col(c), s.radius / F.lit(float(SPLIT**level))) for s in spaces for c in s.columns}


def _parts(rows: DataFrame, spaces: Sequence[Space], level: int) -> DataFrame:
    """Bounding boxes of the level's parts of every cell, with the part of the level above each lies in."""
    above = {}
    if level > 1:
        above = {f"up_{c}": F.floor(F.col(f"part_{c}") / SPLIT).cast("long") for c in _coordinates(spaces)}
    parted = rows.withColumns(_part_columns(spaces, level)).withColumns(above)
    return parted.groupBy("node", *[f"part_{c}" for c in _coordinates(spaces)], *above).agg(*_bounds(spaces))


def _descend(open_pairs: DataFrame, parts: DataFrame, suffix: str, spaces: Sequence[Space], level: int) -> DataFrame:
    """Replace the cell part on one side of every open pair by its parts one level down."""
    on = [f"node_{suffix}"]
    down = suffixed(parts, f"_{suffix}")
    if level > 1:
        names = _coordinates(spaces)
        down = down.withColumnsRenamed({f"part_{c}_{suffix}": f"down_{c}_{suffix}" for c in names})
        down = down.withColumnsRenamed({f"up_{c}_{suffix}": f"part_{c}_{suffix}" for c in names})
        on += [f"part_{c}_{suffix}" for c in names]
        met = open_pairs.join(down, on).drop(*on[1:])
        return met.withColumnsRenamed({f"down_{c}_{suffix}": f"part_{c}_{suffix}" for c in names})
    return open_pairs.join(down, on)


def rows_within(
    probes: DataFrame, rows: DataFrame, nodes: DataFrame, keys: Sequence[str], probe_id: str, row_columns: Sequence[str], space: Space, whole_cells: bool
) -> tuple[DataFrame, DataFrame]:
    """Rows within the radius of every probe of the same keys.

    Returns (pairs, counted): ``pairs`` holds the keys, ``{probe_id}_a``, ``distance2`` and the ``row_columns`` suffixed
    ``_b``; with ``whole_cells`` parts that lie inside the radius as a whole are only counted, as (keys, probe, n), and
    left out of ``pairs``. Without it they are listed as well.
    """
    spaces = [space]
    xs = list(space.columns)
    identity = [*keys, f"{probe_id}_a"]
    start = _as_box(probes.select(*keys, probe_id, *xs), spaces)
    bare = [*identity, *[f"{c}_a" for c in xs], *[f"{e}_{c}_a" for c in xs for e in ("lo", "hi")]]
    met = _meet(start, nodes.select(*keys, "node", "n", *[f"{e}_{c}" for c in xs for e in ("lo", "hi")]), keys, space, bare)
    lookup = rows.select("node", *[F.col(c).alias(f"{c}_b") for c in dict.fromkeys([*row_columns, *xs])]).withColumnRenamed("node", "node_b")
    pairs_parts: list[DataFrame] = []
    counted_parts: list[DataFrame] = []

    def sort_out(met: DataFrame, source: DataFrame, on: list[str]) -> DataFrame:
        close = met.filter(_all_linked(spaces, _gap)).withColumn("inside", _all_linked(spaces, _reach))
        close = cut_lineage(close.withColumn("small", F.col("n_b") <= DIRECT_ROWS))
        direct = F.col("small") & ~F.col("inside")
        if whole_cells:
            counted_parts.append(close.filter("inside").select(*identity, F.col("n_b").alias("n")))
        else:
            direct = F.col("small") | F.col("inside")
        listed = close.filter(direct).select(*identity, *[f"{c}_a" for c in xs], *on).join(source, on)
        listed = listed.withColumn("distance2", _distance(xs)).filter(space.linked(F.col("distance2")))
        pairs_parts.append(listed.select(*identity, "distance2", *[f"{c}_b" for c in row_columns]))
        return close.filter("not inside and not small")

    open_pairs = sort_out(met, lookup, ["node_b"])
    level = 1
    tree = None
    while not open_pairs.isEmpty():
        if level > MAX_LEVELS:
            raise RuntimeError("coordinates are finer than the split allows")
        if tree is None:
            named = open_pairs.select(F.col("node_b").alias("node")).distinct()
            tree = cut_lineage(rows.join(named, "node", "left_semi"))
        part_names = [f"part_{c}_b" for c in xs]
        parts = _parts(tree, spaces, level)
        carried = [*bare, "node_b", *(part_names if level > 1 else [])]
        down = _descend(open_pairs.select(*carried), parts, "b", spaces, level)
        source = tree.withColumns(_part_columns(spaces, level))
        source = source.select(
            F.col("node").alias("node_b"),
            *[F.col(f"part_{c}").alias(f"part_{c}_b") for c in xs],
            *[F.col(c).alias(f"{c}_b") for c in dict.fromkeys([*row_columns, *xs])],
        )
        open_pairs = sort_out(down, source, ["node_b", *part_names])
        level += 1
    pairs = reduce(DataFrame.unionByName, pairs_parts)
    counted = reduce(DataFrame.unionByName, counted_parts) if counted_parts else None
    return pairs, counted


def nearest_within(
    probes: DataFrame, rows: DataFrame, nodes: DataFrame, keys: Sequence[str], probe_id: str, tie: str, row_columns: Sequence[str], space: Space
) -> DataFrame:
    """The nearest row of the same keys within the radius of every probe that has one.

    Result: the keys, ``{probe_id}_a``, ``distance2`` and ``tie`` and ``row_columns`` suffixed ``_b``. Of equally near rows
    the one with the smallest ``tie`` is taken. ``probe_id`` is unique within the keys.

    Every probe carries a bound, the far corner of the best cell it has met, and meets only cells that begin within it.
    Small cells are compared row by row, large ones are split and the bound shrinks with their parts, so a probe never
    lists the rows of its radius. Rows at one place count once when a cell is split, so a pile of copies is one row.
    """
    spaces = [space]
    xs = list(space.columns)
    identity = [*keys, f"{probe_id}_a"]
    corners = [f"{e}_{c}" for c in xs for e in ("lo", "hi")]
    bare = [*identity, *[f"{c}_a" for c in xs], *[f"{c}_a" for c in corners], "bound"]
    payload = list(dict.fromkeys([tie, *row_columns]))
    start = _as_box(probes.select(*keys, probe_id, *xs), spaces)
    met = _meet(start, nodes.select(*keys, "node", "n", *corners), keys, space, bare)
    found: list[DataFrame] = []

    def narrow(met: DataFrame, source: DataFrame, on: list[str]) -> DataFrame | None:
        """Settle the small cells; the large ones that may still hold the nearest row, or None."""
        nearest_end = F.min(_reach(xs)).over(W.partitionBy(*identity))
        close = met.filter(_all_linked(spaces, _gap)).withColumn("bound", F.least("bound", nearest_end))
        close = cut_lineage(close.filter(_gap(xs) <= F.col("bound")))
        small = F.col("n_b") <= DIRECT_ROWS
        listed = close.filter(small).select(*identity, *[f"{c}_a" for c in xs], *on).join(suffixed(source, "_b"), on)
        listed = listed.withColumn("distance2", _distance(xs)).filter(space.linked(F.col("distance2")))
        best = listed.groupBy(*identity).agg(F.min(F.struct("distance2", *[f"{c}_b" for c in payload])).alias("best"))
        found.append(cut_lineage(best))
        large = close.filter(~small)
        if large.isEmpty():
            return None
        told = found[-1].select(*identity, F.col("best.distance2").alias("settled"))
        large = large.join(told, identity, "left").withColumn("bound", F.least("bound", "settled")).drop("settled")
        return cut_lineage(large.filter(_gap(xs) <= F.col("bound")))

    source = rows.select("node", *xs, *payload)
    open_cells = narrow(met.withColumn("bound", F.lit(None).cast("double")), source, ["node_b"])
    places = None
    level = 1
    while open_cells is not None and not open_cells.isEmpty():
        if level > MAX_LEVELS:
            raise RuntimeError("coordinates are finer than the split allows")
        if places is None:
            named = open_cells.select(F.col("node_b").alias("node")).distinct()
            at_place = source.join(named, "node", "left_semi").groupBy("node", *xs).agg(F.min(F.struct(*payload)).alias("__first"))
            places = cut_lineage(at_place.select("node", *xs, "__first.*"))
        part = [f"part_{c}" for c in xs]
        carried = [*bare, "node_b", *([f"{p}_b" for p in part] if level > 1 else [])]
        down = _descend(open_cells.select(*carried), _parts(places, spaces, level), "b", spaces, level)
        open_cells = narrow(down, places.withColumns(_part_columns(spaces, level)), ["node_b", *[f"{p}_b" for p in part]])
        level += 1
    nearest = reduce(DataFrame.unionByName, found).groupBy(*identity).agg(F.min("best").alias("best"))
    return nearest.select(*identity, "best.*")


def kth_distances(
    probes: DataFrame, rows: DataFrame, nodes: DataFrame, keys: Sequence[str], probe_id: str, rank: int, space: Space
) -> DataFrame:
    """Squared distance (``distance2``) from every probe to its ``rank``-th nearest row of the same keys.

    Result: the keys, ``{probe_id}_a`` and ``distance2``; probes with fewer rows within the radius are left out. Copies count
    each. ``probe_id`` is unique within the keys. The bound of a probe is the far corner of the cells that hold ``rank``
    rows together, nearest far corner first; it shrinks as large cells are split, so no probe lists the rows of its radius.
    """
    spaces = [space]
    xs = list(space.columns)
    identity = [*keys, f"{probe_id}_a"]
    corners = [f"{e}_{c}" for c in xs for e in ("lo", "hi")]
    bare = [*identity, *[f"{c}_a" for c in xs], *[f"{c}_a" for c in corners], "bound"]
    start = _as_box(probes.select(*keys, probe_id, *xs), spaces)
    met = _meet(start, nodes.select(*keys, "node", "n", *corners), keys, space, bare)
    found: list[DataFrame] = []

    def full_at(df: DataFrame, count: str, distance: str) -> DataFrame:
        """The first distance at which the rows of a probe number ``rank``."""
        so_far = F.sum(count).over(W.partitionBy(*identity).orderBy(distance))
        reached = df.withColumn("__so_far", so_far).filter(F.col("__so_far") >= rank)
        return reached.groupBy(*identity).agg(F.min(distance).alias("__full"))

    def narrow(met: DataFrame, source: DataFrame, on: list[str]) -> DataFrame | None:
        close = met.filter(_all_linked(spaces, _gap)).withColumn("__far", _reach(xs))
        so_far = F.sum("n_b").over(W.partitionBy(*identity).orderBy("__far"))
        full = F.min(F.when(F.col("__so_far") >= rank, F.col("__far"))).over(W.partitionBy(*identity))
        close = close.withColumn("__so_far", so_far).withColumn("bound", F.least("bound", full)).drop("__so_far", "__far")
        close = cut_lineage(close.filter(F.col("bound").isNull() | (_gap(xs) <= F.col("bound"))))
        small = F.col("n_b") <= DIRECT_ROWS
        listed = close.filter(small).select(*identity, *[f"{c}_a" for c in xs], "bound", *on).join(suffixed(source, "_b"), on)
        listed = listed.withColumn("distance2", _distance(xs)).filter(space.linked(F.col("distance2")))
        listed = listed.filter(F.col("bound").isNull() | (F.col("distance2") <= F.col("bound")))
        found.append(cut_lineage(listed.groupBy(*identity, "distance2").agg(F.sum("copies_b").alias("copies"))))
        large = close.filter(~small)
        if large.isEmpty():
            return None
        told = full_at(found[-1], "copies", "distance2")
        large = large.join(told, identity, "left").withColumn("bound", F.least("bound", "__full")).drop("__full")
        return cut_lineage(large.filter(F.col("bound").isNull() | (_gap(xs) <= F.col("bound"))))

    source = rows.select("node", *xs, F.lit(1).alias("copies"))
    open_cells = narrow(met.withColumn("bound", F.lit(None).cast("double")), source, ["node_b"])
    places = None
    level = 1
    while open_cells is not None and not open_cells.isEmpty():
        if level > MAX_LEVELS:
            raise RuntimeError("coordinates are finer than the split allows")
        if places is None:
            named = open_cells.select(F.col("node_b").alias("node")).distinct()
            places = cut_lineage(rows.join(named, "node", "left_semi").groupBy("node", *xs).agg(F.count(F.lit(1)).alias("copies")))
        part = [f"part_{c}" for c in xs]
        carried = [*bare, "node_b", *([f"{p}_b" for p in part] if level > 1 else [])]
        # A part has as many rows as are compared, its places; the copies at them count towards the rank only when listed.
        down = _descend(open_cells.select(*carried), _parts(places, spaces, level), "b", spaces, level)
        open_cells = narrow(down, places.withColumns(_part_columns(spaces, level)), ["node_b", *[f"{p}_b" for p in part]])
        level += 1
    together = reduce(DataFrame.unionByName, found).groupBy(*identity, "distance2").agg(F.sum("copies").alias("copies"))
    return full_at(together, "copies", "distance2").withColumnRenamed("__full", "distance2")


def closest_between(rows: DataFrame, keys: Sequence[str], group: str, floor: str, space: Space) -> DataFrame:
    """Smallest distance within the radius between every two groups of the same keys: ``src``, ``dst``, ``length2``.

    The squared distance of two rows is at least the ``floor`` of either (a squared length that changes no faster than place
    does). ``src`` and ``dst`` are groups, the smaller one first. Rows of a group that share a link cell are one node; pairs of nodes
    carry a bound, the far corner of their best pair of parts, and parts that begin beyond it are not looked into.
    """
    spaces = [space]
    xs = list(space.columns)
    corners = [f"{e}_{c}" for c in xs for e in ("lo", "hi")]
    cell = {f"cell_{c}": cell_of(F.col(c), _side(space)) for c in xs}

    def boxes(df: DataFrame, by: Sequence[str]) -> DataFrame:
        return df.groupBy(*by).agg(*_bounds(spaces), F.min(floor).alias("lo_floor"), F.max(floor).alias("hi_floor"))

    placed = rows.select(*keys, group, floor, *xs).withColumns(cell)
    nodes = cut_lineage(boxes(placed, [*keys, group, *cell]).withColumn("node", F.monotonically_increasing_id()))
    members = placed.join(nodes.select(*keys, group, *cell, "node"), [*keys, group, *cell]).select("node", floor, *xs)
    about = ["n", *corners, "lo_floor", "hi_floor"]
    box = nodes.select(*keys, "node", group, *about)
    met = _meet(box, box, keys, space, [])
    met = met.filter((F.col("node_a") < F.col("node_b")) & (F.col(f"{group}_a") != F.col(f"{group}_b")))
    pair = [f"{c}_{s}" for c in ("node", group) for s in "ab"]
    found: list[DataFrame] = []
    low = F.greatest(_gap(xs), "lo_floor_a", "lo_floor_b")
    high = F.greatest(_reach(xs), "hi_floor_a", "hi_floor_b")

    def narrow(met: DataFrame, source: DataFrame, part: list[str]) -> DataFrame | None:
        least = met.withColumns({"low": low, "high": high}).filter(space.linked(F.col("low")))
        best_end = F.min("high").over(W.partitionBy("node_a", "node_b"))
        near = cut_lineage(least.withColumn("bound", F.least("bound", best_end)).filter(F.col("low") <= F.col("bound")))
        known = F.col("low") == F.col("high")
        small = F.col("n_a") * F.col("n_b") <= DIRECT_PAIRS
        here = lambda s: [f"{p}_{s}" for p in ["node", *part]]
        side = lambda s: source.select(*[F.col(c).alias(f"{c}_{s}") for c in ["node", *part, floor, *xs]])
        compared = near.filter(~known & small).select(*dict.fromkeys([*pair, *here("a"), *here("b")]))
        compared = compared.join(side("a"), here("a")).join(side("b"), here("b"))
        compared = compared.withColumn("length2", F.greatest(_distance(xs), f"{floor}_a", f"{floor}_b"))
        settled = near.filter(known).select(*pair, F.col("low").alias("length2")).unionByName(compared.select(*pair, "length2"))
        settled = settled.filter(space.linked(F.col("length2"))).groupBy(*pair).agg(F.min("length2").alias("length2"))
        found.append(cut_lineage(settled))
        large = near.filter(~known & ~small)
        if large.isEmpty():
            return None
        told = found[-1].select("node_a", "node_b", "length2")
        large = large.join(told, ["node_a", "node_b"], "left").withColumn("bound", F.least("bound", "length2")).drop("length2")
        return cut_lineage(large.filter(F.col("low") <= F.col("bound")))

    open_pairs = narrow(met.withColumn("bound", F.lit(None).cast("double")), members, [])
    tree = None
    level = 1
    part = [f"part_{c}" for c in xs]
    while open_pairs is not None and not open_pairs.isEmpty():
        if level > MAX_LEVELS:
            raise RuntimeError("coordinates are finer than the split allows")
        if tree is None:
            named = open_pairs.select(F.explode(F.array("node_a", "node_b")).alias("node")).distinct()
            tree = cut_lineage(members.join(named, "node", "left_semi").distinct())
        above = {f"up_{c}": F.floor(F.col(f"part_{c}") / SPLIT).cast("long") for c in xs} if level > 1 else {}
        parted = tree.withColumns(_part_columns(spaces, level)).withColumns(above)
        parts = cut_lineage(boxes(parted, ["node", *part, *above]))
        carried = [f"{p}_{s}" for p in part for s in "ab"] if level > 1 else []
        down = _descend(open_pairs.select(*pair, "bound", *carried), parts, "a", spaces, level)
        down = _descend(down, parts, "b", spaces, level)
        open_pairs = narrow(down, parted.drop(*above), part)
        level += 1
    ends = {"src": F.least(f"{group}_a", f"{group}_b"), "dst": F.greatest(f"{group}_a", f"{group}_b")}
    return reduce(DataFrame.unionByName, found).withColumns(ends).groupBy("src", "dst").agg(F.min("length2").alias("length2"))


def near_components(df: DataFrame, keys: Sequence[str], id_column: str, spaces: Sequence[Space], label: str = "component") -> DataFrame:
    """Label rows of the same keys that are linked directly or through others with the smallest id among them.

    Small groups are labelled as a whole. In larger ones a link cell is one node, whatever the number of its rows, and two cells are
    joined when one pair of their rows is linked. Rows without a key or place are left out.
    """
    small, large, total = split_groups(df, keys, WHOLE_GROUP)
    radii = {f"radius{i}": s.radius.cast("double") for i, s in enumerate(spaces)}
    needed = [*keys, id_column, *_coordinates(spaces)]
    sides = [(s.columns, s.strict) for s in spaces]

    def work(group: dict[str, np.ndarray]) -> np.ndarray:
        order = np.argsort(group["id"], kind="stable")
        linked = np.ones((len(order), len(order)), dtype=bool)
        for i, (names, strict) in enumerate(sides):
            squared, limit = squared_distances([group[c][order] for c in names]), group[f"radius{i}"][0] ** 2
            linked &= squared < limit if strict else squared <= limit
        found = np.empty(len(order), dtype=np.int64)
        found[order] = group["id"][order][first_linked(linked)]
        return found

    complete = small.dropna(subset=needed).filter(reduce(Column.__and__, [r.isNotNull() for r in radii.values()]))
    columns = {"id": F.col(id_column).cast("long")} | {c: F.col(c).cast("double") for c in _coordinates(spaces)} | radii
    whole = per_small_group(complete, keys, total, columns, work, label)
    if large is None:
        return whole
    rows, nodes = link_cells(large, keys, id_column, spaces)
    return whole.unionByName(components_of_cells(rows, nodes, keys, spaces, label).drop("node", "cell_rows"))


def components_of_cells(rows: DataFrame, nodes: DataFrame, keys: Sequence[str], spaces: Sequence[Space], label: str) -> DataFrame:
    """The same for rows and cells that ``link_cells`` made before."""
    edges = _cell_edges(rows, nodes, keys, spaces)
    found = connected_components(nodes.select(F.col("node").alias("id")), edges)
    found = found.select(F.col("id").alias("node"), F.col("component").alias("__root"))
    named = nodes.select("node", "first_id").join(found, "node")
    smallest = named.groupBy("__root").agg(F.min("first_id").alias(label))
    labels = named.join(smallest, "__root").select("node", label)
    return rows.join(labels, "node")


def _cell_edges(rows: DataFrame, nodes: DataFrame, keys: Sequence[str], spaces: Sequence[Space]) -> DataFrame:
    names = _coordinates(spaces)
    box = ["node", "n", *[f"{e}_{c}" for c in names for e in ("lo", "hi")]]
    cells = nodes.select(*keys, *box)
    ends = lambda df: df.select(F.col("node_a").alias("src"), F.col("node_b").alias("dst")).distinct()
    edges: list[DataFrame] = []

    def sort_out(met: DataFrame, source: DataFrame, part: list[str]) -> DataFrame:
        near = met.filter(_all_linked(spaces, _gap)).withColumn("sure", _all_linked(spaces, _reach))
        near = cut_lineage(near.withColumn("small", F.col("n_a") * F.col("n_b") <= DIRECT_PAIRS))
        sure = ends(near.filter("sure"))
        edges.append(sure)
        # Cells joined by one of their parts need no further look.
        joined = sure.select(F.col("src").alias("node_a"), F.col("dst").alias("node_b"))
        rest = near.filter("not sure").join(joined, ["node_a", "node_b"], "left_anti")
        here = lambda s: [f"{p}_{s}" for p in ["node", *part]]
        side = lambda s: source.select(*[F.col(c).alias(f"{c}_{s}") for c in ["node", *part, *names]])
        compared = rest.filter("small").select(*keys, *here("a"), *here("b"))
        compared = compared.join(side("a"), here("a")).join(side("b"), here("b"))
        edges.append(ends(compared.filter(_all_linked(spaces, _distance))))
        return rest.filter("not small")

    met = _meet(cells, cells, keys, spaces[0], box).filter("node_a < node_b")
    open_pairs = sort_out(met, rows, [])
    level = 1
    tree = None
    while not open_pairs.isEmpty():
        if level > MAX_LEVELS:
            raise RuntimeError("coordinates are finer than the split allows")
        if tree is None:
            named = open_pairs.select(F.explode(F.array("node_a", "node_b")).alias("node")).distinct()
            tree = cut_lineage(rows.join(named, "node", "left_semi"))
        parts = cut_lineage(_parts(tree, spaces, level))
        part = [f"part_{c}" for c in names]
        above = [f"{p}_{s}" for p in part for s in "ab"] if level > 1 else []
        down = _descend(open_pairs.select(*keys, "node_a", "node_b", *above), parts, "a", spaces, level)
        down = _descend(down, parts, "b", spaces, level)
        open_pairs = sort_out(down, tree.withColumns(_part_columns(spaces, level)), part)
        level += 1
    return reduce(DataFrame.unionByName, edges)
