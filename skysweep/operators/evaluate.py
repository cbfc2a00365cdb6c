"""Overlap pairs, one-to-one matching and detection quality."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skysweep.functions.iou import add_iou_cylinder, extents, iou_aabb, iou_major
from skysweep.functions.ranks import pivot_percentiles, wide_percentiles
from skysweep.operators import boxfit, cluster
from skysweep.operators.graph import connected_components
from skysweep.operators.grid import overlapping_pairs
from skysweep.operators.near import WHOLE_GROUP, first_of_component, part_of
from skysweep.schema import CLASS_NAMES, FRAME
from skysweep.session import cut_lineage

SHAPE = [f"bbox_center_{a}" for a in "xyz"] + ["bbox_width", "bbox_length", "bbox_height"]
MEASURES = {"aabb": iou_aabb, "major": iou_major}
# Most cells of a table of gains that one task solves (32 MB); beyond it, pairs of a block, units of iou and cut of the
# step of an auction.
MATRIX = 4_000_000
BLOCK = 2_000_000
GAIN_UNITS = 1_000_000
# Pairs of small components that one call solves, one component after the other: a call costs far more than a few boxes.
PART = 20_000
STEP_CUT = 4
# Pairs of boxes of small groups that are measured at a time, cells of the tables of gains that are solved side by side, and
# the widest such table.
MEASURED = 500_000
SIDE_BY_SIDE = 1_000_000
WIDEST = 64


def _half(measure: str) -> tuple[Column, Column]:
    """Half extents of the footprint a measure looks at."""
    if measure == "cylinder":
        radius = F.greatest("bbox_width", "bbox_length") / 2
        return radius, radius
    size = extents("l_major" if measure == "major" else "wl_axis")
    return size["x"] / 2, size["y"] / 2


def iou_pairs(left: DataFrame, right: DataFrame, measure: str = "aabb", keys: Sequence[str] = FRAME, least: float = 0.0) -> DataFrame:
    """Overlapping pairs of two box tables within a frame with iou above 0 and at least ``least``.

    Result: box_id_a, box_id_b, keys and iou. The iou of two boxes is at most that of their sides along one axis, so centres
    lie apart by at most (1 - least) / (1 + least) of the half sides; the search uses footprints shrunk by that.
    """
    shrink = (1 - least) / (1 + least) * (1 + 1e-9) if measure != "cylinder" else 1.0
    half = tuple(h * F.lit(shrink) for h in _half(measure))
    columns = [*keys, "box_id", *SHAPE]
    pairs = overlapping_pairs(left.select(*columns), right.select(*columns), keys, half, half)
    measured = add_iou_cylinder(pairs) if measure == "cylinder" else pairs.withColumn("iou", MEASURES[measure]())
    return measured.filter((F.col("iou") > 0) & (F.col("iou") >= F.lit(float(least)))).select(*keys, "box_id_a", "box_id_b", "iou")


# --- one-to-one assignment ---------------------------------------------------------------------------------------


def _assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of the assignment with the largest total gain, by shortest augmenting paths."""
    flipped = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flipped else gain)
    rows, cols = cost.shape
    row_price, col_price = np.zeros(rows), np.zeros(cols)
    owner = np.full(cols, -1)
    for start in range(rows):
        distance, back, done = np.full(cols, np.inf), np.full(cols, -1), np.zeros(cols, dtype=bool)
        row, column, reached = start, -1, 0.0
        while True:
            offered = reached + cost[row] - row_price[row] - col_price
            better = ~done & (offered < distance)
            distance[better], back[better] = offered[better], column
            column = int(np.where(done, np.inf, distance).argmin())
            reached = distance[column]
            done[column] = True
            if owner[column] < 0:
                break
            row = int(owner[column])
        settled = done & (np.arange(cols) != column)
        row_price[start] += reached
        row_price[owner[settled]] += reached - distance[settled]
        col_price[settled] -= reached - distance[settled]
        while column >= 0:
            previous = int(back[column])
            owner[column] = start if previous < 0 else owner[previous]
            column = previous
    found = [(int(owner[c]), c) for c in range(cols) if owner[c] >= 0]
    return [(c, r) for r, c in found] if flipped else found


def _solved(pdf: pd.DataFrame) -> pd.DataFrame:
    """The pairs of the best assignment of every component of a part, one component after the other."""
    pdf = pdf.sort_values("component", kind="stable")
    component, iou = pdf["component"].to_numpy(), pdf["iou"].to_numpy()
    left, right = pdf["box_id_a"].to_numpy(), pdf["box_id_b"].to_numpy()
    ends = np.append(np.flatnonzero(component[1:] != component[:-1]) + 1, len(pdf))
    kept: list[int] = []
    start = 0
    for end in ends:
        a, row = np.unique(left[start:end], return_inverse=True)
        b, column = np.unique(right[start:end], return_inverse=True)
        gain, at = np.zeros((len(a), len(b))), np.full((len(a), len(b)), -1)
        gain[row, column], at[row, column] = iou[start:end], np.arange(start, end)
        # Boxes that share no pair may be put together at no gain.
        kept += [int(at[r, c]) for r, c in _assign(gain) if at[r, c] >= 0]
        start = end
    return pdf.iloc[kept]


def _ends() -> tuple[Column, Column]:
    """Boxes of the left side as even, of the right side as odd numbers of one graph."""
    return F.col("box_id_a") * 2, F.col("box_id_b") * 2 + 1


def assign_pairs(pairs: DataFrame, keys: Sequence[str], matrix: int = MATRIX, block: int = BLOCK) -> DataFrame:
    """The pairs of a one-to-one assignment of largest total iou.

    The overlap graph falls into components that share no box, and an assignment is best when it is best in each. The boxes
    of a component meet in one task if its table of gains has at most ``matrix`` cells, many small components in one call; larger ones are auctioned in blocks of
    about ``block`` pairs, with ious rounded to a millionth.
    """
    pairs = cut_lineage(pairs)
    left, right = _ends()
    edges = pairs.select(left.alias("src"), right.alias("dst"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    components = cut_lineage(connected_components(nodes, edges))
    is_left = F.col("id") % 2 == 0
    sizes = components.groupBy("component").agg(F.count_if(is_left).alias("n_a"), F.count_if(~is_left).alias("n_b"))
    tagged = pairs.withColumn("id", left).join(components, "id").drop("id")
    sized = cut_lineage(tagged.join(sizes.withColumn("cells", F.col("n_a") * F.col("n_b")), "component"))
    columns = [*keys, "box_id_a", "box_id_b", "iou"]
    schema = sized.select(*columns).schema
    solve = lambda pdf: _solved(pdf)[columns]

    # A lone pair is its own assignment and stays out of the grouped step.
    single, small, large = F.col("cells") == 1, F.col("cells") <= matrix, F.col("cells") > matrix
    several = sized.filter(~single & small)
    part = F.pmod(F.xxhash64("component"), F.lit(max(1, -(-several.count() // PART))))
    solved = several.groupBy(part).applyInPandas(solve, schema)
    found = sized.filter(single).select(*columns).unionByName(solved)
    crowded = sized.filter(~single & large)
    if crowded.isEmpty():
        return found
    boxes = crowded.agg(F.max(F.col("n_a") + F.col("n_b"))).first()[0]
    return found.unionByName(_auction(crowded.select("component", *columns), boxes, block).select(*columns))


def _bids_of_block(step: int):
    """Bids of the unplaced bidders of one block, one after the other, until none of the block is without a place."""

    def bid(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bidder", kind="stable")
        bidders, starts = np.unique(pdf["bidder"], return_index=True)
        items, first, item_of = np.unique(pdf["item"], return_index=True, return_inverse=True)
        ends = np.append(starts[1:], len(pdf))
        gain = pdf["gain"].to_numpy(np.int64)
        price = pdf["price"].to_numpy(np.int64)[first].copy()
        # Owners of other blocks, or none (-1), stand in no place of this block.
        named = pdf["owner"].fillna(-1).to_numpy(np.int64)[first]
        at = np.minimum(np.searchsorted(bidders, named), len(bidders) - 1)
        owner = np.where(bidders[at] == named, at, -1)
        waiting = sorted(set(range(len(bidders))) - set(owner[owner >= 0].tolist()), reverse=True)
        touched = np.zeros(len(items), dtype=bool)
        while waiting:
            who = waiting.pop()
            wished = item_of[starts[who] : ends[who]]
            value = gain[starts[who] : ends[who]] - price[wished]
            best = int(value.argmax())
            most, value[best] = value[best], np.iinfo(np.int64).min
            what = wished[best]
            price[what] += most - value.max() + step
            if owner[what] >= 0:
                waiting.append(int(owner[what]))
            owner[what], touched[what] = who, True
        return pd.DataFrame({"item": items[touched], "price": price[touched], "bidder": bidders[owner[touched]]})

    return bid


def _auction(pairs: DataFrame, boxes: int, block: int) -> DataFrame:
    """Pairs of largest total iou, in units of 1 / GAIN_UNITS, for components of at most ``boxes`` boxes, by auction rounds.

    Every box bids once and is bid for once: a box of the left side for its partners, a box of the right side, at no gain,
    for its own, and each for itself, which means to stay alone. So all can be placed, and prices may be kept while the
    step of the bids shrinks. Gains are whole numbers times more than the boxes of a component, so what the
    last step, one, leaves is the best.

    The bidders of a component fall into blocks of about ``block`` pairs. A block bids on its own at the prices of the round's
    start; the highest bid for an item then takes it, and who lost a place bids again in the next round. Bids of other blocks only
    raise the prices of what a bidder passed over, so its choice stays right. No task sees more than a block.
    """
    scale = boxes + 1
    left, right = _ends()
    units = F.round(F.col("iou") * GAIN_UNITS).cast("long") * scale
    real = pairs.select("component", left.alias("bidder"), right.alias("item"), units.alias("gain"))
    nothing = F.lit(0).cast("long").alias("gain")
    ends = real.select("component", F.explode(F.array("bidder", "item")).alias("id")).distinct()
    alone = ends.select("component", F.col("id").alias("bidder"), F.col("id").alias("item"), nothing)
    back = real.select("component", F.col("item").alias("bidder"), F.col("bidder").alias("item"), nothing)
    wishes = real.unionByName(back).unionByName(alone)
    blocks = pairs.groupBy("component").agg(F.ceil(F.count(F.lit(1)) * 2 / F.lit(block)).alias("blocks"))
    wishes = wishes.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("bidder"), "blocks")).drop("blocks")
    wishes = cut_lineage(wishes)
    homes = cut_lineage(wishes.select("component", "block", "bidder").distinct())
    no_owner = F.lit(None).cast("long")
    items = cut_lineage(ends.select(F.col("id").alias("item"), F.lit(0).cast("long").alias("price"), no_owner.alias("owner")))
    step = GAIN_UNITS * scale // 4
    while True:
        # As many items as bidders: one item without an owner is one bidder without a place.
        while not items.filter("owner is null").isEmpty():
            placed = items.filter("owner is not null").select(F.col("owner").alias("bidder"))
            calls = homes.join(placed, "bidder", "left_anti").select("component", "block").distinct()
            told = wishes.join(calls, ["component", "block"], "left_semi").join(items, "item")
            bids = told.groupBy("component", "block").applyInPandas(_bids_of_block(step), "item long, price long, bidder long")
            top = bids.groupBy("item").agg(F.max(F.struct("price", "bidder")).alias("top"))
            items = cut_lineage(items.join(top, "item", "left").select(
                "item", F.coalesce("top.price", "price").alias("price"), F.coalesce("top.bidder", "owner").alias("owner")
            ))
        if step == 1:
            break
        step = max(1, step // STEP_CUT)
        items = items.withColumn("owner", no_owner)
    won = items.select(F.col("owner").alias("__l"), F.col("item").alias("__r"))
    return pairs.join(won, (left == F.col("__l")) & (right == F.col("__r")), "left_semi")


# --- assignment in small groups ----------------------------------------------------------------------------------


def _assign_many(gains: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """``_assign`` of many tables side by side: the row of every column, or -1.

    Tables have no more rows than columns and are padded to one shape; ``rows`` and ``columns`` are their own sizes.
    """
    count, _, wide = gains.shape
    cost = np.where(np.arange(wide) < columns[:, None, None], -gains, np.inf)
    row_price, col_price = np.zeros(gains.shape[:2]), np.zeros((count, wide))
    owner = np.full((count, wide), -1)
    for start in range(int(rows.max())):
        table = np.flatnonzero(rows > start)
        distance, back = np.full((len(table), wide), np.inf), np.full((len(table), wide), -1)
        done = np.zeros((len(table), wide), dtype=bool)
        row, column, reached = np.full(len(table), start), np.full(len(table), -1), np.zeros(len(table))
        live = np.arange(len(table))
        while len(live):
            at, of = table[live], row[live]
            offered = reached[live, None] + cost[at, of] - row_price[at, of][:, None] - col_price[at]
            far, closed = distance[live], done[live]
            better = ~closed & (offered < far)
            far = np.where(better, offered, far)
            distance[live], back[live] = far, np.where(better, column[live, None], back[live])
            nearest = np.where(closed, np.inf, far).argmin(axis=1)
            column[live], reached[live] = nearest, far[np.arange(len(live)), nearest]
            done[live, nearest] = True
            row[live] = owner[at, nearest]
            live = live[row[live] >= 0]
        settled = done & (np.arange(wide) != column[:, None])
        which, where = np.nonzero(settled)
        row_price[table, start] += reached
        less = reached[which] - distance[which, where]
        row_price[table[which], owner[table[which], where]] += less
        col_price[table[which], where] -= less
        live = np.arange(len(table))
        while len(live):
            previous = back[live, column[live]]
            owner[table[live], column[live]] = np.where(previous < 0, start, owner[table[live], previous])
            column[live] = previous
            live = live[previous >= 0]
    return owner


def _best_of(a: np.ndarray, b: np.ndarray, iou: np.ndarray, nodes: int) -> np.ndarray:
    """Numbers of the pairs of the best assignment of every component; ``a`` and ``b`` are nodes, in the order of groups, sides and ids."""
    label = first_of_component(nodes, a, b)
    left, right = np.unique(a), np.unique(b)
    order_a, order_b = left[np.argsort(label[left], kind="stable")], right[np.argsort(label[right], kind="stable")]
    roots, first_a, n_a = np.unique(label[order_a], return_index=True, return_counts=True)
    _, first_b, n_b = np.unique(label[order_b], return_index=True, return_counts=True)
    component, place = np.searchsorted(roots, label[a]), np.empty(nodes, dtype=np.int64)
    for order, first, n in ((order_a, first_a, n_a), (order_b, first_b, n_b)):
        place[order] = np.arange(len(order)) - np.repeat(first, n)
    # A lone pair is its own assignment.
    kept = [np.flatnonzero((n_a * n_b)[component] == 1)]
    short, long = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    flipped = (n_a > n_b)[component]
    row, column = np.where(flipped, place[b], place[a]), np.where(flipped, place[a], place[b])
    by_component = np.argsort(component, kind="stable")
    begins = np.searchsorted(component[by_component], np.arange(len(roots) + 1))
    waiting = np.flatnonzero((long > 1) & (long <= WIDEST))
    waiting = waiting[np.argsort(long[waiting], kind="stable")]
    while len(waiting):
        # Tables of about one size are solved together.
        limit = max(4, long[waiting[0]] * 5 // 4)
        some = waiting[long[waiting] <= limit][: max(1, SIDE_BY_SIDE // (limit * limit))]
        waiting = waiting[len(some) :]
        pairs = by_component[np.concatenate([np.arange(begins[c], begins[c + 1]) for c in some])]
        table = np.repeat(np.arange(len(some)), begins[some + 1] - begins[some])
        shape = (len(some), int(short[some].max()), int(long[some].max()))
        gain, at = np.zeros(shape), np.full(shape, -1)
        gain[table, row[pairs], column[pairs]], at[table, row[pairs], column[pairs]] = iou[pairs], pairs
        owner = _assign_many(gain, short[some], long[some])
        which, where = np.nonzero(owner >= 0)
        found = at[which, owner[which, where], where]
        kept.append(found[found >= 0])
    for c in np.flatnonzero(long > WIDEST):
        pairs = by_component[begins[c] : begins[c + 1]]
        gain, at = np.zeros((n_a[c], n_b[c])), np.full((n_a[c], n_b[c]), -1)
        gain[place[a[pairs]], place[b[pairs]]], at[place[a[pairs]], place[b[pairs]]] = iou[pairs], pairs
        kept.append(np.array([at[r, k] for r, k in _assign(gain) if at[r, k] >= 0], dtype=np.int64))
    return np.concatenate(kept)


def _iou_major(box: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``iou_major`` of rows ``a`` and ``b``, in the same order of steps."""
    shared = np.ones(len(a))
    for axis in "xyz":
        centre, half = box[f"bbox_center_{axis}"], box[axis] / 2
        low, high = centre - half, centre + half
        shared = shared * np.maximum(np.minimum(high[a], high[b]) - np.maximum(low[a], low[b]), 0.0)
    volume = box["x"] * box["y"] * box["z"]
    union = volume[a] + volume[b] - shared
    return np.divide(shared, union, out=np.zeros(len(a)), where=union > 0)


def _matched_in(keys: Sequence[str]):
    """Best assignment of every group of a part."""
    by = list(keys)

    def match(table: pa.Table) -> pa.Table:
        box = {c: table.column(c).to_numpy() for c in SHAPE}
        box |= {"x": np.maximum(box["bbox_width"], box["bbox_length"]), "y": np.minimum(box["bbox_width"], box["bbox_length"]), "z": box["bbox_height"]}
        side, ids = table.column("__side").to_numpy(), table.column("box_id").to_numpy()
        group = table.select(by).to_pandas().groupby(by, sort=False).ngroup().to_numpy()
        # Rows of a box that comes more than once are one node.
        order = np.lexsort((ids, side, group))
        changes = [c[order][1:] != c[order][:-1] for c in (group, side, ids)]
        node = np.empty(len(order), dtype=np.int64)
        node[order] = np.cumsum(np.r_[False, reduce(np.logical_or, changes)])
        ends = np.searchsorted(group[order], np.arange(group.max() + 2))
        middle = ends[:-1] + np.bincount(group[side == 0], minlength=len(ends) - 1)
        n_a, n_b = middle - ends[:-1], ends[1:] - middle
        passed = np.cumsum(n_a * n_b) // MEASURED
        found: list[tuple[np.ndarray, ...]] = []
        for some in np.split(np.arange(len(n_a)), np.flatnonzero(np.diff(passed)) + 1):
            pairs = n_a[some] * n_b[some]
            of = np.repeat(some, pairs)
            number = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            across = np.maximum(n_b[of], 1)
            a, b = order[ends[of] + number // across], order[middle[of] + number % across]
            iou = _iou_major(box, a, b)
            a, b, iou = a[iou > 0], b[iou > 0], iou[iou > 0]
            if len(a):
                least = min(node[a].min(), node[b].min())
                best = _best_of(node[a] - least, node[b] - least, iou, int(max(node[a].max(), node[b].max()) - least) + 1)
                found.append((a[best], b[best], iou[best]))
        a, b, iou = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, dtype=np.int64),) * 2 + (np.empty(0),)
        named = table.select(by).take(pa.array(a))
        for name, values in (("box_id_a", ids[a]), ("box_id_b", ids[b]), ("iou", iou)):
            named = named.append_column(name, pa.array(values))
        return named

    return match


def best_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], most: int = WHOLE_GROUP) -> DataFrame:
    """The pairs of ``assign_pairs`` of all pairs of ``iou_pairs`` by the measure ``major``.

    Groups of at most ``most`` boxes are measured and assigned as a whole, many to a call, and leave no table of pairs. Larger
    groups, groups with a value that is missing or not finite, and groups that share a box id go over the table of pairs.
    """
    keys = list(keys)
    columns = [*keys, "box_id", *SHAPE]
    boxes = [df.select(*columns) for df in (left, right)]
    by_pairs = lambda a, b: assign_pairs(iou_pairs(a, b, "major", keys), keys)
    types = [dict(df.dtypes) for df in boxes]
    if any(t[c] != "double" for t in types for c in SHAPE) or any(t["box_id"] != "bigint" for t in types) or types[0] != types[1]:
        return by_pairs(*boxes)
    sides = reduce(DataFrame.unionByName, [df.withColumn("__side", F.lit(i)) for i, df in enumerate(boxes)])
    # Rows without a key meet no other.
    sides = sides.dropna(subset=keys)
    odd = reduce(Column.__or__, [~F.coalesce(F.abs(c) < float("inf"), F.lit(False)) for c in SHAPE], F.col("box_id").isNull())
    sizes = sides.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.max(odd).alias("__odd"))
    several = sizes.filter(F.col("__odd") | (F.col("__n") > most)).select(*keys)
    group = F.struct(*keys)
    shared = sides.groupBy("__side", "box_id").agg(F.min(group).alias("__low"), F.max(group).alias("__high")).filter("__low <> __high").select("__side", "box_id")
    rows, crowded = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.count_if(F.col("__odd") | (F.col("__n") > most))).first()
    twice = not shared.isEmpty()
    rest = None
    if crowded or twice:
        if twice:
            several = several.unionByName(sides.join(shared, ["__side", "box_id"], "left_semi").select(*keys))
        several = cut_lineage(several.distinct())
        rest = [df.join(several, keys, "left_semi") for df in boxes]
        sides = sides.join(several, keys, "left_anti")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in sides.select(*keys).schema), "box_id_a long, box_id_b long, iou double"])
    whole = sides.groupBy(part_of(keys, rows)).applyInArrow(_matched_in(keys), schema)
    return whole if rest is None else whole.unionByName(by_pairs(*rest))


def match_boxes(detections: DataFrame, truth: DataFrame, threshold: float = 0.3, keys: Sequence[str] = FRAME, all_frames: bool = True) -> DataFrame:
    """tp, fp, fn and mean iou per key from the assignment of largest total iou.

    With ``all_frames=False`` only keys with detections are counted.
    """
    keys = list(keys)
    matched = best_pairs(detections, truth, keys).filter(F.col("iou") >= F.lit(threshold))
    hits = matched.groupBy(*keys).agg(F.count(F.lit(1)).alias("tp"), F.avg("iou").alias("mean_iou"))
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    how = "full_outer" if all_frames else "left"
    both = count(detections, "n_det").join(count(truth, "n_gt"), keys, how).join(hits, keys, "left")
    both = both.fillna(0, ["n_det", "n_gt", "tp"]).fillna(0.0, ["mean_iou"])
    return both.select(*keys, "tp", (F.col("n_det") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"), "mean_iou")


def scores(matched: DataFrame, by: Sequence[str]) -> DataFrame:
    """Precision, recall and F1 from summed counts; divisors have a floor."""
    summed = matched.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    precision = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    recall = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    with_both = summed.withColumns({"precision": precision, "recall": recall})
    p, r = F.col("precision"), F.col("recall")
    return with_both.withColumn("f1", 2 * p * r / F.greatest(p + r, F.lit(1e-6)))


def pr_metrics(
    detections: DataFrame, truth: DataFrame, overall: float = 0.25, per_class: float = 0.2, by: str = "class_label", all_frames: bool = True
) -> DataFrame:
    """Scores over all boxes and per class, each with its own matching."""
    whole = scores(match_boxes(detections, truth, overall, FRAME, all_frames).withColumn("class_label", F.lit("all")), ["class_label"])
    named = detections.drop("class_label").withColumnRenamed(by, "class_label") if by != "class_label" else detections
    known = F.col("class_label").isin(CLASS_NAMES)
    matched = match_boxes(named.filter(known), truth.filter(known), per_class, [*FRAME, "class_label"], all_frames)
    return whole.unionByName(scores(matched, ["class_label"]))


def cluster_eval(detections: DataFrame, truth: DataFrame, threshold: float = 0.3, by: str = "gt_class", extra: Sequence[str] = ()) -> DataFrame:
    """Scores over every frame with the mean of the frames' mean iou and the numbers of clusters and objects.

    One row per class and one for all (``all``), for every value of the ``extra`` keys.
    """
    keys = [*FRAME, *extra]
    frames = match_boxes(detections, truth, threshold, keys).withColumn("class_label", F.lit("all"))
    named = detections.drop("class_label").withColumnRenamed(by, "class_label")
    known = F.col("class_label").isin(CLASS_NAMES)
    classes = match_boxes(named.filter(known), truth.filter(known), threshold, [*keys, "class_label"])
    columns = [*keys, "class_label", "tp", "fp", "fn", "mean_iou"]
    both = cut_lineage(frames.select(*columns).unionByName(classes.select(*columns)))
    group = [*extra, "class_label"]
    means = both.groupBy(*group).agg(
        F.coalesce(F.avg(F.when(F.col("mean_iou") > 0, F.col("mean_iou"))), F.lit(0.0)).alias("mean_iou"),
        F.sum(F.col("tp") + F.col("fp")).alias("clusters"),
        F.sum(F.col("tp") + F.col("fn")).alias("objects"),
    )
    return scores(both, group).join(means, group)


def param_sweep(points: DataFrame, truth: DataFrame, min_cluster_sizes: Sequence[int], min_samples: Sequence[int], epsilons: Sequence[float], threshold: float = 0.3) -> DataFrame:
    """Scores of the clustering for every parameter combination, best F1 first.

    Radii are a key of the rows, so one clustering run serves all of them. Neighbours are found once per radius, core points clustered
    once per density; the smallest cluster size only filters the clusters. ``points`` carry their class, by which a cluster counts as one of the class most of its points have.
    """
    numbered = [(i, e, m) for i, (e, m) in enumerate((e, m) for e in epsilons for m in min_samples)]
    grid = [F.struct(F.lit(i).alias("param_id"), F.lit(float(e)).alias("epsilon"), F.lit(int(m)).alias("min_samples")) for i, e, m in numbered]
    multiplied = points.withColumn("epsilon", F.explode(F.array(*[F.lit(float(e)) for e in dict.fromkeys(epsilons)])))
    radius = F.greatest(F.col("epsilon"), F.lit(1e-6))
    cored = cluster.core_clusters_of_groups(multiplied, [*FRAME, "epsilon"], radius, [int(m) for m in min_samples], ["class_id"])
    # Settings given twice are settings of their own.
    alike = F.filter(F.array(*grid), lambda g: (g["epsilon"] == F.col("epsilon")) & (g["min_samples"] == F.col("min_samples")))
    keys = [*FRAME, "param_id"]
    members = cored.withColumn("g", F.explode(alike)).select(*FRAME, "g.param_id", "point_id", "class_id", "x", "y", "z", "cluster")
    members = cut_lineage(members)
    boxes = boxfit.obb_yaw_pca(members, [*keys, "cluster"]).join(boxfit.dominant_class(members, [*keys, "cluster"]), [*keys, "cluster"])
    sized = boxes.withColumn("min_cluster_size", F.explode(F.array(*[F.lit(int(s)) for s in min_cluster_sizes])))
    sized = cut_lineage(sized.filter(F.col("num_points") >= F.col("min_cluster_size")).withColumn("box_id", F.monotonically_increasing_id()))
    settings = ["param_id", "min_cluster_size"]
    named = F.array(*[
        F.struct(F.lit(i).alias("param_id"), F.lit(int(s)).alias("min_cluster_size")) for i in range(len(grid)) for s in min_cluster_sizes
    ])
    reference = truth.withColumn("g", F.explode(named)).select(*truth.columns, "g.*")
    # Box ids must stay unique over the copies of the reference boxes.
    reference = cut_lineage(reference.withColumn("box_id", F.monotonically_increasing_id()))
    graded = cluster_eval(sized, reference, threshold, extra=settings)
    of = lambda label, column, name: F.coalesce(F.max(F.when(F.col("class_label") == label, F.col(column))), F.lit(0)).alias(name)
    wide = graded.groupBy(*settings).agg(
        *[of("all", c, c) for c in ("precision", "recall", "f1", "mean_iou")],
        of("all", "clusters", "n_clusters"),
        *[of(c, "f1", f"f1_{c.lower().split()[-1]}") for c in CLASS_NAMES],
    )
    joined = wide.withColumn("g", F.element_at(F.array(*grid), F.col("param_id") + 1))
    return joined.select("min_cluster_size", "g.min_samples", "g.epsilon", *[c for c in wide.columns if c not in settings]).orderBy(
        F.desc("f1"), "min_cluster_size", "min_samples", "epsilon"
    )


def cluster_profile(features: DataFrame) -> DataFrame:
    """Size statistics of clusters per class and over all (class ``all``), with elongation quartiles."""
    both = features.withColumn("class_label", F.explode(F.array(F.coalesce("class_label", F.lit("none")), F.lit("all"))))
    means = both.groupBy("class_label").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("n_points").alias("mean_points"),
        F.min("n_points").alias("min_points"),
        F.max("n_points").alias("max_points"),
        F.avg("bbox_height").alias("mean_height"),
        F.avg("elongation").alias("mean_elongation"),
        F.min("elongation").alias("min_elongation"),
        F.max("elongation").alias("max_elongation"),
    )
    stats = wide_percentiles(both, ["class_label"], ["n_points", "elongation"], [0.25, 0.5, 0.75])
    names = {("n_points", 0.5): "median_points", ("elongation", 0.25): "elongation_q1", ("elongation", 0.5): "elongation_median", ("elongation", 0.75): "elongation_q3"}
    return means.join(pivot_percentiles(stats, ["class_label"], names), "class_label")


# --- average precision -------------------------------------------------------------------------------------------


def true_positives(detections: DataFrame, truth: DataFrame, threshold: float = 0.5, extra: Sequence[str] = ()) -> DataFrame:
    """Detections that are the most confident one on their best reference box of the same frame and class."""
    keys = [*FRAME, "class_label", *extra]
    pairs = iou_pairs(detections, truth, "aabb", keys, least=threshold)
    best = pairs.groupBy(*extra, "box_id_a").agg(F.max_by(F.struct("box_id_b", "iou"), F.struct("iou", -F.col("box_id_b"))).alias("b"))
    scored = best.select(*extra, F.col("box_id_a").alias("box_id"), "b.box_id_b", "b.iou").join(
        detections.select(*extra, "box_id", "confidence"), [*extra, "box_id"]
    )
    first = F.max_by(F.struct("box_id", "iou"), F.struct("confidence", -F.col("box_id"))).alias("w")
    return scored.groupBy(*extra, F.col("box_id_b").alias("gt_id")).agg(first).select(*extra, "gt_id", "w.box_id", "w.iou")


def average_precision(detections: DataFrame, truth: DataFrame, threshold: float = 0.5, extra: Sequence[str] = ()) -> DataFrame:
    """Average precision per class (and extra keys) with the precision made non-increasing.

    Detections of equal confidence enter together. Counts are gathered per confidence first; running sums and the
    envelope are taken inside confidence buckets and then over the buckets, so no task sees a whole class.
    """
    group = [*extra, "class_label"]
    known = F.col("class_label").isin(CLASS_NAMES)
    hits = true_positives(detections.filter(known), truth.filter(known), threshold, extra).select(*extra, "box_id", F.lit(1).alias("hit"))
    marked = detections.filter(known).select(*group, "box_id", "confidence").join(hits, [*extra, "box_id"], "left")
    steps = marked.groupBy(*group, "confidence").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("tp"))
    steps = steps.withColumn("bucket", F.floor(F.col("confidence") * 1024).cast("long"))
    sums = steps.groupBy(*group, "bucket").agg(F.sum("n").alias("bn"), F.sum("tp").alias("bt"))
    above = W.partitionBy(*group).orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*group, "bucket", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}0") for c in ("bn", "bt")])
    inside = W.partitionBy(*group, "bucket").orderBy(F.desc("confidence")).rowsBetween(W.unboundedPreceding, 0)
    positives = truth.filter(known).groupBy(*group).agg(F.count(F.lit(1)).alias("n_gt"))
    curve = steps.join(starts, [*group, "bucket"]).join(positives, group)
    curve = curve.withColumns({"cn": F.col("bn0") + F.sum("n").over(inside), "ct": F.col("bt0") + F.sum("tp").over(inside)})
    curve = curve.withColumns({"precision": F.col("ct") / F.col("cn"), "gain": F.col("tp") / F.col("n_gt")})
    tops = curve.groupBy(*group, "bucket").agg(F.max("precision").alias("bp"))
    below = W.partitionBy(*group).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    tops = tops.select(*group, "bucket", F.max("bp").over(below).alias("later"))
    onward = W.partitionBy(*group, "bucket").orderBy("confidence").rowsBetween(W.unboundedPreceding, 0)
    enveloped = curve.join(tops, [*group, "bucket"]).withColumn("envelope", F.greatest(F.max("precision").over(onward), "later"))
    areas = enveloped.groupBy(*group).agg(F.sum(F.col("gain") * F.col("envelope")).alias("area"))
    return positives.join(areas, group, "left").select(*group, "n_gt", F.coalesce("area", F.lit(0.0)).alias("ap"))


def map_at_iou(detections: DataFrame, truth: DataFrame, threshold: float = 0.5, extra: Sequence[str] = ()) -> DataFrame:
    """Average precision per class and their mean (class ``mAP``)."""
    per_class = average_precision(detections, truth, threshold, extra)
    total = per_class.groupBy(*extra).agg(F.lit("mAP").alias("class_label"), F.sum("n_gt").alias("n_gt"), F.avg("ap").alias("ap"))
    return per_class.unionByName(total.select(*per_class.columns))


def mean_iou_correct(detections: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Mean iou over correctly classified matches."""
    hits = true_positives(detections, truth, threshold)
    return hits.agg(F.count(F.lit(1)).alias("matches"), F.avg("iou").alias("mean_iou"))


def density_robustness(
    detections: DataFrame, truth: DataFrame, threshold: float = 0.5, densities: Sequence[float] = (1.0, 0.75, 0.5, 0.25)
) -> DataFrame:
    """mAP per input density and its drop against full density; detections carry a ``density`` column."""
    reference = truth.withColumn("density", F.explode(F.array(*[F.lit(float(d)) for d in densities])))
    means = map_at_iou(detections, reference, threshold, ["density"]).filter(F.col("class_label") == "mAP")
    full = W.partitionBy().orderBy(F.desc("density"))
    return means.select("density", "ap", F.try_divide(F.first("ap").over(full) - F.col("ap"), F.first("ap").over(full)).alias("drop"))


def scene_stability(detections: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """mAP per scene with the mean and deviation over the scenes."""
    tag = lambda df: df.withColumn("scene_key", F.col("scene"))
    means = map_at_iou(tag(detections), tag(truth), threshold, ["scene_key"]).filter(F.col("class_label") == "mAP")
    everywhere = W.partitionBy()
    return means.select(
        F.col("scene_key").alias("scene"), "ap", F.avg("ap").over(everywhere).alias("mean_ap"), F.stddev_pop("ap").over(everywhere).alias("spread")
    )
