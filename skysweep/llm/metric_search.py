"""Exact top-k inner products by best-first search in M-trees.

Vectors are filed under their nearest pivot in blocks of bounded size, and every block is an M-tree: a root over pages, a page
over vectors, each with its covering radius and each vector with its distance to the page's centre. A search opens the pages of
a block in the order of their lower bounds, and in a page only the vectors whose stored distance allows a result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skysweep.llm.common import stored, with_row

K = 20
SCALE = 64
#: Most pivots (their vectors go to every task) and vectors per pivot that are aimed at.
PIVOTS = 256
PER_PIVOT = 2048
#: Vectors of a block and of a page that are aimed at (small pages open fewer vectors but cost a call each), and queries that search a block together.
BLOCK = 4096
PAGE = 256
TOGETHER = 512
#: Largest product sum that doubles hold exactly; larger ones are computed with Python's whole numbers.
_EXACT = 2**53
#: Relative slack of distances against rounding; it only ever opens more.
_SLACK = 1e-9
#: Score of a place that is not taken yet.
_NOTHING = -np.iinfo(np.int64).max


def quantised(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id`` and ``v``, floor(64 x) as doubles; vectors that are null or hold a null, nan or infinite part are left out."""
    x = F.col(embedding)
    infinite = F.lit(float("inf"))
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == infinite))
    floors = F.transform(x, lambda c: (F.floor(c.cast("double") * F.lit(float(SCALE)))).cast("double"))
    return vectors.filter(F.col(vec_id).isNotNull() & x.isNotNull() & ~F.coalesce(odd, F.lit(True))).select(
        F.col(vec_id).cast("long").alias("vec_id"), floors.alias("v")
    )


def matrix(rows) -> np.ndarray:
    """Rows of numbers as one array; shorter rows are filled with zeros, which change no product."""
    rows = [np.asarray(r, dtype=np.float64) for r in rows]
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), max(width, 1)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def widen(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def lift(x: np.ndarray, most: float) -> np.ndarray:
    """Add the part that makes all lengths ``most``, so that the largest product is the smallest distance."""
    return np.hstack([x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0.0))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def build_tree(ids: np.ndarray, x: np.ndarray, most: float) -> dict:
    """M-tree of a block: vectors ordered by page and by distance to the page's centre, with bounds of pages and vectors."""
    n = len(ids)
    lifted = lift(x, most)
    chosen = np.random.default_rng(n).choice(n, size=max(1, -(-n // PAGE)), replace=False)
    centres = lifted[np.sort(chosen)]
    apart = distances(lifted, centres)
    page = apart.argmin(axis=1)
    to_centre = apart[np.arange(n), page]
    order = np.lexsort((ids, to_centre, page))
    page = page[order]
    # A crowded page is cut along the distance; the parts share its centre.
    start = np.flatnonzero(np.concatenate([[True], page[1:] != page[:-1]]))
    inside = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
    first = np.flatnonzero(inside % (2 * PAGE) == 0)
    to_centre = to_centre[order]
    ends = np.append(first[1:], n)
    return {"ids": ids[order], "x": x[order], "parent": to_centre, "first": first, "end": ends, "centre": centres[page[first]], "near": to_centre[first], "far": to_centre[ends - 1], "most": most}


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact whole products."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if largest < _EXACT:
        return (q @ x.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return (whole(q).astype(object) @ whole(x).astype(object).T).astype(np.int64)


def search(tree: dict, own: np.ndarray, q: np.ndarray, worst: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ``k`` (score, id) of a block for every query, at least those with a score of ``worst`` or more.

    Best first for all queries side by side: in step j every query opens its j-th nearest page, unless the page's lower bound
    exceeds the distance of its k-th best; queries that open the same page share one product.
    """
    width = max(q.shape[1], tree["x"].shape[1])
    q, x, most = widen(q, width), widen(tree["x"], width), tree["most"]
    centre = np.hstack([widen(tree["centre"][:, :-1], width), tree["centre"][:, -1:]])
    flat = np.hstack([q, np.zeros((len(q), 1))])
    square = (q * q).sum(axis=1)
    slack = _SLACK * (square + most) + 1e-6
    low = _NOTHING
    scores, ids = np.full((len(q), k), low), np.full((len(q), k), np.iinfo(np.int64).max)

    def reach(of: np.ndarray) -> np.ndarray:
        """Distance up to which a vector may still count; a tie may, for its id."""
        least = np.maximum(scores[of, -1].astype(np.float64), worst[of])
        return np.sqrt(np.maximum(square[of] + most - 2.0 * least, 0.0) + slack[of])

    away = distances(flat, centre)
    bound = np.maximum(np.maximum(away - tree["far"], tree["near"] - away), 0.0)
    order = np.argsort(bound, axis=1, kind="stable")
    live = np.arange(len(q))
    for step in range(order.shape[1]):
        page = order[live, step]
        open_ = bound[live, page] <= reach(live)
        live, page = live[open_], page[open_]
        if not len(live):
            break
        for p in np.unique(page):
            some = live[page == p]
            limit = reach(some)
            parent = tree["parent"][tree["first"][p] : tree["end"][p]]
            a = tree["first"][p] + np.searchsorted(parent, (away[some, p] - limit).min())
            b = tree["first"][p] + np.searchsorted(parent, (away[some, p] + limit).max(), side="right")
            if a >= b:
                continue
            found = products(q[some], x[a:b])
            found[tree["ids"][None, a:b] == own[some][:, None]] = low
            better = (found >= scores[some, -1][:, None]).any(axis=1)
            some, found = some[better], found[better]
            if not len(some):
                continue
            all_scores = np.hstack([scores[some], found])
            all_ids = np.hstack([ids[some], np.broadcast_to(tree["ids"][a:b], found.shape)])
            rank = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            scores[some], ids[some] = np.take_along_axis(all_scores, rank, 1), np.take_along_axis(all_ids, rank, 1)
    return scores, ids


_FOUND = "query_row long, query_id long, vec_id long, score long"


def search_blocks(work: DataFrame, k: int) -> DataFrame:
    """Run the searches of ``work``: rows with a ``tree`` and its queries ``asked`` (row, id, v, worst)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                tree = pickle.loads(batch.column(0)[at].as_py())
                asked = batch.column(1)[at].values
                own = asked.field("id").to_numpy(zero_copy_only=False)
                rows = asked.field("row").to_numpy(zero_copy_only=False)
                worst = asked.field("worst").to_numpy(zero_copy_only=False)
                scores, ids = search(tree, own, matrix(asked.field("v").to_numpy(zero_copy_only=False)), worst, k)
                hit = scores > _NOTHING
                hit &= scores >= worst[:, None]
                i = np.nonzero(hit)[0]
                yield pa.RecordBatch.from_arrays([pa.array(rows[i]), pa.array(own[i]), pa.array(ids[hit]), pa.array(scores[hit])], names=["query_row", "query_id", "vec_id", "score"])

    return work.select("tree", "asked").mapInArrow(run, _FOUND)


def top_products(vectors: DataFrame, k: int = K, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` best rows for every row whose id is divisible by ``every``.

    Scores are whole inner products of floor(64 x), ties go to the smaller id, a row with the query's own id never counts. Vectors
    that are null or hold null or non-finite parts take no part, nor do rows with a null id. Vectors of unequal
    length are compared as if filled with zeros; an empty vector has the score 0 with all. Repeated rows are rows of their
    own, as queries and as results. An empty table gives an empty result.
    """
    rows = stored(with_row(quantised(vectors, vec_id, embedding), "row"))
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    count, most = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(square), F.lit(0.0))).first()
    n = min(PIVOTS, max(1, -(-count // PER_PIVOT)))
    picked = rows.select("v").orderBy(F.xxhash64("row")).limit(n).collect()
    pivots = lift(matrix([r["v"] for r in picked]), most) if picked else np.zeros((1, 2))

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2).to_numpy(zero_copy_only=False))
            width = max(x.shape[1], pivots.shape[1] - 1)
            centre = np.hstack([widen(pivots[:, :-1], width), pivots[:, -1:]])
            apart = distances(lift(widen(x, width), most), centre)
            pivot = apart.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot.astype(np.int32)), pa.array(apart.min(axis=1))], names=["vec_id", "row", "v", "pivot", "apart"])

    homed = stored(rows.select("vec_id", "row", "v").mapInArrow(near, "vec_id long, row long, v array<double>, pivot int, apart double"))
    sizes = homed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("radius")).collect()
    parts = {r["pivot"]: -(-r["n"] // BLOCK) for r in sizes}
    radius = np.array([next((r["radius"] for r in sizes if r["pivot"] == p), -np.inf) for p in range(len(pivots))])
    blocks_of = F.create_map(*[x for p, b in parts.items() for x in (F.lit(p), F.lit(b))]) if parts else F.create_map(F.lit(0), F.lit(1))
    part = F.pmod(F.xxhash64("row"), F.element_at(blocks_of, F.col("pivot"))).cast("int").alias("part")

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        tree = build_tree(frame["vec_id"].to_numpy(), matrix(frame["v"]), most)
        return pd.DataFrame({"pivot": frame["pivot"].iloc[:1], "part": frame["part"].iloc[:1], "tree": [pickle.dumps(tree)]})

    trees = stored(homed.select("vec_id", "v", "pivot", part).groupBy("pivot", "part").applyInPandas(build, "pivot int, part int, tree binary"))
    queries = stored(homed.filter(F.col("vec_id") % every == 0).select(F.col("row"), F.col("vec_id").alias("id"), "v", "pivot"))
    groups = max(1, -(-queries.count() // TOGETHER))

    def asked(queries: DataFrame) -> DataFrame:
        """Queries gathered per block, at most about TOGETHER in a row."""
        group = F.pmod(F.xxhash64("row"), F.lit(groups))
        told = queries.select("pivot", group.alias("group"), F.struct("row", "id", "v", "worst").alias("query"))
        gathered = told.groupBy("pivot", "group").agg(F.collect_list("query").alias("asked"))
        return trees.join(gathered, "pivot").select("tree", "asked", "pivot", "part")

    # First the blocks of a query's own pivot, whose k-th score bounds the rest.
    nothing = F.lit(float("-inf"))
    home = stored(search_blocks(asked(queries.withColumn("worst", nothing)), k))
    best = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    kth = home.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").cast("double").alias("worst"))
    bounded = queries.join(kth, "row", "left").withColumn("worst", F.coalesce("worst", nothing))

    def others(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pivots, besides its own, whose ball reaches into the ball of a query's k-th best."""
        for batch in batches:
            q = matrix(batch.column(2).to_numpy(zero_copy_only=False))
            width = max(q.shape[1], pivots.shape[1] - 1)
            q = widen(q, width)
            centre = np.hstack([widen(pivots[:, :-1], width), pivots[:, -1:]])
            away = distances(np.hstack([q, np.zeros((len(q), 1))]), centre)
            square, worst = (q * q).sum(axis=1), batch.column(4).to_numpy(zero_copy_only=False)
            reach = np.sqrt(np.maximum(square + most - 2.0 * worst, 0.0) + _SLACK * (square + most) + 1e-6)
            hit = away - radius <= reach[:, None]
            hit[np.arange(len(q)), batch.column(3).to_numpy(zero_copy_only=False)] = False
            i, p = np.nonzero(hit)
            taken = batch.take(pa.array(i))
            yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in (0, 1, 2, 4)), pa.array(p.astype(np.int32))], names=["row", "id", "v", "worst", "pivot"])

    spread = bounded.select("row", "id", "v", "pivot", "worst").mapInArrow(others, "row long, id long, v array<double>, worst double, pivot int")
    found = home.unionByName(search_blocks(asked(spread), k))
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )

