"""Near copies by the Jaccard similarity of their sets of five-word shingles.

SimHash fingerprints of the shingles that differ in two bits or fewer (``near_dedup``) give the first candidates. Verified on the sets, they
join most copies before any band is looked at; bands bring in the pairs of similarity 0.8 and more that differ in more bits.

Minima of seeded hashes of a set agree for two sets with a chance equal to their similarity. A band is five of them, so sets of
similarity s share one of 32 bands but for a chance of (1 - s^5)^32, three in a million at 0.8. Candidates whose sketches (two bits of
every minimum) differ too much are left out, the others are verified on the sets themselves, so no link is wrong.

Shingles that no other candidate has are counted first: they bound the similarity of a set with any other from above, exactly. So a text with
many changes of its own is not compared with a pile of copies that it shares bands with.

Sets under one band meet by rounds. In a round a few of a band are compared with all of it and then leave; sets that links have joined
carry one label, and a band whose sets have one label is settled. Only sets outside the largest label of a band are chosen, four times
as many as in the round before, so rounds grow with the logarithm of the sets that a band holds besides its largest pile.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysweep.llm.common import arrow_pass, filter_by_row, stored
from skysweep.llm.near_dedup import fingerprints, near_links
from skysweep.operators.graph import connected_components

SHINGLE = 5
#: Least similarity of a link.
LEAST = 0.8
BANDS, MINIMA = 32, 5
SEED = 42
#: Sets of a band that are compared with all of it in the first round, and growth of that number by round.
CHOSEN = 4
GROWTH = 4
#: Bits of a minimum in a sketch, and minima in which the sketches of a candidate may differ. Sets of similarity 0.8 differ in 0.2 * 3/4 of the
#: minima, in 24 of 160 with a deviation of 4.5: five deviations more are passed over with a chance of one in a million.
PLANES, SKETCH_DIFFERS = 2, 47
_BLOCK = 1024
_DRAWS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * MINIMA), dtype=np.uint64)
_FACTORS, _SHIFTS = _DRAWS[0] * np.uint64(2) + np.uint64(1), _DRAWS[1]


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the shingles of a text, each once; a text of fewer words has one shingle, a text without words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    parts = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else [words]
    return np.unique(np.fromiter((digest(b" ".join(p), SEED) for p in parts), dtype=np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """Minima of a set under every seeded hash; the largest number for an empty set."""
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(hashes), _BLOCK):
        np.minimum(least, (hashes[start : start + _BLOCK, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    return least


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key per band of the minima of a set, none of an empty set."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    return _keys(minima(hashes))


def _keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, MINIMA)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), b) for b, row in enumerate(rows)], dtype=np.uint64).view(np.int64)


def sketch(least: np.ndarray) -> np.ndarray:
    """Some bits of a mix of every minimum: the first bits of all, 64 to a whole number, then the second bits."""
    mixed = least * np.uint64(0x9E3779B97F4A7C15)
    words = []
    for plane in range(PLANES):
        bits = ((mixed >> np.uint64(63 - plane)) & np.uint64(1)).astype(np.uint8)
        words.append(np.packbits(np.append(bits, np.zeros(-len(bits) % 64, dtype=np.uint8))).view(np.int64))
    return np.concatenate(words)


def set_digests(docs: DataFrame, carry: Sequence[str], text: str) -> DataFrame:
    """``carry``, the ``digest`` of the set of every text, its size ``n``, its ``bands`` and ``sketch``."""

    def work(batches: Iterator[list]) -> Iterator[Sequence[list]]:
        for texts in batches:
            sets = [shingle_set(t) for t in texts]
            least = [minima(s) for s in sets]
            keys = [_keys(m) if len(s) else [] for s, m in zip(sets, least)]
            yield [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [len(s) for s in sets], keys, [sketch(m) for m in least]

    longs = T.ArrayType(T.LongType())
    return arrow_pass(docs, carry, text, work, [("digest", T.BinaryType()), ("n", T.LongType()), ("bands", longs), ("sketch", longs)])


def shingle_sets(docs: DataFrame, carry: Sequence[str], text: str) -> DataFrame:
    def work(batches: Iterator[list]) -> Iterator[Sequence[list]]:
        for texts in batches:
            yield [[shingle_set(t).view(np.int64) for t in texts]]

    return arrow_pass(docs, carry, text, work, [("shingles", T.ArrayType(T.LongType()))])


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (``src``, ``dst``) whose sets (``id``, ``shingles``) have the least similarity."""
    first = sets.select(F.col("id").alias("src"), F.col("shingles").alias("a"))
    second = sets.select(F.col("id").alias("dst"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    similar = both / (F.size("a") + F.size("b") - both) >= F.lit(least)
    return pairs.join(first, "src").join(second, "dst").filter(similar).select("src", "dst")


def fingerprint_pairs(fps: DataFrame) -> DataFrame:
    """Pairs (``src``, ``dst``) of sets (``id``, ``fp``) that join all whose fingerprints differ in two bits or fewer, perhaps by steps."""
    firsts = stored(fps.groupBy("fp").agg(F.min("id").alias("first")))
    equal = fps.join(firsts, "fp").select(F.col("first").alias("src"), F.col("id").alias("dst")).filter("src <> dst")
    end = lambda fp, name: firsts.select(F.col("fp").alias(fp), F.col("first").alias(name))
    unlike = near_links(firsts).join(end("src", "a"), "src").join(end("dst", "b"), "dst")
    return equal.unionByName(unlike.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))).distinct()


def own_shingles(sets: DataFrame) -> DataFrame:
    """``id`` and ``own``: the number of shingles that no other of the sets has (sets without any are left out)."""
    each = sets.select("id", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id"))
    return each.filter("c = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))


def most_similar(n: Column, shared: Column, other: Column) -> Column:
    """Upper bound of the similarity of sets of sizes ``n`` and ``other`` that share at most ``shared``."""
    return shared / (n + other - shared)


def sketch_distance(a: str, b: str) -> Column:
    """Minima whose bits differ."""
    words = -(-BANDS * MINIMA // 64)
    differ = lambda i: F.col(a)[i].bitwiseXOR(F.col(b)[i])
    return reduce(Column.__add__, [F.bit_count(reduce(Column.bitwiseOR, [differ(p * words + i) for p in range(PLANES)])) for i in range(words)])


def shingle_labels(filed: DataFrame, sets: DataFrame, least: float = LEAST, chosen: int = CHOSEN, *, known: DataFrame | None = None) -> DataFrame:
    """``id`` and ``label`` of sets that verified links join with others, as all similar pairs under one key would, perhaps by steps.

    ``known`` links (``src``, ``dst``) join sets beforehand.

    ``filed`` has ``key``, ``id``, ``n`` (shingles), ``own`` (those of no other set) and ``sketch``. Of every key, about ``chosen`` sets that do not belong to its largest label
    are compared with all others of another label and leave; the links join labels, and keys of one label are settled. No pair of a key is left out.
    """
    columns = ("id", "n", "own", "sketch", "label")
    ids = filed.select("id")
    if known is not None:
        ids = ids.unionByName(known.select(F.col("src").alias("id"))).unionByName(known.select(F.col("dst").alias("id")))
    ids = ids.distinct()

    def renamed(df: DataFrame, merged: DataFrame) -> DataFrame:
        return df.join(merged.hint("merge"), "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component")

    def merged_by(edges: DataFrame) -> DataFrame:
        """The label that takes the place of every ``label`` which the edges join with others."""
        joined = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        return stored(connected_components(joined, edges).select(F.col("id").alias("label"), "component"))

    labels, rest = ids.withColumn("label", F.col("id")), filed.withColumn("label", F.col("id"))
    if known is not None:
        before = merged_by(known)
        labels, rest = renamed(labels, before), renamed(rest, before)
    labels, rest = stored(labels.select("id", "label")), stored(rest)
    tested: DataFrame | None = None
    while True:
        # Counted per label first, so that a hot key is combined before it meets.
        counts = rest.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("low"))
        most = F.max(F.struct("c", "label")).alias("most")
        sums = (F.sum("c").alias("members"), F.count(F.lit(1)).alias("labels"), F.min("low").alias("low"), most)
        kept = counts.groupBy("key").agg(*sums).filter("labels > 1")
        kept = kept.select("key", "low", F.col("most.label").alias("largest"), (F.col("members") - F.col("most.c")).alias("others"))
        # Sets that cannot be similar to any set of the least size in the band leave it.
        shared = F.col("n") - F.col("own")
        hopeful = most_similar(F.col("n"), shared, F.greatest(shared, F.col("low"))) >= F.lit(least)
        rest = stored(rest.join(kept.hint("merge"), "key").filter(hopeful).withColumn("outside", F.col("label") != F.col("largest")))
        if rest.isEmpty():
            return labels.join(labels.groupBy("label").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("label"), "label").select("id", "label")
        # All that are outside the largest label where these are few, else one of each of ``chosen`` parts.
        outside = rest.filter("outside").select("key", *columns, "others")
        part = F.pmod(F.xxhash64("id"), F.lit(chosen))
        picked = outside.filter(F.col("others") > chosen).groupBy("key", part).agg(F.min(F.struct(*columns)).alias("p")).select("key", "p.*")
        probes = stored(outside.filter(F.col("others") <= chosen).drop("others").unionByName(picked))
        other = probes.select("key", *[F.col(c).alias(f"o_{c}") for c in columns])
        fits = most_similar(F.col("n"), F.least(shared, F.col("o_n") - F.col("o_own")), F.col("o_n")) >= F.lit(least)
        near = sketch_distance("sketch", "o_sketch") <= SKETCH_DIFFERS
        met = rest.join(other.hint("merge"), "key").filter((F.col("label") != F.col("o_label")) & fits & near)
        pairs = met.select(F.least("id", "o_id").alias("src"), F.greatest("id", "o_id").alias("dst")).distinct()
        # A pair that shares several bands is verified once.
        new = pairs if tested is None else pairs.join(tested.hint("merge"), ["src", "dst"], "left_anti")
        new = stored(new)
        tested = new if tested is None else tested.unionByName(new)
        links = stored(verified(new, sets, least))
        left = rest.select("key", *columns).join(probes.select("key", "id").hint("merge"), ["key", "id"], "left_anti")
        if links.isEmpty():
            rest = left
        else:
            # Only labels that the new links join are looked at.
            named = lambda side, name: labels.select(F.col("id").alias(side), F.col("label").alias(name))
            edges = links.join(named("src", "a").hint("merge"), "src").join(named("dst", "b").hint("merge"), "dst")
            edges = stored(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).filter("src <> dst").distinct())
            merged = merged_by(edges)
            labels = stored(renamed(labels, merged).select("id", "label"))
            rest = renamed(left, merged)
        rest = rest.select("key", *columns)
        chosen *= GROWTH


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """``docs`` with one row of every component of similar texts: the smallest id (null last), and of rows that share it the first.

    Texts link at a similarity of ``least`` or more; ASCII case and white space do not matter. A null text is an empty text,
    and texts without words are equal. Components are told apart by their rows, so repeated or null ids do not matter.
    """

    def kept(copy: DataFrame, row: str) -> DataFrame:
        narrow = copy.select(F.col(row).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
        rows = stored(set_digests(narrow, ["row", "doc_id"], "__text"))
        named = stored(rows.groupBy("digest").agg(F.min("row").alias("id")))
        first = rows.join(named.select(F.col("id").alias("row")), "row").withColumnRenamed("row", "id")
        # Keys alone meet first; sizes and sketches go only to those that sets share.
        filed = first.select("id", F.explode("bands").alias("key"))
        shared = filed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
        met = stored(filed.join(shared, "key"))
        fps = fingerprints(narrow, ["row"], "__text", SHINGLE).withColumnRenamed("row", "id")
        pairs = stored(fingerprint_pairs(stored(fps.join(named.select("id"), "id"))))
        ends = pairs.select(F.col("src").alias("row")).union(pairs.select("dst"))
        wanted = stored(met.select(F.col("id").alias("row")).union(ends).distinct())
        sets = stored(shingle_sets(narrow.join(wanted, "row"), ["row"], "__text").withColumnRenamed("row", "id"))
        about = first.select("id", "n", "sketch").join(own_shingles(sets), "id", "left").withColumn("own", F.coalesce("own", F.lit(0)))
        labels = shingle_labels(met.join(about, "id"), sets, least, known=stored(verified(pairs, sets, least)))
        found = stored(named.join(labels, "id", "left").select("digest", F.coalesce("label", "id").alias("component")))
        smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
        return rows.select("row", "doc_id", "digest").join(found, "digest").groupBy("component").agg(smallest).select(F.col("first.row").alias(row))

    return filter_by_row(docs, kept)
