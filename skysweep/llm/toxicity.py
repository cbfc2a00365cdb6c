"""Toxicity from gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learnt as well: words and word beginnings that labelled toxic texts use far more than other texts. Features are densities
of its hits, their nearness to the second person, capitals, punctuation and signs of obfuscation.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysweep.llm.common import bound_batches, fresh, stored

#: At most this many labelled rows are learnt from, the first in the order of a hash of the id.
TRAIN_ROWS = 20_000
#: Of the labels outside the held-out fold 0, fold 4 calibrates, the others grow the lexicon and the trees.
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
#: Terms of the lexicon, the fewest toxic texts that use one, and its least deviation from chance in standard errors.
TERMS, SUPPORT, DEVIATIONS = 512, 8, 6.0
BEGINNINGS = (4, 5, 6)
TREES, DEPTH, RATE, LEAF_ROWS = 20, 4, 0.3, 15
WINDOW, NEAR = 50, 5
#: Tokens whose properties a task remembers.
REMEMBERED = 1 << 17
#: Letters that digits and signs stand for, and pronouns of the second person.
LOOKALIKES = str.maketrans("013457@$!|", "oieastasii")
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
FEATURES = (
    "hits", "hit_density", "weight_density", "densest_window", "distinct_hits", "best_weight", "hidden_hits", "hidden_density", "near_second_person", "closest_second_person",
    "second_person_density", "capital_share", "capital_words", "exclamations", "questions", "punctuation", "mixed_words", "symbol_words", "single_letters", "words", "variety",
)
_EDGE = ".,;:!?\"'()[]{}<>«»¿¡…-*_"


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def terms_of(word: str) -> list[str]:
    """A word and its beginnings, marked by a trailing hyphen."""
    return [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) >= n)]


def plain(token: str) -> str:
    return token.strip(_EDGE).lower()


def unmasked(word: str) -> str:
    """The word behind look-alike signs and letters set apart by signs."""
    return "".join(c for c in word.translate(LOOKALIKES) if c.isalpha())


class Reader:
    """Turns texts into features; remembers what it found out about tokens."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.known: dict[str, tuple] = {}

    def weight(self, word: str) -> float:
        return max((self.lexicon.get(t, 0.0) for t in terms_of(word)), default=0.0) if word else 0.0

    def look(self, token: str) -> tuple:
        """(weight, hidden, second person, letters, capitals, all capitals, !, ?, punctuation, digits inside, signs inside, single)"""
        word = plain(token)
        weight, hidden = self.weight(word), 0
        letters = sum(map(str.isalpha, token))
        digits_inside = int(0 < letters and any(map(str.isdigit, word)))
        signs_inside = int(0 < letters and any(not c.isalnum() and c not in "'’-" for c in word))
        if not weight and (digits_inside or signs_inside or "-" in word):
            weight = self.weight(unmasked(word))
            hidden = int(weight > 0)
        capitals = sum(map(str.isupper, token))
        marks = sum(not c.isalnum() for c in token)
        return (weight, hidden, int(word in SECOND_PERSON), letters, capitals, int(letters > 2 and capitals == letters), token.count("!"), token.count("?"), marks, digits_inside, signs_inside, int(letters == 1))

    def features(self, text: str | None) -> list[float]:
        tokens = (text or "").split()
        n = len(tokens)
        if not n:
            return [0.0] * len(FEATURES)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, sums, hits, best, weights = self.known, [0.0] * 12, 0, 0.0, 0.0
        counts = Counter(tokens)
        marked = set()
        for token, times in counts.items():
            seen = known.get(token)
            if seen is None:
                seen = known[token] = self.look(token)
            for i in range(1, 12):
                sums[i] += seen[i] * times
            if seen[0]:
                hits += times
                weights += seen[0] * times
                best = max(best, seen[0])
                marked.add(token)
        near = closest = densest = 0.0
        if hits:
            places = [i for i, t in enumerate(tokens) if t in marked]
            people = [i for i, t in enumerate(tokens) if known[t][2]]
            near, closest = self.nearness(places, people)
            first = 0
            for last, place in enumerate(places):
                while places[first] <= place - WINDOW:
                    first += 1
                densest = max(densest, (last - first + 1) / WINDOW)
        letters = max(sums[3], 1.0)
        return [
            math.log1p(hits), hits / n, weights / n, densest, float(len(marked)), best, math.log1p(sums[1]), sums[1] / n, near, closest,
            sums[2] / n, sums[4] / letters, sums[5] / n, sums[6] / n, sums[7] / n, sums[8] / n, sums[9] / n, sums[10] / n, sums[11] / n, math.log1p(n), len(counts) / n,
        ]

    @staticmethod
    def nearness(places: list[int], people: list[int]) -> tuple[float, float]:
        """Share of hits with a second person among the nearest words, and one over the least distance."""
        if not people:
            return 0.0, 0.0
        j, close, least = 0, 0, math.inf
        for place in places:
            while j + 1 < len(people) and abs(people[j + 1] - place) <= abs(people[j] - place):
                j += 1
            gap = max(abs(people[j] - place), 1)
            close += gap <= NEAR
            least = min(least, gap)
        return close / len(places), 1.0 / least


def dense_features(text: Column, lexicon: dict[str, float]) -> Column:
    """Features of a text column. Only the texts go to Python; other columns of the row wait beside them in Spark."""

    @F.pandas_udf("array<double>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(lexicon)
        for texts in batches:
            yield pd.Series([reader.features(t) for t in texts])

    return read(text)


def learn_lexicon(rows: DataFrame, terms: int = TERMS) -> dict[str, float]:
    """Weight (log odds) of the ``terms`` most telling terms of ``text`` for ``toxic``; a text counts a term once."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {w for w in map(plain, set((text or "").split())) if len(w) > 2}
                seen[toxic].update({t for w in words for t in terms_of(w)})
            for toxic, counts in enumerate(seen):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(counts), pa.string()), pa.array([toxic] * len(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["term", "toxic", "n"]
                )

    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    with_term = lambda toxic: F.sum(F.when(F.col("toxic") == toxic, F.col("n")).otherwise(0)) + F.lit(0.5)
    counts = rows.select("text", "toxic").mapInArrow(count, "term string, toxic int, n long").groupBy("term").agg(with_term(1).alias("t"), with_term(0).alias("o"))
    odds = F.log(F.col("t") / F.lit(totals.get(1, 0) + 1.0)) - F.log(F.col("o") / F.lit(totals.get(0, 0) + 1.0))
    scored = counts.filter(F.col("t") > SUPPORT).select("term", odds.alias("odds"), (odds / F.sqrt(1 / F.col("t") + 1 / F.col("o"))).alias("z"))
    kept = scored.filter((F.col("z") >= DEVIATIONS / 2) & (F.col("odds") >= 2.0)).orderBy(F.desc("z"), "term").limit(terms)
    return {r["term"]: r["odds"] for r in kept.collect()}


@dataclass
class ToxicityModel:
    """Lexicon, trees and calibration; without trees every text gets the ``rate``."""

    lexicon: dict[str, float]
    rate: float
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None

    def score(self, docs: DataFrame, text: str, carry: Sequence[str], name: str) -> DataFrame:
        """``carry`` and the score, 0 to 1; null and empty texts get that of a text without any feature."""
        if self.trees is None:
            return docs.select(*carry, F.lit(self.rate).alias(name))
        bound_batches(docs.sparkSession)
        dense, vector, raw, chance, guess, margin = fresh(docs, "dense", "vector", "raw", "chance", "guess", "margin")
        rows = docs.select(*carry, dense_features(F.col(text), self.lexicon).alias(dense))
        trees = self.trees.copy().setFeaturesCol(vector).setRawPredictionCol(raw).setProbabilityCol(chance).setPredictionCol(guess)
        made = trees.transform(rows.withColumn(vector, array_to_vector(dense))).withColumn(margin, vector_to_array(chance)[1])
        if self.calibration is None:
            return made.select(*carry, F.col(margin).alias(name))
        calibrated = self.calibration.copy().setFeaturesCol(margin).setPredictionCol(name).transform(made.select(*carry, margin))
        return calibrated.select(*carry, F.least(F.greatest(F.col(name), F.lit(0.0)), F.lit(1.0)).alias(name))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Learn from at most ``rows`` labelled documents outside the held-out fold.

    An id with several labels is toxic if any is; null ids, texts and labels are left out. With labels of one kind only, or none,
    the model is their rate (0.0 without any).
    """
    given = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & (fold_of(F.col(doc_id)) != HELD_OUT))
    chosen = given.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    # At most ``rows`` rows, so it may be broadcast.
    sample = stored(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("text is not null")
    labelled = stored(texts.join(F.broadcast(sample), "doc_id").withColumn("fold", fold_of(F.col("doc_id"))))
    grown = labelled.filter(F.col("fold") != CALIBRATION)
    kinds = {r["toxic"]: r["n"] for r in grown.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = kinds.get(1, 0) / max(sum(kinds.values()), 1)
    if len(kinds) < 2:
        return ToxicityModel({}, rate)
    lexicon = learn_lexicon(grown)
    featured = stored(labelled.select("toxic", "fold", dense_features(F.col("text"), lexicon).alias("dense")))
    ready = featured.select(F.col("toxic").cast("double").alias("label"), "fold", array_to_vector("dense").alias("features"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=RATE, minInstancesPerNode=LEAF_ROWS, seed=7).fit(ready.filter(F.col("fold") != CALIBRATION))
    held = stored(trees.transform(ready.filter(F.col("fold") == CALIBRATION)).select("label", vector_to_array("probability")[1].alias("margin")))
    calibration = None
    if held.select("label").distinct().count() == 2:
        calibration = IsotonicRegression(featuresCol="margin", labelCol="label").fit(held)
    return ToxicityModel(lexicon, rate, trees, calibration)


def score_toxicity(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score``, ``predicted`` and the ``carry`` columns.

    Only the text decides the score. Repeated rows stay and get equal scores. A null id is not held out. An empty table gives
    an empty result.
    """
    own = [c for c in carry if c != doc_id]
    model = model or train(docs, labels, doc_id=doc_id, text=text)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"), *own)
    scored = model.score(narrow, "__text", ["doc_id", *own], "__score")
    held_out = F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scored.select(
        F.col("doc_id").alias(doc_id), *own, held_out.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """``docs`` without the documents that the model finds toxic, all columns as they are, in one pass without a shuffle."""
    (score,) = fresh(docs, "score")
    model = model or train(docs, labels)
    return model.score(docs, "text", docs.columns, score).filter(F.col(score) < 0.5).select(*docs.columns)
