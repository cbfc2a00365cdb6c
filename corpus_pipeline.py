"""A training corpus from raw documents: drop toxic texts, exact and near copies, mix the sources, encode into pieces.

Each stage reads what the one before it wrote. All but the last return the columns of ``documents``. As a stage begins only
after the result of the one before was written, it first removes the intermediate tables of that one. Columns besides ``doc_id``, ``text`` and ``source``
only go along, whatever their names; an empty table gives empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skysweep.llm.common import clear_stored, fresh, shared_folder, written
from skysweep.llm.exact_dedup import drop_exact_duplicates
from skysweep.llm.mixing import mixed_documents
from skysweep.llm.piece_dropout import encode_documents
from skysweep.llm.queries import table, vocabulary
from skysweep.llm.shingle_dedup import drop_similar
from skysweep.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is below one half."""
    clear_stored(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every text: the largest id."""
    clear_stored(spark)
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of texts that share four fifths of their five-word shingles: the smallest id."""
    clear_stored(spark)
    return drop_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them, at most three times."""
    clear_stored(spark)
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with merge-dropout, and whether they decode to the text.

    Copies of a document are numbered, so that each is segmented anew. The mix makes at most three of a row, and no two rows had one
    text, so no group of the window is large.
    """
    clear_stored(spark)
    (copy,) = fresh(docs, "copy_number")
    same = W.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    return encode_documents(docs.withColumn(copy, F.row_number().over(same)), vocabulary("piece_bpe_32k.model"), copy=copy)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("encode", encode),
]

#: Trees, fingerprints, seeded draws and pieces are beyond SQL; the tests hold the pipeline against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, f"{shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex}")
    return docs
