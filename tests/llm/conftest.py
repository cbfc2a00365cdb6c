from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture
def make_docs(spark):
    """``documents`` from (id, text) or (id, text, source), with extra columns whose names operators use themselves."""

    def make(rows, clashes=()):
        schema = T.StructType([*DOCS.fields, *(T.StructField(c, T.StringType()) for c in clashes)])
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src", len(r[1] or ""), *("x" for _ in clashes)) for r in rows]
        return spark.createDataFrame(full, schema).repartition(3)

    return make
