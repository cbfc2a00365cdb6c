"""Helpers of the text operators: tables cut off from their lineage, Arrow passes over texts, fresh column names."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysweep.session import cut_lineage


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a session without it gets the one that checkpoints use."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if spark.sparkContext.getCheckpointDir() is None:
            cut_lineage(spark.range(1))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Intermediate tables of this process, oldest first.
_tables: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new intermediate table in the shared folder and read on from there.

    Later plans start at the written files, so a lost executor costs its running tasks only, and values drawn while
    writing (row numbers) stay the same in every pass. The files stay until ``clear_stored``.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _tables.append(path)
    return written(df, path)


def clear_stored(spark: SparkSession) -> None:
    """Remove the intermediate tables made so far. Results that read them must have been written before."""
    while _tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(_tables.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that ``df`` does not have; Spark compares names without case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def with_row(df: DataFrame, name: str) -> DataFrame:
    """Add a whole number that differs in every row. Only stable once the result is ``stored``."""
    return df.withColumn(name, F.monotonically_increasing_id())


def filter_by_row(docs: DataFrame, kept: Callable[[DataFrame, str], DataFrame], extra: Sequence[str] = ()) -> DataFrame:
    """The rows of ``docs`` that ``kept`` names.

    ``kept`` gets a stored copy of ``docs`` with a row number and that column's name, and returns the rows to keep under
    that name, each once for every time it is to appear. Repeated rows and ids are told apart by the row number.
    Columns ``extra`` of what ``kept`` returns are added.
    """
    (row,) = fresh(docs, "kept_row")
    copy = stored(with_row(docs, row))
    chosen = kept(copy, row).select(row, *extra)
    return copy.join(chosen, row).select(*[copy[c] for c in docs.columns], *[chosen[c] for c in extra])


#: Rows in a batch of texts for Python. Spark's default of 10,000 holds tens of MB of texts in the executor and in Python at once.
BATCH_ROWS = 1000
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Let the session send texts to Python in batches of BATCH_ROWS, unless it was given another number than the default."""
    if spark.conf.get(_ROWS_SETTING) == "10000":
        spark.conf.set(_ROWS_SETTING, str(BATCH_ROWS))


def small_parts(batch: pa.RecordBatch, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into parts of about ``size`` bytes, so that what Python makes of a part stays small."""
    step = max(1, batch.num_rows * size // max(batch.nbytes, 1))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def arrow_pass(
    df: DataFrame, carry: Sequence[str], column: str, work: Callable[[Iterator[list]], Iterator[Sequence[list]]], fields: Sequence[tuple[str, T.DataType]]
) -> DataFrame:
    """One Arrow pass over ``column``: ``work`` turns the lists of its values into lists for the new ``fields``.

    The ``carry`` columns go along untouched. Batches are bounded in rows and bytes by Spark.
    """
    bound_batches(df.sparkSession)
    narrow = df.select(*carry, column)
    schema = T.StructType([*(narrow.schema[c] for c in carry), *(T.StructField(n, t) for n, t in fields)])
    kept = len(carry)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(t) for _, t in fields]
        carried: list[list[pa.Array]] = []

        def values() -> Iterator[list]:
            for batch in batches:
                for part in small_parts(batch):
                    carried.append([part.column(i) for i in range(kept)])
                    yield part.column(kept).to_pylist()

        for made in work(values()):
            arrays = [*carried.pop(0), *(pa.array(v, t) for v, t in zip(made, types))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return narrow.mapInArrow(run, schema)
