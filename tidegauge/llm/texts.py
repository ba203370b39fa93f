"""Shared helpers: documents in Arrow batches, and rows written once to the shared folder."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidegauge.runtime import scratch_path

# Functions travel to the Python workers by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bounds of one Arrow batch. They bound a worker's memory and never the rows that are read.
BATCH_ROWS = 1000
BATCH_BYTES = 16 * 1024 * 1024
# Words that a task's memo may hold before it starts anew.
MEMO_WORDS = 400_000


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def keyed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", fill: bool = True) -> DataFrame:
    """Only the key and the text, so that other columns may have any name; a null text is empty if `fill`."""
    body = F.col(text).cast("string")
    return docs.select(F.col(key).cast("bigint").alias("doc_id"),
                       (F.coalesce(body, F.lit("")) if fill else body).alias("text"))


def map_batches(rows: DataFrame, schema: pa.Schema, make: Callable[[], Callable]) -> DataFrame:
    """`make()` is called once per task and gives the function from a record batch to columns by name."""
    bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                made = work(batch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made[f.name], type=f.type) for f in schema], schema=schema)

    return rows.mapInArrow(run, from_arrow_schema(schema))


def filter_batches(rows: DataFrame, make: Callable[[], Callable]) -> DataFrame:
    """Rows whose verdict holds; `make()` gives the function from a record batch to one boolean per row."""
    bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(work(batch), type=pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


# Name under which a Python worker keeps what its tasks share; the module is made in the worker and holds nothing else.
_SHARED = "tidegauge_worker_memo"


def worker_shared(key: tuple, make: Callable[[], object]) -> object:
    """What `make()` gave the first time in this Python worker: later tasks of the worker use it again.

    One of each kind (the key's first entry) is kept, so that a worker holds no more than one task would.
    """
    kept = sys.modules.setdefault(_SHARED, types.ModuleType(_SHARED)).__dict__
    if kept.get(key[0], (None, None))[0] != key:
        kept[key[0]] = key, make()
    return kept[key[0]][1]


# Folders written inside each running `settled`.
_FOLDERS: list[list[str]] = []


def written(rows: DataFrame, label: str) -> DataFrame:
    """The rows stored once in the shared folder: fixed for all later reads, and lineage is cut."""
    spark = rows.sparkSession
    path = scratch_path(spark, label)
    if _FOLDERS:
        _FOLDERS[-1].append(path)
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """The rows of `make()` stored; what `make` itself stored on the way is deleted, as nothing needs it any more."""
    _FOLDERS.append([])
    try:
        rows = make()
        path = scratch_path(spark, label)
        rows.write.option("compression", "zstd").parquet(path)
    finally:
        used = _FOLDERS.pop()
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in used:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(hadoop).delete(place, True)
    if _FOLDERS:
        _FOLDERS[-1].append(path)
    return spark.read.schema(rows.schema).parquet(path)


def free_name(docs: DataFrame, wish: str) -> str:
    """`wish`, with underscores in front until no column is called so."""
    taken = {c.lower() for c in docs.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents written once with a number for each row, and the name of the column that holds it."""
    name = free_name(docs, "__row")
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "documents"), name


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
