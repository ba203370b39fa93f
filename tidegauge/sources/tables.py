"""Stored tables as parquet folders: the writer, its batch, and the UTC day are partitions.

One layout serves appends, the batches of streams, and tables of the session catalog, so that what is written by path is
readable by name, and the other way round. A batch is replaced as a whole when it is written again, whatever days it
held before. Writes sort rows inside their files, so that symbol and time filters skip row groups. Time filters add
the day predicate that partition pruning needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.scalars import at_or_after
from tidegauge.schemas import TABLES, Table

# Writers of rows that belong to no batch, and of batches that no streaming query writes.
APPENDED, DIRECT = "append", "direct"
# Partition columns before the day.
WRITER, BATCH = "query", "batch_id"


def query_id(spark: SparkSession) -> str:
    """Identity of the streaming query whose batch is being written; it lives as long as the query's checkpoint."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or DIRECT


def _schema(table: Table) -> str:
    return f"{table.ddl()}, {WRITER} STRING, {BATCH} BIGINT, {table.day} DATE"


def _name(table: Table, database: str | None) -> str:
    return f"{database}.{table.name}" if database else table.name


def create_tables(spark: SparkSession, root: str, database: str | None = None) -> None:
    """Create every missing table in the session catalog, located under `root`, and find what is stored there already."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for table in TABLES.values():
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table_path(root, table))
        folder.getFileSystem(hadoop).mkdirs(folder)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {_name(table, database)} ({_schema(table)}) "
            f"USING parquet PARTITIONED BY ({WRITER}, {BATCH}, {table.day}) LOCATION '{table_path(root, table)}'"
        )
        recover(spark, table, database)


def recover(spark: SparkSession, table: Table, database: str | None = None) -> None:
    """Make partitions that were written or deleted by path known to the table of that name."""
    spark.sql(f"MSCK REPAIR TABLE {_name(table, database)} SYNC PARTITIONS")


def table_path(root: str, table: Table) -> str:
    return f"{root.rstrip('/')}/{table.name}"


def read_table(spark: SparkSession, root: str, table: Table) -> DataFrame:
    """All rows below `root`, with the partition columns."""
    return spark.read.schema(_schema(table)).parquet(table_path(root, table))


def read_named(spark: SparkSession, table: Table, database: str | None = None) -> DataFrame:
    """All rows of the table in the session catalog; its partitions are found without listing folders."""
    return spark.table(_name(table, database))


def shape(rows: DataFrame, table: Table, now: Column) -> DataFrame:
    """Bring rows to the table's columns and types.

    Decimals round half up; a value that does not fit fails the write, so rows are split with
    `quality.split` before. Missing columns are null, a missing `id` is a hash of the row, a missing `created_at` is `now`.
    """
    have = set(rows.columns)
    identity = F.xxhash64(*[F.col(c) for c in rows.columns])
    stored = []
    for name, kind in table.columns:
        if name in have:
            column = F.col(name)
        elif name == "id":
            column = identity
        elif name == "created_at":
            column = now
        else:
            column = F.lit(None)
        shaped = column.try_cast(kind)
        if name in have and kind.startswith("DECIMAL"):
            shaped = F.when(column.isNotNull() & shaped.isNull(), F.raise_error(F.lit(f"{table.name}.{name} does not fit {kind}"))
                            .cast(kind)).otherwise(shaped)
        stored.append(shaped.alias(name))
    return rows.select(*stored).withColumn(table.day, F.to_date(table.time))


def _arranged(rows: DataFrame, table: Table, now: Column) -> DataFrame:
    """Shaped rows, rebalanced by day and sorted inside each day.

    Adaptive execution splits a day that is too large for one file and merges small ones, so the number of files
    follows the size of the data.
    """
    key = [c for c in ("symbol", table.time) if c in dict(table.columns)]
    return shape(rows, table, now).hint("rebalance", table.day).sortWithinPartitions(table.day, *key)


def append(rows: DataFrame, root: str, table: Table, now: Column, batch_id: int | None = None,
           query: str = DIRECT) -> None:
    """Write rows to the table's folder.

    With `batch_id` the rows go to the folder of that query and batch and replace whatever an earlier attempt of
    the same batch left there, so a retried batch is written once and another query's batches stay.
    """
    writer, batch, mode = (APPENDED, 0, "append") if batch_id is None else (query, int(batch_id), "overwrite")
    (_arranged(rows, table, now).write.mode(mode).option("partitionOverwriteMode", "static")
     .partitionBy(table.day).parquet(f"{table_path(root, table)}/{WRITER}={writer}/{BATCH}={batch}"))


@contextmanager
def _whole_partitions(spark: SparkSession) -> Iterator[None]:
    """Overwriting a batch by name removes all its days, also those that the new rows do not have."""
    setting = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "static")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def insert(rows: DataFrame, table: Table, now: Column, database: str | None = None, batch_id: int | None = None,
           query: str = DIRECT) -> None:
    """Like `append`, into the table of that name: its new partitions are known to the catalog at once."""
    spark = rows.sparkSession
    writer, batch, how = (APPENDED, 0, "INTO") if batch_id is None else (query, int(batch_id), "OVERWRITE")
    with _whole_partitions(spark):
        spark.sql(f"INSERT {how} TABLE {_name(table, database)} PARTITION ({WRITER} = '{writer}', {BATCH} = {batch}, {table.day}) "
                  "SELECT * FROM {rows}", rows=_arranged(rows, table, now))


def read_batches(spark: SparkSession, root: str, table: Table) -> DataFrame:
    """Rows written per batch, all attempts resolved."""
    return read_table(spark, root, table).filter(F.col(WRITER) != APPENDED)


def since(rows: DataFrame, table: Table, start: Column) -> DataFrame:
    """Rows at or after `start`; whole day partitions before it are pruned."""
    return rows.filter(at_or_after(rows, table.time, start))
