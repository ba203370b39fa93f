"""Structured Streaming jobs. Sources are passed in as streaming DataFrames with a text column `value`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegauge.functions.scalars import seconds
from tidegauge.operators import moments, quality
from tidegauge.operators.iforest import Forest
from tidegauge.operators.windows import ohlcv, trailing_metrics
from tidegauge.plans import batch as plans
from tidegauge.schemas import AGGREGATED_METRICS, ANOMALY_LOGS, RAW_TRADES, WINDOW_CELLS, WINDOW_TRADES, WINDOWS, Table
from tidegauge.sources import tables
from tidegauge.sources.messages import decode_trades, encode

# Trigger interval and watermark delay.
TRIGGER = "10 seconds"
DELAY = "30 seconds"


def trade_stream(messages: DataFrame, delay: str = DELAY) -> DataFrame:
    """Decoded trades with a watermark on event time.

    A message's place in its topic is its identity. Other sources have no place, so there equal trades share an id.
    """
    place = [c for c in ("topic", "partition", "offset") if c in messages.columns]
    named = decode_trades(messages, place)
    return (named.withColumn("id", F.xxhash64(*(place or ("symbol", "trade_timestamp", "price", "volume"))))
            .drop(*place).withWatermark("ts", delay))


def trade_rows(trades: DataFrame) -> DataFrame:
    """Decoded trades in the columns of the trade table."""
    return trades.select("id", "symbol", "price", "volume", F.col("ts").alias("trade_timestamp"), "conditions")


def stored_trades(spark: SparkSession, root: str) -> Callable[[Column], DataFrame]:
    """Reader of landed trades from a moment on, for windows that reach back over batches."""
    def recent(start: Column) -> DataFrame:
        rows = tables.since(tables.read_batches(spark, root, RAW_TRADES), RAW_TRADES, start)
        return rows.select("id", "symbol", F.col("price").cast("double").alias("price"),
                           F.col("volume").cast("double").alias("volume"), F.col("trade_timestamp").alias("ts"))

    return recent


def run(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str,
        once: bool = False) -> StreamingQuery:
    """Start a per-batch job: every trigger interval, or over what is available and then stop."""
    trigger = {"availableNow": True} if once else {"processingTime": TRIGGER}
    return (stream.writeStream.foreachBatch(on_batch).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def detection(root: str, now: Callable[[], Column] = F.current_timestamp, forest: Forest | None = None,
              publish: Callable[[DataFrame], None] | None = None, windows=WINDOWS, model_window: str = "5m",
              recent: Callable[[Column], DataFrame] | None = None, history: int | None = None,
              keep: bool = True) -> Callable[[DataFrame, int], None]:
    """Batch callback: store window metrics, run all detectors, store and publish anomalies.

    Each table is written to the batch's own partition, so a retried batch replaces its
    earlier rows. Rows that do not fit the table are kept
    apart with a reason; any other failure fails the batch, which is then run again.
    With `history`, a number of seconds, windows reach back over the query's own earlier batches: each batch stores its
    trades and their cells of that length, and batches are told apart by their number, so equal trades of several
    batches all count. In place of that, `recent(start)` may return trades that another job landed, from `start` on.
    `keep` persists the batch while it is worked on, so that the source is read once; bound the batch
    by the source's rate limit.
    """
    def on_batch(trades: DataFrame, batch_id: int) -> None:
        if keep:
            trades = trades.persist()
        try:
            if trades.isEmpty():
                return
            query, moment = tables.query_id(trades.sparkSession), now()
            if history is not None:
                metrics = _reaching(trades, root, history, windows, moment, batch_id, query)
            elif recent is not None:
                end = trades.agg(F.max("ts")).scalar()
                stored = recent(end - seconds(max(length for _, length in windows))).filter(F.col("ts") <= end)
                metrics = trailing_metrics(_with_earlier(trades, stored), windows)
            else:
                metrics = trailing_metrics(trades, windows)
            metrics = metrics.persist()
            _store(metrics, root, AGGREGATED_METRICS, moment, batch_id, query)

            verdicts = plans.all_verdicts(trades, metrics, forest, model_window)
            found = plans.anomaly_events(verdicts, trades, moment).persist()
            _store(plans.log_rows(found), root, ANOMALY_LOGS, moment, batch_id, query)
            if publish is not None:
                publish(encode(found, "symbol"))
            found.unpersist()
            metrics.unpersist()
        finally:
            if keep:
                trades.unpersist()

    return on_batch


def _reaching(trades: DataFrame, root: str, cell: int, windows, moment: Column, batch_id: int, query: str) -> DataFrame:
    """Window metrics over this and all earlier batches of the query; the batch's trades and cells are stored first."""
    own = trades.select("symbol", F.col("price").cast("double").alias("price"), F.col("volume").cast("double").alias("volume"), "ts")
    spark = trades.sparkSession
    tables.append(own, root, WINDOW_TRADES, moment, batch_id, query)
    tables.append(moments.cells(own, cell), root, WINDOW_CELLS, moment, batch_id, query)
    before = (F.col(tables.WRITER) == query) & (F.col(tables.BATCH) < batch_id)
    start = trades.agg(F.max("ts")).first()[0]
    if start is not None:
        start = F.lit(start) - seconds(max(length for _, length in windows) + cell)
    stored = [tables.read_table(spark, root, table).filter(before) for table in (WINDOW_CELLS, WINDOW_TRADES)]
    if start is not None:
        stored = [tables.since(rows, table, start) for rows, table in zip(stored, (WINDOW_CELLS, WINDOW_TRADES))]
    return moments.reaching_metrics(own, *stored, cell, windows)


def _with_earlier(trades: DataFrame, stored: DataFrame) -> DataFrame:
    """A batch's trades and those stored before it, where the store may or may not hold the batch itself already.

    The store holds the batch if it has each of its trades at least as often. Then so many copies of each are the batch's
    own, and what is stored beyond them came earlier; equal fills of several batches all count.
    """
    shared, key = ["id", "symbol", "price", "volume", "ts"], ["id", "ts"]
    counts = trades.groupBy(*key).agg(F.count(F.lit(1)).alias("_own"))
    held = stored.groupBy(*key).agg(F.count(F.lit(1)).alias("_held"))
    landed = counts.join(held, key, "left").agg(F.bool_and(F.coalesce("_held", F.lit(0)) >= F.col("_own"))).first()[0]
    earlier = stored.select(*shared)
    if landed:
        place = F.row_number().over(Window.partitionBy(*key).orderBy("symbol", "price", "volume"))
        earlier = (earlier.join(counts, key, "left").withColumn("_place", place)
                   .filter(F.col("_own").isNull() | (F.col("_place") > F.col("_own"))))
    return trades.select(*shared).unionByName(earlier.select(*shared))


def landing(root: str, table: Table, now: Callable[[], Column] = F.current_timestamp) -> Callable[[DataFrame, int], None]:
    """Batch callback: append normalised rows to a table, each batch once."""
    def on_batch(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        try:
            _store(rows, root, table, now(), batch_id, tables.query_id(rows.sparkSession))
        finally:
            rows.unpersist()

    return on_batch


def rejects(root: str, table: Table) -> str:
    """Folder of the rows that did not fit the table, with their reasons."""
    return f"{root}/rejected_{table.name}"


def _store(rows: DataFrame, root: str, table: Table, now: Column, batch_id: int, query: str) -> None:
    """Write a batch's rows to the table, and those that do not fit, with a reason, to its rejects."""
    accepted, rejected = quality.split(rows, table)
    tables.append(accepted, root, table, now, batch_id, query)
    rejected.write.mode("overwrite").parquet(f"{rejects(root, table)}/query={query}/batch_id={batch_id}")


def bars(trades: DataFrame, length: int, slide: int | None = None) -> DataFrame:
    """Event-time bars of a watermarked trade stream; closed windows are emitted, late trades dropped."""
    return ohlcv(trades, length, slide)


def fresh_articles(articles: DataFrame, horizon: str = "7 days", time: str = "published_at",
                   key: str = "id") -> DataFrame:
    """Each article once within the horizon; the state is bounded by the watermark."""
    return articles.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])


def store(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append a stream to a parquet folder."""
    trigger = {"availableNow": True} if once else {"processingTime": TRIGGER}
    return (stream.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())
