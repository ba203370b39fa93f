"""Streaming jobs run over the given event files until nothing is left, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from catalog.registry import query
from catalog.signals import _BAR_SQL, EPOCH, TRAILING_SQL, forest, scores_sql
from tidegauge.runtime import scratch_path
from tidegauge.operators.iforest import FEATURES, load
from tidegauge.schemas import AGGREGATED_METRICS, ANOMALY_LOGS
from tidegauge.sources import messages, tables
from tidegauge.streaming import jobs


def _stream(spark, sf, name):
    # A file source takes a folder or a pattern; the pattern matches one file as well as a folder of files.
    schema = v.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/[{name[0]}]{name[1:]}.parquet")


def _trades(spark, sf, symbol="event_type", volume="k"):
    return v.trades_of(_stream(spark, sf, "events"), symbol, volume).withWatermark("ts", "30 seconds")


@query(f"""
SELECT * FROM (
  SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts, {EPOCH}) AS window_start,
         time_bucket(INTERVAL 1 HOUR, ts, {EPOCH}) + INTERVAL 1 HOUR AS window_end, {_BAR_SQL}
  FROM ({v.trades_sql()}) GROUP BY symbol, time_bucket(INTERVAL 1 HOUR, ts, {EPOCH}))
WHERE window_end <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 30 SECOND""")
def stream_tumbling_ohlcv(spark, sf):
    root = scratch_path(spark, "bars")
    closed = jobs.bars(_trades(spark, sf), 3600)
    jobs.store(closed, f"{root}/rows", f"{root}/checkpoint", once=True).awaitTermination()
    return spark.read.schema(closed.schema).parquet(f"{root}/rows")


def _detect(spark, sf):
    root = scratch_path(spark, "detection")
    moment = F.lit("2024-02-01 00:00:00").cast("timestamp")
    callback = jobs.detection(root, now=lambda: moment, windows=v.DAYS, model_window="5d")
    jobs.run(_trades(spark, sf, "user_id", "value"), callback, f"{root}/checkpoint", once=True).awaitTermination()
    return root


@query(f"""
WITH m AS (SELECT symbol, avg(price) AS price, avg(volume) AS volume
           FROM ({v.trades_sql("user_id", "value")}) GROUP BY symbol)
SELECT symbol, kind AS anomaly_type, sev AS severity, detection_method, {v.half_up("score", 6)} AS anomaly_score,
       {v.half_up('m.price', 4)} AS price_at_anomaly, {v.half_up('m.volume', 4)} AS volume_at_anomaly, ctx AS context,
       TIMESTAMP '2024-02-01' AS detected_at
FROM ({v.verdicts_sql(v.LAST_STATS_SQL, 'symbol')}) JOIN m USING (symbol) WHERE is_anomaly""")
def stream_detect(spark, sf):
    stored = tables.read_batches(spark, _detect(spark, sf), ANOMALY_LOGS)
    numbers = {c: F.col(c).cast("double") for c in ("anomaly_score", "price_at_anomaly", "volume_at_anomaly")}
    return stored.withColumns(numbers).select(
        "symbol", "anomaly_type", "severity", "detection_method", *numbers, "context", "detected_at")


@query(f"""
WITH t AS ({v.trades_sql("user_id", "value")}), e AS (SELECT max(ts) AS w_end FROM t),
     w(window_size, d) AS (VALUES ('1d', INTERVAL 1 DAY), ('5d', INTERVAL 5 DAY), ('15d', INTERVAL 15 DAY))
SELECT symbol, window_size, w_end - d AS window_start, w_end AS window_end, count(*) AS trade_count,
       min(price) AS min_price, max(price) AS max_price, {v.half_up("sum(volume)", 4)} AS total_volume
FROM t, e, w WHERE ts >= w_end - d GROUP BY symbol, window_size, w_end, d""")
def stream_trailing_metrics(spark, sf):
    stored = tables.read_batches(spark, _detect(spark, sf), AGGREGATED_METRICS)
    return stored.select("symbol", "window_size", "window_start", "window_end",
                         F.col("trade_count").cast("bigint").alias("trade_count"),
                         *[F.col(c).cast("double").alias(c) for c in ("min_price", "max_price", "total_volume")])


_MILLIS = "(SELECT * REPLACE (date_trunc('milliseconds', ts) AS ts) FROM events)"
_STREAMED_SQL = TRAILING_SQL.replace("FROM events", f"FROM {_MILLIS}")


@query(f"""
WITH {scores_sql("y")
      .replace(",\nq0 AS", f""",
live AS MATERIALIZED (SELECT * FROM ({_STREAMED_SQL}) WHERE window_size = '5d'),
y AS (SELECT symbol, window_start, [{", ".join(f"({f} - mean[{i + 1}]) / scale[{i + 1}]" for i, f in enumerate(FEATURES))}] AS x FROM live, sc),
q0 AS""")},
g AS (SELECT symbol, avg(price) AS price, avg(volume) AS volume FROM ({v.trades_sql("user_id")}) GROUP BY symbol)
SELECT symbol AS key, symbol, 'ml_anomaly' AS anomaly_type,
       CASE WHEN least(1, 0.5 + iso_score) >= 0.85 THEN 'critical' WHEN least(1, 0.5 + iso_score) >= 0.70 THEN 'high'
            WHEN least(1, 0.5 + iso_score) >= 0.55 THEN 'medium' ELSE 'low' END AS severity,
       {v.half_up("least(1, 0.5 + iso_score)", 6)} AS anomaly_score, {v.half_up("g.price", 4)} AS price, {v.half_up("g.volume", 4)} AS volume,
       TIMESTAMP '2024-02-01' AS detected_at
FROM scored_q JOIN g USING (symbol) WHERE iso_score > (SELECT border FROM border)""")
def stream_forest(spark, sf):
    """Trade messages as text, scored by a saved forest in the stream, and what it publishes read back."""
    root = scratch_path(spark, "forest")
    forest(spark, sf).save(f"{root}/model")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSxxx").alias("trade_timestamp")
    texts = v.trades(spark, sf, "user_id").select(F.to_json(F.struct("symbol", "price", "volume", at)).alias("value"))
    texts.write.text(f"{root}/in")
    stream = jobs.trade_stream(spark.readStream.schema("value STRING").text(f"{root}/in"))
    moment = F.lit("2024-02-01 00:00:00").cast("timestamp")
    callback = jobs.detection(f"{root}/out", now=lambda: moment, forest=load(spark, f"{root}/model"), windows=v.DAYS, model_window="5d",
                              publish=lambda found: found.write.mode("append").parquet(f"{root}/topic"))
    jobs.run(stream, callback, f"{root}/checkpoint", once=True).awaitTermination()
    topic = spark.read.schema("key STRING, value STRING").parquet(f"{root}/topic")
    said = messages.decode_anomalies(topic, ["key"]).filter("detection_method = 'isolation_forest'")
    return said.select("key", "symbol", "anomaly_type", "severity", "anomaly_score", "price", "volume", "detected_at")


# Trades of three batches that interleave in time, with many equal ones: symbol, hour and rounded price are all they have.
_BATCHES = 3
_FILLS_SQL = f"""
SELECT event_id % {_BATCHES} AS b, event_type AS symbol, floor(value / 50) * 50 AS price, {v.K} % 5 * 1.0::DOUBLE AS volume,
       date_trunc('hour', ts) AS ts FROM events"""


def fills(events):
    amount = (F.from_json("props", "k INT")["k"] % 5).cast("double")
    return events.select(
        F.pmod("event_id", F.lit(_BATCHES)).alias("b"), F.col("event_type").alias("symbol"), (F.floor(F.col("value") / 50) * 50).cast("double").alias("price"),
        amount.alias("volume"), F.date_trunc("hour", "ts").cast("timestamp").alias("ts"))


def in_batches(spark, sf, root, callback):
    """Each batch's rows arrive, and the same stream goes on from its checkpoint."""
    rows = fills(v.table(spark, sf, "events"))
    for b in range(_BATCHES):
        rows.filter(F.col("b") == b).drop("b").write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.drop("b").schema).parquet(f"{root}/in")
        named = stream.withColumn("id", F.xxhash64("symbol", "price", "volume", "ts")).withWatermark("ts", "30 seconds")
        jobs.run(named, callback, f"{root}/checkpoint", once=True).awaitTermination()


_REACH = (("90m", 5400), ("5h", 18000), ("10d", 864000))


@query(f"""
WITH t AS ({_FILLS_SQL}), e AS (SELECT b, max(ts) AS w_end FROM t GROUP BY b),
     w(window_size, d) AS (VALUES {", ".join(f"('{label}', INTERVAL '{length}' SECOND)" for label, length in _REACH)})
SELECT e.b AS batch_id, symbol, window_size, w_end - d AS window_start, w_end AS window_end, {v.half_up("avg(price)", 4)} AS avg_price,
       {v.half_up("coalesce(stddev_samp(price), 0)", 6)} AS std_dev, sum(volume) AS total_volume, count(*) AS trade_count,
       {v.half_up("CASE WHEN sum(volume) < 1e-9 THEN avg(price) ELSE sum(price * volume) / sum(volume) END", 4)} AS vwap,
       min(price) AS min_price, max(price) AS max_price
FROM t JOIN e ON t.b <= e.b AND t.ts <= e.w_end, w WHERE t.ts >= w_end - d GROUP BY ALL""")
def stream_windows_over_batches(spark, sf):
    """Windows over the batches so far, from their cells of seven hours and the trades that borders cut off."""
    root = scratch_path(spark, "reach")
    in_batches(spark, sf, root, jobs.detection(f"{root}/out", windows=_REACH, history=7 * 3600))
    stored = tables.read_batches(spark, f"{root}/out", AGGREGATED_METRICS)
    return stored.select("batch_id", "symbol", "window_size", "window_start", "window_end", F.col("trade_count").cast("bigint").alias("trade_count"),
                         *[F.col(c).cast("double").alias(c) for c in ("avg_price", "std_dev", "total_volume", "vwap", "min_price", "max_price")])


@query("SELECT DISTINCT conv_id AS id FROM conversations")
def stream_news_dedup(spark, sf):
    root = scratch_path(spark, "news")
    articles = _stream(spark, sf, "conversations").select(
        F.col("conv_id").alias("id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn")).alias("published_at"),
        F.col("text").alias("summary"))
    fresh = jobs.fresh_articles(articles)
    jobs.store(fresh, f"{root}/rows", f"{root}/checkpoint", once=True).awaitTermination()
    return spark.read.schema(fresh.schema).parquet(f"{root}/rows").select("id")
