"""The given tables read as trades, quotes, sentiment, news, reports and steps.

Each view exists twice: as a DataFrame, and as a DuckDB query text for the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.detectors import flagged, rolling_verdicts

HOURS = (("1h", 3600), ("5h", 18000), ("15h", 54000))
DAYS = (("1d", 86400), ("5d", 432000), ("15d", 1296000))
LOOKBACK = 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def trades_of(events: DataFrame, symbol: str = "event_type", volume: str = "k", zoned: bool = True) -> DataFrame:
    """Times without zone as stored keep their filters in the scan; streams need zoned ones."""
    moment = F.col("ts").cast("timestamp") if zoned else F.col("ts")
    amount = F.from_json("props", "k INT")["k"].cast("double") if volume == "k" else F.col(volume)
    return events.select(
        F.col("event_id").alias("id"), F.col(symbol).cast("string").alias("symbol"),
        F.col("value").alias("price"), amount.alias("volume"), moment.alias("ts"))


def trades(spark: SparkSession, sf: str, symbol: str = "event_type", volume: str = "k") -> DataFrame:
    return trades_of(table(spark, sf, "events"), symbol, volume)


def newest_event(spark: SparkSession, sf: str) -> Column:
    return table(spark, sf, "events").agg(F.max(F.col("ts").cast("timestamp"))).scalar()


def quote_messages(spark: SparkSession, sf: str) -> DataFrame:
    move = (F.col("o_custkey") % 200 - 100).cast("double")
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("at"),
        F.to_json(F.struct(
            F.col("o_orderpriority").alias("symbol"),
            F.when(F.col("o_orderstatus") != "P", price).alias("c"),
            move.alias("d"), (move / 100).alias("dp"), (price + 1).alias("h"), (price - 1).alias("l"),
            (price - move).alias("o"), (price - move).alias("pc"))).alias("value"))


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    move = (F.col("o_custkey") % 200 - 100).cast("double")
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("symbol"),
        price.alias("current_price"), move.alias("change"), (move / 100).alias("percent_change"),
        (price + 1).alias("high_price"), (price - 1).alias("low_price"), (price - move).alias("open_price"),
        (price - move).alias("prev_close"), F.col("o_orderdate").alias("quoted_at"),
        F.col("o_orderdate").alias("created_at"))


def sentiment(spark: SparkSession, sf: str) -> DataFrame:
    k = F.from_json("props", "k INT")["k"]
    score = F.coalesce(F.nullif(k / 100, F.lit(0.0)), F.col("value") / 500)
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("symbol"),
        score.alias("sentiment_score"), F.col("ts").alias("scored_at"))


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly metric rows per event type."""
    rows = trades(spark, sf)
    total = F.sum("volume")
    return (rows.groupBy("symbol", F.window("ts", "1 hour").alias("w")).agg(
        F.avg("price").alias("avg_price"),
        F.coalesce(F.stddev_samp("price"), F.lit(0.0)).alias("std_dev"),
        total.alias("total_volume"),
        F.count(F.lit(1)).alias("trade_count"),
        F.coalesce(F.try_divide(F.sum(F.col("price") * F.col("volume")), F.nullif(total, F.lit(0.0))),
                   F.avg("price")).alias("vwap"),
        F.min("price").alias("min_price"), F.max("price").alias("max_price"))
        .select("symbol", F.lit("5m").alias("window_size"), F.col("w.start").alias("window_start"),
                F.col("w.end").alias("window_end"), "avg_price", "std_dev", "total_volume", "trade_count",
                "vwap", "min_price", "max_price"))


def anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """Anomaly log: flagged rolling verdicts over all events."""
    found = flagged(rolling_verdicts(trades(spark, sf, volume="value"), LOOKBACK))
    rank = F.array_position(F.array(F.lit("zscore"), F.lit("iqr"), F.lit("volume_spike")), F.col("detection_method"))
    return found.select(
        (F.col("id") * 10 + rank).alias("id"), "symbol", "anomaly_type", "severity", "detection_method",
        "anomaly_score", F.col("price").alias("price_at_anomaly"), F.col("volume").alias("volume_at_anomaly"),
        "context", F.col("ts").alias("detected_at"), F.col("ts").alias("created_at"))


def report_day(key: str) -> Column:
    """A report's time: one minute per key after a fixed start."""
    return F.timestamp_seconds(F.lit(1_700_000_000) + F.col(key) * 60)


def reports(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("anomaly_log_id"), F.col("source").alias("symbol"),
        F.col("text").alias("summary"), ((F.col("n_chars") % 101) / 100).alias("confidence_score"),
        F.col("lang").alias("root_cause_type"), F.split("text", "\n").alias("recommendations"),
        F.col("n_chars").cast("int").alias("tokens_used"), F.concat(F.lit("Report: "), F.col("text")).alias("full_report"),
        F.concat(F.lit("source "), F.col("source")).alias("evidence"), F.col("lang").alias("agent_model"),
        report_day("doc_id").alias("generated_at"))


def reported_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    level = F.array(*[F.lit(s) for s in ("low", "medium", "high", "critical")])
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), level[F.col("quality") * 2 + F.col("toxic")].alias("severity"),
        F.when(F.col("toxic") == 1, "volume_spike").otherwise("price_spike").alias("anomaly_type"),
        F.when(F.col("quality") == 1, "zscore").otherwise("iqr").alias("detection_method"),
        (F.col("doc_id") / 8).alias("price_at_anomaly"), report_day("doc_id").alias("detected_at"))


def audit(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("report_id"),
        F.col("role").alias("step_name"), F.when(F.col("role") == "user", F.col("text")).alias("step_input"),
        F.when(F.col("role") != "user", F.col("text")).alias("step_output"),
        F.lit(None).cast("string").alias("tool_calls"), (F.col("turn") * 7).cast("int").alias("duration_ms"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn")).alias("executed_at"))


def monitored(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    moments = trades(spark, sf)
    return {
        "raw_trades": moments.select(F.col("ts").alias("trade_timestamp"), F.col("ts").alias("created_at")),
        "stock_quotes": quotes(spark, sf).select("quoted_at", "created_at"),
        "sentiment_scores": sentiment(spark, sf).select("scored_at"),
        "aggregated_metrics": metrics(spark, sf).select("window_start", F.col("window_end").alias("created_at")),
        "anomaly_logs": anomalies(spark, sf).select("detected_at", "created_at"),
        "root_cause_reports": reports(spark, sf).select("generated_at"),
        "agent_audit_trail": audit(spark, sf).select("executed_at"),
    }


# DuckDB texts -------------------------------------------------------------------------

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def trades_sql(symbol: str = "event_type", volume: str = "k") -> str:
    amount = f"CAST({K} AS DOUBLE)" if volume == "k" else volume
    return (f"SELECT event_id AS id, CAST({symbol} AS VARCHAR) AS symbol, value AS price, "
            f"{amount} AS volume, ts FROM events")


QUOTES_SQL = """
SELECT o_orderkey AS id, o_orderpriority AS symbol, o_totalprice AS current_price,
       CAST(o_custkey % 200 - 100 AS DOUBLE) AS change, CAST(o_custkey % 200 - 100 AS DOUBLE) / 100 AS percent_change,
       o_totalprice + 1 AS high_price, o_totalprice - 1 AS low_price,
       o_totalprice - (o_custkey % 200 - 100) AS open_price, o_totalprice - (o_custkey % 200 - 100) AS prev_close,
       o_orderdate AS quoted_at, o_orderstatus AS status
FROM orders"""

SENTIMENT_SQL = f"""
SELECT event_id AS id, CAST(user_id AS VARCHAR) AS symbol,
       coalesce(nullif({K} / 100.0::DOUBLE, 0), value / 500) AS sentiment_score, ts AS scored_at
FROM events"""

METRICS_SQL = f"""
SELECT symbol, '5m' AS window_size, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start,
       time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 HOUR AS window_end,
       avg(price) AS avg_price, coalesce(stddev_samp(price), 0) AS std_dev, sum(volume) AS total_volume,
       count(*) AS trade_count,
       CASE WHEN sum(volume) = 0 THEN avg(price) ELSE sum(price * volume) / sum(volume) END AS vwap,
       min(price) AS min_price, max(price) AS max_price
FROM ({trades_sql()}) GROUP BY ALL"""


def rolling_sql(rows: int = LOOKBACK) -> str:
    """History statistics of each trade over the rows before it."""
    return f"""
SELECT *, count(price) OVER w AS n, avg(price) OVER w AS mean, stddev_samp(price) OVER w AS sd,
       quantile_cont(price, 0.25) OVER w AS q1, quantile_cont(price, 0.75) OVER w AS q3, avg(volume) OVER w AS av
FROM ({trades_sql(volume="value")})
WINDOW w AS (PARTITION BY symbol ORDER BY ts, id ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"""


def half_up(value: str, digits: int) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(38, {digits + 5})), {digits}) AS DOUBLE)"


def verdicts_sql(stats: str, keep: str) -> str:
    """All three verdicts for rows with columns price, volume, n, mean, sd, q1, q3, av."""
    return f"""
SELECT {keep}, 'zscore' AS detection_method, 1 AS rank, price AS value,
       CASE WHEN n >= 5 AND sd >= 1e-9 THEN abs((price - mean) / sd) END AS score,
       coalesce(score >= 3, false) AS is_anomaly, 'price_spike' AS kind,
       CASE WHEN score >= 5 THEN 'critical' WHEN score >= 4 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS sev,
       to_json({{'z_score': {half_up('CASE WHEN n >= 5 AND sd >= 1e-9 THEN (price - mean) / sd END', 4)}, 'mean': {half_up('mean', 4)},
                 'std': {half_up('sd', 4)}, 'threshold': 3.0::DOUBLE}})::VARCHAR AS ctx
FROM ({stats})
UNION ALL
SELECT {keep}, 'iqr', 2, price,
       CASE WHEN n >= 5 AND q3 - q1 >= 1e-9
            THEN greatest(price - (q3 + 1.5 * (q3 - q1)), (q1 - 1.5 * (q3 - q1)) - price) / (q3 - q1) END AS score,
       coalesce(score IS NOT NULL AND (price > q3 + 1.5 * (q3 - q1) OR price < q1 - 1.5 * (q3 - q1)), false), 'price_outlier',
       CASE WHEN score >= 9 THEN 'critical' WHEN score >= 6 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END,
       to_json({{'q1': {half_up('q1', 4)}, 'q3': {half_up('q3', 4)}, 'iqr': {half_up('q3 - q1', 4)},
                 'lower_fence': {half_up('q1 - 1.5 * (q3 - q1)', 4)}, 'upper_fence': {half_up('q3 + 1.5 * (q3 - q1)', 4)},
                 'k': 1.5::DOUBLE}})::VARCHAR
FROM ({stats})
UNION ALL
SELECT {keep}, 'volume_spike', 3, volume,
       CASE WHEN n >= 3 AND av >= 1e-9 THEN volume / av END AS score,
       coalesce(score >= 5, false), 'volume_spike',
       CASE WHEN score >= 20 THEN 'critical' WHEN score >= 10 THEN 'high' WHEN score >= 7.5 THEN 'medium' ELSE 'low' END,
       to_json({{'current_volume': {half_up('volume', 4)}, 'avg_volume': {half_up('av', 4)},
                 'ratio': {half_up('CASE WHEN n >= 3 AND av >= 1e-9 THEN volume / av END', 4)}, 'threshold': 5.0::DOUBLE}})::VARCHAR
FROM ({stats})"""


VERDICT_SQL = f"""detection_method, is_anomaly, CASE WHEN is_anomaly THEN kind ELSE 'none' END AS anomaly_type,
       CASE WHEN is_anomaly THEN sev ELSE 'low' END AS severity,
       {half_up("CASE WHEN is_anomaly THEN score ELSE 0 END", 6)} AS anomaly_score, {half_up("value", 6)} AS value,
       CASE WHEN is_anomaly THEN ctx END AS context"""

ANOMALIES_SQL = f"""
SELECT id * 10 + rank AS id, symbol, kind AS anomaly_type, sev AS severity, detection_method, score AS anomaly_score,
       price AS price_at_anomaly, volume AS volume_at_anomaly, ctx AS context, ts AS detected_at
FROM ({verdicts_sql(rolling_sql(), "id, symbol, ts, price, volume")}) WHERE is_anomaly"""

LAST_STATS_SQL = f"""
SELECT h.*, l.price, l.volume FROM (
  SELECT symbol, count(*) AS n, avg(price) AS mean, stddev_samp(price) AS sd, quantile_cont(price, 0.25) AS q1,
         quantile_cont(price, 0.75) AS q3, avg(volume) AS av
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, id DESC) AS rn
        FROM ({trades_sql("user_id", "value")})) WHERE rn > 1 GROUP BY symbol) h
JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, id DESC) AS rn
      FROM ({trades_sql("user_id", "value")})) WHERE rn = 1) l USING (symbol)"""

REPORT_TIME = "TIMESTAMP '2023-11-14 22:13:20'"

REPORTS_SQL = f"""
SELECT doc_id AS id, doc_id AS anomaly_log_id, source AS symbol, text AS summary, (n_chars % 101) / 100.0::DOUBLE AS confidence_score,
       lang AS root_cause_type, n_chars AS tokens_used, 'Report: ' || text AS full_report, 'source ' || source AS evidence, lang AS agent_model, {REPORT_TIME} + to_seconds(doc_id * 60) AS generated_at
FROM documents"""

REPORTED_SQL = f"""
SELECT doc_id AS id, ['low', 'medium', 'high', 'critical'][quality * 2 + toxic + 1] AS severity,
       CASE WHEN toxic = 1 THEN 'volume_spike' ELSE 'price_spike' END AS anomaly_type,
       CASE WHEN quality = 1 THEN 'zscore' ELSE 'iqr' END AS detection_method,
       doc_id / 8.0::DOUBLE AS price_at_anomaly, {REPORT_TIME} + to_seconds(doc_id * 60) AS detected_at
FROM labels"""
