"""Queries on prices, sentiment, anomalies, reports and system health."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from catalog.registry import query
from tidegauge.operators.sharding import segment_starts
from tidegauge.runtime import cut
from tidegauge.functions.scalars import confidence_band, seconds
from tidegauge.plans import anomalies, health, prices, reports

NOW_SQL = "(SELECT max(ts) FROM events)"
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE")


# prices ---------------------------------------------------------------------------------

def _position():
    """Place of a row in a result of few ordered rows, which are one partition."""
    return F.monotonically_increasing_id() + 1


def in_order(rows):
    """An ordered result of any length with each row's place in it: the index in its partition after those before."""
    numbered = rows.withColumn("_part", F.spark_partition_id()).withColumn(
        "_index", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    fixed = cut(numbered)
    starts = segment_starts(fixed.withColumnRenamed("_part", "_seg"), F.lit(1))
    return (fixed.join(F.broadcast(starts), fixed["_part"] == starts["_seg"])
            .withColumn("position", F.col("_start") + F.col("_index") + 1))


@query(f"""
SELECT id, symbol, price, volume, ts AS trade_timestamp FROM ({v.trades_sql()})
WHERE symbol = 'view' AND ts >= {NOW_SQL} - INTERVAL 7 DAY""", settle=False)
def recent_trades(spark, sf):
    events = v.table(spark, sf, "events")
    rows = v.trades_of(events, zoned=False).withColumnRenamed("ts", "trade_timestamp")
    return prices.recent_trades(rows, "view", events.agg(F.max("ts")).scalar(), 7 * 24 * 60)


@query(f"""
SELECT row_number() OVER (ORDER BY window_start DESC) AS position, symbol, window_size, window_start, window_end,
       {v.half_up("avg_price", 6)} AS avg_price, {v.half_up("std_dev", 6)} AS std_dev, {v.half_up("total_volume", 6)} AS total_volume, trade_count, {v.half_up("vwap", 6)} AS vwap, min_price, max_price
FROM ({v.METRICS_SQL}) WHERE symbol = 'view' AND window_size = '5m' ORDER BY window_start DESC LIMIT 100""")
def metrics_latest(spark, sf):
    return prices.metrics_latest(v.metrics(spark, sf), "view", "5m", 100).withColumn("position", _position())


_LATEST_QUOTE_SQL = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY quoted_at DESC, id DESC) AS rn
               FROM ({v.QUOTES_SQL})) WHERE rn = 1"""


@query(f"""
SELECT symbol, current_price, change, percent_change, high_price,
       low_price, quoted_at FROM ({_LATEST_QUOTE_SQL})""", settle=False)
def latest_quote(spark, sf):
    return prices.latest_quotes(v.quotes(spark, sf))


_LATEST_SENTIMENT_SQL = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY scored_at DESC, id DESC) AS rn
               FROM ({v.SENTIMENT_SQL})) WHERE rn = 1"""


@query(f"SELECT symbol, sentiment_score, scored_at FROM ({_LATEST_SENTIMENT_SQL})", settle=False)
def latest_sentiment(spark, sf):
    return prices.latest_sentiment(v.sentiment(spark, sf))


@query(f"""
SELECT w.symbol, CASE WHEN q.id IS NULL THEN '—' ELSE printf('$%.2f', q.current_price) END AS price,
       CASE WHEN q.id IS NULL THEN 'no data' ELSE printf('%+.2f%%', q.percent_change) END AS delta
FROM (VALUES {", ".join(f"('{p}')" for p in PRIORITIES)}) w(symbol) LEFT JOIN ({_LATEST_QUOTE_SQL}) q USING (symbol)""")
def ticker_snapshot(spark, sf):
    return prices.ticker_snapshot(v.quotes(spark, sf), PRIORITIES)


@query(f"""
SELECT row_number() OVER (ORDER BY quoted_at, id) AS position, symbol, current_price, change, percent_change, high_price,
       low_price, open_price, prev_close, quoted_at
FROM ({v.QUOTES_SQL}) WHERE quoted_at >= TIMESTAMP '2001-01-01' - INTERVAL 8760 HOUR""", settle=False)
def quote_history(spark, sf):
    now = F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")
    rows = prices.quote_history(v.quotes(spark, sf), now, 8760)
    return in_order(rows).select("position", *prices.QUOTE_COLUMNS)


@query(f"""
SELECT id, symbol, quoted_at, current_price, current_price / first_value(current_price) OVER (PARTITION BY symbol ORDER BY quoted_at, id) * 100 AS normalised FROM ({v.QUOTES_SQL})""", settle=False)
def normalized_prices(spark, sf):
    return prices.normalised_prices(v.quotes(spark, sf))


@query(f"""
SELECT symbol, arg_min(current_price, (quoted_at, id)) AS first_value, arg_max(current_price, (quoted_at, id)) AS last_value,
       count(*) AS points, {v.half_up("(last_value - first_value) / first_value * 100", 6)} AS pct_change,
       last_value >= first_value AS is_up FROM ({v.QUOTES_SQL}) GROUP BY symbol""")
def pct_change(spark, sf):
    return prices.price_change(v.quotes(spark, sf))


@query(f"""
WITH p AS (SELECT symbol, greatest(0, least(1, coalesce(nullif(sentiment_score, 0), 0.5))) * 100 AS pct
           FROM ({_LATEST_SENTIMENT_SQL}))
SELECT symbol, {v.half_up("pct", 6)} AS percent,
       CASE WHEN pct >= 60 THEN 'Bullish' WHEN pct >= 40 THEN 'Neutral' ELSE 'Bearish' END AS band,
       {v.half_up("pct - 50", 6)} AS delta FROM p""")
def sentiment_gauge(spark, sf):
    return prices.sentiment_gauge(v.sentiment(spark, sf))


@query(f"""
SELECT id, symbol, scored_at, sentiment_score, 0.6::DOUBLE AS bullish_line,
       0.4::DOUBLE AS bearish_line
FROM ({v.SENTIMENT_SQL}) WHERE scored_at >= {NOW_SQL} - INTERVAL 72 HOUR""", settle=False)
def sentiment_history(spark, sf):
    now = v.table(spark, sf, "events").agg(F.max("ts")).scalar()
    return prices.sentiment_history(v.sentiment(spark, sf), now, 72)


# anomalies ------------------------------------------------------------------------------

_FILTERED_SQL = f"""
SELECT * FROM ({v.ANOMALIES_SQL}) WHERE detected_at >= {NOW_SQL} - INTERVAL 168 HOUR
ORDER BY detected_at DESC, id DESC LIMIT 500"""


def _week(spark, sf, **filters):
    since = v.newest_event(spark, sf) - seconds(168 * 3600)
    return anomalies.newest(v.anomalies(spark, sf), since, **filters)


@query(f"""
SELECT id, symbol, anomaly_type, severity, detection_method, {v.half_up("anomaly_score", 6)} AS anomaly_score, price_at_anomaly,
       volume_at_anomaly, context, detected_at
FROM ({v.ANOMALIES_SQL}) WHERE detected_at >= {NOW_SQL} - INTERVAL 168 HOUR AND severity = 'low'
     AND detection_method = 'iqr' ORDER BY detected_at DESC, id DESC LIMIT 500""")
def anomaly_filter(spark, sf):
    return _week(spark, sf, symbol="All", severity="low", method="iqr")


@query(f"""
SELECT id, symbol, detected_at, anomaly_type, detection_method, severity,
       upper(severity[1]) || severity[2:] AS severity_label,
       list_position(['low', 'medium', 'high', 'critical'], severity)::BIGINT AS severity_rank,
       {v.half_up("anomaly_score", 6)} AS anomaly_score, {v.half_up("least(anomaly_score, 20) + 6", 6)} AS bubble_size
FROM ({_FILTERED_SQL})""")
def anomaly_timeline(spark, sf):
    return anomalies.timeline(_week(spark, sf))


@query(f"SELECT count(DISTINCT symbol) AS symbols, greatest(300, count(DISTINCT symbol) * 60 + 100) AS height FROM ({_FILTERED_SQL})")
def timeline_size(spark, sf):
    return anomalies.timeline_size(_week(spark, sf))


@query(f"""SELECT symbol, detection_method, count(*) AS "count" FROM ({_FILTERED_SQL}) GROUP BY ALL""")
def anomaly_breakdown(spark, sf):
    return anomalies.breakdown(_week(spark, sf))


@query(f"SELECT severity, count(*) AS cnt FROM ({v.ANOMALIES_SQL}) GROUP BY severity")
def severity_counts(spark, sf):
    return anomalies.severity_counts(v.anomalies(spark, sf))


@query("SELECT " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}"
                             for s in ("low", "medium", "high", "critical")) + f" FROM ({v.ANOMALIES_SQL})")
def severity_pivot(spark, sf):
    return anomalies.severity_columns(v.anomalies(spark, sf))


@query(f"""
SELECT severity, count(*) AS cnt FROM ({v.ANOMALIES_SQL})
WHERE detected_at >= {NOW_SQL} - INTERVAL 24 HOUR GROUP BY severity""")
def severity_recent(spark, sf):
    return anomalies.severity_counts(v.anomalies(spark, sf), v.newest_event(spark, sf) - seconds(86400))


@query(f"""
SELECT id, symbol, CASE anomaly_type WHEN 'price_spike' THEN 'Price Spike' WHEN 'price_outlier' THEN 'Price Outlier'
       ELSE 'Volume Spike' END AS title, upper(severity) AS severity, detection_method AS method,
       printf('%.4f', anomaly_score) AS score, printf('$%.4f', price_at_anomaly) AS price,
       printf('%.2f', volume_at_anomaly) AS volume, context, detected_at
FROM ({_FILTERED_SQL}) ORDER BY detected_at DESC, id DESC LIMIT 50""")
def anomaly_cards(spark, sf):
    return anomalies.cards(_week(spark, sf), 50)


@query(f"""
SELECT id, symbol, detected_at, {", ".join(f"CAST(json_extract_string(context, '$.{k}') AS DOUBLE) AS {k}"
                                           for k in anomalies.CONTEXT_KEYS["iqr"])}
FROM ({v.ANOMALIES_SQL}) WHERE detection_method = 'iqr'""")
def anomaly_context(spark, sf):
    return anomalies.context_fields(v.anomalies(spark, sf), "iqr")


# reports --------------------------------------------------------------------------------

@query(f"""
SELECT row_number() OVER (ORDER BY r.generated_at DESC, r.id DESC) AS position, r.evidence, r.agent_model, r.tokens_used,
       md5(r.full_report) AS full_report, md5(array_to_string(string_split(r.summary, chr(10)), '|')) AS recommendations,
       r.id, r.anomaly_log_id, r.symbol, r.root_cause_type, r.summary, {v.half_up("r.confidence_score", 6)} AS confidence_score,
       r.generated_at, a.severity, a.anomaly_type, a.detection_method, a.price_at_anomaly,
       a.detected_at AS anomaly_detected_at,
       printf('%d%%', round(confidence_score * 100)::INTEGER) || CASE WHEN confidence_score >= 0.7 THEN ' (High)'
         WHEN confidence_score >= 0.4 THEN ' (Medium)' ELSE ' (Low)' END AS confidence_label,
       upper(coalesce(severity, '—')) AS severity_label, coalesce(anomaly_type, '—') AS type_label
FROM (SELECT * FROM ({v.REPORTS_SQL}) ORDER BY generated_at DESC, id DESC LIMIT 100) r
LEFT JOIN ({v.REPORTED_SQL}) a ON r.anomaly_log_id = a.id""")
def report_list(spark, sf):
    rows = reports.newest(v.reports(spark, sf), v.reported_anomalies(spark, sf))
    # Long texts are compared by digest; the position shows the order of the result.
    shown = {"full_report": F.md5(F.col("full_report").cast("binary")),
             "recommendations": F.md5(F.array_join("recommendations", "|").cast("binary")),
             "tokens_used": F.col("tokens_used").cast("bigint"), "position": _position()}
    return reports.labelled(rows).withColumns(shown)


@query(f"""
SELECT r.id, r.anomaly_log_id, r.symbol, a.severity, a.anomaly_type, a.detection_method, a.price_at_anomaly,
       a.detected_at AS anomaly_detected_at
FROM ({v.REPORTS_SQL}) r LEFT JOIN ({v.REPORTED_SQL}) a ON r.anomaly_log_id = a.id""")
def report_anomaly_join(spark, sf):
    rows = reports.with_anomaly(v.reports(spark, sf), v.reported_anomalies(spark, sf))
    return rows.select("id", "anomaly_log_id", "symbol", *reports.ANOMALY_COLUMNS, "anomaly_detected_at")


@query(f"""
SELECT r.id, r.symbol, c.conv_id * 1000 + c.turn AS step_id, {v.REPORT_TIME} + to_seconds(c.turn) AS executed_at,
       'Step: ' || c.role || CASE WHEN c.turn <> 0 THEN ' (' || c.turn * 7 || ' ms)' ELSE '' END AS label,
       CASE WHEN c.conv_id IS NOT NULL THEN CASE WHEN c.role = 'user' THEN c.text ELSE '{{}}' END END AS step_input,
       CASE WHEN c.conv_id IS NOT NULL THEN CASE WHEN c.role <> 'user' THEN c.text ELSE '{{}}' END END AS step_output
FROM ({v.REPORTS_SQL}) r LEFT JOIN conversations c ON r.id = c.conv_id""")
def report_steps(spark, sf):
    chosen = v.reports(spark, sf).select("id", "symbol")
    return reports.steps(chosen, v.audit(spark, sf)).drop("tool_calls", "duration_ms")


@query("""
SELECT doc_id AS id, (unnest(range(len(string_split(text, chr(10))))))::INTEGER AS position,
       unnest(string_split(text, chr(10))) AS recommendation FROM documents""")
def recommendation_rows(spark, sf):
    return reports.recommendations(v.reports(spark, sf))


@query(f"""
SELECT count(*) AS total_reports, {v.half_up("avg(confidence_score)", 6)} AS avg_confidence, {v.half_up("avg(tokens_used)", 6)} AS avg_tokens,
       count(DISTINCT symbol) AS symbols_investigated FROM ({v.REPORTS_SQL})""")
def report_summary(spark, sf):
    return reports.summary(v.reports(spark, sf))


@query("""
SELECT least(floor(l_discount * 10 * 20)::BIGINT + 1, 20) AS bin, count(*) AS cnt
FROM lineitem GROUP BY bin""")
def confidence_hist(spark, sf):
    rows = v.table(spark, sf, "lineitem").select((F.col("l_discount") * 10).alias("confidence_score"))
    return reports.confidence_histogram(rows)


@query(f"""
SELECT id, printf('%d%%', round(confidence_score * 100)::INTEGER) || CASE WHEN confidence_score >= 0.7 THEN ' (High)'
         WHEN confidence_score >= 0.4 THEN ' (Medium)' ELSE ' (Low)' END AS label FROM ({v.REPORTS_SQL})""")
def confidence_labels(spark, sf):
    return v.reports(spark, sf).select("id", confidence_band(F.col("confidence_score")).alias("label"))


# health ---------------------------------------------------------------------------------

_COUNT_SQL = {
    "raw_trades": "SELECT count(*) FROM events",
    "stock_quotes": "SELECT count(*) FROM orders",
    "sentiment_scores": "SELECT count(*) FROM events",
    "aggregated_metrics": f"SELECT count(*) FROM ({v.METRICS_SQL})",
    "anomaly_logs": f"SELECT count(*) FROM ({v.ANOMALIES_SQL})",
    "root_cause_reports": "SELECT count(*) FROM documents",
    "agent_audit_trail": "SELECT count(*) FROM conversations",
}


@query(" UNION ALL ".join(
    f"SELECT '{name}' AS table_name, n AS row_count, format('{{:,}}', n) AS rows_text FROM ({sql}) t(n)"
    for name, sql in _COUNT_SQL.items()))
def table_counts(spark, sf):
    return health.counts_text(health.table_counts(v.monitored(spark, sf)))


@query(f"""
SELECT label, strftime(t, '%Y-%m-%d %H:%M:%S') AS latest FROM (
  SELECT 'Last trade' AS label, max(ts) AS t FROM events UNION ALL
  SELECT 'Last quote', max(o_orderdate) FROM orders UNION ALL
  SELECT 'Last sentiment', max(ts) FROM events UNION ALL
  SELECT 'Last anomaly', max(detected_at) FROM ({v.ANOMALIES_SQL}) UNION ALL
  SELECT 'Last report', max(generated_at) FROM ({v.REPORTS_SQL}))""")
def freshness(spark, sf):
    kept = v.monitored(spark, sf)
    return health.freshness({name: kept[name] for name in health.LATEST})


@query(f"""
SELECT 'raw_trades (86400s)' AS label, count(*) AS row_count FROM events WHERE ts >= {NOW_SQL} - INTERVAL 86400 SECOND UNION ALL
SELECT 'stock_quotes (86400s)', count(*) FROM orders WHERE o_orderdate >= {NOW_SQL} - INTERVAL 86400 SECOND UNION ALL
SELECT 'aggregated_metrics (86400s)', count(*) FROM ({v.METRICS_SQL}) WHERE window_end >= {NOW_SQL} - INTERVAL 86400 SECOND UNION ALL
SELECT 'anomaly_logs (86400s)', count(*) FROM ({v.ANOMALIES_SQL}) WHERE detected_at >= {NOW_SQL} - INTERVAL 86400 SECOND""")
def throughput(spark, sf):
    kept = v.monitored(spark, sf)
    streamed = ("raw_trades", "stock_quotes", "aggregated_metrics", "anomaly_logs")
    return health.throughput({name: kept[name] for name in streamed}, v.newest_event(spark, sf), 86400)


@query(" UNION ALL ".join(
    f"SELECT '{health.COMPONENTS[name]}' AS component, CASE WHEN n > 0 THEN 'RUNNING' ELSE 'NO DATA' END AS status "
    f"FROM ({sql}) t(n)" for name, sql in _COUNT_SQL.items() if name in health.COMPONENTS))
def component_status(spark, sf):
    return health.component_status(v.monitored(spark, sf))


@query(f"""
SELECT 'Trades Ingested' AS label, count(*) AS n FROM events UNION ALL
SELECT 'Anomalies Detected', count(*) FROM ({v.ANOMALIES_SQL}) UNION ALL
SELECT 'Root Cause Reports', count(*) FROM documents UNION ALL
SELECT 'Symbols Active', count(DISTINCT o_orderpriority) FROM orders""")
def home_stats(spark, sf):
    kept = v.monitored(spark, sf)
    return health.home_statistics(kept["raw_trades"], kept["anomaly_logs"], kept["root_cause_reports"],
                                  v.quotes(spark, sf))


@query(f"SELECT DISTINCT symbol FROM ({v.trades_sql('user_id')})")
def active_symbols(spark, sf):
    return v.trades(spark, sf, "user_id").select("symbol").distinct()
