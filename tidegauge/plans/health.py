"""Monitoring questions over all tables: sizes, freshness, throughput, component state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalars import DASH, seconds

# Component shown for each table, and the label of each table's newest time.
COMPONENTS = {
    "raw_trades": "WebSocket Trade Producer",
    "stock_quotes": "Quote Producer (REST)",
    "sentiment_scores": "Sentiment Producer (REST)",
    "aggregated_metrics": "Spark Stream Consumer",
    "anomaly_logs": "Anomaly Detection Engine",
    "root_cause_reports": "Root Cause Agent",
}
LATEST = {
    "raw_trades": ("Last trade", "trade_timestamp"),
    "stock_quotes": ("Last quote", "quoted_at"),
    "sentiment_scores": ("Last sentiment", "scored_at"),
    "anomaly_logs": ("Last anomaly", "detected_at"),
    "root_cause_reports": ("Last report", "generated_at"),
}


def _stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return _stacked([t.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
                     for name, t in tables.items()])


def counts_text(counts: DataFrame) -> DataFrame:
    """Row counts with thousands separators."""
    return counts.withColumn("rows_text", F.format_number("row_count", 0))


def component_status(tables: dict[str, DataFrame]) -> DataFrame:
    """RUNNING for a component whose table has rows, NO DATA otherwise."""
    counts = table_counts({name: t.limit(1) for name, t in tables.items() if name in COMPONENTS})
    name = F.element_at(F.create_map(*[F.lit(x) for pair in COMPONENTS.items() for x in pair]), F.col("table_name"))
    return counts.select(name.alias("component"),
                         F.when(F.col("row_count") > 0, "RUNNING").otherwise("NO DATA").alias("status"))


def freshness(tables: dict[str, DataFrame]) -> DataFrame:
    """Newest time of each table as text, a dash for an empty one."""
    parts = []
    for name, rows in tables.items():
        label, time = LATEST[name]
        text = F.date_format(F.max(time), "yyyy-MM-dd HH:mm:ss")
        parts.append(rows.agg(F.lit(label).alias("label"), F.coalesce(text, F.lit(DASH)).alias("latest")))
    return _stacked(parts)


def throughput(tables: dict[str, DataFrame], now: Column, length: int = 60) -> DataFrame:
    """Rows created in the last `length` seconds of each table."""
    return _stacked([
        t.filter(F.col("created_at") >= now - seconds(length))
        .agg(F.lit(f"{name} ({length}s)").alias("label"), F.count(F.lit(1)).alias("row_count"))
        for name, t in tables.items()])


def home_statistics(trades: DataFrame, anomalies: DataFrame, reports: DataFrame, quotes: DataFrame) -> DataFrame:
    """Trades, anomalies, reports and active symbols, one row each."""
    one = F.count(F.lit(1)).alias("n")
    return _stacked([
        trades.agg(F.lit("Trades Ingested").alias("label"), one),
        anomalies.agg(F.lit("Anomalies Detected").alias("label"), one),
        reports.agg(F.lit("Root Cause Reports").alias("label"), one),
        quotes.agg(F.lit("Symbols Active").alias("label"), F.count_distinct("symbol").alias("n")),
    ])
