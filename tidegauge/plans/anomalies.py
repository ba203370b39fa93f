"""Questions about logged anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalars import (DASH, all_of, at_or_after, bubble_size, chart_height, equals_unless_all, fixed,
                                         seconds, severity_rank, title_words)
from tidegauge.schemas import SEVERITIES

COLUMNS = ("id", "symbol", "anomaly_type", "severity", "detection_method", "anomaly_score",
           "price_at_anomaly", "volume_at_anomaly", "context", "detected_at")


def newest(anomalies: DataFrame, since: Column, symbol: str | None = None, severity: str | None = None,
           method: str | None = None, limit: int = 500) -> DataFrame:
    """Newest anomalies under the given filters; None or "All" leaves a filter out."""
    wanted = all_of([at_or_after(anomalies, "detected_at", since),
                     *equals_unless_all("symbol", symbol),
                     *equals_unless_all("severity", severity),
                     *equals_unless_all("detection_method", method)])
    return (anomalies.filter(wanted).select(*[c for c in COLUMNS if c in anomalies.columns])
            .orderBy(F.col("detected_at").desc(), F.col("id").desc()).limit(limit))


def timeline(rows: DataFrame) -> DataFrame:
    """Chart points: bubble size, severity order and label."""
    score = F.col("anomaly_score").try_cast("double")
    return rows.select("id", "symbol", "detected_at", "anomaly_type", "detection_method", "severity",
                       F.initcap("severity").alias("severity_label"),
                       severity_rank(F.col("severity")).alias("severity_rank"),
                       score.alias("anomaly_score"), bubble_size(score).alias("bubble_size"))


def timeline_size(rows: DataFrame) -> DataFrame:
    """Number of symbols on the timeline and the chart height it needs."""
    return rows.agg(F.count_distinct("symbol").alias("symbols")).withColumn("height", chart_height(F.col("symbols")))


def breakdown(rows: DataFrame) -> DataFrame:
    return rows.groupBy("symbol", "detection_method").agg(F.count(F.lit(1)).alias("count"))


def cards(rows: DataFrame, limit: int = 50) -> DataFrame:
    """Detail texts of the first rows."""
    level = F.lower(F.coalesce(F.when(F.col("severity") != "", F.col("severity")), F.lit("low")))
    return (rows.orderBy(F.col("detected_at").desc(), F.col("id").desc()).limit(limit).select(
        "id",
        F.coalesce("symbol", F.lit("?")).alias("symbol"),
        title_words(F.coalesce("anomaly_type", F.lit("unknown"))).alias("title"),
        F.upper(level).alias("severity"),
        F.coalesce("detection_method", F.lit(DASH)).alias("method"),
        fixed("%.4f", F.col("anomaly_score").cast("double")).alias("score"),
        fixed("$%.4f", F.col("price_at_anomaly").cast("double")).alias("price"),
        fixed("%.2f", F.col("volume_at_anomaly").cast("double")).alias("volume"),
        "context", "detected_at"))


# The context keys of each method.
CONTEXT_KEYS = {
    "zscore": ("z_score", "mean", "std", "threshold"),
    "iqr": ("q1", "q3", "iqr", "lower_fence", "upper_fence", "k"),
    "volume_spike": ("current_volume", "avg_volume", "ratio", "threshold"),
}


def context_fields(rows: DataFrame, method: str) -> DataFrame:
    """Anomalies of one method with their context decoded into columns."""
    schema = ", ".join(f"{key} DOUBLE" for key in CONTEXT_KEYS[method])
    return (rows.filter(F.col("detection_method") == method)
            .select("id", "symbol", "detected_at", F.from_json("context", schema).alias("c"))
            .select("id", "symbol", "detected_at", "c.*"))


def severity_counts(anomalies: DataFrame, since: Column | None = None) -> DataFrame:
    rows = anomalies if since is None else anomalies.filter(at_or_after(anomalies, "detected_at", since))
    return rows.groupBy("severity").agg(F.count(F.lit(1)).alias("cnt"))


def severity_columns(anomalies: DataFrame) -> DataFrame:
    """One row with a count per severity, 0 where there is none."""
    return anomalies.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def last_hour(now: Column) -> Column:
    return now - seconds(3600)
