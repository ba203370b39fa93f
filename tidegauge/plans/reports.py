"""Questions about root-cause reports and their investigation steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalars import DASH, all_of, confidence_band, equals_unless_all, step_label

ANOMALY_COLUMNS = ("severity", "anomaly_type", "detection_method", "price_at_anomaly")


def with_anomaly(reports: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Reports with the columns of the anomaly they explain; reports without one are kept."""
    about = anomalies.select(F.col("id").alias("_anomaly_id"), *ANOMALY_COLUMNS,
                             F.col("detected_at").alias("anomaly_detected_at"))
    return reports.join(about, F.col("anomaly_log_id") == F.col("_anomaly_id"), "left").drop("_anomaly_id")


def newest(reports: DataFrame, anomalies: DataFrame, symbol: str | None = None, limit: int = 100) -> DataFrame:
    """Newest reports, newest first. The limit is taken before the join, which neither drops nor repeats reports
    but may change their order, so they are ordered again."""
    order = F.col("generated_at").desc(), F.col("id").desc()
    chosen = reports.filter(all_of(equals_unless_all("symbol", symbol))).orderBy(*order).limit(limit)
    return with_anomaly(chosen, anomalies).orderBy(*order)


def labelled(reports: DataFrame) -> DataFrame:
    """Report list texts; missing parts become a dash."""
    score = F.col("confidence_score").try_cast("double")
    return reports.withColumns({
        "confidence_label": confidence_band(score),
        "severity_label": F.upper(F.coalesce("severity", F.lit(DASH))),
        "type_label": F.coalesce("anomaly_type", F.lit(DASH)),
    })


def recommendations(reports: DataFrame) -> DataFrame:
    """One row per recommendation, in order."""
    return reports.select("id", F.posexplode("recommendations").alias("position", "recommendation"))


def steps(reports: DataFrame, audit: DataFrame) -> DataFrame:
    """Every report with its investigation steps, one row per step, in time order within a report.

    Steps stay rows: a report with very many steps is spread over tasks like any other rows.
    """
    trail = audit.select(F.col("report_id").alias("_report_id"), F.col("id").alias("step_id"), "executed_at",
                         step_label(F.col("step_name"), F.col("duration_ms")).alias("label"),
                         F.coalesce("step_input", F.lit("{}")).alias("step_input"),
                         F.coalesce("step_output", F.lit("{}")).alias("step_output"),
                         "tool_calls", "duration_ms")
    return (reports.join(trail, F.col("id") == F.col("_report_id"), "left").drop("_report_id")
            .orderBy("id", "executed_at", "step_id"))


def summary(reports: DataFrame) -> DataFrame:
    return reports.agg(
        F.count(F.lit(1)).alias("total_reports"),
        F.avg("confidence_score").alias("avg_confidence"),
        F.avg("tokens_used").alias("avg_tokens"),
        F.count_distinct("symbol").alias("symbols_investigated"),
    )


def confidence_histogram(rows: DataFrame, column: str = "confidence_score", bins: int = 20) -> DataFrame:
    """Counts in equal bins on [0, 1]; the last bin includes 1."""
    score = F.col(column).try_cast("double")
    placed = F.least(F.width_bucket(score, F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins).cast("bigint"))
    return (rows.filter(score.isNotNull()).select(placed.alias("bin"))
            .groupBy("bin").agg(F.count(F.lit(1)).alias("cnt")))
