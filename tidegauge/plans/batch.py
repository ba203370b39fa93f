"""What happens to one set of trades: window metrics, verdicts of all detectors, anomaly events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.detectors import anomaly_events, last_verdicts
from tidegauge.operators.iforest import Forest, isolation_verdicts
from tidegauge.schemas import ANOMALY_LOGS

VERDICT = ("symbol", "detection_method", "anomaly_type", "is_anomaly", "severity", "anomaly_score",
           "value", "context")


def all_verdicts(trades: DataFrame, metrics: DataFrame, forest: Forest | None = None,
                 model_window: str = "5m") -> DataFrame:
    """Verdicts of the statistical detectors on each symbol's last trade and of the forest on its metrics."""
    modelled = isolation_verdicts(metrics.filter(metrics["window_size"] == model_window), forest)
    return last_verdicts(trades).select(*VERDICT).unionByName(modelled.select(*VERDICT))


def events(trades: DataFrame, metrics: DataFrame, now: Column, forest: Forest | None = None) -> DataFrame:
    return anomaly_events(all_verdicts(trades, metrics, forest), trades, now)


def log_rows(anomalies: DataFrame) -> DataFrame:
    """Anomaly events in the columns of the anomaly table; an empty context is stored as null."""
    named = anomalies.withColumn("context", F.nullif(F.col("context"), F.lit("{}"))).withColumnsRenamed({"price": "price_at_anomaly", "volume": "volume_at_anomaly"})
    return named.select(*[c for c, _ in ANOMALY_LOGS.columns if c in named.columns])
