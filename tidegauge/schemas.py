"""Wire messages, stored tables and result records."""

from __future__ import annotations

from dataclasses import dataclass

# Severity levels from mild to grave.
SEVERITIES = ("low", "medium", "high", "critical")

# Detector names as they appear in verdicts and filters.
METHODS = ("zscore", "iqr", "volume_spike", "isolation_forest")

# Default watch list.
SYMBOLS = ("AAPL", "TSLA", "AMZN", "MSFT", "GOOGL")
CRYPTO_SYMBOLS = ("BINANCE:BTCUSDT",)

# Topic per message kind.
TOPICS = {
    "trades": "stock-trades",
    "quotes": "stock-quotes",
    "news": "market-news",
    "sentiment": "sentiment",
    "anomalies": "anomalies",
}

# Trailing windows (label, seconds).
WINDOWS = (("1m", 60), ("5m", 300), ("15m", 900))

# Model features in matrix order.
FEATURES = ("avg_price", "total_volume", "std_dev", "vwap", "trade_count")

TRADE_MSG = "symbol STRING, price DOUBLE, volume DOUBLE, trade_timestamp STRING, conditions ARRAY<STRING>"
QUOTE_MSG = "symbol STRING, c DOUBLE, d DOUBLE, dp DOUBLE, h DOUBLE, l DOUBLE, o DOUBLE, pc DOUBLE"
NEWS_MSG = (
    "id BIGINT, category STRING, datetime BIGINT, headline STRING, related STRING, "
    "source STRING, summary STRING, url STRING"
)
SENTIMENT_MSG = (
    "symbol STRING, companyNewsScore DOUBLE, sectorAverageBullishPercent DOUBLE, "
    "sectorAverageBearishPercent DOUBLE, "
    "buzz STRUCT<articlesInLastWeek: INT, weeklyAverage: DOUBLE>, "
    "sentiment STRUCT<bullishPercent: DOUBLE>"
)
ANOMALY_MSG = (
    "symbol STRING, anomaly_type STRING, severity STRING, detection_method STRING, "
    "anomaly_score DOUBLE, price DOUBLE, volume DOUBLE, detected_at STRING, context STRING"
)
FEED_ENVELOPE = (
    "type STRING, data ARRAY<STRUCT<s: STRING, p: DOUBLE, v: DOUBLE, t: BIGINT, c: ARRAY<STRING>>>"
)

FOREST_NODE = "tree INT, node INT, feature INT, split DOUBLE, size INT, depth INT"


@dataclass(frozen=True)
class Table:
    """A stored table: columns in order, its time column, and the declared constraints."""

    name: str
    columns: tuple[tuple[str, str], ...]
    time: str
    not_null: tuple[str, ...] = ()
    allowed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    parents: tuple[tuple[str, str], ...] = ()  # (column, parent table), parent key is `id`

    @property
    def day(self) -> str:
        """Partition column: the UTC day of the time column."""
        return f"{self.time}_day"

    def ddl(self) -> str:
        return ", ".join(f"{name} {kind}" for name, kind in self.columns)


RAW_TRADES = Table(
    "raw_trades",
    (("id", "BIGINT"), ("symbol", "STRING"), ("price", "DECIMAL(12,4)"), ("volume", "DECIMAL(20,4)"),
     ("trade_timestamp", "TIMESTAMP"), ("conditions", "ARRAY<STRING>"), ("created_at", "TIMESTAMP")),
    time="trade_timestamp",
    not_null=("trade_timestamp",),
)
AGGREGATED_METRICS = Table(
    "aggregated_metrics",
    (("id", "BIGINT"), ("symbol", "STRING"), ("window_size", "STRING"), ("window_start", "TIMESTAMP"),
     ("window_end", "TIMESTAMP"), ("avg_price", "DECIMAL(12,4)"), ("std_dev", "DECIMAL(12,6)"),
     ("total_volume", "DECIMAL(20,4)"), ("trade_count", "INT"), ("vwap", "DECIMAL(12,4)"),
     ("min_price", "DECIMAL(12,4)"), ("max_price", "DECIMAL(12,4)"), ("created_at", "TIMESTAMP")),
    time="window_start",
    not_null=("window_start", "window_end"),
)
STOCK_QUOTES = Table(
    "stock_quotes",
    (("id", "BIGINT"), ("symbol", "STRING"), ("current_price", "DECIMAL(12,4)"), ("change", "DECIMAL(12,4)"),
     ("percent_change", "DECIMAL(8,4)"), ("high_price", "DECIMAL(12,4)"), ("low_price", "DECIMAL(12,4)"),
     ("open_price", "DECIMAL(12,4)"), ("prev_close", "DECIMAL(12,4)"), ("quoted_at", "TIMESTAMP"),
     ("created_at", "TIMESTAMP")),
    time="quoted_at",
    not_null=("quoted_at",),
)
SENTIMENT_SCORES = Table(
    "sentiment_scores",
    (("id", "BIGINT"), ("symbol", "STRING"), ("buzz_articles_in_last_week", "INT"),
     ("buzz_weekly_average", "DECIMAL(8,4)"), ("company_news_score", "DECIMAL(8,6)"),
     ("sector_avg_bullish", "DECIMAL(8,6)"), ("sector_avg_bearish", "DECIMAL(8,6)"),
     ("sentiment_score", "DECIMAL(8,6)"), ("scored_at", "TIMESTAMP"), ("created_at", "TIMESTAMP")),
    time="scored_at",
    not_null=("scored_at",),
)
ANOMALY_LOGS = Table(
    "anomaly_logs",
    (("id", "BIGINT"), ("symbol", "STRING"), ("anomaly_type", "STRING"), ("severity", "STRING"),
     ("detection_method", "STRING"), ("anomaly_score", "DECIMAL(10,6)"), ("price_at_anomaly", "DECIMAL(12,4)"),
     ("volume_at_anomaly", "DECIMAL(20,4)"), ("context", "STRING"), ("detected_at", "TIMESTAMP"),
     ("created_at", "TIMESTAMP")),
    time="detected_at",
    not_null=("symbol", "detected_at"),
    allowed=(("severity", SEVERITIES),),
)
ROOT_CAUSE_REPORTS = Table(
    "root_cause_reports",
    (("id", "BIGINT"), ("anomaly_log_id", "BIGINT"), ("symbol", "STRING"), ("summary", "STRING"),
     ("full_report", "STRING"), ("confidence_score", "DECIMAL(4,3)"), ("root_cause_type", "STRING"),
     ("evidence", "STRING"), ("recommendations", "ARRAY<STRING>"), ("agent_model", "STRING"),
     ("tokens_used", "INT"), ("generated_at", "TIMESTAMP"), ("created_at", "TIMESTAMP")),
    time="generated_at",
    not_null=("symbol", "generated_at"),
    parents=(("anomaly_log_id", "anomaly_logs"),),
)
AGENT_AUDIT_TRAIL = Table(
    "agent_audit_trail",
    (("id", "BIGINT"), ("report_id", "BIGINT"), ("step_name", "STRING"), ("step_input", "STRING"),
     ("step_output", "STRING"), ("tool_calls", "STRING"), ("duration_ms", "INT"), ("executed_at", "TIMESTAMP")),
    time="executed_at",
    not_null=("executed_at",),
    parents=(("report_id", "root_cause_reports"),),
)

# What a detection stream keeps for windows that reach back over its batches; not among the stored tables.
WINDOW_TRADES = Table(
    "window_trades",
    (("symbol", "STRING"), ("price", "DOUBLE"), ("volume", "DOUBLE"), ("ts", "TIMESTAMP")),
    time="ts",
)
WINDOW_CELLS = Table(
    "window_cells",
    (("symbol", "STRING"), ("cell_start", "TIMESTAMP"), ("n", "BIGINT"), ("k", "BIGINT"), ("mean", "DOUBLE"),
     ("squares", "DOUBLE"), ("volume", "DOUBLE"), ("price_volume", "DOUBLE"), ("low", "DOUBLE"), ("high", "DOUBLE")),
    time="cell_start",
)

TABLES = {
    table.name: table
    for table in (RAW_TRADES, STOCK_QUOTES, SENTIMENT_SCORES, AGGREGATED_METRICS,
                  ANOMALY_LOGS, ROOT_CAUSE_REPORTS, AGENT_AUDIT_TRAIL)
}
