from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import scalars
from tidegauge.plans import anomalies, health, prices, reports


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("score, label", [(None, "—"), (0.0, "0% (Low)"), (0.39, "39% (Low)"), (0.4, "40% (Medium)"),
                                          (0.7, "70% (High)"), (1.0, "100% (High)")])
def test_confidence_band(spark, score, label):
    assert one(spark, scalars.confidence_band(F.lit(score).cast("double"))) == label


def test_small_functions(spark):
    assert one(spark, scalars.title_words(F.lit("price_spike"))) == "Price Spike"
    assert one(spark, scalars.clamp_unit(F.lit(1.2))) == 1.0
    assert one(spark, scalars.bubble_size(F.lit(99.0))) == 26.0
    assert one(spark, scalars.chart_height(F.lit(2).cast("bigint"))) == 300
    assert one(spark, scalars.chart_height(F.lit(9).cast("bigint"))) == 640
    assert one(spark, scalars.step_label(F.lit("fetch"), F.lit(12))) == "Step: fetch (12 ms)"
    assert one(spark, scalars.step_label(F.lit(None).cast("string"), F.lit(0))) == "Step: step"
    assert one(spark, scalars.fixed("$%.4f", F.lit(1.5))) == "$1.5000"
    assert one(spark, scalars.fixed("%.2f", F.lit(None).cast("double"))) == "—"
    assert one(spark, scalars.severity_rank(F.lit("high"))) == 3
    assert one(spark, scalars.or_default(F.lit(0.0), F.lit(0.5))) == 0.5
    assert one(spark, scalars.settled(F.lit(92.87874999999999), 4)) == 92.8788


@pytest.fixture(scope="module")
def logged(spark):
    rows = [(i, s, "price_spike", v, m, float(i), 10.0, None, "{}", datetime(2024, 1, 1, i))
            for i, (s, v, m) in enumerate([("A", "low", "zscore"), ("A", "critical", "iqr"), ("B", "low", "iqr"),
                                           ("C", None, "zscore")])]
    return spark.createDataFrame(rows, "id BIGINT, symbol STRING, anomaly_type STRING, severity STRING, "
                                       "detection_method STRING, anomaly_score DOUBLE, price_at_anomaly DOUBLE, "
                                       "volume_at_anomaly DOUBLE, context STRING, detected_at TIMESTAMP")


def test_anomaly_filters(spark, logged):
    start = F.to_timestamp(F.lit("2024-01-01 01:00:00"))
    ids = lambda **f: [r["id"] for r in anomalies.newest(logged, start, **f).collect()]
    assert ids() == [3, 2, 1]
    assert ids(symbol="All", severity="low") == [2]
    assert ids(method="iqr", limit=1) == [2]
    assert ids(symbol="A", severity="low") == []


def test_anomaly_views(spark, logged):
    assert {(r["symbol"], r["detection_method"]): r["count"] for r in anomalies.breakdown(logged).collect()} == \
        {("A", "zscore"): 1, ("A", "iqr"): 1, ("B", "iqr"): 1, ("C", "zscore"): 1}
    assert tuple(anomalies.severity_columns(logged).first()) == (2, 0, 0, 1)
    assert tuple(anomalies.timeline_size(logged).first()) == (3, 300)
    card = anomalies.cards(logged, 1).first()
    assert (card["id"], card["severity"], card["price"], card["volume"], card["title"]) == \
        (3, "LOW", "$10.0000", "—", "Price Spike")


def test_snapshot_keeps_silent_symbols(spark):
    quotes = spark.createDataFrame([(1, "A", 10.0, -1.256, "2024-01-01"), (2, "A", 11.0, None, "2024-01-02")],
                                   "id BIGINT, symbol STRING, current_price DOUBLE, percent_change DOUBLE, at STRING") \
        .selectExpr("*", "0D change", "0D high_price", "0D low_price", "to_timestamp(at) quoted_at").drop("at")
    got = {r["symbol"]: (r["price"], r["delta"]) for r in prices.ticker_snapshot(quotes, ["A", "Z"]).collect()}
    assert got == {"A": ("$11.00", "+0.00%"), "Z": ("—", "no data")}


def test_gauge_defaults(spark):
    scores = spark.createDataFrame([(1, "A", 0.0), (2, "B", 0.61), (3, "C", 1.7), (4, "D", 0.2)],
                                   "id BIGINT, symbol STRING, sentiment_score DOUBLE") \
        .withColumn("scored_at", F.to_timestamp(F.lit("2024-01-01")))
    got = {r["symbol"]: (r["percent"], r["band"]) for r in prices.sentiment_gauge(scores, ["A", "B", "C", "D", "Z"]).collect()}
    assert got == {"A": (50.0, "Neutral"), "B": (61.0, "Bullish"), "C": (100.0, "Bullish"), "D": (20.0, "Bearish"),
                   "Z": (50.0, "Neutral")}


def test_histogram_edges(spark):
    rows = spark.createDataFrame([("0",), ("0.05",), ("1.0",), (None,), ("n/a",)], "confidence_score STRING")
    assert {r["bin"]: r["cnt"] for r in reports.confidence_histogram(rows).collect()} == {1: 1, 2: 1, 20: 1}


def test_report_steps_are_ordered(spark):
    chosen = spark.createDataFrame([(1,), (2,)], "id BIGINT")
    audit = spark.createDataFrame([(10, 1, "b", None, None, None, 0, 2), (11, 1, "a", "{1}", None, None, 5, 1)],
                                  "id BIGINT, report_id BIGINT, step_name STRING, step_input STRING, step_output STRING, "
                                  "tool_calls STRING, duration_ms INT, at BIGINT") \
        .withColumn("executed_at", F.timestamp_seconds("at"))
    got = reports.steps(chosen, audit).collect()
    assert [(r["id"], r["label"], r["step_input"]) for r in got] == \
        [(1, "Step: a (5 ms)", "{1}"), (1, "Step: b", "{}"), (2, None, None)]


def test_health_of_empty_tables(spark):
    empty = spark.createDataFrame([], "trade_timestamp TIMESTAMP, created_at TIMESTAMP")
    assert health.freshness({"raw_trades": empty}).first()["latest"] == "—"
    assert health.component_status({"raw_trades": empty}).first()["status"] == "NO DATA"
    assert health.throughput({"raw_trades": empty}, F.current_timestamp()).first()["row_count"] == 0
