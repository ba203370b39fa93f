import json

import pytest

from pyspark.sql import functions as F

from tidegauge import schemas
from tidegauge.operators import quality
from tidegauge.plans import prices
from tidegauge.sources import messages, tables

NOW = "2024-01-02 03:04:05"


def texts(spark, *lines):
    return spark.createDataFrame([(line,) for line in lines], "value STRING")


def now():
    return F.to_timestamp(F.lit(NOW))


def test_feed_frames(spark):
    got = messages.feed_trades(texts(
        spark,
        '{"type":"trade","data":[{"s":"AAA","p":10.5,"v":3,"t":1704067200123,"c":["1"]},{"p":1}]}',
        '{"type":"ping"}', "not json", '{"type":"trade","data":[]}', '{"type":"trade"}',
        '{"type":"trade","data":[{"s":"BBB","p":2,"v":1,"t":1,"c":null}]}')).drop("ts").collect()
    assert [tuple(r) for r in got] == [
        ("AAA", 10.5, 3.0, "2024-01-01T00:00:00.123+00:00", ["1"]),
        ("UNKNOWN", 1.0, 0.0, "1970-01-01T00:00:00.000+00:00", []),
        ("BBB", 2.0, 1.0, "1970-01-01T00:00:00.001+00:00", [])]


def test_trade_messages(spark):
    got = messages.decode_trades(texts(
        spark,
        '{"symbol":"AAA","price":10.5,"volume":3.0,"trade_timestamp":"2024-01-01T00:00:00.123000+00:00","conditions":["1"]}',
        '{"symbol":"AAA","price":10.5,"volume":3.0,"trade_timestamp":"junk","conditions":[]}', "not json",
        '{"price":1,"trade_timestamp":"2024-01-01T00:00:00+00:00"}',
        '{"symbol":"NAN","price":"NaN","volume":1,"trade_timestamp":"2024-01-01T01:00:00+01:00","more":1}')).collect()
    assert [(r["symbol"], r["price"], r["conditions"]) for r in got] == [("AAA", 10.5, ["1"]), ("NAN", None, [])]
    assert [str(r["ts"]) for r in got] == ["2024-01-01 00:00:00.123000", "2024-01-01 00:00:00"]


def test_quotes(spark):
    got = messages.quote_rows(messages.decode_quotes(texts(
        spark, '{"symbol":"AAA","c":10.0,"d":0.1,"dp":1.0,"h":11,"l":9,"o":9.9,"pc":9.8}', '{"symbol":"BBB","c":null}',
        "{}")), now()).collect()
    assert [tuple(r)[:8] for r in got] == [("AAA", 10.0, 0.1, 1.0, 11.0, 9.0, 9.9, 9.8)]
    assert str(got[0]["quoted_at"]) == NOW


def test_sentiment_falls_through_zero(spark):
    got = messages.sentiment_rows(messages.decode_sentiment(texts(
        spark,
        '{"symbol":"AAA","buzz":{"articlesInLastWeek":3,"weeklyAverage":2.5},"companyNewsScore":0.7,'
        '"sectorAverageBullishPercent":0.6,"sectorAverageBearishPercent":0.4,"sentiment":{"bullishPercent":0.0}}',
        '{"symbol":"BBB","sentiment":{"bullishPercent":0.8},"companyNewsScore":0.1}',
        '{"symbol":"CCC","sentiment":null,"companyNewsScore":0.2}', '{"symbol":"DDD"}')), now())
    assert [(r["symbol"], r["buzz_articles_in_last_week"], r["sentiment_score"]) for r in got.collect()] == \
        [("AAA", 3, 0.7), ("BBB", None, 0.8), ("CCC", None, 0.2)]


def test_news_first_arrival_wins(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (2, 1, "b"), (1, 2, "c"), (None, 3, "d"), (None, 4, "e")],
                                 "id BIGINT, arrival INT, headline STRING")
    got = messages.first_arrivals(rows, ["arrival"]).collect()
    assert sorted((r["headline"], r["id"]) for r in got) == [("a", 1), ("b", 2), ("d", None)]


def test_news_and_anomaly_messages(spark):
    news = messages.decode_news(texts(spark, '{"id":7,"datetime":1704067200,"headline":"h"}')).first()
    assert (news["id"], str(news["published_at"])) == (7, "2024-01-01 00:00:00")
    anomaly = messages.decode_anomalies(texts(
        spark, '{"symbol":"A","severity":"low","detected_at":"2024-01-01T00:00:00Z","context":{"z":1}}')).first()
    assert str(anomaly["detected_at"]) == "2024-01-01 00:00:00" and json.loads(anomaly["context"]) == {"z": 1}


def test_encode(spark):
    rows = spark.createDataFrame([("A", 1.5)], "symbol STRING, price DOUBLE")
    assert tuple(messages.encode(rows, "symbol").first()) == ("A", '{"symbol":"A","price":1.5}')
    assert tuple(messages.encode(rows, None, ["price"]).first()) == (None, '{"price":1.5}')


ANOMALY = "id BIGINT, symbol STRING, severity STRING, anomaly_score DOUBLE, detected_at STRING, report_id BIGINT"


def test_constraints(spark):
    rows = spark.createDataFrame(
        [(1, "A", "low", 1.0, NOW, None), (2, None, "low", 1.0, NOW, None), (3, "A", "odd", 1.0, NOW, None),
         (4, "A", "high", 1e4, NOW, None), (5, "A", None, None, NOW, None), (6, "A", "low", 1.0, None, None)],
        ANOMALY).withColumn("detected_at", F.to_timestamp("detected_at"))
    accepted, rejected = quality.split(rows, schemas.ANOMALY_LOGS)
    assert sorted(r["id"] for r in accepted.collect()) == [1, 5]
    assert {r["id"]: r["reject_reason"] for r in rejected.collect()} == \
        {2: "null symbol", 3: "bad severity", 4: "overflow anomaly_score", 6: "null detected_at"}


def test_references(spark):
    rows = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "id BIGINT, report_id BIGINT") \
        .withColumn("executed_at", now())
    parents = spark.createDataFrame([(10,)], "id BIGINT")
    accepted, rejected = quality.split(rows, schemas.AGENT_AUDIT_TRAIL, {"root_cause_reports": parents})
    assert sorted(r["id"] for r in accepted.collect()) == [1, 3]
    assert [(r["id"], r["reject_reason"]) for r in rejected.collect()] == [(2, "no root_cause_reports for report_id")]


def test_append_rounds_half_up_and_prunes_days(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "A", 1.00005, 2.0, "2024-01-01 10:00:00"), (2, "A", 1.5, 1e15, "2024-01-03 10:00:00")],
        "id BIGINT, symbol STRING, price DOUBLE, volume DOUBLE, trade_timestamp STRING") \
        .withColumn("trade_timestamp", F.to_timestamp("trade_timestamp"))
    tables.append(rows, str(tmp_path), schemas.RAW_TRADES, now())
    stored = tables.read_table(spark, str(tmp_path), schemas.RAW_TRADES)
    kept = {r["id"]: (float(r["price"]), r["volume"]) for r in stored.collect()}
    assert kept[1][0] == 1.0001 and kept[2][0] == 1.5
    with pytest.raises(Exception, match="does not fit"):
        tables.append(rows.withColumn("volume", F.lit(1e17)), str(tmp_path), schemas.RAW_TRADES, now())
    recent = tables.since(stored, schemas.RAW_TRADES, F.to_timestamp(F.lit("2024-01-02 00:00:00")))
    assert [r["id"] for r in recent.collect()] == [2]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(trade_timestamp_day" in plan
    asked = prices.recent_trades(stored, "A", F.to_timestamp(F.lit("2024-01-03 10:30:00")))
    assert [r["id"] for r in asked.collect()] == [2]
    assert "PartitionFilters: [isnotnull(trade_timestamp_day" in asked._jdf.queryExecution().executedPlan().toString()


def test_batch_writes_are_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("A", "5m", 1.0), ("B", "5m", 2.0)], "symbol STRING, window_size STRING, avg_price DOUBLE") \
        .withColumns({"window_start": now(), "window_end": now()})
    for batch in (0, 0, 1):
        tables.append(rows, str(tmp_path), schemas.AGGREGATED_METRICS, now(), batch)
    assert tables.read_batches(spark, str(tmp_path), schemas.AGGREGATED_METRICS).count() == 4


def test_create_tables_twice(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS market LOCATION '{tmp_path}/db'")
    for _ in range(2):
        tables.create_tables(spark, str(tmp_path / "t"), "market")
    assert spark.sql("SHOW TABLES IN market").count() == 7
    assert dict(spark.table("market.anomaly_logs").dtypes)["anomaly_score"] == "decimal(10,6)"
    spark.sql("DROP DATABASE market CASCADE")


def test_bounds_agree_with_casts(spark):
    """Fixed values around the bounds of a decimal with ten digits, six of them after the point."""
    values = [0.0, -0.0, 9999.9999994, 9999.9999995, 9999.99999949999, -9999.9999995, 1e4, -1e4, 9999.999999, 1e300, -1e300, float("inf"),
              float("-inf"), float("nan"), None, 5e-7, 0.1 + 0.2]
    rows = spark.createDataFrame([(x,) for x in values], "anomaly_score DOUBLE").select("*", F.col("anomaly_score").cast("float").alias("f"))
    for column in ("anomaly_score", "f"):
        got = rows.select(F.col(column).isNotNull() & quality.fits(rows, column, "DECIMAL(10,6)"), F.col(column).try_cast("DECIMAL(10,6)").isNotNull())
        assert all(bool(a) == b for a, b in got.collect())


def test_tables_by_name_and_by_path_are_the_same(spark, tmp_path):
    """Rows written before the table was created, by name, as a batch, and a batch written again with other days."""
    root, day = str(tmp_path / "t"), lambda d: F.to_timestamp(F.lit(f"2024-01-0{d} 10:00:00"))
    rows = spark.createDataFrame([(1, "A", 1.0, 2.0)], "id BIGINT, symbol STRING, price DOUBLE, volume DOUBLE")
    trades = lambda d: rows.withColumn("trade_timestamp", day(d))
    tables.append(trades(1), root, schemas.RAW_TRADES, now())
    spark.sql(f"CREATE DATABASE named LOCATION '{tmp_path}/db'")
    tables.create_tables(spark, root, "named")
    stored = lambda: sorted(
        (r["query"], r["batch_id"], str(r["trade_timestamp_day"])) for r in tables.read_named(spark, schemas.RAW_TRADES, "named").collect())
    assert stored() == [("append", 0, "2024-01-01")]
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        tables.insert(trades(2), schemas.RAW_TRADES, now(), "named")
        tables.insert(trades(3).unionByName(trades(4)), schemas.RAW_TRADES, now(), "named", 7, "q")
        tables.insert(trades(5), schemas.RAW_TRADES, now(), "named", 7, "q")
        tables.insert(trades(6), schemas.RAW_TRADES, now(), "named", 8, "q")
        tables.insert(trades(6).limit(0), schemas.RAW_TRADES, now(), "named", 8, "q")
        assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == "dynamic"
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    want = [("append", 0, "2024-01-01"), ("append", 0, "2024-01-02"), ("q", 7, "2024-01-05")]
    assert stored() == want
    tables.append(trades(9), root, schemas.RAW_TRADES, now(), 1, "other")
    tables.recover(spark, schemas.RAW_TRADES, "named")
    assert stored() == sorted([*want, ("other", 1, "2024-01-09")]) and tables.read_table(spark, root, schemas.RAW_TRADES).count() == 4
    asked = tables.since(tables.read_named(spark, schemas.RAW_TRADES, "named"), schemas.RAW_TRADES, day(5))
    assert asked.count() == 2
    assert "PartitionFilters: [isnotnull(trade_timestamp_day" in asked._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="does not fit"):
        tables.insert(trades(1).withColumn("volume", F.lit(1e17)), schemas.RAW_TRADES, now(), "named")
    spark.sql("DROP DATABASE named CASCADE")


@pytest.mark.parametrize("decoded", [messages.decode_trades, messages.feed_trades, lambda m: messages.sentiment_rows(messages.decode_sentiment(m), now()),
                                     lambda m: messages.quote_rows(messages.decode_quotes(m), now())])
def test_texts_are_parsed_once(spark, decoded):
    plan = decoded(texts(spark, "{}"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
