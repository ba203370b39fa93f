import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import moments, windows
from tidegauge.plans import batch
from tidegauge.schemas import AGGREGATED_METRICS, ANOMALY_LOGS, RAW_TRADES, TRADE_MSG
from tidegauge.sources import messages, tables
from tidegauge.streaming import jobs


def message(symbol, price, volume, second):
    stamp = f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}+00:00"
    return json.dumps({"symbol": symbol, "price": price, "volume": volume, "trade_timestamp": stamp, "conditions": []})


def write(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}.txt"
    with open(path, "w") as out:
        out.write("\n".join(lines) + "\n")
    stamp = time.time() + int(name)
    os.utime(path, (stamp, stamp))


def source(spark, folder):
    return spark.readStream.schema("value STRING").option("maxFilesPerTrigger", 1).text(folder)


def spike(second=100):
    return [message("A", 100 + i % 3 / 10, 10.0, second + i) for i in range(30)] + [message("A", 400.0, 10.0, second + 30)]


def test_detection_equals_batch(spark, tmp_path):
    write(f"{tmp_path}/in", "1", spike() + [message("B", 5.0, 1.0, 120), "not json"])
    published = []
    trades = jobs.trade_stream(source(spark, f"{tmp_path}/in"))
    moment = lambda: F.to_timestamp(F.lit("2024-01-01 01:00:00"))
    callback = jobs.detection(f"{tmp_path}/out", now=moment, keep=True,
                              publish=lambda m: published.extend(m.collect()))
    jobs.run(trades, callback, f"{tmp_path}/cp", once=True).awaitTermination()

    rows = messages.decode_trades(spark.read.text(f"{tmp_path}/in")).withColumn(
        "id", F.xxhash64("symbol", "trade_timestamp", "price", "volume"))
    metrics = windows.trailing_metrics(rows)
    stored = tables.read_batches(spark, f"{tmp_path}/out", AGGREGATED_METRICS)
    names = ["symbol", "window_size", "trade_count", "min_price", "max_price"]
    assert sorted((r[0], r[1], r[2], float(r[3]), float(r[4])) for r in stored.select(names).collect()) == \
        sorted(map(tuple, metrics.select(names).collect()))
    want = {(r["symbol"], r["detection_method"]) for r in batch.events(rows, metrics, moment()).collect()}
    got = tables.read_batches(spark, f"{tmp_path}/out", ANOMALY_LOGS).collect()
    assert {(r["symbol"], r["detection_method"]) for r in got} == want == {("A", "zscore"), ("A", "iqr")}
    assert {m["key"] for m in published} == {"A"} and len(published) == 2
    assert set(json.loads(published[0]["value"])) == {
        "symbol", "anomaly_type", "severity", "detection_method", "anomaly_score", "price", "volume", "detected_at",
        "context"}


def test_retried_batch_is_written_once(spark, tmp_path):
    write(f"{tmp_path}/in", "1", spike())
    rows = messages.decode_trades(spark.read.text(f"{tmp_path}/in")).withColumn("id", F.monotonically_increasing_id())
    callback = jobs.detection(f"{tmp_path}/out")
    for _ in range(2):
        callback(rows, 7)
    assert tables.read_batches(spark, f"{tmp_path}/out", ANOMALY_LOGS).count() == 2
    assert tables.read_batches(spark, f"{tmp_path}/out", AGGREGATED_METRICS).count() == 3


def test_score_that_does_not_fit_is_kept_apart(spark, tmp_path):
    quiet = [message("A", 100.0 + i % 2 * 1e-6, 10.0, i) for i in range(20)] + [message("A", 500.0, 10.0, 20)]
    write(f"{tmp_path}/in", "1", quiet)
    rows = messages.decode_trades(spark.read.text(f"{tmp_path}/in")).withColumn("id", F.monotonically_increasing_id())
    jobs.detection(f"{tmp_path}/out")(rows, 0)
    assert tables.read_batches(spark, f"{tmp_path}/out", ANOMALY_LOGS).count() == 0
    kept = spark.read.parquet(jobs.rejects(f"{tmp_path}/out", ANOMALY_LOGS)).collect()
    assert {r["reject_reason"] for r in kept} == {"overflow anomaly_score"}


def test_windows_reach_back_over_batches(spark, tmp_path):
    old = spark.createDataFrame([(1, "A", 50.0, 1.0, 0)], "id BIGINT, symbol STRING, price DOUBLE, volume DOUBLE, s BIGINT") \
        .select("id", "symbol", "price", "volume", F.timestamp_seconds("s").alias("ts"))
    new = old.select(F.lit(2).cast("bigint").alias("id"), "symbol", F.lit(70.0).alias("price"), "volume",
                     (F.col("ts") + F.expr("INTERVAL 4 MINUTES")).alias("ts"))
    callback = jobs.detection(f"{tmp_path}/out", recent=lambda start: old.filter(F.col("ts") >= start))
    callback(new, 0)
    got = tables.read_batches(spark, f"{tmp_path}/out", AGGREGATED_METRICS)
    assert {r["window_size"]: r["trade_count"] for r in got.collect()} == {"1m": 1, "5m": 2, "15m": 2}


def test_windows_reach_back_to_landed_trades(spark, tmp_path):
    write(f"{tmp_path}/in", "1", [message("A", 50.0, 1.0, 0), message("A", 60.0, 1.0, 100)])
    write(f"{tmp_path}/in", "2", [message("A", 70.0, 1.0, 240)])
    trades = jobs.trade_stream(source(spark, f"{tmp_path}/in"))
    jobs.run(jobs.trade_rows(trades), jobs.landing(f"{tmp_path}/out", RAW_TRADES), f"{tmp_path}/cp1", once=True) \
        .awaitTermination()
    callback = jobs.detection(f"{tmp_path}/out", recent=jobs.stored_trades(spark, f"{tmp_path}/out"))
    jobs.run(trades, callback, f"{tmp_path}/cp2", once=True).awaitTermination()
    got = tables.read_batches(spark, f"{tmp_path}/out", AGGREGATED_METRICS).collect()
    assert {(r["batch_id"], r["window_size"]): (r["trade_count"], float(r["avg_price"])) for r in got} == {
        (0, "1m"): (1, 60.0), (0, "5m"): (2, 55.0), (0, "15m"): (2, 55.0),
        (1, "1m"): (1, 70.0), (1, "5m"): (3, 60.0), (1, "15m"): (3, 60.0)}


def test_bars_close_and_late_trades_drop(spark, tmp_path):
    write(f"{tmp_path}/in", "1", [message("A", 1.0, 1.0, 10), message("A", 3.0, 1.0, 50)])
    write(f"{tmp_path}/in", "2", [message("A", 2.0, 1.0, 200)])
    write(f"{tmp_path}/in", "3", [message("A", 4.0, 1.0, 400)])
    write(f"{tmp_path}/in", "4", [message("A", 99.0, 1.0, 20), message("A", 5.0, 1.0, 800)])
    trades = jobs.trade_stream(source(spark, f"{tmp_path}/in"))
    bars = jobs.bars(trades, 60)
    jobs.store(bars, f"{tmp_path}/out", f"{tmp_path}/cp", once=True).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("window_start").collect()
    assert [(str(r["window_start"])[14:16], r["open"], r["close"], r["high"], r["trade_count"]) for r in got] == \
        [("00", 1.0, 3.0, 3.0, 2), ("03", 2.0, 2.0, 2.0, 1), ("06", 4.0, 4.0, 4.0, 1)]


def test_feed_lands_once_per_batch(spark, tmp_path):
    frame = lambda p: json.dumps({"type": "trade", "data": [{"s": "A", "p": p, "v": 1, "t": 1704067200000}] * 2})
    write(f"{tmp_path}/in", "1", [frame(1.5), '{"type":"ping"}'])
    write(f"{tmp_path}/in", "2", [frame(2.5)])
    rows = messages.feed_trades(source(spark, f"{tmp_path}/in")).drop("trade_timestamp") \
        .withColumnRenamed("ts", "trade_timestamp")
    callback = jobs.landing(f"{tmp_path}/out", RAW_TRADES)
    jobs.run(rows, callback, f"{tmp_path}/cp", once=True).awaitTermination()
    stored = tables.read_batches(spark, f"{tmp_path}/out", RAW_TRADES).collect()
    assert sorted((r["symbol"], float(r["price"]), r["batch_id"]) for r in stored) == \
        [("A", 1.5, 0), ("A", 1.5, 0), ("A", 2.5, 1), ("A", 2.5, 1)]


def test_sliding_bars_in_a_stream(spark, tmp_path):
    write(f"{tmp_path}/in", "1", [message("A", 1.0, 1.0, 70), message("A", 3.0, 1.0, 130)])
    write(f"{tmp_path}/in", "2", [message("A", 2.0, 1.0, 900)])
    bars = jobs.bars(jobs.trade_stream(source(spark, f"{tmp_path}/in")), 120, 60)
    jobs.store(bars, f"{tmp_path}/out", f"{tmp_path}/cp", once=True).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("window_start").collect()
    assert [(str(r["window_start"])[14:16], r["open"], r["close"], r["trade_count"]) for r in got] == \
        [("00", 1.0, 1.0, 1), ("01", 1.0, 3.0, 2), ("02", 3.0, 3.0, 1)]


def test_news_once_over_batches(spark, tmp_path):
    article = lambda i, second: json.dumps({"id": i, "datetime": 1704067200 + second, "headline": "h"})
    write(f"{tmp_path}/in", "1", [article(1, 0), article(2, 1), article(1, 2)])
    write(f"{tmp_path}/in", "2", [article(2, 5), article(3, 6), article(None, 7), article(None, 8)])
    fresh = jobs.fresh_articles(messages.decode_news(source(spark, f"{tmp_path}/in")))
    jobs.store(fresh, f"{tmp_path}/out", f"{tmp_path}/cp", once=True).awaitTermination()
    got = [r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got, key=str) == [1, 2, 3, None]


def test_trade_schema_is_what_the_decoder_uses(spark):
    assert spark.createDataFrame([], TRADE_MSG).columns == ["symbol", "price", "volume", "trade_timestamp", "conditions"]


def test_equal_fills_count_twice(spark, tmp_path):
    write(f"{tmp_path}/in", "1", [message("A", 50.0, 3.0, 10)] * 2)
    rows = messages.decode_trades(spark.read.text(f"{tmp_path}/in")).withColumn("id", F.xxhash64("symbol", "price"))
    none = rows.filter("false")
    callback = jobs.detection(f"{tmp_path}/out", recent=lambda start: rows.filter(F.col("ts") >= start).unionByName(none))
    callback(rows, 0)
    got = tables.read_batches(spark, f"{tmp_path}/out", AGGREGATED_METRICS).filter("window_size = '1m'").first()
    assert (got["trade_count"], float(got["total_volume"])) == (2, 6.0)


def test_another_query_keeps_its_batches(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A", 1.0, 2.0)], "id BIGINT, symbol STRING, price DOUBLE, volume DOUBLE") \
        .withColumn("trade_timestamp", F.current_timestamp())
    for query in ("one", "two", "two"):
        tables.append(rows, str(tmp_path), RAW_TRADES, F.current_timestamp(), 7, query)
    assert tables.read_batches(spark, str(tmp_path), RAW_TRADES).count() == 2


def test_a_renewed_checkpoint_starts_beside_the_old_rows(spark, tmp_path):
    write(f"{tmp_path}/in", "1", [message("A", 1.0, 1.0, 10)])
    trades = jobs.trade_rows(jobs.trade_stream(source(spark, f"{tmp_path}/in")))
    for checkpoint in ("a", "b"):
        jobs.run(trades, jobs.landing(f"{tmp_path}/out", RAW_TRADES), f"{tmp_path}/{checkpoint}", once=True).awaitTermination()
    assert tables.read_batches(spark, f"{tmp_path}/out", RAW_TRADES).count() == 2


def test_the_place_in_a_topic_is_the_identity(spark):
    rows = spark.createDataFrame([(message("A", 1.0, 1.0, 10), "t", 0, i) for i in range(2)],
                                 "value STRING, topic STRING, partition INT, offset BIGINT")
    assert jobs.trade_stream(rows).select("id").distinct().count() == 2


def test_equal_fills_over_batches(spark, tmp_path):
    for name in "12":
        write(f"{tmp_path}/in", name, [message("A", 50.0, 3.0, 10)])
    trades = jobs.trade_stream(source(spark, f"{tmp_path}/in"))
    jobs.run(jobs.trade_rows(trades), jobs.landing(f"{tmp_path}/landed", RAW_TRADES), f"{tmp_path}/cp1", once=True).awaitTermination()
    ways = {"landed": {"recent": jobs.stored_trades(spark, f"{tmp_path}/landed")}, "own": {"history": 60}}
    for way, how in ways.items():
        jobs.run(trades, jobs.detection(f"{tmp_path}/{way}_out", **how), f"{tmp_path}/cp_{way}", once=True).awaitTermination()
    counts = {way: {(r["batch_id"], r["window_size"]): r["trade_count"] for r in
                    tables.read_batches(spark, f"{tmp_path}/{way}_out", AGGREGATED_METRICS).collect()} for way in ways}
    # All is landed before the first batch runs, so there both fills count at once; own history counts them as they come.
    assert set(counts["landed"].values()) == {2}
    assert counts["own"] == {(b, w): b + 1 for b in (0, 1) for w in ("1m", "5m", "15m")}


@pytest.mark.parametrize("cell", [7, 60, 1000])
def test_windows_from_cells_equal_windows_from_trades(spark, skewed, cell):
    """Three batches that interleave in time, with stored cells of any length, against all trades at once."""
    trades = skewed[1].withColumn("volume", F.when(F.col("id") % 11 > 0, F.col("volume")))
    chosen = (("1m", 60), ("7m", 421), ("15m", 900))
    # Late and early trades in every batch; the last one's newest trade comes before the newest of all.
    batch = F.when((F.col("ts") > F.timestamp_seconds(F.lit(1704067200 + 3900))), F.pmod("id", F.lit(2))).otherwise(F.pmod("id", F.lit(3)))
    parts = [trades.filter(batch == b) for b in range(3)]
    stored_cells = moments.cells(parts[0], cell).unionByName(moments.cells(parts[1], cell))
    got = moments.reaching_metrics(parts[2], stored_cells, parts[0].unionByName(parts[1]), cell, chosen)
    end = parts[2].agg(F.max("ts")).first()[0]
    want = windows.trailing_metrics(trades.filter(F.col("ts") <= F.lit(end)), chosen)
    assert got.columns == want.columns
    rows = [{(r["symbol"], r["window_size"]): r for r in df.collect()} for df in (got, want)]
    assert rows[0].keys() == rows[1].keys() and len(rows[0]) > 80
    for key, r in rows[0].items():
        w = rows[1][key]
        assert (r["trade_count"], r["min_price"], r["max_price"], r["window_start"], r["window_end"]) == \
            (w["trade_count"], w["min_price"], w["max_price"], w["window_start"], w["window_end"])
        for c in ("avg_price", "std_dev", "total_volume", "vwap"):
            assert r[c] == pytest.approx(w[c], rel=1e-9, abs=1e-9)


def test_windows_of_a_batch_without_times(spark, skewed):
    none = skewed[1].withColumn("ts", F.lit(None).cast("timestamp"))
    assert moments.reaching_metrics(none, moments.cells(none, 60), none, 60).collect() == []
    # Without earlier batches the windows are those of the batch.
    got = moments.reaching_metrics(skewed[1], moments.cells(none, 60), none, 60)
    key = ["symbol", "window_size", "trade_count", "min_price"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, windows.trailing_metrics(skewed[1]).select(key).collect()))


def test_a_retried_batch_reads_earlier_ones_alone(spark, tmp_path):
    write(f"{tmp_path}/in", "1", [message("A", 50.0, 3.0, 10), message("A", 70.0, 3.0, 20)])
    rows = messages.decode_trades(spark.read.text(f"{tmp_path}/in")).withColumn("id", F.monotonically_increasing_id())
    callback = jobs.detection(f"{tmp_path}/out", history=60)
    for batch_id in (0, 1, 1, 0):
        callback(rows, batch_id)
    got = tables.read_batches(spark, f"{tmp_path}/out", AGGREGATED_METRICS).filter("window_size = '5m'").collect()
    assert sorted((r["batch_id"], r["trade_count"], float(r["avg_price"]), float(r["std_dev"])) for r in got) == \
        [(0, 2, 60.0, 14.142136), (1, 4, 60.0, 11.547005)]
