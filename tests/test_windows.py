import pytest
from pyspark.sql import functions as F

from tidegauge.functions.scalars import settled
from tidegauge.operators import latest, windows

FIXTURE = [(1, "A", 10.0, 2.0, "2024-01-01 00:00:00"), (2, "A", 12.0, 1.0, "2024-01-01 00:10:00"),
           (3, "A", 14.0, 1.0, "2024-01-01 00:15:00"), (4, "B", 5.0, 0.0, "2024-01-01 00:14:30"),
           (5, "B", 7.0, 1.0, None)]


@pytest.fixture(scope="module")
def fixture_trades(spark):
    return spark.createDataFrame(FIXTURE, "id BIGINT, symbol STRING, price DOUBLE, volume DOUBLE, ts STRING") \
        .withColumn("ts", F.to_timestamp("ts"))


def test_trailing_fixture(fixture_trades):
    got = {(r["symbol"], r["window_size"]): r for r in windows.trailing_metrics(fixture_trades).collect()}
    want = {("A", "1m"): (1, 14, 0.0, 1, 14, 14, 14), ("A", "5m"): (2, 13, 1.414214, 2, 13, 12, 14),
            ("A", "15m"): (3, 12, 2.0, 4, 11.5, 10, 14)}
    want.update({("B", w): (1, 5, 0.0, 0, 5, 5, 5) for w in ("1m", "5m", "15m")})
    assert set(got) == set(want)
    for key, numbers in want.items():
        row = got[key]
        assert [row[c] for c in ("trade_count", "avg_price", "std_dev", "total_volume", "vwap", "min_price",
                                 "max_price")] == pytest.approx(numbers, abs=1e-6)
        assert str(row["window_end"]) == "2024-01-01 00:15:00"


def test_idle_symbol_has_no_row(spark):
    trades = spark.createDataFrame([(1, "OLD", 1.0, 1.0, 0), (2, "NEW", 1.0, 1.0, 3600)],
                                   "id BIGINT, symbol STRING, price DOUBLE, volume DOUBLE, s BIGINT") \
        .withColumn("ts", F.timestamp_seconds("s"))
    assert {r["symbol"] for r in windows.trailing_metrics(trades).collect()} == {"NEW"}


def test_null_symbol_and_null_price(spark):
    trades = spark.createDataFrame([(1, None, 1.0, 1.0), (2, "A", None, 3.0), (3, "A", 4.0, 1.0)],
                                   "id BIGINT, symbol STRING, price DOUBLE, volume DOUBLE") \
        .withColumn("ts", F.timestamp_seconds(F.lit(0)))
    row = windows.trailing_metrics(trades).filter("window_size = '1m'").collect()
    assert len(row) == 1
    assert (row[0]["trade_count"], row[0]["avg_price"], row[0]["total_volume"], row[0]["vwap"]) == (2, 4.0, 4.0, 1.0)


def test_range_frames_match_brute_force(skewed):
    frame, rows = skewed
    spans = (("1m", 60), ("5m", 300), ("15m", 900))
    got = {(r["symbol"], int(r["ts"].timestamp()) - 1704067200, r["window_size"]): r
           for r in windows.range_frame_metrics(rows, spans).collect()}
    wanted = 0
    for symbol, part in frame.groupby("symbol"):
        for at in part["second"].unique():
            for label, length in spans:
                inside = part[(part["second"] <= at) & (part["second"] >= at - length)]
                row = got[symbol, at, label]
                wanted += 1
                volume = inside["volume"].sum()
                vwap = (inside["price"] * inside["volume"]).sum() / volume if volume else inside["price"].mean()
                std = inside["price"].std() if len(inside) > 1 else 0.0
                assert row["trade_count"] == len(inside)
                assert [row["avg_price"], row["std_dev"], row["total_volume"], row["vwap"], row["min_price"],
                        row["max_price"]] == pytest.approx(
                    [inside["price"].mean(), std, volume, vwap, inside["price"].min(), inside["price"].max()], abs=1e-6)
    assert len(got) == wanted


def test_range_frames_over_short_cells(skewed, monkeypatch):
    """Denser data get shorter cells, so no task holds a frame; the rows stay the same."""
    _, rows = skewed
    spans = (("1m", 60), ("5m", 300), ("15m", 900))
    numbers = [settled(F.col(c), 6) for c in ("avg_price", "std_dev", "total_volume", "vwap")]
    shown = ["symbol", "ts", "window_size", *numbers, "trade_count", "min_price", "max_price"]
    whole = sorted(map(tuple, windows.range_frame_metrics(rows, spans).select(*shown).collect()))
    stamps = rows.select("symbol", "ts")
    assert windows._cell_length(stamps, [60, 300, 900])[0] == 60
    monkeypatch.setattr(windows, "CELL_ROWS", 12)
    monkeypatch.setattr(windows, "TASK_ROWS", 1000)
    width, _ = windows._cell_length(stamps, [60, 300, 900])
    held = stamps.distinct().groupBy("symbol", F.floor(F.unix_seconds("ts") / width)).count().agg(F.max("count")).first()[0]
    assert 1 < width < 60 and held <= 12
    assert sorted(map(tuple, windows.range_frame_metrics(rows, spans).select(*shown).collect())) == whole


def test_range_frames_keep_a_price_that_is_no_number_to_its_frames(spark):
    rows = spark.sql("""SELECT id, 'A' AS symbol, IF(id = 3, double('NaN'), double(id)) AS price, 1D AS volume,
                        timestamp_seconds(1704067200 + id * 30) AS ts FROM range(12)""")
    got = {int(r["ts"].timestamp() - 1704067200) // 30: r["avg_price"] for r in windows.range_frame_metrics(rows, (("1m", 60),)).collect()}
    assert sorted(i for i in got if got[i] != got[i]) == [3, 4, 5]
    assert got[6] == pytest.approx(5.0) and got[0] == 0.0


def test_levels_equal_direct_bars(skewed):
    _, rows = skewed
    levels = windows.ohlcv_levels(rows, (("1m", 60), ("5m", 300), ("15m", 900)))
    for label, length in (("1m", 60), ("5m", 300), ("15m", 900)):
        columns = ["symbol", "window_start", "window_end", "open", "high", "low", "close", "volume", "trade_count"]
        merged = levels.filter(F.col("window_size") == label).select(*columns, settled(F.col("vwap"), 6))
        direct = windows.ohlcv(rows, length).select(*columns, settled(F.col("vwap"), 6))
        assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, direct.collect()))


def test_levels_need_a_common_divisor(skewed):
    with pytest.raises(ValueError):
        windows.ohlcv_levels(skewed[1], (("2m", 120), ("5m", 300)))


def test_latest_and_series_ends(skewed):
    frame, rows = skewed
    ordered = frame.sort_values(["second", "id"])
    got = {r["symbol"]: r["id"] for r in latest.latest_per_key(rows, "symbol", ("ts", "id")).collect()}
    assert got == ordered.groupby("symbol")["id"].last().to_dict()
    ends = {r["symbol"]: (r["first_value"], r["last_value"], r["points"])
            for r in latest.series_ends(rows, "symbol", "price", ("ts", "id")).collect()}
    for symbol, part in ordered.groupby("symbol"):
        assert ends[symbol] == (part["price"].iloc[0], part["price"].iloc[-1], len(part))


def test_newest_n(skewed):
    frame, rows = skewed
    got = latest.newest_n(rows, "symbol", [F.col("ts").desc(), F.col("id").desc()], 5)
    want = frame.sort_values(["second", "id"]).groupby("symbol").tail(5)
    assert {r["id"] for r in got.collect()} == set(want["id"])


def test_percent_change_and_rebasing(spark):
    rows = spark.createDataFrame(
        [(1, "UP", 50.0, 1), (2, "UP", 75.0, 2), (3, "ONE", 3.0, 1), (4, "ZERO", 0.0, 1), (5, "ZERO", 9.0, 2)],
        "id BIGINT, symbol STRING, price DOUBLE, ts BIGINT")
    change = {r["symbol"]: (r["pct_change"], r["is_up"]) for r in
              latest.percent_change(rows, "symbol", "price", ("ts", "id")).collect()}
    assert change == {"UP": (50.0, True), "ONE": (None, None), "ZERO": (0.0, True)}
    scaled = {r["id"]: r["normalised"] for r in latest.rebased(rows, "symbol", "price", ("ts", "id")).collect()}
    assert scaled == {1: 100.0, 2: 150.0, 3: 100.0, 4: 0.0, 5: 9.0}
