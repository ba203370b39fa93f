import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import sharding
from tidegauge.operators.detectors import history_statistics, last_verdicts, rolling_verdicts


def test_positions_are_dense_and_sorted(skewed):
    frame, rows = skewed
    got = sharding.ordered_positions(rows, ["symbol", "ts", "id"]).select("_pos", "id").orderBy("_pos").collect()
    want = frame.sort_values(["symbol", "second", "id"])["id"].tolist()
    assert [r["_pos"] for r in got] == list(range(len(frame)))
    assert [r["id"] for r in got] == want


@pytest.mark.parametrize("limit", [0, 10**6])
def test_quantiles_match_numpy(skewed, limit):
    frame, rows = skewed
    probs = (0.0, 0.25, 0.5, 0.95, 1.0)
    names = ("a", "b", "c", "d", "e")
    got = {r["symbol"]: r[1:] for r in
           sharding.grouped_quantiles(rows, ["symbol"], "price", probs, names, group_limit=limit).collect()}
    assert set(got) == set(frame["symbol"])
    for symbol, part in frame.groupby("symbol"):
        assert np.allclose(got[symbol], np.quantile(part["price"], probs), atol=1e-9)


def test_quantiles_of_one_repeated_value(spark):
    rows = spark.range(5000).select(F.lit("X").alias("symbol"), F.lit(2.5).alias("price"))
    got = sharding.grouped_quantiles(rows, ["symbol"], "price", (0.25, 0.75), ("q1", "q3"), group_limit=0).collect()
    assert [tuple(r) for r in got] == [("X", 2.5, 2.5)]


def test_quantiles_leave_out_null_and_nan(spark):
    rows = spark.createDataFrame([("X", 1.0), ("X", None), ("X", float("nan")), ("X", 3.0)], "symbol STRING, price DOUBLE")
    for limit in (0, 100):
        got = sharding.grouped_quantiles(rows, ["symbol"], "price", (0.5,), ("m",), group_limit=limit).first()
        assert got["m"] == 2.0


@pytest.mark.parametrize("chunk_rows", [20, 33, 1000])
def test_chunked_frames_equal_plain_window(skewed, chunk_rows):
    _, rows = skewed
    columns = {"n": lambda w: F.count("price").over(w), "mean": lambda w: F.round(F.avg("price").over(w), 6),
               "first": lambda w: F.first("id").over(w)}
    plain = sharding.preceding_rows(rows, ["symbol"], ["ts", "id"], 20, columns)
    split = sharding.preceding_rows(rows, ["symbol"], ["ts", "id"], 20, columns, group_limit=0, chunk_rows=chunk_rows)
    names = ["id", "n", "mean", "first"]
    assert sorted(map(tuple, plain.select(names).collect()), key=str) == \
        sorted(map(tuple, split.select(names).collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast(skewed, how):
    _, rows = skewed
    lookup = rows.filter("symbol <> 'S1'").groupBy("symbol").agg(F.count("*").alias("n"))
    small = sharding.attach(rows, lookup, ["symbol"], how)
    large = sharding.attach(rows, lookup, ["symbol"], how, rows=0, share=300)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().toString()
    assert sorted(map(tuple, small.select(sorted(small.columns)).collect()), key=str) == \
        sorted(map(tuple, large.select(sorted(large.columns)).collect()), key=str)


def test_salted_join_spreads_the_hot_key(skewed):
    frame, rows = skewed
    joined = sharding.attach(rows, rows.groupBy("symbol").count(), ["symbol"], rows=0, share=100)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and joined.count() == len(frame)


def test_last_verdicts_do_not_depend_on_the_path(skewed):
    _, rows = skewed
    plain = sorted(map(tuple, last_verdicts(rows).collect()), key=str)
    split = sorted(map(tuple, last_verdicts(rows, group_limit=0).collect()), key=str)
    assert plain == split


def test_rolling_verdicts_do_not_depend_on_the_path(skewed):
    _, rows = skewed
    plain = rolling_verdicts(rows, 20).filter("is_anomaly").orderBy("id", "detection_method").collect()
    split = rolling_verdicts(rows, 20, group_limit=0, chunk_rows=50).filter("is_anomaly") \
        .orderBy("id", "detection_method").collect()
    assert len(plain) > 30
    assert [(r["id"], r["detection_method"], round(r["anomaly_score"], 9)) for r in plain] == \
        [(r["id"], r["detection_method"], round(r["anomaly_score"], 9)) for r in split]


@pytest.mark.parametrize("copies", [1, 2, 4])
def test_copies_of_the_newest_trade_count_alike_on_both_paths(spark, copies):
    old = [("A", 100.0 + i % 3 / 10, 10.0, i, i) for i in range(9)] + [("B", 5.0, 1.0, 1, 1)]
    rows = spark.createDataFrame(old + [("A", 400.0, 20.0, 50, 50)] * copies + [("B", 5.0, 1.0, 1, 1)] * (copies - 1),
                                 "symbol STRING, price DOUBLE, volume DOUBLE, second BIGINT, id BIGINT") \
        .withColumn("ts", F.timestamp_seconds("second"))
    both = [sorted((r["symbol"], r["history_n"], *[None if x is None else round(x, 9) for x in (r["mean"], r["std"], r["avg_volume"], r["q1"], r["q3"])])
                   for r in history_statistics(rows, group_limit=limit).collect()) for limit in (10**6, 0)]
    assert both[0] == both[1] and ("A", 8 + copies) in {r[:2] for r in both[0]}


def test_a_null_key_has_quantiles_on_both_paths(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), ("X", 5.0)], "symbol STRING, price DOUBLE")
    both = [sorted(map(tuple, sharding.grouped_quantiles(rows, ["symbol"], "price", (0.5,), ("m",), group_limit=limit).collect()), key=str)
            for limit in (10**6, 0)]
    assert both[0] == both[1] == [("X", 5.0), (None, 2.0)]


@pytest.mark.parametrize("shape", ["ties", "two values", "spread", "infinite"])
def test_quantiles_by_brackets_of_hard_keys(spark, shape):
    """A key of 20,000 rows with next to no room: many rounds, ranks on the borders of ties."""
    rng = np.random.default_rng(4)
    values = {"ties": np.round(rng.exponential(1, 20_000), 1), "two values": np.r_[np.zeros(5000), np.ones(15_000)],
              "spread": rng.normal(0, 1, 20_000) * 10.0 ** rng.integers(-9, 9, 20_000),
              "infinite": np.r_[np.full(6000, -np.inf), rng.normal(0, 1, 8000), np.full(6000, np.inf)]}[shape]
    rows = spark.createDataFrame([(None if i % 2 else "X", float(x), 1 + i % 3) for i, x in enumerate(rng.permutation(values))],
                                 "symbol STRING, price DOUBLE, n INT").repartition(6)
    probs, names = (0.25, 0.7500125, 1.0), ("a", "b", "c")
    for weight in ("n",) if shape == "ties" else (None,):
        both = []
        for limit in (10**9, 100):
            found = sharding.grouped_quantiles(rows, ["symbol"], "price", probs, names, group_limit=limit, weight=weight, accuracy=100)
            both.append({r["symbol"]: [x for x in r[1:]] for r in found.collect()})
        assert both[0].keys() == both[1].keys() == {None, "X"}
        for key in both[0]:
            assert both[0][key] == pytest.approx(both[1][key], rel=1e-12, nan_ok=True)


def test_a_large_key_of_few_values_needs_no_brackets(spark, monkeypatch):
    rows = spark.range(20_000).selectExpr("if(id % 3 = 0, null, 'X') AS symbol", "double(id * id % 41) AS price", "1 + id % 4 AS n")
    probs, names = (0.25, 0.7500125, 1.0), ("a", "b", "c")
    wanted = sharding.grouped_quantiles(rows, ["symbol"], "price", probs, names, group_limit=10**9, weight="n").collect()
    monkeypatch.setattr(sharding, "_counted", None)
    got = sharding.grouped_quantiles(rows, ["symbol"], "price", probs, names, group_limit=100, weight="n").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, wanted), key=str) and len(got) == 2


def test_no_tally_is_stored(skewed, monkeypatch):
    stored = []
    plain = sharding.cut
    monkeypatch.setattr(sharding, "cut", lambda df: stored.append(plain(df)) or stored[-1])
    assert sharding.grouped_quantiles(skewed[1], ["symbol"], "price", (0.5,), ("m",), group_limit=100).count() == 41
    assert stored and max(df.count() for df in stored) == 41


@pytest.mark.parametrize("odd", [float("inf"), float("-inf"), float("nan")])
def test_odd_prices_flag_nothing(spark, odd):
    rows = spark.createDataFrame([("A", 100.0 + i % 3 if i != 4 else odd, 10.0, i, i) for i in range(12)],
                                 "symbol STRING, price DOUBLE, volume DOUBLE, second BIGINT, id BIGINT") \
        .withColumn("ts", F.timestamp_seconds("second"))
    assert [r for limit in (10**6, 0) for r in last_verdicts(rows, group_limit=limit).collect() if r["is_anomaly"]] == []
