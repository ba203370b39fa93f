import json
import math

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import rules
from tidegauge.operators import detectors

B = [100.0, 100.1, 99.9, 100.2, 100.0, 100.1, 99.8, 100.3]
R = [float(x) for x in range(50, 150)]
FLAT7 = [100.0] * 7

# (case, method, parameter, history, current, flagged, severity or None, score or None)
CASES = [
    ("z1", "zscore", 3.0, [100, 101, 99.5, 100.5, 100.2, 99.8, 101.5, 100.1], 100.4, False, "low", 0.0),
    ("z2", "zscore", 3.0, [100.0] * 20, 100.05, False, "low", 0.0),
    ("z3", "zscore", 3.0, B, 200.0, True, "critical", 623.2978),
    ("z4", "zscore", 3.0, B, 50.0, True, "critical", 312.1166),
    ("z5", "zscore", 3.0, [100.0] * 8 + [101.0, 99.0], 500.0, True, "critical", 848.5281),
    ("z6", "zscore", 3.0, [100.0, 101.0], 200.0, False, "low", 0.0),
    ("z7", "zscore", 3.0, [100.0] * 10, 100.0, False, "low", 0.0),
    ("z8", "zscore", 2.0, [99, 100, 101, 100, 99.5, 100.5, 100.2, 99.8], 103.0, True, "high", 4.9415),
    ("z five rows", "zscore", 3.0, [1.0, 2.0, 3.0, 4.0, 5.0], 50.0, True, "critical", None),
    ("z four rows", "zscore", 3.0, [1.0, 2.0, 3.0, 4.0], 50.0, False, "low", 0.0),
    ("z low", "zscore", 2.0, [98.0, 99.0, 100.0, 101.0, 102.0], 100 + 2.5 * math.sqrt(2.5), True, "low", 2.5),
    ("i1", "iqr", 1.5, R, 99.0, False, "low", 0.0),
    ("i2", "iqr", 1.5, [10, 12, 11, 10.5, 11.5, 12.5, 9.5, 10.8], 13.0, False, "low", 0.0),
    ("i3", "iqr", 1.5, R, 500.0, True, "high", 6.0909),
    ("i4", "iqr", 1.5, R, -100.0, True, "low", 2.0303),
    ("i5", "iqr", 1.5, [10.0, 11.0], 500.0, False, "low", 0.0),
    ("i6", "iqr", 1.5, [100.0] * 10, 999.0, False, "low", 0.0),
    ("i on the fence", "iqr", 1.5, R, 198.5, False, "low", 0.0),
    ("i score 3", "iqr", 1.5, R, 198.5 + 3 * 49.5, True, "medium", 3.0),
    ("i score 6", "iqr", 1.5, R, 198.5 + 6 * 49.5, True, "high", 6.0),
    ("i score 9", "iqr", 1.5, R, 198.5 + 9 * 49.5, True, "critical", 9.0),
    ("v1", "volume_spike", 5.0, [100, 110, 90, 105, 95, 100, 108], 106.0, False, "low", 0.0),
    ("v2", "volume_spike", 5.0, FLAT7, 400.0, False, "low", 0.0),
    ("v3", "volume_spike", 5.0, FLAT7, 510.0, True, "low", 5.1),
    ("v4", "volume_spike", 5.0, FLAT7, 2100.0, True, "critical", 21.0),
    ("v5", "volume_spike", 5.0, [100.0, 200.0], 10000.0, False, "low", 0.0),
    ("v6", "volume_spike", 5.0, [0.0] * 7, 100.0, False, "low", 0.0),
    ("v7", "volume_spike", 5.0, FLAT7, 1000.0, True, "high", 10.0),
    ("v8", "volume_spike", 2.0, FLAT7, 250.0, True, "low", 2.5),
    ("v exactly five", "volume_spike", 5.0, FLAT7, 500.0, True, "low", 5.0),
    ("v 7.5", "volume_spike", 5.0, FLAT7, 750.0, True, "medium", 7.5),
    ("v 20", "volume_spike", 5.0, FLAT7, 2000.0, True, "critical", 20.0),
    ("v three rows", "volume_spike", 5.0, [100.0] * 3, 600.0, True, "low", 6.0),
]

CONTEXT = {
    "zscore": {"z_score", "mean", "std", "threshold"},
    "iqr": {"q1", "q3", "iqr", "lower_fence", "upper_fence", "k"},
    "volume_spike": {"current_volume", "avg_volume", "ratio", "threshold"},
}
TYPES = {"zscore": "price_spike", "iqr": "price_outlier", "volume_spike": "volume_spike"}


def as_trades(spark, cases):
    rows = [(i, case, float(x), float(x)) for case, history, current in cases
            for i, x in enumerate([*history, current])]
    return spark.createDataFrame(rows, "id BIGINT, symbol STRING, price DOUBLE, volume DOUBLE") \
        .withColumn("ts", F.timestamp_seconds(F.col("id")))


@pytest.fixture(scope="module")
def verdicts(spark):
    found = {}
    for method, parameter in {(c[1], c[2]) for c in CASES}:
        chosen = [(c[0], c[3], c[4]) for c in CASES if (c[1], c[2]) == (method, parameter)]
        for row in detectors.last_verdicts(as_trades(spark, chosen), (method,), threshold=parameter, k=parameter,
                                           volume_threshold=parameter).collect():
            found[row["symbol"]] = row
    return found


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_case(verdicts, case):
    name, method, parameter, _, current, flagged, severity, score = case
    got = verdicts[name]
    assert got["detection_method"] == method
    assert got["is_anomaly"] is flagged
    assert got["anomaly_type"] == (TYPES[method] if flagged else "none")
    assert got["severity"] == severity
    assert got["value"] == current
    if score is not None:
        assert got["anomaly_score"] == pytest.approx(score, abs=1e-4)
    assert (set(json.loads(got["context"])) == CONTEXT[method]) if flagged else got["context"] is None


def test_threshold_is_inclusive(spark):
    z = 4.941484
    stats = spark.createDataFrame([(z, 8, 0.0, 1.0)], "value DOUBLE, n BIGINT, mean DOUBLE, std DOUBLE")
    made = rules.zscore(F.col("value"), F.col("n"), F.col("mean"), F.col("std"), threshold=z)
    assert stats.select(made.alias("v")).first()["v"]["is_anomaly"]


def test_one_row_gives_no_verdict_and_bad_numbers_are_left_out(spark):
    trades = as_trades(spark, [("ONE", [], 5.0), ("NAN", B, float("nan")), ("OK", B, 500.0)])
    got = {(r["symbol"], r["detection_method"]): r["is_anomaly"] for r in detectors.last_verdicts(trades).collect()}
    assert not [key for key in got if key[0] == "ONE"]
    assert got["OK", "zscore"] and got["OK", "iqr"]
    assert not any(flag for (symbol, _), flag in got.items() if symbol == "NAN")


def test_obvious_spike_is_agreed_on(spark):
    got = detectors.agreement(detectors.last_verdicts(as_trades(spark, [("A", B, 500.0)]), ("zscore", "iqr"))).first()
    assert (got["methods_flagged"], got["methods"]) == (2, "iqr,zscore")


def test_events_carry_batch_means(spark):
    trades = as_trades(spark, [("A", FLAT7, 1000.0)])
    events = detectors.anomaly_events(detectors.last_verdicts(trades, ("volume_spike",)), trades, F.lit("now"))
    got = events.first()
    assert got["price"] == pytest.approx(212.5) and got["volume"] == pytest.approx(212.5)
    assert got["anomaly_score"] == 10.0 and json.loads(got["context"])["ratio"] == 10.0


def test_rolling_matches_last_row(spark):
    trades = as_trades(spark, [("A", B, 200.0)])
    got = detectors.rolling_verdicts(trades, 8).filter("id = 8").collect()
    last = detectors.last_verdicts(trades).collect()
    assert {(r["detection_method"], r["is_anomaly"], round(r["anomaly_score"], 6)) for r in got} == \
        {(r["detection_method"], r["is_anomaly"], round(r["anomaly_score"], 6)) for r in last}
