import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import iforest
from tidegauge.schemas import FEATURES


@pytest.fixture(scope="module")
def metrics(spark):
    rng = np.random.default_rng(3)
    n = 900
    frame = pd.DataFrame({name: rng.normal(100, 5, n) for name in FEATURES})
    frame["symbol"] = np.where(np.arange(n) % 3 == 0, "HOT", "S" + pd.Series(np.arange(n) % 5).astype(str))
    frame["minute"] = np.arange(n)
    for name in FEATURES:
        frame.loc[:5, name] = 300.0 + np.arange(6)
    return spark.createDataFrame(frame).select(
        "symbol", F.lit("5m").alias("window_size"), F.timestamp_seconds(F.col("minute") * 60).alias("window_start"),
        *FEATURES).cache()


@pytest.fixture(scope="module")
def forest(metrics):
    return iforest.fit(metrics, ["symbol", "window_start"])


def walk(nodes, x):
    """Path length of one row in one tree, by plain recursion."""
    node = nodes[0]
    while node["feature"] >= 0:
        node = nodes[2 * node["node"] + (2 if x[node["feature"]] > node["split"] else 1)]
    return node["depth"] + float(iforest.path_correction(np.array([node["size"]]))[0])


def test_trees_are_sound(forest):
    nodes = forest.nodes.collect()
    assert {r["tree"] for r in nodes} == set(range(100))
    assert forest.sample == 256
    for tree in range(100):
        kept = {r["node"]: r for r in nodes if r["tree"] == tree}
        assert kept[0]["size"] == 256 and max(r["depth"] for r in kept.values()) <= 8
        for r in kept.values():
            if r["feature"] >= 0:
                assert kept[2 * r["node"] + 1]["size"] + kept[2 * r["node"] + 2]["size"] == r["size"]


def test_scores_match_plain_walk(metrics, forest):
    nodes = {}
    for r in forest.nodes.collect():
        nodes.setdefault(r["tree"], {})[r["node"]] = r
    norm = float(iforest.path_correction(np.array([256]))[0])
    for r in iforest.isolation_scores(metrics, forest).limit(40).collect():
        x = [(r[f] - m) / s for f, m, s in zip(FEATURES, forest.means, forest.scales)]
        depth = np.mean([walk(tree, x) for tree in nodes.values()])
        assert r["iso_score"] == pytest.approx(2 ** (-depth / norm), abs=1e-9)


def test_flags_the_planted_outliers(metrics, forest):
    got = iforest.isolation_verdicts(metrics, forest).filter("is_anomaly").collect()
    assert len(got) == 45                          # 5 percent of 900
    assert sum(r["avg_price"] >= 300 for r in got) == 6
    for r in got:
        assert r["detection_method"] == "isolation_forest" and r["anomaly_type"] == "ml_anomaly"
        assert r["anomaly_score"] == pytest.approx(min(1.0, 0.5 + r["iso_score"]))
        assert r["iso_score"] > forest.threshold and r["value"] == r["avg_price"]


def test_model_does_not_depend_on_partitioning(metrics, forest):
    again = iforest.fit(metrics.repartition(13), ["symbol", "window_start"], group_limit=0)
    assert again.threshold == pytest.approx(forest.threshold, abs=1e-12)
    key = lambda r: (r["tree"], r["node"])
    pairs = zip(sorted(forest.nodes.collect(), key=key), sorted(again.nodes.collect(), key=key), strict=True)
    for one, other in pairs:
        assert (key(one), one["feature"], one["size"]) == (key(other), other["feature"], other["size"])
        assert one["split"] == pytest.approx(other["split"], abs=1e-9)


def test_large_input_is_drawn_down(spark):
    rows = spark.range(30000).select(
        F.col("id").alias("key"), *[F.xxhash64("id", F.lit(i)).cast("double").alias(f) for i, f in enumerate(FEATURES)])
    drawn = iforest._tree_samples(rows, ["key"], 30000, trees=4, sample=32)
    counts = [r["count"] for r in drawn.groupBy("tree").count().collect()]
    assert len(counts) == 4 and all(64 < c < 256 for c in counts)


def test_save_and_load(spark, forest, tmp_path):
    path = str(tmp_path / "model")
    assert iforest.load(spark, path) is None
    forest.save(path)
    kept = iforest.load(spark, path)
    assert (kept.means, kept.scales, kept.sample, kept.threshold) == \
        (forest.means, forest.scales, forest.sample, forest.threshold)
    assert sorted(map(tuple, kept.nodes.collect())) == sorted(map(tuple, forest.nodes.collect()))


def test_without_model_nothing_is_flagged(metrics):
    got = iforest.isolation_verdicts(metrics, None)
    assert got.count() == 900 and got.filter("is_anomaly").count() == 0


def test_too_few_rows_give_no_model(metrics):
    assert iforest.fit(metrics.limit(19), ["symbol", "window_start"]) is None


def test_missing_features_count_as_zero_and_flat_ones_scale_by_one(spark):
    rows = spark.createDataFrame([(None, 2.0, 1.0, 1.0, 3), (4.0, 2.0, 2.0, 1.0, 5)],
                                 ", ".join(f"{f} DOUBLE" for f in FEATURES[:4]) + ", trade_count BIGINT")
    got = {r["feature"]: (r["mean"], r["scale"]) for r in iforest.scaling(rows).collect()}
    assert got == {"avg_price": (2.0, 2.0), "total_volume": (2.0, 1.0), "std_dev": (1.5, 0.5), "vwap": (1.0, 1.0),
                   "trade_count": (4.0, 1.0)}


def test_training_rows_filter_size_and_symbols(spark):
    rows = spark.createDataFrame([("A", "5m", i) for i in range(9)] + [("A", "1m", 99), ("B", "5m", 3), (None, "5m", 1)],
                                 "symbol STRING, window_size STRING, window_start BIGINT")
    got = iforest.training_rows(rows, per_symbol=4)
    assert sorted((r["symbol"], r["window_start"]) for r in got.collect()) == \
        [("A", 5), ("A", 6), ("A", 7), ("A", 8), ("B", 3)]
    assert iforest.training_rows(rows, symbols=["B"]).count() == 1
