import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidegauge.runtime import build_session

    session = build_session("tests", "local[8]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def skewed(spark):
    """Trades in which one symbol holds a third of the rows, with ties in time and price."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    n = 6000
    symbol = np.where(np.arange(n) % 3 == 0, "HOT", np.char.add("S", (np.arange(n) % 40).astype(str)))
    seconds = np.sort(rng.integers(0, 4000, n))
    frame = pd.DataFrame({
        "id": np.arange(n), "symbol": symbol,
        "price": np.round(100 + rng.normal(0, 5, n), 1), "volume": rng.integers(0, 50, n).astype(float),
        "second": seconds})
    frame.loc[rng.choice(n, 40, replace=False), "price"] *= 3
    rows = spark.createDataFrame(frame).selectExpr(
        "id", "symbol", "price", "volume", "timestamp_seconds(1704067200 + second) ts")
    return frame, rows.repartition(7).cache()
