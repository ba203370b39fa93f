"""Detectors over keyed trades: last-against-history and rolling.

Input columns: id, symbol, price, volume, ts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import rules
from tidegauge.functions.scalars import finite, settled, sorted_quantile
from tidegauge.operators.latest import latest_per_key
from tidegauge.operators.sharding import (GROUP_LIMIT, VALUE_LIMIT, attach, grouped_quantiles, largest_group,
                                          preceding_rows)
from tidegauge.runtime import cut

STATISTICAL = ("zscore", "iqr", "volume_spike")
# Order of a symbol's trades; the history of the newest one is all rows but exactly one copy of it.
MOMENT = ("ts", "id", "price", "volume")


def clean_trades(trades: DataFrame) -> DataFrame:
    """Rows a detector may see: symbol and time known, price and volume real numbers."""
    return trades.withColumns({"price": finite(F.col("price")), "volume": finite(F.col("volume"))}).filter(
        F.col("symbol").isNotNull() & F.col("ts").isNotNull()
        & F.col("price").isNotNull() & F.col("volume").isNotNull())


def history_statistics(trades: DataFrame, quartiles: bool = True, group_limit: int = VALUE_LIMIT) -> DataFrame:
    """Per symbol: its last trade, and statistics of all trades before it.

    While every symbol is small, one shuffle by symbol serves both. Otherwise the last trade
    is found and attached to the rows, and no symbol is sorted or gathered.
    """
    keyed = clean_trades(trades).select("symbol", "price", "volume", "ts", "id")
    if largest_group(trades.filter(F.col("symbol").isNotNull()), ["symbol"]) <= group_limit:
        return _ranked_statistics(keyed, quartiles)
    return _attached_statistics(keyed, quartiles, group_limit)


def _ranked_statistics(keyed: DataFrame, quartiles: bool) -> DataFrame:
    newest = Window.partitionBy("symbol").orderBy(*[F.col(c).desc() for c in MOMENT])
    ranked = keyed.withColumn("_rank", F.row_number().over(newest))
    current, past = F.col("_rank") == 1, F.col("_rank") > 1
    price, volume = F.when(past, F.col("price")), F.when(past, F.col("volume"))
    wanted = [
        F.max(F.when(current, F.col("price"))).alias("current_price"),
        F.max(F.when(current, F.col("volume"))).alias("current_volume"),
        F.count_if(past).alias("history_n"),
        F.avg(price).alias("mean"),
        F.stddev_samp(price).alias("std"),
        F.avg(volume).alias("avg_volume"),
    ]
    if quartiles:
        wanted.append(F.percentile(price, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    result = ranked.groupBy("symbol").agg(*wanted).filter(F.col("history_n") > 0)
    return result.withColumns({"q1": F.col("_q")[0], "q3": F.col("_q")[1]}).drop("_q") if quartiles else result


def _attached_statistics(keyed: DataFrame, quartiles: bool, group_limit: int) -> DataFrame:
    last = cut(latest_per_key(keyed, "symbol", MOMENT))
    border = last.select("symbol", F.struct(*MOMENT).alias("_border"))
    placed = attach(keyed, border, ["symbol"], fixed=True).withColumn("_at", F.struct(*MOMENT))
    past = F.col("_at") < F.col("_border")
    before = placed.filter(past).drop("_at", "_border")
    # Copies of the newest row are all alike, so their number stands for them.
    earlier, amount = F.when(past, F.col("price")), F.when(past, F.col("volume"))
    known = placed.groupBy("symbol").agg(
        (F.count_if(F.col("_at") == F.col("_border")) - 1).alias("_copies"), F.count_if(past).alias("_n"),
        F.avg(earlier).alias("_mean"), F.var_pop(earlier).alias("_var"), F.sum(amount).alias("_volume"))
    joined = last.select("symbol", F.col("price").alias("current_price"), F.col("volume").alias("current_volume")).join(known, "symbol")
    n, k, price = F.coalesce("_n", F.lit(0)), F.col("_copies"), F.col("current_price")
    total = (n + k).cast("double")
    apart = price - F.coalesce("_mean", price)
    squares = F.coalesce(F.col("_var") * n, F.lit(0.0)) + apart * apart * n * k / total
    result = joined.filter(n + k > 0).select(
        "symbol", "current_price", "current_volume", (n + k).alias("history_n"),
        (F.coalesce("_mean", price) + apart * k / total).alias("mean"),
        F.when(n + k > 1, F.sqrt(squares / (total - 1))).alias("std"),
        ((F.coalesce("_volume", F.lit(0.0)) + F.col("current_volume") * k) / total).alias("avg_volume"))
    if quartiles:
        weighted = before.select("symbol", "price", F.lit(1).cast("bigint").alias("_w")).unionByName(
            joined.filter(k > 0).select("symbol", price.alias("price"), k.alias("_w")))
        fences = grouped_quantiles(weighted, ["symbol"], "price", (0.25, 0.75), ("q1", "q3"), group_limit, "_w")
        result = result.join(fences, "symbol")
    return result


def last_verdicts(trades: DataFrame, methods: Sequence[str] = STATISTICAL, threshold: float = 3.0,
                  k: float = 1.5, volume_threshold: float = 5.0, group_limit: int = VALUE_LIMIT) -> DataFrame:
    """One verdict per symbol and method on the symbol's last trade; symbols with one trade give none."""
    stats = history_statistics(trades, "iqr" in methods, group_limit)
    price, volume, n = F.col("current_price"), F.col("current_volume"), F.col("history_n")
    made = _verdicts(methods, price, volume, n, threshold, k, volume_threshold)
    return stats.select("symbol", F.inline(F.array(*made)))


def _verdicts(methods: Sequence[str], price: Column, volume: Column, n: Column,
              threshold: float, k: float, volume_threshold: float) -> list[Column]:
    made = {
        "zscore": lambda: rules.zscore(price, n, F.col("mean"), F.col("std"), threshold),
        "iqr": lambda: rules.iqr(price, n, F.col("q1"), F.col("q3"), k),
        "volume_spike": lambda: rules.volume_spike(volume, n, F.col("avg_volume"), volume_threshold),
    }
    return [made[method]() for method in methods]


def rolling_verdicts(trades: DataFrame, rows: int = 20, methods: Sequence[str] = STATISTICAL,
                     threshold: float = 3.0, k: float = 1.5, volume_threshold: float = 5.0,
                     group_limit: int = GROUP_LIMIT, **chunking: int) -> DataFrame:
    """Every trade scored against the `rows` trades of its symbol before it."""
    columns = {"history_n": lambda w: F.count("price").over(w)}
    if "zscore" in methods:
        columns["mean"] = lambda w: F.avg("price").over(w)
        columns["std"] = lambda w: F.stddev_samp("price").over(w)
    if "iqr" in methods:
        # A short frame is collected and sorted once for both quartiles.
        columns["_sorted"] = lambda w: F.sort_array(F.collect_list("price").over(w))
    if "volume_spike" in methods:
        columns["avg_volume"] = lambda w: F.avg("volume").over(w)
    base = clean_trades(trades).select("id", "symbol", "ts", "price", "volume")
    framed = preceding_rows(base, ["symbol"], ["ts", "id"], rows, columns, group_limit, **chunking)
    if "iqr" in methods:
        framed = framed.withColumns({"q1": sorted_quantile(F.col("_sorted"), 0.25),
                                     "q3": sorted_quantile(F.col("_sorted"), 0.75)})
    made = _verdicts(methods, F.col("price"), F.col("volume"), F.col("history_n"), threshold, k, volume_threshold)
    return framed.select("id", "symbol", "ts", "price", "volume", F.inline(F.array(*made)))


def flagged(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter("is_anomaly")


def agreement(verdicts: DataFrame) -> DataFrame:
    """How many and which detectors flag each symbol."""
    hit = F.when(F.col("is_anomaly"), F.col("detection_method"))
    return verdicts.groupBy("symbol").agg(
        F.count_if(F.col("is_anomaly")).alias("methods_flagged"),
        F.array_join(F.array_sort(F.collect_set(hit)), ",").alias("methods"),
    )


def batch_means(trades: DataFrame) -> DataFrame:
    """Mean price and volume per symbol, as logged with each anomaly."""
    return trades.filter(F.col("symbol").isNotNull()).groupBy("symbol").agg(
        F.avg("price").alias("price"), F.avg("volume").alias("volume"))


def anomaly_events(verdicts: DataFrame, trades: DataFrame, detected_at: Column) -> DataFrame:
    """Flagged verdicts as anomaly messages: rounded, with the batch means and detection time.

    Each mean is over the symbol's finite values of that column; without any it is null, and the verdict stays.
    """
    finite_rows = trades.withColumns({"price": finite(F.col("price")), "volume": finite(F.col("volume"))})
    return flagged(verdicts).join(batch_means(finite_rows), "symbol", "left").select(
        "symbol", "anomaly_type", "severity", "detection_method",
        settled(F.col("anomaly_score"), 6).alias("anomaly_score"),
        settled(F.col("price"), 4).alias("price"),
        settled(F.col("volume"), 4).alias("volume"),
        detected_at.alias("detected_at"),
        "context",
    )
