"""Mergeable statistics of trades, and trailing windows that reach back over batches.

Trades of a symbol in a cell of time are folded into a few numbers: counts, mean, sum of squares around it, extremes,
volume, price x volume. Two such records merge by the parallel variance rule, so a window over stored cells reads a row per
cell in place of its trades. Only cells that a window's border cuts are read as trades.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalars import seconds
from tidegauge.operators.windows import volume_weighted
from tidegauge.schemas import WINDOWS

# Statistics of a record: rows, prices, their mean and sum of squares around it, and what adds up or is compared.
FIELDS = ("n", "k", "mean", "squares", "volume", "price_volume", "low", "high")


def record(inside: Column | None = None) -> Column:
    """Aggregate of trades (of those `inside`) as one record."""
    def of(column: Column) -> Column:
        return column if inside is None else F.when(inside, column)

    price = of(F.col("price"))
    return F.struct(
        F.count(of(F.lit(1))).alias("n"), F.count(price).alias("k"), F.avg(price).alias("mean"),
        (F.var_pop(price) * F.count(price)).alias("squares"), F.sum(of(F.col("volume"))).alias("volume"),
        F.sum(of(F.col("price") * F.col("volume"))).alias("price_volume"), F.min(price).alias("low"), F.max(price).alias("high"))


def _add(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


def merged(a: Column, b: Column) -> Column:
    """The record of both records' trades together."""
    k = (a["k"] + b["k"]).cast("double")
    apart = b["mean"] - a["mean"]
    part = F.try_divide(b["k"], k)
    mean = F.coalesce(a["mean"] + apart * part, a["mean"], b["mean"])
    squares = F.coalesce(a["squares"] + b["squares"] + apart * apart * a["k"] * part, a["squares"], b["squares"])
    return F.struct((a["n"] + b["n"]).alias("n"), (a["k"] + b["k"]).alias("k"), mean.alias("mean"), squares.alias("squares"),
                    _add(a["volume"], b["volume"]).alias("volume"), _add(a["price_volume"], b["price_volume"]).alias("price_volume"),
                    F.least(a["low"], b["low"]).alias("low"), F.greatest(a["high"], b["high"]).alias("high"))


def cells(trades: DataFrame, length: int) -> DataFrame:
    """One row per symbol and cell of `length` seconds: symbol, cell_start, and the record's fields."""
    micros = length * 1_000_000
    at = F.unix_micros("ts")
    start = F.timestamp_micros(at - F.pmod(at, F.lit(micros)))
    known = trades.filter(F.col("symbol").isNotNull() & F.col("ts").isNotNull())
    return known.groupBy("symbol", start.alias("cell_start")).agg(record().alias("_r")).select("symbol", "cell_start", "_r.*")


def _cell_of(moment: Column, micros: int) -> Column:
    at = F.unix_micros(moment)
    return at - F.pmod(at, F.lit(micros))


def reaching_metrics(trades: DataFrame, stored_cells: DataFrame, stored_trades: DataFrame, length: int,
                     windows: Sequence[tuple[str, int]] = WINDOWS) -> DataFrame:
    """Trailing windows ending at the newest of `trades`, over these and all stored ones up to that moment.

    `stored_cells` are `cells` of earlier batches, several rows for a cell if several batches had trades of it, and
    `stored_trades` are the trades (symbol, price, volume, ts) behind them. Of the latter only cells that hold a window's
    start or the end are read: both filters are on time and reach the scan. Records of a symbol and window are
    at most as many as cells in the window times batches that had trades in them; they are merged in one order.
    """
    micros = length * 1_000_000
    timed = trades.filter(F.col("ts").isNotNull() & F.col("symbol").isNotNull())
    end = timed.agg(F.max("ts")).first()[0]
    if end is None:
        return _results(timed.groupBy("symbol").agg(record().alias("_r")).select(
            "symbol", F.lit("").alias("window_size"), F.lit(None).cast("timestamp").alias("window_start"),
            F.lit(None).cast("timestamp").alias("window_end"), "_r").limit(0))
    last = F.lit(end)
    starts = [last - seconds(span) for _, span in windows]
    longest = max(range(len(windows)), key=lambda i: windows[i][1])

    # A cell counts as a whole if it begins in the window and ends no later than the window.
    begin = F.unix_micros("cell_start")
    closed = stored_cells.filter((F.col("cell_start") >= starts[longest]) & (begin + micros - 1 <= F.unix_micros(last)))
    whole = closed.select("symbol", F.struct(*FIELDS).alias("_r"), F.explode(F.filter(
        F.array(*[F.when(F.col("cell_start") >= s, F.lit(i)) for i, s in enumerate(starts)]), lambda i: i.isNotNull())).alias("_w"))

    # What the borders cut: trades of the cells that hold a start, or the end.
    cut = [_cell_of(s, micros) for s in starts] + [_cell_of(last, micros)]
    own = F.unix_micros("ts")
    near = stored_trades.filter((F.col("ts") >= F.timestamp_micros(_cell_of(starts[longest], micros))) & (F.col("ts") <= last)
                                & F.coalesce(*[F.when((own >= c) & (own < c + micros), True) for c in cut], F.lit(False)))
    # A stored trade of a cell that counts as a whole in a window is in that cell's record already.
    at_cell = own - F.pmod(own, F.lit(micros))
    columns = ["symbol", "price", "volume", "ts"]
    loose = timed.select(*columns, F.lit(False).alias("_stored")).unionByName(
        near.select(*columns).withColumn("_stored", F.lit(True)))
    aggregates = []
    for i, s in enumerate(starts):
        counted = (at_cell >= F.unix_micros(s)) & (at_cell + micros - 1 <= F.unix_micros(last))
        aggregates.append(record((F.col("ts") >= s) & (F.col("ts") <= last) & ~(F.col("_stored") & counted)).alias(f"_r{i}"))
    folded = loose.groupBy("symbol").agg(*aggregates).select(
        "symbol", F.inline(F.array(*[F.struct(F.col(f"_r{i}").alias("_r"), F.lit(i).alias("_w")) for i in range(len(starts))])))

    # Sorted, so that sums do not depend on which task came first.
    gathered = whole.unionByName(folded).filter(F.col("_r.n") > 0).groupBy("symbol", "_w").agg(
        F.sort_array(F.collect_list("_r")).alias("_all"))
    total = F.aggregate(F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(0))), F.get("_all", F.lit(0)), merged)
    label = F.array(*[F.struct(F.lit(name).alias("window_size"), s.alias("window_start")) for (name, _), s in zip(windows, starts)])
    return _results(gathered.select("symbol", F.get(label, F.col("_w")).alias("_l"), total.alias("_r")).select(
        "symbol", "_l.*", last.alias("window_end"), "_r"))


def _results(rows: DataFrame) -> DataFrame:
    """Records as window metrics."""
    k, total = F.col("_r.k"), F.coalesce("_r.volume", F.lit(0.0))
    spread = F.when(k > 1, F.sqrt(F.col("_r.squares") / (k - 1)))
    return rows.select(
        "symbol", "window_size", "window_start", "window_end", F.col("_r.mean").alias("avg_price"),
        F.when(F.col("_r.n") > 1, spread).otherwise(0.0).alias("std_dev"), total.alias("total_volume"),
        F.col("_r.n").alias("trade_count"), volume_weighted(F.col("_r.price_volume"), total, F.col("_r.mean")).alias("vwap"),
        F.col("_r.low").alias("min_price"), F.col("_r.high").alias("max_price"))
