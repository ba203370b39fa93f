"""Window statistics per symbol.

Input columns: id, symbol, price, volume, ts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalars import finite, moment_key, seconds
from tidegauge.schemas import WINDOWS

CELL_ROWS = 100_000           # instants of a symbol that one cell of time may hold
TASK_ROWS = 1_000_000         # rows of cells that one task may sort


def volume_weighted(price_volume: Column, volume: Column, mean: Column) -> Column:
    """Volume-weighted mean; the plain mean when there is no volume."""
    return F.when(volume < 1e-9, mean).otherwise(F.try_divide(price_volume, volume))


def trailing_metrics(trades: DataFrame, windows: Sequence[tuple[str, int]] = WINDOWS) -> DataFrame:
    """Statistics of the trailing windows that end at the newest trade of the whole input.

    All windows come out of one pass: rows older than the longest window are dropped,
    then a single grouped aggregate holds one conditional set of statistics per window.
    """
    timed = trades.filter(F.col("ts").isNotNull() & F.col("symbol").isNotNull())
    end = timed.agg(F.max("ts")).scalar()
    longest = max(length for _, length in windows)
    recent = timed.withColumn("_end", end).filter(F.col("ts") >= F.col("_end") - seconds(longest))

    aggregates, records = [F.max("_end").alias("_end")], []
    for i, (label, length) in enumerate(windows):
        inside = F.col("ts") >= F.col("_end") - seconds(length)
        price, volume = F.when(inside, F.col("price")), F.when(inside, F.col("volume"))
        aggregates += [
            F.avg(price).alias(f"_avg{i}"),
            F.stddev_samp(price).alias(f"_std{i}"),
            F.sum(volume).alias(f"_vol{i}"),
            F.count_if(inside).alias(f"_n{i}"),
            F.sum(price * volume).alias(f"_pv{i}"),
            F.min(price).alias(f"_min{i}"),
            F.max(price).alias(f"_max{i}"),
        ]
        total = F.coalesce(F.col(f"_vol{i}"), F.lit(0.0))
        records.append(F.struct(
            F.lit(label).alias("window_size"),
            (F.col("_end") - seconds(length)).alias("window_start"),
            F.col("_end").alias("window_end"),
            F.col(f"_avg{i}").alias("avg_price"),
            F.when(F.col(f"_n{i}") > 1, F.col(f"_std{i}")).otherwise(0.0).alias("std_dev"),
            total.alias("total_volume"),
            F.col(f"_n{i}").alias("trade_count"),
            volume_weighted(F.col(f"_pv{i}"), total, F.col(f"_avg{i}")).alias("vwap"),
            F.col(f"_min{i}").alias("min_price"),
            F.col(f"_max{i}").alias("max_price"),
        ))
    return (recent.groupBy("symbol").agg(*aggregates)
            .select("symbol", F.inline(F.array(*records)))
            .filter(F.col("trade_count") > 0))


def _bars(grouped) -> DataFrame:
    moment = moment_key(F.col("ts"), F.col("id"))
    return grouped.agg(
        F.min_by("price", moment).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", moment).alias("close"),
        F.sum("volume").alias("volume"),
        F.sum(F.col("price") * F.col("volume")).alias("_pv"),
        F.sum("price").alias("_sum"),
        F.count("price").alias("_prices"),
        F.count(F.lit(1)).alias("trade_count"),
    )


def _bar_columns(bars: DataFrame, *leading: str) -> DataFrame:
    mean = F.try_divide(F.col("_sum"), F.col("_prices"))
    return bars.select(*leading, "symbol", "window_start", "window_end", "open", "high", "low", "close",
                       "volume", "trade_count", volume_weighted(F.col("_pv"), F.col("volume"), mean).alias("vwap"))


def ohlcv(trades: DataFrame, length: int, slide: int | None = None) -> DataFrame:
    """Event-time bars, tumbling or sliding. Also valid on a stream with a watermark on `ts`."""
    span = [f"{length} seconds"] + ([f"{slide} seconds"] if slide else [])
    bars = _bars(trades.filter(F.col("symbol").isNotNull()).groupBy(F.window("ts", *span).alias("w"), "symbol"))
    return _bar_columns(bars.withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")}))


def ohlcv_levels(trades: DataFrame, windows: Sequence[tuple[str, int]] = WINDOWS) -> DataFrame:
    """Tumbling bars at several lengths from one pass over the trades.

    The first length divides the others: its bars are computed from trades, the longer
    ones by merging those bars.
    """
    base = windows[0][1]
    if any(length % base for _, length in windows):
        raise ValueError("the first window length must divide the others")
    timed = trades.filter(F.col("symbol").isNotNull() & F.col("ts").isNotNull())
    second = F.unix_seconds("ts")
    # A plain number as window key: cheaper to hash and compare than a window struct.
    fine = _bars(timed.withColumn("_start", second - F.pmod(second, F.lit(base))).groupBy("_start", "symbol"))
    finest = fine.select("*", F.lit(windows[0][0]).alias("window_size"), F.lit(base).alias("_length"))
    levels = F.array(*[
        F.struct(F.lit(label).alias("window_size"), F.lit(length).alias("_length"),
                 (F.col("_start") - F.pmod(F.col("_start"), F.lit(length))).alias("_from"))
        for label, length in windows[1:]])
    merged = fine.select("*", F.inline(levels)).groupBy("window_size", "_length", "_from", "symbol").agg(
        F.min_by("open", "_start").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "_start").alias("close"),
        *[F.sum(c).alias(c) for c in ("volume", "_pv", "_sum", "_prices", "trade_count")],
    ).withColumnRenamed("_from", "_start")
    # Both branches read the same shuffled partial aggregate of the trades.
    bars = finest.unionByName(merged) if len(windows) > 1 else finest
    return _bar_columns(bars.withColumns({
        "window_start": F.timestamp_seconds("_start"),
        "window_end": F.timestamp_seconds(F.col("_start") + F.col("_length")),
    }), "window_size")


# Statistics of a record of trades; all but the moments combine by these.
_MERGE = {"_n": F.sum, "_k": F.sum, "_d1": F.sum, "_d2": F.sum, "_vol": F.sum, "_pv": F.sum, "_min": F.min, "_max": F.max}
_RECORD = ("_n", "_k", "_mean", "_squares", "_vol", "_pv", "_min", "_max")


def _add(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


_COMBINE = {name: {F.sum: _add, F.min: F.least, F.max: F.greatest}[how] for name, how in _MERGE.items()}


def _records(grouped) -> DataFrame:
    return grouped.agg(
        F.count(F.lit(1)).alias("_n"),
        F.count("price").alias("_k"),
        F.avg("price").alias("_mean"),
        (F.var_pop("price") * F.count("price")).alias("_squares"),
        F.sum("volume").alias("_vol"),
        F.sum(F.col("price") * F.col("volume")).alias("_pv"),
        F.min("price").alias("_min"),
        F.max("price").alias("_max"),
    )


def _cell(at: str, width: int) -> Column:
    return F.expr(f"({at} - pmod({at}, {width}L)) div {width}L")


def _reached(rows: DataFrame, width: int, shifts: dict[int, int], upto: int = 0, between: DataFrame | None = None,
             parts: int = 0) -> DataFrame:
    """Records `_r<i>` over what each of `rows` (symbol, _at, record) reaches back to, for each frame i.

    Places are cut into cells of `width`. A frame is as many cells long as its shift says, so it begins as far inside its
    first cell as the row lies inside its own: each row is copied into the cell that looks back to it, where a running
    aggregate from the end yields the frame's first cell, and one from the start (up to the row, or the one
    before it: `upto`) its last. What lies between, one record per frame and cell (_w, _cell), joins the former.
    """
    copies = [(-1, 0), *shifts.items()]
    placed = rows.select(
        "symbol", F.pmod("_at", F.lit(width).cast("bigint")).alias("_offset"), _cell("_at", width).alias("_own"), *_RECORD,
        F.inline(F.array(*[F.struct(F.lit(i).alias("_w"), F.lit(s).cast("bigint").alias("_shift")) for i, s in copies])))
    columns = ["symbol", (F.col("_own") + F.col("_shift")).alias("_cell"), "_offset", "_w", *_RECORD]
    placed = placed.select(*columns)
    if between is not None:
        placed = placed.unionByName(between.withColumn("_offset", F.lit(width).cast("bigint")))
    if parts:
        placed = placed.repartition(parts, "symbol", "_cell")

    # Moments around a mean price of the cell's rows stay exact where plain sums of squares would cancel.
    key = ("symbol", "_cell")
    falling = Window.partitionBy(*key).orderBy(F.col("_offset").desc())
    whole = falling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    price = finite(F.col("_mean"))
    weight = F.when(price.isNotNull(), F.col("_k"))
    centre = F.coalesce(F.sum(price * weight).over(whole) / F.nullif(F.sum(weight).over(whole), F.lit(0)), F.lit(0.0))
    apart = F.col("_mean") - F.col("_centre")
    centred = placed.withColumn("_centre", centre).withColumns({
        "_d1": apart * F.col("_k"), "_d2": F.col("_squares") + apart * apart * F.col("_k")}).drop("_mean", "_squares")
    backward = falling.rangeBetween(Window.unboundedPreceding, 0)
    tails = {f"_t{i}": F.struct(*[how(F.when(F.col("_w") == i, F.col(name))).over(backward).alias(name) for name, how in _MERGE.items()])
             for i in shifts}
    forward = Window.partitionBy(*key).orderBy("_offset").rowsBetween(Window.unboundedPreceding, upto)
    head = F.struct(*[how(name).over(forward).alias(name) for name, how in _MERGE.items()])
    framed = centred.withColumns(tails).filter(F.col("_w") == -1).withColumn("_head", head)

    found = []
    for i in shifts:
        stat = {name: _COMBINE[name](F.col(f"_head.{name}"), F.col(f"_t{i}.{name}")) for name in _MERGE}
        share = F.try_divide(stat["_d1"], stat["_k"])
        made = stat | {"_mean": F.col("_centre") + share, "_squares": F.greatest(stat["_d2"] - stat["_d1"] * share, F.lit(0.0))}
        found.append(F.struct(*[made[name].alias(name) for name in _RECORD]).alias(f"_r{i}"))
    return framed.select("symbol", (F.col("_cell") * width + F.col("_offset")).alias("_at"), *found)


def _cell_length(stamps: DataFrame, lengths: Sequence[int]) -> tuple[int, int]:
    """Seconds of a cell: the longest common divisor of `lengths` with few instants of a symbol in each; and the number of rows counted.

    Counts are of rows at first, and of instants if these are too many: a burst at one instant is one instant.
    """
    longest = gcd(*lengths)
    width, folded = longest, False
    while True:
        counts = stamps.groupBy("symbol", _cell("unix_micros(ts)", width * 1_000_000).alias("cell")).count()
        densest, total = counts.agg(F.max("count"), F.sum("count")).first()
        if (densest or 0) <= CELL_ROWS or width == 1 and folded:
            return width, total or 0
        if folded:
            width = max(d for d in range(1, width) if longest % d == 0 and (d == 1 or d * densest <= width * CELL_ROWS))
        else:
            stamps, folded = stamps.distinct(), True


def range_frame_metrics(trades: DataFrame, windows: Sequence[tuple[str, int]] = WINDOWS) -> DataFrame:
    """Trailing statistics at every instant that has a trade: one row per (symbol, ts).

    Trades of one instant share their frames, so they are folded first (a burst at one
    instant costs one row). Time is cut into cells that divide all frames. A frame is the end of one cell, whole cells, and the
    start of the row's own. Whole cells are records of their own, and a frame over them is put together the
    same way. A task sees a few cells of a symbol, never a frame, and cells get shorter as data get denser.
    """
    clean = trades.filter(F.col("symbol").isNotNull() & F.col("ts").isNotNull())
    lengths = [length for _, length in windows]
    width, total = _cell_length(clean.select("symbol", "ts"), lengths)
    micros = width * 1_000_000
    instants = _records(clean.groupBy("symbol", "ts")).withColumn("_at", F.unix_micros("ts"))
    cells = _records(clean.groupBy("symbol", _cell("unix_micros(ts)", micros).alias("_at")))
    # Of frames of two cells and more: the whole cells between the first and the row's own.
    between = [_reached(cells, length // width - 1, {i: 1}, -1).filter(F.col(f"_r{i}._n") > 0)
               .select("symbol", F.col("_at").alias("_cell"), F.lit(i).alias("_w"), f"_r{i}.*")
               for i, length in enumerate(lengths) if length > width]
    # More partitions than the session's only if these would hold too many rows.
    parts = -(-total * (len(windows) + 1) // TASK_ROWS)
    found = _reached(instants, micros, {i: length // width for i, length in enumerate(lengths)},
                     between=reduce(DataFrame.unionByName, between) if between else None,
                     parts=parts if parts > int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions")) else 0)
    results = []
    for i, (label, _) in enumerate(windows):
        k, mean = F.col(f"_r{i}._k"), F.col(f"_r{i}._mean")
        total_volume = F.coalesce(f"_r{i}._vol", F.lit(0.0))
        spread = F.sqrt(F.col(f"_r{i}._squares") / F.greatest(k - 1, F.lit(1)))
        results.append(F.struct(
            F.lit(label).alias("window_size"),
            mean.alias("avg_price"),
            F.when((k > 1) & (F.col(f"_r{i}._min") < F.col(f"_r{i}._max")), spread).otherwise(0.0).alias("std_dev"),
            total_volume.alias("total_volume"),
            F.col(f"_r{i}._n").alias("trade_count"),
            volume_weighted(F.col(f"_r{i}._pv"), total_volume, mean).alias("vwap"),
            F.col(f"_r{i}._min").alias("min_price"),
            F.col(f"_r{i}._max").alias("max_price"),
        ))
    return found.select("symbol", F.timestamp_micros("_at").alias("ts"), F.inline(F.array(*results)))
