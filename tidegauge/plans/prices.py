"""Price and sentiment questions. `now` is a column, so a question can be asked of any moment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalars import at_or_after, clamp_unit, fixed, or_default, seconds, sentiment_band
from tidegauge.operators.latest import latest_per_key, percent_change, rebased

QUOTE_COLUMNS = ("symbol", "current_price", "change", "percent_change", "high_price", "low_price",
                 "open_price", "prev_close", "quoted_at")


def recent_trades(trades: DataFrame, symbol: str, now: Column, minutes: int = 60) -> DataFrame:
    return (trades.filter((F.col("symbol") == symbol)
                          & at_or_after(trades, "trade_timestamp", now - seconds(minutes * 60)))
            .orderBy("trade_timestamp", "id"))


def metrics_latest(metrics: DataFrame, symbol: str, window_size: str, limit: int = 100) -> DataFrame:
    return (metrics.filter((F.col("symbol") == symbol) & (F.col("window_size") == window_size))
            .orderBy(F.col("window_start").desc(), *[F.col(c).desc() for c in ("id",) if c in metrics.columns]).limit(limit))


def latest_quotes(quotes: DataFrame) -> DataFrame:
    shown = ("symbol", "current_price", "change", "percent_change", "high_price", "low_price", "quoted_at")
    return latest_per_key(quotes.select("id", *shown), "symbol", ("quoted_at", "id")).select(*shown)


def latest_sentiment(scores: DataFrame) -> DataFrame:
    shown = ("symbol", "sentiment_score", "scored_at")
    return latest_per_key(scores.select("id", *shown), "symbol", ("scored_at", "id")).select(*shown)


def _watch_list(rows: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """The watched symbols as rows. Latest rows filtered to them are as few, so they may be broadcast."""
    return rows.sparkSession.createDataFrame([(s,) for s in symbols], "symbol STRING")


def ticker_snapshot(quotes: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """Price and change of every watched symbol; a dash for one without quotes."""
    latest = latest_quotes(quotes.filter(F.col("symbol").isin(*symbols)))
    seen = F.col("quoted_at").isNotNull()
    price = or_default(F.col("current_price"), F.lit(0.0))
    change = or_default(F.col("percent_change"), F.lit(0.0))
    return _watch_list(quotes, symbols).join(F.broadcast(latest), "symbol", "left").select(
        "symbol",
        fixed("$%.2f", F.when(seen, price)).alias("price"),
        F.when(seen, F.printf(F.lit("%+.2f%%"), change)).otherwise("no data").alias("delta"),
    )


def quote_history(quotes: DataFrame, now: Column, hours: int = 1, symbols: Sequence[str] | None = None) -> DataFrame:
    """Quotes of the last hours in time order, ties by id."""
    recent = quotes.filter(at_or_after(quotes, "quoted_at", now - seconds(hours * 3600)))
    if symbols is not None:
        recent = recent.filter(F.col("symbol").isin(*symbols))
    return recent.orderBy("quoted_at", "id")


def normalised_prices(quotes: DataFrame) -> DataFrame:
    """All series scaled to 100 at their first price."""
    rows = quotes.select("id", "symbol", "quoted_at", F.col("current_price").cast("double").alias("current_price"))
    return rebased(rows, "symbol", "current_price", ("quoted_at", "id"))


def price_change(quotes: DataFrame) -> DataFrame:
    rows = quotes.select("id", "symbol", "quoted_at", F.col("current_price").cast("double").alias("current_price"))
    return percent_change(rows, "symbol", "current_price", ("quoted_at", "id"))


def sentiment_gauge(scores: DataFrame, symbols: Sequence[str] | None = None) -> DataFrame:
    """Gauge values per symbol; 50 percent when the score is 0 or missing."""
    if symbols is None:
        latest = latest_sentiment(scores)
    else:
        known = latest_sentiment(scores.filter(F.col("symbol").isin(*symbols)))
        latest = _watch_list(scores, symbols).join(F.broadcast(known), "symbol", "left")
    value = clamp_unit(or_default(F.col("sentiment_score").cast("double"), F.lit(0.5))) * 100
    return latest.select("symbol", value.alias("percent")).select(
        "symbol", "percent", sentiment_band(F.col("percent")).alias("band"),
        (F.col("percent") - 50).alias("delta"))


def sentiment_history(scores: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    """Scores of the last hours in time order, with the two reference lines."""
    return (scores.filter(at_or_after(scores, "scored_at", now - seconds(hours * 3600)))
            .select("id", "symbol", "scored_at", "sentiment_score",
                    F.lit(0.6).alias("bullish_line"), F.lit(0.4).alias("bearish_line"))
            .orderBy("scored_at", "id"))
