"""Topic messages: decode, normalise, encode. All functions work in batch and in streaming.

Inputs carry the message text in a column `value` (a Kafka source or landed JSON lines).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegauge import schemas
from tidegauge.functions.scalars import finite, iso_utc, or_default, parse_time


def read_topic(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Streaming source; the Kafka connector must be on the cluster's class path."""
    return (spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic)
            .option("startingOffsets", "latest")
            .option("failOnDataLoss", "false")
            .options(**options).load())


def write_topic(messages: DataFrame, servers: str, topic: str) -> None:
    """Batch sink for `key`, `value` rows."""
    (messages.write.format("kafka").option("kafka.bootstrap.servers", servers)
     .option("topic", topic).save())


def stream_to_topic(messages: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """Streaming sink for `key`, `value` rows."""
    return (messages.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("topic", topic).option("checkpointLocation", checkpoint).start())


def decode(messages: DataFrame, schema: str, keep: Sequence[str] = ()) -> DataFrame:
    """Parse `value`; text that is not JSON gives a row of nulls, extra fields are dropped.

    The parsed fields leave through a generator, over which no filter moves: each text is parsed once.
    `keep` names columns of the messages to keep.
    """
    return messages.select(*keep, F.inline(F.array(F.from_json(F.col("value").cast("string"), schema))))


def decode_trades(messages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Trades with event time `ts`; rows without symbol or parseable time are dropped, NaN and infinities are null."""
    return (decode(messages, schemas.TRADE_MSG, keep)
            .withColumns({"ts": parse_time(F.col("trade_timestamp")),
                          "price": finite(F.col("price")),
                          "volume": finite(F.col("volume")),
                          "conditions": F.coalesce("conditions", F.array().cast("array<string>"))})
            .filter(F.col("ts").isNotNull() & F.col("symbol").isNotNull()))


def decode_quotes(messages: DataFrame) -> DataFrame:
    return decode(messages, schemas.QUOTE_MSG)


def decode_news(messages: DataFrame) -> DataFrame:
    """Articles with publication time `published_at`."""
    return decode(messages, schemas.NEWS_MSG).withColumn("published_at", F.timestamp_seconds("datetime"))


def decode_sentiment(messages: DataFrame) -> DataFrame:
    return decode(messages, schemas.SENTIMENT_MSG)


def decode_anomalies(messages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return (decode(messages, schemas.ANOMALY_MSG, keep)
            .withColumn("detected_at", parse_time(F.col("detected_at"))))


def feed_trades(messages: DataFrame) -> DataFrame:
    """One trade per element of each feed frame of type `trade`; other frames are dropped."""
    element = decode(messages, schemas.FEED_ENVELOPE).filter(F.col("type") == "trade").select(
        F.explode("data").alias("e"))
    moment = F.timestamp_millis(F.coalesce("e.t", F.lit(0).cast("bigint")))
    return element.select(
        F.coalesce("e.s", F.lit("UNKNOWN")).alias("symbol"),
        F.coalesce("e.p", F.lit(0.0)).alias("price"),
        F.coalesce("e.v", F.lit(0.0)).alias("volume"),
        iso_utc(moment).alias("trade_timestamp"),
        F.coalesce("e.c", F.array().cast("array<string>")).alias("conditions"),
        moment.alias("ts"),
    )


def quote_rows(quotes: DataFrame, now: Column) -> DataFrame:
    """Quote snapshots with a price, in table columns, stamped with processing time."""
    return quotes.filter(F.col("c").isNotNull()).select(
        "symbol",
        F.col("c").alias("current_price"),
        F.col("d").alias("change"),
        F.col("dp").alias("percent_change"),
        F.col("h").alias("high_price"),
        F.col("l").alias("low_price"),
        F.col("o").alias("open_price"),
        F.col("pc").alias("prev_close"),
        now.alias("quoted_at"),
    )


def sentiment_rows(messages: DataFrame, now: Column) -> DataFrame:
    """Flattened sentiment; the score is the bullish share, or the news score when that is 0 or missing."""
    body = [c for c in messages.columns if c != "symbol"]
    return messages.filter(F.coalesce(*[F.col(c).cast("string") for c in body]).isNotNull()).select(
        "symbol",
        F.col("buzz.articlesInLastWeek").alias("buzz_articles_in_last_week"),
        F.col("buzz.weeklyAverage").alias("buzz_weekly_average"),
        F.col("companyNewsScore").alias("company_news_score"),
        F.col("sectorAverageBullishPercent").alias("sector_avg_bullish"),
        F.col("sectorAverageBearishPercent").alias("sector_avg_bearish"),
        or_default(F.col("sentiment.bullishPercent"), F.col("companyNewsScore")).alias("sentiment_score"),
        now.alias("scored_at"),
    )


def first_arrivals(articles: DataFrame, arrival: list[str], key: str = "id") -> DataFrame:
    """Each article once, the first to arrive; articles without id count as one."""
    first = articles.groupBy(key).agg(F.min(F.struct(*arrival)).alias("_first"))
    at = first.select(F.col(key).alias("_key"), "_first")
    # Only keys and arrivals are aggregated; whole articles meet their first arrival and ties among few rows.
    met = articles.join(at, articles[key].eqNullSafe(at["_key"]) & (F.struct(*arrival) == at["_first"])).drop("_first", "_key")
    return met.dropDuplicates([key])


def encode(rows: DataFrame, key: str | None, columns: list[str] | None = None) -> DataFrame:
    """Rows as `key`, `value` messages; without key column the key is null."""
    body = F.to_json(F.struct(*[F.col(c) for c in (columns or rows.columns)]))
    return rows.select(
        (F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"),
        body.alias("value"),
    )
