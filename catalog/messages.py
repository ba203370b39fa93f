"""Queries on message decoding, normalisation, storage types and constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from catalog.registry import query
from tidegauge import schemas
from tidegauge.operators import quality
from tidegauge.sources import messages, tables
from tidegauge.runtime import scratch_path
from tidegauge.streaming import jobs

MILLIS = "%Y-%m-%dT%H:%M:%S.%g"


def _trade_texts(spark, sf):
    """Events as trade messages; some are not JSON, some have no valid time."""
    events = v.trades(spark, sf)
    moment = F.when(F.col("volume") == 0, "junk").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))
    body = F.to_json(F.struct("symbol", "price", "volume", moment.alias("trade_timestamp"),
                              F.lit(1).alias("extra")))
    return events.select(F.when(F.col("symbol") == "error", "not json").otherwise(body).alias("value"))


@query(f"""
SELECT symbol, price, volume, ts, 0::BIGINT AS conditions
FROM ({v.trades_sql()}) WHERE symbol <> 'error' AND volume <> 0""", settle=False)
def decode_trades(spark, sf):
    rows = messages.decode_trades(_trade_texts(spark, sf))
    return rows.select("symbol", "price", "volume", "ts", F.size("conditions").cast("bigint").alias("conditions"))


@query(f"""
SELECT symbol, price, volume, strftime(ts_ms, '{MILLIS}') || '+00:00' AS trade_timestamp, n AS conditions, ts_ms AS ts
FROM (
  SELECT CAST(user_id AS VARCHAR) AS symbol, value AS price, CAST({v.K} AS DOUBLE) AS volume,
         date_trunc('milliseconds', ts) AS ts_ms, 1::BIGINT AS n FROM events WHERE event_type <> 'error'
  UNION ALL
  SELECT 'UNKNOWN', value, 0, TIMESTAMP '1970-01-01', 0 FROM events WHERE event_type <> 'error')""", settle=False)
def feed_normalize(spark, sf):
    rows = v.table(spark, sf, "events")
    whole = F.struct(
        F.col("user_id").cast("string").alias("s"), F.col("value").alias("p"),
        F.from_json("props", "k INT")["k"].cast("double").alias("v"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.array(F.col("event_type")).alias("c"))
    bare = F.struct(F.lit(None).cast("string").alias("s"), F.col("value").alias("p"),
                    F.lit(None).cast("double").alias("v"), F.lit(None).cast("bigint").alias("t"),
                    F.lit(None).cast("array<string>").alias("c"))
    kind = F.when(F.col("event_type") == "error", "ping").otherwise("trade")
    texts = rows.select(F.to_json(F.struct(kind.alias("type"), F.array(whole, bare).alias("data"))).alias("value"))
    return messages.feed_trades(texts).withColumn("conditions", F.size("conditions").cast("bigint"))


@query(f"""
SELECT symbol, current_price, change, percent_change, high_price,
       low_price, open_price, prev_close,
       TIMESTAMP '2024-01-01' AS quoted_at
FROM ({v.QUOTES_SQL}) WHERE status <> 'P'""", settle=False)
def quote_normalize(spark, sf):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return messages.quote_rows(messages.decode_quotes(v.quote_messages(spark, sf)), now)


@query(f"""
SELECT CAST(user_id AS VARCHAR) AS symbol, {v.K} AS buzz_articles_in_last_week, value / 7 AS buzz_weekly_average,
       value / 500 AS company_news_score, 0.6::DOUBLE AS sector_avg_bullish, 0.4::DOUBLE AS sector_avg_bearish,
       coalesce(nullif({v.K} / 100.0::DOUBLE, 0), value / 500) AS sentiment_score,
       TIMESTAMP '2024-01-01' AS scored_at FROM events""", settle=False)
def sentiment_normalize(spark, sf):
    k = F.from_json("props", "k INT")["k"]
    texts = v.table(spark, sf, "events").select(F.to_json(F.struct(
        F.col("user_id").cast("string").alias("symbol"), (F.col("value") / 500).alias("companyNewsScore"),
        F.lit(0.6).alias("sectorAverageBullishPercent"), F.lit(0.4).alias("sectorAverageBearishPercent"),
        F.struct(k.alias("articlesInLastWeek"), (F.col("value") / 7).alias("weeklyAverage")).alias("buzz"),
        F.struct((k / 100).alias("bullishPercent")).alias("sentiment"))).alias("value"))
    return messages.sentiment_rows(messages.decode_sentiment(texts), F.lit("2024-01-01 00:00:00").cast("timestamp"))


@query("""
SELECT id, turn, headline, summary FROM (
  SELECT conv_id AS id, turn, role AS headline, text AS summary,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn = 1""")
def news_dedup(spark, sf):
    articles = v.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("id"), "turn", F.col("role").alias("headline"), F.col("text").alias("summary"))
    return messages.first_arrivals(articles, ["turn"])


@query(f"""
SELECT symbol AS key, '{{"symbol":"' || symbol || '","price":' || price || ',"volume":' || volume || ',"ts":"' ||
       strftime(date_trunc('milliseconds', ts), '{MILLIS}') || 'Z"}}' AS value
FROM ({v.trades_sql()})""", settle=False)
def encode_messages(spark, sf):
    rows = v.trades(spark, sf).withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return messages.encode(rows, "symbol", ["symbol", "price", "volume", "ts"])


@query("""
SELECT l_orderkey, l_linenumber, CAST(TRY_CAST(l_extendedprice / 7 AS DECIMAL(10,6)) AS DOUBLE) AS anomaly_score,
       CAST(TRY_CAST(l_extendedprice / 7 AS DECIMAL(12,4)) AS DOUBLE) AS price_at_anomaly,
       CASE WHEN TRY_CAST(l_extendedprice / 7 AS DECIMAL(10,6)) IS NULL THEN 'overflow anomaly_score' END AS reject_reason
FROM lineitem""", settle=False)
def decimal_store(spark, sf):
    rows = v.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 7).alias("anomaly_score"),
        (F.col("l_extendedprice") / 7).alias("price_at_anomaly"))
    checked = quality.storage_check(rows, schemas.ANOMALY_LOGS)
    return checked.select("l_orderkey", "l_linenumber",
                          F.col("anomaly_score").try_cast("decimal(10,6)").cast("double").alias("anomaly_score"),
                          F.col("price_at_anomaly").try_cast("decimal(12,4)").cast("double").alias("price_at_anomaly"),
                          "reject_reason")


@query("""
SELECT o_orderkey AS id, CASE
         WHEN o_orderpriority = '5-LOW' THEN 'null symbol'
         WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'bad severity'
         ELSE 'no parent' END AS reject_reason
FROM orders WHERE o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED')
   OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def constraint_rejects(spark, sf):
    level = (F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "unknown").otherwise("low"))
    logged = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent_id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("symbol"),
        level.alias("severity"), F.col("o_orderdate").cast("timestamp").alias("detected_at"))
    parents = v.table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    accepted, rejected = quality.split(logged, schemas.ANOMALY_LOGS)
    lost = quality.orphans(accepted, "parent_id", parents).withColumn("reject_reason", F.lit("no parent"))
    return rejected.unionByName(lost).select("id", "reject_reason")


@query(f"""
SELECT id, symbol, CAST(CAST(price AS DECIMAL(12,4)) AS DOUBLE) AS price, CAST(CAST(volume AS DECIMAL(20,4)) AS DOUBLE) AS volume,
       ts AS trade_timestamp FROM ({v.trades_sql()})""", settle=False)
def table_roundtrip(spark, sf):
    root = scratch_path(spark, "tables")
    rows = v.trades(spark, sf).withColumn("trade_timestamp", F.col("ts"))
    tables.append(rows, root, schemas.RAW_TRADES, F.current_timestamp())
    stored = tables.read_table(spark, root, schemas.RAW_TRADES)
    return stored.select("id", "symbol", F.col("price").cast("double").alias("price"),
                         F.col("volume").cast("double").alias("volume"), "trade_timestamp")


def _database(spark, root):
    """A database of its own for each run of a query, with all tables created, twice without harm."""
    database = root.rsplit("/", 1)[-1].replace("-", "_")
    spark.sql(f"CREATE DATABASE {database}")
    for _ in range(2):
        tables.create_tables(spark, root, database)
    return database


@query(f"""
SELECT id, symbol, CAST(CAST(price AS DECIMAL(12,4)) AS DOUBLE) AS price, ts AS trade_timestamp, 'append' AS query, 0 AS batch_id
FROM ({v.trades_sql()}) WHERE id % 3 = 0
UNION ALL
SELECT id, symbol, CAST(CAST(price AS DECIMAL(12,4)) AS DOUBLE), ts, 'direct', id % 3 + 4
FROM ({v.trades_sql()}) WHERE id % 3 > 0 AND ts >= (SELECT min(ts) FROM events) + INTERVAL 10 DAY
UNION ALL
SELECT id, symbol, 1, ts, 'late', 5 FROM ({v.trades_sql()}) WHERE symbol = 'view'""", settle=False)
def catalog_table_roundtrip(spark, sf):
    """Tables by name: an append, two batches of which an earlier attempt held other days, and a batch written by path."""
    root = scratch_path(spark, "named")
    database = _database(spark, root)
    rows = v.trades(spark, sf).withColumn("trade_timestamp", F.col("ts"))
    third, now = F.pmod("id", F.lit(3)), F.current_timestamp()
    tables.insert(rows.filter(third == 0), schemas.RAW_TRADES, now, database)
    start = v.table(spark, sf, "events").agg(F.min(F.col("ts").cast("timestamp"))).scalar()
    for batch in (5, 6):
        own = rows.filter(third == batch - 4)
        tables.insert(own, schemas.RAW_TRADES, now, database, batch)
        tables.insert(own.filter(F.col("ts") >= start + F.expr("INTERVAL 10 DAYS")), schemas.RAW_TRADES, now, database, batch)
    by_path = rows.filter("symbol = 'view'").withColumn("price", F.lit(1.0))
    tables.append(by_path, root, schemas.RAW_TRADES, now, 5, "late")
    tables.recover(spark, schemas.RAW_TRADES, database)
    stored = tables.read_named(spark, schemas.RAW_TRADES, database)
    return stored.select("id", "symbol", F.col("price").cast("double").alias("price"), "trade_timestamp", "query", "batch_id")


def _appended(spark, table, rows):
    """The rows written by name in two halves, and read by path."""
    root = scratch_path(spark, table.name)
    database = _database(spark, root)
    for half in (0, 1):
        tables.insert(rows.filter(F.pmod("id", F.lit(2)) == half), table, F.lit("2024-01-01 00:00:00").cast("timestamp"), database)
    return tables.read_table(spark, root, table)


def _numbers(*names):
    return [F.col(n).cast("double").alias(n) for n in names]


@query(f"""
SELECT id, symbol, CAST(CAST(current_price AS DECIMAL(12,4)) AS DOUBLE) AS current_price, CAST(CAST(change AS DECIMAL(12,4)) AS DOUBLE) AS change,
       CAST(CAST(percent_change AS DECIMAL(8,4)) AS DOUBLE) AS percent_change, CAST(CAST(prev_close AS DECIMAL(12,4)) AS DOUBLE) AS prev_close,
       date_trunc('quarter', quoted_at)::TIMESTAMP AS quoted_at, date_trunc('quarter', quoted_at)::DATE AS quoted_at_day,
       TIMESTAMP '2024-01-01' AS created_at FROM ({v.QUOTES_SQL})""", settle=False)
def stored_quotes(spark, sf):
    rows = v.quotes(spark, sf).withColumn("quoted_at", F.date_trunc("quarter", "quoted_at").cast("timestamp")).drop("created_at")
    stored = _appended(spark, schemas.STOCK_QUOTES, rows)
    return stored.select("id", "symbol", *_numbers("current_price", "change", "percent_change", "prev_close"), "quoted_at", "quoted_at_day", "created_at")


@query(f"""
SELECT id, symbol, CAST(CAST(sentiment_score AS DECIMAL(8,6)) AS DOUBLE) AS sentiment_score, scored_at,
       CAST(scored_at AS DATE) AS scored_at_day FROM ({v.SENTIMENT_SQL})""", settle=False)
def stored_sentiment(spark, sf):
    rows = v.sentiment(spark, sf).withColumn("scored_at", F.col("scored_at").cast("timestamp"))
    return _appended(spark, schemas.SENTIMENT_SCORES, rows).select("id", "symbol", *_numbers("sentiment_score"), "scored_at", "scored_at_day")


def _stamped(spark, sf, **fields):
    return v.table(spark, sf, "events").select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("value"))


@query("""
SELECT event_id AS id, event_type AS headline, to_timestamp(1700000000 + event_id)::TIMESTAMP AS published_at FROM events""", settle=False)
def decode_news(spark, sf):
    texts = _stamped(spark, sf, id=F.col("event_id"), headline=F.col("event_type"), datetime=F.lit(1_700_000_000) + F.col("event_id"))
    return messages.decode_news(texts).select("id", "headline", "published_at")


@query("""
SELECT CAST(user_id AS VARCHAR) AS symbol, value AS price, date_trunc('milliseconds', ts) AS detected_at FROM events""", settle=False)
def decode_anomalies(spark, sf):
    moment = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSxxx")
    texts = _stamped(spark, sf, symbol=F.col("user_id").cast("string"), price=F.col("value"), detected_at=moment)
    return messages.decode_anomalies(texts).select("symbol", "price", "detected_at")


@query("""
SELECT l_orderkey AS id, l_linenumber AS line, 'overflow price' AS reject_reason FROM lineitem WHERE l_extendedprice * 2000 > 99999999.99995
UNION ALL SELECT l_orderkey, l_linenumber, NULL FROM lineitem WHERE l_extendedprice * 2000 <= 99999999.99995""", settle=False)
def landing_rejects(spark, sf):
    """Trades landed by a batch, with those that do not fit kept apart."""
    root = scratch_path(spark, "landing")
    rows = v.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("symbol"), (F.col("l_extendedprice") * 2000).alias("price"),
        F.col("l_linenumber").cast("double").alias("volume"), F.date_trunc("year", "l_shipdate").alias("trade_timestamp"))
    jobs.landing(root, schemas.RAW_TRADES)(rows, 0)
    line = F.col("volume").cast("bigint").alias("line")
    stored = tables.read_batches(spark, root, schemas.RAW_TRADES).select("id", line, F.lit(None).cast("string").alias("reject_reason"))
    return stored.unionByName(spark.read.parquet(jobs.rejects(root, schemas.RAW_TRADES)).select("id", line, "reject_reason"))
