"""Queries on windows, detectors and the forest."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from catalog.registry import query
from tidegauge.functions.scalars import iso_utc, settled
from tidegauge.operators import detectors, iforest, latest, windows
from tidegauge.operators.sharding import grouped_quantiles
from tidegauge.runtime import scratch_path

WINDOW_VALUES = ", ".join(f"('{label}', INTERVAL '{length}' SECOND)" for label, length in v.HOURS)
DAY_VALUES = ", ".join(f"('{label}', INTERVAL '{length}' SECOND)" for label, length in v.DAYS)
EPOCH = "TIMESTAMP '1970-01-01'"

_METRIC_SQL = f"""{v.half_up("avg(price)", 6)} AS avg_price, {v.half_up("coalesce(stddev_samp(price), 0)", 6)} AS std_dev,
       {v.half_up("sum(volume)", 6)} AS total_volume, count(*) AS trade_count,
       {v.half_up("CASE WHEN sum(volume) < 1e-9 THEN avg(price) ELSE sum(price * volume) / sum(volume) END", 6)} AS vwap,
       min(price) AS min_price, max(price) AS max_price"""

TRAILING_SQL = f"""
WITH t AS ({v.trades_sql("user_id")}), e AS (SELECT max(ts) AS w_end FROM t),
     w(window_size, d) AS (VALUES {DAY_VALUES})
SELECT symbol, window_size, w_end - d AS window_start, w_end AS window_end, {_METRIC_SQL}
FROM t, e, w WHERE ts >= w_end - d GROUP BY symbol, window_size, w_end, d"""

_BAR_SQL = f"""arg_min(price, (ts, id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, id)) AS close,
       {v.half_up("sum(volume)", 6)} AS volume, count(*) AS trade_count,
       {v.half_up("CASE WHEN sum(volume) < 1e-9 THEN avg(price) ELSE sum(price * volume) / sum(volume) END", 6)} AS vwap"""


@query(TRAILING_SQL)
def trailing_window_metrics(spark, sf):
    return windows.trailing_metrics(v.trades(spark, sf, "user_id"), v.DAYS)


@query(f"""
WITH t AS ({v.trades_sql()}), w(window_size, d) AS (VALUES {WINDOW_VALUES})
SELECT window_size, symbol, time_bucket(d, ts, {EPOCH}) AS window_start, time_bucket(d, ts, {EPOCH}) + d AS window_end,
       {_BAR_SQL}
FROM t, w GROUP BY window_size, symbol, d, time_bucket(d, ts, {EPOCH})""")
def tumbling_ohlcv(spark, sf):
    return windows.ohlcv_levels(v.trades(spark, sf), v.HOURS)


@query(f"""
WITH t AS ({v.trades_sql()}), s AS (
  SELECT *, time_bucket(INTERVAL 1 HOUR, ts, {EPOCH}) - i * INTERVAL 1 HOUR AS window_start
  FROM t, range(5) r(i))
SELECT symbol, window_start, window_start + INTERVAL 5 HOUR AS window_end, {_BAR_SQL}
FROM s GROUP BY symbol, window_start""")
def sliding_ohlcv(spark, sf):
    return windows.ohlcv(v.trades(spark, sf), 5 * 3600, 3600)


def _frame_sql(label: str, length: int) -> str:
    return f"""
SELECT DISTINCT symbol, ts, '{label}' AS window_size, {v.half_up("avg(price) OVER w", 6)} AS avg_price,
       {v.half_up("coalesce(stddev_samp(price) OVER w, 0)", 6)} AS std_dev, {v.half_up("sum(volume) OVER w", 6)} AS total_volume,
       count(*) OVER w AS trade_count,
       {v.half_up("CASE WHEN sum(volume) OVER w < 1e-9 THEN avg(price) OVER w ELSE sum(price * volume) OVER w / sum(volume) OVER w END", 6)} AS vwap,
       min(price) OVER w AS min_price, max(price) OVER w AS max_price
FROM ({v.trades_sql()})
WINDOW w AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL '{length}' SECOND PRECEDING AND CURRENT ROW)"""


@query(" UNION ALL ".join(_frame_sql(*w) for w in v.HOURS))
def range_frame_stats(spark, sf):
    return windows.range_frame_metrics(v.trades(spark, sf), v.HOURS)


def _last(spark, sf, *methods):
    return detectors.last_verdicts(v.trades(spark, sf, "user_id", "value"), methods or detectors.STATISTICAL)


_LAST_SQL = f"SELECT symbol, {v.VERDICT_SQL} FROM ({v.verdicts_sql(v.LAST_STATS_SQL, 'symbol')})"


@query(f"{_LAST_SQL} WHERE detection_method = 'zscore'")
def zscore_last(spark, sf):
    return _last(spark, sf, "zscore")


@query(f"{_LAST_SQL} WHERE detection_method = 'iqr'")
def iqr_last(spark, sf):
    return _last(spark, sf, "iqr")


@query(f"{_LAST_SQL} WHERE detection_method = 'volume_spike'")
def volume_spike_last(spark, sf):
    return _last(spark, sf, "volume_spike")


@query(_LAST_SQL)
def all_detectors_last(spark, sf):
    return _last(spark, sf)


def _rolling(spark, sf, method):
    found = detectors.rolling_verdicts(v.trades(spark, sf, volume="value"), v.LOOKBACK, (method,))
    return detectors.flagged(found).select("id", "symbol", "ts", "detection_method", "is_anomaly", "anomaly_type",
                                           "severity", "anomaly_score", "value", "context")


_ROLLING_SQL = (f"SELECT id, symbol, ts, {v.VERDICT_SQL} FROM "
                f"({v.verdicts_sql(v.rolling_sql(), 'id, symbol, ts')}) WHERE is_anomaly")


@query(f"{_ROLLING_SQL} AND detection_method = 'zscore'")
def rolling_zscore(spark, sf):
    return _rolling(spark, sf, "zscore")


@query(f"{_ROLLING_SQL} AND detection_method = 'iqr'")
def rolling_iqr(spark, sf):
    return _rolling(spark, sf, "iqr")


@query(f"{_ROLLING_SQL} AND detection_method = 'volume_spike'")
def rolling_volume(spark, sf):
    return _rolling(spark, sf, "volume_spike")


@query(f"""
SELECT symbol, count(*) FILTER (WHERE is_anomaly) AS methods_flagged,
       coalesce(string_agg(detection_method, ',' ORDER BY detection_method) FILTER (WHERE is_anomaly), '') AS methods
FROM ({v.verdicts_sql(v.LAST_STATS_SQL, 'symbol')}) GROUP BY symbol""")
def detector_agreement(spark, sf):
    return detectors.agreement(_last(spark, sf))


@query(f"""
WITH m AS (SELECT symbol, {v.half_up('avg(price)', 4)} AS price, {v.half_up('avg(volume)', 4)} AS volume
           FROM ({v.trades_sql("user_id", "value")}) GROUP BY symbol)
SELECT symbol, anomaly_type, severity, detection_method, anomaly_score, m.price, m.volume,
       (SELECT strftime(date_trunc('milliseconds', max(ts)), '%Y-%m-%dT%H:%M:%S.%g') || '+00:00' FROM events) AS detected_at, context
FROM ({_LAST_SQL}) JOIN m USING (symbol) WHERE is_anomaly""")
def anomaly_events(spark, sf):
    rows = v.trades(spark, sf, "user_id", "value")
    return detectors.anomaly_events(_last(spark, sf), rows, iso_utc(v.newest_event(spark, sf)))


@query(f"SELECT symbol, {v.half_up("avg(price)", 6)} AS price, {v.half_up("avg(volume)", 6)} AS volume FROM ({v.trades_sql()}) GROUP BY symbol")
def batch_means(spark, sf):
    return detectors.batch_means(v.trades(spark, sf))


@query(f"""
SELECT symbol, {v.half_up("quantile_cont(price, 0.25)", 6)} AS q1, {v.half_up("quantile_cont(price, 0.5)", 6)} AS q2,
       {v.half_up("quantile_cont(price, 0.75)", 6)} AS q3 FROM ({v.trades_sql()}) GROUP BY symbol""")
def exact_quartiles(spark, sf):
    return grouped_quantiles(v.trades(spark, sf), ["symbol"], "price", (0.25, 0.5, 0.75), ("q1", "q2", "q3"))


@query(f"""
SELECT nullif(symbol, 'view') AS symbol, {v.half_up("quantile_cont(price, 0.25)", 6)} AS q1, {v.half_up("quantile_cont(price, 0.5)", 6)} AS q2,
       {v.half_up("quantile_cont(price, 0.75)", 6)} AS q3 FROM ({v.trades_sql()}) GROUP BY ALL""")
def quartiles_by_brackets(spark, sf):
    """As above, with keys larger than what one task may hold, a null key among them."""
    rows = v.trades(spark, sf).withColumn("symbol", F.nullif("symbol", F.lit("view")))
    return grouped_quantiles(rows, ["symbol"], "price", (0.25, 0.5, 0.75), ("q1", "q2", "q3"), group_limit=30)


_TOP_SQL = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY window_start DESC) AS rn
               FROM ({v.METRICS_SQL})) WHERE rn <= 500"""


@query(f"""
SELECT symbol, window_size, window_start, window_end, {v.half_up("avg_price", 6)} AS avg_price, {v.half_up("std_dev", 6)} AS std_dev,
       {v.half_up("total_volume", 6)} AS total_volume, trade_count, {v.half_up("vwap", 6)} AS vwap, min_price, max_price
FROM ({_TOP_SQL})""")
def latest_per_symbol_topn(spark, sf):
    rows = v.metrics(spark, sf)
    return latest.newest_n(rows, "symbol", [F.col("window_start").desc()], 500)


@query(" UNION ALL ".join(
    f"SELECT '{f}' AS feature, {v.half_up(f"avg({f})", 6)} AS mean, "
    f"{v.half_up(f"coalesce(nullif(stddev_pop({f}), 0), 1)", 6)} AS scale FROM ({_TOP_SQL})"
    for f in ("avg_price", "total_volume", "std_dev", "vwap", "trade_count")))
def feature_scaling(spark, sf):
    return iforest.scaling(iforest.training_rows(v.metrics(spark, sf)))


# Metrics as the table stores them, with its decimals.
_DIGITS = {"avg_price": 4, "std_dev": 6, "total_volume": 4, "vwap": 4}
_STORED_SQL = f"""
SELECT symbol, window_size, window_start, {", ".join(f"{v.half_up(c, d)} AS {c}" for c, d in _DIGITS.items())},
       CAST(trade_count AS DOUBLE) AS trade_count FROM ({v.METRICS_SQL})"""
_HASH = "('0x' || substr(md5({}), 1, {}))::BIGINT"


def _uniform_sql(what: str) -> str:
    return f"{_HASH.format(f"'{iforest.SEED}|{what}|' || tree || '|' || node", 13)} / {float(1 << 52)}"


def _level_sql(depth: int) -> str:
    """Splits of one level of all trees, and the rows of the next."""
    low, high = (", ".join(f"{how}(x[{i + 1}])" for i in range(5)) for how in ("min", "max"))
    return f"""
s{depth} AS (
  SELECT tree, node, count(*) AS size, [{low}] AS low, [{high}] AS high FROM l{depth} GROUP BY tree, node),
u{depth} AS (SELECT *, list_filter([1, 2, 3, 4, 5], lambda i: high[i] > low[i]) AS usable FROM s{depth}),
f{depth} AS (
  SELECT *, CASE WHEN len(usable) > 0 AND {depth} < (SELECT depth FROM p)
                 THEN usable[CAST(floor(({_uniform_sql("feature")}) * len(usable)) AS INTEGER) + 1] END AS feature FROM u{depth}),
n{depth} AS (
  SELECT tree, node, feature, low[feature] + ({_uniform_sql("split")}) * (high[feature] - low[feature]) AS split, size, {depth} AS depth
  FROM f{depth}),
l{depth + 1} AS (
  SELECT tree, node * 2 + CASE WHEN x[feature] > split THEN 2 ELSE 1 END AS node, x
  FROM l{depth} JOIN n{depth} USING (tree, node) WHERE feature IS NOT NULL)"""


def _top_sql(rows: str) -> str:
    return f"SELECT * FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY window_start DESC) <= 500"


FOREST_SQL = f"""
m AS MATERIALIZED ({_STORED_SQL}),
top AS (SELECT * FROM ({_top_sql("FROM m")})),
p AS (SELECT least(256, count(*)) AS sample, ceil(log2(greatest(least(256, count(*)), 2))) AS depth FROM top),
sc AS (SELECT [{", ".join(f"avg({f})" for f in iforest.FEATURES)}] AS mean,
              [{", ".join(f"coalesce(nullif(stddev_pop({f}), 0), 1)" for f in iforest.FEATURES)}] AS scale FROM top),
z AS MATERIALIZED (
  SELECT *, [{", ".join(f"({f} - mean[{i + 1}]) / scale[{i + 1}]" for i, f in enumerate(iforest.FEATURES))}] AS x FROM m, sc),
h AS (SELECT symbol, window_start, x, {_HASH.format("symbol || '|' || epoch_us(window_start)", 8)} % {iforest.DRAW} AS hash
      FROM z SEMI JOIN top USING (symbol, window_start)),
t(tree, a, b) AS (VALUES {", ".join(f"({t}, {a}::BIGINT, {b}::BIGINT)" for t, (a, b) in ((t, iforest.draw_line(t)) for t in range(iforest.TREES)))}),
l0 AS MATERIALIZED (
  SELECT tree, 0 AS node, x FROM h, t
  QUALIFY row_number() OVER (PARTITION BY tree ORDER BY (hash * a + b) % {iforest.DRAW}, symbol, window_start) <= (SELECT sample FROM p)),
{",".join(_level_sql(d) for d in range(9))},
nodes AS MATERIALIZED ({" UNION ALL ".join(f"FROM n{d}" for d in range(9))})"""

_CORRECTION = f"CASE WHEN {{0}} > 2 THEN 2 * (ln({{0}} - 1) + {0.5772156649015329}) - 2 * ({{0}} - 1) / {{0}} WHEN {{0}} = 2 THEN 1 ELSE 0 END"


def _step_sql(name: str, step: int) -> str:
    return f"""
{name}{step + 1} AS (
  SELECT symbol, window_start, x, o.tree,
         CASE WHEN feature IS NULL THEN o.node ELSE o.node * 2 + CASE WHEN x[feature] > split THEN 2 ELSE 1 END END AS node
  FROM {name}{step} o JOIN nodes USING (tree, node))"""


def scores_sql(rows: str = "z") -> str:
    """Scores of `rows` (symbol, window_start, x), and the border of the training rows' scores."""
    def walk(name: str, source: str) -> str:
        start = f"{name}0 AS (SELECT symbol, window_start, x, tree, 0 AS node FROM {source}, range({iforest.TREES}) r(tree)),"
        return f"""
{start}
{",".join(_step_sql(name, i) for i in range(8))},
scored_{name} AS MATERIALIZED (
  SELECT symbol, window_start,
         {v.half_up(f"pow(2, -avg(depth + {_CORRECTION.format('size::DOUBLE')}) / (SELECT {_CORRECTION.format('sample::DOUBLE')} FROM p))", 9)} AS iso_score
  FROM {name}8 JOIN nodes USING (tree, node) GROUP BY symbol, window_start)"""

    return f"""{FOREST_SQL},{walk("w", "z")},
border AS (SELECT quantile_cont(iso_score, 0.95) AS border FROM scored_w SEMI JOIN top USING (symbol, window_start))
""" + ("" if rows == "z" else f",{walk('q', rows)}")


_FLAGS_SQL = f"""
WITH {scores_sql()}
SELECT symbol, window_start, iso_score, 'isolation_forest' AS detection_method, 'ml_anomaly' AS anomaly_type,
       CASE WHEN least(1, 0.5 + iso_score) >= 0.85 THEN 'critical' WHEN least(1, 0.5 + iso_score) >= 0.70 THEN 'high'
            WHEN least(1, 0.5 + iso_score) >= 0.55 THEN 'medium' ELSE 'low' END AS severity,
       {v.half_up("least(1, 0.5 + iso_score)", 6)} AS anomaly_score, avg_price AS value, {v.half_up("-iso_score", 6)} AS raw_isolation_score,
       std_dev, trade_count
FROM scored_w JOIN m USING (symbol, window_start) WHERE iso_score > (SELECT border FROM border)"""


def stored_metrics(spark, sf):
    rows = v.metrics(spark, sf)
    return rows.withColumns({c: settled(F.col(c), d) for c, d in _DIGITS.items()})


def forest(spark, sf):
    return iforest.fit(iforest.training_rows(stored_metrics(spark, sf)), ["symbol", "window_start"])


@query(f"""
WITH {FOREST_SQL}
SELECT tree, node, coalesce(feature - 1, -1) AS feature, {v.half_up("coalesce(split, 0)", 6)} AS split, size, depth FROM nodes""")
def iforest_train(spark, sf):
    return forest(spark, sf).nodes


@query(f"""
SELECT t AS tree, least(256, n) AS root_rows, least(256, n) AS leaf_rows, true AS shallow, true AS binary
FROM range(100) r(t), (SELECT count(*) AS n FROM ({_TOP_SQL}))""")
def iforest_shape(spark, sf):
    """What holds for every tree, however its splits were drawn."""
    leaf = F.col("feature") < 0
    return forest(spark, sf).nodes.groupBy(F.col("tree").cast("bigint").alias("tree")).agg(
        F.max(F.when(F.col("node") == 0, F.col("size"))).cast("bigint").alias("root_rows"),
        F.sum(F.when(leaf, F.col("size"))).cast("bigint").alias("leaf_rows"),
        (F.max("depth") <= 8).alias("shallow"), (F.count_if(leaf) == F.count_if(~leaf) + 1).alias("binary"))


def flag_rows(found):
    """Flagged verdicts with what their context says."""
    told = F.from_json("context", "raw_isolation_score DOUBLE, features STRUCT<std_dev: DOUBLE, trade_count: DOUBLE>")
    return detectors.flagged(found).withColumn("_told", told).select(
        "symbol", "window_start", settled(F.col("iso_score"), 9).alias("iso_score"), "detection_method", "anomaly_type", "severity", "anomaly_score", "value",
        "_told.raw_isolation_score", "_told.features.std_dev", "_told.features.trade_count")


@query(f"SELECT * REPLACE ({v.half_up('iso_score', 6)} AS iso_score) FROM ({_FLAGS_SQL})")
def iforest_flags(spark, sf):
    return flag_rows(iforest.isolation_verdicts(stored_metrics(spark, sf), forest(spark, sf)))


@query(f"SELECT * REPLACE ({v.half_up('iso_score', 6)} AS iso_score) FROM ({_FLAGS_SQL})")
def iforest_saved(spark, sf):
    """The forest is saved, read again, and scores what it has not been fitted in this session for."""
    path = scratch_path(spark, "forest")
    forest(spark, sf).save(path)
    return flag_rows(iforest.isolation_verdicts(stored_metrics(spark, sf), iforest.load(spark, path)))
