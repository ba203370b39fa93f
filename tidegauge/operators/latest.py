"""Newest rows and series ends per key, without sorting whole keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators.sharding import attach
from tidegauge.runtime import cut


TASK_GROUPS = 256


def latest_per_key(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The row with the greatest `order` of each key; `order` starts with the time column.

    First the newest time of each key, from two columns and in a hash aggregate. Only rows
    at those times are then compared whole, and rows older than all of them are not read.
    """
    time = order[0]
    tops = cut(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(time).alias("_top")))
    recent = rows.filter(F.col(time) >= tops.agg(F.min("_top")).scalar())
    newest = attach(recent, tops, [key], fixed=True).filter(F.col(time) == F.col("_top"))
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return (newest.groupBy(F.col(key).alias("_key"))
            .agg(F.max_by(whole, F.struct(*order)).alias("r")).select("r.*"))


def newest_n(rows: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """The newest `n` rows of each key.

    Every task first keeps `n` rows per key of what it reads. Those are ranked within groups
    of tasks, and only the winners of the groups meet in the last ranking of a key.
    """
    grouped = rows.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(TASK_GROUPS)))
    first = Window.partitionBy(key, "_group").orderBy(*order)
    final = Window.partitionBy(key).orderBy(*order)
    kept = grouped.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= n)
    return (kept.withColumn("_rank", F.row_number().over(final)).filter(F.col("_rank") <= n)
            .drop("_rank", "_group"))


def series_ends(rows: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """First and last value and length of each key's series, found in two steps like `latest_per_key`."""
    time = order[0]
    span = cut(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(time).alias("_from"), F.max(time).alias("_to"), F.count(F.lit(1)).alias("points")))
    ends = attach(rows.select(key, value, *order), span, [key], fixed=True).filter(
        (F.col(time) == F.col("_from")) | (F.col(time) == F.col("_to")))
    moment = F.struct(*order)
    return ends.groupBy(key).agg(
        F.min_by(value, moment).alias("first_value"),
        F.max_by(value, moment).alias("last_value"),
        F.max("points").alias("points"),
    )


def percent_change(rows: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """Change from first to last value in percent: 0 for a zero start, null for a single point."""
    first, last = F.col("first_value"), F.col("last_value")
    change = F.when(F.col("points") > 1, F.coalesce(F.try_divide(last - first, first) * 100, F.lit(0.0)))
    return (series_ends(rows, key, value, order)
            .withColumn("pct_change", change).withColumn("is_up", F.col("pct_change") >= 0))


def rebased(rows: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """Add `normalised`: the series scaled to 100 at its first value, unscaled when that is not positive."""
    bases = cut(series_ends(rows, key, value, order).select(key, F.col("first_value").alias("_base")))
    scaled = F.when(F.col("_base") > 0, F.col(value) / F.nullif(F.col("_base"), F.lit(0.0)) * 100)
    return (attach(rows, bases, [key], "left", fixed=True)
            .withColumn("normalised", F.coalesce(scaled, F.col(value))).drop("_base"))
