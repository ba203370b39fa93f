"""Column functions shared by the operators: clean-up, scaling, bands and labels."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.schemas import SEVERITIES

DASH = "—"


def finite(value: Column) -> Column:
    """NaN and infinities become null, so that averages skip them. NaN is above every number in Spark's order."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def or_default(value: Column, default: Column) -> Column:
    """`default` when the value is missing or zero."""
    return F.coalesce(F.nullif(value, F.lit(0.0)), default)


def clamp_unit(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def settled(value: Column, digits: int) -> Column:
    """Half-up rounding that ignores floating-point noise far below the last digit kept."""
    return F.round(F.round(value, digits + 5), digits)


def sorted_quantile(values: Column, p: float) -> Column:
    """Quantile of an ascending array with linear interpolation; null for an empty one."""
    exact = (F.size(values) - 1) * F.lit(float(p))
    low = F.get(values, F.floor(exact).cast("int"))
    high = F.get(values, F.ceil(exact).cast("int"))
    return low + (high - low) * (exact - F.floor(exact))


def moment_key(ts: Column, row_id: Column) -> Column:
    """One number that orders like (ts, id).

    A decimal has a fixed width in aggregation buffers, a struct has not: `min_by` over
    this key stays a hash aggregate where a struct key would sort the input. The factor
    exceeds the span of a 64-bit id.
    """
    factor = F.lit("20000000000000000000").cast("decimal(20,0)")
    return F.unix_micros(ts).cast("decimal(18,0)") * factor + row_id.cast("bigint")


def seconds(length: int) -> Column:
    return F.expr(f"INTERVAL '{int(length)}' SECOND")


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text of a timestamp with milliseconds and offset (session time zone UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSxxx")


def at_or_after(rows: DataFrame, time: str, start: Column) -> Column:
    """Rows from `start` on; a stored table's day column joins in, so that older partitions are not read."""
    recent, day = F.col(time) >= start, f"{time}_day"
    return recent & (F.col(day) >= F.to_date(start)) if day in rows.columns else recent


def parse_time(text: Column) -> Column:
    """Timestamp from ISO text; null when it does not parse."""
    return F.try_to_timestamp(text)


def all_of(conditions: list[Column]) -> Column:
    """Conjunction of the present conditions; true when there are none."""
    return reduce(and_, conditions, F.lit(True))


def equals_unless_all(column: str, wanted: str | None) -> list[Column]:
    """No condition for None or "All", otherwise one equality."""
    return [] if wanted in (None, "All") else [F.col(column) == wanted]


def severity_rank(severity: Column) -> Column:
    """1 for low up to 4 for critical, 0 for anything else."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def title_words(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def fixed(pattern: str, value: Column) -> Column:
    """printf-style text, a dash for null."""
    return F.coalesce(F.when(value.isNotNull(), F.printf(F.lit(pattern), value)), F.lit(DASH))


def percent(value: Column) -> Column:
    """Whole percent text of a fraction."""
    return F.concat(F.round(value * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def confidence_band(score: Column) -> Column:
    band = F.when(score >= 0.7, "High").when(score >= 0.4, "Medium").otherwise("Low")
    return F.when(score.isNull(), DASH).otherwise(F.concat(percent(score), F.lit(" ("), band, F.lit(")")))


def sentiment_band(percent_value: Column) -> Column:
    return F.when(percent_value >= 60, "Bullish").when(percent_value >= 40, "Neutral").otherwise("Bearish")


def bubble_size(score: Column) -> Column:
    return F.least(score, F.lit(20.0)) + 6


def chart_height(symbols: Column) -> Column:
    return F.greatest(F.lit(300).cast("bigint"), symbols * 60 + 100)


def step_label(name: Column, duration_ms: Column) -> Column:
    suffix = F.when(duration_ms != 0, F.concat(F.lit(" ("), duration_ms.cast("string"), F.lit(" ms)")))
    return F.concat(F.lit("Step: "), F.coalesce(name, F.lit("step")), F.coalesce(suffix, F.lit("")))
