"""Detector rules as column expressions.

Each rule takes the current value and the statistics of its history and returns a
verdict struct. Guards come before every division, so the expressions are safe in ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions.scalars import finite, settled

MIN_SPREAD = 1e-9


def verdict(method: str, value: Column, flagged: Column, kind: str, severity: Column,
            score: Column, context: Column) -> Column:
    """One verdict; an unflagged one has type none, severity low and score 0."""
    hit = F.coalesce(flagged, F.lit(False))
    return F.struct(
        F.lit(method).alias("detection_method"),
        F.when(hit, kind).otherwise("none").alias("anomaly_type"),
        hit.alias("is_anomaly"),
        F.when(hit, severity).otherwise("low").alias("severity"),
        F.when(hit, score).otherwise(0.0).alias("anomaly_score"),
        value.alias("value"),
        F.when(hit, context).alias("context"),
    )


def _context(**fields: Column) -> Column:
    return F.to_json(F.struct(*[settled(column, 4).alias(name) for name, column in fields.items()]))


def zscore(value: Column, n: Column, mean: Column, std: Column,
           threshold: float = 3.0, kind: str = "price_spike") -> Column:
    z = finite(F.when((n >= 5) & (std >= MIN_SPREAD) & finite(std).isNotNull(), (value - mean) / std))
    size = F.abs(z)
    severity = (F.when(size >= 5, "critical").when(size >= 4, "high").when(size >= 3, "medium").otherwise("low"))
    context = _context(z_score=z, mean=mean, std=std, threshold=F.lit(float(threshold)))
    return verdict("zscore", value, size >= threshold, kind, severity, size, context)


def iqr(value: Column, n: Column, q1: Column, q3: Column,
        k: float = 1.5, kind: str = "price_outlier") -> Column:
    spread = q3 - q1
    usable = (n >= 5) & (spread >= MIN_SPREAD) & finite(spread).isNotNull() & finite(value).isNotNull()
    lower, upper = q1 - spread * k, q3 + spread * k
    score = F.when(usable, F.greatest(value - upper, lower - value) / spread)
    severity = F.when(score >= 9, "critical").when(score >= 6, "high").when(score >= 3, "medium").otherwise("low")
    context = _context(q1=q1, q3=q3, iqr=spread, lower_fence=lower, upper_fence=upper, k=F.lit(float(k)))
    return verdict("iqr", value, usable & ((value > upper) | (value < lower)), kind, severity, score, context)


def volume_spike(value: Column, n: Column, mean: Column, threshold: float = 5.0) -> Column:
    ratio = finite(F.when((n >= 3) & (mean >= MIN_SPREAD) & finite(mean).isNotNull(), value / mean))
    severity = (F.when(ratio >= threshold * 4, "critical").when(ratio >= threshold * 2, "high")
                .when(ratio >= threshold * 1.5, "medium").otherwise("low"))
    context = _context(current_volume=value, avg_volume=mean, ratio=ratio, threshold=F.lit(float(threshold)))
    return verdict("volume_spike", value, ratio >= threshold, "volume_spike", severity, ratio, context)


def isolation(value: Column, flagged: Column, raw: Column, context: Column) -> Column:
    """`raw` is the negated isolation score, in [-1, 0]."""
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) - raw))
    severity = F.when(score >= 0.85, "critical").when(score >= 0.70, "high").when(score >= 0.55, "medium").otherwise("low")
    return verdict("isolation_forest", value, flagged, "ml_anomaly", severity, score, context)
