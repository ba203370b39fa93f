"""Registry of queries, each with an equivalent DuckDB text where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.scalars import settled
from tidegauge.runtime import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def comparable(df: DataFrame, settle: bool = True) -> DataFrame:
    """Zone-free timestamps and, where sums are involved, doubles rounded to six places.

    Engines add in different orders, so only rounded sums compare; plain values need no rounding.
    """
    shown = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind == "timestamp":
            column = column.cast("timestamp_ntz")
        elif kind == "double" and settle:
            column = settled(column, 6)
        shown.append(column.alias(name))
    return df.select(*shown)


def query(sql: str | None = None, settle: bool = True) -> Callable[[Query], Query]:
    def register(make: Query) -> Query:
        name = make.__name__

        @wraps(make)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return comparable(make(prepare(spark), sf), settle)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return make

    return register
