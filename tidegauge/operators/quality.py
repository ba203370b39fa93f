"""Declared constraints as checks that split rows into accepted and rejected."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.schemas import Table


def fits(rows: DataFrame, column: str, kind: str) -> Column:
    """Whether a value that is not null fits a decimal type, rounded half up.

    Doubles are compared with the type's bound: a cast that overflows fails inside for each row, at ten times the cost.
    """
    if dict(rows.dtypes)[column] not in ("double", "float"):
        return F.col(column).try_cast(kind).isNotNull()
    precision, scale = (int(x) for x in re.findall(r"\d+", kind))
    return F.abs(F.round(F.col(column).cast("double"), scale)) < F.lit(float(10 ** (precision - scale)))


def _row_reason(rows: DataFrame, table: Table) -> Column:
    """First broken rule that a row shows by itself, null when there is none."""
    have = set(rows.columns)
    broken = [F.when(F.col(c).isNull(), F.lit(f"null {c}")) for c in table.not_null if c in have]
    broken += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), F.lit(f"bad {c}"))
               for c, values in table.allowed if c in have]
    broken += [F.when(F.col(c).isNotNull() & ~fits(rows, c, kind), F.lit(f"overflow {c}"))
               for c, kind in table.columns if c in have and kind.startswith("DECIMAL")]
    return F.coalesce(*broken, F.lit(None).cast("string"))


def storage_check(rows: DataFrame, table: Table) -> DataFrame:
    """Rows with `reject_reason`: null times or symbols, values outside a list, decimals that do not fit."""
    return rows.withColumn("reject_reason", _row_reason(rows, table))


def orphans(rows: DataFrame, column: str, parents: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose non-null reference has no parent."""
    known = parents.select(F.col(parent_key).alias("_parent"))
    return rows.filter(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_parent"), "left_anti")


def referenced(rows: DataFrame, column: str, parents: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose reference is null or has a parent."""
    known = parents.select(F.col(parent_key).alias("_parent"))
    return rows.filter(F.col(column).isNull()).unionByName(
        rows.join(known, F.col(column) == F.col("_parent"), "left_semi"))


def split(rows: DataFrame, table: Table, parents: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); rejected rows carry `reject_reason`."""
    checked = storage_check(rows, table)
    accepted = checked.filter(F.col("reject_reason").isNull())
    rejected = checked.filter(F.col("reject_reason").isNotNull())
    for column, parent in table.parents:
        if parents and parent in parents:
            lost = orphans(accepted, column, parents[parent])
            rejected = rejected.unionByName(lost.withColumn("reject_reason", F.lit(f"no {parent} for {column}")))
            accepted = referenced(accepted, column, parents[parent])
    return accepted.drop("reject_reason"), rejected
