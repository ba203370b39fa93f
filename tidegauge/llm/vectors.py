"""Embedding rows as whole-number vectors of one length."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Names of the columns that this module gives, whatever else a table holds.
ID, LABEL, X = "vec_id", "label", "x"


def whole_vectors(rows: DataFrame, factor: int, offset: int, limit: int, key: str = "vec_id", vector: str = "embedding",
                  label: str | None = None) -> DataFrame:
    """Columns vec_id, x and, if asked for, label: x is floor(factor * component) + offset of each component, a long.

    Left out are rows whose vector is null, empty, or holds a null, NaN or infinite component, and those with a component of
    `limit` or more in size after scaling, whose products would leave a long. Vectors of another length than most rows have
    (of equally frequent lengths the greater) are left out too, as no product with the others exists.
    """
    body = F.col(vector).cast("array<double>")
    fits = F.forall(body, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * factor) < limit))
    chosen = rows.select(F.col(key).cast("bigint").alias(ID), body.alias("_body"),
                         *([F.col(label).cast("bigint").alias(LABEL)] if label else [])).filter(
        F.col("_body").isNotNull() & (F.size("_body") > 0) & F.coalesce(fits, F.lit(False)))
    lengths = chosen.groupBy(F.size("_body").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    # One number, found when the query runs.
    length = lengths.agg(F.max_by("length", F.struct("n", "length"))).scalar()
    x = F.transform("_body", lambda c: F.floor(c * factor) + offset)
    return chosen.filter(F.size("_body") == length).withColumn(X, x).drop("_body")


def matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    """Rows of a list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)
