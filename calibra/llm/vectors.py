"""Shared by the operators on vectors: which rows count, and batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scaled_rows(rows: DataFrame, vector: str, scale: int, offset: int, kept: list[str]) -> DataFrame:
    """The kept columns and x, the long vector floor(scale * c) + offset, of each row with a finite vector.

    Rows whose vector is null or holds null, NaN or infinite entries are dropped. Vectors of several lengths have no common
    space: those of the most frequent length stay, of the shortest of such.
    """
    rows = rows.select(*kept, F.col(vector).cast("array<double>").alias("x"))
    fine = rows.filter(F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    first = fine.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    scaled = F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(offset))
    return fine.filter(F.size("x") == (first["n"] if first else 0)).select(*kept, scaled.alias("x"))


def matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    """A batch's vectors as rows of a matrix of 64-bit integers."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(batch.num_rows, -1)
