"""Running sums and row numbers within a key, over ranges of the order instead of one window for a key.

Rows are dealt to ranges of (key, order) and summed up within each. A range's totals of the key that goes on in the next
one are carried over to it, at most one row for each range, so a key of any size is spread over as many tasks as it fills.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE = "_slice"


def use_checkpoints(spark: SparkSession) -> None:
    """Makes checkpoints go to spark.checkpoint.dir; on one machine, where it is unset, to a temporary folder."""
    if not spark.sparkContext.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            where = tempfile.mkdtemp(prefix="calibra-")
        spark.sparkContext.setCheckpointDir(where)


def sliced(rows: DataFrame, by: list[str], order: list[Column], slices: int | None = None) -> DataFrame:
    """rows with SLICE, the number of their range of (by, order), ascending in that order; cut off from their lineage."""
    spark = rows.sparkSession
    use_checkpoints(spark)
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return rows.repartitionByRange(slices, *[F.col(c) for c in by], *order).withColumn(SLICE, F.spark_partition_id()).checkpoint()


def running(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], slices: int | None = None) -> DataFrame:
    """rows with, for each name of sums, its expression's sum over the key's rows up to and with this one.

    `order` must tell the rows of a key apart, or equal ones come in any order. Null keys are a key of their own; null
    values count as nothing; no rows give none.
    """
    parts = sliced(rows.withColumns({f"_carry_value_{n}": e for n, e in sums.items()}), by, order, slices)
    own = Window.partitionBy(SLICE, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = parts.withColumns({n: F.coalesce(F.sum(f"_carry_value_{n}").over(own), F.lit(0)) for n in sums}).drop(*[f"_carry_value_{n}" for n in sums])
    return carried(local, parts.groupBy(SLICE, *by).agg(*[F.sum(f"_carry_value_{n}").alias(n) for n in sums]), by, list(sums)).drop(SLICE)


def carried(local: DataFrame, totals: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """local's running sums within its slices, with the totals of a key's earlier slices added.

    Only keys that go on in a further slice have something to carry, so at most one row for each slice is broadcast.
    """
    before = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col(SLICE).alias("_carry_slice"), *[F.col(c).alias(f"_carry_key_{c}") for c in by], F.count(F.lit(1)).over(before).alias("_carry_earlier"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_carry_sum_{n}") for n in names])
    same = F.col(SLICE) == F.col("_carry_slice")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_carry_key_{c}"))
    joined = local.join(F.broadcast(base.filter("_carry_earlier > 0").drop("_carry_earlier")), same, "left")
    added = {n: F.col(n) + F.coalesce(F.col(f"_carry_sum_{n}"), F.lit(0)) for n in names}
    return joined.withColumns(added).drop("_carry_slice", *[f"_carry_key_{c}" for c in by], *[f"_carry_sum_{n}" for n in names])


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str, start: int = 0, slices: int | None = None) -> DataFrame:
    """rows with `name`, their place within the key from `start` on, without gaps."""
    out = running(rows, by, order, {name: F.lit(1)}, slices)
    return out.withColumn(name, (F.col(name) + (start - 1)).cast("long"))
