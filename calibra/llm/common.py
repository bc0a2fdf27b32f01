"""Helpers shared by the corpus operators: the shared folder, cut lineage, range buckets, text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for every operator: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On one machine it is set to a temporary folder where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="calibra-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark then deletes a query's shuffle files when it has ended; what it has written is read again instead.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.saved_at = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes the files of saved() tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column, from one narrow aggregation."""
    return df.agg(F.sum(F.octet_length(column)).alias("b")).first()["b"] or 0


def quantile_bounds(df: DataFrame, column: str, buckets: int) -> list[int]:
    """At most buckets - 1 increasing bounds that cut a column into about equal parts. Only the bounds reach the driver."""
    if buckets < 2:
        return []
    at = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(column, at, max(10_000, 20 * buckets)).alias("b")).first()
    return sorted(set(row["b"] or []))


def range_bucket(value: Column, bounds: list[int]) -> Column:
    """How many bounds are at most value, by a search in two steps; null values come first, in bucket 0."""
    if not bounds:
        return F.lit(0).cast("long")
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    fine = F.array(*[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups])
    coarse = F.size(F.filter(heads, lambda b: b <= value))
    within = F.size(F.filter(F.get(fine, coarse - 1), lambda b: b <= value))
    return F.when(value.isNull() | (coarse <= 0), 0).otherwise((coarse - 1) * step + within).cast("long")


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A batch's texts, null as empty."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text; a longer text stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
