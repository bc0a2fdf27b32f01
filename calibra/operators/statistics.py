"""Rank statistics, quantiles, bootstrap and paired tests."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibra.functions.scalars import wilson
from calibra.operators.ranges import SLICE, numbered, sliced


def auc(rows: DataFrame, positive: str, negative: str, by: list[str] | None = None) -> DataFrame:
    """The chance that a positive value is above a negative one, half for equals; NaN without either. rows: grp, value.

    Equal values are counted first, and the distinct values are cut into ranges. Within a range each value is held
    against the negatives below it there; the negatives of the ranges below are added as a whole.
    """
    by = by or []
    counts = rows.groupBy(*by, "value").agg(F.count_if(F.col("grp") == positive).alias("p"), F.count_if(F.col("grp") == negative).alias("q")).filter("p + q > 0")
    return _auc_of_counts(sliced(counts, [], [F.col("value")]), by)


def _auc_of_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """AUC from counts p and q of distinct values in ranges, SLICE. A key has one row for each range in the last window."""
    below = Window.partitionBy(*by, SLICE).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("below", F.coalesce(F.sum("q").over(below), F.lit(0)))
    parts = counts.groupBy(*by, SLICE).agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum(F.col("p") * (F.col("below") + F.col("q") / F.lit(2.0))).alias("wins"))
    lower = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("lower", F.coalesce(F.sum("q").over(lower), F.lit(0)))
    wins = F.sum(F.col("wins") + F.col("p") * F.col("lower"))
    pairs = F.coalesce(F.sum("p").cast("double") * F.sum("q"), F.lit(0.0))
    return parts.groupBy(*by).agg(F.when(pairs > 0, wins / F.when(pairs > 0, pairs).otherwise(1)).otherwise(F.lit(float("nan"))).alias("auc"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("q"), F.lit(0)).alias("n_neg"))


def within_groups(rows: DataFrame, positive: str, negative: str, cluster: str) -> DataFrame:
    """AUC over pairs within a cluster that holds both kinds: clusters, pairs, auc."""
    each = auc(rows, positive, negative, [cluster]).filter("n_pos > 0 and n_neg > 0").withColumn("pairs", F.col("n_pos") * F.col("n_neg"))
    return each.agg(F.count("*").alias("clusters"), F.sum("pairs").alias("pairs"), (F.sum(F.col("auc") * F.col("pairs")) / F.sum("pairs")).alias("auc"))


def describe(rows: DataFrame) -> DataFrame:
    """n, quartiles and median of each group by linear interpolation, exactly."""
    q = lambda p: F.percentile("value", F.lit(p))
    return rows.groupBy("grp").agg(F.count("value").alias("n"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"))


def group_sizes(rows: DataFrame, cluster: str) -> DataFrame:
    return rows.groupBy("grp").agg(F.count("value").alias("boxes"), F.count_distinct(F.when(F.col("value").isNotNull(), F.col(cluster))).alias("images"), F.count_if(F.col("value").isNull()).alias("unmeasurable"))


#: Draws that one task makes from a stored state of the generator, and draws of all resamples that every task may hold.
DRAWS = 1 << 20
MOST_SENT = 1 << 20


def generator_blocks(seed: int, draws: int, block: int) -> Iterator[tuple[int, int, bytes]]:
    """The first draw, the number of draws and the generator's state for each block of CPython's random.Random(seed).

    One pass goes over the draws, without keeping any, and numpy's generator takes CPython's state as it is.
    """
    state = random.Random(seed).getstate()[1]
    rng = np.random.RandomState()
    rng.set_state(("MT19937", np.array(state[:-1], np.uint32), state[-1]))
    for first in range(0, draws, block):
        _, keys, place, *_ = rng.get_state()
        n = min(block, draws - first)
        yield first, n, np.append(keys, np.uint32(place)).astype("<u4").tobytes()
        if first + n < draws:
            rng.random_sample(n)


def drawn_places(state: bytes, n: int, clusters: int) -> np.ndarray:
    """n places of clusters from a stored state, as random.choices draws them."""
    words = np.frombuffer(state, "<u4")
    rng = np.random.RandomState()
    rng.set_state(("MT19937", words[:-1], int(words[-1])))
    return np.floor(rng.random_sample(n) * float(clusters)).astype(np.int64)


def resamples(spark: SparkSession, clusters: int, reps: int, seed: int, block: int = DRAWS) -> DataFrame:
    """rep, place and times: how often each resample draws each place. A resample may come in several blocks, whose times add up."""
    blocks = spark.createDataFrame(list(generator_blocks(seed, clusters * reps, block)), "first long, n long, state binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, state in zip(*(batch.column(c).to_pylist() for c in ("first", "n", "state")), strict=True):
                at = first + np.arange(n)
                both, times = np.unique((at // clusters) * clusters + drawn_places(state, n, clusters), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(both // clusters), pa.array(both % clusters), pa.array(times)], ["rep", "place", "times"])

    return blocks.repartition(max(1, -(-clusters * reps // block)), "first").mapInArrow(run, "rep long, place long, times long")


def bootstrap_auc(rows: DataFrame, positive: str, negative: str, cluster: str, reps: int, seed: int) -> DataFrame:
    """The 95 % interval of the AUC under resampling of whole clusters: low, high, used, skipped (a side was empty).

    How often each resample draws each cluster is a table, made in blocks from stored states of the generator; it joins
    the clusters' counts of each value by the clusters' places, and the AUC is taken by resample over ranges of values.
    """
    values = rows.filter(F.col("grp").isin(positive, negative)).groupBy(cluster, "value").agg(F.count_if(F.col("grp") == positive).alias("p"), F.count_if(F.col("grp") == negative).alias("q"))
    values = sliced(values, [], [F.col("value")])
    places = numbered(values.select(cluster).distinct(), [], [F.col(cluster)], "place").withColumnRenamed(cluster, "_cluster")
    n = places.count()
    placed = values.join(places, values[cluster].eqNullSafe(places["_cluster"])).select("place", SLICE, "value", "p", "q")
    drawn = resamples(rows.sparkSession, n, reps, seed)
    if n * reps <= MOST_SENT:
        # Each range of values stays in one task, from the join over the counts to their sums.
        slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        placed, drawn = placed.repartition(slices, SLICE), F.broadcast(drawn)
    counts = placed.join(drawn, "place").groupBy("rep", SLICE, "value").agg(F.sum(F.col("times") * F.col("p")).alias("p"), F.sum(F.col("times") * F.col("q")).alias("q"))
    found = _auc_of_counts(counts, ["rep"])
    q = lambda p: F.percentile("auc", F.lit(p))
    found = found.filter(~F.isnan("auc")).agg(q(0.025).alias("low"), q(0.975).alias("high"), F.count("auc").alias("used"))
    return found.withColumn("skipped", F.lit(reps) - F.col("used"))


def binomial_tail(b: Column, c: Column) -> Column:
    """The chance of c or fewer heads in b + c fair throws: an exact one-sided McNemar test; 1 without throws."""
    n = (b + c).cast("double")
    start = F.struct(F.exp(-n * F.log(F.lit(2.0))).alias("term"), F.lit(0.0).alias("sum"))
    tail = F.aggregate(
        F.sequence(F.lit(0).cast("long"), c.cast("long")),
        start,
        lambda a, k: F.struct((a["term"] * (n - k) / (k + 1)).alias("term"), (a["sum"] + a["term"]).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail))


def paired(control: DataFrame, treatment: DataFrame, misread: Column) -> DataFrame:
    """Discordant counts of two runs over the same keys(image, gt_idx) and the test: b misread by control only, c by treatment only.

    A key that only one run has is an error, not a row.
    """
    a = control.withColumn("m", misread).select("image", "gt_idx", F.col("m").alias("m_c"))
    t = treatment.withColumn("m", misread).select("image", "gt_idx", F.col("m").alias("m_t"))
    both = a.join(t, ["image", "gt_idx"], "full_outer")
    one = F.count_if(F.col("m_c").isNull() | F.col("m_t").isNull())
    counts = both.agg(F.count_if(F.col("m_c") & ~F.col("m_t")).alias("b"), F.count_if(~F.col("m_c") & F.col("m_t")).alias("c"), F.count_if("m_c").alias("misread_c"), F.count_if("m_t").alias("misread_t"), one.alias("_one"))
    checked = F.when(F.col("_one") > 0, F.raise_error(F.lit("the two runs do not cover the same boxes"))).otherwise(F.col("b"))
    return counts.withColumn("b", checked.cast("long")).withColumn("p", binomial_tail(F.col("b"), F.col("c"))).drop("_one")


def arms(rows: DataFrame) -> DataFrame:
    """Summary of each arm: n, successes, share (null without boxes), its interval, and two medians."""
    out = rows.groupBy("arm").agg(
        F.count("*").alias("n"), F.count_if("success").alias("successes"),
        F.median(F.col("after_conf") - F.col("before_conf")).alias("median_change"), F.median("clipped").alias("median_clipped"),
    )
    w = wilson(F.col("successes"), F.col("n"))
    return out.withColumns({"share": F.when(F.col("n") > 0, F.col("successes") / F.greatest(F.col("n"), F.lit(1))), "low": w["low"], "high": w["high"]})


def best_epoch(rows: DataFrame) -> DataFrame:
    """The greatest score of rows(epoch, val, ema) and its epoch: the earliest, and of one epoch the first column."""
    flat = rows.select("epoch", F.posexplode(F.array("val", "ema")).alias("col", "score")).filter("score is not null")
    return flat.agg(F.max("score").alias("score"), F.max_by("epoch", F.struct("score", -F.col("epoch"), -F.col("col"))).alias("epoch"))


def median_targets(rows: DataFrame) -> DataFrame:
    """Of rows(a, b): each side's count and medians, NaN where a side is empty, and the rows without a colour."""
    from calibra.functions.scalars import side

    s = side(F.col("b"))
    nan = lambda c: F.coalesce(c, F.lit(float("nan")))
    out = []
    for name in ("yellow", "blue"):
        mine = (s == name) & F.col("b").isNotNull()
        out += [F.count_if(mine).alias(f"n_{name}"), *[nan(F.median(F.when(mine, F.col(c)))).alias(f"{c}_{name}") for c in "ab"]]
    return rows.agg(*out, F.count_if(F.col("b").isNull()).alias("unmeasurable"))
