"""Capture sessions on one timeline, joined where near-duplicates link them, and the split built from them."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibra.operators.ranges import SLICE, numbered, sliced, use_checkpoints

GAP_MINUTES = 5


def sessionize(rows: DataFrame, gap_minutes: int = GAP_MINUTES, slices: int | None = None) -> DataFrame:
    """rows(id, ts) with session, numbered from 1 by time; a gap of more than gap_minutes begins a new one.

    The timeline is dealt to ranges that are sessionized on their own; a range's numbers then go on from those before it,
    which takes the ranges' ends alone: a row for each range meets in one task.
    """
    rows = sliced(rows.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp"))), [], [F.col("_at"), F.col("id")], slices)
    local = Window.partitionBy(SLICE).orderBy("_at", "id")
    wide = gap_minutes * 60_000_000
    rows = rows.withColumn("_new", (F.col("_at") - F.lag("_at").over(local) > wide).cast("long"))
    rows = rows.withColumn("_n", F.sum(F.coalesce("_new", F.lit(0))).over(local.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy(SLICE).agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.max("_n").alias("n"))
    over = Window.orderBy(SLICE)
    ends = ends.withColumn("begins", F.coalesce((F.col("first") - F.lag("last").over(over) > wide).cast("long"), F.lit(1)))
    upto = over.rowsBetween(Window.unboundedPreceding, -1)
    base = ends.select(SLICE, (F.coalesce(F.sum("n").over(upto), F.lit(0)) + F.sum("begins").over(over.rowsBetween(Window.unboundedPreceding, 0))).alias("_base"))
    # A row for each range.
    return rows.join(F.broadcast(base), SLICE).withColumn("session", (F.col("_n") + F.col("_base")).cast("long")).drop("_at", SLICE, "_new", "_n", "_base")


def merge_sessions(rows: DataFrame, near: DataFrame) -> DataFrame:
    """rows(id, ts, session) with session merged over near(a, b), renumbered from 1 by first moment.

    The pairs are lifted to sessions before labels spread, so the rounds touch sessions and not images. A lower session
    stands for its component; of components that begin together the one with the lower session comes first.
    """
    of = lambda c: rows.select(F.col("id").alias(c), F.col("session").alias(f"s_{c}"))
    links = near.join(of("a"), "a").join(of("b"), "b").filter("s_a <> s_b").select(F.col("s_a").alias("a"), F.col("s_b").alias("b"))
    labels = spread(links)
    named = rows.join(labels, rows["session"] == labels["id_"], "left").withColumn("_s", F.coalesce("label", "session")).drop("id_", "label")
    starts = named.groupBy("_s").agg(F.min("ts").alias("_from"))
    places = numbered(starts, [], [F.col("_from"), F.col("_s")], "_number", 1).select("_s", "_number")
    return named.join(places, "_s").withColumn("session", F.col("_number")).drop("_s", "_number")


def spread(links: DataFrame) -> DataFrame:
    """id_ and label, the least id reachable over links(a, b); each round is checkpointed in the shared folder."""
    use_checkpoints(links.sparkSession)
    both = links.select("a", "b").union(links.select("b", "a")).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("id_")).agg(F.least(F.col("a"), F.min("b")).alias("label")).checkpoint()
    while True:
        heard = both.join(labels, both["b"] == labels["id_"]).groupBy("a").agg(F.min("label").alias("heard"))
        step = labels.join(heard, labels["id_"] == heard["a"]).select("id_", F.least("label", "heard").alias("new"), "label")
        own = labels.select(F.col("id_").alias("new"), F.col("label").alias("of"))
        step = step.join(own, "new", "left").select("id_", F.least("new", F.coalesce("of", "new")).alias("next"), "label").checkpoint()
        labels = step.select("id_", F.col("next").alias("label"))
        if not step.filter("next < label").limit(1).count():
            return labels


#: Split rules: share of test images and its aim, least images of a class in the test part and in the rest.
TEST_SHARE, TEST_AIM, TEST_LEAST, REST_LEAST = (0.15, 0.25), 0.20, 15, 100
VAL_SHARE, VAL_TRIALS, VAL_SEED = (0.12, 0.17), 2000, 26
MOST_DATES = 20


def test_dates(rows: DataFrame, classes: list[str], share=TEST_SHARE, aim=TEST_AIM, test_least=TEST_LEAST, rest_least=REST_LEAST) -> DataFrame:
    """The set of dates for the test part: dates, images, gap. rows has id, day, classes (an array).

    All proper subsets of at most MOST_DATES dates are tried on counts by date and class. The least gap from the
    aim wins, and of equals the first list of dates; without any it is an error.
    """
    by_day = rows.groupBy("day").agg(F.count("*").alias("images"))
    n_days = by_day.count()
    if n_days > MOST_DATES:
        raise ValueError(f"{n_days} dates have too many subsets")
    by_class = rows.select("day", F.explode(F.array_distinct("classes")).alias("cls")).groupBy("day", "cls").agg(F.count("*").alias("n"))
    counts = by_class.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("cls", "n"))).alias("by_class"))
    days = by_day.join(counts, "day", "left")
    per_class = F.array(*[F.coalesce(F.try_element_at("by_class", F.lit(c)), F.lit(0)) for c in classes])
    days = days.agg(F.sort_array(F.collect_list(F.struct("day", "images", per_class.alias("per")))).alias("days"))
    tried = days.select("days", F.explode(F.sequence(F.lit(1), F.lit(2**n_days - 2))).alias("mask"))
    chosen = F.filter("days", lambda d, i: F.getbit(F.col("mask"), i) == 1)
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, d: a + d["images"])
    per = lambda part: F.aggregate(part, F.array(*[F.lit(0).cast("long")] * len(classes)), lambda a, d: F.zip_with(a, d["per"], lambda x, y: x + y))
    tried = tried.withColumn("in", chosen).withColumns({"images": total(F.col("in")), "all": total(F.col("days")), "test": per(F.col("in")), "every": per(F.col("days"))})
    part = F.col("images") / F.col("all")
    fine = part.between(*share) & (F.array_min("test") >= test_least) & (F.array_min(F.zip_with("every", "test", lambda e, t: e - t)) >= rest_least)
    good = tried.filter(fine).select(F.transform("in", lambda d: d["day"]).alias("dates"), "images", F.abs(part - aim).alias("gap"))
    best = good.agg(F.min_by(F.struct("dates", "images", "gap"), F.struct("gap", "dates")).alias("b"))
    found = F.when(F.col("b").isNull(), F.raise_error(F.lit("no set of dates satisfies the rule")).cast("boolean")).otherwise(F.lit(True))
    return best.filter(found).select("b.dates", "b.images", "b.gap")


#: Trials that one task makes from a stored state of the generator.
TRIALS = 50


def permutation_states(n: int, trials: int, seed: int, block: int = TRIALS) -> list[tuple[int, int, str]]:
    """The first trial, the number of trials and the generator's state for each block of numpy's seeded permutations of n."""
    rng, out = np.random.default_rng(seed), []
    for first in range(0, trials, block):
        out.append((first, min(block, trials - first), json.dumps(rng.bit_generator.state)))
        if first + block < trials:
            for _ in range(block):
                rng.permutation(n)
    return out


def permuted(spark, n: int, trials: int, seed: int, begin: int, end: int, block: int = TRIALS) -> DataFrame:
    """trial, rank and place for the ranks from begin to end of each trial's permutation of n places."""

    def run(batches):
        for batch in batches:
            for first, many, state in zip(*(batch.column(c).to_pylist() for c in ("first", "many", "state")), strict=True):
                rng = np.random.default_rng()
                rng.bit_generator.state = json.loads(state)
                for t in range(first, first + many):
                    places = rng.permutation(n)[begin:end]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), t)), pa.array(np.arange(begin, begin + len(places))), pa.array(places)], ["trial", "rank", "place"])

    blocks = spark.createDataFrame(permutation_states(n, trials, seed, block), "first long, many long, state string")
    return blocks.repartition(max(1, -(-trials // block)), "first").mapInArrow(run, "trial long, rank long, place long")


def filled(drawn: DataFrame, sizes: DataFrame, low: float, high: float) -> DataFrame:
    """trial, total and the places taken: in the order of rank, each one that keeps the total within high, until it reaches low."""
    by_trial = drawn.join(sizes, "place").groupBy("trial").agg(F.sort_array(F.collect_list(F.struct("rank", "place", "images"))).alias("order"))

    def step(acc, s):
        fits = (acc["total"] < low) & (acc["total"] + s["images"] <= high)
        return F.struct(F.when(fits, acc["total"] + s["images"]).otherwise(acc["total"]).alias("total"), F.when(fits, F.concat(acc["taken"], F.array(s["place"]))).otherwise(acc["taken"]).alias("taken"))

    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<long>").alias("taken"))
    return by_trial.select("trial", F.aggregate("order", start, step).alias("f")).select("trial", "f.total", "f.taken")


def val_sessions(pool: DataFrame, classes: list[str], n: int, share=VAL_SHARE, trials=VAL_TRIALS, seed=VAL_SEED, needed: bool = True) -> DataFrame:
    """Sessions for the validation part: the seeded fill with the best least-covered class, the first of equals.

    pool has id, session, ts, classes. Sessions are numbered by first moment, and each trial's permutation of these places
    joins their sizes; permutations are made in blocks from stored states of numpy's generator. As a fill ends early, a
    quarter of the ranks is tried first, and the whole order only where trials have not ended by then. Where no trial
    has a share in the range, it is an error; or, if a choice is not `needed`, there are no rows.
    """
    per = [F.count_if(F.array_contains("classes", c)).alias(f"c{i}") for i, c in enumerate(classes)]
    sessions = pool.groupBy("session").agg(F.min("ts").alias("first"), F.count("*").alias("images"), *per)
    sessions = numbered(sessions, [], [F.col("first"), F.col("session")], "place")
    spark, places, low, high = pool.sparkSession, sessions.count(), share[0] * n, share[1] * n
    sizes = sessions.select("place", "images")
    quarter = min(places, max(64, places // 4))
    use_checkpoints(spark)
    tried = filled(permuted(spark, places, trials, seed, 0, quarter), sizes, low, high).checkpoint()
    if quarter < places:
        rest = tried.filter(F.col("total") < low).select("trial")
        if not rest.isEmpty():
            again = permuted(spark, places, trials, seed, 0, places).join(F.broadcast(rest), "trial")  # `trials` rows at most
            tried = tried.filter(F.col("total") >= low).unionByName(filled(again, sizes, low, high))
    good = tried.filter(F.col("total").between(low, high)).select("trial", F.explode("taken").alias("place")).join(sessions, "place")
    scores = good.groupBy("trial").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(classes))])
    score = F.array_min(F.array(*[f"c{i}" for i in range(len(classes))]))
    best = scores.select("trial", score.alias("score")).agg(F.max_by(F.struct("trial", "score"), F.struct("score", -F.col("trial"))).alias("b")).first()["b"]
    if best is None:
        if needed:
            raise ValueError("no trial reaches the share of the validation part")
        return good.select("trial", F.lit(None).cast("long").alias("score"), "session").limit(0)
    return good.filter(F.col("trial") == best["trial"]).select("trial", F.lit(best["score"]).cast("long").alias("score"), "session")


def assign(rows: DataFrame, dates: DataFrame, val: DataFrame) -> DataFrame:
    """rows(id, day, session, exclusion) with split: excluded, test, val or train; excluded rows have no session."""
    test = dates.select(F.explode("dates").alias("day"), F.lit(True).alias("_test"))
    chosen = val.select("session", F.lit(True).alias("_val"))
    split = F.when(F.col("exclusion") != "", "excluded").when(F.col("_test"), "test").when(F.col("_val"), "val").otherwise("train")
    out = rows.join(test, "day", "left").join(chosen, "session", "left").withColumn("split", split)
    return out.withColumn("session", F.when(F.col("exclusion") == "", F.col("session"))).drop("_test", "_val")
