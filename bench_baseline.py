"""Self-baseline: plain formulations in Spark against the library's, on the same session and tables.

Prints one JSON line: for each query the seconds of both, the median of BENCH_REPS runs, and the machine. The plain forms
compare all pairs, match again at each threshold, or use one window for all rows; results must be equal.
"""

from __future__ import annotations

import json
import os
import platform
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from calibra.functions import scalars as S  # noqa: E402
from calibra.operators import matching as M  # noqa: E402
from calibra.plans import fixtures as fx  # noqa: E402
from calibra.plans import registry as Q  # noqa: E402


def all_pairs(spark: SparkSession, sf: str) -> DataFrame:
    kinds = Q._members(spark, sf).filter("id = rep").select("rep", "words")
    dist = S.hamming(F.col("wa"), F.col("wb")).cast("long")
    a, b = kinds.toDF("a", "wa"), kinds.toDF("b", "wb")
    return a.join(b, (F.col("a") < F.col("b")) & (dist <= Q.NEAR_BITS)).select("a", "b", dist.alias("dist"))


def each_threshold(spark: SparkSession, sf: str) -> DataFrame:
    images, gt, _ = Q._run(spark, sf, split="val")
    pred = fx.frame(spark, sf, fx.PRED).join(images, "image", "left_semi")
    actual, out = gt.count(), None
    for t in (i / 100 for i in range(5, 96)):
        cut = M.match(gt, pred.filter(F.col("conf") >= t))
        row = cut.agg(F.lit(t).alias("threshold"), F.count_if(F.col("cls") == F.col("true_cls")).alias("correct"), F.count("*").alias("predicted"))
        out = row if out is None else out.unionByName(row)
    f1 = S.ratio(2 * F.col("correct"), F.col("predicted") + F.lit(actual))
    return out.select("threshold", "correct", "predicted", F.lit(actual).cast("long").alias("actual"), F.round(f1, 6).alias("f1"))


def pairs_of_values(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.frame(spark, sf, fx.MEASURES)
    p, q = m.filter("grp = 'misread'").select(F.col("value").alias("p")), m.filter("grp = 'correct'").select(F.col("value").alias("q"))
    n, k = p.count(), q.count()
    wins = p.join(q, F.col("p") >= F.col("q")).agg(F.sum(F.when(F.col("p") > F.col("q"), 1.0).otherwise(0.5)).alias("w"))
    return wins.select(F.round(F.col("w") / (n * k), 6).alias("auc"), F.lit(n).cast("long").alias("n_pos"), F.lit(k).cast("long").alias("n_neg"))


def one_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = Q._events(spark, sf).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    order = Window.orderBy("at", "id")
    new = F.when(F.col("at") - F.lag("at").over(order) <= 300_000_000, 0).otherwise(1)
    return rows.withColumn("new", new).select("id", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("session"))


PLAIN = {"hamming_pairs": all_pairs, "threshold_sweep": each_threshold, "auc": pairs_of_values, "sessionize": one_window}


def main() -> None:
    sf, cpus, reps = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_REPS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("baseline").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    Q.QUERIES["class_coverage"](spark, sf).write.format("noop").mode("overwrite").save()
    out = {}
    for name in os.environ.get("BENCH_NAMES", ",".join(PLAIN)).split(","):
        seconds, rows = {}, {}
        for kind, query in (("library", Q.QUERIES[name]), ("plain", PLAIN[name])):
            took = []
            for _ in range(reps):
                begin = time.time()
                found = query(spark, sf).collect()
                took.append(time.time() - begin)
            seconds[kind] = round(statistics.median(took), 3)
            rows[kind] = sorted(tuple(r[c] for c in sorted(r.asDict())) for r in found)
        out[name] = seconds | {"ratio": round(seconds["plain"] / seconds["library"], 2), "equal": rows["library"] == rows["plain"], "rows": len(rows["plain"])}
    print(json.dumps({"metric": "plain_over_library", "sf": sf, "cpus": int(cpus), "machine": platform.machine(), "spark": spark.version, "queries": out}))


if __name__ == "__main__":
    main()
