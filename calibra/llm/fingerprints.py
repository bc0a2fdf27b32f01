"""Document fingerprints: bottom-k sketches of word-shingle hashes, with DataFrame functions only.

A sketch is the sorted array of the k least distinct shingle hashes of a text. Sketches of parts merge into the
sketch of the whole. They estimate resemblance, containment and the number of distinct shingles; with fewer than k
shingles they are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibra.llm.common import WORD, quantile_bounds, range_bucket, shuffle_partitions, table

SHINGLE, K = 5, 128
#: Hashes have 48 bits, so that a sketch is eight base64 characters each.
RANGE = 1 << 48


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, though body names it often: an expression is else copied to each place."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1)), lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """Hashes of each run of `size` words; of the whole sequence if it is shorter; none without words. Repeats stay."""
    runs = F.transform(
        F.sequence(F.lit(0), F.size(words) - size),
        lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)]),
    )
    return F.when(F.size(words) >= size, runs).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(F.transform(hashes, lambda h: F.shiftrightunsigned(h, 16)))), 1, k)


def sketch(text: Column, size: int = SHINGLE, k: int = K) -> Column:
    return let(word_hashes(text), lambda words: bottom_k(shingle_hashes(words, size), k))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_shingles(s: Column, k: int = K) -> Column:
    """About how many distinct shingles the text has; exactly, below k."""
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) * float(RANGE) / F.element_at(s, k))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Jaccard similarity of the shingle sets, estimated on the sketch of both; 1 if both are empty."""

    def of(both: Column) -> Column:
        common = F.size(F.array_intersect(F.array_intersect(both, a), b))
        return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.greatest(F.size(both), F.lit(1)))

    return let(merged(a, b, k), of)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The share of a's shingles that b has, from the resemblance and both sizes; 1 if a is empty."""
    r, n, m = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r / (1 + r) * (n + m) / F.greatest(n, F.lit(1.0))))


def printed(s: Column) -> Column:
    """A sketch as text: base64 of its hashes, six bytes each."""
    return F.translate(F.base64(F.unhex(F.concat_ws("", F.transform(s, lambda h: F.lpad(F.hex(h), 12, "0"))))), "\r\n", "")


def with_next(docs: DataFrame, carried: list[str], buckets: int) -> DataFrame:
    """docs with next_<c> for each carried column: the following row's by (doc_id, text), after the last the first's.

    Rows are dealt to ranges of doc_id, and each range also gets the first row of the ranges after it, so no task
    holds more than a range. Only the ranges' first rows meet in one task, one row a range.
    """
    bounds = quantile_bounds(docs, "doc_id", buckets)
    rows = docs.withColumn("_range", range_bucket(F.col("doc_id"), bounds))
    # At most a row for each range: the least doc_id (null first), and of its texts the least.
    least = rows.groupBy("_range").agg(F.when(F.count("*") > F.count("doc_id"), None).otherwise(F.min("doc_id")).alias("_first"))
    first = rows.join(F.broadcast(least.withColumnRenamed("_range", "_r")), (F.col("_range") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_first")))
    first = first.groupBy("_range", "doc_id").agg(F.min("text").alias("text"))
    # The range before a first row is the greatest non-empty one below it; the first range follows the last.
    before = F.coalesce(F.lag("_range").over(Window.orderBy("_range")), F.max("_range").over(Window.partitionBy()))
    edges = first.withColumn("_range", before).select("_range", "doc_id", "text")
    extra = [c for c in carried if c != "text"]
    edges = edges.withColumns({c: docs_column for c, docs_column in {c: _CARRIED[c](F.col("text")) for c in extra}.items()})
    columns = ["_range", "doc_id", "text", *extra]
    both = rows.select(*columns, F.lit(0).alias("_edge")).unionByName(edges.select(*columns, F.lit(1).alias("_edge")))
    order = Window.partitionBy("_range").orderBy("_edge", "doc_id", "text")
    return both.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).filter("_edge = 0").drop("_edge", "_range")


_CARRIED = {"sketch": sketch}


def fingerprint_edits(docs: DataFrame, buckets: int) -> DataFrame:
    """The rows of op10: each text's fingerprint, its edited text's, and their likeness.

    A null text is empty. Repeated rows stay and are next to each other; null doc_ids come first; other columns are
    ignored; an empty table gives no rows; a single document is its own next one.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sketch", sketch(F.col("text")))
    rows = with_next(rows, ["text", "sketch"], buckets).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", "n_chars", "sketch", "next_sketch", edited.alias("edited")).withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"),
        printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_shingles(F.col("sketch")).alias("distinct_shingles"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_contained"),
    )


def op10_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"), max(16, 4 * shuffle_partitions(spark)))
