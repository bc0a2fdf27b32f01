"""Near-duplicate hashes by an exact join, over bands or between parts of all hashes, and what leaks between splits."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibra.operators.ranges import use_checkpoints
from calibra.operators.sessions import spread


#: Look-ups of one hash in all bands, at most. A row looked up costs about as much as this many compared pairs.
MOST_PROBES, PROBE_COST = 20_000, 3
#: Hashes of a part, how many of them meet another part's at once, and the most parts: of more hashes parts are greater, as
#: each is sent once for every part. A pair that is met there costs as much, for each 64 bits, as so many of the pairs that a
#: join over bands compares.
TILE, STEP, PARTS, TILE_COST = 8192, 16, 128, 0.05


def ball(width: int, radius: int) -> int:
    """How many values of `width` bits lie within `radius` bits of one."""
    return sum(math.comb(width, i) for i in range(radius + 1))


def band_plan(total_bits: int, max_bits: int, n: int) -> list[tuple[int, int, int]]:
    """First bit, width and radius of bands such that hashes within max_bits of each other agree in some band to its radius.

    If each band differed in more than its radius, all would differ in at least the sum of radius + 1, which is made
    max_bits + 1. Fewer, wider bands with greater radii part unlike hashes better and look up more values: of the plans
    with 1 to max_bits + 1 bands the one with the least expected cost for n random hashes is taken. Of a band that a long
    does not hold, 62 bits are used: they differ in no more bits than the band.
    """
    return _cheapest(total_bits, max_bits, n)[1]


def _cheapest(total_bits: int, max_bits: int, n: int) -> tuple[float, list[tuple[int, int, int]]]:
    best = None
    for bands in range(1, min(max_bits + 1, total_bits) + 1):
        edges = [total_bits * b // bands for b in range(bands + 1)]
        plan = [(lo, min(hi - lo, 62), (max_bits + 1) * (b + 1) // bands - (max_bits + 1) * b // bands - 1) for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
        looked_up = [ball(w, r) for _, w, r in plan]
        if sum(looked_up) > MOST_PROBES and bands <= max_bits:
            continue
        cost = PROBE_COST * n * sum(looked_up) + n * n / 2 * sum(v / 2**w for v, (_, w, _) in zip(looked_up, plan, strict=True))
        if best is None or cost < best[0]:
            best = cost, plan
    return best


def in_tiles(total_bits: int, max_bits: int, n: int) -> bool:
    """Whether n hashes meet all others part by part for less than what a join over bands costs.

    Radii that are wide for the bits leave bands so few pairs to part that looking up costs more: of 64 bits at 16 that
    holds for any number of hashes, of 256 at 20 for hundreds.
    """
    return TILE_COST * -(-total_bits // 64) * n * n / 2 <= _cheapest(total_bits, max_bits, n)[0]


def band_value(words: Column, first: int, width: int) -> Column:
    """Bits first to first + width of a hash of 32-bit words, as one long."""
    value = F.lit(0).cast("long")
    for w in range(first // 32, (first + width - 1) // 32 + 1):
        low, high = max(first, 32 * w) - 32 * w, min(first + width, 32 * w + 32) - 32 * w
        part = F.shiftrightunsigned(F.get(words, F.lit(w)), 32 - high).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long"))
        value = F.shiftleft(value, high - low).bitwiseOR(part)
    return value


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << i for i in bits) for k in range(radius + 1) for bits in itertools.combinations(range(width), k)]


def _plain(kinds: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """k (a band and its bits), a and wa: each hash under its own bits of each band."""
    keys = F.array(*[F.struct(F.lit(i).alias("b"), band_value(F.col("words"), lo, w).alias("v")) for i, (lo, w, _) in enumerate(plan)])
    return kinds.select(F.col("rep").alias("a"), F.col("words").alias("wa"), F.explode(keys).alias("k"))


def _probing(kinds: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """k, b and wb: each hash under every value within the radius of its bits, band by band."""
    out = None
    for i, (lo, w, r) in enumerate(plan):
        own, band = band_value(F.col("words"), lo, w), F.lit(i)
        near = F.transform(F.array(*[F.lit(m).cast("long") for m in _masks(w, r)]), lambda m: F.struct(band.alias("b"), own.bitwiseXOR(m).alias("v")))  # noqa: B023
        one = kinds.select(F.col("rep").alias("b"), F.col("words").alias("wb"), F.explode(near).alias("k"))
        out = one if out is None else out.unionByName(one)
    return out


def _first_band(plan: list[tuple[int, int, int]]) -> Column:
    """The first band in which wa and wb agree to its radius: where a pair that shares several is taken once."""
    out = F.lit(len(plan))
    for i, (lo, w, r) in reversed(list(enumerate(plan))):
        out = F.when(F.bit_count(band_value(F.col("wa"), lo, w).bitwiseXOR(band_value(F.col("wb"), lo, w))) <= r, F.lit(i)).otherwise(out)
    return out


def classes(hashes: DataFrame) -> DataFrame:
    """hashes(id, words) with rep, the least id of equal hashes."""
    reps = hashes.groupBy("words").agg(F.min("id").alias("rep"))
    return hashes.join(reps, "words").select("id", "rep", "words")


def _distance(total_bits: int) -> Column:
    """Bits in which wa and wb differ, word by word, so that it is compiled into the join."""
    return sum((F.bit_count(F.get("wa", F.lit(w)).bitwiseXOR(F.get("wb", F.lit(w)))) for w in range(1, -(-total_bits // 32))), F.bit_count(F.get("wa", F.lit(0)).bitwiseXOR(F.get("wb", F.lit(0)))))


def _kinds(members: DataFrame) -> DataFrame:
    return members.filter("id = rep").select("rep", "words").distinct()


def _met(group: pa.Table, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in a group of one or two parts, and differing bits, of its near pairs: within the part, or between the two."""
    words = group.column("words").combine_chunks()
    words = words.flatten().to_numpy().reshape(len(words), -1).astype(np.uint64)
    if words.shape[1] % 2:
        words = np.pad(words, ((0, 0), (1, 0)))
    hashes = (words[:, ::2] << np.uint64(32) | words[:, 1::2]).T.copy()
    part, first = group.column("part").to_numpy(), group.column("one")[0].as_py()
    whole = first == group.column("two")[0].as_py()
    left = np.flatnonzero(part == first)
    right = left if whole else np.flatnonzero(part != first)
    step = max(1, min(STEP, STEP * TILE // max(1, len(right))))
    for k in range(0, len(left), step):
        own, others = left[k : k + step], right[k:] if whole else right
        dist = np.zeros((len(own), len(others)), np.uint8 if len(hashes) < 4 else np.uint16)
        for h in hashes:
            dist += np.bitwise_count(h[own][:, None] ^ h[others])
        i, j = np.divmod(np.flatnonzero(dist.ravel() <= max_bits), len(others))
        if whole:
            i, j = i[j > i], j[j > i]
        if len(i):
            yield own[i], others[j], dist[i, j]


def _pairs_met(max_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The near pairs of a group, a step at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        rep = group.column("rep").combine_chunks()
        for i, j, dist in _met(group, max_bits):
            a, b = rep.take(pa.array(i)), rep.take(pa.array(j))
            less = pc.less(a, b)
            yield pa.RecordBatch.from_arrays([pc.if_else(less, a, b), pc.if_else(less, b, a), pa.array(dist.astype(np.int64))], ["a", "b", "dist"])

    return run


def _links_met(max_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of the near pairs of a group those that join two of its components, so fewer than it has hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        rep, label = group.column("rep").combine_chunks(), np.arange(group.num_rows)
        for i, j, _ in _met(group, max_bits):
            while len(i := i[apart := label[i] != label[j]]):
                j = j[apart]
                # Each label goes under one lower one that it meets: no ring, and one component less for each link.
                high, at = np.unique(np.maximum(label[i], label[j]), return_index=True)
                yield pa.RecordBatch.from_arrays([rep.take(pa.array(i[at])), rep.take(pa.array(j[at]))], ["a", "b"])
                under = np.arange(len(label))
                under[high] = np.minimum(label[i], label[j])[at]
                while (further := under[under]).tolist() != under.tolist():
                    under = further
                label = under[label]

    return run


def _tiled(kinds: DataFrame, n: int, run: Callable, others: str) -> DataFrame:
    """What run finds between all n hashes, dealt to parts: each part and each two meet in a group of their own."""
    parts = max(1, min(PARTS, -(-n // TILE)))
    part = F.pmod(F.xxhash64("words"), F.lit(parts)).cast("int")
    dealt = kinds.filter(~F.exists("words", lambda w: w.isNull())).withColumns({"part": part, "other": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    groups = dealt.select(F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "part", "rep", "words")
    kind = kinds.schema["rep"].dataType.simpleString()
    return groups.repartition(min(2000, parts * (parts + 1)), "one", "two").groupBy("one", "two").applyInArrow(run, f"a {kind}, b {kind}{others}")


def hamming_pairs(members: DataFrame, total_bits: int, max_bits: int) -> DataFrame:
    """All pairs of distinct hashes of classes() that differ in at most max_bits bits: a < b, dist; equal ones are members.

    Parts of all hashes meet each other where that costs less (in_tiles). Else an index over several bands: the one side
    stands under its own bits of each, the other is looked up under every value within the band's radius. band_plan chooses
    the bands by the number of hashes. Each pair comes once.
    """
    kinds = _kinds(members)
    n = kinds.count()
    if in_tiles(total_bits, max_bits, n):
        return _tiled(kinds, n, _pairs_met(max_bits), ", dist long")
    plan = band_plan(total_bits, max_bits, n)
    met = _plain(kinds, plan).join(_probing(kinds, plan), "k")
    dist = _distance(total_bits).cast("long")
    return met.filter((F.col("a") < F.col("b")) & (dist <= max_bits) & (F.col("k.b") == _first_band(plan))).select("a", "b", dist.alias("dist"))


def hamming_links(members: DataFrame, total_bits: int, max_bits: int) -> DataFrame:
    """Links a, b between ids whose components are those of all pairs within max_bits bits, equal hashes included.

    In a group of thousands of near hashes not all pairs are made: those under one value of a band first meet the least
    of them, and only values under which several components are left have their other pairs compared, between components.
    Where all hashes meet part by part instead (in_tiles), two parts put out only what joins components of theirs.
    """
    kinds = _kinds(members)
    n = kinds.count()
    copies = members.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    if in_tiles(total_bits, max_bits, n):
        return _tiled(kinds, n, _links_met(max_bits), "").unionByName(copies)
    use_checkpoints(members.sparkSession)
    plan = band_plan(total_bits, max_bits, n)
    plain, probing = _plain(kinds, plan), _probing(kinds, plan)
    near = lambda met: met.filter((F.col("a") != F.col("b")) & (_distance(total_bits) <= max_bits))
    heads = plain.groupBy("k").agg(F.min_by(F.struct("a", "wa"), "a").alias("h")).select("k", "h.a", "h.wa")
    first = near(heads.join(probing, "k")).select("a", "b").distinct().checkpoint()
    labels = spread(first).withColumnRenamed("id_", "_id")
    of = lambda df, c: df.join(labels, df[c] == labels["_id"], "left").withColumn(f"c{c}", F.coalesce("label", c)).drop("_id", "label")
    plain, probing = of(plain, "a"), of(probing, "b")
    several = plain.select("k", F.col("ca").alias("c")).union(probing.select("k", "cb")).groupBy("k").agg(F.min("c").alias("least"), F.max("c").alias("most")).filter("least < most").select("k")
    left = plain.join(several, "k", "left_semi").join(probing, "k").filter("ca <> cb")
    return first.unionByName(near(left).select("a", "b").distinct()).unionByName(copies)


def _counts(members: DataFrame, splits: DataFrame) -> DataFrame:
    """For each hash and split: how many items, and the two least ids."""
    rows = members.select("id", "rep").join(splits, "id")
    place = F.row_number().over(Window.partitionBy("rep", "split").orderBy("id"))
    low = rows.withColumn("k", place).filter("k <= 2").groupBy("rep", "split").agg(F.min("id").alias("first"), F.max(F.when(F.col("k") == 2, F.col("id"))).alias("second"))
    return rows.groupBy("rep", "split").agg(F.count("*").alias("n")).join(low, ["rep", "split"])


def cross_split_pairs(members: DataFrame, pairs: DataFrame, splits: DataFrame) -> DataFrame:
    """How many near pairs, equal hashes included, have their ends in two splits. Counted by hash and split; no pair of items is made."""
    n = _counts(members, splits).select("rep", "split", "n")
    of = lambda c: n.select(F.col("rep").alias(c), F.col("split").alias(f"split_{c}"), F.col("n").alias(f"n_{c}"))
    across = pairs.join(of("a"), "a").join(of("b"), "b").filter("split_a <> split_b")
    same = of("a").join(of("b"), (F.col("a") == F.col("b")) & (F.col("split_a") < F.col("split_b")))
    both = across.select("split_a", "split_b", "n_a", "n_b").unionByName(same.select("split_a", "split_b", "n_a", "n_b"))
    return both.groupBy(F.least("split_a", "split_b").alias("one"), F.greatest("split_a", "split_b").alias("other")).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("pairs"))


def leakage(members: DataFrame, pairs: DataFrame, splits: DataFrame) -> DataFrame:
    """What each item's nearest twin within the pairs' distance says: seven counts in one row.

    Items; those with a twin; those with several nearest twins; those whose first nearest twin is in another split; the
    least and the most that this count could be with another choice among equals; those with any twin in another split.
    Twins are counted by hash and split, so copies in thousands are a row for each split.
    """
    n = _counts(members, splits)
    end = lambda a, b: F.struct(F.col(a).alias("rep"), F.col(b).alias("twin"), "dist")
    ends = pairs.select(F.inline(F.array(end("a", "b"), end("b", "a"))))
    own = n.select("rep", "split")
    seen = own.join(ends, "rep").join(n.select(F.col("rep").alias("twin"), F.col("split").alias("of"), F.col("n").alias("m"), "first"), "twin")
    seen = seen.withColumn("other", F.col("split") != F.col("of"))
    near = seen.groupBy("rep", "split", "dist").agg(F.sum("m").alias("twins"), F.bool_or("other").alias("some"), F.bool_and("other").alias("every"), F.min_by("other", "first").alias("lead"))
    near = near.groupBy("rep", "split").agg(F.min_by(F.struct("twins", "some", "every", "lead"), "dist").alias("n"), F.bool_or("some").alias("any"))
    total = n.groupBy("rep").agg(F.sum("n").alias("total"))
    rest = n.select("rep", F.col("split").alias("of"), F.col("first").alias("f")).join(own, "rep").filter("of <> split").groupBy("rep", "split").agg(F.min("f").alias("lead_other"))
    rows = members.select("id", "rep").join(splits, "id").join(n, ["rep", "split"]).join(total, "rep").join(rest, ["rep", "split"], "left").join(near.withColumnsRenamed({"n": "near"}), ["rep", "split"], "left")
    copies, strange = F.col("total") > 1, F.col("lead_other").isNotNull()
    mine = F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    here = F.struct(
        (F.col("total") - 1).alias("twins"), strange.alias("some"), (strange & (F.col("n") == 1)).alias("every"),
        (strange & (mine.isNull() | (F.col("lead_other") < mine))).alias("lead"),
    )
    rows = rows.select(F.when(copies, here).otherwise(F.col("near")).alias("x"), (F.coalesce("any", F.lit(False)) | (copies & strange)).alias("any"))
    return rows.agg(
        F.count("*").alias("items"), F.count("x").alias("with_twin"), F.count_if(F.col("x.twins") > 1).alias("tied"), F.count_if("x.lead").alias("nearest_other"),
        F.count_if("x.every").alias("nearest_other_min"), F.count_if("x.some").alias("nearest_other_max"), F.count_if("any").alias("any_other"),
    )
