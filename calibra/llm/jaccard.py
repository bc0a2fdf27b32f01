"""N-gram Jaccard join with grouped prefixes.

Shingles have one order for the whole corpus: those that many documents share come last. Two sets that link have a
shingle in common among the first of each, their prefixes. Equal sets are one class; classes with the same prefix
and size are one group, and only groups are listed under their shingles.

A list of many groups is not all compared. Each has a pivot, its least group. First every group meets the least pivot of
all its lists; what links is joined into components. In lists that still hold several components, groups meet the list's
pivot; and where several are left even so, those outside the pivot's are compared with the list. So near copies, however
many, cost a comparison each, and no link is lost.

Where very many share a pivot, those outside are not compared with the whole list either: each member is replaced by its
differences from the pivot, and the differences are joined by their own prefixes. Two members differ by the differences
that they do not share, so one outside must share many with whatever it links with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm.common import forget, saved, small_batches, table, text_bytes, texts
from calibra.llm.components import connected_components, joined_components
from calibra.llm.shingles import set_key, shingle_set, shingle_sets

#: A shingle in so many documents is common; at most COMMON_BITS / 8 shingles, the most frequent, count as common.
COMMON_DF, COMMON_BITS = 32, 1 << 25
#: The share of all hashes that is counted: prefixes are the least hashes, and end below it unless most of a text is common.
COUNTED = 0.36
#: Bits of every set's parities, and more for sets over so many shingles.
PARITY_BITS, WIDE_BITS, WIDE_FROM = 1 << 10, 1 << 14, 1500
#: With more members, a pivot's are compared by their differences from it.
DENSE, LATE = 200, 1000
SHARD_BYTES, LEAST_SHARDS, HELD = 24 << 20, 64, 2 << 20


def _tally(size: int, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    edges = np.array([int(COUNTED * 2**48 * k / shards) for k in range(1, shards)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def sent() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            cut = np.concatenate([[0], np.searchsorted(found, edges), [len(found)]])
            raw = found.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            counts = counts.astype("<u4")
            rows = [(k, raw[a:b].tobytes(), counts[a:b].tobytes()) for k, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "hashes", "n"])

        for batch in small_batches(batches, "text", 1 << 20):
            for s in shingle_sets(texts(batch), size):
                h = s >> np.uint64(16)
                held.append(h[h < np.uint64(int(COUNTED * 2**48))])
                n += len(held[-1])
            if n > HELD:
                yield sent()
                held, n = [], 0
        if n:
            yield sent()

    return run


def _common(group: pa.Table) -> pa.Table:
    """A shard's common shingles by the logarithm of their counts, as places in the bit table."""
    raw = b"".join(group.column("hashes").to_pylist())
    h = np.zeros((len(raw) // 6, 8), np.uint8)
    h[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    found, at = np.unique(h.view("<u8").ravel(), return_inverse=True)
    n = np.bincount(at, np.frombuffer(b"".join(group.column("n").to_pylist()), "<u4")).astype(np.int64)
    keep = n >= COMMON_DF
    place, level = (found[keep] % np.uint64(COMMON_BITS)).astype("<u4"), np.log2(n[keep]).astype(int)
    rows = [(int(v), int((level == v).sum()), place[level == v].tobytes()) for v in np.unique(level)]
    return pa.table({"level": pa.array([r[0] for r in rows], pa.int32()), "n": pa.array([r[1] for r in rows], pa.int64()), "places": pa.array([r[2] for r in rows], pa.binary())})


def common_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """A bit for each place of the hash table that a common shingle falls on: COMMON_BITS bits, whatever the corpus.

    Every document is counted. The table orders shingles and decides no link: two shingles that share a place are
    ordered alike, and a common one that is missed costs time only.
    """
    shards = max(LEAST_SHARDS, -(-text_bytes(docs) // SHARD_BYTES))
    counts = docs.select("text").mapInArrow(_tally(size, shards), "shard int, hashes binary, n binary")
    found = saved(counts.groupBy("shard").applyInArrow(lambda t: _common(t), "level int, n long, places binary"), "common")
    levels = {r["level"]: r["n"] for r in found.groupBy("level").agg(F.sum("n").alias("n")).collect()}
    least = min(levels, default=0)
    while sum(n for v, n in levels.items() if v >= least) > COMMON_BITS // 8:
        least += 1
    bits = np.zeros(COMMON_BITS, bool)
    for r in found.filter(F.col("level") >= least).select("places").toLocalIterator():
        bits[np.frombuffer(r["places"], "<u4")] = True
    return np.packbits(bits, bitorder="little")


def ordered(s: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int]:
    """A sorted set in the corpus's order, rare shingles by hash, then common ones by hash; and how many counted ones are rare."""
    place = (s >> np.uint64(16)) % np.uint64(COMMON_BITS)
    low = s < np.uint64(int(COUNTED * 2**48) << 16)
    is_common = ((common[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool) & low
    return np.concatenate([s[~is_common], s[is_common]]), int((low & ~is_common).sum())


def prefix_length(n: int, percent: int) -> int:
    """How many first shingles two linking sets cannot both miss: all but ceil(n * percent / 100) - 1."""
    return n - -(-n * percent // 100) + 1


def parity(s: np.ndarray, bits: int) -> np.ndarray:
    """Whether each of `bits` buckets of hashes holds an odd number of a set's: differing bits are so many differences at least."""
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.int64)


def may_link(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) without those whose sizes or parities show that they differ too much; no link is lost.

    Two sets have the similarity p / 100 just if (100 + p) times their differences are at most (100 - p) times their sizes.
    """
    of = lambda name: sketches.select(F.col("cid").alias(name), F.col("n").alias(f"n_{name}"), F.col("parity").alias(f"p_{name}"), F.col("wide").alias(f"w_{name}"))
    bits = lambda c: F.aggregate(F.zip_with(f"{c}_a", f"{c}_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, m: n + m)
    apart = F.when((F.size("w_a") > 0) & (F.size("w_b") > 0), bits("w")).otherwise(bits("p"))
    apart = F.greatest(apart, F.abs(F.col("n_a") - F.col("n_b")))
    return pairs.join(of("a"), "a").join(of("b"), "b").filter((100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).select("a", "b").distinct()


SIGNATURE = "doc_id long, n long, k1 long, k2 long, g1 long, g2 long, rare long, parity array<long>, wide array<long>, prefix array<long>"


def _sign(size: int, percent: int, common) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            out = []
            for doc_id, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(texts(batch), size), strict=True):
                first, rare = ordered(s, common.value)
                first = first[: prefix_length(len(s), percent)] if len(s) else s
                wide = parity(s, WIDE_BITS) if len(s) > WIDE_FROM else s[:0].view(np.int64)
                out.append((doc_id, len(s), *set_key(s), *set_key(first), rare, parity(s, PARITY_BITS), wide, first.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in SIGNATURE.split(", ")])

    return run


def differences(s: np.ndarray, p: np.ndarray, outside: bool, percent: int, common: np.ndarray, late: np.ndarray) -> tuple[int, np.ndarray]:
    """How many shingles two sets differ by, and the first of these: s's own in the corpus's order, p's by hash, `late` ones.

    A link (s, t) allows d = (100 - percent) / (100 + percent) * (|s| + |t|) differences, so s and t must have at least
    (|s ^ p| + |t ^ p| - d) / 2 of their differences from p in common. The prefix is what can hold the first common one,
    for every size that t may have; if s is not outside, t is, and so differs from p by more than a link allows.
    """
    own, lost = ordered(np.setdiff1d(s, p, assume_unique=True), common)[0], np.setdiff1d(p, s, assume_unique=True)
    n, whole = len(own) + len(lost), np.concatenate([own, lost])
    last = np.isin(whole, late)
    most = len(s) * (100 - percent) / percent
    length = most
    if not outside:
        least = (100 - percent) / (100 + percent) * (len(s) * percent / 100 + len(p))
        length = min(most, max(0, n + most - least) / 2)
    return n, np.concatenate([whole[~last], np.sort(whole[last])])[: int(length + 1e-6) + 1]


def _differ(size: int, percent: int, common) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, np.ndarray] = ("", shingle_set("", size))
        for whole in batches:
            for batch in small_batches([whole], "text", 2 << 20):
                out = []
                for text, other, outside, late in zip(texts(batch), texts(batch, "pivot_text"), batch.column("outside").to_pylist(), batch.column("late").to_pylist(), strict=True):
                    if held[0] != other:
                        held = other, shingle_set(other, size)
                    n, first = differences(shingle_set(text, size), held[1], outside, percent, common.value, np.array(late or [], np.int64).view(np.uint64))
                    out.append((n, first.view(np.int64)))
                more = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.list_(pa.int64())), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("pivot", "cid", "component", "n", "outside")), *more], ["pivot", "cid", "component", "n", "outside", "apart", "first"])

    return run


def pairs_by_differences(members: DataFrame, known: DataFrame, size: int, percent: int, common) -> DataFrame:
    """Pairs(a, b) of members(pivot, head, cid, component, n, outside) that may link, one of them outside its pivot's component. known has their texts."""
    whole = members.join(known.select(F.col("doc_id").alias("cid"), "text"), "cid").join(known.select(F.col("doc_id").alias("head"), F.col("text").alias("pivot_text")), "head")
    schema = "pivot long, cid long, component long, n long, outside boolean, apart long, first array<long>"
    differ = lambda late: whole.join(late, "pivot", "left").select("pivot", "cid", "component", "n", "outside", "text", "pivot_text", "late").mapInArrow(_differ(size, percent, common), schema)
    # A difference that many of a pivot's members have, as where the pivot is itself an edited copy, comes last.
    # This orders differences and decides no link, so the most frequent LATE of them do.
    sizes = members.groupBy("pivot").agg(F.count("*").alias("size"))
    counts = differ(sizes.select("pivot", F.array().cast("array<long>").alias("late"))).select("pivot", F.explode("first").alias("s")).groupBy("pivot", "s").agg(F.count("*").alias("held"))
    many = saved(counts.join(sizes, "pivot").filter("held * 16 > size").select("pivot", "held", "s"), "frequent")
    late = many.groupBy("pivot").agg(F.slice(F.sort_array(F.collect_list(F.struct("held", "s")), False), 1, LATE)["s"].alias("late"))
    found = saved(differ(late), "differences")
    listed = found.select(*found.columns[:-1], F.posexplode("first").alias("pos", "s"))
    side = lambda e: listed.select("pivot", "s", *[F.col(c).alias(f"{c}_{e}") for c in ("cid", "component", "n", "outside", "apart", "pos")])
    left = side("a").filter("outside_a")
    enough = f"{100 + percent} * (apart_a + apart_b - 2 * least(apart_a - pos_a, apart_b - pos_b)) <= {100 - percent} * (n_a + n_b)"
    fits = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    pairs = left.join(side("b"), ["pivot", "s"]).filter(f"component_a <> component_b and {fits} and {enough}")
    return pairs.select(F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b")).distinct()


def _verify(size: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, np.ndarray] = {}

        def of(text: str) -> np.ndarray:
            if text not in sets:
                if len(sets) >= 64:
                    sets.clear()
                sets[text] = shingle_set(text, size)
            return sets[text]

        for whole in batches:
            for batch in small_batches([whole], "text_a", 2 << 20):
                keep = []
                for x, y in zip(texts(batch, "text_a"), texts(batch, "text_b"), strict=True):
                    a, b = of(x), of(y)
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(100 * both >= percent * (len(a) + len(b) - both))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, known: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of pairs(a, b) whose texts, in known(doc_id, text), link."""
    joined = pairs.join(known.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(known.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return saved(joined.select("a", "b", "text_a", "text_b").mapInArrow(_verify(size, percent), "a long, b long").distinct(), "links")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs(doc_id, text).

    Documents link when their sets of `size`-word shingles have a Jaccard similarity of percent / 100 or more; the
    component is the least doc_id reachable. A text without words, or null, has no shingles and links with nothing.
    Repeated rows stay, and rows that share a doc_id link as one; a null doc_id gets the component of an equal text, or
    null. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, size))
    signed = saved(docs.mapInArrow(_sign(size, percent, common), SIGNATURE), "signatures")
    members = signed.filter("n > 0 and doc_id is not null")
    classes = members.groupBy("k1", "k2").agg(F.min("doc_id").alias("cid"))
    # A class's row is its least doc_id's; of repeated rows any will do, as they are equal.
    reps = members.join(classes, ["k1", "k2"]).filter("doc_id = cid").select("cid", "n", "g1", "g2", "rare", "parity", "wide").distinct()
    reps = saved(reps, "classes")
    # A group's id puts the groups with the fewest rare shingles first: a list's least group is the text that the most
    # others of the list are copies of.
    groups = reps.groupBy("g1", "g2", "n").agg(F.min("cid").alias("head"), F.min("rare").alias("rare"))
    place = F.shiftleft(F.least(F.col("rare"), F.lit(0xFFFF)), 47).bitwiseOR(F.shiftrightunsigned(F.xxhash64("head", "n"), 17))
    grouped = saved(reps.join(groups.select("g1", "g2", "n", "head", place.alias("gid")), ["g1", "g2", "n"]).select("cid", "gid", "head", "n"), "groups")
    heads = grouped.filter("cid = head").select("gid", "head", "n").distinct()

    # Repeated rows of a head would list it twice; distinct pairs below make up for it.
    listed = members.join(heads.select("gid", F.col("head").alias("doc_id"), "n"), ["doc_id", "n"]).select("gid", F.posexplode("prefix").alias("pos", "s"))
    lists = listed.groupBy("s").agg(F.min("gid").alias("pivot"), F.max("gid").alias("last")).filter("pivot < last").select("s", "pivot")
    shared = saved(listed.join(lists, "s"), "lists")
    # Texts of all classes that a list or a group of several holds, once.
    several = shared.select("gid").union(grouped.filter("cid <> head").select("gid")).distinct()
    ids = grouped.join(several, "gid", "left_semi").select(F.col("cid").alias("doc_id")).distinct()
    known = saved(docs.join(ids, "doc_id", "left_semi").distinct(), "class-texts")
    of = lambda name: heads.select(F.col("gid").alias(name), F.col("head").alias(f"head_{name}"), F.col("n").alias(f"n_{name}"))
    fits = f"100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y)"

    def meetings(star: DataFrame) -> DataFrame:
        """Classes of groups x and heads of groups y of star(x, y), as a and b."""
        sized = star.join(of("x"), "x").join(of("y"), "y").filter(fits)
        return sized.join(grouped.select("cid", F.col("gid").alias("x")), "x").select(F.col("cid").alias("a"), F.col("head_y").alias("b"))

    def spans_of(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Each class's component so far; and the least and greatest of each group."""
        now = saved(grouped.join(labels, F.col("cid") == F.col("id"), "left").select("cid", "gid", "n", F.coalesce("component", "cid").alias("component")), "components")
        return now, saved(now.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("n")), "spans")

    def open_lists(spans: DataFrame) -> DataFrame:
        """The rows of lists that hold several components, each with its group's and its pivot's span."""
        rows = shared.join(spans.select("gid", "low", "high"), "gid")
        ends = rows.groupBy("s").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.min(F.struct("gid", "low", "high")).alias("p"))
        ends = ends.filter("least < most").select("s", F.col("p.low").alias("low_p"), F.col("p.high").alias("high_p"))
        return rows.join(ends, "s")

    first = shared.filter("gid <> pivot").groupBy(F.col("gid").alias("x")).agg(F.min("pivot").alias("y"))
    within = grouped.filter("cid <> head").select(F.col("cid").alias("a"), F.col("head").alias("b"))
    links = verified(saved(may_link(meetings(first).union(within), reps, percent), "met"), known, size, percent)
    labels = connected_components(links)
    now, spans = spans_of(labels)
    unlike = "gid <> pivot and not (low = high and low_p = high_p and low = low_p)"
    star = saved(open_lists(spans).filter(unlike).select(F.col("gid").alias("x"), F.col("pivot").alias("y")).distinct(), "stars")
    met = saved(may_link(meetings(star).join(links, ["a", "b"], "left_anti"), reps, percent), "met")
    labels = joined_components(labels, verified(met, known, size, percent))

    # A list is done if all its groups are in one component.
    now, spans = spans_of(labels)
    left = saved(open_lists(spans), "open")
    star = saved(left.filter("gid <> pivot").select("gid", "pivot").distinct(), "stars")
    member = star.join(grouped.select("cid", "gid"), "gid").select("pivot", "cid").union(grouped.filter("cid <> head").select(F.col("gid").alias("pivot"), "cid"))
    dense = saved(member.groupBy("pivot").count().filter(F.col("count") > DENSE).select("pivot"), "dense")
    at = now.select("cid", "component", "n")
    led = heads.select(F.col("gid").alias("pivot"), "head").join(dense, "pivot").join(now.select(F.col("cid").alias("head"), F.col("component").alias("led")), "head")
    crowd = saved(member.join(led, "pivot").join(at, "cid").select("pivot", "head", "cid", "component", "n", (F.col("component") != F.col("led")).alias("outside")), "crowd")
    crowd = crowd.join(crowd.filter("outside").select("pivot").distinct(), "pivot", "left_semi")
    by_difference = pairs_by_differences(crowd, known, size, percent, common)

    # Lists of fewer members are compared as they are.
    sparse = left.join(dense, "pivot", "left_anti").join(spans.select("gid", "n"), "gid").select("s", "gid", "pivot", "pos", "low", "high", "n", F.expr(unlike).alias("outside"))
    side = lambda e: sparse.select("s", *[F.col(c).alias(f"{c}_{e}") for c in ("pos", "low", "high", "n")], F.col("gid").alias(e), F.col("outside").alias(f"outside_{e}"))
    apart = "not (low_x = high_x and low_y = high_y and low_x = low_y)"
    # Where a pair's first shared shingle stands, enough must be left of both for the similarity.
    enough = f"{100 + percent} * least(n_x - pos_x, n_y - pos_y) >= {percent} * (n_x + n_y)"
    cross = side("x").filter("outside_x").join(side("y"), "s").filter(f"x <> y and {apart} and {fits} and {enough}").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    torn = spans.filter("low < high").join(dense.withColumnRenamed("pivot", "gid"), "gid", "left_anti").select(F.col("gid").alias("x"), F.col("gid").alias("y"))
    each = lambda end, name: now.select(F.col("gid").alias(end), F.col("cid").alias(name), F.col("component").alias(f"of_{name}"))
    more = cross.union(torn).join(each("x", "a"), "x").join(each("y", "b"), "y").filter("of_a <> of_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = saved(may_link(more.union(by_difference).distinct(), reps, percent), "more")
    final = joined_components(labels, verified(more, known, size, percent))
    forget(known, shared)
    out = signed.select("doc_id", "n", "k1", "k2").join(classes, ["k1", "k2"], "left").join(final.withColumnRenamed("id", "cid"), "cid", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "cid")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op4_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 4, 85)
