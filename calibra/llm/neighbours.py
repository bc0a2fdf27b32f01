"""Approximate nearest neighbours by learned partitions.

On a bounded sample, a graph joins each vector to its nearest; the graph is cut into parts of equal size with few
edges across; and a small classifier learns the parts of a vector's neighbours. Every vector is then indexed under its
most probable part, and a query searches its most probable parts, as many as the sample needs for the wanted recall.
Candidates are reranked by the exact measure, the inner product in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibra.llm.common import saved, table

#: The sample has at most SAMPLE_PER_PART vectors for each part, and there are at most MOST_PARTS: 32,768 vectors.
MOST_PARTS, SAMPLE_PER_PART = 256, 128
GRAPH, CAPACITY, PASSES = 12, 1.1, 12
HIDDEN, STEPS, BATCH, RATE = 128, 1500, 256, 3e-3
#: Recall on the sample that sets how many parts a query searches.
WANTED = 0.95
#: Vectors in a block of candidates, and queries in a block: what one task compares at a time.
BLOCK = 4096


def part_count(n: int) -> int:
    """A power of two near a quarter of the square root of n."""
    return int(2 ** np.clip(np.round(np.log2(max(n, 1) ** 0.5 / 4)), 1, np.log2(MOST_PARTS)))


def nearest_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's k others of largest inner product, in blocks of rows."""
    out = np.empty((len(x), k), np.int32)
    for at in range(0, len(x), 1024):
        near = x[at : at + 1024] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out[at : at + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """Halves along the main direction again and again, then moves vectors to their neighbours' parts while these have room."""
    label = np.zeros(len(x), np.int64)
    for _ in range(parts.bit_length() - 1):
        fresh = np.empty_like(label)
        for p in np.unique(label):
            own = np.flatnonzero(label == p)
            centred = x[own] - x[own].mean(axis=0)
            main = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            order = own[np.argsort(centred @ main, kind="stable")]
            fresh[order[: len(order) // 2]], fresh[order[len(order) // 2 :]] = 2 * p, 2 * p + 1
        label = fresh
    room, rng = int(np.ceil(CAPACITY * len(x) / parts)), np.random.default_rng(seed)
    back = [[] for _ in range(len(x))]
    for i, row in enumerate(graph):
        for j in row:
            back[j].append(i)
    links = [np.concatenate([row, np.array(b, np.int32)]) for row, b in zip(graph, back, strict=True)]
    size = np.bincount(label, minlength=parts)
    for _ in range(PASSES):
        moved = 0
        for i in rng.permutation(len(x)):
            votes = np.bincount(label[links[i]], minlength=parts)
            here = label[i]
            votes[(size >= room) & (np.arange(parts) != here)] = -1
            best = int(votes.argmax())
            if votes[best] > votes[here]:
                size[here] -= 1
                size[best] += 1
                label[i] = best
                moved += 1
        if moved < len(x) // 200:
            break
    return label


@dataclass
class Router:
    """A classifier with one hidden layer over unit vectors, and how many parts a query searches."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def scores(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return np.maximum(unit @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def parts(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, :n]


def train_router(x: np.ndarray, wanted: np.ndarray, seed: int) -> Router:
    """Softmax regression on shares of parts, by Adam."""
    rng = np.random.default_rng(seed)
    d, parts = x.shape[1], wanted.shape[1]
    r = Router(rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts))
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    weights = [r.w1, r.b1, r.w2, r.b2]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for t in range(1, STEPS + 1):
        at = rng.integers(0, len(x), min(BATCH, len(x)))
        a, y = unit[at], wanted[at]
        h = np.maximum(a @ r.w1 + r.b1, 0)
        z = h @ r.w2 + r.b2
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p = (p / p.sum(axis=1, keepdims=True) - y) / len(at)
        dh = (p @ r.w2.T) * (h > 0)
        for w, g, m, s in zip(weights, (a.T @ dh, dh.sum(axis=0), h.T @ p, p.sum(axis=0)), mean, square, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            w -= RATE * (1 - t / STEPS * 0.9) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
    return r


def learn_router(x: np.ndarray, parts: int, k: int, seed: int = 6) -> Router:
    """The router of a sample, and the least number of parts with which the sample's own k nearest are found."""
    d = x.shape[1]
    if len(x) < 4 * parts or parts < 2:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = nearest_graph(x, min(GRAPH, len(x) - 1))
    label = balanced_parts(x, graph, parts, seed)
    wanted = np.zeros((len(x), parts))
    np.add.at(wanted, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1 / (graph.shape[1] + 1))
    wanted[np.arange(len(x)), label] += 1 / (graph.shape[1] + 1)
    router = train_router(x, wanted, seed)
    some = np.random.default_rng(seed).permutation(len(x))[:1000]
    home = router.parts(x, 1)[:, 0]
    near = x[some] @ x.T
    near[np.arange(len(some)), some] = -np.inf
    k = min(k, len(x) - 1)
    true = np.argpartition(-near, k - 1, axis=1)[:, :k]
    place = np.argsort(router.parts(x[some], parts), axis=1)  # of each part in a query's order
    found = np.take_along_axis(place, home[true], axis=1)
    recall = [(found < m).mean() for m in range(1, parts + 1)]
    router.probes = 1 + int(np.argmax(np.array(recall) >= WANTED))
    return router


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows with an id and a finite vector that is not zero, of the most frequent length (the least of equals)."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(fine)
    first = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size(v) == (first["n"] if first else 0))


def _vectors(batch: pa.RecordBatch | pa.Table, column: str) -> np.ndarray:
    c = batch.column(column)
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def _route(router: Router, probes: int, schema: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = router.parts(_vectors(batch, "vector"), probes)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts.astype(np.int32).tolist(), pa.list_(pa.int32()))], [*schema, "parts"])

    return run


FOUND = "query long, vec_id long, score double"


def _compare(keep: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Each query's best `keep` ids among a block's vectors; equal scores by id."""

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if candidates.num_rows and queries.num_rows:
            x, q = _vectors(candidates, "vector"), _vectors(queries, "vector")
            ids = candidates.column("ids").combine_chunks()
            flat, begin = ids.flatten().to_numpy(), ids.offsets.to_numpy() - ids.offsets[0].as_py()
            slack = 1e-9 * (np.abs(x).max() * np.abs(q).max() * x.shape[1] + 1e-300)
            k = min(keep, len(x))
            for at in range(0, len(q), 256):
                rough = q[at : at + 256] @ x.T
                least = np.partition(rough, len(x) - k, axis=1)[:, len(x) - k] - slack
                for i, row in enumerate(rough):
                    some = np.flatnonzero(row >= least[i])
                    exact = (x[some] * q[at + i]).sum(axis=1)
                    n = begin[some + 1] - begin[some]
                    v = np.concatenate([flat[begin[s] : begin[s + 1]] for s in some])
                    s = np.repeat(exact, n)
                    best = np.lexsort((v, -s))[:keep]
                    out_q.append(np.full(len(best), queries.column("query")[at + i].as_py()))
                    out_v.append(v[best])
                    out_s.append(s[best])
        join = lambda parts, kind: np.concatenate([*parts, np.empty(0, kind)]).astype(kind)
        return pa.table({"query": join(out_q, np.int64), "vec_id": join(out_v, np.int64), "score": join(out_s, float)})

    return run


def search(rows: DataFrame, is_query, k: int, vector: str = "embedding") -> DataFrame:
    """The k nearest of every query row: query_id, rank, vec_id, score; ties go to the smaller vec_id.

    rows has vec_id and the vector; is_query is a condition on vec_id. Rows that usable() drops take no part. A vec_id
    that is repeated with one vector counts once; other columns are ignored; no usable rows give no result; a query
    with fewer candidates gets them all.

    Equal vectors are indexed once with their k + 1 least ids, since no query can have more of them in its result, and
    equal queries are searched once, so a vector that a third of all rows share costs what any other does. A part's
    candidates and queries are dealt to blocks of BLOCK, so no part is one task.
    """
    keep = k + 1
    rows = usable(rows.select("vec_id", F.col(vector).cast("array<double>").alias("vector")), "vector")
    first = F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))
    distinct = rows.withColumn("_n", first).filter(F.col("_n") <= keep).groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    distinct = saved(distinct.withColumn("rep", F.col("ids")[0]), "ann-vectors")
    asked = saved(rows.filter(is_query).groupBy("vector").agg(F.min("vec_id").alias("query")), "ann-queries")
    n = distinct.count()
    parts = part_count(n)
    sample = distinct.orderBy(F.xxhash64("rep"), "rep").select("vector").limit(parts * SAMPLE_PER_PART)
    x = np.array([r["vector"] for r in sample.collect()], float)
    router = learn_router(x, parts, k) if len(x) else None
    if router is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    schema = "vector array<double>, ids array<long>, rep long, parts array<int>"
    index = saved(distinct.mapInArrow(_route(router, 1, ["vector", "ids", "rep"]), schema).withColumn("part", F.col("parts")[0]).drop("parts"), "ann-index")
    routed = asked.mapInArrow(_route(router, router.probes, ["vector", "query"]), "vector array<double>, query long, parts array<int>")
    routed = saved(routed.withColumn("part", F.explode("parts")).drop("parts"), "ann-routed")
    # One row for each part, at most MOST_PARTS.
    blocks = lambda df, name: df.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = F.broadcast(blocks(index, "cbs").join(blocks(routed, "qbs"), "part"))
    left = index.join(sizes, "part").select("part", F.pmod(F.xxhash64("rep"), F.col("cbs")).cast("int").alias("cb"), F.explode(F.sequence(F.lit(0), F.col("qbs") - 1)).alias("qb"), "ids", "vector")
    right = routed.join(sizes, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("cbs") - 1)).alias("cb"), F.pmod(F.xxhash64("query"), F.col("qbs")).cast("int").alias("qb"), "query", "vector")
    found = left.groupBy("part", "cb", "qb").cogroup(right.groupBy("part", "cb", "qb")).applyInArrow(_compare(keep), FOUND)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= keep).drop("_n")
    every = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "vector").distinct().join(asked, "vector").select("query_id", "query")
    out = every.join(found, "query").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
