"""Vector codes: each part of a vector is the number of its nearest entry in that part's codebook.

All distances are of integers, and exact. A search starts at the entry that a part had before and looks through that
entry's neighbours, nearest first, no further than twice the part's own distance: an entry that is at most as far from
the part is within that radius, by the triangle inequality. Equal distances go to the lower entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm.common import forget, saved, table
from calibra.llm.vectors import matrix, scaled_rows

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Labels up to which their sums are sent to all tasks; beyond, rows and sums meet by label.
MOST_LABELS = 100_000

Books = list[np.ndarray]
Batches = Iterator[pa.RecordBatch]


def part_edges(dimension: int) -> list[int]:
    return [i * dimension // PARTS for i in range(PARTS + 1)]


def nearest_entries(x: np.ndarray, book: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry and its squared distance, found from the entry it had before."""
    between = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(between, axis=1, kind="stable")
    between = np.take_along_axis(between, order, axis=1)
    distance = ((x - book[before]) ** 2).sum(axis=1)
    entry = before.astype(np.int64)
    for a in np.unique(before):
        own = np.flatnonzero(before == a)
        within = np.searchsorted(between[a], 4 * distance[own], side="right")
        own, within = own[np.argsort(-within, kind="stable")], np.sort(within)
        for t in range(within[-1]):
            c = order[a, t]
            if c == a:
                continue
            rows = own[: len(own) - np.searchsorted(within, t, side="right")]
            d = ((x[rows] - book[c]) ** 2).sum(axis=1)
            closer = (d < distance[rows]) | ((d == distance[rows]) & (c < entry[rows]))
            distance[rows[closer]], entry[rows[closer]] = d[closer], c
    return entry, distance


def assign(x: np.ndarray, books: Books, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of all parts of each row, and the squared distances summed over parts."""
    reach = max([int(np.abs(x).max(initial=0)), *(int(np.abs(b).max(initial=0)) for b in books)])
    if 16 * (reach + 1) ** 2 * x.shape[1] >= 2**63:
        raise OverflowError("squared distances do not fit in 64 bits")
    edges, codes, error = part_edges(x.shape[1]), np.empty((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
    for p in range(PARTS):
        codes[:, p], d = nearest_entries(x[:, edges[p] : edges[p + 1]], books[p], before[:, p])
        error += d
    return codes, error


#: Rows of vectors, and beside them rows that hold a task's sums of the parts dealt to an entry.
STATE = "vec_id long, label string, x array<long>, code binary, part int, entry int, count long, sums array<long>"
_STATE_TYPES = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
_STATE_NAMES = [f.split()[0] for f in STATE.split(", ")]


def _before(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, PARTS)


def _round(books: Books) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = matrix(part)
                edges = part_edges(x.shape[1])
                codes, _ = assign(x, books, _before(part))
                for p, own in enumerate(sums):
                    np.add.at(own[:, 0], codes[:, p], 1)
                    np.add.at(own[:, 1:], codes[:, p], x[:, edges[p] : edges[p + 1]])
                none = [pa.nulls(part.num_rows, t) for t in _STATE_TYPES[4:]]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), part.column("x"), pa.array([c.tobytes() for c in codes], pa.binary()), *none], _STATE_NAMES)
        rows = [(p, e, int(own[e, 0]), own[e, 1:].tolist()) for p, own in enumerate(sums) for e in range(len(own)) if own[e, 0]]
        if rows:
            none = [pa.nulls(len(rows), t) for t in _STATE_TYPES[:4]]
            yield pa.RecordBatch.from_arrays([*none, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _STATE_TYPES[4:], strict=True))], _STATE_NAMES)

    return run


def moved_entries(books: Books, state: DataFrame) -> Books:
    """Each entry's parts' componentwise floor(sum / count); unused entries stay."""
    width = max(b.shape[1] for b in books)
    total = state.filter("part is not null").groupBy("part", "entry").agg(F.sum("count").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("s"))
    books = [b.copy() for b in books]
    for r in total.collect():  # PARTS * ENTRIES rows at most
        book = books[r["part"]]
        book[r["entry"]] = [s // r["n"] for s in r["s"][: book.shape[1]]]
    return books


def train(rows: DataFrame, rounds: int) -> tuple[Books, DataFrame | None]:
    """Codebooks after the rounds, and the rows (vec_id, label, x) with the codes that they had in the last one, a saved table.

    The codebooks start as the parts of the ENTRIES smallest vec_ids; of equal ones by vector, null ones last.
    """
    first = [r["x"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).select("x").collect()]
    if not first or not first[0]:
        return [], None
    edges = part_edges(len(first[0]))
    books = [np.array([x[a:b] for x in first], np.int64).reshape(len(first), b - a) for a, b in zip(edges, edges[1:], strict=False)]
    state = saved(rows.select("vec_id", "label", "x", F.lit(bytes(PARTS)).alias("code"), *(F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in STATE.split(", ")[4:])), "codes")
    for _ in range(rounds):
        step = saved(state.filter("part is null").mapInArrow(_round(books), STATE), "codes")
        forget(state)
        state, books = step, moved_entries(books, step)
    return books, state


def _code(books: Books) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                codes, error = assign(matrix(batch), books, _before(batch))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def decode(codes: list[str], books: Books) -> np.ndarray:
    """The vectors that codes stand for, in scaled integers."""
    return np.array([np.concatenate([books[p][e] for p, e in enumerate(bytes.fromhex(c))]) for c in codes])


def printed(books: Books) -> str:
    return ",".join(str(v) for book in books for v in book.ravel().tolist())


def compress(rows: DataFrame, vector: str = "embedding", rounds: int = ROUNDS) -> tuple[DataFrame, Books]:
    """vec_id, label, code (two hex digits a part) and error of each row, and the codebooks.

    Entries become floor(4096 * c). scaled_rows says which rows take part; rows that repeat a vec_id or a vector count each,
    and a null vec_id is kept. With fewer than ENTRIES rows the codebooks are as short. Parts are cut at i * d / PARTS,
    rounded down. Other columns are ignored; no rows give none, and no codebooks. Components so large that squared
    distances exceed 64 bits are an error.
    """
    label = F.col("label").cast("string").alias("label") if "label" in rows.columns else F.lit(None).cast("string").alias("label")
    named = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label, F.col(vector).alias("vector"))
    books, state = train(scaled_rows(named, "vector", SCALE, 0, ["vec_id", "label"]), rounds)
    if state is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, label string, code string, error long"), []
    coded = saved(state.filter("part is null").select("vec_id", "label", "x", "code").mapInArrow(_code(books), "vec_id long, label string, code string, error long"), "coded")
    forget(state)
    return coded, books


def op13_exponion_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    if by_label.limit(MOST_LABELS + 1).count() <= MOST_LABELS:
        by_label = F.broadcast(by_label)
    by_label = by_label.withColumnRenamed("label", "_label")
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(printed(books).encode()).hexdigest()).alias("codebooks_sha256"))
