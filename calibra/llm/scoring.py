"""Language-model scores by deleted interpolation.

The probability of a token after a context mixes maximum-likelihood estimates of each order and a uniform one, with
weights by the frequency class of the context, learned by expectation-maximisation on held-out counts.

Counts live in shards by hash and never meet in one place. Documents are dealt to chunks; a chunk asks each shard for
its distinct n-grams, with what it adds to their counts, and the shard answers with the counts of the whole corpus in
the order of the question. So a frequent word costs a chunk one entry, and a shard one for each chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm.common import saved, table, text_bytes
from calibra.llm.language import held_out
from calibra.llm.shingles import word_hashes

ORDER = 2
#: Text in a chunk, and in a shard's share of the questions; the least number of either.
CHUNK_BYTES, SHARD_BYTES, LEAST = 16 << 20, 16 << 20, 64
#: One training document in so many gives the counts on which the weights are learned.
EM_FOLDS, EM_ROUNDS = 12, 60
CLASSES, STEPS = 24, 4
#: The end of a text; no word has a blank.
END = xxhash.xxh3_64_intdigest(b" end")


def tokens(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of each text's words, lower-cased A-Z, and of the end. About a megabyte of text is hashed at once."""
    out: list[np.ndarray] = []
    held: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        held.append(text or "")
        size += len(held[-1])
        if size > 1 << 20 or i == len(texts) - 1:
            out += [np.append(w, np.uint64(END)) for w in word_hashes(held)]
            held, size = [], 0
    return out


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


@dataclass
class Chunk:
    """The n-grams of a chunk's documents: for each order, a hash for every token; the last is the context's place."""

    ends: np.ndarray
    grams: list[np.ndarray]
    distinct: list[np.ndarray]
    at: list[np.ndarray]

    @classmethod
    def of(cls, texts: list[str | None], order: int) -> Chunk:
        docs = tokens(texts)
        ends = np.cumsum([len(d) for d in docs])
        words = np.concatenate(docs)
        grams, context = [words], words
        place = np.arange(len(words)) - np.repeat(ends - [len(d) for d in docs], [len(d) for d in docs])
        for n in range(1, order):
            # A context that begins before the text holds the end mark there.
            before = np.full(len(words), END, np.uint64)
            before[n:] = np.where(place[n:] >= n, words[:-n], np.uint64(END))
            context = _mixed(before, context)
            grams.append(_mixed(context, np.full(1, n, np.uint64)))
        found = [np.unique(g, return_inverse=True) for g in grams]
        return cls(ends, grams, [f[0] for f in found], [f[1] for f in found])

    def spread(self, per_document: np.ndarray) -> np.ndarray:
        return np.repeat(per_document, np.diff(self.ends, prepend=0))

    def previous(self, values: list[np.ndarray], none: np.ndarray) -> list[np.ndarray]:
        """values[n] of the context of each token: those of the token before it, at order n."""
        starts = np.concatenate([[0], self.ends[:-1]])
        out = []
        for v, first in zip(values, none, strict=True):
            moved = np.empty_like(v)
            moved[1:] = v[:-1]
            moved[starts] = first
            out.append(moved)
        return out


def small_ints(values: np.ndarray) -> bytes:
    """Counts in the least of 1, 2, 4 or 8 bytes; the first byte says which."""
    size = next(s for s in (1, 2, 4, 8) if s == 8 or not len(values) or values.max() < 1 << (8 * s))
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def from_small_ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", -1, 1).astype(np.int64)


def short_hashes(values: np.ndarray, shift: int) -> bytes:
    """Hashes of one shard in six bytes: the bits below the shard's, as many as fit."""
    low = (values << np.uint64(shift)) >> np.uint64(16)
    return low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_short_hashes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


QUESTION = "chunk long, shard long, grams int, hashes binary, n binary, n_fold binary"
ANSWER = "chunk long, shard long, grams int, n binary, n_fold binary, total long, kinds long, fold_total long"


def _asks(order: int, bits: int) -> Callable[[pa.Table], pa.Table]:
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

    def ask(group: pa.Table) -> pa.Table:
        chunk = Chunk.of(group.column("text").to_pylist(), order)
        train = chunk.spread(group.column("train").to_numpy().astype(float))
        fold = chunk.spread(group.column("fold").to_numpy().astype(float))
        out, key = [], group.column("chunk")[0].as_py()
        for n in range(order):
            hashes = chunk.distinct[n]
            counts = [np.bincount(chunk.at[n], w, len(hashes)).astype(np.int64) for w in (train, fold)]
            cut = np.append(np.searchsorted(hashes, edges), len(hashes))
            for shard in range(1 << bits):
                a, b = cut[shard], cut[shard + 1]
                if b > a:
                    out.append((key, shard, n + 1, short_hashes(hashes[a:b], bits), *(small_ints(c[a:b]) for c in counts)))
        return _table(out, QUESTION)

    return ask


def _answers(group: pa.Table) -> pa.Table:
    rows, out = group.to_pylist(), []
    for n in sorted({r["grams"] for r in rows}):
        asked = [r for r in rows if r["grams"] == n]
        hashes = [from_short_hashes(r["hashes"]) for r in asked]
        distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
        counts, folds = (np.bincount(at, np.concatenate([from_small_ints(r[c]) for r in asked]), len(distinct)).astype(np.int64) for c in ("n", "n_fold"))
        begin = 0
        for r, h in zip(asked, hashes, strict=True):
            where = at[begin : begin + len(h)]
            begin += len(h)
            out.append((r["chunk"], r["shard"], n, small_ints(counts[where]), small_ints(folds[where]), 0, 0, 0))
        if n == 1:
            out.append((-1, rows[0]["shard"], n, b"", b"", int(counts.sum()), int((counts > 0).sum()), int(folds.sum())))
    return _table(out, ANSWER)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.table({name: pa.array(c, _ARROW[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


@dataclass
class Model:
    """What scoring needs besides the counts: totals, and the weights of each context order and frequency class."""

    order: int
    total: int
    kinds: int
    weights: np.ndarray  # classes by context order, class, and estimate: uniform first

    def classes(self, count: np.ndarray) -> np.ndarray:
        return np.minimum(CLASSES - 1, np.log2(count + 1).astype(int))


def _estimates(chunk: Chunk, counts: list[np.ndarray], total: float, kinds: int, ends: float) -> tuple[np.ndarray, np.ndarray]:
    """Each token's estimates, uniform first, and the longest context's count, from counts by token and order."""
    previous = chunk.previous(counts[:-1], [ends] * (len(counts) - 1)) if len(counts) > 1 else []
    out = [np.full(len(chunk.grams[0]), 1 / (kinds + 1)), counts[0] / max(total, 1)]
    for n, before in enumerate(previous, 1):
        out.append(np.divide(counts[n], before, out=np.zeros(len(before)), where=before > 0))
    return np.stack(out), previous[-1] if previous else np.zeros(len(chunk.grams[0]))


def _counts(chunk: Chunk, answers: pa.Table, column: str) -> list[np.ndarray]:
    """The corpus's counts of each token's n-gram, by order."""
    rows = sorted(answers.select(["grams", "shard", column]).to_pylist(), key=lambda r: (r["grams"], r["shard"]))
    out = []
    for n, at in enumerate(chunk.at, 1):
        found = np.concatenate([from_small_ints(r[column]) for r in rows if r["grams"] == n])
        if len(found) != len(chunk.distinct[n - 1]):
            raise RuntimeError("a chunk's documents differ from those that it asked about")
        out.append(found[at].astype(float))
    return out


CELLS = "cell long, n long"


def _cells(order: int, total: int, kinds: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Held-out tokens by class and rounded estimates, all from the counts without the held-out documents."""

    def count(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([], CELLS)
        chunk = Chunk.of(docs.column("text").to_pylist(), order)
        counts = [a - b for a, b in zip(_counts(chunk, answers, "n"), _counts(chunk, answers, "n_fold"), strict=True)]
        ends = counts[0][chunk.ends[0] - 1]
        estimates, context = _estimates(chunk, counts, total, kinds, ends)
        cell = np.minimum(CLASSES - 1, np.log2(context + 1).astype(np.int64))
        for p in estimates[1:]:
            level = np.where(p > 0, 1 + np.round(-STEPS * np.log2(np.maximum(p, 2.0**-60))), 0).astype(np.int64)
            cell = cell * (60 * STEPS + 2) + level
        return _table(list(zip(*(x.tolist() for x in np.unique(cell, return_counts=True)), strict=True)), CELLS)

    return count


def learn_weights(cells: list[tuple[int, int]], order: int, kinds: int) -> np.ndarray:
    """Expectation-maximisation in each class over (cell, tokens); a class without tokens gets the weights of all."""
    base = 60 * STEPS + 2
    ids, n = np.array([c for c, _ in cells], np.int64), np.array([k for _, k in cells], float)
    estimates = []
    for _ in range(order):
        level = ids % base
        estimates.append(np.where(level > 0, 2.0 ** (-(level - 1) / STEPS), 0.0))
        ids = ids // base
    p = np.stack([np.full(len(n), 1 / (kinds + 1)), *estimates[::-1]])

    def weights(mask: np.ndarray) -> np.ndarray:
        w = np.full(order + 1, 1 / (order + 1))
        for _ in range(EM_ROUNDS):
            share = w[:, None] * p[:, mask]
            got = (share / share.sum(axis=0) * n[mask]).sum(axis=1)
            w = np.maximum(got / got.sum(), 1e-9)
            w /= w.sum()
        return w

    everything = weights(np.ones(len(n), bool)) if len(n) else np.full(order + 1, 1 / (order + 1))
    return np.stack([weights(ids == k) if (ids == k).any() else everything for k in range(CLASSES)])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(model: Model) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([], SCORES)
        chunk = Chunk.of(docs.column("text").to_pylist(), model.order)
        counts = _counts(chunk, answers, "n")
        estimates, context = _estimates(chunk, counts, model.total, model.kinds, counts[0][chunk.ends[0] - 1])
        weights = model.weights[model.classes(context)].T
        starts = np.concatenate([[0], chunk.ends[:-1]])
        log_p = np.log10((weights * estimates).sum(axis=0))
        base = np.log10((counts[0] + 1) / (model.total + (model.kinds + 1)))
        lengths = np.diff(chunk.ends, prepend=0)
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": docs.column("held_out"),
                "n_tokens": pa.array(lengths.astype(np.int64)),
                "n_known": pa.array(np.add.reduceat((counts[0] > 0).astype(np.int64), starts)),
                "train_tokens": pa.array(np.full(len(lengths), model.total, np.int64)),
                "base_score": pa.array([math.fsum(base[a:b]) for a, b in zip(starts, chunk.ends, strict=True)], pa.float64()),
                "score": pa.array([math.fsum(log_p[a:b]) for a, b in zip(starts, chunk.ends, strict=True)], pa.float64()),
            }
        )

    return score


def score_documents(docs: DataFrame, held: Column, order: int = ORDER) -> DataFrame:
    """Scores of every row of docs(doc_id, text); `held` says which rows are not learned from.

    A null text is empty and is its end alone; equal rows get equal scores; a null doc_id is a document like any
    other; other columns are ignored; an empty table gives no rows, and without training rows every estimate but the
    uniform one is 0. Only totals, and the held-out tokens by class and rounded estimates, reach the driver: at most
    CLASSES times (60 STEPS + 2) squared cells for two orders, whatever the corpus.
    """
    size = text_bytes(docs)
    chunks = max(LEAST, -(-size // CHUNK_BYTES))
    bits = max(LEAST, -(-size // SHARD_BYTES)).bit_length() - 1
    key = F.xxhash64("doc_id", F.substring("text", 1, 64), F.length("text"))
    fold = ~F.col("held_out") & (F.pmod(F.xxhash64("doc_id", F.lit("weights")), F.lit(EM_FOLDS)) == 0)
    rows = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out")).withColumns({"train": ~F.col("held_out"), "fold": fold})
    # Documents for the weights have chunks of their own, so learning reads no others.
    fold_chunks = max(4, chunks // EM_FOLDS)
    rows = rows.withColumn("chunk", F.when(F.col("fold"), chunks + F.pmod(key, F.lit(fold_chunks))).otherwise(F.pmod(key, F.lit(chunks))))
    questions = rows.groupBy("chunk").applyInArrow(_asks(order, bits), QUESTION)
    answers = saved(questions.groupBy("shard").applyInArrow(_answers, ANSWER), "lm-answers")
    sums = answers.filter("chunk = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "kinds", "fold_total")]).first()
    answers = answers.filter("chunk >= 0")
    some = rows.filter("fold").groupBy("chunk").cogroup(answers.filter(F.col("chunk") >= chunks).groupBy("chunk"))
    cells = some.applyInArrow(_cells(order, sums["total"] - sums["fold_total"], sums["kinds"]), CELLS).groupBy("cell").agg(F.sum("n").alias("n"))
    weights = learn_weights([(r["cell"], r["n"]) for r in cells.collect()], order, sums["kinds"])
    model = Model(order, sums["total"], sums["kinds"], weights)
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scores(model), SCORES)


def op7_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), held_out(F.col("doc_id"), 7, 2))
