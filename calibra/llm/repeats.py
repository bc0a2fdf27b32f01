"""Exact repeats of long byte strings, judged by suffix arrays over the places where copies part.

Every window of WINDOW bytes has an anchor: its run of CORE bytes with the least hash. Equal windows have equal anchors
at equal places, so only windows whose anchors meet again can repeat. The windows of one anchor are a piece. Pieces meet
by their anchors' hashes in shards, where equal ones become one; of each different piece of an anchor that has several,
the bytes are sent, and suffix arrays over both sides of the anchor tell which of its windows stand in an earlier piece.

Anchors with very many different pieces are cut into pieces of SEGMENT windows that meet by all bytes these have in
common, so that a passage with other text around each copy is not one group.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm.common import forget, saved, shuffle_partitions, table
from calibra.llm.shingles import FACTOR, mixed
from calibra.llm.suffixes import equal_windows

WINDOW, CORE, SEGMENT = 100, 24, 4
#: Bytes hashed at once; a place in them has 20 bits. Bytes of text whose anchors are first compared among themselves.
BLOCK, CHUNK = 1 << 18, 16 << 20
#: Different pieces from which on an anchor is cut up; those that a chunk has at least this many of are counted; and the
#: most anchors that are sent to all tasks. They decide how pieces meet, and never which windows are equal.
CROWD, CHUNK_CROWD, MOST_CROWDS = 512, 4, 1 << 20
#: Text of a shard, and pieces whose suffixes are sorted together.
SHARD_BYTES, SORTED_TOGETHER = 16 << 20, 4096
#: Stands for a missing doc_id, which comes first.
FIRST = -(1 << 63)

PIECE = np.dtype([("key", "<u8"), ("same", "<u8"), ("doc", "<u4"), ("lo", "<u8"), ("n", "<u1"), ("core_at", "<u1"), ("core", "<u1")])
RUN = np.dtype([("doc", "<u4"), ("lo", "<u8"), ("hi", "<u8")])
SPAN = np.dtype([("lo", "<u8"), ("hi", "<u8")])
DOC = np.dtype([("at", "<i8"), ("tie", "<i8")])

_INVERSE = pow(FACTOR, -1, 1 << 64)
_BYTES = mixed(np.arange(256, dtype=np.uint64) + np.uint64(11))


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    out = []
    for factor in (FACTOR, _INVERSE):
        p = np.full(BLOCK + 2 * WINDOW, factor, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def block_pieces(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, crowds: np.ndarray) -> np.ndarray:
    """The pieces of the texts buffer[start:end], with doc the text's place and lo its place in the text; at most BLOCK bytes and a window."""
    windows = len(buffer) - WINDOW + 1
    if windows < 1:
        return np.empty(0, PIECE)
    up, down = _powers()
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(_BYTES[buffer] * up[: len(buffer)], out=sums[1:])
        hashes = mixed((sums[CORE:] - sums[:-CORE]) * down[: len(buffer) - CORE + 1])
        span = WINDOW - CORE + 1
        low = np.uint64((1 << 20) - 1)
        keyed = np.concatenate([(hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), np.full(-len(hashes) % span, ~np.uint64(0))]).reshape(-1, span)
        ahead = np.minimum.accumulate(keyed, axis=1).ravel()
        back = np.minimum.accumulate(keyed[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(back[:windows], ahead[span - 1 : span - 1 + windows]) & low).astype(np.int64)
        # A window belongs to a text; those that reach into the next one are no windows.
        text = np.repeat(np.arange(len(starts)), ends - starts)[:windows]
        text = np.where(np.arange(windows) + WINDOW <= ends[text], text, -1)
        cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [windows]])
        fine = text[lo] >= 0
        lo, hi = lo[fine], hi[fine]
        at, doc = anchor[lo], text[lo]
        key, core_at, core = hashes[at], at, np.full(len(lo), CORE)
        if len(crowds) and len(lo):
            place = np.minimum(np.searchsorted(crowds, key), len(crowds) - 1)
            often = crowds[place] == key
            first, last = (at - hi + 1) // SEGMENT, (at - lo) // SEGMENT
            times = np.where(often, last - first + 1, 1)
            of = np.repeat(np.arange(len(lo)), times)
            j = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
            lo, hi, at, key, doc, often = lo[of], hi[of], at[of], key[of], doc[of], often[of]
            begin = at - SEGMENT * j  # the last window of a segment starts here, and so do the bytes that its windows share
            lo, hi = np.where(often, np.maximum(lo, begin - SEGMENT + 1), lo), np.where(often, np.minimum(hi, begin + 1), hi)
            core_at, core = np.where(often, begin, at), np.where(often, WINDOW - SEGMENT + 1, CORE)
            shared = mixed((sums[np.minimum(core_at + core, len(buffer))] - sums[core_at]) * down[core_at])
            key = np.where(often, mixed(key + shared + mixed(j.astype(np.uint64) + np.uint64(3))), key)
        out = np.empty(len(lo), PIECE)
        end = hi + WINDOW - 1
        place = ((hi - lo) * 256 + (core_at - lo)).astype(np.uint64)
        out["same"] = mixed((sums[end] - sums[lo]) * down[lo]) ^ mixed(place + np.uint64(5))
    out["key"], out["doc"], out["n"], out["core_at"], out["core"] = key, doc, hi - lo, core_at - lo, core
    out["lo"] = lo - starts[doc]
    return out


def _blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts side by side in blocks; a long one in slices that overlap by all but a byte of a window. Yields bytes, starts, ends, texts, offsets."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - WINDOW + 1), BLOCK // 2):
            part = text[offset : offset + BLOCK // 2 + WINDOW - 1]
            if size + len(part) > BLOCK and held:
                yield _joined(held)
                held, size = [], 0
            held.append((i, offset, part))
            size += len(part)
    if held:
        yield _joined(held)


def _joined(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(p) for _, _, p in held])
    starts = np.concatenate([[0], ends[:-1]])
    return np.frombuffer(b"".join(p for _, _, p in held), np.uint8), starts, ends, np.array([i for i, _, _ in held]), np.array([o for _, o, _ in held])


def pieces_of(texts: list[bytes], crowds: np.ndarray) -> np.ndarray:
    """The pieces of texts, with doc the text's place in the list."""
    out = [np.empty(0, PIECE)]
    for buffer, starts, ends, which, offsets in _blocks(texts):
        p = block_pieces(buffer, starts, ends, crowds)
        p["lo"] += offsets[p["doc"]].astype(np.uint64)
        p["doc"] = which[p["doc"]]
        out.append(p)
    return np.concatenate(out)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Documents' addresses and texts, about CHUNK bytes at a time, in text order within a chunk."""
    held, size = [], 0
    for batch in batches:
        for row in zip(batch.column("at").to_pylist(), batch.column("tie").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            held.append(row)
            size += len(row[2])
            if size >= CHUNK:
                yield _sorted(held)
                held, size = [], 0
    if held:
        yield _sorted(held)


def _sorted(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, list[bytes]]:
    held = sorted(held, key=lambda r: r[:2])
    return np.array([r[:2] for r in held], DOC), [r[2] for r in held]


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in _chunks(batches):
        p = pieces_of(texts, np.empty(0, np.uint64))
        both = np.unique(p[["key", "same"]])
        keys, n = np.unique(both["key"], return_counts=True)
        many = n >= CHUNK_CROWD
        yield pa.RecordBatch.from_arrays([pa.array(keys[many].view(np.int64)), pa.array(n[many].astype(np.int64))], ["key", "n"])


def crowded_anchors(texts: DataFrame) -> np.ndarray:
    """Hashes of anchors with very many different pieces, sorted; at most MOST_CROWDS."""
    found = texts.mapInArrow(_crowded, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= CROWD)
    rows = found.orderBy(F.desc("n"), "key").limit(MOST_CROWDS).select("key").toArrow()
    return np.sort(rows.column("key").to_numpy().view(np.uint64))


def _firsts(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces in text order: the first of each set of equal ones, and whether a piece is such."""
    order = np.lexsort((np.arange(len(p)), p["same"], p["key"]))
    s = p[order]
    new = np.ones(len(s), bool)
    new[1:] = (s["key"][1:] != s["key"][:-1]) | (s["same"][1:] != s["same"][:-1])
    first = np.zeros(len(p), bool)
    first[order[new]] = True
    return np.flatnonzero(first), first


def _runs(p: np.ndarray) -> np.ndarray:
    out = np.empty(len(p), RUN)
    out["doc"], out["lo"], out["hi"] = p["doc"], p["lo"], p["lo"] + p["n"]
    return out


def _request(shards: int, crowds) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = crowds.value
        for docs, texts in _chunks(batches):
            p = pieces_of(texts, known)
            p = p[np.lexsort((p["lo"], p["doc"]))]
            kept, first = _firsts(p)
            gone = _runs(p[~first])
            shard = (p["key"] % np.uint64(shards)).astype(np.int64)
            own = kept[np.argsort(shard[kept], kind="stable")]
            cuts = np.searchsorted(shard[own], np.arange(shards + 1))
            gone_shard = gone["doc"] % shards
            for s in np.unique(np.concatenate([shard[own], gone_shard])):
                mine, settled = p[own[cuts[s] : cuts[s + 1]]], gone[gone_shard == s]
                used, place = np.unique(np.concatenate([mine["doc"], settled["doc"]]), return_inverse=True)
                mine["doc"], settled["doc"] = place[: len(mine)], place[len(mine) :]
                yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (docs[used], mine, settled))], ["shard", "docs", "pieces", "gone"])

    return run


REQUESTS = "shard int, docs binary, pieces binary, gone binary"
REPLIES = "at long, tie long, gone binary, ask binary"


def _gathered(t: pa.Table, kinds: dict[str, np.dtype]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The documents that rows tell of, in text order, and the rows' records with doc the place among these."""
    docs = [np.frombuffer(x, DOC) for x in t.column("docs").to_pylist()]
    every, place = np.unique(np.concatenate([np.empty(0, DOC), *docs]), return_inverse=True)
    begin = np.cumsum([0, *(len(d) for d in docs)])
    out = []
    for name, kind in kinds.items():
        parts = [np.empty(0, kind)]
        for i, x in enumerate(t.column(name).to_pylist()):
            part = np.frombuffer(x, kind).copy()
            part["doc"] = place[begin[i] + part["doc"].astype(np.int64)]
            parts.append(part)
        out.append(np.concatenate(parts))
    return every, out


def _meet(t: pa.Table) -> pa.Table:
    """Settles a shard: what is equal to an earlier piece is gone, and different pieces of one key are asked for."""
    docs, (p, gone) = _gathered(t, {"pieces": PIECE, "gone": RUN})
    p = p[np.lexsort((p["lo"], p["doc"]))]
    kept, first = _firsts(p)
    gone = np.concatenate([gone, _runs(p[~first])])
    keys, place, n = np.unique(p["key"][kept], return_inverse=True, return_counts=True)
    ask = p[kept[n[place] > 1]]
    return _by_document(docs, gone, ask)


def _by_document(docs: np.ndarray, gone: np.ndarray, ask: np.ndarray) -> pa.Table:
    gone, ask = gone[np.argsort(gone["doc"], kind="stable")], ask[np.argsort(ask["doc"], kind="stable")]
    every = np.arange(len(docs) + 1)
    a, b = np.searchsorted(gone["doc"], every), np.searchsorted(ask["doc"], every)
    some = np.flatnonzero((a[1:] > a[:-1]) | (b[1:] > b[:-1]))
    spans = np.empty(len(gone), SPAN)
    spans["lo"], spans["hi"] = gone["lo"], gone["hi"]
    cut = lambda x, c: pa.array([x[c[i] : c[i + 1]].tobytes() for i in some], pa.binary())
    return pa.table({"at": pa.array(docs["at"][some]), "tie": pa.array(docs["tie"][some]), "gone": cut(spans, a), "ask": cut(ask, b)})


PIECES = "shard int, key long, at long, tie long, lo long, core_at long, core int, low int, high int, left binary, right binary"


def _send(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bytes of the pieces that are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, tie, text, asked in zip(*(batch.column(c).to_pylist() for c in ("at", "tie", "bytes", "asked")), strict=True):
                p = np.concatenate([np.frombuffer(x, PIECE) for x in asked])
                lo = p["lo"].astype(np.int64)
                core_at = lo + p["core_at"]
                end = lo + p["n"] + WINDOW - 1
                left = [text[a:b][::-1] for a, b in zip(lo.tolist(), core_at.tolist(), strict=True)]
                right = [text[a:b] for a, b in zip((core_at + p["core"]).tolist(), end.tolist(), strict=True)]
                low = p["core_at"].astype(np.int64) - p["n"] + 1
                columns = [(p["key"] % np.uint64(shards)).astype(np.int32), p["key"].view(np.int64) if p["key"].flags.c_contiguous else p["key"].copy().view(np.int64), np.full(len(p), at), np.full(len(p), tie), lo, core_at, p["core"].astype(np.int32), low.astype(np.int32), p["core_at"].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(left, pa.binary()), pa.array(right, pa.binary())], [f.split()[0] for f in PIECES.split(", ")])

    return run


def _judge(t: pa.Table) -> pa.Table:
    """The windows of a shard's pieces that an earlier piece has, as runs for each document."""
    c = {n: t.column(n).to_numpy() for n in ("key", "at", "tie", "lo", "core_at", "core", "low", "high")}
    order = np.lexsort((c["core_at"], c["tie"], c["at"], c["key"]))
    keys = c["key"][order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    bounds = [0]
    for h in [*heads[1:].tolist(), len(keys)]:  # whole keys, about SORTED_TOGETHER pieces at a time
        if h - bounds[-1] >= SORTED_TOGETHER or h == len(keys):
            bounds.append(h)
    left, right = t.column("left").combine_chunks(), t.column("right").combine_chunks()
    docs, spans = [np.empty(0, DOC)], [np.empty(0, SPAN)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        o = order[a:b]
        if not len(o):
            continue
        take = lambda column: column.take(pa.array(o)).to_pylist()  # noqa: B023, E731
        again = equal_windows(c["key"][o], c["core"][o].astype(np.int64), c["low"][o].astype(np.int64), c["high"][o].astype(np.int64), take(left), take(right), WINDOW)
        # Window q begins q bytes before the core: runs of q become runs of windows.
        edge = np.diff(np.pad(again.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, q = np.nonzero(edge == 1)
        _, after = np.nonzero(edge == -1)
        core_at = c["core_at"][o][row]
        d, s = np.empty(len(row), DOC), np.empty(len(row), SPAN)
        d["at"], d["tie"] = c["at"][o][row], c["tie"][o][row]
        s["lo"], s["hi"] = core_at - after + 1, core_at - q + 1
        docs.append(d)
        spans.append(s)
    docs, spans = np.concatenate(docs), np.concatenate(spans)
    every, place = np.unique(docs, return_inverse=True)
    gone = np.empty(len(spans), RUN)
    gone["doc"], gone["lo"], gone["hi"] = place, spans["lo"], spans["hi"]
    return _by_document(every, gone, np.empty(0, PIECE)).select(["at", "tie", "gone"])


CUT = "at long, tie long, n_removed long, n_spans long, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without the bytes of the windows that are gone."""
    for batch in batches:
        for at, tie, text, gone in zip(*(batch.column(c).to_pylist() for c in ("at", "tie", "bytes", "gone")), strict=True):
            runs = np.concatenate([np.empty(0, SPAN), *(np.frombuffer(x, SPAN) for x in gone)])
            runs = runs[np.argsort(runs["lo"])]
            lo, hi = runs["lo"].astype(np.int64), np.maximum.accumulate(runs["hi"].astype(np.int64)) + WINDOW - 1
            new = np.concatenate([[True], lo[1:] > hi[:-1]])[: len(lo)]
            begin, end = lo[new], hi[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lo) - 1]])] if len(lo) else lo
            edges = [0, *np.column_stack([begin, end]).ravel().tolist(), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((at, pa.int64()), (tie, pa.int64()), (len(text) - len(kept), pa.int64()), (len(begin), pa.int64()), (kept, pa.binary()))], ["at", "tie", "n_removed", "n_spans", "kept"])


def distinct_texts(docs: DataFrame) -> DataFrame:
    """at, tie and bytes of each different text that has a window, at its least doc_id; no two have the same address."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("at"), text.alias("text")).filter(F.octet_length("text") >= WINDOW)
    rows = rows.withColumn("digest", F.sha2("text", 256))
    return rows.groupBy("digest").agg(F.min("at").alias("at"), F.first("text").alias("text")).select("at", F.xxhash64("digest").alias("tie"), F.encode("text", "utf-8").alias("bytes"))


def removed_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each different text with a repeat, what is left of it: at, tie, n_removed, n_spans, kept (bytes); and all different texts."""
    spark = docs.sparkSession
    texts = saved(distinct_texts(docs), "repeat-texts")
    size = texts.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = max(shuffle_partitions(spark), size // SHARD_BYTES + 1)
    crowds = spark.sparkContext.broadcast(crowded_anchors(texts))
    asked = texts.mapInArrow(_request(shards, crowds), REQUESTS).repartition(shards, "shard")
    replies = saved(asked.groupBy("shard").applyInArrow(_meet, REPLIES), "repeat-replies")
    wanted = replies.filter(F.length("ask") > 0).groupBy("at", "tie").agg(F.collect_list("ask").alias("asked"))
    sent = texts.join(wanted, ["at", "tie"]).mapInArrow(_send(shards), PIECES).repartition(shards, "shard")
    judged = saved(sent.groupBy("shard").applyInArrow(_judge, "at long, tie long, gone binary"), "repeat-judged")
    gone = replies.select("at", "tie", "gone").union(judged).filter(F.length("gone") > 0).groupBy("at", "tie").agg(F.collect_list("gone").alias("gone"))
    left = saved(texts.join(gone, ["at", "tie"]).mapInArrow(_cut, CUT), "repeat-left")
    forget(replies, judged)
    return left, texts


def cut_repeats(docs: DataFrame) -> DataFrame:
    """What each document loses with the bytes that repeat: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of WINDOW bytes over it also starts earlier, in the input, in a smaller doc_id or before in its
    own text. A null text is empty, a null doc_id comes first, and rows of one doc_id are ordered by a hash of their texts;
    of rows with equal doc_id and text one is the earlier. Texts may be of any length: they are hashed in slices. Other
    columns are ignored, and an empty table gives no rows.
    """
    left, texts = removed_repeats(docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("digest"))
    rows = rows.groupBy("doc_id", "n_bytes", "digest").agg(F.count("*").alias("copies"))
    rows = rows.withColumns({"at": F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)), "tie": F.xxhash64("digest")})
    firsts = texts.select("at", "tie").join(left.select("at", "tie", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")), ["at", "tie"], "left")
    rows = rows.join(firsts.withColumn("first", F.lit(True)), ["at", "tie"], "left")
    rows = rows.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    short = F.col("n_bytes") < WINDOW
    first = F.col("first").isNotNull() & (F.col("row") == 1)
    whole = lambda own, untouched, copy: F.when(short, untouched).when(first, F.coalesce(own, untouched)).otherwise(copy)
    return rows.select(
        "doc_id",
        "n_bytes",
        whole(F.col("n_removed"), F.lit(0), F.col("n_bytes")).cast("long").alias("n_removed"),
        whole(F.col("n_spans"), F.lit(0), F.lit(1)).cast("long").alias("n_spans"),
        whole(F.col("kept_sha256"), F.col("digest"), F.lit(hashlib.sha256(b"").hexdigest())).alias("kept_sha256"),
    )


def op11_grouped_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"))
