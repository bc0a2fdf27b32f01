"""Token-id files: fixed-width bit packing with block offsets.

A shard is one file. Ids take the least bits that hold the vocabulary, lowest bit first, in blocks of BLOCK ids;
after the blocks come the documents' ids and first tokens, each block's byte offset, and a trailer of fixed size:

    blocks | doc_ids int64[n] | doc_starts uint64[n + 1] | block_offsets uint64[b + 1] | trailer

A reader takes the trailer, then the index, then only the blocks it needs, and unpacks a block with numpy.
All integers are little-endian. A null doc_id is stored as NULL_ID.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibra.llm.common import new_path, saved, shuffle_partitions, small_batches, table, text_bytes, texts
from calibra.llm.tokens import encoder, tokenizer_path, vocabulary_size

MAGIC, BLOCK, NULL_ID = b"CALBITS1", 4096, -(1 << 63)
TRAILER = struct.Struct("<QQIIQ8s")  # documents, tokens, bits, ids in a block, where the index begins, MAGIC
MANIFEST = "shard long, path string, n_docs long, n_tokens long"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a bit string, lowest bit first, filled up to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return spread @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class ShardWriter:
    """Writes documents in the order they come; holds one block and the index."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits, self.at = stream, bits, 0
        self.ids, self.starts, self.offsets = [], [0], [0]
        self.held, self.n_held = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(NULL_ID if doc_id is None else doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 64 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([*self.held, np.empty(0, np.uint32)])
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for k in range(0, whole, BLOCK):
            raw = pack(ids[k : min(k + BLOCK, whole)], self.bits)
            self.stream.write(raw)
            self.at += len(raw)
            self.offsets.append(self.at)
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> tuple[int, int]:
        self._flush(True)
        for part, kind in ((self.ids, "<i8"), (self.starts, "<u8"), (self.offsets, "<u8")):
            self.stream.write(np.asarray(part, kind).tobytes())
        self.stream.write(TRAILER.pack(len(self.ids), self.starts[-1], self.bits, BLOCK, self.at, MAGIC))
        self.stream.close()
        return len(self.ids), self.starts[-1]


class ShardReader:
    """Random access to a shard: the index is read at once, blocks as they are asked for."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        n, self.n_tokens, self.bits, self.block, at, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        index = self.file.read_at(size - TRAILER.size - at, at)
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.starts = np.frombuffer(index, "<u8", n + 1, 8 * n).astype(np.int64)
        self.offsets = np.frombuffer(index, "<u8", -1, 8 * (2 * n + 1)).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start up to stop, counted from the shard's first."""
        if stop <= start:
            return np.empty(0, np.uint32)
        a, b = start // self.block, -(-stop // self.block)
        raw = self.file.read_at(int(self.offsets[b] - self.offsets[a]), int(self.offsets[a]))
        n = min(b * self.block, self.n_tokens) - a * self.block
        return unpack(raw, n, self.bits)[start - a * self.block : stop - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Each document's id, first token and ids; about `most` ids are read at a time."""
        n, k = len(self.doc_ids), 0
        while k < n:
            end = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + most, "right")) - 1)
            base = int(self.starts[k])
            ids = self.ids(base, int(self.starts[end]))
            for j in range(k, end):
                doc_id = int(self.doc_ids[j])
                yield None if doc_id == NULL_ID else doc_id, int(self.starts[j]), ids[self.starts[j] - base : self.starts[j + 1] - base]
            k = end


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shard_bytes: int = 64 << 20) -> DataFrame:
    """Writes docs(doc_id, text) in ascending doc_id order to shards under folder; returns the manifest.

    The rows are dealt by ranges of doc_id and sorted (then by text), so the shards in order hold the whole table in
    order. Each attempt of a task writes a file of its own name, and the manifest, which Spark commits, names those
    that count. A null or empty text is the end id alone; null doc_ids come first; repeated rows stay; other
    columns are ignored; an empty table gives no shard with documents. folder is a URI that pyarrow can open.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    shards = max(shuffle_partitions(spark), -(-text_bytes(rows) // shard_bytes))
    dealt = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return saved(dealt.mapInArrow(_writer(folder, tokenizer, end_id, bits_for(vocabulary_size(tokenizer))), MANIFEST), "manifest")


def _writer(folder: str, tokenizer: str, end_id: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, end = encoder(tokenizer), TaskContext.get().partitionId(), np.array([end_id], np.uint32)
        store, path = fs.FileSystem.from_uri(folder)
        name, shard = f"shard-{task:07d}-{uuid.uuid4().hex}.bits", None
        for batch in small_batches(batches, "text"):
            if shard is None:
                store.create_dir(path, recursive=True)
                shard = ShardWriter(store.open_output_stream(f"{path}/{name}"), bits)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                shard.add(doc_id, np.concatenate([encode.ids(text), end]))
        if shard is not None:
            n_docs, n_tokens = shard.close()
            yield pa.RecordBatch.from_pydict({"shard": [task], "path": [f"{folder}/{name}"], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    return run


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (tokens before it in all shards), n_tokens and the CRC of its ids.

    Only the manifest, a row for each shard, is summed in one task.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("shard", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    tasks = max(1, manifest.count())
    return placed.repartitionByRange(tasks, "shard").mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for row in batch.to_pylist():
            out: list[tuple] = []
            for doc_id, start, ids in ShardReader(row["path"]).documents():
                out.append((doc_id, row["base"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                if len(out) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"), 1))
