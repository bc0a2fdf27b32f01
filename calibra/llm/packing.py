"""Packing by power-of-two decomposition.

Each document's ids, with an end id, are cut into pieces whose lengths are powers of two: as many pieces of the
longest length as fit, then the binary digits of the rest, longest first. Pieces of one length form a bucket, and
each piece is a sequence of its own, so no sequence crosses documents and none needs padding: its length is a
power of two. A trainer reads whole buckets, so every batch has one length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from calibra.llm.common import small_batches, table, texts
from calibra.llm.tokens import encoder, tokenizer_path

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int, sequence_id long, offset long"


def piece_lengths(n: int, longest: int) -> list[int]:
    """The lengths of the pieces of n ids; longest is a power of two."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, longest: int = 1024) -> DataFrame:
    """Pieces of every row of docs(doc_id, text): one row a piece, ids as little-endian unsigned 32-bit integers.

    bucket is the base-2 logarithm of the length. sequence_id is the bucket, then the task's number, then a count in
    the task: unique, and in one range for each bucket. A null or empty text is the end id alone; a null doc_id, a
    repeated row and other columns change nothing; an empty table gives no rows. A whole text is held at a time.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    return docs.select("doc_id", "text").mapInArrow(_packer(tokenizer, end_id, longest), PIECES)


def _packer(tokenizer: str, end_id: int, longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer), TaskContext.get().partitionId()
        made = [0] * (longest.bit_length())
        end = np.array([end_id], np.uint32)
        for batch in small_batches(batches, "text"):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                ids = np.concatenate([encode.ids(text), end]).astype("<u4")
                raw, start = ids.tobytes(), 0
                for n in piece_lengths(len(ids), longest):
                    bucket = n.bit_length() - 1
                    out.append((doc_id, start, n, raw[4 * start : 4 * (start + n)], len(ids), bucket, (bucket << 58) | (task << 34) | made[bucket], 0))
                    made[bucket] += 1
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)

    return run


_NAMES = [f.split()[0] for f in PIECES.split(", ")]
_TYPES = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]] for f in PIECES.split(", ")]


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a CRC in place of their ids."""
    from pyspark.sql import functions as F

    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op8_power_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 0))
