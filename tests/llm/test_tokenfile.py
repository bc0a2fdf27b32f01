import zlib

import numpy as np
import pytest

from calibra.llm.common import new_path
from calibra.llm.tokenfile import ShardReader, bits_for, pack, read_token_files, unpack, write_token_files
from calibra.llm.tokens import encoder, tokenizer_path

SCHEMA = "doc_id long, text string, shard string, path long"


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 9001, dtype=np.uint64).astype(np.uint32)
    raw = pack(ids, bits)
    assert len(raw) == -(-9001 * bits // 8) and (unpack(raw, 9001, bits) == ids).all()


def test_bits():
    assert [bits_for(n) for n in (1, 2, 3, 256, 257, 49408)] == [1, 1, 2, 8, 9, 16]


def test_files_hold_the_table_in_order(spark):
    path = tokenizer_path("word_bpe_49k.json")
    rows = [(9, "Last one, é.", "x", 1), (-3, "first", "x", 1), (4, None, None, None), (5, "", "", 0), (6, "many words " * 9000, "y", 2), (6, "again six", "y", 2), (6, "again six", "y", 2), (None, "no id", "z", 3)]
    manifest = write_token_files(spark.createDataFrame(rows, SCHEMA), new_path(spark, "t"), path, 1)
    got = sorted(read_token_files(manifest).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (doc_id, text, _, _) in zip(got, want, strict=True):
        ids = np.append(encoder(path).ids(text or ""), 1).astype("<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    whole = [x for m in sorted(manifest.collect(), key=lambda m: m.shard) for k in range(m.n_docs) for x in ShardReader(m.path).document(k)]
    assert len(whole) == at


def test_empty_table(spark):
    manifest = write_token_files(spark.createDataFrame([], SCHEMA), new_path(spark, "t"), tokenizer_path("word_bpe_49k.json"), 1)
    assert read_token_files(manifest).count() == 0
