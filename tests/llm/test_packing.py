import numpy as np
from pyspark.sql import Row

from calibra.llm.packing import digest, pack_documents, piece_lengths
from calibra.llm.tokens import encoder, tokenizer_path

SCHEMA = "doc_id long, text string, bucket string, start long"


def test_piece_lengths():
    for n in range(1, 5000):
        parts = piece_lengths(n, 1024)
        assert sum(parts) == n and parts == sorted(parts, reverse=True) and all(p & (p - 1) == 0 and p <= 1024 for p in parts)


def test_pieces_give_back_every_document(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = [(1, "The one and the other.", "x", 1), (2, None, None, None), (3, "", "", 0), (4, "long words here " * 4000, "y", 2), (4, "long words here " * 4000, "y", 2), (None, "no id", "z", 3)]
    got = pack_documents(spark.createDataFrame(rows, SCHEMA), path, 0).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    by = {}
    for r in got:
        assert r.length == 1 << r.bucket and r.length <= 1024 and r.offset == 0 and len(r.ids) == 4 * r.length
        by.setdefault((r.doc_id, r.start), []).append(r)
    for doc_id, text, _, _ in rows:
        want = [*encoder(path).ids(text or ""), 0]
        copies = 2 if doc_id == 4 else 1
        have = b"".join(by[k][0].ids for k in sorted((k for k in by if k[0] == doc_id), key=lambda k: k[1]))
        assert list(np.frombuffer(have, "<u4")) == want
        assert all(len(v) == copies and {r.doc_tokens for r in v} == {len(want)} for k, v in by.items() if k[0] == doc_id)


def test_empty_table_and_digest(spark):
    got = digest(pack_documents(spark.createDataFrame([], SCHEMA), tokenizer_path("byte_bpe_50k.json"), 0))
    assert got.count() == 0
    one = digest(pack_documents(spark.createDataFrame([Row(doc_id=7, text="")], "doc_id long, text string"), tokenizer_path("byte_bpe_50k.json"), 0)).first()
    assert (one.doc_id, one.start, one.length, one.doc_tokens) == (7, 0, 1, 1)
