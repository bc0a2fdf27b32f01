import base64
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from calibra.llm.fingerprints import containment, distinct_shingles, fingerprint_edits, merged, resemblance, shingle_hashes, sketch, word_hashes

SCHEMA = "doc_id long, text string, _range string, sketch int"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_edits_against_plain_python(spark):
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2
    rows = [(3, base, "x", 1), (1, None, "x", 1), (2, "", None, 2), (7, "é" * 11, "", 3), (5, base, "", 3), (4, "one two three four five six", "", 3), (4, "one two three four five six", "", 3), (8, base + "tail end of it all", "", 1), (None, "zero id\tx", "", 1)]
    for buckets in (1, 4, 50):
        got = fingerprint_edits(spark.createDataFrame(rows, SCHEMA), buckets).collect()
        assert len(got) == len(rows)
        order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        want = []
        for i, (doc_id, text) in enumerate(order):
            following = order[(i + 1) % len(order)][1]
            half = len(text) // 2
            edited = text[: len(text) - half] + following[:half]
            like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
            want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(like(shingles(text), shingles(edited)), 9), round(like(shingles(text), shingles(following)), 9)))
        key = lambda r: (r[0] is not None, r)
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=lambda r: (r[0] is not None, r[0] or 0, r[1:])) == sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, r[1:])), key
        prints = {r.doc_id: r.fingerprint for r in got}
        assert prints[3] == prints[5] and prints[1] == prints[2] == "" and len(base64.b64decode(prints[3].replace("\r\n", ""))) == 6 * len(shingles(base))
        assert all(0 <= r.edited_contained <= 1 for r in got)


def test_empty(spark):
    assert fingerprint_edits(spark.createDataFrame([], SCHEMA), 4).count() == 0


def test_estimates_and_merge(spark):
    words = [f"w{i}" for i in range(6000)]
    row = (spark.createDataFrame([(" ".join(words[:4000]), " ".join(words[2000:6000]), " ".join(words))], "a string, b string, c string")
           .select(*[sketch(F.col(c)).alias(c) for c in "abc"])
           .select("c", merged(F.col("a"), F.col("b")).alias("m"), resemblance(F.col("a"), F.col("b")).alias("r"), containment(F.col("a"), F.col("c")).alias("k"), distinct_shingles(F.col("c")).alias("n")).first())
    assert row.m[:50] == row.c[:50] and abs(row.r - 1 / 3) < 0.13 and row.k > 0.8 and abs(row.n - 5996) < 1500


@pytest.mark.parametrize("n", [0, 1, 4, 5, 9])
def test_shingle_counts(spark, n):
    row = spark.createDataFrame([(" \t".join("abcdefghi"[:n]),)], "t string").select(F.size(shingle_hashes(word_hashes(F.col("t")))).alias("n")).first()
    assert row.n == (0 if n == 0 else max(1, n - 4))
