import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.llm import scoring
from calibra.llm.common import table
from calibra.llm.language import held_out
from calibra.llm.scoring import Chunk, from_short_hashes, from_small_ints, learn_weights, score_documents, short_hashes, small_ints

SCHEMA = "doc_id long, text string, chunk int, train string"


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "<end>"]


def is_held(d):
    return zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2


def plain_base(rows):
    counts = Counter(w for d, t in rows if not is_held(d) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    return sorted((d, is_held(d), len(words(t)), sum(w in counts for w in words(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for d, t in rows)


def test_bytes_round_trip():
    for top in (3, 300, 70_000, 1 << 40):
        values = np.array([0, 1, top])
        assert (from_small_ints(small_ints(values)) == values).all()
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 60, 50, dtype=np.uint64))
    assert (np.diff(from_short_hashes(short_hashes(h, 4)).astype(np.int64)) > 0).all()


def test_base_score_over_documents(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    got = scoring.op7_deleted_interpolation(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == plain_base(rows)
    # The mixture predicts held-out texts better than single words do.
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_model_against_plain_python(spark, monkeypatch, order):
    rows = [(i, " ".join("abcdefgh"[(i * k * k + k) % 8] for k in range(i % 17)), 1, "") for i in range(200)] + [(None, "a B", 1, ""), (7, None, 2, None), (7, "a b c", 2, None)]
    weights = np.tile(np.arange(1, order + 2) / sum(range(1, order + 2)), (scoring.CLASSES, 1))
    monkeypatch.setattr(scoring, "learn_weights", lambda *a: weights)
    got = score_documents(spark.createDataFrame(rows, SCHEMA), held_out(F.col("doc_id"), 7, 2), order).collect()
    grams = [Counter() for _ in range(order + 1)]
    context = [Counter() for _ in range(order + 1)]
    for d, t, *_ in rows:
        if not is_held(d):
            w = ["<end>"] * (order - 1) + words(t)
            for i in range(order - 1, len(w)):
                for n in range(1, order + 1):
                    grams[n][tuple(w[i - n + 1 : i + 1])] += 1
                    context[n][tuple(w[i - n + 1 : i])] += 1
    n, v = sum(grams[1].values()), len(grams[1])

    def score(t):
        w, out = ["<end>"] * (order - 1) + words(t), 0
        for i in range(order - 1, len(w)):
            p = weights[0][0] / (v + 1)
            for k in range(1, order + 1):
                c = context[k][tuple(w[i - k + 1 : i])]
                p += weights[0][k] * (grams[k][tuple(w[i - k + 1 : i + 1])] / c if c else 0)
            out += math.log10(p)
        return out

    want = sorted((str(d), len(words(t)), round(score(t), 6)) for d, t, *_ in rows)
    assert sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}


def test_weights_find_the_better_estimate():
    base = 60 * scoring.STEPS + 2
    cell = (3 * base + 1 + 8 * scoring.STEPS) * base + 1 + scoring.STEPS  # unigram 2^-8, bigram 2^-1
    w = learn_weights([(cell, 1000)], 2, 10_000)
    assert w.shape == (scoring.CLASSES, 3) and w[3][2] > 0.9 and np.allclose(w.sum(axis=1), 1)


def test_empty_table(spark):
    assert score_documents(spark.createDataFrame([], SCHEMA), F.lit(False)).count() == 0
    only = score_documents(spark.createDataFrame([(1, "a b", 0, "")], SCHEMA), F.lit(True)).first()
    assert (only.n_tokens, only.n_known, only.train_tokens, only.base_score) == (3, 0, 0, 0.0)
    assert len(Chunk.of([None], 2).grams[0]) == 1
