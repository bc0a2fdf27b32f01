import numpy as np
from pyspark.sql import functions as F

from calibra.llm.common import table
from calibra.llm.neighbours import SAMPLE_PER_PART, learn_router, op6_learned_partitions, part_count, search

SCHEMA = "vec_id long, embedding array<float>, part int, rep string"


def brute(rows, k, every):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    out = set()
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(axis=1)
        s[ids == ids[i]] = -np.inf
        order = np.lexsort((ids, -s))[: min(k, (ids != ids[i]).sum())]
        out |= {(int(ids[i]), n + 1, int(ids[j]), round(float(s[j]), 9)) for n, j in enumerate(order)}
    return out


def test_recall_on_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    got = op6_learned_partitions(spark, "/root/testdata/sf0.1").collect()
    true = {(q, v) for q, _, v, _ in brute(rows, 20, 20)}
    assert len(got) == len(true) and len({(r.query_id, r.vec_id) for r in got} & true) / len(true) >= 0.9
    assert all(r.rank in range(1, 21) for r in got)


def test_small_tables_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(v) for v in rng.integers(-3, 4, 4)]) for i in range(1, 80)]
    good = [(i, v) for i, v in good if any(v)] + [(i, [1.0, 2.0, 0.0, -1.0]) for i in range(100, 160)]
    bad = [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan"), 1.0, 1.0, 1.0]), (204, [float("inf"), 1.0, 1.0, 1.0]), (205, [1.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0]), (220, [])]
    rows = [(i, v, 0, "x") for i, v in good + bad] + [(120, [1.0, 2.0, 0.0, -1.0], 0, "x")]
    got = search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0, 7).collect()
    assert {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got} == brute(good, 7, 5)
    few = search(spark.createDataFrame(rows[:3], SCHEMA), F.col("vec_id") % 1 == 0, 20).collect()
    assert len(few) == 6
    assert search(spark.createDataFrame([], SCHEMA), F.lit(True), 3).count() == 0


def met_and_recall(x, k=20):
    """The share of all vectors that a query meets, and the share of its k nearest among them."""
    parts = part_count(len(x))
    router = learn_router(x[: parts * SAMPLE_PER_PART], parts, k)
    home = router.parts(x, 1)[:, 0]
    asked = x[::20]
    searched = router.parts(asked, router.probes)
    met = (searched[:, :, None] == home[None, None, :]).any(axis=1)
    near = asked @ x.T
    near[np.arange(len(asked)), np.arange(0, len(x), 20)] = -np.inf
    true = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return met.mean(), np.take_along_axis(met, true, axis=1).mean()


def test_a_query_meets_a_part_of_all_vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 64))
    clustered = centres[rng.integers(0, 60, 4000)] + 0.4 * rng.normal(size=(4000, 64))
    met, recall = met_and_recall(clustered / np.linalg.norm(clustered, axis=1, keepdims=True))
    assert met < 0.4 and recall >= 0.9
    # Without any structure nearly all parts hold some of the nearest; even there not all vectors are met.
    plain = rng.normal(size=(4000, 64))
    met, recall = met_and_recall(plain / np.linalg.norm(plain, axis=1, keepdims=True))
    assert met < 0.9 and recall >= 0.9
