import numpy as np
import pytest

from calibra.llm import whitening
from calibra.llm.common import table
from calibra.llm.whitening import op12_range_finder, rayleigh_ritz, whiten

SCHEMA = "vec_id long, embedding array<double>, n string, x int"


def brute(vectors, k=16):
    """Deviations and, up to sign, whitened coordinates from all different vectors' covariance."""
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors], np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    real = e > 1e-12 * np.trace(v)
    e, u = e[real], u[:, real]
    off = n * x - sums
    return n, (off.astype(object) ** 2).sum(axis=1), np.abs(off / n @ u / np.sqrt(e)), e / np.trace(v)


def same(got, ids, vectors, k=16):
    n, deviation, whitened, explained = brute(vectors, k)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == len(ids) * len(explained) and set(by) == set(ids)
    for i, v in enumerate(ids):
        for c in range(len(explained)):
            r = by[v][c + 1]
            assert r.n == n and r.deviation == deviation[i] and r.identity_error < 1e-9
            assert abs(abs(r.whitened) - whitened[i, c]) < 1e-7 * max(1, whitened[i, c]) and abs(r.explained / explained[c] - 1) < 1e-9


def test_whole_embeddings(spark):
    sf = "/root/testdata/sf0.01"
    rows = table(spark, sf, "embeddings").collect()
    got = op12_range_finder(spark, sf).collect()
    same(got, [r.vec_id for r in rows], [r.embedding for r in rows])
    signs = {}
    for r in got:  # one sign for all rows
        signs.setdefault(r.component, []).append(r.whitened)
    whitened = np.array([signs[c] for c in sorted(signs)])
    assert np.abs(whitened @ whitened.T / len(rows) - np.eye(len(whitened))).max() < 0.05


@pytest.mark.parametrize("falling", [True, False])
def test_range_and_whole_space(spark, monkeypatch, falling):
    """Variances that fall steeply are found in a range of 24 directions; flat ones need the whole space."""
    rng = np.random.default_rng(1)
    scale = 1000 * 0.3 ** np.arange(40) if falling else np.linspace(12, 10, 40)
    vectors = (rng.normal(size=(600, 40)) * scale) @ np.linalg.qr(rng.normal(size=(40, 40)))[0]
    widths = []
    real = whitening.summed_products
    monkeypatch.setattr(whitening, "summed_products", lambda rows, of, width: widths.append(width) or real(rows, of, width))
    df = spark.createDataFrame([(i, v.tolist(), "x", 1) for i, v in enumerate(vectors)], SCHEMA)
    same(whiten(df, 6).collect(), list(range(600)), vectors, 6)
    passes = widths[1:-1]  # after the trace, before the check of the result
    assert (max(passes) == 14) is falling


def test_residuals():
    v = np.diag([9.0, 4.0, 1.0, 0.5])
    _, _, off = rayleigh_ritz(np.eye(4)[:, :2], v[:, :2], 2)
    assert off < 1e-15
    q = np.linalg.qr(np.array([[1, 0.0], [0, 1], [0.1, 0], [0, 0]]))[0]
    assert rayleigh_ritz(q, v @ q, 2)[2] > 1e-3


def test_bad_rows_copies_and_flat_tables(spark):
    good = [(i, [float(i % 7), float(i * i % 5) / 3, 2.0]) for i in range(30)]
    copies = [(40, good[0][1]), (41, good[0][1]), (5, good[6][1])]
    bad = [(50, None), (51, [1.0, None, 1.0]), (52, [float("nan"), 0.0, 1.0]), (53, [0.0, float("-inf"), 1.0]), (54, [1.0]), (55, [])]
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in good + copies[:2] + bad], SCHEMA)
    kept = good + copies[:2]
    same(whiten(df).collect(), [i for i, _ in kept], [v for _, v in kept])  # the third entry has no variance: two components
    twice = spark.createDataFrame([(i, v, "a", 1) for i, v in [*good, copies[2], (None, good[3][1])]], SCHEMA)
    got = whiten(twice).collect()
    assert len(got) == 2 * 32 and sum(r.vec_id is None for r in got) == 2
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0], "a", 1)] * 3, SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
