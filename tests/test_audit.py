import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.functions import scalars as S
from calibra.operators import near_dup as N
from calibra.operators import sessions as T


def test_names_and_exclusions(spark):
    rows = [("IMG_20251106_130044.jpg", 1, False), ("IMG_20251106_130044_BURST001_COVER.jpg", 1, True), ("ZE_3.png", 0, False), ("3.jpg", 0, False), ("31.webp", 2, False), ("VID_20251340_999999.mp4", 1, False), ("PXL_20250101_000000.jpg", 0, True)]
    df = spark.createDataFrame(rows, "file string, n int, conflict boolean")
    at = S.captured_at(F.col("file"))
    got = df.select(F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"), S.exclusion(F.col("file"), at, F.col("n"), F.col("conflict")).alias("why")).collect()
    assert [r.at for r in got] == ["2025-11-06 13:00:44"] * 2 + [None] * 4 + ["2025-01-01 00:00:00"]
    assert [r.why for r in got] == ["", "double_labelled", "third_party_video", "third_party_press", "third_party_press", "third_party_press", "no_boxes"]


def test_counts_and_basename(spark):
    r = spark.createDataFrame([(["b", "a", "b"], "x\\y/z.pt")], "c array<string>, p string").select(S.format_counts(S.box_counts(F.col("c"))).alias("t"), S.basename(F.col("p")).alias("n")).first()
    assert (r.t, r.n) == ("a:1;b:2", "z.pt")
    assert spark.createDataFrame([(r.t,), ("",)], "t string").select(S.parse_counts(F.col("t")).alias("m")).collect()[0].m == {"a": 1, "b": 2}


def test_wilson(spark):
    got = spark.createDataFrame([(3, 10), (0, 0), (10, 10)], "k int, n int").select(S.wilson(F.col("k"), F.col("n")).alias("w")).collect()
    assert got[0].w.low < 0.3 < got[0].w.high and tuple(got[1].w) == (0, 0) and got[2].w.high == 1


@pytest.mark.parametrize("bits, most", [(64, 5), (256, 20), (256, 30)])
def test_banded_join_and_leakage(spark, bits, most):
    rng = np.random.default_rng(most)
    base = rng.integers(0, 2, (40, bits))
    rows = np.concatenate([base, base[:10], *(base ^ (rng.random(base.shape) < p) for p in (0.02, 0.06, 0.12))])
    splits = [f"s{rng.integers(3)}" for _ in rows]
    words = [[int("".join(map(str, r[k : k + 32])), 2) for k in range(0, bits, 32)] for r in rows]
    frame = spark.createDataFrame([(i, w, s) for i, (w, s) in enumerate(zip(words, splits, strict=True))], "id long, words array<long>, split string")
    dist = (rows[:, None, :] != rows[None]).sum(axis=2)
    members = N.classes(frame.select("id", "words"))
    pairs = N.hamming_pairs(members, bits, most)
    first = {i: int(np.flatnonzero(dist[i] == 0)[0]) for i in range(len(rows))}
    want = {(i, j, int(dist[i, j])) for i in range(len(rows)) for j in range(i + 1, len(rows)) if 0 < dist[i, j] <= most and first[i] == i and first[j] == j}
    assert {tuple(r) for r in pairs.collect()} == want and want
    other = np.array([[a != b for b in splits] for a in splits])
    cross = {}
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if dist[i, j] <= most and other[i, j]:
                key = tuple(sorted((splits[i], splits[j])))
                cross[key] = cross.get(key, 0) + 1
    assert {(r.one, r.other): r.pairs for r in N.cross_split_pairs(members, pairs, frame.select("id", "split")).collect()} == cross
    np.fill_diagonal(dist, 10_000)
    near = dist.min(axis=1)
    twin, tied = near <= most, dist == near[:, None]
    any_other = ((dist <= most) & other).any(axis=1)
    counts = [len(rows), twin.sum(), (twin & (tied.sum(axis=1) > 1)).sum(), (twin & other[np.arange(len(rows)), dist.argmin(axis=1)]).sum(), (twin & ~(tied & ~other).any(axis=1)).sum(), (twin & (tied & other).any(axis=1)).sum(), any_other.sum()]
    assert list(N.leakage(members, pairs, frame.select("id", "split")).first()) == [int(c) for c in counts]


def test_hex_words(spark):
    r = spark.createDataFrame([("ffffffff00000001" + "0" * 48, "fffffffe00000001" + "0" * 48)], "a string, b string").select(S.hex_words(F.col("a")).alias("w"), S.hamming(S.hex_words(F.col("a")), S.hex_words(F.col("b"))).alias("d")).first()
    assert r.w[:2] == [0xFFFFFFFF, 1] and len(r.w) == 8 and r.d == 1


def test_sessions_over_slices_and_merge(spark):
    rnd, at, rows, want, n = random.Random(4), datetime(2025, 1, 1), [], {}, 1
    for i in range(300):
        gap = rnd.choice([1, 2, 5, 5.001, 9])
        if i and gap > 5:
            n += 1
        at += timedelta(minutes=gap if i else 0)
        rows.append((i, at))
        want[i] = n
    frame = spark.createDataFrame(rows, "id long, ts timestamp")
    for slices in (1, 7, 64):
        assert {r.id: r.session for r in T.sessionize(frame, slices=slices).collect()} == want
    near = spark.createDataFrame([(0, 299), (299, 150), (10, 11)], "a long, b long")
    merged = {r.id: r.session for r in T.merge_sessions(T.sessionize(frame), near).collect()}
    assert merged[0] == merged[299] == merged[150] == 1
    assert len(set(merged.values())) == n - len({want[0], want[150], want[299]}) + 1 - (want[10] != want[11])
    assert sorted(set(merged.values())) == list(range(1, len(set(merged.values())) + 1))


def plain_val_sessions(pool, classes, n, trials):
    """The seeded trials one after another: sessions in order of time, taken while they fit, up to the least share."""
    rows = {}
    for r in pool:
        rows.setdefault(r.session, []).append(r)
    order = sorted(rows, key=lambda s: (min(r.ts for r in rows[s]), s))
    rng, best = np.random.default_rng(T.VAL_SEED), None
    for t in range(trials):
        taken, total = [], 0
        for p in rng.permutation(len(order)):
            if total >= T.VAL_SHARE[0] * n:
                break
            if total + len(rows[order[p]]) <= T.VAL_SHARE[1] * n:
                taken.append(order[p])
                total += len(rows[order[p]])
        score = min(sum(c in r.classes for s in taken for r in rows[s]) for c in classes)
        if T.VAL_SHARE[0] * n <= total <= T.VAL_SHARE[1] * n and (best is None or score > best[1]):
            best = t, score, sorted(taken)
    return [(best[0], best[1], s) for s in best[2]]


def test_split_choice(spark):
    rows = [(i, f"d{i % 5}", ["a", "b"] if i % 2 else ["a"], datetime(2025, 1, 1) + timedelta(minutes=10 * i), i // 5 + 1) for i in range(700)]
    frame = spark.createDataFrame(rows, "id long, day string, classes array<string>, ts timestamp, session long")
    dates = T.test_dates(frame, ["a", "b"])
    got = dates.first()
    assert got.dates == ["d0"] and got.images == 140
    with pytest.raises(Exception, match="no set of dates"):
        T.test_dates(frame, ["a", "b"], test_least=1000).collect()
    pool = frame.join(dates.select(F.explode("dates").alias("day")), "day", "left_anti")
    val = T.val_sessions(pool, ["a", "b"], 700, trials=40)
    assert [(r.trial, r.score, r.session) for r in val.collect()] == plain_val_sessions(pool.collect(), ["a", "b"], 700, 40)
    with pytest.raises(Exception, match="no trial reaches"):
        T.val_sessions(pool, ["a", "b"], 7, trials=40).collect()
    out = {r.split: r["count"] for r in T.assign(frame.withColumn("exclusion", F.when(F.col("id") == 699, "no_boxes").otherwise("")), dates, val).groupBy("split").count().collect()}
    assert out["excluded"] == 1 and out["test"] == 140 and 0.12 * 700 - 1 <= out["val"] <= 0.17 * 700
