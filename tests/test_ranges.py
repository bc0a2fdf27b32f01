import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.operators import near_dup as N
from calibra.operators import sessions as T
from calibra.operators import statistics as X
from calibra.operators.ranges import numbered, running


@pytest.mark.parametrize("slices", [1, 7])
def test_running_sums_of_a_large_key_small_keys_and_nulls(spark, slices):
    rnd = random.Random(slices)
    rows = [("hot", i, rnd.choice([None, 1, 5])) for i in range(300)] + [(k, i, i) for k in ("a", "b", None) for i in range(4)] + [("one", None, 3)]
    df = spark.createDataFrame(rnd.sample(rows, len(rows)), "key string, at int, v int")
    got = {(r.key, r.at): (r.total, r.n) for r in running(df, ["key"], [F.desc_nulls_first("at")], {"total": F.col("v"), "n": F.lit(1)}, slices).collect()}
    want = {}
    for key, own in itertools.groupby(sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, -(r[1] or 0))), key=lambda r: r[0]):
        total = n = 0
        for _, at, v in own:
            total, n = total + (v or 0), n + 1
            want[key, at] = (total, n)
    assert got == want


def test_numbers_without_gaps(spark):
    df = spark.createDataFrame([(i % 3, 1000 - i) for i in range(500)], "part int, id int")
    got = sorted((r.part, r.place, r.id) for r in numbered(df, ["part"], [F.col("id")], "place", slices=9).collect())
    assert got == sorted((p, k, i) for p in range(3) for k, i in enumerate(sorted(1000 - j for j in range(500) if j % 3 == p)))
    assert [r.n for r in numbered(df.limit(5), [], [F.col("id")], "n", 1).orderBy("id").collect()] == [1, 2, 3, 4, 5]
    assert numbered(df.limit(0), ["part"], [F.col("id")], "n").count() == 0


@pytest.mark.parametrize("total, most, n", [(64, 16, 50), (64, 16, 5_000), (64, 16, 10**7), (64, 5, 1000), (256, 20, 100), (256, 30, 10**8), (64, 0, 10), (32, 31, 10)])
def test_bands_cover_all_bits_and_every_difference(total, most, n):
    plan = N.band_plan(total, most, n)
    ends = [lo for lo, _, _ in plan[1:]] + [total]
    assert plan[0][0] == 0 and all(w == min(end - lo, 62) for (lo, w, _), end in zip(plan, ends))
    assert sum(r + 1 for _, _, r in plan) == most + 1


def test_plans_for_more_hashes_compare_fewer_of_the_pairs():
    share = [sum(N.ball(w, r) / 2**w for _, w, r in N.band_plan(64, 16, n)) for n in (50, 2_000, 20_000, 10**7)]
    assert share == sorted(share, reverse=True) and share[0] > 1 and share[2] < 0.25 and share[3] < 0.1


@pytest.mark.parametrize("planned", [2_000, 20_000])
def test_pairs_with_probes_of_several_bits(spark, monkeypatch, planned):
    """As on tables of that size: bands whose values are looked up within one and two bits."""
    real = N.band_plan
    monkeypatch.setattr(N, "band_plan", lambda total, most, n: real(total, most, planned))
    rng = np.random.default_rng(planned)
    base = rng.integers(0, 2, (30, 64))
    bits = np.concatenate([base, base ^ (rng.random(base.shape) < 0.15), base ^ (rng.random(base.shape) < 0.25)])
    words = [[int("".join(map(str, r[k : k + 32])), 2) for k in (0, 32)] for r in bits]
    members = N.classes(spark.createDataFrame(list(enumerate(words)), "id long, words array<long>"))
    got = [tuple(r) for r in N.hamming_pairs(members, 64, 16).collect()]
    dist = (bits[:, None] != bits[None]).sum(axis=2)
    want = {(i, j, int(dist[i, j])) for i in range(len(bits)) for j in range(i + 1, len(bits)) if dist[i, j] <= 16}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30


def components(n, links):
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_links_have_the_components_of_all_pairs(spark):
    """A crowd of near hashes, chains, and copies; far fewer links than pairs."""
    rng = np.random.default_rng(8)
    crowd = rng.integers(0, 2, 64) ^ (rng.random((120, 64)) < 0.08)
    chain = [rng.integers(0, 2, 64)]
    for _ in range(20):
        flip = np.zeros(64, int)
        flip[rng.permutation(64)[:15]] = 1
        chain.append(chain[-1] ^ flip)
    bits = np.concatenate([crowd, np.array(chain), crowd[:10], rng.integers(0, 2, (30, 64))]).astype(int)
    words = [[int("".join(map(str, r[k : k + 32])), 2) for k in (0, 32)] for r in bits]
    members = N.classes(spark.createDataFrame(list(enumerate(words)), "id long, words array<long>"))
    links = [tuple(r) for r in N.hamming_links(members, 64, 16).collect()]
    dist = (bits[:, None] != bits[None]).sum(axis=2)
    pairs = [(i, j) for i in range(len(bits)) for j in range(len(bits)) if i < j and dist[i, j] <= 16]
    assert all(dist[a, b] <= 16 for a, b in links)
    assert components(len(bits), links) == components(len(bits), pairs) and len(links) < len(pairs) / 2


@pytest.mark.parametrize("bits, most", [(64, 16), (96, 20), (256, 60)])
def test_hashes_meet_part_by_part(spark, monkeypatch, bits, most):
    """Several parts and steps, ids of text: all pairs once, and of the links fewer than two parts have hashes."""
    monkeypatch.setattr(N, "TILE", 40)
    monkeypatch.setattr(N, "STEP", 7)
    rng = np.random.default_rng(bits)
    crowd = rng.integers(0, 2, bits) ^ (rng.random((80, bits)) < 0.08)
    base = rng.integers(0, 2, (40, bits))
    rows = np.concatenate([crowd, base, base ^ (rng.random(base.shape) < 0.15), 1 - base[:3], crowd[:5]]).astype(int)
    assert N.in_tiles(bits, most, len(rows))
    words = [[int("".join(map(str, r[k : k + 32])), 2) for k in range(0, bits, 32)] for r in rows]
    members = N.classes(spark.createDataFrame([(f"p{i:03d}", w) for i, w in enumerate(words)], "id string, words array<long>"))
    dist = (rows[:, None] != rows[None]).sum(axis=2)
    alike = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if dist[i, j] <= most]
    first = {i: int(np.flatnonzero(dist[i] == 0)[0]) for i in range(len(rows))}
    got = [(int(r.a[1:]), int(r.b[1:]), r.dist) for r in N.hamming_pairs(members, bits, most).collect()]
    assert sorted(got) == sorted((i, j, int(dist[i, j])) for i, j in alike if first[i] == i and first[j] == j) and len(got) > 3000
    links = [(int(r.a[1:]), int(r.b[1:])) for r in N.hamming_links(members, bits, most).collect()]
    parts = -(-len(set(first.values())) // 40)
    assert all(dist[a, b] <= most for a, b in links) and len(links) <= parts * len(rows)
    assert components(len(rows), links) == components(len(rows), alike)


def test_many_hashes_with_a_wide_radius_are_not_looked_up(spark):
    """100,000 hashes of 64 bits at 16 had 1,019 look-ups each, and as many rows in a shuffle."""
    assert all(N.in_tiles(64, 16, n) for n in (1, 1000, 100_000, 600_000))
    assert not N.in_tiles(256, 20, 10_000)
    rng = np.random.default_rng(3)
    members = N.classes(spark.createDataFrame([(i, [int(w) for w in rng.integers(0, 2**32, 2)]) for i in range(3000)], "id long, words array<long>"))
    for found in (N.hamming_pairs(members, 64, 16), N.hamming_links(members, 64, 16)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "transform(" not in plan and "Join Inner, (k" not in plan


@pytest.mark.parametrize("planned", [2_000, 20_000])
def test_bands_find_what_parts_find(spark, monkeypatch, planned):
    rng = np.random.default_rng(planned)
    base = rng.integers(0, 2, (30, 64))
    rows = np.concatenate([base, base ^ (rng.random(base.shape) < 0.15), base ^ (rng.random(base.shape) < 0.25), base[0] ^ (rng.random((50, 64)) < 0.05)])
    members = N.classes(spark.createDataFrame([(i, [int("".join(map(str, r[k : k + 32])), 2) for k in (0, 32)]) for i, r in enumerate(rows)], "id long, words array<long>"))
    found = lambda f: [tuple(r) for r in f(members, 64, 16).collect()]
    pairs, links, real = found(N.hamming_pairs), found(N.hamming_links), N.band_plan
    monkeypatch.setattr(N, "in_tiles", lambda total, most, n: False)
    monkeypatch.setattr(N, "band_plan", lambda total, most, n: real(total, most, planned))
    assert sorted(found(N.hamming_pairs)) == sorted(pairs)
    assert components(len(rows), found(N.hamming_links)) == components(len(rows), links)


def test_resamples_from_stored_states_are_those_of_one_generator(spark):
    drawing, want = random.Random(11), {}
    for rep in range(40):
        for p in drawing.choices(range(23), k=23):
            want[rep, p] = want.get((rep, p), 0) + 1
    got = {}
    for r in X.resamples(spark, 23, 40, 11, block=57).collect():  # blocks end within resamples
        got[r.rep, r.place] = got.get((r.rep, r.place), 0) + r.times
    assert got == want


def test_permutations_from_stored_states_are_those_of_one_generator(spark):
    rng = np.random.default_rng(26)
    want = {(t, k, int(p)) for t in range(30) for k, p in enumerate(rng.permutation(37)) if 5 <= k < 20}
    assert {tuple(r) for r in T.permuted(spark, 37, 30, 26, 5, 20, block=7).collect()} == want
    assert all(json.loads(state)["bit_generator"] == "PCG64" for _, _, state in T.permutation_states(5, 3, 1, 1))


@pytest.mark.parametrize("sessions", [40, 400])
def test_validation_choice_against_plain_python(spark, sessions):
    rnd = random.Random(sessions)
    pool = [(i, s, f"2025-01-01 00:{s % 60:02d}:{s // 60:02d}", rnd.sample(["a", "b", "c"], rnd.randint(0, 3))) for s in range(sessions) for i in range(s * 100, s * 100 + rnd.choice([1, 3, 9]))]
    df = spark.createDataFrame(pool, "id int, session int, ts string, classes array<string>")
    n = int(len(pool) * 1.2)
    sizes, first, cover = {}, {}, {}
    for _, s, ts, classes in pool:
        sizes[s] = sizes.get(s, 0) + 1
        first[s] = min(first.get(s, ts), ts)
        for c in classes:
            cover[s, c] = cover.get((s, c), 0) + 1
    ids = sorted(sizes, key=lambda s: (first[s], s))
    low, high = T.VAL_SHARE[0] * n, T.VAL_SHARE[1] * n
    rng, best = np.random.default_rng(T.VAL_SEED), None
    for t in range(200):
        taken, total = [], 0
        for p in rng.permutation(len(ids)):
            if total + sizes[ids[p]] <= high:
                taken.append(ids[p])
                total += sizes[ids[p]]
            if total >= low:
                break
        if low <= total <= high:
            score = min(sum(cover.get((s, c), 0) for s in taken) for c in "abc")
            if best is None or score > best[1]:
                best = t, score, sorted(taken)
    got = T.val_sessions(df, ["a", "b", "c"], n, trials=200).collect()
    assert ({r.trial for r in got}, {r.score for r in got}, sorted(r.session for r in got)) == ({best[0]}, {best[1]}, best[2])
