"""Queries without SQL, held against plain Python over the same tables."""

import math
import random
import statistics
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_phash import plain_hash

from calibra.operators import pixels as P
from calibra.operators import sessions as T
from calibra.plans import fixtures as fx
from calibra.plans import registry as Q


def picture(k):
    y, x = np.mgrid[:48, :64]
    return np.stack([(x * 3 + k) % 256, (y * 5 + 2 * k) % 256, (x + y + 7 * k) % 256], axis=-1).astype(np.uint8)


@pytest.fixture(scope="module")
def boxes(spark, sf_dir):
    """Each order's boxes in the pictures' pixels, in order."""
    out = defaultdict(list)
    for r in fx.frame(spark, sf_dir, fx.GT).orderBy("image", "gt_idx").collect():
        out[r.image].append((r.cls, (r.x, r.y, r.w / 8, r.h / 8)))
    return dict(out)


def test_picture_hashes(spark, sf_dir, boxes):
    got = {r.image: r.phash for r in Q.QUERIES["picture_hashes"](spark, sf_dir).collect()}
    assert set(got) == {f"p{k}" for k in boxes}
    for k in random.Random(1).sample(sorted(boxes), 25):
        assert got[f"p{k}"] == plain_hash(picture(k))


def plain_lab(rgb):
    linear = [c / 255 / 12.92 if c / 255 <= 0.04045 else ((c / 255 + 0.055) / 1.055) ** 2.4 for c in map(int, rgb)]
    f = []
    for row, white in zip(P.RGB_TO_XYZ.tolist(), P.WHITE.tolist()):
        t = sum(m * c for m, c in zip(row, linear)) / white
        f.append(t ** (1 / 3) if t > 216 / 24389 else (24389 / 27 * t + 16) / 116)
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def test_ring_median(spark, sf_dir, boxes):
    got = defaultdict(dict)
    for r in Q.QUERIES["ring_median"](spark, sf_dir).collect():
        got[r.image][r.box] = (r.ring_pixels, r.ring_a, r.ring_b, r.plate_chroma)
    assert {k: len(v) for k, v in got.items()} == {f"p{k}": len(b) for k, b in boxes.items()}
    for k in random.Random(2).sample(sorted(boxes), 12):
        rgb = picture(k)
        lab = {(i, j): plain_lab(rgb[j, i]) for j in range(48) for i in range(64)}
        within = lambda i, j, b: b[0] <= i + 0.5 < b[0] + b[2] and b[1] <= j + 0.5 < b[1] + b[3]
        for n, (_, (x, y, w, h)) in enumerate(boxes[k]):
            m = max(8.0, max(w, h) / 4)
            around = [p for p in lab if within(*p, (x - m, y - m, w + 2 * m, h + 2 * m)) and not any(within(*p, b) for _, b in boxes[k]) and rgb[p[1], p[0]].max() > 0]
            middle = [p for p in lab if within(*p, (x + 0.2 * w, y + 0.2 * h, 0.6 * w, 0.6 * h))]
            a, b = ([statistics.median(lab[p][c] for p in around) for c in (1, 2)] if len(around) >= 150 else (None, None))
            chroma = statistics.median(math.hypot(*lab[p][1:]) for p in middle) if middle else None
            for have, want in zip(got[f"p{k}"][n], (len(around), a, b, chroma)):
                assert have == (want if want is None else pytest.approx(want, abs=2e-6))


def overlap(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    shared = max(0.0, w) * max(0.0, h)
    return shared / (a[2] * a[3] + b[2] * b[3] - shared)


def test_recoloured_arms(spark, sf_dir, boxes):
    counts, clipped = Counter(), defaultdict(list)
    for k, own in boxes.items():
        target = next((i for i, (c, _) in enumerate(own) if c == "k00"), None)
        if target is None:
            continue
        rgb, places = picture(k), [b for _, b in own]
        for arm, (kind, colour) in P.ARMS.items():
            mask = P.outside(rgb, places) if kind == "whole" else P.ring((48, 64), places[target], places) & (rgb.max(axis=-1) > 0)
            altered, lost = P.recolour(rgb, mask, Q.COLOURS[colour] if colour else None)
            taken = {}
            for i, (cls, conf, *b) in sorted(enumerate(Q.grid_model(altered)), key=lambda d: (-d[1][1], d[0])):
                free = [(overlap(b, g), j) for j, g in enumerate(places) if j not in taken and overlap(b, g) >= 0.5]
                if free:
                    taken[max(free)[1]] = cls if conf >= Q.AT else None
            outcome = taken.get(target) or "missed"
            counts[arm, outcome] += 1
            clipped[arm, outcome].append(lost)
    got = {(r.arm, r.outcome): (r.n, r.median_clipped) for r in Q.QUERIES["recoloured_arms"](spark, sf_dir).collect()}
    assert {k: n for k, (n, _) in got.items()} == dict(counts) and len({o for _, o in got}) == 3
    for key, (_, median) in got.items():
        assert median == pytest.approx(statistics.median(clipped[key]), abs=2e-6)


def test_bootstrap_ci(spark, sf_dir):
    by = defaultdict(lambda: ([], []))
    for r in fx.frame(spark, sf_dir, fx.MEASURES).collect():
        by[r.image][r.grp == "correct"].append(r.value)
    names, drawing, found = sorted(by), random.Random(20260925), []
    for _ in range(200):
        drawn = [by[n] for n in drawing.choices(names, k=len(names))]
        pos, neg = ([v for d in drawn for v in d[i]] for i in (0, 1))
        found.append(sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg)))
    got = Q.QUERIES["bootstrap_ci"](spark, sf_dir).first()
    assert (got.low, got.high, got.used, got.skipped) == (*(pytest.approx(v, abs=2e-6) for v in np.percentile(found, [2.5, 97.5])), 200, 0)


def chosen(spark, sf_dir):
    """Sessions, test days and the validation sessions of all 2,000 trials, by plain Python."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "ts", "event_type").orderBy("at", "event_id").collect()
    session, before, rows = 0, None, []
    for r in events:
        session += before is None or r.at - before > 300_000_000
        before = r.at
        rows.append((f"d{(r.ts.date() - date(2020, 1, 1)).days // 5 % 7}", session, r.at, r.event_type))
    dates = set(Q.QUERIES["test_date_choice"](spark, sf_dir).first().dates.split(","))
    pool = [r for r in rows if r[0] not in dates]
    sizes, first = Counter(s for _, s, _, _ in pool), {}
    for _, s, at, _ in pool:
        first[s] = min(first.get(s, at), at)
    cover = Counter((s, c) for _, s, _, c in pool)
    ids = sorted(sizes, key=lambda s: (first[s], s))
    low, high = T.VAL_SHARE[0] * len(rows), T.VAL_SHARE[1] * len(rows)
    rng, best = np.random.default_rng(T.VAL_SEED), None
    for t in range(T.VAL_TRIALS):
        taken, total = [], 0
        for p in rng.permutation(len(ids)):
            if total + sizes[ids[p]] <= high:
                taken.append(ids[p])
                total += sizes[ids[p]]
            if total >= low:
                break
        if low <= total <= high:
            score = min(sum(cover[s, c] for s in taken) for c in ("click", "purchase", "view"))
            if best is None or score > best[1]:
                best = t, score, set(taken)
    return rows, dates, best


def test_validation_choice_and_split(spark, sf_dir):
    rows, dates, (trial, score, sessions) = chosen(spark, sf_dir)
    got = Q.QUERIES["val_session_choice"](spark, sf_dir).collect()
    assert {(r.trial, r.score) for r in got} == {(trial, score)} and {r.session for r in got} == sessions
    split = [("test" if d in dates else "val" if s in sessions else "train", s) for d, s, _, _ in rows]
    want = {k: (sum(p == k for p, _ in split), len({s for p, s in split if p == k})) for k in ("test", "val", "train")}
    assert {r.split: (r.images, r.sessions) for r in Q.QUERIES["split_assignment"](spark, sf_dir).collect()} == want


def test_no_validation_part_where_sessions_are_too_large(spark, tmp_path):
    """A session a day, each a seventh of the events or more: none fits, as in tables of ten times the events."""
    start = datetime(2020, 1, 1)
    events = [(i, start + timedelta(days=i // 1000, seconds=i % 1000), ("click", "purchase", "view")[i % 3]) for i in range(5500)]
    spark.createDataFrame([(i, at + timedelta(days=4 * (at - start).days), kind) for i, at, kind in events], "event_id long, ts timestamp_ntz, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert Q.QUERIES["val_session_choice"](spark, str(tmp_path)).collect() == []
    got = {r.split: (r.images, r.sessions) for r in Q.QUERIES["split_assignment"](spark, str(tmp_path)).collect()}
    assert got == {"test": (1000, 1), "train": (4500, 5)}
