import json
import math
import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.operators import pixels as P
from calibra.operators import rules as R
from calibra.operators import statistics as X

ROWS = "grp string, value double, image string"


def test_auc_and_within(spark):
    df = spark.createDataFrame([("p", 3.0, "x"), ("p", 2.0, "x"), ("q", 1.0, "x"), ("q", 2.0, "y")], ROWS)
    assert X.auc(df, "p", "q").first().auc == 0.875
    assert math.isnan(X.auc(df.filter("grp = 'q'"), "p", "q").first().auc)
    w = X.within_groups(df, "p", "q", "image").first()
    assert (w.clusters, w.pairs, w.auc) == (1, 2, 1.0)


def test_bootstrap_against_plain_python(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("pq"), float(rnd.randint(0, 9)), f"c{rnd.randint(0, 6)}") for _ in range(60)] + [("p", 1.0, "lonely")]
    got = X.bootstrap_auc(spark.createDataFrame(rows, ROWS), "p", "q", "image", 60, 5).first()
    ids = sorted({r[2] for r in rows})
    found = []
    drawing = random.Random(5)
    for _ in range(60):
        places = drawing.choices(range(len(ids)), k=len(ids))
        drawn = [r for k in places for r in rows if r[2] == ids[k]]
        pos, neg = ([v for g, v, _ in drawn if g == k] for k in "pq")
        if pos and neg:
            found.append(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)))
    assert (got.used, got.skipped) == (len(found), 60 - len(found))
    assert (got.low, got.high) == pytest.approx(tuple(np.percentile(found, [2.5, 97.5])))


@pytest.mark.parametrize("b, c, p", [(0, 0, 1.0), (10, 0, 2**-10), (8, 2, 56 / 1024), (26, 0, 1.4901161193847656e-08), (300, 250, None)])
def test_binomial_tail(spark, b, c, p):
    got = spark.range(1).select(X.binomial_tail(F.lit(b), F.lit(c)).alias("p")).first().p
    assert got == pytest.approx(sum(math.comb(b + c, k) for k in range(c + 1)) / 2 ** (b + c) if p is None else p, rel=1e-9)


def test_paired_refuses_other_boxes(spark):
    a = spark.createDataFrame([("i", 0, True), ("j", 0, False)], "image string, gt_idx int, m0 boolean")
    assert X.paired(a, a, F.col("m0")).first().asDict() == {"b": 0, "c": 0, "misread_c": 1, "misread_t": 1, "p": 1.0}
    with pytest.raises(Exception, match="same boxes"):
        X.paired(a, a.limit(1), F.col("m0")).collect()


def test_rules(spark):
    def one(c):
        return spark.range(1).select(c.alias("c")).first().c

    lit = lambda *v: [F.lit(x) for x in v]
    assert [one(R.backdrop(*lit(20, 20, 9, 9, *v))) for v in ((0.8, 0.6, 0.9), (0.2, 0.1, 0.4), (0.5, 0.4, 0.6), (0.6, 0.2, 0.8), (0.8, 0.5, 0.9))] == ["for", "reversed", "against", "inconclusive", "inconclusive"]
    assert one(R.backdrop(*lit(14, 20, 9, 9, 0.8, 0.6, 0.9))) == "inconclusive"
    assert [one(R.recolour(*lit(40, *v))) for v in ((0, 0, 3), (20, 0, 0), (0, 20, 0), (4, 4, 0), (5, 0, 0))] == ["pipeline noise", "for (local)", "for (scene)", "against", "inconclusive"]
    assert one(R.gate(F.lit(3), F.lit("for"))) == "no verdict"
    cases = [((20, 0, 0, 0, 0.0, True), "void"), ((51, 40, 25, 72, 1e-8, True), "fixed"), ((51, 40, 25, 72, 1e-8, False), "fixed at a cost"), ((51, 40, 25, 41, 1e-8, True), "displaced"), ((51, 40, 26, 72, 1e-8, True), "not fixed"), ((51, 40, 25, 72, 0.05, True), "not fixed")]
    assert [one(R.run_decision(*lit(*v), F.lit(True))) for v, _ in cases] == [w for _, w in cases]
    assert one(R.run_decision(*lit(51, 40, 25, 72, 1e-8, True), F.lit(False))) == "invalid"
    before = spark.createDataFrame([("map", 0.74), ("val", 0.82), ("a", 0.70), ("b", 0.70), ("skip", 0.9)], "name string, score double")
    after = spark.createDataFrame([("map", 0.72), ("val", 0.79), ("a", 0.65), ("b", 0.64), ("skip", 0.1)], "name string, score double")
    assert {r.name: r.ok for r in R.guardrails(before, after, ["skip"]).collect()} == {"map": True, "val": False, "a": True, "b": False}


def test_config_diff(spark):
    one = {"train": {"lr": 0.1, "sizes": [1, 2], "out": "/a/x.pt", "none": None}, "seed": 1}
    other = {"train": {"lr": 0.2, "sizes": [1, 2], "out": "/b/x.pt", "none": None, "new": 3}, "seed": 1}
    flat = R.flatten(spark.createDataFrame([("a", json.dumps(one)), ("b", json.dumps(other))], "run string, config string")).cache()
    assert flat.filter("run = 'a'").count() == 5
    got = {r.path: (r.one, r.other, r.allowed) for r in R.config_diff(flat.filter("run = 'a'"), flat.filter("run = 'b'"), ["new"], ["train.out"]).collect()}
    assert got == {"train.lr": ("0.1", "0.2", False), "train.new": (None, "3", True)}
    with pytest.raises(Exception, match="not done"):
        R.required(flat, F.lit(False), "not done").collect()


def test_colours(spark):
    known = {(255, 255, 255): (100, 0, 0), (0, 0, 0): (0, 0, 0), (255, 255, 0): (97.14, -21.55, 94.48), (0, 0, 255): (32.30, 79.19, -107.86)}
    for rgb, lab in known.items():
        assert P.to_lab(np.array([rgb]))[0] == pytest.approx(lab, abs=0.02)
    cube = np.random.default_rng(1).integers(0, 256, (500, 3))
    assert np.abs(P.to_rgb(P.to_lab(cube)) - cube).max() < 1e-3
    rows = spark.createDataFrame([tuple(map(float, c)) for c in cube[:50].tolist()], "r double, g double, b double")
    got = rows.select(P.lab_columns(F.col("r"), F.col("g"), F.col("b")).alias("x")).collect()
    assert np.allclose([tuple(r.x) for r in got], P.to_lab(cube[:50]), atol=1e-9)


def test_masks_recolour_and_measure(spark):
    rng = np.random.default_rng(3)
    rgb = rng.integers(1, 255, (100, 100, 3)).astype(np.uint8)
    box, near = (10, 10, 8, 40), (18, 10, 8, 40)
    mask = P.ring((100, 100), box, [box, near])
    assert not mask[20, 12] and not mask[20, 20] and mask[5, 12] and not mask[70, 70]
    same, clipped = P.recolour(rgb, mask, None)
    assert np.abs(same.astype(int) - rgb).max() <= 1 and (same[~mask] == rgb[~mask]).all() and clipped == 0
    blue, _ = P.recolour(rgb, mask, (0.0, -20.0))
    assert (blue[~mask] == rgb[~mask]).all() and np.median(P.to_lab(blue[mask])[:, 2]) < -5
    assert [(a, p.shape) for a, p, _ in P.arm_pictures(rgb, box, [box], ["sham"], {})] == [("sham", rgb.shape)]
    targets = {"blue": (20.0, -40.0), "yellow": (0.0, 40.0)}
    fresh = {arm: p for arm, p, _ in P.arm_pictures(rgb, box, [box], list(P.ARMS), targets)}
    assert (fresh["ring"] == fresh["keep"]).all() and (fresh["ring"] != fresh["reverse"]).any() and (fresh["whole"] != fresh["ring"]).any()
    ((_, again, _),) = P.arm_pictures(fresh["ring"], box, [box], ["ring"], targets)
    changed = (fresh["ring"] != rgb).any(axis=-1)
    assert np.median(P.to_lab(again[changed])[:, 2]) < -20 < 20 < np.median(P.to_lab(fresh["reverse"][changed])[:, 2])  # what is blue already stays blue
    schema = "image string, width int, height int, data binary, boxes array<struct<cls: string, x: double, y: double, w: double, h: double>>"
    grey = np.full((60, 80, 3), 128, np.uint8)
    rows = [("g", 80, 60, bytearray(grey.tobytes()), [("a", 20.0, 20.0, 10.0, 10.0), ("a", 0.0, 0.0, 80.0, 60.0)]), ("black", 80, 60, bytearray(80 * 60 * 3), [("a", 20.0, 20.0, 10.0, 10.0)])]
    got = {(r.image, r.box): r for r in P.measure(spark.createDataFrame(rows[:1] + rows[1:], schema)).collect()}
    assert got["g", 0].ring_b is None and got["black", 0].ring_b is None  # the second box covers all
    got = P.measure(spark.createDataFrame([("g", 80, 60, rows[0][3], rows[0][4][:1])], schema)).first()
    assert got.ring_pixels == 26 * 26 - 100 and abs(got.ring_b) < 0.01
    with pytest.raises(Exception, match="is not 81"):
        P.measure(spark.createDataFrame([("g", 81, 60, rows[0][3], [])], schema)).collect()
    found = P.predict(spark.createDataFrame(rows[:1], schema), lambda a: [("a", float(a.mean()) / 255, 0.0, 0.0, 1.0, 1.0)]).first()
    assert found.cls == "a" and abs(found.conf - 128 / 255) < 1e-9


def test_epochs_medians_and_streams(spark, tmp_path):
    e = X.best_epoch(spark.createDataFrame([(1, 0.5, None), (2, 0.7, 0.9), (3, 0.9, 0.9)], "epoch long, val double, ema double")).first()
    assert (e.epoch, e.score) == (2, 0.9)
    m = X.median_targets(spark.createDataFrame([(1.0, 0.0), (2.0, -1.0), (3.0, -9.0), (None, None)], "a double, b double")).first()
    assert (m.n_blue, m.b_blue, m.n_yellow, m.unmeasurable) == (3, -1.0, 0, 1) and math.isnan(m.b_yellow)
    from calibra.streaming.live import live_outcomes, live_sessions

    at = datetime(2025, 1, 1)
    rows = spark.createDataFrame([("u", at), ("u", at + timedelta(minutes=5)), ("u", at + timedelta(minutes=11)), ("u", at + timedelta(days=1))], "k string, ts timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = live_sessions(stream, "k").writeStream.format("memory").queryName("live").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert sorted(r.events for r in spark.table("live").collect()) == [1, 2]
    assert live_outcomes(spark.createDataFrame([("a", "b"), ("a", "b")], "truth string, pred string")).first().n == 2


def test_arms_in_one_row_each_hold_what_predict_arms_explodes(spark):
    rgb = np.random.default_rng(3).integers(0, 256, (40, 60, 3)).astype(np.uint8)
    model = lambda p: [("a", float(p.mean()) / 255, 1.0, 2.0, 3.0, 4.0), ("b", 0.5, 0.0, 0.0, 1.0, 1.0)]
    columns = "image string, width int, height int, data binary, boxes array<struct<cls: string, x: double, y: double, w: double, h: double>>, target int, arms array<string>"
    frame = spark.createDataFrame([("p", 60, 40, bytearray(rgb.tobytes()), [("a", 20.0, 15.0, 8.0, 6.0)], 0, ["ring", "sham", "whole"])], columns)
    targets = {"blue": (5.0, -30.0), "yellow": (0.0, 45.0)}
    nested = {r.arm: r for r in P.read_arms(frame, targets, model).collect()}
    flat = P.predict_arms(frame, targets, model).collect()
    for arm, altered, clipped in P.arm_pictures(rgb, (20.0, 15.0, 8.0, 6.0), [(20.0, 15.0, 8.0, 6.0)], ["ring", "sham", "whole"], targets):
        assert nested[arm].clipped == clipped and [tuple(d)[1:] for d in nested[arm].found] == model(altered)
        assert [(r.pred_idx, r.cls) for r in flat if r.arm == arm] == [(-1, None), (0, "a"), (1, "b")]
    assert P.to_lab(rgb) == pytest.approx(P.to_lab(rgb.astype(float)), abs=1e-12)


def test_bootstrap_keeps_ranges_of_values_apart(spark, monkeypatch):
    """The counts stay in the ranges' partitions, without a shuffle by resample, and are the same with one."""
    rows = spark.range(600).selectExpr("if(id % 3 = 0, 'a', 'b') AS grp", "CAST((id * 37) % 101 AS DOUBLE) AS value", "id % 7 AS image")
    few = X.bootstrap_auc(rows, "a", "b", "image", 20, 5)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(rep#\d+L?, _slice#\d+", plan) and re.search(r"hashpartitioning\(_slice#\d+", plan)
    one = few.first()
    monkeypatch.setattr(X, "MOST_SENT", 0)
    assert tuple(one) == pytest.approx(tuple(X.bootstrap_auc(rows, "a", "b", "image", 20, 5).first()))
