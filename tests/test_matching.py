import random

import pytest
from pyspark.sql import functions as F

from calibra.functions.geometry import box, corners, iou, iou_for_conflicts
from calibra.operators import matching as M

A, B = (0.0, 0.0, 10.0, 10.0), (100.0, 0.0, 10.0, 10.0)
GT, PRED = "image string, gt_idx long, cls string, x double, y double, w double, h double", "image string, pred_idx long, cls string, conf double, x double, y double, w double, h double"


def tables(spark, gt, pred):
    g = spark.createDataFrame([("i", k, c, *b) for k, (c, b) in enumerate(gt)], GT)
    p = spark.createDataFrame([("i", k, c, s, *b) for k, (c, s, b) in enumerate(pred)], PRED)
    return spark.createDataFrame([("i",)], "image string"), g, M.match(g, p)


def outcome(spark, gt, pred, threshold=0.5):
    images, g, m = tables(spark, gt, pred)
    return {(r.truth, r.pred): r.n for r in M.outcomes(images, g, m, threshold).collect()}


@pytest.mark.parametrize(
    "gt, pred, want",
    [
        ([("s", A)], [("l", 0.9, A)], {("s", "l"): 1}),
        ([("s", A)], [("s", 0.6, A), ("l", 0.8, A)], {("s", "l"): 1, ("background", "s"): 1}),
        ([("s", A), ("m", B)], [("s", 0.9, (6.0, 0.0, 10.0, 10.0)), ("m", 0.3, B)], {("background", "s"): 1, ("s", "missed"): 1, ("m", "missed"): 1}),
        ([("s", A)], [("s", 0.9, A), ("s", 0.8, A)], {("s", "s"): 1, ("background", "s"): 1}),
        ([("s", A)], [], {("s", "missed"): 1}),
        ([("s", A), ("t", A)], [("u", 0.9, A)], {("t", "u"): 1, ("s", "missed"): 1}),
    ],
)
def test_outcomes(spark, gt, pred, want):
    assert outcome(spark, gt, pred) == want


def test_iou_and_corners(spark):
    rows = spark.createDataFrame([(*A, *A), (*A, *B), (*A, 5.0, 0.0, 10.0, 10.0), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "x double, y double, w double, h double, x2 double, y2 double, w2 double, h2 double")
    other = F.struct(*[F.col(f"{n}2").alias(n) for n in "xywh"])
    got = rows.select(iou(box(), other).alias("a"), iou_for_conflicts(box(), other).alias("b")).collect()
    assert [round(r.a, 9) for r in got] == [1, 0, round(50 / 150, 9), 0] and got[0].b < 1
    c = spark.createDataFrame([(10.4, 20.6, 30.0, 40.0), (0.5, 1.5, 1.0, 1.0)], "x double, y double, w double, h double").select(corners(box()).alias("c")).collect()
    assert [tuple(r.c) for r in c] == [(10, 21, 40, 61), (0, 2, 2, 2)]


def plain_match(gt, pred):
    def overlap(a, b):
        w, h = (max(0.0, min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k])) for k in (0, 1))
        u = a[2] * a[3] + b[2] * b[3] - w * h
        return w * h / u if u > 0 else 0.0

    free, out = set(range(len(gt))), {}
    for k in sorted(range(len(pred)), key=lambda k: -pred[k][1]):
        best = max(((overlap(pred[k][2], gt[g][1]), g) for g in free), default=(0, None))
        out[k] = best[1] if best[0] >= 0.5 else None
        free.discard(out[k])
    return out


def test_random_images_and_the_sweep(spark):
    rnd, gts, preds, want = random.Random(2), [], [], {}
    for i in range(60):
        gt = [(rnd.choice("abc"), (rnd.randint(0, 3) * 4.0, 0.0, 10.0, 10.0)) for _ in range(rnd.randint(0, 4))]
        pred = [(rnd.choice("abc"), rnd.randint(1, 19) / 20, (rnd.randint(0, 3) * 4.0, 0.0, 10.0, 10.0)) for _ in range(rnd.randint(0, 6))]
        gts += [(f"i{i}", k, c, *b) for k, (c, b) in enumerate(gt)]
        preds += [(f"i{i}", k, c, s, *b) for k, (c, s, b) in enumerate(pred)]
        want |= {(f"i{i}", k): g for k, g in plain_match(gt, pred).items()}
    images, g, p = spark.createDataFrame([(f"i{i}",) for i in range(60)], "image string"), spark.createDataFrame(gts, GT), spark.createDataFrame(preds, PRED)
    matched = M.match(g, p).cache()
    assert {(r.image, r.pred_idx): r.gt_idx for r in matched.collect()} == want
    swept = {r.threshold: r for r in M.sweep(images, g, matched).collect()}
    assert len(swept) == 91
    for t in (0.05, 0.5, 0.95):
        # Matching the predictions above a threshold by themselves gives the same.
        table = M.outcomes(images, g, M.match(g, p.filter(F.col("conf") >= t)), 0.0)
        assert abs(M.micro_f1(table).first().f1 - swept[t].f1) < 1e-12


def test_tables_and_average_precision(spark):
    table = spark.createDataFrame([("a", "a", 5), ("a", "b", 3), ("a", "c", 1), ("a", "missed", 1)], "truth string, pred string, n long")
    r = M.errors(table, spark.createDataFrame([("a", "b"), ("b", "a")], "cls string, partner string")).filter("cls = 'a'").first()
    assert (r.n, r.correct, r.confused, r.other, r.missed, r.share) == (10, 5, 3, 1, 1, 0.3) and r.low < 0.3 < r.high
    few = spark.createDataFrame([("a", "a", 2), ("b", "c", 1), ("background", "a", 1)], "truth string, pred string, n long")
    assert M.micro_f1(few).first().f1 == 4 / 7
    classes = spark.createDataFrame([("a",), ("z",)], "cls string")
    assert {x.cls: (x.n_gt, x.precision, x.recall) for x in M.per_class(few, classes).collect()} == {"a": (2, 2 / 3, 1.0), "z": (0, 0.0, 0.0)}
    g = spark.createDataFrame([("i", 0, "a", *A), ("i", 1, "a", *B)], GT)
    good = [("i", 0, "a", 0.9, *A), ("i", 1, "a", 0.8, *B)]
    assert M.average_precision(g, spark.createDataFrame(good, PRED)).first().ap == pytest.approx(1.0)
    # A prediction of an image without boxes counts as false.
    assert M.average_precision(g, spark.createDataFrame([("other", 0, "a", 0.95, *A), *good], PRED)).first().ap < 1
    assert M.average_precision(g, spark.createDataFrame([], PRED)).first().ap == 0
