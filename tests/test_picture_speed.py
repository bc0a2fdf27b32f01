"""Colours that the arms give, the stand-in model and the matching, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.operators import matching as M
from calibra.operators import pixels as P
from calibra.plans import registry as Q


@pytest.mark.parametrize("colour", ["blue", "yellow", None])
def test_painted_pixels_are_recoloured_ones(colour):
    rgb = np.random.default_rng(4).integers(0, 256, (1, 20000, 3)).astype(np.uint8)
    rgb[0, :4000] %= 12
    target = None if colour is None else Q.COLOURS[colour]
    want, share = P.recolour(rgb, np.ones((1, 20000), bool), target)
    got, clipped = P.painted(rgb[0], target)
    assert (got == want[0]).all() and clipped.mean() == share


def test_a_pixel_gets_a_colour_once(monkeypatch):
    rgb = np.random.default_rng(5).integers(0, 256, (48, 64, 3)).astype(np.uint8)
    boxes, painted, many = [(20.0, 15.0, 8.0, 6.0), (3.0, 3.0, 9.0, 9.0)], P.painted, []
    monkeypatch.setattr(P, "painted", lambda px, t: many.append(len(px)) or painted(px, t))
    got = list(P.arm_pictures(rgb, boxes[0], boxes, list(P.ARMS), Q.COLOURS))
    # Blue on the whole picture and the ring together, yellow and sham on the ring.
    ring, whole = (int(P.masked_by(k, rgb, boxes[0], boxes).sum()) for k in ("ring", "whole"))
    assert sorted(many) == sorted([whole, ring, ring])
    for arm, altered, share in got:
        kind, colour = P.ARMS[arm]
        want, lost = P.recolour(rgb, P.masked_by(kind, rgb, boxes[0], boxes), None if colour is None else Q.COLOURS[colour])
        assert (altered == want).all() and share == lost


def test_grid_model_sees_the_means_of_its_parts():
    for shape in ((48, 64, 3), (34, 52, 3), (30, 45, 3)):
        rgb = np.random.default_rng(6).integers(0, 256, shape).astype(np.uint8)
        want = []
        for y in range(0, 30, 10):
            for x in range(0, 50, 10):
                r, g, b = rgb[max(0, y - 4) : y + 14, max(0, x - 4) : x + 12].reshape(-1, 3).astype(np.int64).sum(axis=0) / rgb[max(0, y - 4) : y + 14, max(0, x - 4) : x + 12, 0].size
                want.append(("k00" if b > r else "k01", g / 255, float(x), float(y), 6.0, 9.0))
        assert Q.grid_model(rgb) == want


def test_matching_of_odd_boxes(spark):
    """Boxes without a place or of no size, and those that several predictions want."""
    schema = "preds array<struct<box: struct<x: double, y: double, w: double, h: double>>>, gts array<struct<idx: bigint, box: struct<x: double, y: double, w: double, h: double>>>"
    a, nan, none = (0.0, 0.0, 10.0, 10.0), (float("nan"), 0.0, 10.0, 10.0), (0.0, 0.0, 0.0, 0.0)
    rows = [([(b,) for b in (a, a, none, (0.0, 0.0, 10.0, 5.0), a)], [(0, a), (1, a), (2, none)]), ([(a,), (nan,)], [(5, nan)]), ([], [(0, a)]), ([(a,)], [])]
    got = [r.t for r in spark.createDataFrame(rows, schema).select(M.fold(F.col("preds"), F.col("gts")).alias("t")).collect()]
    assert got == [[1, 0, None, None, None], [5, None], [], [None]]
