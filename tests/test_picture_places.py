"""Places of the boxes of many pictures at once, against those of one at a time."""

import numpy as np
import pyarrow as pa
import pytest

from calibra.operators import pixels as P

ODD = [np.nan, np.inf, -np.inf, 0.0, -3.0, 0.5, 2.5, 47.5, 63.5, 64.0, 1e300]


def test_places_of_many_boxes_are_those_of_each():
    rng = np.random.default_rng(3)
    boxes = np.concatenate([rng.uniform(-20, 80, (300, 4)), rng.choice(ODD, (700, 4))])
    shapes = rng.integers(0, 70, (1000, 2))
    for one, many in ((lambda b: b, lambda b: b), (P.around, P.all_around), (P.middle, P.all_middles)):
        with np.errstate(invalid="ignore"):
            got = P.places(shapes, many(boxes)).tolist()
        for shape, b, (top, low, left, right) in zip(shapes.tolist(), boxes.tolist(), got, strict=True):
            want, have = np.zeros(shape, bool), np.zeros(shape, bool)
            want[P.place(tuple(shape), one(tuple(b)))] = True
            have[top:low, left:right] = True
            assert (want == have).all(), (shape, b)


def test_lists_of_boxes_that_are_not_whole_are_errors():
    kind = pa.list_(pa.struct([("cls", pa.string()), *((c, pa.float64()) for c in "xywh")]))
    box = {"cls": "a", "x": 1.0, "y": 2.0, "w": 3.0, "h": 4.0}
    assert P.boxes_of(pa.array([[box], [], [box, box]], kind).slice(1))[2].tolist() == [0, 0, 2]
    for bad in ([None], [[box | {"w": None}]]):
        with pytest.raises(ValueError):
            P.boxes_of(pa.array(bad, kind))
