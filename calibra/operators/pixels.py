"""Colour and region measures of pictures, in Arrow batches; a picture is one row and is decoded once."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibra.operators.batches import ROWS, pictures_of

#: Fixed values of the CIELAB definition: white point D65, the two bounds, and the sRGB primaries.
WHITE = np.array([0.95047, 1.0, 1.08883])
EPS, KAPPA = 216 / 24389, 24389 / 27
RGB_TO_XYZ = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
XYZ_TO_RGB = np.linalg.inv(RGB_TO_XYZ)
#: Ring: a quarter of the longer side, at least eight pixels; it needs so many pixels. Core: the middle share.
RING_SHARE, RING_LEAST, RING_PIXELS, CORE = 0.25, 8.0, 150, 0.6


def _linear(c: np.ndarray) -> np.ndarray:
    return np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)


#: Linear light of each of the 256 values of a byte.
_OF_BYTE = _linear(np.arange(256) / 255)


def _by_channel(rgb: np.ndarray) -> np.ndarray:
    """Linear light of pixels (n x 3 bytes), a row for each channel."""
    return np.stack([_OF_BYTE.take(rgb[:, c]) for c in range(3)])


def _curve(t: np.ndarray) -> np.ndarray:
    f, dark = np.cbrt(t), np.flatnonzero(t <= EPS)
    if len(dark):
        f.put(dark, (KAPPA * t.take(dark) + 16) / 116)
    return f


def to_ab(rgb: np.ndarray) -> np.ndarray:
    """a* and b* of pixels (n x 3 bytes), a row each, as to_lab() gives them."""
    x, y, z = _curve(RGB_TO_XYZ @ _by_channel(rgb) / WHITE[:, None])
    return np.stack([500 * (x - y), 200 * (y - z)])


def to_lab(rgb: np.ndarray) -> np.ndarray:
    linear = _OF_BYTE[rgb] if rgb.dtype == np.uint8 else _linear(rgb.astype(float) / 255)
    t = linear @ RGB_TO_XYZ.T / WHITE
    f = np.where(t > EPS, np.cbrt(t), (KAPPA * t + 16) / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def to_rgb(lab: np.ndarray) -> np.ndarray:
    """The inverse, in 0 to 255 and not cut off."""
    fy = (lab[..., 0] + 16) / 116
    f = np.stack([fy + lab[..., 1] / 500, fy, fy - lab[..., 2] / 200], axis=-1)
    cubes = f * f * f
    t = np.where(cubes > EPS, cubes, (116 * f - 16) / KAPPA)
    linear = t * WHITE @ XYZ_TO_RGB.T
    c = np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * np.maximum(linear, 0.0031308) ** (1 / 2.4) - 0.055)
    return c * 255


def lab_columns(r: Column, g: Column, b: Column) -> Column:
    """The same conversion as a column expression, for tables of colours."""
    linear = [F.when(c / 255.0 <= 0.04045, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4))) for c in (r, g, b)]
    f = []
    for row, white in zip(RGB_TO_XYZ, WHITE, strict=True):
        t = sum((float(m) * c for m, c in zip(row, linear, strict=True)), F.lit(0.0)) / float(white)
        f.append(F.when(t > EPS, F.cbrt(t)).otherwise((KAPPA * t + 16) / 116))
    return F.struct((116 * f[1] - 16).alias("l"), (500 * (f[0] - f[1])).alias("a"), (200 * (f[1] - f[2])).alias("b"))


def rgb_columns(l: Column, a: Column, b: Column) -> Column:
    """The inverse as a column expression, not cut off."""
    fy = (l + 16) / 116
    xyz = [F.when(f * f * f > EPS, f * f * f).otherwise((116 * f - 16) / KAPPA) * float(w) for f, w in zip((fy + a / 500, fy, fy - b / 200), WHITE, strict=True)]
    out = []
    for row in np.linalg.inv(RGB_TO_XYZ):
        c = sum((float(m) * v for m, v in zip(row, xyz, strict=True)), F.lit(0.0))
        out.append(F.when(c <= 0.0031308, 12.92 * c).otherwise(1.055 * F.pow(F.greatest(c, F.lit(0.0031308)), F.lit(1 / 2.4)) - 0.055) * 255)
    return F.struct(*[v.alias(n) for v, n in zip(out, "rgb", strict=True)])


def _span(size: int, at: float, length: float) -> slice:
    """Of so many pixels in a row, those whose centres lie from `at` on over a length."""
    first, last = at - 0.5, at + length - 0.5
    if first != first or last != last:
        return slice(0, 0)
    start, stop = (0 if v <= 0 else size if v >= size else math.ceil(v) for v in (first, last))
    return slice(start, max(start, stop))


def place(shape: tuple[int, int], box: tuple[float, float, float, float]) -> tuple[slice, slice]:
    """Rows and columns of the pixels whose centres lie in a box."""
    x, y, w, h = box
    return _span(shape[0], y, h), _span(shape[1], x, w)


def places(shapes: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """place() of many boxes (n x 4) in pictures of so many rows and columns (n x 2): first and end row, first and end column."""
    out = np.zeros((len(boxes), 4), np.int64)
    for k in (0, 1):
        size, at, length = shapes[:, k], boxes[:, 1 - k], boxes[:, 3 - k]
        with np.errstate(invalid="ignore"):
            span = np.stack([at - 0.5, at + length - 0.5])
        empty = np.isnan(span).any(axis=0)
        start, stop = np.clip(np.ceil(np.where(empty, 0.0, span)), 0, size).astype(np.int64)
        out[:, 2 * k], out[:, 2 * k + 1] = start, np.where(empty, start, np.maximum(start, stop))
    return out


def boxes_of(column: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Classes and places (n x 4) of all boxes of some pictures, and where each picture's begin and the last one's end."""
    if column.null_count:
        raise ValueError("a picture without a list of boxes")
    each = pc.list_flatten(column)
    numbers = [pc.struct_field(each, c) for c in "xywh"]
    if any(c.null_count for c in numbers):
        raise ValueError("a box without a place")
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy())])
    return pc.struct_field(each, "cls").to_pylist(), np.stack([c.to_numpy() for c in numbers], axis=1), ends


def inside(shape: tuple[int, int], box: tuple[float, float, float, float]) -> np.ndarray:
    """Pixels whose centres lie in a box."""
    out = np.zeros(shape, bool)
    out[place(shape, box)] = True
    return out


def around(box: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    """A box and its ring."""
    x, y, w, h = box
    m = max(RING_LEAST, RING_SHARE * max(w, h))
    return x - m, y - m, w + 2 * m, h + 2 * m


def all_around(boxes: np.ndarray) -> np.ndarray:
    """around() of many boxes (n x 4)."""
    x, y, w, h = boxes.T
    with np.errstate(invalid="ignore"):
        m = np.fmax(RING_LEAST, RING_SHARE * np.fmax(w, h))
        return np.stack([x - m, y - m, w + 2 * m, h + 2 * m], axis=1)


def ring(shape, box, boxes) -> np.ndarray:
    """What surrounds a box, without any labelled box."""
    out = inside(shape, around(box))
    for b in boxes:
        out[place(shape, b)] = False
    return out


def middle(box: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    """The middle share of a box."""
    x, y, w, h = box
    return x + w * (1 - CORE) / 2, y + h * (1 - CORE) / 2, w * CORE, h * CORE


def all_middles(boxes: np.ndarray) -> np.ndarray:
    """middle() of many boxes (n x 4)."""
    x, y, w, h = boxes.T
    with np.errstate(invalid="ignore"):
        return np.stack([x + w * (1 - CORE) / 2, y + h * (1 - CORE) / 2, w * CORE, h * CORE], axis=1)


def core(shape, box) -> np.ndarray:
    return inside(shape, middle(box))


def outside(rgb: np.ndarray, boxes) -> np.ndarray:
    """Everything outside the boxes but pure black."""
    out = coloured(rgb)
    for b in boxes:
        out[place(rgb.shape[:2], b)] = False
    return out


def coloured(rgb: np.ndarray) -> np.ndarray:
    """Pixels that are not pure black."""
    return (rgb[..., 0] | rgb[..., 1] | rgb[..., 2]) != 0


def median(values: np.ndarray) -> float:
    """The median of at least one number, as np.median gives it."""
    return sorted_median(np.array(values))


def sorted_median(values: np.ndarray) -> float:
    """median() of an array of its own, which is left sorted."""
    values.sort()
    n = len(values)
    return float(values[n // 2]) if n % 2 else float((values[n // 2 - 1] + values[n // 2]) / 2)


def recolour(rgb: np.ndarray, mask: np.ndarray, target: tuple[float, float] | None) -> tuple[np.ndarray, float]:
    """The picture with a* and b* set to a target under the mask, or sent there and back without one; and the clipped share.

    Lightness and unmasked pixels stay. Halves round to even.
    """
    return recoloured(rgb, mask, to_lab(rgb[mask]), target)


def recoloured(rgb: np.ndarray, mask: np.ndarray, lab: np.ndarray, target: tuple[float, float] | None) -> tuple[np.ndarray, float]:
    """recolour(), with the masked pixels' colours, which it leaves as they are."""
    out = rgb.copy()
    if not len(lab):
        return out, 0.0
    if target is not None:
        lab = lab.copy()
        lab[:, 1], lab[:, 2] = target
    fresh = np.rint(to_rgb(lab))
    out[mask] = np.clip(fresh, 0, 255).astype(np.uint8)
    return out, float(((fresh < 0) | (fresh > 255)).any(axis=1).mean())


#: Fixed values, the arms of the experiment: which pixels change, and the colour that they get; none for the sham.
ARMS = {
    "ring": ("ring", "blue"),
    "sham": ("ring", None),
    "whole": ("whole", "blue"),
    "reverse": ("ring", "yellow"),
    "keep": ("ring", "blue"),
}


def masked_by(kind: str, rgb: np.ndarray, box, boxes) -> np.ndarray:
    """The pixels that a kind of arm changes: those around a box that are not black, or all outside the boxes."""
    if kind == "whole":
        return outside(rgb, boxes)
    return ring(rgb.shape[:2], box, boxes) & coloured(rgb)


def painted(rgb: np.ndarray, target: tuple[float, float] | None) -> tuple[np.ndarray, np.ndarray]:
    """What recoloured() makes of pixels (n x 3 bytes), and which of them it clips; a row for each channel within."""
    linear = _by_channel(rgb)
    if target is None:
        f = _curve(RGB_TO_XYZ @ linear / WHITE[:, None])
        # By way of a* and b*, as the other arms go.
        a, b = 500 * (f[0] - f[1]), 200 * (f[1] - f[2])
        f[0], f[2] = f[1] + a / 500, f[1] - b / 200
    else:
        # Of the old colour only lightness is left.
        fy = _curve(RGB_TO_XYZ[1] @ linear / WHITE[1])
        f = np.stack([fy + target[0] / 500, fy, fy - target[1] / 200])
    t = f * f * f
    dark = np.flatnonzero(t <= EPS)
    if len(dark):
        t.put(dark, (116 * f.take(dark) - 16) / KAPPA)
    t *= WHITE[:, None]
    linear = XYZ_TO_RGB @ t
    c = np.maximum(linear, 0.0031308)
    np.power(c, 1 / 2.4, out=c)
    c *= 1.055
    c -= 0.055
    dark = np.flatnonzero(linear <= 0.0031308)
    if len(dark):
        c.put(dark, 12.92 * linear.take(dark))
    c *= 255
    fresh = np.rint(c, out=c)
    clipped = ((fresh < 0) | (fresh > 255)).any(axis=0)
    return np.clip(fresh, 0, 255, out=fresh).astype(np.uint8).T, clipped


def arm_pictures(rgb: np.ndarray, box, boxes, arms: list[str], targets: dict[str, tuple[float, float]]) -> Iterator[tuple[str, np.ndarray, float]]:
    """Each arm with its altered picture and the share of changed pixels that was clipped. Arms with one mask share it."""
    masks = {kind: masked_by(kind, rgb, box, boxes) for kind in sorted({ARMS[a][0] for a in arms})}
    return altered_by(rgb, masks, arms, targets)


def altered_by(rgb: np.ndarray, masks: dict[str, np.ndarray], arms: list[str], targets: dict[str, tuple[float, float]]) -> Iterator[tuple[str, np.ndarray, float]]:
    """arm_pictures() with the mask of each kind. A pixel gets a colour once, however many masks have it."""
    made: dict[tuple, tuple[np.ndarray, float]] = {}
    for colour in dict.fromkeys(ARMS[a][1] for a in arms):
        kinds = list(dict.fromkeys(ARMS[a][0] for a in arms if ARMS[a][1] == colour))
        at = np.flatnonzero(masks[kinds[0]] if len(kinds) == 1 else np.logical_or.reduce([masks[k] for k in kinds]))
        fresh, clipped = painted(rgb.reshape(-1, 3).take(at, axis=0), None if colour is None else targets[colour])
        # A pixel's three bytes move as one value.
        fresh = np.ascontiguousarray(fresh).view("V3").reshape(-1)
        for kind in kinds:
            altered = np.array(rgb, order="C")
            chosen = masks[kind].ravel().take(at) if len(kinds) > 1 else None
            if chosen is None or chosen.all():
                altered.view("V3").reshape(-1)[at] = fresh
                lost = clipped
            else:
                altered.view("V3").reshape(-1)[at[chosen]] = fresh[chosen]
                lost = clipped[chosen]
            made[kind, colour] = altered, float(lost.mean()) if len(lost) else 0.0
    for arm in arms:
        altered, share = made[ARMS[arm]]
        yield arm, altered.copy(), share


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows at most."""
    for whole in batches:
        for first in range(0, whole.num_rows, rows):
            yield whole.slice(first, rows)


#: Rows that a task sends on together.
HELD = 4096
#: Columns of a picture.
PICTURE = ["image", "width", "height", "data"]
MEASURES = "image string, box int, ring_pixels int, ring_a double, ring_b double, plate_chroma double"


def measure(pictures: DataFrame, target: Callable[[str], bool] | None = None) -> DataFrame:
    """Medians around and in each box: pictures has image, width, height, data (RGB bytes) and boxes (cls, x, y, w, h).

    The ring's medians are null under RING_PIXELS pixels that are not black. A picture whose size differs from its data
    is an error. `target` picks the classes that are measured; pictures without one should be dropped before.
    """

    def measured(rgb: np.ndarray, wanted: list[int], own: list[list[int]], rings: list[list[int]], cores: list[list[int]]) -> Iterator[tuple]:
        free = coloured(rgb)
        for top, low, left, right in own:
            free[top:low, left:right] = False
        # Only pixels of a ring or a core need their colour.
        need = np.zeros(free.shape, bool)
        for i in wanted:
            top, low, left, right = rings[i]
            need[top:low, left:right] = True
        need &= free
        for i in wanted:
            top, low, left, right = cores[i]
            need[top:low, left:right] = True
        at = np.flatnonzero(need)
        ab = np.empty((2, *free.shape))
        ab.reshape(2, -1)[:, at] = to_ab(rgb.reshape(-1, 3).take(at, axis=0))
        for i in wanted:
            top, low, left, right = rings[i]
            shown = free[top:low, left:right]
            n, values = int(np.count_nonzero(shown)), [None, None]
            if n >= RING_PIXELS:
                values = [sorted_median(c[top:low, left:right][shown]) for c in ab]
            top, low, left, right = cores[i]
            chroma = np.hypot(*ab[:, top:low, left:right]).ravel()
            yield i, n, *values, sorted_median(chroma) if len(chroma) else None

    def packed(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in MEASURES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in pieces(batches):
            kinds, boxes, ends = boxes_of(batch.column("boxes"))
            shapes = np.stack([batch.column(c).to_numpy() for c in ("height", "width")], axis=1).repeat(np.diff(ends), axis=0)
            spans = [places(shapes, part).tolist() for part in (boxes, all_around(boxes), all_middles(boxes))]
            for k, (image, rgb, _) in enumerate(pictures_of([batch.select(PICTURE)])):
                first, end = ends[k], ends[k + 1]
                wanted = [i for i, c in enumerate(kinds[first:end]) if target is None or target(c)]
                out += [(image, *m) for m in measured(rgb, wanted, *(part[first:end] for part in spans))]
                if len(out) >= HELD:
                    yield packed(out)
                    out = []
        if out:
            yield packed(out)

    return pictures.select("image", "width", "height", "data", "boxes").mapInArrow(run, MEASURES)


#: Finds objects: from pixels to (cls, conf, x, y, w, h) each.
Model = Callable[[np.ndarray], list[tuple]]
DETECTIONS = "image string, pred_idx long, cls string, conf double, x double, y double, w double, h double"


def _detections(found: list[tuple]) -> list[pa.Array]:
    return [pa.array(range(len(found)), pa.int64()), *(pa.array([d[k] for d in found], pa.string() if k == 0 else pa.float64()) for k in range(6))]


def predict(pictures: DataFrame, model: Model) -> DataFrame:
    """Detections of a model that the caller gives, numbered within each picture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for image, rgb, _ in pictures_of(batches):
            found = model(rgb)
            yield pa.RecordBatch.from_arrays([pa.array([image] * len(found), pa.string()), *_detections(found)], [f.split()[0] for f in DETECTIONS.split(", ")])

    return pictures.select("image", "width", "height", "data").mapInArrow(run, DETECTIONS)


#: One detection of those of a picture.
FOUND = "struct<pred_idx: bigint, cls: string, conf: double, x: double, y: double, w: double, h: double>"


def read_arms(pictures: DataFrame, targets: dict[str, tuple[float, float]], model: Model) -> DataFrame:
    """Detections on each picture as each of its arms alters it, a row for each arm: image, boxes, target, arm, clipped, found (an array).

    pictures has image, width, height, data, boxes, target (the place of the box that the arms are about) and arms (names
    of ARMS). A picture is decoded once and its altered forms are made, read and dropped one after the other; none is
    stored.
    """

    def packed(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        at, arms, clipped, found = zip(*rows, strict=True)
        ends = np.concatenate([[0], np.cumsum([len(f) for f in found])])
        idx = np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
        columns = list(zip(*(d[:6] for f in found for d in f), strict=True)) or [()] * 6
        fields = [pa.array(idx), *(pa.array(c, pa.float64() if k else pa.string()) for k, c in enumerate(columns))]
        each = pa.StructArray.from_arrays(fields, ["pred_idx", "cls", "conf", "x", "y", "w", "h"])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)
        same = batch.select(["image", "boxes", "target"]).take(pa.array(at))
        return pa.RecordBatch.from_arrays([*same.columns, pa.array(arms, pa.string()), pa.array(clipped, pa.float64()), lists], ["image", "boxes", "target", "arm", "clipped", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, HELD // 32):
            _, boxes, ends = boxes_of(batch.column("boxes"))
            shapes = np.stack([batch.column(c).to_numpy() for c in ("height", "width")], axis=1)
            own = places(shapes.repeat(np.diff(ends), axis=0), boxes).tolist()
            at, arms = batch.column("target").to_numpy(), batch.column("arms").to_pylist()
            if ((at < 0) | (at >= np.diff(ends))).any():
                raise ValueError("a target that is not among its picture's boxes")
            wide = places(shapes, all_around(boxes[ends[:-1] + at])).tolist()
            rows: list[tuple] = []
            for k, (_, rgb, _) in enumerate(pictures_of([batch.select(PICTURE)])):
                masks = {"whole": coloured(rgb)}
                for top, low, left, right in own[ends[k] : ends[k + 1]]:
                    masks["whole"][top:low, left:right] = False
                if any(ARMS[a][0] == "ring" for a in arms[k]):
                    top, low, left, right = wide[k]
                    masks["ring"] = np.zeros(rgb.shape[:2], bool)
                    masks["ring"][top:low, left:right] = masks["whole"][top:low, left:right]
                rows += [(k, arm, clipped, model(altered)) for arm, altered, clipped in altered_by(rgb, masks, arms[k], targets)]
            if rows:
                yield packed(batch, rows)

    fields = "array<struct<cls: string, x: double, y: double, w: double, h: double>>"
    return pictures.select("image", "width", "height", "data", "boxes", "target", "arms").mapInArrow(run, f"image string, boxes {fields}, target int, arm string, clipped double, found array<{FOUND}>")


def predict_arms(pictures: DataFrame, targets: dict[str, tuple[float, float]], model: Model) -> DataFrame:
    """read_arms() with a row for each detection: arm, clipped and the columns of predict().

    Each arm has a row without a class too, pred_idx -1, so that arms without a detection keep their clipped share.
    """
    none = F.struct(F.lit(-1).cast("long").alias("pred_idx"), F.lit(None).cast("string").alias("cls"), *[F.lit(0.0).alias(c) for c in ("conf", *"xywh")])
    rows = read_arms(pictures, targets, model).select("arm", "clipped", "image", F.explode(F.concat(F.array(none), "found")).alias("d"))
    return rows.select("arm", "clipped", "image", "d.*")
