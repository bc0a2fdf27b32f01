"""Box expressions. A box is x, y, w, h: its upper left corner and its size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: Column | None = None) -> Column:
    """A struct of x, y, w and h, from columns of these names or the fields of a struct."""
    get = (lambda n: F.col(n)) if prefix is None else prefix.getField
    return F.struct(*[get(n).cast("double").alias(n) for n in ("x", "y", "w", "h")])


def overlap(a: Column, b: Column) -> Column:
    def side(at: str, size: str) -> Column:
        return F.greatest(F.lit(0.0), F.least(a[at] + a[size], b[at] + b[size]) - F.greatest(a[at], b[at]))

    return side("x", "w") * side("y", "h")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union for scoring; 0 where the union is not positive."""
    return iou_of(overlap(a, b), a["w"] * a["h"] + b["w"] * b["h"])


def iou_of(inner: Column, areas: Column) -> Column:
    """The same from the intersection and the sum of both areas, as columns that need not be evaluated again."""
    union = areas - inner
    return F.when(union > 0, inner / F.when(union > 0, union).otherwise(1.0)).otherwise(0.0)


def iou_for_conflicts(a: Column, b: Column) -> Column:
    """Intersection over union for labels that contradict each other: a billionth is added to the union."""
    inner = overlap(a, b)
    return inner / (a["w"] * a["h"] + b["w"] * b["h"] - inner + 1e-9)


def corners(b: Column) -> Column:
    """Rounded corners, halves to even."""
    return F.struct(*[F.bround(v).cast("long").alias(n) for n, v in (("x0", b["x"]), ("y0", b["y"]), ("x1", b["x"] + b["w"]), ("y1", b["y"] + b["h"]))])


def sizes(b: Column) -> Column:
    """x0, y0, x1, y1 as x, y, w, h."""
    return F.struct(b["x0"].alias("x"), b["y0"].alias("y"), (b["x1"] - b["x0"]).alias("w"), (b["y1"] - b["y0"]).alias("h"))


def span(low: Column, high: Column, limit: Column) -> Column:
    """First and one past the last pixel whose centre lies in [low, high), inside the picture."""
    first = F.greatest(F.lit(0), F.ceil(low - 0.5).cast("long"))
    return F.struct(first.alias("first"), F.greatest(first, F.least(limit.cast("long"), F.ceil(high - 0.5).cast("long"))).alias("end"))
