"""Column functions over boxes and frames.  A box is a struct of x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bbox(x1, y1, x2, y2) -> Column:
    names = ("x1", "y1", "x2", "y2")
    return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).cast("double").alias(n) for c, n in zip((x1, y1, x2, y2), names, strict=True)])


def centre(box: Column) -> tuple[Column, Column]:
    return (box["x1"] + box["x2"]) / 2, (box["y1"] + box["y2"]) / 2


def diagonal(width: Column, height: Column) -> Column:
    w, h = width.cast("double"), height.cast("double")
    return F.sqrt(w * w + h * h)


def distance(a: Column, b: Column) -> Column:
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def distance_norm(a: Column, b: Column, diag: Column) -> Column:
    """Distance of the centres over the frame's diagonal; null where the frame has no size."""
    return F.when(diag > 0, distance(a, b) / F.when(diag > 0, diag))


def crop_window(box: Column, pad_ratio: float, width: Column, height: Column) -> Column:
    """The padded box in whole pixels inside the frame: cut towards zero, then clamped.

    A box wholly left of or above the frame gives an empty window (cx2 <= cx1).
    """
    px, py = (box["x2"] - box["x1"]) * F.lit(pad_ratio), (box["y2"] - box["y1"]) * F.lit(pad_ratio)
    return F.struct(
        F.greatest(F.lit(0), (box["x1"] - px).cast("int")).alias("cx1"), F.greatest(F.lit(0), (box["y1"] - py).cast("int")).alias("cy1"),
        F.least(width, (box["x2"] + px).cast("int")).alias("cx2"), F.least(height, (box["y2"] + py).cast("int")).alias("cy2"),
    )


def nonempty(window: Column) -> Column:
    return (window["cx2"] > window["cx1"]) & (window["cy2"] > window["cy1"])


def to_frame(box: Column, window: Column) -> Column:
    """A box in crop coordinates, in frame coordinates."""
    return bbox(box["x1"] + window["cx1"], box["y1"] + window["cy1"], box["x2"] + window["cx1"], box["y2"] + window["cy1"])


def pixels(cx: Column, cy: Column, bw: Column, bh: Column, width: Column, height: Column) -> Column:
    """A normalised centre box as pixel corners."""
    return bbox((cx - bw / 2) * width, (cy - bh / 2) * height, (cx + bw / 2) * width, (cy + bh / 2) * height)


def aspect_ratio(w: Column, h: Column) -> Column:
    return F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1e-9))
