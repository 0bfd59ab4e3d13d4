"""Scalar expressions on two-dimensional boxes, given as structs or columns x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
Box = tuple[Column, Column, Column, Column]


def box_cols(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def _area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def _extent(a: Box, b: Box) -> tuple[Column, Column]:
    return F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])


def box_iou(a: Box, b: Box) -> Column:
    """Intersection over union with 1e-6 added to the union; negative extents give no intersection."""
    w, h = _extent(a, b)
    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    return inter / (_area(a) + _area(b) - inter + EPS)


def box_hit(a: Box, b: Box, t: float = 0.5) -> Column:
    """1 if the boxes truly intersect and their IoU reaches t."""
    w, h = _extent(a, b)
    return ((box_iou(a, b) >= t) & (w > 0) & (h > 0)).cast("int")


def box_giou(a: Box, b: Box) -> Column:
    """IoU minus the share of the enclosing box that neither box covers."""
    w, h = _extent(a, b)
    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = _area(a) + _area(b) - inter
    hull = (F.greatest(a[2], b[2]) - F.least(a[0], b[0])) * (F.greatest(a[3], b[3]) - F.least(a[1], b[1]))
    return inter / (union + EPS) - (hull - union) / (hull + EPS)


def cxcywh_to_xyxy(box: Box, width: Column | float = 1.0, height: Column | float = 1.0) -> Box:
    """Centre form in unit coordinates to corner form in pixels."""
    cx, cy, w, h = box
    wide, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (width, height))
    return (
        (cx - w / 2) * wide,
        (cy - h / 2) * high,
        (cx + w / 2) * wide,
        (cy + h / 2) * high,
    )


def xyxy_to_cxcywh(box: Box) -> Box:
    x0, y0, x1, y1 = box
    return (x0 + x1) / 2, (y0 + y1) / 2, x1 - x0, y1 - y0


def bins_to_pixels(bin_no: Column, n_bins: int, size: Column | float, ratio: Column | float = 1.0) -> Column:
    """Quantised coordinate to pixels of the original image."""
    size, ratio = (v if isinstance(v, Column) else F.lit(float(v)) for v in (size, ratio))
    return bin_no / (n_bins - 1) * size / ratio


def int_center(b: Box) -> tuple[Column, Column]:
    return ((b[0] + b[2]) / 2).cast("int"), ((b[1] + b[3]) / 2).cast("int")


def hand_object_offset(hand: Box, obj: Box) -> Column:
    """Struct (dx, dy, magnitude): unit vector between the integer centres, magnitude in thousands of pixels.

    Equal centres have no direction and give null.
    """
    hx, hy = int_center(hand)
    ox, oy = int_center(obj)
    dx, dy = ox - hx, oy - hy
    norm = F.sqrt((dx * dx + dy * dy).cast("double"))
    return F.when(
        norm > 0,
        F.struct((dx / norm).alias("dx"), (dy / norm).alias("dy"), (norm / 1000.0).alias("magnitude")),
    )
