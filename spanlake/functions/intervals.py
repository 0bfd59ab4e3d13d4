"""Scalar expressions on one-dimensional segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def intersection(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def tiou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over true union; null for two empty segments."""
    inter = intersection(s1, e1, s2, e2)
    return F.try_divide(inter, (e1 - s1) + (e2 - s2) - inter)


def hull_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over the covering span; null for an empty span."""
    return F.try_divide(intersection(s1, e1, s2, e2), F.greatest(e1, e2) - F.least(s1, s2))


def center_iou_loss(l1: Column, r1: Column, l2: Column, r2: Column, eps: float = 1e-8) -> Column:
    """1 - IoU of two segments given as left and right offsets from one common centre."""
    inter = F.least(l1, l2) + F.least(r1, r2)
    union = (l1 + r1) + (l2 + r2) - inter
    return 1 - inter / F.greatest(union, F.lit(eps))


def center_diou_loss(l1: Column, r1: Column, l2: Column, r2: Column, eps: float = 1e-8) -> Column:
    """center_iou_loss plus the squared centre distance over the covering length."""
    cover = F.greatest(l1, l2) + F.greatest(r1, r2)
    rho = 0.5 * ((r1 - l1) - (r2 - l2))
    return center_iou_loss(l1, r1, l2, r2, eps) + F.pow(rho / F.greatest(cover, F.lit(eps)), 2)
