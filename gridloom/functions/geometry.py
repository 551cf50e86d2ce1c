"""Predicates and measures as Columns. A side is named by prefix: ``side("a.")`` reads ``a.x1`` and so on."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    x2: Column
    y1: Column
    y2: Column


def side(prefix: str = "") -> Box:
    return Box(*(F.col(f"{prefix}{c}") for c in ("x1", "x2", "y1", "y2")))


def literal(x1, x2, y1, y2) -> Box:
    return Box(F.lit(x1), F.lit(x2), F.lit(y1), F.lit(y2))


def range_intersects(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return (a1 <= b2) & (b1 <= a2)


def intersects(a: Box, b: Box) -> Column:
    """Touching counts."""
    return range_intersects(a.x1, a.x2, b.x1, b.x2) & range_intersects(a.y1, a.y2, b.y1, b.y2)


def contains(outer: Box, inner: Box) -> Column:
    """Equal edges count."""
    return (outer.x1 <= inner.x1) & (inner.x2 <= outer.x2) & (outer.y1 <= inner.y1) & (inner.y2 <= outer.y2)


def overlap(a: Box, b: Box) -> Box:
    """The common part of two boxes; meaningful where they intersect."""
    return Box(F.greatest(a.x1, b.x1), F.least(a.x2, b.x2), F.greatest(a.y1, b.y1), F.least(a.y2, b.y2))


def range_contains(lo: Column, hi: Column, v: Column) -> Column:
    return (lo <= v) & (v <= hi)


def side_of(lo: Column, hi: Column, v: Column) -> Column:
    """-1 where v lies below the range, 1 above, 0 inside."""
    return F.when(v < lo, -1).when(v > hi, 1).otherwise(0)


def distance2(box: Box, px: Column, py: Column) -> Column:
    """Squared distance of a point to the nearest point of a box; 0 inside."""
    zero = F.lit(0)
    dx = F.greatest(box.x1 - px, px - box.x2, zero)
    dy = F.greatest(box.y1 - py, py - box.y2, zero)
    return dx * dx + dy * dy


def centre_distance2(box: Box, px: Column, py: Column) -> Column:
    cx, cy = (box.x1 + box.x2) / 2, (box.y1 + box.y2) / 2
    return (cx - px) * (cx - px) + (cy - py) * (cy - py)


def line_distance2(v: Column, at: Column) -> Column:
    """Squared distance of a coordinate to an axis-aligned line."""
    return (v - at) * (v - at)


def ray_t(box: Box, px: Column, py: Column, dx: Column, dy: Column) -> Column:
    """Parameter t of the first point of the ray p + t d, t >= 0, in the box; null if it misses. 0 inside."""

    def slab(o: Column, d: Column, s: Column, e: Column):
        still = d == 0
        safe = F.when(still, F.lit(1.0)).otherwise(d.cast("double"))
        one, two = (s - o) / safe, (e - o) / safe
        lo = F.when(still, F.lit(float("-inf"))).otherwise(F.least(one, two))
        hi = F.when(still, F.lit(float("inf"))).otherwise(F.greatest(one, two))
        return still & ~range_contains(s, e, o), lo, hi

    miss_x, lo_x, hi_x = slab(px, dx, box.x1, box.x2)
    miss_y, lo_y, hi_y = slab(py, dy, box.y1, box.y2)
    enter = F.greatest(lo_x, lo_y, F.lit(0.0))
    # a miss is a flag of its own: greatest and least skip nulls
    return F.when(~(miss_x | miss_y) & (enter <= F.least(hi_x, hi_y)), enter)


def ray_circle_t(cx: Column, cy: Column, radius: Column, px: Column, py: Column, dx: Column, dy: Column) -> Column:
    """Smallest t >= 0 at which the ray meets the circle; 0 inside; null if it misses or has no direction."""
    fx, fy = px - cx, py - cy
    a, b, c = (dx * dx + dy * dy).cast("double"), (fx * dx + fy * dy).cast("double"), (fx * fx + fy * fy - radius * radius).cast("double")
    root = b * b - a * c
    safe_a, safe_root = F.when(a == 0, F.lit(1.0)).otherwise(a), F.when(root < 0, F.lit(0.0)).otherwise(root)
    t = (-b - F.sqrt(safe_root)) / safe_a
    return F.when(c <= 0, F.lit(0.0)).when((a > 0) & (root >= 0) & (t >= 0), t)
