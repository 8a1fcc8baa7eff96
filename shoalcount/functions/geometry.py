"""Box geometry as Column expressions (no UDFs, so they stay inside code generation).

A box is a mapping of the four names x_min, y_min, x_max, y_max to Columns.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = ("x_min", "y_min", "x_max", "y_max")
Box = Mapping[str, Column]


def box(prefix: str = "") -> Box:
    """The box held in columns ``<prefix>x_min`` and so on."""
    return {edge: F.col(prefix + edge) for edge in EDGES}


def normalized_center(b: Box, width: Column, height: Column) -> tuple[Column, Column]:
    """Box centre as a share of the frame.

    Origin and size are divided first and half the size added after; the order matters for
    comparisons that land exactly on the line.
    """
    u = b["x_min"] / width + ((b["x_max"] - b["x_min"]) / width) / F.lit(2.0)
    v = b["y_min"] / height + ((b["y_max"] - b["y_min"]) / height) / F.lit(2.0)
    return u, v


def area(b: Box) -> Column:
    zero = F.lit(0.0)
    return F.greatest(b["x_max"] - b["x_min"], zero) * F.greatest(b["y_max"] - b["y_min"], zero)


def intersection(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    w = F.least(a["x_max"], b["x_max"]) - F.greatest(a["x_min"], b["x_min"])
    h = F.least(a["y_max"], b["y_max"]) - F.greatest(a["y_min"], b["y_min"])
    return F.greatest(w, zero) * F.greatest(h, zero)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 when the union is empty."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def containment(a: Box, b: Box) -> Column:
    """Intersection over the smaller area; 0 when that area is empty."""
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, intersection(a, b) / smaller).otherwise(F.lit(0.0))


def corner_distance(a: Box, b: Box) -> Column:
    """Largest absolute difference over the four edges."""
    return F.greatest(*[F.abs(a[e] - b[e]) for e in EDGES])


def meters_per_pixel(start: Column, stop: Column, pixels: Column) -> Column:
    return F.abs(stop - start) / pixels


def center_m(b: Box, mx: Column, my: Column) -> tuple[Column, Column]:
    """Box centre in metres."""
    return (b["x_min"] + b["x_max"]) / 2 * mx, (b["y_min"] + b["y_max"]) / 2 * my


def ramp(value: Column, zero: float, one: float) -> Column:
    """Linear map with ``zero`` -> 0 and ``one`` -> 1, clipped to [0, 1]."""
    return F.least(F.greatest((value - F.lit(zero)) / F.lit(one - zero), F.lit(0.0)), F.lit(1.0))


def letterbox_scale(height: Column | float, width: Column | float, canvas_h: int, canvas_w: int) -> Column:
    """One scale that fits the frame into the canvas."""
    return F.least(F.lit(float(canvas_h)) / F.lit(height), F.lit(float(canvas_w)) / F.lit(width))
