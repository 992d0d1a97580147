"""Arithmetic of pixel boxes (x1, y1, x2, y2), as columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Added to denominators of overlaps, so that a geometric 1/2 comes out just below 1/2.
EPS = 1e-9


class Box(NamedTuple):
    """Four columns of a box."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @staticmethod
    def of(prefix: str = "", names: tuple[str, str, str, str] = ("x1", "y1", "x2", "y2")) -> Box:
        return Box(*(F.col(prefix + n) for n in names))

    def named(self, *names: str) -> list[Column]:
        return [c.alias(n) for c, n in zip(self, names or ("x1", "y1", "x2", "y2"), strict=True)]


def _positive(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def box_area(b: Box) -> Column:
    """Area; sides below zero count as zero."""
    return _positive(b.x2 - b.x1) * _positive(b.y2 - b.y1)


def box_inter(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return _positive(w) * _positive(h)


def box_iou(a: Box, b: Box) -> Column:
    inter = box_inter(a, b)
    return inter / (box_area(a) + box_area(b) - inter + F.lit(EPS))


def box_inside(a: Box, b: Box) -> Column:
    """Share of `a` that lies in `b`."""
    return box_inter(a, b) / (box_area(a) + F.lit(EPS))


def shrink_box(b: Box, margin: float = 0.25) -> Box:
    """Take a share of each side off at both ends."""
    dx, dy = (b.x2 - b.x1) * margin, (b.y2 - b.y1) * margin
    return Box(b.x1 + dx, b.y1 + dy, b.x2 - dx, b.y2 - dy)


def widen_box(b: Box, pixels: float = 4.0) -> Box:
    return Box(b.x1 - pixels, b.y1 - pixels, b.x2 + pixels, b.y2 + pixels)


def clip_box(b: Box, width: Column, height: Column) -> Box:
    """The part of a box inside the photo."""
    zero = F.lit(0.0)
    return Box(F.greatest(b.x1, zero), F.greatest(b.y1, zero), F.least(b.x2, width), F.least(b.y2, height))


def in_frame_share(b: Box, width: Column, height: Column) -> Column:
    """Clipped area over full area; null for a box without area."""
    return F.try_divide(box_area(clip_box(b, width, height)), box_area(b))


def scale_box(b: Box, sx: Column, sy: Column) -> Box:
    """Fractions of the sides to pixels."""
    return Box(b.x1 * sx, b.y1 * sy, b.x2 * sx, b.y2 * sy)


def to_centre(b: Box, width: Column, height: Column) -> list[Column]:
    """cx, cy, w, h as fractions of the photo's sides."""
    return [
        ((b.x1 + b.x2) / 2 / width).alias("cx"),
        ((b.y1 + b.y2) / 2 / height).alias("cy"),
        ((b.x2 - b.x1) / width).alias("w"),
        ((b.y2 - b.y1) / height).alias("h"),
    ]


def from_centre(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Box:
    return Box((cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height)


def confidence_filter(df: DataFrame, least: float = 0.10, conf: str = "conf") -> DataFrame:
    return df.filter(F.col(conf) >= least)


def view_quality(b: Box, conf: Column, width: Column, height: Column) -> Column:
    """Area times confidence; a fifth of it for a box within 2 px of a photo border."""
    cut = (b.x1 <= 2) | (b.y1 <= 2) | (b.x2 >= width - 2) | (b.y2 >= height - 2)
    return (b.x2 - b.x1) * (b.y2 - b.y1) * conf * F.when(cut, F.lit(0.2)).otherwise(F.lit(1.0))


def fit_scale(width: Column, height: Column, most: float = 6000.0) -> Column:
    """By how much a photo is shrunk so that its longer side has at most `most` pixels."""
    return F.least(F.lit(1.0), F.lit(most) / F.greatest(width, height))


def rescale_box(b: Box, shrink: Column) -> Box:
    """Boxes found in a shrunk photo, in whole pixels of the full one (halves to even)."""
    return Box(*(F.bround(c / shrink, 0) for c in b))


def min_box_size(boxes: Column, least: float = 12.0) -> Column:
    """Of an array of box structs those with both sides of at least `least` pixels."""
    return F.filter(boxes, lambda b: (b.x2 - b.x1 >= least) & (b.y2 - b.y1 >= least))
