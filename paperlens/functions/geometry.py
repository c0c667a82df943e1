"""Geometry of boxes as Column expressions. A box is four columns x0, y0, x1, y1 with a prefix; y grows downwards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))

    @classmethod
    def of_array(cls, c: Column) -> Box:
        return cls(*(F.get(c, F.lit(i)).cast("double") for i in range(4)))

    @property
    def width(self) -> Column:
        return F.abs(self.x1 - self.x0)

    @property
    def height(self) -> Column:
        return F.abs(self.y1 - self.y0)

    @property
    def area(self) -> Column:
        return self.width * self.height

    def ordered(self) -> Box:
        return Box(F.least(self.x0, self.x1), F.least(self.y0, self.y1), F.greatest(self.x0, self.x1), F.greatest(self.y0, self.y1))

    def struct(self) -> Column:
        return F.struct(self.x0.alias("x0"), self.y0.alias("y0"), self.x1.alias("x1"), self.y1.alias("y1"))


def _zero(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c)


def union(a: Box, b: Box) -> Box:
    return Box(F.least(a.x0, b.x0), F.least(a.y0, b.y0), F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1))


def intersection_area(a: Box, b: Box) -> Column:
    a, b = a.ordered(), b.ordered()
    return _zero(F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)) * _zero(F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))


def contains(outer: Box, inner: Box) -> Column:
    o, i = outer.ordered(), inner.ordered()
    return (o.x0 <= i.x0) & (o.x1 >= i.x1) & (o.y0 <= i.y0) & (o.y1 >= i.y1)


def overlap_ratio(outer: Box, inner: Box) -> Column:
    """Share of the inner box that the outer one covers; 0 for an inner box without area."""
    return F.when(inner.area > 0, intersection_area(outer, inner) / inner.area).otherwise(0.0)


def iou(a: Box, b: Box) -> Column:
    both = intersection_area(a, b)
    whole = a.area + b.area - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def aspect(b: Box) -> Column:
    return F.when(b.height > 0, b.width / b.height).otherwise(0.0)


def horizontal_overlap(a: Box, b: Box) -> Column:
    """Common width as a share of the narrower box."""
    narrow = F.least(a.width, b.width)
    return F.when(narrow > 0, _zero(F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)) / narrow).otherwise(0.0)


def gaps(a: Box, b: Box) -> tuple[Column, Column]:
    """(vertical, horizontal) gap between two boxes; 0 where they overlap in that direction."""
    return _zero(F.greatest(b.y0 - a.y1, a.y0 - b.y1)), _zero(F.greatest(b.x0 - a.x1, a.x0 - b.x1))


def aligned(a: Box, b: Box) -> Column:
    """In one row or one column, with like sizes across."""
    v = _zero(F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))
    h = _zero(F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0))
    like = lambda p, q: F.abs(p - q) / F.greatest(p, q) < 0.35
    row = (v > 0) & (v / F.least(a.height, b.height) > 0.5) & like(a.height, b.height)
    column = (h > 0) & (h / F.least(a.width, b.width) > 0.5) & like(a.width, b.width) & (gaps(a, b)[0] < F.least(a.height, b.height) * 0.30)
    return row | column


def adjust(b: Box, left: Column, top: Column, right: Column, bottom: Column) -> Box:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return Box(b.x0 + zero(left), b.y0 + zero(top), b.x1 + zero(right), b.y1 + zero(bottom))


def is_noise(b: Box, desc: Column) -> Column:
    """A block without a description of its own that is tiny, a stripe or a banner."""
    bare = desc.rlike("^(?:image|chart|table) on page")
    w, h = b.width, b.height
    ratio = F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1.0))
    return bare & (((w < 40) & (h < 40)) | (ratio > 10) | ((w > 300) & (h < 55) & (ratio > 6)) | (b.area < 1200))


def plausible_figure(b: Box) -> Column:
    return (b.area >= 800) & aspect(b).between(1 / 15, 15)


def plausible_clip(b: Box) -> Column:
    return (b.area >= 2000) & aspect(b).between(1 / 12, 12)


def plausible_fill(b: Box) -> Column:
    return (b.area > 3000) & (b.width > 100) & (b.height > 10)


def caption_score(keyword: Column, gap: Column, overlap: Column) -> Column:
    """How well a text fits a body as its caption, at most 1."""
    return F.least(F.lit(1.0), keyword * 0.6 + F.exp(-gap / 50.0) * 0.3 + overlap * 0.1)


def svg_matrix(c: Column) -> Column:
    """The six numbers of `matrix(a,b,c,d,e,f)`; null otherwise."""
    body = F.regexp_extract(c, "matrix\\(([^)]*)\\)", 1)
    numbers = F.transform(F.filter(F.split(body, "[\\s,]+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    return F.when(F.size(numbers) == 6, numbers)
