"""Rectangles as struct<x0,y0,x1,y1:double> and their algebra as column expressions (GEO-1 to GEO-12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"


def rect(x0="x0", y0="y0", x1="x1", y1="y1") -> Column:
    cols = [c if isinstance(c, Column) else F.col(c) for c in (x0, y0, x1, y1)]
    return F.struct(*[c.cast("double").alias(n) for c, n in zip(cols, ("x0", "y0", "x1", "y1"), strict=True)])


def width(r: Column) -> Column:
    return r["x1"] - r["x0"]


def height(r: Column) -> Column:
    return r["y1"] - r["y0"]


def area(r: Column) -> Column:
    """0 for empty or inverted rectangles."""
    return F.greatest(width(r), F.lit(0.0)) * F.greatest(height(r), F.lit(0.0))


def intersect(a: Column, b: Column) -> Column:
    """GEO-5: may be inverted where the rectangles don't meet; its area is then 0."""
    return rect(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))


def union(a: Column, b: Column) -> Column:
    """GEO-5: the smallest rectangle around both; a null side gives the other."""
    both = rect(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def common_area(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def cover(inner: Column, outer: Column) -> Column:
    """GEO-1: share of ``inner`` that ``outer`` covers."""
    return common_area(inner, outer) / F.greatest(area(inner), F.lit(1e-6))


def hit_any(r: Column, rects: Column, share: float) -> Column:
    """GEO-2: some rectangle of the list covers ``share`` of r."""
    return F.coalesce(F.exists(rects, lambda q: cover(r, q) >= share), F.lit(False))


def y_overlap(a: Column, b: Column) -> Column:
    return F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])


def x_overlap(a: Column, b: Column) -> Column:
    return F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])


def same_line(a: Column, b: Column) -> Column:
    """GEO-3: vertical overlap beyond half the lower height."""
    return y_overlap(a, b) > 0.5 * F.least(height(a), height(b))


def x_aligned(a: Column, b: Column) -> Column:
    """GEO-4: horizontal overlap beyond 0.55 of the narrower width."""
    narrow = F.least(width(a), width(b))
    return F.when(narrow > 0, x_overlap(a, b) / F.nullif(narrow, F.lit(0.0)) > 0.55).otherwise(False)


def centre_in(r: Column, region: Column) -> Column:
    """GEO-6."""
    cx, cy = (r["x0"] + r["x1"]) / 2, (r["y0"] + r["y1"]) / 2
    return cx.between(region["x0"], region["x1"]) & cy.between(region["y0"], region["y1"])


def hits_regions(r: Column, regions: Column, least: float = 0.5) -> Column:
    """GEO-7: shares an area of ``least`` with some region."""
    return F.coalesce(F.exists(regions, lambda q: common_area(r, q) >= least), F.lit(False))


def cut_out(r: Column, regions: Column, ignore: float = 0.5, sliver: float = 0.2, side: float = 1.0) -> Column:
    """GEO-8: what is left of r without the regions, as rectangles of at least ``side`` both ways.

    Each region leaves up to four parts of a rectangle: above, below, left and right of it.
    Overlaps of less than ``ignore`` and margins of at most ``sliver`` don't cut.
    """

    def parts(p: Column, g: Column) -> Column:
        hit = intersect(p, g)
        above = rect(p["x0"], p["y0"], p["x1"], hit["y0"])
        below = rect(p["x0"], hit["y1"], p["x1"], p["y1"])
        left = rect(p["x0"], hit["y0"], hit["x0"], hit["y1"])
        right = rect(hit["x1"], hit["y0"], p["x1"], hit["y1"])
        cut = F.filter(F.array(above, below, left, right), lambda q: (width(q) > sliver) & (height(q) > sliver))
        return F.when(common_area(p, g) < ignore, F.array(p)).otherwise(cut)

    rest = F.aggregate(regions, F.array(r), lambda acc, g: F.flatten(F.transform(acc, lambda p: parts(p, g))))
    return F.filter(rest, lambda p: (width(p) >= side) & (height(p) >= side))


def covered_share(r: Column, rects: Column, full: float = 0.8) -> Column:
    """GEO-9: common areas added up (overlaps count twice) over the area; 1 from ``full`` on and for empty r."""
    total = F.aggregate(rects, F.lit(0.0), lambda acc, q: acc + common_area(r, q)) / F.nullif(area(r), F.lit(0.0))
    return F.when(area(r) <= 0, F.lit(1.0)).when(total >= full, F.lit(1.0)).otherwise(total)


def covered(r: Column, rects: Column, share: float = 0.6) -> Column:
    """GEO-10: common areas add up to ``share`` of r; false for empty r."""
    total = F.aggregate(rects, F.lit(0.0), lambda acc, q: acc + common_area(r, q))
    return (area(r) > 0) & (total >= share * area(r))


def side(r: Column, middle: Column) -> Column:
    """GEO-11: column 0 or 1, null in the gutter of 6 pt either side."""
    c = (r["x0"] + r["x1"]) / 2
    return F.when(c < middle - 6, 0).when(c > middle + 6, 1)
