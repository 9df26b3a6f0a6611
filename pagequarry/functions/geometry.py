"""Box arithmetic as Column expressions over flat coordinates, so that predicates stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box:
    """Four columns of a box under a prefix or alias: ``Box("l.")`` names l.x1, l.y1, l.x2, l.y2."""

    def __init__(self, prefix: str = ""):
        self.x1, self.y1, self.x2, self.y2 = (F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1


def area(b: Box) -> Column:
    """Never below 0."""
    return F.greatest(b.width, F.lit(0)) * F.greatest(b.height, F.lit(0))


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def touches(a: Box, b: Box) -> Column:
    """Range conditions of a join: the boxes share area."""
    return (a.x1 < b.x2) & (b.x1 < a.x2) & (a.y1 < b.y2) & (b.y1 < a.y2)


def iou(a: Box, b: Box) -> Column:
    """0 where the union has no area."""
    i = intersection(a, b)
    u = area(a) + area(b) - i
    return F.when(u > 0, i / u).otherwise(F.lit(0.0))


def cover(inner: Box, outer: Box) -> Column:
    """Share of ``inner`` that lies in ``outer``."""
    return intersection(inner, outer) / F.greatest(area(inner), F.lit(1e-6))


def inside(inner: Box, holder: Box, share: float) -> Column:
    return cover(inner, holder) >= share


def cuts(box: Box, inner: Box, low: float = 0.12, high: float = 0.88) -> Column:
    """A region that takes a part of ``inner``, neither next to nothing nor nearly all."""
    c = cover(inner, box)
    return (c > low) & (c < high)


def overlap_1d(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Overlap of two intervals as a share of the shorter."""
    shorter = F.least(a2 - a1, b2 - b1)
    return F.greatest(F.least(a2, b2) - F.greatest(a1, b1), F.lit(0)) / F.greatest(shorter, F.lit(1e-6))


def normalised(x1: Column, y1: Column, x2: Column, y2: Column) -> list[Column]:
    """A box with x1 <= x2 and y1 <= y2, rounded to two places."""
    return [F.round(c, 2).alias(n) for c, n in ((F.least(x1, x2), "x1"), (F.least(y1, y2), "y1"), (F.greatest(x1, x2), "x2"), (F.greatest(y1, y2), "y2"))]


#: Classes whose content is media, tables or thrown away; all others are text (fixed values).
BUCKETS = {"table": "TABLE", "figure": "MEDIA", "header": "DISCARD", "footer": "DISCARD", "page_number": "DISCARD", "separator": "DISCARD"}


def bucket(cls: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in BUCKETS.items() for x in pair])
    return F.coalesce(F.element_at(lookup, cls), F.lit("TEXT"))


def score_band(value: Column, cuts_: tuple[float, ...], reverse: bool = False) -> Column:
    """1 plus the number of cuts reached, mirrored if low values are good; null stays null."""
    reached = sum((F.when(value >= c, 1).otherwise(0) for c in cuts_), F.lit(1))
    return F.when(value.isNotNull(), (len(cuts_) + 2) - reached if reverse else reached)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a share; (0, 1) without cases."""
    p, zz = k / n, z * z
    mid = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n == 0, 0.0).otherwise(F.greatest(mid - half, F.lit(0.0))), F.when(n == 0, 1.0).otherwise(F.least(mid + half, F.lit(1.0)))
