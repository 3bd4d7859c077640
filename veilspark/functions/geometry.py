"""Polygons as array<struct<x:int,y:int>>: boxes, scaling and clipping as column expressions.

Boxes are half-open; a stored polygon holds the last pixels, so the right and
bottom of a bounding box are one beyond its largest vertices.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x, y) -> Column:
    return F.struct(F.lit(x).cast("int").alias("x") if not isinstance(x, Column) else x.cast("int").alias("x"), y.cast("int").alias("y") if isinstance(y, Column) else F.lit(y).cast("int").alias("y"))


def from_bbox(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Corners from top left clockwise, with exclusive right and bottom taken back by one."""
    return F.array(point(x1, y1), point(x2 - 1, y1), point(x2 - 1, y2 - 1), point(x1, y2 - 1))


def bounding_box(p: Column) -> Column:
    xs, ys = F.transform(p, lambda v: v["x"]), F.transform(p, lambda v: v["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), (F.array_max(xs) + 1).alias("x2"), (F.array_max(ys) + 1).alias("y2"))


def fully_inside(p: Column, width: Column, height: Column) -> Column:
    return F.forall(p, lambda v: (v["x"] >= 0) & (v["y"] >= 0) & (v["x"] < width) & (v["y"] < height))


def centre(p: Column, axis: str) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, v: a + v[axis]) / F.size(p)


def let(value: Column, of) -> Column:
    """of(value), with value evaluated once: inside a lambda a column stands for its whole expression each time."""
    return F.element_at(F.transform(F.array(value), of), 1)


def max_uniform_scale(p: Column, width: Column, height: Column) -> Column:
    """The largest factor about the vertex mean that keeps all vertices inside; infinite for a single point."""

    def limits(t):
        of = lambda v, axis, size: F.when(v[axis] > t[axis], (size - 1 - t[axis]) / (v[axis] - t[axis])).when(v[axis] < t[axis], t[axis] / (t[axis] - v[axis])).otherwise(F.lit(float("inf")))
        return F.greatest(F.lit(0.0), F.array_min(F.transform(t["p"], lambda v: F.least(of(v, "x", width), of(v, "y", height)))))

    free = let(F.struct(p.alias("p"), centre(p, "x").alias("x"), centre(p, "y").alias("y")), limits)
    return F.when((width <= 0) | (height <= 0) | (F.size(p) < 3), F.lit(1.0)).otherwise(free)


def scale(p: Column, factor: Column) -> Column:
    """About the vertex mean; coordinates are cut towards zero."""

    def moved(t):
        return F.transform(p, lambda v: point(t["x"] + (v["x"] - t["x"]) * t["f"], t["y"] + (v["y"] - t["y"]) * t["f"]))

    return F.when(factor == 1, p).otherwise(let(F.struct(centre(p, "x").alias("x"), centre(p, "y").alias("y"), factor.alias("f")), moved))


def scale_clamped(p: Column, factor: Column, width: Column, height: Column) -> Column:
    """scale(), by no more than fits: a polygon that hangs over an edge shrinks."""
    fits = F.least(factor, max_uniform_scale(p, width, height))
    return F.when(factor == 1, p).otherwise(let(fits, lambda f: F.when(f <= 0, p).otherwise(scale(p, f))))


def clip(p: Column, width: Column, height: Column) -> Column:
    return F.transform(p, lambda v: point(F.greatest(F.lit(0), F.least(v["x"], width - 1)), F.greatest(F.lit(0), F.least(v["y"], height - 1))))


def _fold(p: Column, of) -> Column:
    n = F.size(p)
    at = lambda i: F.element_at(p, (i % n + 1).cast("int"))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + of(at(i), at(i + 1)))


def area(p: Column) -> Column:
    return F.abs(_fold(p, lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]).cast("double"))) / 2


def perimeter(p: Column) -> Column:
    return _fold(p, lambda a, b: F.sqrt(((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])).cast("double")))


def unclip_distance(p: Column, ratio: float = 1.6) -> Column:
    return area(p) * ratio / F.greatest(perimeter(p), F.lit(1e-6))


def is_convex(p: Column) -> Column:
    """All turns in one direction (collinear points allowed)."""
    n = F.size(p)
    at = lambda i: F.element_at(p, (i % n + 1).cast("int"))

    def turn(i):
        a, b, c = at(i), at(i + 1), at(i + 2)
        return (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"])

    turns = F.transform(F.sequence(F.lit(0), n - 1), turn)
    return F.forall(turns, lambda t: t >= 0) | F.forall(turns, lambda t: t <= 0)


def ordered_quad(p: Column) -> Column:
    """Four points as top left, top right, bottom right, bottom left: the two leftmost, then by height in each pair."""
    s = F.array_sort(F.transform(p, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))))
    a, b, c, d = (F.element_at(s, i) for i in (1, 2, 3, 4))
    left, right = b["y"] > a["y"], d["y"] > c["y"]
    return F.array(F.when(left, a).otherwise(b), F.when(right, c).otherwise(d), F.when(right, d).otherwise(c), F.when(left, b).otherwise(a))
