"""Plane geometry as column expressions over arrays of struct<x,y>."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _pairs(points: Column, f) -> Column:
    """f of each two consecutive points."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    return F.zip_with(F.slice(points, F.lit(1), n), F.slice(points, F.lit(2), n), f)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def signed_area(ring: Column) -> Column:
    """Shoelace area of a closed ring, positive if counter-clockwise."""
    return _sum(_pairs(ring, lambda p, q: (p["x"] * q["y"] - q["x"] * p["y"]).cast("double"))) / 2


def line_length(points: Column) -> Column:
    return _sum(_pairs(points, lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))))


def close_ring(points: Column) -> Column:
    return F.concat(points, F.slice(points, F.lit(1), F.lit(1)))


def counter_clockwise(ring: Column) -> Column:
    return F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def densify(points: Column, step: float) -> Column:
    """Equal parts of at most `step` on every segment; the first point stays, a segment of no length adds none."""

    def cut(p, q):
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        n = F.ceil(F.sqrt(dx * dx + dy * dy) / step).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((p["x"] + dx * i / n).alias("x"), (p["y"] + dy * i / n).alias("y")))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))

    first = F.transform(F.slice(points, F.lit(1), F.lit(1)), lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    return F.concat(first, F.flatten(_pairs(points, cut)))


def chaikin(points: Column) -> Column:
    """One round of corner cutting of an open line; the ends stay."""

    def corner(p, q):
        at = lambda t: F.struct((p["x"] * (1 - t) + q["x"] * t).alias("x"), (p["y"] * (1 - t) + q["y"] * t).alias("y"))
        return F.array(at(0.25), at(0.75))

    real = F.transform(points, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    return F.concat(F.slice(real, F.lit(1), F.lit(1)), F.flatten(_pairs(points, corner)), F.slice(real, F.lit(-1), F.lit(1)))


def chaikin_ring(ring: Column) -> Column:
    """One round of corner cutting of a closed ring, closed again."""

    def corner(p, q):
        at = lambda t: F.struct((p["x"] * (1 - t) + q["x"] * t).cast("double").alias("x"), (p["y"] * (1 - t) + q["y"] * t).cast("double").alias("y"))
        return F.array(at(0.25), at(0.75))

    cut = F.flatten(_pairs(ring, corner))
    return F.concat(cut, F.slice(cut, F.lit(1), F.lit(1)))


def densify_long(points: Column, longest: float) -> Column:
    """Equal parts on the segments that are over `longest`; others, and segments of no length, stay as they are."""

    def cut(p, q):
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        size = F.sqrt((dx * dx + dy * dy).cast("double"))
        n = F.when(size > longest, F.ceil(size / longest)).otherwise(1).cast("int")
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct((p["x"] + dx * i / n).cast("double").alias("x"), (p["y"] + dy * i / n).cast("double").alias("y")))

    first = F.transform(F.slice(points, F.lit(1), F.lit(1)), lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    return F.concat(first, F.flatten(_pairs(points, cut)))


def densify_ring(points: Column, longest: float) -> Column:
    """As `densify_long`, closed at the end where the last point is not the first one."""
    return F.when((F.size(points) > 1) & (points[0] != F.element_at(points, -1)), densify_long(close_ring(points), longest)).otherwise(densify_long(points, longest))


def densify_inside(points: Column, longest: float) -> Column:
    """As `densify_long`, without a repeated last point."""
    whole = densify_long(points, longest)
    return F.when((F.size(whole) > 1) & (whole[0] == F.element_at(whole, -1)), F.slice(whole, F.lit(1), F.size(whole) - 1)).otherwise(whole)


def longest_edge(points: Column) -> Column:
    return F.array_max(_pairs(points, lambda p, q: F.sqrt(((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"])).cast("double"))))


def ring_centroid(ring: Column) -> Column:
    """(x, y) of the centre of a closed ring's area; null where it has none."""
    cross = lambda p, q: (p["x"] * q["y"] - q["x"] * p["y"]).cast("double")
    whole = signed_area(ring)
    part = lambda c: _sum(_pairs(ring, lambda p, q: (p[c] + q[c]) * cross(p, q))) / (6 * whole)
    return F.when(whole != 0, F.struct(part("x").alias("x"), part("y").alias("y")))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _angles(y: pd.Series, x: pd.Series) -> pd.Series:
    """atan2 of each two elements, by the C library: the engine's own may differ in the last place, which changes the order on a line through the mean."""
    return pd.Series([None if a is None or b is None else list(map(math.atan2, a, b)) for a, b in zip(y, x, strict=True)], dtype=object)


def by_angle(points: Column) -> Column:
    """Points counter-clockwise around their mean, from the angle of -pi on; equal angles by coordinates."""
    mean = lambda c: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[c]) / F.size(points)
    away = lambda c: F.zip_with(points, F.array_repeat(mean(c), F.size(points)), lambda p, m: p[c] - m)
    keyed = F.zip_with(points, _angles(away("y"), away("x")), lambda p, a: F.struct(a.alias("angle"), p["x"].alias("x"), p["y"].alias("y")))
    return F.transform(F.array_sort(keyed), lambda k: F.struct(k["x"].alias("x"), k["y"].alias("y")))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Crossing number: whether a point lies in a closed ring."""
    crosses = _pairs(ring, lambda p, q: F.when(((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]), 1).otherwise(0))
    return F.aggregate(crosses, F.lit(0), lambda a, v: a + v) % 2 == 1


def clip_interval(x1, y1, x2, y2, xmin, ymin, xmax, ymax) -> tuple[Column, Column]:
    """Liang-Barsky: the part t0..t1 of a segment inside a box; empty if t0 > t1."""
    low, high = [F.lit(0.0)], [F.lit(1.0)]
    for p, d, a, b in ((x1, x2 - x1, xmin, xmax), (y1, y2 - y1, ymin, ymax)):
        still, inside = d == 0, (p >= a) & (p <= b)
        rate = F.when(still, 1.0).otherwise(d)
        near, far = (a - p) / rate, (b - p) / rate
        low.append(F.when(still, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(near, far)))
        high.append(F.when(still, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(near, far)))
    return F.greatest(*low), F.least(*high)
