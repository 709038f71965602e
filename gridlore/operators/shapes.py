"""Regions in tables: overlay, buffers, repair, clipping, triangulation and prisms as Arrow-batched column functions.

A region column is array<array<double>>: rings as flat coordinates x, y, x, y, ... without a repeated last point, outer
rings counter-clockwise, holes clockwise (see `gridlore.functions.plane`). A line column is array<double>, flat as well. Null
regions give null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.functions import buffers, plane
from gridlore.functions.simplify import kept_places
from gridlore.operators import spatial
from gridlore.operators.tables import settled

REGION = "array<array<double>>"
#: The same as types, since a function's result is declared before there is a session.
_REGION = T.ArrayType(T.ArrayType(T.DoubleType()))
_PIECES = T.StructType([T.StructField("bridge", _REGION), T.StructField("land", _REGION)])
_MESH = T.StructType([T.StructField("points", _REGION), T.StructField("faces", T.ArrayType(T.ArrayType(T.LongType())))])


def to_rings(value) -> plane.Rings:
    return [plane.as_ring(np.asarray(r, float)) for r in value if r is not None and len(r) >= 6]


def to_lists(rings: plane.Rings) -> list[list[float]]:
    return [np.asarray(r, float).ravel().tolist() for r in rings]


def _each(f, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*columns, strict=True)], dtype=object)


def flat_ring(points: Column) -> Column:
    """array<struct<x,y>> as flat coordinates; a closed ring loses its last point."""
    flat = F.flatten(F.transform(points, lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))))
    closed = (F.size(points) > 1) & (F.get(points, F.lit(0)) == F.get(points, F.size(points) - 1))
    return F.when(closed, F.slice(flat, F.lit(1), F.greatest(F.size(flat) - 2, F.lit(0)))).otherwise(flat)


def flat_line(points: Column) -> Column:
    return F.flatten(F.transform(points, lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))))


def box_region(x0, y0, x1, y1) -> Column:
    d = lambda c: F.col(c).cast("double") if isinstance(c, str) else c.cast("double")
    return F.array(F.array(d(x0), d(y0), d(x1), d(y0), d(x1), d(y1), d(x0), d(y1)))


def region_area(rings: Column) -> Column:
    """The sum of the rings' shoelace areas, in the engine; differences from a ring's first point keep it exact."""

    def ring(r):
        n = F.size(r) / 2
        at = lambda i, k: F.element_at(r, (2 * (i % n) + k + 1).cast("int")) - F.element_at(r, k + 1)
        cross = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: at(i, 0) * at(i + 1, 1) - at(i + 1, 0) * at(i, 1))
        return F.when(F.size(r) >= 6, F.aggregate(cross, F.lit(0.0), lambda a, v: a + v) / 2).otherwise(0.0)

    return F.aggregate(F.transform(rings, ring), F.lit(0.0), lambda a, v: a + v)


def bounds(rings: Column) -> Column:
    """(x0, y0, x1, y1) of a region."""
    axis = lambda k: F.flatten(F.transform(rings, lambda r: F.filter(r, lambda v, i: i % 2 == k)))
    return F.struct(F.array_min(axis(0)).alias("x0"), F.array_min(axis(1)).alias("y0"), F.array_max(axis(0)).alias("x1"), F.array_max(axis(1)).alias("y1"))


def centroid(rings: Column | str) -> Column:
    """(x, y) of the centre of a region's area, in the engine; null where it has none."""
    rings = F.col(rings) if isinstance(rings, str) else rings
    x0, y0 = rings[0][0], rings[0][1]

    def ring(r):
        n = F.size(r) / 2
        at = lambda i, k, base: F.element_at(r, (2 * (i % n) + k + 1).cast("int")) - base

        def step(i):
            ax, ay, bx, by = at(i, 0, x0), at(i, 1, y0), at(i + 1, 0, x0), at(i + 1, 1, y0)
            cross = ax * by - bx * ay
            return F.struct(cross.alias("a"), ((ax + bx) * cross).alias("x"), ((ay + by) * cross).alias("y"))

        return F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), step)

    steps = F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) >= 6), ring))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    total = F.aggregate(steps, zero, lambda t, s: F.struct((t["a"] + s["a"]).alias("a"), (t["x"] + s["x"]).alias("x"), (t["y"] + s["y"]).alias("y")))
    part = lambda c, base: (base + total[c] / (3 * total["a"])).alias(c)
    return F.when(total["a"] != 0, F.struct(part("x", x0), part("y", y0)))


def outlines(rings: Column) -> Column:
    """Rings of three points at least, each with the number of its first point among the region's points."""
    kept = F.filter(rings, lambda r: F.size(r) >= 6)
    size = F.transform(kept, lambda r: (F.size(r) / 2).cast("int"))
    return F.transform(kept, lambda r, i: F.struct(F.aggregate(F.slice(size, F.lit(1), i), F.lit(0), lambda a, v: a + v).alias("begins"), r.alias("ring")))


def _rectangle(value) -> tuple | None:
    """x0, y0, x1, y1 of a region that is one rectangle with level and upright sides."""
    if len(value) != 1 or value[0] is None or len(value[0]) != 8:
        return None
    a, b, c, d, e, f, g, h = value[0]
    if (a == c and d == f and e == g and h == b or b == d and c == e and f == h and g == a) and a != e and b != f:
        return min(a, e), min(b, f), max(a, e), max(b, f)
    return None


def _upright(value) -> bool:
    """Whether a region is one such rectangle that runs counter-clockwise."""
    if not _rectangle(value):
        return False
    a, b, c, d, e, f, *_ = value[0]
    return (c - a) * (f - d) > (e - c) * (d - b)


def _overlaid(overlay, apart, first_in_second, second_in_first, other=None) -> object:
    """The overlay of each two regions; two rectangles that do not touch, or of which one holds the other, need none, but are what the next three
    say, and all others what `other` says, if it is known."""

    def one(x, y):
        a, b = _rectangle(x), _rectangle(y)
        if a and b:
            if a[0] > b[2] or b[0] > a[2] or a[1] > b[3] or b[1] > a[3]:
                return apart(a, b)
            if first_in_second and a[0] >= b[0] and a[1] >= b[1] and a[2] <= b[2] and a[3] <= b[3]:
                return first_in_second(a, b)
            if second_in_first and b[0] >= a[0] and b[1] >= a[1] and b[2] <= a[2] and b[3] <= a[3]:
                return second_in_first(a, b)
            if other:
                return other(a, b)
        return to_lists(overlay(to_rings(x), to_rings(y)))

    return one


def _ring_of(r: tuple) -> list[float]:
    x0, y0, x1, y1 = r
    return [x0, y0, x1, y0, x1, y1, x0, y1]


def _common(a: tuple, b: tuple) -> list[list[float]]:
    x0, y0, x1, y1 = max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])
    return [_ring_of((x0, y0, x1, y1))] if x0 < x1 and y0 < y1 else []


_INTERSECTION = _overlaid(plane.intersection, lambda a, b: [], lambda a, b: [_ring_of(a)], lambda a, b: [_ring_of(b)], lambda a, b: _common(a, b))
_DIFFERENCE = _overlaid(plane.difference, lambda a, b: [_ring_of(a)], lambda a, b: [], None)
_UNION = _overlaid(lambda x, y: plane.union([x, y]), lambda a, b: [_ring_of(a), _ring_of(b)], lambda a, b: [_ring_of(b)], lambda a, b: [_ring_of(a)])


@F.pandas_udf(_REGION)
def intersection(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(_INTERSECTION, a, b)


@F.pandas_udf(_REGION)
def difference(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(_DIFFERENCE, a, b)


@F.pandas_udf(_REGION)
def union(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(_UNION, a, b)


@F.pandas_udf(_REGION)
def repair(a: pd.Series) -> pd.Series:
    return _each(lambda x: to_lists(plane.repair(to_rings(x))), a)


@F.pandas_udf(T.ArrayType(_REGION))
def polygons(a: pd.Series) -> pd.Series:
    """A region's polygons, each an outer ring with its holes."""
    return _each(lambda x: [[x[0].tolist()]] if _upright(x) else [to_lists(p) for p in plane.parts(to_rings(x))], a)


@F.pandas_udf(T.BooleanType())
def contains(a: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([None if r is None or np.isnan(u) or np.isnan(v) else bool(plane.contains(to_rings(r), u, v)[0]) for r, u, v in zip(a, x, y, strict=True)], dtype=object)


def _buffered(round_ends: bool):
    @F.pandas_udf(_REGION)
    def buffer(line: pd.Series, half: pd.Series) -> pd.Series:
        return _each(lambda p, h: to_lists(plane.buffer_line(p, h, round_ends)), line, half)

    return buffer


#: Lines with round ends and joints, and with flat ends and mitred joints.
buffer_round, buffer_flat = _buffered(True), _buffered(False)


@F.arrow_udf(T.DoubleType())
def buffer_round_area(line: pa.Array, half: pa.Array) -> pa.Array:
    """The area of buffer_round's region, of a batch's lines together."""
    known = pc.and_(line.is_valid(), half.is_valid())
    kept = line.filter(known)
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(kept).to_numpy(zero_copy_only=False).astype(np.int64))))
    area = buffers.round_areas(kept.flatten().to_numpy(zero_copy_only=False), ends // 2, half.filter(known).to_numpy(zero_copy_only=False))
    return pc.replace_with_mask(pa.nulls(len(line), pa.float64()), known, pa.array(area, pa.float64()))


def clip_line(inside: bool):
    @F.pandas_udf(_REGION)
    def clip(line: pd.Series, region: pd.Series) -> pd.Series:
        return _each(lambda p, r: to_lists(plane.clip_line(p, to_rings(r), inside)), line, region)

    return clip


@F.pandas_udf(_PIECES)
def split_at_boundary(line: pd.Series, region: pd.Series) -> pd.DataFrame:
    """A line's pieces between its meetings with a region's boundary: bridge where the piece lies inside (by a point on it: the centroid of one around a corner may lie on
    the other side), else land. A line that does not meet the region is all land."""
    rows = []
    for p, r in zip(line, region, strict=True):
        if p is None or r is None:
            rows.append((None, None))
            continue
        rings = to_rings(r)
        pieces = [x for x in plane.split_line(p, rings) if plane.line_length(x)]
        inside = [bool(plane.contains(rings, *plane.inner_point(x))[0]) for x in pieces]
        if not any(inside):
            pieces, inside = [np.asarray(p, float).reshape(-1, 2)], [False]
        rows.append(([x.ravel().tolist() for x, i in zip(pieces, inside, strict=True) if i], [x.ravel().tolist() for x, i in zip(pieces, inside, strict=True) if not i]))
    return pd.DataFrame(rows, columns=["bridge", "land"])


def simplify_region(rings: Column, tolerance: float, largest: bool = False) -> Column:
    """Rings with fewer points, none of the others farther away than the tolerance. What comes out is made valid again; a region that
    vanishes stays as it was. largest: of one that falls apart only the polygon of the largest area."""

    @F.pandas_udf(_REGION)
    def simpler(a: pd.Series) -> pd.Series:
        def one(value):
            r = _rectangle(value) if _upright(value) else None
            if r and (r[2] - r[0]) * (r[3] - r[1]) > tolerance * (1 + 1e-9) * float(np.hypot(r[2] - r[0], r[3] - r[1])):
                # The corners are farther from the diagonal, so all stay; in the order that the overlay gives.
                return [[r[0], r[3], r[0], r[1], r[2], r[1], r[2], r[3]]]
            rings_ = to_rings(value)
            less = []
            for r in rings_:
                closed = np.concatenate((r, r[:1]))
                k = kept_places(closed[:, 0], closed[:, 1], tolerance)
                less.append(closed[k][:-1])
            less = plane.repair([r for r in less if len(r) >= 3]) or rings_
            return to_lists(max(plane.parts(less), key=plane.area, default=[]) if largest else less)

        return _each(one, a)

    return simpler(rings)


def clip_to_box(df: DataFrame, window: tuple, kind: str = "kind", parts: str = "parts") -> DataFrame:
    """Features (kind: polygon, line or point; parts: rings, lines or points as flat coordinates) cut to a window; those of
    which nothing is left go, as do null ones. Features whose bounds lie inside are kept without a look at their points, and
    those outside are dropped before Python sees them."""
    x0, y0, x1, y1 = map(float, window)
    b = F.col("_b")
    met = df.where(F.col(parts).isNotNull() & (F.size(parts) > 0)).withColumn("_b", bounds(F.col(parts)))
    met = met.where((b["x0"] <= x1) & (b["x1"] >= x0) & (b["y0"] <= y1) & (b["y1"] >= y0))

    @F.pandas_udf(_REGION)
    def cut(kinds: pd.Series, a: pd.Series) -> pd.Series:
        rings = plane.box(x0, y0, x1, y1)

        def one(k, value):
            if k == "polygon":
                return to_lists(plane.intersection(to_rings(value), rings))
            if k == "line":
                return [x for p in value for x in to_lists(plane.clip_line(p, rings))]
            return [p for p in (np.asarray(v, float) for v in value) if x0 <= p[0] <= x1 and y0 <= p[1] <= y1]

        return _each(one, kinds, a)

    inside = (b["x0"] >= x0) & (b["x1"] <= x1) & (b["y0"] >= y0) & (b["y1"] <= y1)
    out = met.where(inside).unionByName(met.where(~inside).withColumn(parts, cut(F.col(kind), F.col(parts))))
    return out.where(F.size(parts) > 0).drop("_b")


def _sided(df: DataFrame, side: str, rings: str) -> DataFrame:
    b = bounds(F.col(rings))
    return df.withColumns({f"{side}{c}": b[c] for c in ("x0", "y0", "x1", "y1")})


def is_box(rings: Column) -> Column:
    """Whether a region is one rectangle with level and upright sides."""
    r = F.get(rings, F.lit(0))
    same = lambda *pairs: F.array(*(F.get(r, F.lit(a)) for a, _ in pairs)) == F.array(*(F.get(r, F.lit(b)) for _, b in pairs))
    return (F.size(rings) == 1) & (F.size(r) == 8) & (same((0, 2), (3, 5), (4, 6), (7, 1)) | same((1, 3), (2, 4), (5, 7), (6, 0)))


#: Parts that the regions of a cell are dealt to.
CELL_PARTS = 4


def covered_shares(regions: DataFrame, covers: DataFrame, size: float) -> DataFrame:
    """id and share of each region (id, rings) that the covers (rings) take together, overlaps counted once.

    Both are cut by a grid of cells of `size`. A cell's covers are united once, rectangles as rectangles that do not overlap, and each
    region meets what they take together, so the work grows with regions and covers and not with their pairs."""
    r = _sided(regions.select("id", "rings"), "a", "rings")
    r = r.withColumn("a_rings", F.when(is_box(F.col("rings")), None).otherwise(F.col("rings"))).drop("rings")
    c = _sided(covers.select("rings"), "b", "rings")
    c = c.withColumn("b_rings", F.when(is_box(F.col("rings")), None).otherwise(F.col("rings"))).drop("rings")
    span = lambda side, k: F.explode(F.sequence(F.floor(F.col(f"{side}{k}0") / size), F.floor(F.col(f"{side}{k}1") / size)))

    def celled(df, side):
        df = df.withColumn("cx", span(side, "x")).withColumn("cy", span(side, "y"))
        low = {f"{side}{k}0": F.greatest(F.col(f"{side}{k}0"), F.col(f"c{k}") * size) for k in "xy"}
        high = {f"{side}{k}1": F.least(F.col(f"{side}{k}1"), (F.col(f"c{k}") + 1) * size) for k in "xy"}
        return df.withColumns({**low, **high}).where(f"{side}x0 < {side}x1 AND {side}y0 < {side}y1")

    sides = lambda table, side: np.stack([table.column(f"{side}{k}").to_numpy() for k in ("x0", "y0", "x1", "y1")], 1).astype(float)
    cell = lambda table: plane.box(*((table.column(c)[0].as_py() + k) * size for k in (0, 1) for c in ("cx", "cy")))

    def once(table: pa.Table) -> pa.Table:
        other = np.asarray(table.column("b_rings").combine_chunks().is_valid())
        boxes = plane.disjoint_boxes(sides(table, "b")[~other])
        over = []
        if other.any():
            rest = [plane.intersection(to_rings(x), cell(table)) for x in table.column("b_rings").to_pylist() if x is not None]
            over, boxes = plane.union([*rest, [q for p in boxes for q in plane.box(*p)]]), boxes[:0]
        return pa.table({"cx": table.column("cx")[:1], "cy": table.column("cy")[:1], "boxes": pa.array([boxes.ravel()], pa.list_(pa.float64())), "over": pa.array([to_lists(over)], pa.list_(pa.list_(pa.float64())))})

    def common(own: pa.Table, cover: pa.Table) -> pa.Table:
        n = own.num_rows if cover.num_rows else 0
        covered = np.zeros(n)
        if n:
            a, b = sides(own, "a"), np.array(cover.column("boxes")[0].as_py(), float).reshape(-1, 4)
            over = to_rings(cover.column("over")[0].as_py())
            for k in range(0, n, step := max(1, plane._PAIRS // max(1, len(b)))):
                p = a[k : k + step, None]
                x, y = (np.minimum(p[..., i + 2], b[:, i + 2]) - np.maximum(p[..., i], b[:, i]) for i in (0, 1))
                covered[k : k + step] = (np.maximum(x, 0) * np.maximum(y, 0)).sum(1)
            rings = own.column("a_rings").combine_chunks()
            for i in range(n) if over else np.flatnonzero(np.asarray(rings.is_valid()) & (covered > 0)).tolist():
                mine = plane.intersection(to_rings(rings[i].as_py()), cell(own)) if rings[i].is_valid else plane.box(*a[i])
                near = (b[:, :2] < a[i, 2:]).all(1) & (b[:, 2:] > a[i, :2]).all(1)
                covered[i] = plane.area(plane.intersection(mine, over or [q for p in b[near] for q in plane.box(*p)]))
        return pa.table({"id": own.column("id")[:n], "cx": own.column("cx")[:n], "cy": own.column("cy")[:n], "covered": covered})

    kind = regions.schema["id"].dataType.simpleString()
    whole_cover = celled(c, "b").distinct().groupBy("cx", "cy").applyInArrow(once, f"cx long, cy long, boxes array<double>, over {REGION}")
    whole_cover = whole_cover.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(CELL_PARTS - 1))))
    dealt = celled(r, "a").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(CELL_PARTS)).cast("int"))
    keys = ["cx", "cy", "part"]
    parts = dealt.groupBy(*keys).cogroup(whole_cover.groupBy(*keys)).applyInArrow(common, f"id {kind}, cx long, cy long, covered double")
    whole = regions.select("id", region_area(F.col("rings")).alias("whole"))
    # A region that comes twice counts once.
    found = parts.groupBy("id", "cx", "cy").agg(F.max("covered").alias("covered")).groupBy("id").agg(F.sum("covered").alias("covered")).join(whole, "id")
    return found.where("whole > 0 AND covered > 0").select("id", (F.col("covered") / F.col("whole")).alias("share"))


def united(regions: DataFrame, size: float) -> DataFrame:
    """cx, cy, rings: the union of all regions (rings) in pieces, one a grid cell that has any."""
    c = _sided(regions.select("rings"), "b", "rings")
    span = lambda k: F.explode(F.sequence(F.floor(F.col(f"b{k}0") / size), F.floor(F.col(f"b{k}1") / size)))
    c = c.withColumn("cx", span("x")).withColumn("cy", span("y")).select(F.col("cx").cast("long").alias("cx"), F.col("cy").cast("long").alias("cy"), "rings")

    def one(table: pa.Table) -> pa.Table:
        x, y = table.column("cx")[0].as_py(), table.column("cy")[0].as_py()
        cell = plane.box(x * size, y * size, (x + 1) * size, (y + 1) * size)
        over = plane.union([plane.intersection(to_rings(b), cell) for b in table.column("rings").to_pylist()])
        n = 1 if over else 0
        return pa.table({"cx": pa.array([x][:n], pa.int64()), "cy": pa.array([y][:n], pa.int64()), "rings": pa.array([to_lists(over)][:n], pa.list_(pa.list_(pa.float64())))})

    return c.groupBy("cx", "cy").applyInArrow(one, f"cx long, cy long, rings {REGION}")


def without_covered(regions: DataFrame, covers: DataFrame, size: float, most: float) -> DataFrame:
    """The regions (id, rings and more) of which the covers together take no more than `most`."""
    shares = covered_shares(regions, covers, size).where(F.col("share") > most).select("id")
    return regions.join(shares, "id", "left_anti")


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """a_id, b_id and the common area of each two regions (id, rings) whose bounds meet."""
    side = lambda df, s: _sided(df.select(F.col("id").alias(f"{s}_id"), F.col("rings").alias(f"{s}_rings")), s, f"{s}_rings")
    pairs = spatial.box_join(side(a, "a"), side(b, "b"))
    return pairs.select("a_id", "b_id", region_area(intersection("a_rings", "b_rings")).alias("common"))


def without_dominated(losers: DataFrame, winners: DataFrame, share: float) -> DataFrame:
    """losers (id, rings and more) without those that a single winner (rings) covers by more than `share`.

    Where both are rectangles the search ends at the first such winner; other pairs are overlaid if their bounds have enough in common."""
    side = lambda df, s, *more: _sided(df.select(*more, F.col("rings").alias(f"{s}_rings"), is_box(F.col("rings")).alias(f"{s}_box")), s, f"{s}_rings")
    a = side(losers, "a", F.col("id").alias("a_id"), region_area(F.col("rings")).alias("own"))
    b = side(winners, "b")
    plain = spatial.dominated_ids(a.where("a_box").drop("a_rings", "a_box"), b.where("b_box").drop("b_rings", "b_box").distinct(), share)
    left = spatial.box_join(a.where("a_box"), b.where("NOT b_box")).unionByName(spatial.box_join(a.where("NOT a_box"), b))
    left = left.where(spatial.overlap_area() > share * F.col("own"))
    hit = left.where(region_area(intersection("a_rings", "b_rings")) > share * F.col("own")).select("a_id")
    return losers.join(plain.unionAll(hit).select(F.col("a_id").alias("id")), "id", "left_anti")


def with_centroids(df: DataFrame) -> DataFrame:
    """df, which has rings among plain columns, with the centre of each region (cx, cy). A step of its own, so that later steps do not repeat it."""

    def work(batches):
        for batch in batches:
            found = [plane.centroid(r) if (r := to_rings(x or [])) else (None, None) for x in batch.column("rings").to_pylist()]
            for k, name in enumerate(("cx", "cy")):
                batch = batch.append_column(name, pa.array([c[k] for c in found], pa.float64()))
            yield batch

    return df.mapInArrow(work, T.StructType([*df.schema.fields, T.StructField("cx", T.DoubleType()), T.StructField("cy", T.DoubleType())]))


def meshed(df: DataFrame, longest: float | None = None) -> DataFrame:
    """df, which has rings among plain columns, with points and faces (counter-clockwise triangles) in their place, halved until no
    edge is over `longest` (five rounds at most); regions without any triangle go."""
    kept = [c for c in df.columns if c != "rings"]

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = []
                for x in part.column("rings").to_pylist():
                    points, faces = plane.triangulate(to_rings(x or []))
                    found.append(plane.refine(points, faces, longest) if longest else (points, faces))
                some = [len(f) > 0 for _, f in found]
                out = part.select(kept).filter(pa.array(some, pa.bool_()))
                for name, k, kind in (("points", 0, pa.float64()), ("faces", 1, pa.int64())):
                    out = out.append_column(name, pa.array([x[k].tolist() for x, s in zip(found, some, strict=True) if s], pa.list_(pa.list_(kind))))
                yield out

    schema = T.StructType([*(df.schema[c] for c in kept), *_MESH.fields])
    # Vertices and faces, and what is told from both, are read from one mesh.
    return settled(spatial.dealt(df.select(*kept, "rings"), "object").mapInArrow(work, schema))


def surfaces(df: DataFrame, longest: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of flat surfaces: df has object, rings and z."""
    x = meshed(df.select("object", "z", "rings"), longest)
    point = F.posexplode("points").alias("vid", "p")
    vertices = x.select("object", "z", point).select("object", F.col("vid").cast("long").alias("vid"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), F.col("z").cast("double").alias("z"))
    faces = x.select("object", F.posexplode("faces").alias("fid", "f")).select("object", F.col("fid").cast("long").alias("fid"), *(F.col("f")[k - 1].alias(f"v{k}") for k in (1, 2, 3)))
    return vertices, faces


def prisms(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of closed upright solids over regions with holes: df has object, rings, low and high.

    Caps are the triangulated region; walls stand on the edges that one triangle only has. Faces carry the places of their corners (see `mesh.corners`)."""
    x = meshed(df.select("object", "low", "high", "rings"))
    n = F.size("points").cast("long")
    at = lambda z: F.transform("points", lambda p, i: F.struct((i + F.when(F.lit(z == "high"), n).otherwise(0)).cast("long").alias("vid"), p[0].alias("x"), p[1].alias("y"), F.col(z).cast("double").alias("z")))
    vertices = x.select("object", F.explode(F.concat(at("low"), at("high"))).alias("v")).select("object", "v.*")
    face = lambda a, b, c: F.struct(a.alias("v1"), b.alias("v2"), c.alias("v3"))
    edges = F.flatten(F.transform("faces", lambda f: F.array(*(F.struct(f[i].alias("a"), f[(i + 1) % 3].alias("b")) for i in range(3)))))
    x = x.withColumn("n", n).withColumn("edges", edges)
    twins = F.transform("edges", lambda e: F.struct(e["b"].alias("a"), e["a"].alias("b")))
    rim = F.array_except("edges", twins)
    walls = F.flatten(F.transform(rim, lambda e: F.array(face(e["a"], e["b"], e["b"] + F.col("n")), face(e["a"], e["b"] + F.col("n"), e["a"] + F.col("n")))))
    caps = F.flatten(F.transform("faces", lambda f: F.array(face(f[0], f[2], f[1]), face(f[0] + F.col("n"), f[1] + F.col("n"), f[2] + F.col("n")))))
    faces = x.select("object", "points", "low", "high", "n", F.posexplode(F.concat(caps, walls)).alias("fid", "f"))
    v = lambda k: F.col(f"f.v{k}")
    point = lambda k, c: F.element_at(F.element_at("points", (v(k) % F.col("n") + 1).cast("int")), c + 1)
    corner = lambda k: (point(k, 0).alias(f"x{k}"), point(k, 1).alias(f"y{k}"), F.when(v(k) < F.col("n"), F.col("low")).otherwise(F.col("high")).cast("double").alias(f"z{k}"))
    return vertices, faces.select("object", F.col("fid").cast("long").alias("fid"), "f.*", *(c for k in (1, 2, 3) for c in corner(k)))
