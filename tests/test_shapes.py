import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore import profiles as P
from gridlore.functions import geometry as G
from gridlore.functions import buffers, plane
from gridlore.functions.gridfill import fill_holes, filled
from gridlore.operators import layers, mesh, raster, shapes, spatial

REGION = "array<array<double>>"


def star(r, n, x, y, size):
    turns = sorted(r.uniform(0, 2 * math.pi) for _ in range(n))
    return [np.array([(x + size * r.uniform(0.2, 1) * math.cos(t), y + size * r.uniform(0.2, 1) * math.sin(t)) for t in turns])]


def boxes(r, n):
    return plane.union([plane.box(x, y, x + r.randint(1, 5), y + r.randint(1, 5)) for x, y in [(r.randint(0, 6), r.randint(0, 6)) for _ in range(n)]])


@pytest.mark.parametrize("seed", range(120))
def test_overlay_against_points_and_areas(seed):
    r = random.Random(seed)
    a = boxes(r, 4) if seed % 3 == 0 else plane.repair(star(r, r.randint(3, 12), 0, 0, 10))
    b = boxes(r, 3) if seed % 3 == 0 else plane.repair(star(r, r.randint(3, 12), r.uniform(-5, 5), r.uniform(-5, 5), 8))
    both, either, left = plane.intersection(a, b), plane.union([a, b]), plane.difference(a, b)
    assert plane.area(a) + plane.area(b) == pytest.approx(plane.area(both) + plane.area(either), abs=1e-4)
    assert plane.area(left) == pytest.approx(plane.area(a) - plane.area(both), abs=1e-4)
    assert plane.area(plane.symmetric_difference(a, b)) == pytest.approx(plane.area(either) - plane.area(both), abs=1e-4)
    if seed % 3 == 0:
        cells = lambda rings: plane.contains(rings, *(np.mgrid[0:12, 0:12].reshape(2, -1) + 0.5)).sum()
        assert plane.area(both) == cells(both) and plane.area(either) == cells(either)
    x, y = np.random.default_rng(seed).uniform(-12, 14, (2, 200))
    in_a, in_b = plane.contains(a, x, y), plane.contains(b, x, y)
    assert (plane.contains(both, x, y) == (in_a & in_b)).all() and (plane.contains(left, x, y) == (in_a & ~in_b)).all() and (plane.contains(either, x, y) == (in_a | in_b)).all()
    points, faces = plane.triangulate(left)
    assert sum(plane.ring_area(points[list(f)]) for f in faces) == pytest.approx(plane.area(left), abs=1e-4)
    assert all(plane.ring_area(points[list(f)]) > 0 for f in faces)
    assert sum(plane.area(p) for p in plane.parts(left)) == pytest.approx(plane.area(left), abs=1e-4)
    line = np.random.default_rng(seed).uniform(-12, 14, (6, 2))
    inside, outside = plane.clip_line(line, a), plane.clip_line(line, a, False)
    assert sum(map(plane.line_length, inside + outside)) == pytest.approx(plane.line_length(line))
    for piece in inside:
        assert plane.contains(a, *((piece[1:] + piece[:-1]) / 2).T).all()


def test_repair_and_odd_regions():
    bow_tie = [np.array([(0, 0), (4, 4), (4, 0), (0, 4)], float)]
    assert plane.area(plane.repair(bow_tie)) == 8 and len(plane.repair(bow_tie)) == 2
    doubled = [np.array([(0, 0), (0, 0), (2, 0), (2, 2), (5, 2), (2, 2), (0, 2)], float)]
    assert plane.area(plane.repair(doubled)) == 4 and len(plane.repair(doubled)[0]) == 4
    assert plane.repair([np.array([(0, 0), (1, 1), (2, 2)], float)]) == [] == plane.union([]) == plane.intersection(plane.box(0, 0, 1, 1), plane.box(1, 0, 2, 1))
    ring = plane.difference(plane.box(0, 0, 10, 10), plane.box(3, 3, 7, 7))
    assert plane.area(ring) == 84 and plane.centroid(ring) == pytest.approx((5, 5)) and len(plane.parts(ring)) == 1
    assert not plane.contains(ring, 5, 5)[0] and plane.contains(ring, 1, 5)[0]
    with pytest.raises(ValueError, match="finite"):
        plane.repair([np.array([(0, 0), (1, np.nan), (2, 2)])])


def test_buffers():
    line = [(0, 0), (10, 0), (10, 10)]
    assert plane.area(plane.buffer_line(line, 1, False)) == pytest.approx(40)
    assert plane.area(plane.buffer_line(line, 1)) == pytest.approx(40 - 1 + math.pi / 4 + math.pi, rel=2e-3)
    assert plane.area(plane.buffer_line([(0, 0), (3, 4)], 2, False)) == pytest.approx(20)
    assert plane.area(plane.buffer_line([(1, 1)], 2)) == pytest.approx(4 * math.pi, rel=2e-3)
    assert plane.buffer_line([(1, 1), (1, 1)], 2, False) == [] == plane.buffer_line([], 1)
    spike = plane.buffer_line([(0, 0), (10, 0), (0, 0.5)], 1, False)  # sharper than the mitre limit
    assert max(r[:, 0].max() for r in spike) < 12
    square = plane.buffer_line([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], 1, False)
    assert plane.area(square) == pytest.approx(144 - 64)
    for seed in range(20):
        r = np.random.default_rng(seed)
        p = r.uniform(0, 20, (5, 2))
        rings = plane.buffer_line(p, 1.5)
        q = r.uniform(-3, 23, (300, 2))
        near = np.full(len(q), np.inf)
        for a, b in zip(p[:-1], p[1:]):
            t = np.clip(((q - a) @ (b - a)) / ((b - a) @ (b - a)), 0, 1)
            near = np.minimum(near, np.hypot(*(q - a - t[:, None] * (b - a)).T))
        sure = np.abs(near - 1.5) > 0.01
        assert (plane.contains(rings, *q.T) == (near < 1.5))[sure].all()


def test_refined_triangles_share_their_middles():
    points, faces = plane.refine(*plane.triangulate(plane.box(0, 0, 16, 9)), 5)
    edges = np.sort(np.concatenate([faces[:, [0, 1]], faces[:, [1, 2]], faces[:, [2, 0]]]), axis=1)
    assert np.hypot(*(points[edges[:, 0]] - points[edges[:, 1]]).T).max() <= 5
    area = sum(abs(plane.ring_area(points[list(f)])) for f in faces)
    assert area == pytest.approx(144)


def test_grid_fill():
    plain = np.add.outer(np.arange(9.0) * 2, np.arange(12.0) * 3)
    z = plain.copy()
    z[2:5, 3:7] = z[7, 4] = z[8, 5] = z[4, 0] = np.nan
    assert np.allclose(fill_holes(z), plain)
    z[0, 0] = np.nan
    assert fill_holes(z)[0, 0] == pytest.approx(np.nanmean(z))
    assert (fill_holes(np.full((2, 2), np.nan)) == 0).all() and fill_holes(np.array([[1.0, np.nan], [np.nan, 3.0]]))[0, 1] == 2
    row, col = np.mgrid[0:6, 0:6].reshape(2, -1)
    mostly = np.where((row + col) % 3 == 0, np.nan, 5.0)
    assert (filled(row, col, mostly) == 5).all()


def test_grid_fill_by_grid(spark):
    rows = [(g, r, c, None if (r, c) == (2, 2) else float(r + g * c)) for g in (1, 2) for r in range(5) for c in range(6)]
    out = raster.fill_missing(spark.createDataFrame(rows, "grid int, row int, col int, z double"))
    assert {(x.grid, x.z) for x in out.where("row = 2 AND col = 2").collect()} == {(1, 4.0), (2, 6.0)} and out.count() == len(rows)


def test_region_columns(spark):
    flat = lambda rings: [r.ravel().tolist() for r in rings]
    ring = flat(plane.difference(plane.box(0, 0, 10, 10), plane.box(3, 3, 7, 7)))
    df = spark.createDataFrame([(1, ring, flat(plane.box(5, 5, 20, 20)), [0.0, 5.0, 12.0, 5.0]), (2, None, None, None)], f"id int, a {REGION}, b {REGION}, line array<double>")
    one = lambda c: df.select(c.alias("v")).where("v IS NOT NULL").collect()
    assert one(shapes.region_area(F.col("a")))[0].v == 84
    assert one(shapes.region_area(shapes.intersection("a", "b")))[0].v == 21
    assert one(shapes.region_area(shapes.difference("a", "b")))[0].v == 63
    assert one(shapes.region_area(shapes.union("a", "b")))[0].v == 84 + 225 - 21
    assert tuple(one(shapes.bounds(F.col("a")))[0].v) == (0, 0, 10, 10)
    assert one(shapes.centroid("a"))[0].v.x == pytest.approx(5)
    assert [len(p) for p in one(shapes.polygons("a"))[0].v] == [2]
    assert [x.begins for x in one(shapes.outlines(F.col("a")))[0].v] == [0, 4]
    pieces = one(shapes.split_at_boundary("line", "a"))[0].v
    assert pieces.bridge == [[0.0, 5.0, 3.0, 5.0], [7.0, 5.0, 10.0, 5.0]] and pieces.land == [[3.0, 5.0, 7.0, 5.0], [10.0, 5.0, 12.0, 5.0]]
    assert one(shapes.clip_line(True)("line", "a"))[0].v == pieces.bridge
    assert len(one(shapes.simplify_region(F.col("a"), 1.0))[0].v) == 2
    points = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 0.0)],)], "p array<struct<x:double,y:double>>")
    assert points.select(shapes.flat_ring(F.col("p"))).first()[0] == [0, 0, 4, 0, 4, 3]


def test_a_piece_around_a_corner_is_land(spark):
    """Its centroid lies inside the window, the piece does not (a way of a table of 12 times sf0.1)."""
    line = [float(v) for v in (789, 798, 790, 801, 801, 803, 801, 794)]
    x = spark.createDataFrame([(line,)], "line array<double>").select(shapes.split_at_boundary("line", shapes.box_region(*map(F.lit, (100.5, 100.5, 800.5, 800.5)))).alias("s")).first().s
    assert np.allclose(x.bridge, [[789, 798, 789 + 2.5 / 3, 800.5]])
    assert len(x.land) == 1 and x.land[0][-6:] == line[-6:]


def test_clip_to_box(spark):
    rows = [(1, "polygon", [[-5.0, -5.0, 5.0, -5.0, 5.0, 5.0, -5.0, 5.0]]), (2, "line", [[-5.0, 1.0, 20.0, 1.0]]), (3, "polygon", [[1.0, 1.0, 2.0, 1.0, 2.0, 2.0]]), (4, "polygon", [[30.0, 30.0, 31.0, 30.0, 31.0, 31.0]]), (5, "point", [[3.0, 3.0]]), (6, "point", [[-3.0, 3.0]]), (7, "polygon", None), (8, "polygon", [])]
    out = {r.id: r.parts for r in shapes.clip_to_box(spark.createDataFrame(rows, f"id int, kind string, parts {REGION}"), (0, 0, 10, 10)).collect()}
    assert set(out) == {1, 2, 3, 5} and out[2] == [[0.0, 1.0, 10.0, 1.0]] and out[3] == rows[2][2]
    assert plane.area([plane.as_ring(r) for r in out[1]]) == 25


def test_coverage_and_union(spark):
    flat = lambda *b: [np.concatenate(plane.box(*b)).ravel().tolist()]
    regions = spark.createDataFrame([(1, flat(0, 0, 10, 10)), (2, flat(50, 50, 60, 60)), (3, flat(0, 0, 100, 100))], f"id int, rings {REGION}")
    covers = spark.createDataFrame([(flat(0, 0, 4, 10),), (flat(2, 0, 6, 10),), (flat(55, 40, 70, 52),)], f"rings {REGION}")
    share = {r.id: r.share for r in shapes.covered_shares(regions, covers, 7.0).collect()}
    assert share[1] == pytest.approx(0.6) and share[2] == pytest.approx(0.1) and share[3] == pytest.approx((60 + 180) / 10000)
    assert {r.id for r in shapes.without_covered(regions, covers, 7.0, 0.3).collect()} == {2, 3}
    whole = shapes.united(covers, 7.0).agg(F.sum(shapes.region_area(F.col("rings")))).first()[0]
    assert whole == pytest.approx(60 + 180)


@pytest.fixture(scope="module")
def ground(spark):
    return spark.range(900).repartition(1).select((F.col("id") / 30).cast("long").alias("row"), (F.col("id") % 30).alias("col"), ((F.col("id") % 7) / 10 + F.col("id") / 900).alias("z")).cache()


def closed(report):
    rows = report.collect()
    return rows and all(r.open_edges == 0 and r.volume > 0 for r in rows)


def regions(spark, rows):
    return spark.createDataFrame([(i, [r.ravel().tolist() for r in rings]) for i, rings in rows], f"id int, rings {REGION}")


def test_layers_are_closed_solids(spark, ground):
    ell = plane.union([plane.box(2, 2, 12, 5), plane.box(2, 2, 5, 14)])
    court = plane.difference(plane.box(14, 14, 26, 26), plane.box(18, 18, 22, 22))
    b = regions(spark, [(1, ell), (2, court), (3, plane.box(0, 0, 1, 1)), (4, plane.box(500, 500, 520, 520))]).withColumn("est_height", F.lit(20.0))
    solids = layers.buildings(b, ground, 1.0, 1.0)
    made = {r.object: r for r in mesh.report(*solids).collect()}
    tall = 3.0 + (20 - 5) / 145 * 2.3
    assert set(made) == {"1:0", "2:0", "4:0"} and all(r.open_edges == 0 for r in made.values())
    assert made["1:0"].volume == pytest.approx(57 * tall) and made["2:0"].volume == pytest.approx(128 * tall)

    points = spark.createDataFrame([(7, k, float(x), float(y)) for k, (x, y) in enumerate([(1, 1), (20, 1), (20, 20)])] + [(8, 0, 1.0, 1.0), (8, 1, 2.0, 1.0)], "way long, pos int, x double, y double")
    roads = spark.createDataFrame([(7, "primary;service"), (8, "motorway"), (9, None)], "way long, highway string")
    made = mesh.report(*layers.roads(roads, points, ground, 1.0, 1.0)).collect()
    assert [r.object for r in made] == ["7"] and made[0].open_edges == 0
    assert layers.shown_roads(roads, 80.0).count() == 2 and {r.way: r.half for r in layers.shown_roads(roads, 1.0).collect()} == {7: 15.0, 8: 20.0, 9: 7.5}

    green = regions(spark, [(1, plane.box(1, 1, 20, 20)), (2, plane.box(1, 1, 2, 2))])
    made = mesh.report(*layers.vegetation(green, ground, 1.0, least=100.0)).collect()
    assert [r.object for r in made] == ["1:0"] and made[0].volume == pytest.approx(361 * P.VEGETATION_THICK_MM)
    line = spark.createDataFrame([(1, [0.0, 10.0, 30.0, 10.0], 30.0), (2, [0.0, 1.0, 2.0, 1.0], 2.0)], "id int, line array<double>, length double")
    none = layers.excluded(b.select("id", "rings"), line, green.where("id = 2"))
    assert sorted((r.kind, r.id) for r in none.collect()) == [("building", "1"), ("building", "2"), ("building", "4"), ("road", "1"), ("water", "2")]
    assert layers.excluded() is None
    cut = mesh.report(*layers.vegetation(green, ground, 1.0, least=100.0, without=none)).collect()
    assert closed(mesh.report(*layers.vegetation(green, ground, 1.0, least=100.0, without=none))) and cut[0].volume < made[0].volume
    columns = mesh.report(*layers.exclusion_columns(b.select("id", "rings"), ground, 1.0)).collect()
    assert {r.object: r.volume for r in columns}["1:0"] == pytest.approx(57 * 6)


def test_water_layers(spark, ground):
    flat = lambda *b: [np.concatenate(plane.box(*b)).ravel().tolist()]
    rows = [
        (1, "polygon", flat(0, 0, 20, 20), None, None), (2, "line", [[0.0, 8.0, 20.0, 8.0]], "stream", "10"), (3, "line", [[0.0, 100.0, 40.0, 100.0]], "river", "12"),
        (4, "polygon", flat(100, 100, 101, 101), None, None), (5, "line", [[0.0, 200.0, 5.0, 200.0]], "ditch", None), (6, "polygon", flat(0, 90, 200, 110), None, None),
    ]
    water = spark.createDataFrame(rows, f"id int, kind string, parts {REGION}, waterway string, width string")
    plate = {r.object for r in layers.water_plate(water, 15.0, 50.0).collect()}
    assert plate == {"polygon:1:0", "polygon:6:0", "line:3:0"}  # line 2 lies in polygon 1, which it covers by half
    columns = {r.object for r in layers.water_columns(water, 15.0, 50.0).collect()}
    assert columns == {"line:2:0", "line:3:0", "line:5:0", "polygon:6:0"}
    solids = layers.water(water, (0, 0, 200, 200), 0.5, 15.0, 50.0)
    low = solids[0].agg(F.min("z"), F.max("z")).first()
    assert closed(mesh.report(*solids)) and low[0] == pytest.approx(P.WATER_BOTTOM_MM) and low[1] > 10
    v, f = layers.water_surfaces(water.where("id = 1"), ground, 4.0, 15.0)
    assert v.select("z").distinct().count() == 1 and mesh.normals(v, f).where("abs(nz) < 0.999").count() == 0 and f.count() > 40
    off = layers.water_surfaces(water.where("id = 6"), ground, 4.0, 15.0)[1]
    assert off.count() == 0


def test_short_and_small_waters_have_surfaces(spark, ground):
    """Waters are told in vertices of the ground: a river of two of them is no less a river."""
    rows = [(1, "line", [[4.0, 4.0, 6.0, 4.0]], "river", "0.5"), (2, "polygon", [[9.0, 9.0, 9.1, 9.0, 9.1, 9.1, 9.0, 9.1]], None, None), (3, "line", [[4.0, 4.0, 4.0, 4.0]], "river", "1")]
    water = spark.createDataFrame(rows, f"id int, kind string, parts {REGION}, waterway string, width string")
    v, f = layers.water_surfaces(water, ground, 4.0, 0.0)
    assert {r.object for r in f.collect()} == {r.object for r in v.collect()} == {"line:1:0", "polygon:2:0"}


def test_terrain_solids(spark, ground):
    whole = layers.terrain(ground, 2.0)
    assert closed(mesh.report(*whole))
    lake = regions(spark, [(1, plane.box(5.2, 5.2, 12.2, 9.2))])
    holed = layers.terrain(ground, 2.0, water_=lake)
    assert closed(mesh.report(*holed)) and holed[1].count() == whole[1].count() - 28 * 4 + 2 * 22
    v, f = layers.base(ground, 3.0)
    top = raster.heightfield_faces(ground).select(F.lit("base").alias("object"), F.col("fid"), "v1", F.col("v3").alias("v2"), F.col("v2").alias("v3"))
    assert mesh.longest_loop(top).first().points == 4 * 29 and raster.boundary_loop(ground).count() == 4 * 29
    place = {(r.row, r.col): r.place for r in raster.boundary_loop(ground).collect()}
    ring = sorted(place, key=place.get)
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(ring, ring[1:] + ring[:1]))
    n = 10_000_000
    shell = top.withColumns({k: F.col(k) + n for k in ("v1", "v2", "v3")})
    points = ground.select(F.lit("base").alias("object"), (F.col("row") * 30 + F.col("col") + n).alias("vid"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), "z")
    merged = mesh.repaired(points.unionByName(v), shell.unionByName(f.withColumn("fid", F.col("fid") + n)))
    assert closed(mesh.report(*merged))
    holed_up = layers.terrain(ground.where("row < 0"), 1.0)
    assert holed_up[1].count() == 0


def test_carving(spark, ground):
    pond = regions(spark, [(1, plane.box(4.5, 4.5, 12.5, 9.5)), (2, plane.box(20, 20, 20.5, 20.5))])
    z = {(r.row, r.col): r.z for r in ground.collect()}

    def highest(x, y):
        return max(z[k] for k in sorted(z, key=lambda k: ((k[1] - x) ** 2 + (k[0] - y) ** 2, k))[:8])

    corners = [(4.5, 4.5), (12.5, 4.5), (12.5, 9.5), (4.5, 9.5), (4.5, 4.5)]
    level = np.percentile([highest(*c) for c in corners], 25)
    out = {(r.row, r.col): r.z for r in layers.carve(ground, pond, 10.0).collect()}
    inside = {(r, c) for r in range(5, 10) for c in range(5, 13)}
    assert {k for k in z if out[k] != z[k]} == {k for k in inside if z[k] > level - 1}
    assert all(out[k] == pytest.approx(level - 1) for k in inside if z[k] > level - 1)


def test_mesh_repair(spark):
    v = spark.createDataFrame([("a", k, *map(float, p)) for k, p in enumerate([(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 0, 1e-9), (0.5, 0, 0), (9, 9, 9)])], "object string, vid long, x double, y double, z double")
    f = spark.createDataFrame([("a", 0, 0, 1, 2), ("a", 1, 2, 0, 3), ("a", 2, 0, 4, 1), ("a", 3, 1, 3, 2)], "object string, fid long, v1 long, v2 long, v3 long")
    points, faces = mesh.repaired(v, f)
    assert [tuple(r) for r in faces.collect()] == [("a", 0, 0, 1, 2)] and sorted(r.vid for r in points.collect()) == [0, 1, 2]
    points, faces = mesh.reindexed(v, f.where("fid = 1"))
    assert [tuple(r)[1:] for r in faces.collect()] == [(1, 1, 0, 2)] and sorted(r.vid for r in points.collect()) == [0, 1, 2]


def test_boxes_that_do_not_overlap():
    r = np.random.default_rng(7)
    for n in (0, 1, 40, 3000):
        low = r.integers(0, 60, (n, 2))
        b = np.concatenate((low, low + r.integers(0, 9, (n, 2))), 1)
        want, got = np.zeros((80, 80), int), np.zeros((80, 80), int)
        for x0, y0, x1, y1 in b.tolist():
            want[y0:y1, x0:x1] = 1
        for x0, y0, x1, y1 in plane.disjoint_boxes(b.astype(float)).astype(int).tolist():
            got[y0:y1, x0:x1] += 1
        assert (want == got).all()


def test_a_cells_covers_are_united_once(spark):
    """Regions meet what a cell's covers take together: no row for each pair of a region and a cover."""
    square = lambda df: df.select("id", shapes.box_region(F.lit(0), F.lit(0), F.lit(10), F.lit(10)).alias("rings"))
    covers = spark.range(400).select(F.col("id"), shapes.box_region(F.lit(0), F.lit(0), F.lit(2), F.col("id") % 5 + 1).alias("rings"))
    tilted = spark.createDataFrame([(0, [[5.0, 5.0, 7.0, 7.0, 5.0, 9.0]])], f"id long, rings {REGION}")
    shares = shapes.covered_shares(square(spark.range(300)), covers, 64.0)
    assert "Join" not in shares._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroupsInArrow")[1]
    assert {(r.id, r.share) for r in shares.collect()} == {(i, 0.1) for i in range(300)}
    assert [r.share for r in shapes.covered_shares(square(spark.range(1)), covers.unionByName(tilted), 4.0).collect()] == [pytest.approx(0.14)]
    assert [r.share for r in shapes.covered_shares(tilted, square(spark.range(1)), 4.0).collect()] == [pytest.approx(1)]


def test_a_loser_is_dominated_by_one_winner(spark):
    """A search ends at the first winner that is enough, and gives no row for each pair."""
    a = spark.createDataFrame([(k, x, 0, x + 10, 10) for k, x in enumerate((0, 20, 40))], "a_id long, ax0 long, ay0 long, ax1 long, ay1 long")
    b = spark.createDataFrame([(0, 0, 2, 10), (2, 0, 4, 10), (20, 0, 23, 10), (40, 0, 44, 10)] * 50, "bx0 long, by0 long, bx1 long, by1 long")
    left = spatial.dominated(a, b)
    assert "LeftSemi" in left._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.a_id for r in left.collect()) == [0, 1]


def test_waters_are_united_before_roads_cross_them(spark):
    segments = spark.createDataFrame([(1, 1, 0, 0, 30, 0), (2, 1, 3, 9, 9, 9), (3, 1, 0, 20, 9, 20)], "way long, pos long, x1 long, y1 long, x2 long, y2 long")
    waters = spark.createDataFrame([(k % 7, -(k % 3) - 1, k % 7 + 5, k % 4) for k in range(300)] + [(9, 9, 12, 12), (4, 4, 4, 9), (-900, -900, -1, -1)], "bx0 long, by0 long, bx1 long, by1 long")
    less = spatial.disjoint(waters)
    assert less.count() < 30
    want = {r.way: r.water_length for r in spatial.covered_length(spatial.crossings(segments, waters)).collect()}
    got = {r.way: r.water_length for r in spatial.covered_length(spatial.crossings(segments, less)).collect()}
    assert want == pytest.approx(got) and set(got) == {1, 2}


def test_lines_under_single_polygons(spark):
    rows = lambda *r: spark.createDataFrame(list(r), f"id string, rings {REGION}")
    box = lambda x0, y0, x1, y1: [[float(v) for v in (x0, y0, x1, y0, x1, y1, x0, y1)]]
    lines = rows(("a", box(0, 0, 10, 2)), ("b", box(20, 0, 30, 2)), ("c", [[40.0, 0.0, 50.0, 0.0, 45.0, 5.0]]), ("d", box(60, 0, 70, 2)))
    winners = rows(("p", box(0, 0, 4, 2)), ("q", box(20, 0, 23, 2)), ("r", box(39, 0, 51, 2)), ("s", [[60.0, 0.0, 68.0, 0.0, 60.0, 8.0]]))
    left = shapes.without_dominated(lines, winners, 0.3)
    assert sorted(r.id for r in left.collect()) == ["b"]


def test_angles_on_a_line_through_the_mean(spark):
    """Rounded angles decide, those of the C library, as in SQL and in Python."""
    p = [(20.0, 88.0), (21.0, 89.0), (29.0, 97.0)]
    mx, my = (sum(c) / 3 for c in zip(*p, strict=True))
    want = sorted(p, key=lambda q: (math.atan2(q[1] - my, q[0] - mx), *q))
    got = spark.createDataFrame([(p,)], "p array<struct<x:double,y:double>>").select(G.by_angle(F.col("p")).alias("p")).first().p
    assert want[0] == (21, 89) and [tuple(q) for q in got] == want


def test_rectangles_need_no_overlay(monkeypatch):
    """Rectangles apart or one in the other are told from their sides, with the areas that an overlay gives."""
    r = random.Random(3)
    pairs = [[[shapes._ring_of((float(x := r.randint(0, 9)), float(y := r.randint(0, 9)), float(x + r.randint(1, 6)), float(y + r.randint(1, 6))))] for _ in "ab"] for _ in range(60)]
    for f, g in ((shapes._INTERSECTION, plane.intersection), (shapes._DIFFERENCE, plane.difference), (shapes._UNION, lambda a, b: plane.union([a, b]))):
        for a, b in pairs:
            got, want = plane.repair(shapes.to_rings(f(a, b))), g(shapes.to_rings(a), shapes.to_rings(b))
            assert plane.area(got) == plane.area(want) and not plane.area(plane.symmetric_difference(got, want))
    monkeypatch.setattr(plane, "combine", None)
    small, large, far = ([shapes._ring_of(x)] for x in ((1.0, 1.0, 2.0, 2.0), (0.0, 0.0, 3.0, 3.0), (5.0, 5.0, 6.0, 6.0)))
    assert shapes._INTERSECTION(small, large) == small and shapes._DIFFERENCE(small, large) == [] and shapes._UNION(small, far) == small + far


def test_uncovered_is_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(60):
        own, low = (3.0, 2.0, *(rng.integers(1, 9, 2) + (3.0, 2.0))), rng.integers(0, 12, (rng.integers(0, 12), 2))
        boxes = np.concatenate((low, low + rng.integers(0, 6, low.shape)), 1).astype(float)
        left = plane.union([plane.box(*b) for b in plane.uncovered(own, boxes)])
        want = plane.difference(plane.box(*own), plane.union([plane.box(*b) for b in boxes if b[0] < b[2] and b[1] < b[3]]))
        assert plane.area(plane.symmetric_difference(left, want)) == 0 and len(plane.triangulate(left)[1]) == len(plane.triangulate(want)[1])


def test_cut_out_unites_covers_before_they_meet_regions(spark, monkeypatch):
    """A hundred covers one on another reach a region as few boxes; a slanted one is cut out as well."""
    met = []
    join = layers.spatial.box_join
    monkeypatch.setattr(layers.spatial, "box_join", lambda a, b: met.append(join(a, b)) or met[-1])
    green = spark.createDataFrame([("g", [[0.0, 0.0, 10.0, 0.0, 10.0, 10.0, 0.0, 10.0]])], "object string, rings array<array<double>>")
    covers = [([[0.0, 0.0, 4.0, 0.0, 4.0, 10.0, 0.0, 10.0]],)] * 100 + [([[6.0, 0.0, 10.0, 0.0, 10.0, 4.0]],)]
    left = layers.cut_out(green, spark.createDataFrame(covers, "rings array<array<double>>"), "object").collect()
    assert abs(plane.area(shapes.to_rings(left[0].rings)) - 52) < 1e-6
    assert met[-1].count() < 20


def test_areas_of_round_buffers_need_no_overlay(monkeypatch):
    """The areas of many lines together are those of their regions."""
    rng = np.random.default_rng(5)
    lines = [rng.integers(0, 12, (n, 2)).astype(float) for n in rng.integers(1, 8, 60)]
    lines += [np.concatenate((x, x[:1])) for x in lines[:15]] + [np.concatenate((x, x[::-1])) for x in lines[:15]]
    lines += [np.zeros((0, 2)), np.full((3, 2), 7.0), rng.random((60, 2)) * 50]
    half = np.where(np.arange(len(lines)) % 7 == 0, 0.75, 2.5)
    half[3] = 0.0
    first = np.concatenate(([0], np.cumsum([len(x) for x in lines])))
    want = [plane.area(plane.buffer_line(x, h)) for x, h in zip(lines, half, strict=True)]
    assert buffers.round_areas(np.concatenate(lines), first, half).tolist() == pytest.approx(want, abs=1e-5)
    monkeypatch.setattr(plane, "combine", None)
    two = np.array([[0.0, 0.0], [20.0, 0.0], [20.0, 30.0], [20.0, 0.0]])
    disc = 32 * 2.5**2 * math.sin(math.pi / 32)
    assert buffers.round_areas(np.concatenate((two, two[:2])), np.array([0, 4, 6]), np.full(2, 2.5)).tolist() == pytest.approx([5 * 50 - 2.5**2 + disc * 5 / 4, 5 * 20 + disc], abs=1e-4)
    # A wave, against points near the line.
    x = np.linspace(0, 9, 17)
    wave = np.stack((x, np.sin(x)), 1)
    gx, gy = (v.ravel() for v in np.meshgrid(np.arange(-2, 11, 0.05), np.arange(-3, 3, 0.05)))
    a, d = wave[:-1], np.diff(wave, axis=0)
    t = np.clip(((gx[:, None] - a[:, 0]) * d[:, 0] + (gy[:, None] - a[:, 1]) * d[:, 1]) / (d * d).sum(1), 0, 1)
    near = np.hypot(gx[:, None] - a[:, 0] - t * d[:, 0], gy[:, None] - a[:, 1] - t * d[:, 1]).min(1) < 1.2
    assert buffers.round_areas(wave, np.array([0, 17]), np.array([1.2]))[0] == pytest.approx(near.sum() * 0.05**2, rel=0.01)


def test_areas_of_round_buffers_in_a_table(spark):
    rows = [(1, [0.0, 0.0, 20.0, 0.0], 2.5), (2, None, 2.5), (3, [0.0, 0.0, 3.0, 4.0, 0.0, 0.0], None), (4, [0.0, 0.0, 3.0, 4.0, 0.0, 9.0], 1.0)]
    x = spark.createDataFrame(rows, "id int, line array<double>, half double")
    got = {r.id: r.a for r in x.select("id", shapes.buffer_round_area("line", "half").alias("a")).collect()}
    want = {r.id: r.b for r in x.where("id <> 3").select("id", shapes.region_area(shapes.buffer_round("line", "half")).alias("b")).collect()}
    assert got[2] is got[3] is want[2] is None
    assert all(got[k] == pytest.approx(want[k], abs=1e-5) for k in (1, 4))
