import json
import os
import time
import zipfile
from xml.dom import minidom

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlore import profiles as P
from gridlore.functions import plane
from gridlore.operators import ribbon, scan, shapes, spatial, tiles
from gridlore.sources import elevation, osm, threemf

#: A lake relation of two outer rings and a hole, an open shore, a road with a list, a house, a wood and a way out of the window.
PLACES = {
    **{k: xy for k, xy in enumerate([(0, 0), (4, 0), (4, 4), (0, 4)], 1)}, **{k: xy for k, xy in enumerate([(1, 1), (2, 1), (2, 2), (1, 2)], 11)},
    **{k: xy for k, xy in enumerate([(6, 0), (8, 0), (8, 2), (6, 2)], 21)}, 31: (0, 5), 32: (9, 5), 33: (9, 9), **{k: xy for k, xy in enumerate([(5, 5.2), (5.2, 5.2), (5.2, 5.4), (5, 5.4)], 41)}, 51: (50, 50), 52: (51, 51),
}


@pytest.fixture(scope="module")
def elements(spark, tmp_path_factory):
    unit = 0.01
    node = lambda k: {"type": "node", "id": k, "lat": 30 + PLACES[k][1] * unit, "lon": 120 + PLACES[k][0] * unit}
    way = lambda k, nodes, **tags: {"type": "way", "id": k, "nodes": nodes, "tags": {a.replace("__", ":"): b for a, b in tags.items()}}
    ring = lambda a: [a, a + 1, a + 2, a + 3, a]
    members = [{"type": "way", "ref": r, "role": role} for r, role in ((1, "outer"), (2, "inner"), (3, ""), (4, "outer"), (99, "outer"))]
    doc = {"elements": [
        *map(node, PLACES), way(1, ring(1)), way(2, ring(11)), way(3, ring(21)), way(4, [31, 32], natural="water"), way(5, [31, 32, 33, 999], highway="service;primary"),
        way(6, ring(41), building="yes", height="25 m", building__levels="3"), way(7, [51, 52], highway="primary"), way(8, ring(21)[::-1], landuse="meadow"), way(9, [31], highway="primary"),
        {"type": "relation", "id": 1, "members": members, "tags": {"type": "multipolygon", "natural": "water", "water": "lake"}},
        {"type": "relation", "id": 2, "members": members, "tags": {"type": "route", "natural": "water"}},
    ]}
    path = tmp_path_factory.mktemp("osm") / "a.json"
    path.write_text(json.dumps(doc))
    return tuple(x.cache() for x in osm.read_overpass(spark, str(path)))


WINDOW = (30.0, 120.0, 30.07, 120.1)


def test_assembly(elements):
    got = {(r.osm_type, r.osm_id): r for r in scan.assemble(*elements).collect()}
    lake = [plane.as_ring(r) for r in got[("relation", 1)].parts]
    assert plane.area(lake) == pytest.approx((16 - 1 + 4) * 1e-4) and len(lake) == 3
    assert ("relation", 2) not in got and ("way", 9) not in got
    assert plane.area([plane.as_ring(got[("way", 8)].parts[0])]) == pytest.approx(4e-4)
    assert got[("way", 5)].kind == "line" and len(got[("way", 5)].parts[0]) == 6 and got[("way", 6)].kind == "polygon"


def test_layers(elements, tmp_path):
    water = scan.fetch_water(elements, WINDOW).collect()
    assert [(r.osm_type, r.osm_id, r.kind) for r in water] == [("relation", 1, "polygon"), ("way", 4, "line")]
    assert scan.fetch_water(elements, WINDOW, least_m2=1e9).count() == 1 and scan.fetch_water(elements, WINDOW, relations_only=True).count() == 1
    roads = scan.fetch_roads(elements, WINDOW).collect()
    assert [r.osm_id for r in roads] == [5] and roads[0].length_m == pytest.approx(0.09 * 111320 * np.cos(np.radians(30.035)) + 0.02 * 111320, rel=1e-3)
    assert scan.fetch_roads(elements, WINDOW, ("primary",)).count() == 1 and scan.fetch_roads(elements, WINDOW, ("trunk",)).count() == 0
    house = scan.fetch_buildings(elements, WINDOW).first()
    assert house.est_height == 25.0 and scan.fetch_buildings(elements, WINDOW, 1e6).count() == 0
    assert [r.osm_id for r in scan.fetch_vegetation(elements, WINDOW).collect()] == [8]
    layer = scan.Layer("vegetation", WINDOW, extra=lambda df: df.where("osm_id > 100"))
    assert layer.run(elements, export=str(tmp_path), stop_early=True).count() == 0 and list(layer.steps) == ["raw", "filtered"]
    assert sorted(os.listdir(tmp_path / "vegetation")) == ["filtered", "raw"]


def test_expressions():
    assert scan.compile_expression("nwr/landuse=forest,grass r/water") == ({"landuse": ("forest", "grass"), "water": True}, {"node", "way", "relation"})
    assert scan.compile_expression("r/natural=water")[1] == {"relation"} and scan.compile_expression("highway")[0] == {"highway": True}
    assert scan.compile_expression("w/a w/a=b")[0] == {"a": True}


def test_tile_cache(spark, elements, tmp_path):
    path = str(tmp_path / "cache")
    assert scan.read_tiles(spark, path, "water", WINDOW) is None
    whole = scan.fetch(elements, "water", (30.0, 120.0, 30.1, 120.1))
    scan.save_tiles(whole, path, "water")
    scan.save_tiles(whole, path, "water")
    small = (30.0, 120.0, 30.04, 120.04)
    hit = scan.read_tiles(spark, path, "water", small)
    assert {(r.osm_type, r.osm_id) for r in hit.collect()} == {("relation", 1)} and scan.read_tiles(spark, path, "roads", small) is None
    assert scan.read_tiles(spark, path, "water", (30.0, 120.0, 30.2, 120.2)) is None
    assert scan.cached_tiles(spark, path, "water").count() == 4


def test_city_index(spark, tmp_path):
    index = {"a|30.1|120.2": {"lat": 30.1, "lon": 120.2, "cache_files": {"osm": ["city\\x.json", "city/y.json"]}}, "b|30.9|120.9": {"cache_files": {"osm": ["city/y.json"]}}, "far|50|5": {"lat": 50.0, "lon": 5.0, "cache_files": {"osm": ["z"]}}, "bad": {}}
    path = tmp_path / "index.json"
    path.write_text(json.dumps(index, indent=1))
    got = scan.read_city_index(spark, str(path))
    assert got.count() == 3 and sorted(r.path for r in scan.city_files(got, (30, 120, 30.2, 120.2), root="r/").collect()) == ["r/city/x.json", "r/city/y.json"]
    assert scan.read_city_index(spark, str(tmp_path / "none.json")).count() == 0


def test_purge_and_listing(spark, tmp_path):
    old, new = tmp_path / "old.bin", tmp_path / "new.bin"
    old.write_bytes(b"1")
    new.write_bytes(b"22")
    os.utime(old, (1, 1))
    assert [r.length for r in scan.listing(spark, str(tmp_path)).collect()] == [2, 1]
    assert scan.purge(spark, str(tmp_path), -1, time.time()) == [] and scan.purge(spark, str(tmp_path), 3600, time.time()) == [str(old)]
    assert scan.purge(spark, str(tmp_path), 0, time.time()) == [str(new)]


def test_geojson_round_trip(spark, tmp_path):
    rows = [({"a": "b"}, "Polygon", "[[[0,0],[0,4],[4,4],[4,0],[0,0]],[[1,1],[2,1],[2,2],[1,2],[1,1]]]"), (None, "LineString", "[[0,0],[3,4]]"), ({}, "MultiPolygon", "[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]"), ({}, "Point", "[1,2,9]"), ({}, "MultiLineString", "[[[0,0],[1,1]],[[2,2],[3,3]]]")]
    df = spark.createDataFrame(rows, "tags map<string,string>, kind string, coordinates string").coalesce(2)
    path = str(tmp_path / "out")
    osm.write_geojson(df, path)
    back = osm.read_geojson(spark, path)
    assert sorted(r.kind for r in back.collect()) == sorted(k for _, k, _ in rows)
    got = {}
    for r in osm.read_shapes(spark, path).collect():
        got.setdefault(r.kind, []).append(r.parts)
    assert sorted(plane.area([plane.as_ring(x) for x in p]) for p in got["polygon"]) == [1.0, 15.0]
    assert got["point"] == [[[1.0, 2.0]]] and sorted(map(len, got["line"])) == [1, 2]
    assert osm.read_shapes(spark, path).where("kind = 'polygon' AND tags['a'] = 'b'").count() == 1
    osm.write_geojson(df.where("false"), str(tmp_path / "none"))
    assert osm.read_geojson(spark, str(tmp_path / "none")).count() == 0


def test_archive_with_materials(spark, tmp_path):
    names = ["roads", "terrain_surface", 'odd <&">', "empty"]
    v = spark.createDataFrame([(n, i, float(i), float(i % 2), 0.0) for n in names for i in range(3)], "object string, vid long, x double, y double, z double")
    f = spark.createDataFrame([(n, 0, 0, 1, 2) for n in names[:3]], "object string, fid long, v1 long, v2 long, v3 long")
    path = str(tmp_path / "m.3mf")
    threemf.write_3mf(v, f, path)
    points, faces = threemf.read_3mf(spark, path)
    assert {r.object for r in faces.collect()} == set(names[:3]) and points.count() == 9
    assert {r.object: r.extruder for r in threemf.read_extruders(spark, path).collect()} == {"roads": 2, "terrain_surface": 1, 'odd <&">': 1}
    xml = zipfile.ZipFile(path).read(threemf.MODEL).decode()
    assert xml.count("<base ") == len(P.COLOURS) and xml.index('name="terrain_surface" pid="1" pindex="0"') < xml.index('name="roads" pid="1" pindex="3"')
    minidom.parseString(xml)


def test_elevation_sources(spark, tmp_path):
    side = 5
    cells = [(30, 120, r, c, float(r * 10 + c) if (r, c) != (2, 2) else None) for r in range(side) for c in range(side)]
    tile = spark.createDataFrame(cells, "lat int, lon int, row int, col int, z double")
    sides = spark.createDataFrame([(30, 120, side)], "lat int, lon int, side int")
    points = spark.createDataFrame([(1, 30.0, 120.0), (2, 30.99, 120.99), (3, 30.5, 120.5), (4, 31.0, 120.0), (5, 30.125, 120.375)], "id int, lat double, lon double")
    got = {r.id: r.z for r in elevation.sample_tiles(points, tile, sides).collect()}
    assert got == {1: 0.0, 2: 44.0, 3: None, 4: None, 5: got[5]} and got[5] in (1.0, 2.0, 11.0, 12.0)
    grid = spark.createDataFrame([(r, c, -9999.0 if (r, c) == (0, 0) else float(r * 10 + c)) for r in range(3) for c in range(4)], "row long, col long, z double")
    where = spark.createDataFrame([(1, 0.5, 29.5), (2, 3.5, 0.0), (3, 99.0, 99.0), (4, -5.0, -5.0)], "id int, x double, y double")
    got = {r.id: r.z for r in elevation.sample_raster(where, grid, 0.0, 30.0, (1.0, 10.0), -9999.0).collect()}
    assert got == {1: None, 2: 23.0, 3: 3.0, 4: 20.0}
    path = str(tmp_path / "g.npy")
    elevation.write_npy(grid.withColumn("z", F.when(F.col("z") >= 0, F.col("z"))), path)
    assert np.isnan(np.load(path)[0, 0]) and elevation.read_npy(spark, path).where("z IS NULL").count() == 1 and elevation.read_npy(spark, path).count() == 12
    whole = elevation.finished(spark.createDataFrame([(r, c, None if (r, c) == (2, 2) else 7.0) for r in range(6) for c in range(5)], "row long, col long, z double"), 6, 5)
    assert whole.count() == 30 and all(r.z == pytest.approx(7.0) for r in whole.collect())


def test_large_boxes_meet_small_ones(spark):
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(zip(*rng.uniform(-50, 50, (2, 120)), *(10 ** rng.uniform(-3, 3, (2, 120)))))]
    a = spark.createDataFrame(rows[:60], "a_id int, ax0 double, ay0 double, ax1 double, ay1 double")
    b = spark.createDataFrame(rows[60:], "b_id int, bx0 double, by0 double, bx1 double, by1 double")
    want = {(p[0], q[0]) for p in rows[:60] for q in rows[60:] if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    got = [(r.a_id, r.b_id) for r in spatial.box_join(a, b).collect()]
    assert sorted(got) == sorted(want) and len(got) > 100
    point = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0)], "a_id int, ax0 double, ay0 double, ax1 double, ay1 double")
    assert spatial.box_join(point, b).count() == sum(q[1] <= 0 <= q[3] and q[2] <= 0 <= q[4] for q in rows[60:])
    assert spatial.box_join(a.where("false"), b.where("false")).count() == 0


def test_nearest_around_gaps(spark):
    cells = [(r, c, float(r * 31 + c * 17 % 23)) for r in range(20) for c in range(20) if not (4 <= r < 14 and 5 <= c < 15)]
    points = [(1, 9.3, 9.2), (2, 0.0, 0.0), (3, 60.0, 3.0), (4, 10.0, -40.0), (5, 5.5, 4.5)]
    want = {}
    for i, x, y in points:
        near = sorted(cells, key=lambda k: ((k[1] - x) ** 2 + (k[0] - y) ** 2, k[0], k[1]))[:8]
        want[i] = max(k[2] for k in near)
    out = spatial.nearest_max(spark.createDataFrame(points, "id int, px double, py double"), spark.createDataFrame(cells, "row long, col long, z double"))
    assert {r.id: r.z for r in out.collect()} == want
    empty = spark.createDataFrame([], "row long, col long, z double")
    assert spatial.nearest_max(spark.createDataFrame(points, "id int, px double, py double"), empty).count() == 0
    # A point's candidates are looked through in its row and not sorted as rows of their own.
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_ribbon_points_that_come_back(spark):
    df = spark.createDataFrame([("a", k, x, 0.0) for k, x in enumerate([0.0, 0.009, 0.018, 0.0, 5.0])], "way string, pos int, x double, y double")
    assert ribbon.mitred_edges(df, 1.0).count() >= 2
    v, f = ribbon.strip(ribbon.central_edges(df, 1.0), 0.5)
    assert f.count() == 8 and v.where("z <> 0.5").count() == 0


def test_tiles_of_a_feature(spark):
    df = spark.createDataFrame([(1, [[120.0, 30.0, 120.07, 30.0, 120.07, 30.02, 120.0, 30.02]])], "id int, parts array<array<double>>")
    assert {(r.ty, r.tx) for r in scan.tile_of(df).collect()} == {(600, 2400), (600, 2401)} and tiles.TILE == 50_000
    assert shapes.REGION == "array<array<double>>"
