import json
import struct

import pytest
from pyspark.sql import functions as F

from gridlore.functions import geometry as G
from gridlore.functions import scalars as S
from gridlore.operators import assemble, layers, mesh
from gridlore.operators import features as X
from gridlore.sources import osm, threemf


def ring(spark, *points):
    return spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in points],)], "p array<struct<x:double,y:double>>")


def one(df, c):
    return df.select(c).first()[0]


def test_geometry(spark):
    t = ring(spark, (0, 0), (4, 0), (4, 3), (0, 0))
    p = F.col("p")
    assert one(t, G.signed_area(p)) == 6.0
    assert one(t, G.signed_area(F.reverse(p))) == -6.0
    assert one(t, G.line_length(p)) == 12.0
    assert one(t, G.in_ring(F.lit(3.0), F.lit(1.0), p)) and not one(t, G.in_ring(F.lit(0.5), F.lit(2.0), p))
    d = t.select(G.densify(p, 1.0).alias("p"))
    assert one(d, F.size("p")) == 13 and one(d, G.line_length(p)) == pytest.approx(12.0)
    assert one(ring(spark, (1, 1), (1, 1)), F.size(G.densify(p, 1.0))) == 1
    assert one(t.select(G.chaikin(p).alias("p")), F.size("p")) == 8
    low, high = G.clip_interval(*(F.lit(float(v)) for v in (-1, 0, 3, 0, 0, -1, 2, 1)))
    assert t.select(low, high).first()[:] == (0.25, 0.75)
    low, high = G.clip_interval(*(F.lit(float(v)) for v in (-1, 5, 3, 5, 0, -1, 2, 1)))
    assert one(t, low > high)


def test_heights(spark):
    rows = [("25 m", "3", 25.0), ("10", "4", 14.0), ("10-12", "2", 7.0), ("-5", None, 5.0), ("1.2.3", None, 10.0), ("", None, 10.0), (None, "400", 800.0), (None, "5d", 10.0), ("900", None, 10.0)]
    df = spark.createDataFrame(rows, "h string, l string, want double")
    assert all(a == b for a, b in df.select(S.building_height(F.col("h"), F.col("l")), "want").collect())


def test_scalars(spark):
    df = spark.range(1)
    assert one(df, S.hgt_name(F.lit(30), F.lit(120))) == "N30E120.hgt" and one(df, S.hgt_name(F.lit(-3), F.lit(-7))) == "S03W007.hgt"
    assert one(df, S.utm_zone(F.lit(120.15))) == 51
    assert one(df, S.xml_escape(F.lit('a&<">'))) == "a&amp;&lt;&quot;&gt;"
    for km, mm in ((25000, 0.00784), (10000, 0.0196), (5000, 0.0392)):
        assert one(df, S.model_scale(F.lit(km), F.lit(1))) == pytest.approx(mm)


def test_dedupe_without_the_column(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 5)], "seq int, osm_id int")
    assert [r.seq for r in X.dedupe_first(df).orderBy("seq").collect()] == [1, 3]
    assert X.dedupe_first(df.select("seq")).count() == 3


def test_overpass_to_ways(spark, tmp_path):
    doc = {"elements": [{"type": "node", "id": i, "lat": float(i // 2), "lon": float(i % 2)} for i in range(4)] + [{"type": "way", "id": 9, "nodes": [0, 1, 3, 2, 0, 77], "tags": {"natural": "water"}}, {"type": "relation", "id": 5, "members": [{"type": "way", "ref": 9, "role": ""}], "tags": {}}]}
    (tmp_path / "o.json").write_text(json.dumps(doc))
    nodes, ways, relations = osm.read_overpass(spark, str(tmp_path / "o.json"))
    places = nodes.select(F.col("id").alias("node"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    w = assemble.ways(assemble.resolve(osm.node_references(ways), places)).first()
    assert w.closed and len(w.points) == 5
    assert relations.first().members[0].ref == 9


def test_empty_geojson(spark, tmp_path):
    (tmp_path / "e.geojson").write_text('{"type": "FeatureCollection", "features": []}')
    assert osm.read_geojson(spark, str(tmp_path / "e.geojson")).count() == 0


def test_hgt(spark, tmp_path):
    (tmp_path / "N30E120.hgt").write_bytes(struct.pack(">9h", 1, 2, 3, 4, -32768, 6, 7, 8, 9))
    rows = {(r.row, r.col): r.z for r in osm.read_hgt(spark, str(tmp_path / "*.hgt")).collect()}
    assert rows[(0, 0)] == 7 and rows[(2, 2)] == 3 and rows[(1, 1)] is None and len(rows) == 9


CUBE = [(x, y, z) for x in (0.0, 1.0) for y in (0.0, 1.0) for z in (0.0, 1.0)]
SIDES = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]


def cube(spark, name="terrain_surface"):
    v = spark.createDataFrame([(name, i, *p) for i, p in enumerate(CUBE)], "object string, vid long, x double, y double, z double")
    f = spark.createDataFrame([(name, i, *t) for i, t in enumerate(SIDES)], "object string, fid long, v1 long, v2 long, v3 long")
    return v, f


def test_mesh_report_and_rules(spark):
    v, f = cube(spark)
    r = mesh.report(v, f).first()
    assert (r.faces, r.open_edges, r.degenerate) == (12, 0, 0) and abs(abs(r.volume) - 1) < 1e-9
    empty = spark.createDataFrame([], "object string, extruder int")
    rules = mesh.check_model(v, f, empty, empty)
    passed = {x.rule: x.passed for x in rules.collect()}
    assert len(passed) == 12 and not passed["V1"] and not passed["V2"] and passed["V10"]
    assert not mesh.verdict(rules).first().passed
    assert mesh.split_by_normal(v, f).where("part = 'surface'").count() == 2


def test_3mf_round_trip(spark, tmp_path):
    v, f = cube(spark, "water")
    path = str(tmp_path / "m.3mf")
    threemf.write_3mf(v, f, path)
    v2, f2 = threemf.read_3mf(spark, path)
    assert sorted(v2.collect()) == sorted(v.collect()) and sorted(f2.collect()) == sorted(f.collect())


def test_utm_known_values_and_back(spark):
    from gridlore.functions import crs

    places = [(0.0, 123.0), (45.0, 123.0), (30.25, 120.15), (-33.9, 121.5), (60.0, 125.9)]
    df = spark.createDataFrame(places, "lat double, lon double").withColumn("zone", F.lit(51))
    east, north = crs.to_utm(F.col("lat"), F.col("lon"), F.col("zone"))
    df = df.withColumn("east", east).withColumn("north", north)
    lat, lon = crs.from_utm(F.col("east"), F.col("north"), F.col("zone"), F.col("lat") < 0)
    rows = df.withColumn("lat2", lat).withColumn("lon2", lon).collect()
    assert (rows[0].east, rows[0].north) == (500000.0, 0.0)
    assert abs(rows[1].north - 0.9996 * 4984944.378) < 0.01 and abs(rows[1].east - 500000) < 1e-6  # the meridian's arc to 45 degrees
    for r in rows:
        assert abs(r.lat - r.lat2) < 1e-9 and abs(r.lon - r.lon2) < 1e-9


def test_simplify_equals_recursion(spark):
    import random

    from gridlore.functions.simplify import simplify

    def far(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        n = dx * dx + dy * dy
        t = min(1, max(0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n)) if n else 0
        return ((p[0] - a[0] - t * dx) ** 2 + (p[1] - a[1] - t * dy) ** 2) ** 0.5

    def plain(p, tol):
        if len(p) < 3:
            return p
        k = max(range(1, len(p) - 1), key=lambda i: far(p[i], p[0], p[-1]))
        return plain(p[: k + 1], tol)[:-1] + plain(p[k:], tol) if far(p[k], p[0], p[-1]) > tol else [p[0], p[-1]]

    r = random.Random(4)
    lines = [[(r.random() * 9, r.random() * 9) for _ in range(r.randrange(2, 25))] for _ in range(40)] + [[], [(1.0, 1.0)], [(0.0, 0.0), (1.0, 0.1), (2.0, 0.0)]]
    square = [(0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.0, 0.0)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*lines, square, None])], "i int, p array<struct<x:double,y:double>>")
    got = {i: x if x is None else [tuple(q) for q in x] for i, x in df.select("i", simplify(F.col("p"), 1.5)).collect()}
    assert got[len(lines)] == square and got[len(lines) + 1] is None
    for i, x in enumerate(lines):
        assert got[i] == plain(x, 1.5)


def test_extruded_solid_is_closed(spark):
    from gridlore.operators import mesh

    ring = [(0.0, 0.0), (4.0, 0.0), (5.0, 2.0), (2.0, 4.0), (0.0, 3.0), (0.0, 0.0)]
    df = spark.createDataFrame([("a", ring, 1.0, 3.0), ("b", ring[:2], 0.0, 1.0), ("c", [], 0.0, 1.0)], "object string, ring array<struct<x:double,y:double>>, low double, high double")
    (r,) = mesh.report(*mesh.extrude(df)).collect()
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) / 2
    assert (r.object, r.faces, r.degenerate, r.open_edges) == ("a", 16, 0, 0) and abs(r.volume - 2 * area) < 1e-9


def test_ribbon_keeps_its_width(spark):
    from gridlore.operators import ribbon

    line = [(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0), (1, 2, 10.0, 10.0), (2, 0, 0.0, 0.0), (3, 0, 0.0, 0.0), (3, 1, 5.0, 0.0)]
    df = spark.createDataFrame(line, "way long, pos long, x double, y double")
    edges = {(r.way, r.pos): r for r in ribbon.mitred_edges(df, 2.0).collect()}
    assert set(edges) == {(1, 0), (1, 1), (1, 2), (3, 0), (3, 1)}
    corner = edges[1, 1]
    assert [round(v, 9) for v in (corner.lx, corner.ly, corner.rx, corner.ry)] == [8.0, 2.0, 12.0, -2.0]
    solids = {r.object: r for r in mesh.report(*ribbon.box(ribbon.mitred_edges(df, 2.0), 1.0, 0.5)).collect()}
    assert set(solids) == {"1", "3"} and all(r.open_edges == 0 and r.degenerate == 0 for r in solids.values())
    assert abs(solids["3"].volume - 5 * 4 * 0.5) < 1e-9 and solids["1"].faces == 20 and abs(solids["1"].volume - 20 * 4 * 0.5) < 1e-9


def test_each_model_rule(spark):
    flat = lambda name, z, base, n=10: [(name, [(base + 3 * i, 0.0 + i, 0.0, z), (base + 3 * i + 1, 1.0 + i, 0.0, z), (base + 3 * i + 2, 0.0 + i, 1.0, z)]) for i in range(n)]
    model = {
        "terrain_surface": [("terrain_surface", [(0, 0.0, 0.0, 0.0), (1, 196.0, 0.0, 4.0), (2, 0.0, 196.0, 2.0)])],
        "terrain_walls": [("terrain_walls", [(0, 0.0, 0.0, 0.0), (1, 196.0, 0.0, 0.0), (2, 0.0, 0.0, 4.0)])],
        "buildings": [("buildings", [(0, 5.0, 5.0, 3.0), (1, 6.0, 5.0, 9.0), (2, 5.0, 6.0, 3.0)])],
        "roads": [*flat("roads", 4.5, 0, 1), *flat("roads", 5.0, 3, 1)],
        "water": [("water", [(0, 0.0, 0.0, -2.0), (1, 9.0, 0.0, -2.0), (2, 0.0, 0.0, -1.4)])],
        "vegetation": [*flat("vegetation", 4.1, 0), *flat("vegetation", 4.3, 30)],
    }
    extruders = {"terrain_surface": 1, "terrain_walls": 1, "buildings": 1, "roads": 2, "water": 3, "vegetation": 4}

    def failing(change=None, given=None):
        m = {**model, **(change or {})}
        points = [(name, *map(float, ()), *p) for parts in m.values() for name, ps in parts for p in ps]
        faces = [(name, i, *(p[0] for p in ps)) for parts in m.values() for i, (name, ps) in enumerate(parts)]
        v = spark.createDataFrame(points, "object string, vid long, x double, y double, z double")
        f = spark.createDataFrame(faces, "object string, fid long, v1 long, v2 long, v3 long")
        rows = lambda e: spark.createDataFrame(list(e.items()), "object string, extruder int")
        rules = mesh.check_model(v, f, rows(given or extruders), rows(extruders))
        return {r.rule for r in rules.collect() if not r.passed}, mesh.verdict(rules).first()[0], [r.line for r in mesh.rule_text(rules).orderBy("at").collect()]

    assert failing()[:2] == (set(), True) and failing()[2][-1] == "model passed" and len(failing()[2]) == 13
    up = lambda name, by: {name: [(n, [(k, x, y, z * by) for k, x, y, z in ps]) for n, ps in model[name]]}
    assert failing({"terrain_walls": []})[:2] == ({"V2"}, False)
    assert "V1" in failing({"terrain_surface": [("terrain_surface", [(0, 0.0, 0.0, 0.0), (1, 150.0, 0.0, 4.0), (2, 0.0, 150.0, 2.0)])], "terrain_walls": [("terrain_walls", [(0, 0.0, 0.0, 0.0), (1, 150.0, 0.0, 0.0), (2, 0.0, 0.0, 4.0)])]})[0]
    assert "V3" in failing({**up("terrain_surface", 2.0), **up("terrain_walls", 2.0)})[0]
    assert failing(up("buildings", 3.0))[0] == {"V4", "V5"}
    assert failing({"buildings": [("buildings", [(0, 5.0, 5.0, -3.0), (1, 6.0, 5.0, 9.0), (2, 5.0, 6.0, 3.0)])]})[0] == {"V5"}
    assert failing({"roads": [("roads", [(0, 0.0, 0.0, 4.0), (2, 0.0, 1.0, 4.0), (1, 1.0, 0.0, 4.6)])]})[0] == {"V6"}
    assert failing({"roads": flat("roads", 5.0, 0)})[0] == {"V7"}
    assert failing({"water": [("water", [(0, 0.0, 0.0, -2.0), (1, 9.0, 0.0, -2.0), (2, 0.0, 0.0, -1.8)])]})[0] == {"V8"}
    assert failing({"water": [("water", [(0, 0.0, 0.0, -2.0), (1, 90.0, 0.0, -2.0), (2, 0.0, 90.0, -1.0)])]})[0] == {"V9"}
    assert failing(given={**extruders, "roads": 4})[0] == {"V10"} and failing(given={k: v for k, v in extruders.items() if k != "roads"})[0] == set()
    assert failing({"vegetation": flat("vegetation", 4.1, 0)})[0] == {"V11"}
    assert failing({"vegetation": [("vegetation", [(0, 0.0, 0.0, 4.1), (1, 1.0, 0.0, 4.1), (2, 0.0, 1.0, 4.9)])]})[0] == {"V12"}
    assert failing(dict.fromkeys(("buildings", "roads", "water", "vegetation"), []))[0] == set()


def test_houses_in_the_way(spark):
    box = lambda x, y, w, h: [[float(v) for v in (x, y, x + w, y, x + w, y + h, x, y + h)]]
    table = lambda rows: spark.createDataFrame(rows, "id int, rings array<array<double>>")
    houses = table([(1, box(0, 0, 10, 10)), (2, box(20, 0, 10, 10)), (3, box(40, 0, 10, 10)), (4, box(60, 0, 10, 10))])
    roads = spark.createDataFrame([(1, "primary", [35.0, 3.0, 55.0, 3.0]), (2, "service", [15.0, 3.0, 35.0, 3.0])], "id int, highway string, line array<double>")
    assert layers.wide_roads(roads).count() == 1
    kept = layers.without_conflicts(houses, table([(1, box(0, 0, 2, 10)), (2, box(1, 0, 3, 10)), (3, box(60, 0, 3, 10))]), layers.wide_roads(roads), 16.0)
    assert sorted(r.id for r in kept.collect()) == [2, 4]


def test_faces_of_solids_carry_the_corners_that_a_join_finds(spark):
    from gridlore.operators import mesh, ribbon, shapes

    ring = [0.0, 0.0, 4.0, 0.0, 4.0, 3.0, 0.0, 3.0]
    hole = [1.0, 1.0, 1.0, 2.0, 2.0, 2.0, 2.0, 1.0]
    df = spark.createDataFrame([("a", [ring, hole], 1.0, 2.5), ("b", [ring], -1.0, 0.0)], "object string, rings array<array<double>>, low double, high double")
    ways = spark.createDataFrame([(w, i, i * 3.0, float(i * i % 5), i / 7) for w in (1, 2) for i in range(4 + w)], "way long, pos int, x double, y double, z double")
    edges = ribbon.central_edges(ways, 1.0).join(ways.select("way", "pos", "z"), ["way", "pos"])
    for v, f in (shapes.prisms(df), ribbon.box(edges, 0.5, 0.4)):
        plain = f.select("object", "fid", "v1", "v2", "v3")
        assert mesh.corners(v, f) is f
        columns = sorted(f.columns)
        found, want = (sorted(map(tuple, x.select(columns).collect())) for x in (f, mesh.corners(v, plain)))
        assert found == want and len(found) > 40
        told, joined = (mesh.summary(v, x).orderBy("object").collect() for x in (f, plain))
        assert told == joined


def test_model_is_told_layer_by_layer(spark):
    from gridlore.plans import layers as plans

    layers = plans.model(spark, "/root/testdata/sf0.001")
    vertices, faces = next(layers)
    assert {r.object for r in vertices.select("object").distinct().collect()} == {"terrain_surface"}
    assert faces.count() == 2 * 31 * 31
