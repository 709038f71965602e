"""Queries over the model's layers: solids, terrain, meshes and the model rules."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore import profiles as P
from gridlore.functions import scalars as S
from gridlore.operators import layers, mesh, raster, shapes
from gridlore.plans import fixtures as fx
from gridlore.plans.fixtures import with_sql
from gridlore.plans.queries import FACE_SQL, HEIGHT_SQL, PAIR_SQL, PROXY_SQL, _mesh, _regions, _roads, _water
from gridlore.plans.registry import query


def _ground(spark, d, rows: int = 32) -> DataFrame:
    """A small ground: the first 32 rows and columns, without missing vertices; a vertex stands for 32 metres."""
    return fx.raster(spark, d).where((F.col("row") < rows) & (F.col("col") < rows)).select("row", "col", F.coalesce("z", F.lit(0.0)).alias("z"))


STEP = 32.0


def _solid(solids, *more) -> DataFrame:
    return mesh.report(*solids).select("object", "faces", F.round("volume", 4).alias("volume"), "degenerate", "open_edges", *more)


MM_SQL = f"greatest(3.0::DOUBLE, least(5.3::DOUBLE, 3.0::DOUBLE + (CASE WHEN est_height > 0 THEN est_height ELSE {PROXY_SQL} END - 5.0::DOUBLE) / 145.0::DOUBLE * 2.3::DOUBLE))"


@query(with_sql("feat") + HEIGHT_SQL + f" SELECT seq::VARCHAR || ':0' AS object, 12::BIGINT AS faces, round(area * {MM_SQL}, 4) AS volume, 0::BIGINT AS degenerate, 0::BIGINT AS open_edges FROM e WHERE type = 'STANDARD' AND area >= 30")
def building_layer(spark, d):
    """Buildings of the least area as closed solids on the ground."""
    x = fx.features(spark, d).where(S.tag_filter(F.col("tags"), P.LAYERS["buildings"]))
    features = x.select(F.col("seq").alias("id"), shapes.box_region("xmin", "ymin", "xmax", "ymax").alias("rings"), S.building_height(F.col("height"), F.col("levels")).alias("est_height"))
    return _solid(layers.buildings(features, _ground(spark, d), 1.0, 1.0, STEP))


@query(with_sql("nodes", "segs") + """, s AS (SELECT way, sqrt(((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))::DOUBLE) AS l FROM segs),
    k AS (SELECT way, sum(l) AS length, sum(greatest(1, ceil(l / 10)))::BIGINT AS n FROM s GROUP BY way)
    SELECT way::VARCHAR AS object, 8 * n + 4 AS faces, 0::BIGINT AS open_edges FROM k WHERE length >= 10""")
def road_layer(spark, d):
    """Roads as closed ribbons over the ground: their faces, and that they are closed."""
    return mesh.report(*layers.roads(_roads(spark, d), fx.nodes(spark, d), _ground(spark, d), 1.0, 1.0, STEP)).select("object", "faces", "open_edges")


def _water_features(spark, d) -> DataFrame:
    """Rivers as level lines along the middle of their boxes, as wide as these are high; other water as polygons."""
    w = _water(spark, d)
    middle = ((F.col("ymin") + F.col("ymax")) / 2).cast("double")
    line = F.array(F.array(F.col("xmin").cast("double"), middle, F.col("xmax").cast("double"), middle))
    is_line = F.col("type") == "LARGE"
    parts = F.when(is_line, line).otherwise(shapes.box_region("xmin", "ymin", "xmax", "ymax"))
    return w.select(F.col("seq").alias("id"), F.when(is_line, "line").otherwise("polygon").alias("kind"), parts.alias("parts"), F.lit("river").alias("waterway"), (F.col("ymax") - F.col("ymin")).cast("string").alias("width"))


PLATE_SQL = PAIR_SQL.replace("pairs AS (", "big AS (SELECT * FROM feat WHERE (xmax - xmin) * (ymax - ymin) >= 40 AND (type <> 'LARGE' OR xmax - xmin >= 10)), pairs AS (").replace("FROM feat a JOIN feat b", "FROM big a JOIN big b") + """,
    cell AS (SELECT DISTINCT x, y FROM (SELECT x, unnest(range(ymin, ymax)) AS y FROM (SELECT ymin, ymax, unnest(range(xmin, xmax)) AS x FROM big WHERE type = 'LARGE'))),
    own AS (SELECT seq, x, unnest(range(ymin, ymax)) AS y FROM (SELECT seq, ymin, ymax, unnest(range(xmin, xmax)) AS x FROM big WHERE type IN ('ECONOMY', 'MEDIUM', 'PROMO'))),
    dom AS (SELECT seq AS b_id FROM own LEFT JOIN cell USING (x, y) GROUP BY seq HAVING count(cell.x) > 0.3 * count(*))"""


@query(with_sql("feat") + PLATE_SQL + """ SELECT 'polygon:' || seq || ':0' AS object, 12::BIGINT AS faces, ((xmax - xmin) * (ymax - ymin) * 100)::DOUBLE AS volume, 0::BIGINT AS degenerate, 0::BIGINT AS open_edges FROM big WHERE type IN ('ECONOMY', 'MEDIUM', 'PROMO')
    UNION ALL SELECT 'line:' || seq || ':0', 12, ((xmax - xmin) * (ymax - ymin) * 100)::DOUBLE, 0, 0 FROM big WHERE type = 'LARGE' AND seq NOT IN (SELECT a_id FROM pairs JOIN dom USING (b_id) WHERE common > 0.3 * a_area)
    UNION ALL SELECT 'plate', 12, 1100.0 * 1100.0 * 0.4, 0, 0""")
def water_layer(spark, d):
    """The water relief on its base plate, polygons before lines: solids with their volumes."""
    return _solid(layers.water(_water_features(spark, d), (0, 0, 1100, 1100), 1.0, 40.0, 64.0))


@query()
def water_columns(spark, d):
    """The regions that are cut from the terrain, lines before polygons; lines have round ends (no closed form in SQL)."""
    return layers.water_columns(_water_features(spark, d), 40.0, 64.0).select("object", F.round(shapes.region_area(F.col("rings")), 4).alias("area"))


@query(with_sql("feat") + " SELECT seq::VARCHAR || ':0' AS object, 12::BIGINT AS faces, round((xmax - xmin) * (ymax - ymin) * 0.2, 4)::DOUBLE AS volume, 0::BIGINT AS degenerate, 0::BIGINT AS open_edges FROM feat WHERE type = 'SMALL' AND (xmax - xmin) * (ymax - ymin) >= 100 AND (xmax - xmin) * (ymax - ymin) / sqrt(((xmax - xmin) * (xmax - xmin) + (ymax - ymin) * (ymax - ymin))::DOUBLE) > 0")
def vegetation_layer(spark, d):
    """Plates of vegetation of the least area."""
    green = _regions(fx.features(spark, d).where(S.tag_filter(F.col("tags"), P.LAYERS["vegetation"])))
    return _solid(layers.vegetation(green, _ground(spark, d), 1.0, STEP, 100.0))


@query()
def vegetation_cut(spark, d):
    """The same with buildings and water cut out (the areas of what is left have no closed form in SQL)."""
    f = fx.features(spark, d)
    none = layers.excluded(_regions(f.where("type = 'STANDARD'")), None, _regions(_water(spark, d)))
    green = _regions(f.where(S.tag_filter(F.col("tags"), P.LAYERS["vegetation"])))
    return _solid(layers.vegetation(green, _ground(spark, d), 1.0, STEP, 100.0, without=none))


@query(with_sql("feat") + " SELECT seq::VARCHAR || ':0' AS object, 12::BIGINT AS faces, ((xmax - xmin) * (ymax - ymin) * 6)::DOUBLE AS volume, 0::BIGINT AS degenerate, 0::BIGINT AS open_edges FROM feat WHERE type = 'STANDARD' AND (xmax - xmin) * (ymax - ymin) >= 10")
def exclusion_columns(spark, d):
    return _solid(layers.exclusion_columns(_regions(fx.features(spark, d).where("type = 'STANDARD'")), _ground(spark, d), 1.0, STEP))


@query(with_sql("grid") + ", m AS (SELECT max(row) AS r FROM grid) SELECT 'terrain' AS object, 4 * 63 * r + 4 * (63 + r) AS faces, 0::BIGINT AS degenerate, 0::BIGINT AS open_edges FROM m")
def terrain_solid(spark, d):
    g = fx.raster(spark, d).withColumn("z", F.coalesce("z", F.lit(0.0)))
    return mesh.report(*layers.terrain(g, 1.0)).select("object", "faces", "degenerate", "open_edges")


@query(with_sql("feat", "grid") + """, m AS (SELECT max(row) AS r FROM grid), b AS (SELECT xmin % 60 + 0.2 AS x0, ymin % r + 0.2 AS y0, xmin % 60 + 0.2 + 2 + seq % 5 AS x1, ymin % r + 0.2 + 1 + seq % 4 AS y1 FROM feat, m WHERE type = 'ECONOMY'),
    k AS (SELECT row, col FROM grid, m WHERE row < r AND col < 63 AND NOT EXISTS (SELECT 1 FROM b WHERE col + 0.5 > x0 AND col + 0.5 < x1 AND row + 0.5 > y0 AND row + 0.5 < y1)),
    e AS (SELECT count(*) * 4 - 2 * (SELECT count(*) FROM k a JOIN k b ON (b.row = a.row AND b.col = a.col + 1) OR (b.col = a.col AND b.row = a.row + 1)) AS edges, count(*) AS cells FROM k)
    SELECT 'terrain' AS object, 4 * cells + 2 * edges AS faces, 0::BIGINT AS degenerate FROM e""")
def terrain_with_holes(spark, d):
    """The ground's solid without the cells whose centre lies in water."""
    g = fx.raster(spark, d).withColumn("z", F.coalesce("z", F.lit(0.0)))
    x0, y0 = F.col("xmin") % 60 + 0.2, F.col("ymin") % (F.col("rows") - 1) + 0.2
    w = raster.with_shape(fx.features(spark, d).where("type = 'ECONOMY'"), g).select(shapes.box_region(x0, y0, x0 + 2 + F.col("seq") % 5, y0 + 1 + F.col("seq") % 4).alias("rings"))
    return mesh.report(*layers.terrain(g, 1.0, water_=w)).select("object", "faces", "degenerate")


@query(with_sql("grid") + ", m AS (SELECT max(row) AS r FROM grid) SELECT 'base' AS object, 6 * (63 + r) AS faces, 0::BIGINT AS degenerate FROM m")
def terrain_base(spark, d):
    g = fx.raster(spark, d).withColumn("z", F.coalesce("z", F.lit(0.0)))
    return mesh.report(*layers.base(g, 3.0)).select("object", "faces", "degenerate")


@query()
def water_surfaces(spark, d):
    """Surfaces of all waters, rivers and small ones too, at their outline's level, refined: points and faces by object."""
    small = F.transform("parts", lambda r: F.transform(r, lambda v: v / STEP))
    wet = _water_features(spark, d).withColumns({"parts": small, "width": (F.col("width").cast("double") / STEP).cast("string")})
    v, f = layers.water_surfaces(wet, _ground(spark, d), 0.5, 0.0)
    return f.groupBy("object").agg(F.count(F.lit(1)).alias("faces")).join(v.groupBy("object").agg(F.count(F.lit(1)).alias("points"), F.round(F.min("z"), 6).alias("z")), "object")


@query(with_sql("feat") + " SELECT seq::VARCHAR AS object, 2::BIGINT AS faces, ((xmax - xmin) * (ymax - ymin))::DOUBLE AS area FROM feat")
def triangulate(spark, d):
    """Rectangles as triangles, and the triangles' area."""
    v, f = shapes.surfaces(fx.features(spark, d).select(F.col("seq").cast("string").alias("object"), shapes.box_region("xmin", "ymin", "xmax", "ymax").alias("rings"), F.lit(0.0).alias("z")))
    c = mesh.corners(v, f)
    twice = (F.col("x2") - F.col("x1")) * (F.col("y3") - F.col("y1")) - (F.col("x3") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return c.groupBy("object").agg(F.count(F.lit(1)).alias("faces"), F.sum(twice / 2).alias("area"))


@query(with_sql("feat") + " SELECT seq::VARCHAR AS object, ((xmax - xmin) * (ymax - ymin))::DOUBLE AS area, true AS short FROM feat WHERE xmax - xmin <= 24")
def refine_triangles(spark, d):
    """Triangles halved until no edge is over eight (five rounds are enough for boxes up to 24 wide): the area stays."""
    x = fx.features(spark, d).where("xmax - xmin <= 24").select(F.col("seq").cast("string").alias("object"), shapes.box_region("xmin", "ymin", "xmax", "ymax").alias("rings"), F.lit(0.0).alias("z"))
    c = mesh.corners(*shapes.surfaces(x, 12.0))
    twice = (F.col("x2") - F.col("x1")) * (F.col("y3") - F.col("y1")) - (F.col("x3") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    size = lambda a, b: F.hypot(F.col(f"x{a}") - F.col(f"x{b}"), F.col(f"y{a}") - F.col(f"y{b}"))
    return c.groupBy("object").agg(F.round(F.sum(F.abs(twice) / 2), 6).alias("area"), F.max(F.greatest(size(1, 2), size(2, 3), size(3, 1)) <= 12.0).alias("short"))


@query(FACE_SQL + " SELECT count(*) AS faces, (SELECT count(*) FROM grid) AS points FROM f")
def mesh_repair(spark, d):
    """A mesh of two copies of each point and face, and a face without area, repaired: one copy is left."""
    v, f = _mesh(spark, d)
    shift = 10_000_000_000
    doubled = v.unionByName(v.withColumn("vid", F.col("vid") + shift))
    more = f.select("object", (F.col("fid") + shift).alias("fid"), *((F.col(f"v{k}") + shift).alias(f"v{k}") for k in (2, 3, 1))).toDF("object", "fid", "v1", "v2", "v3")
    flat = f.limit(1).select("object", F.lit(-1).cast("long").alias("fid"), "v1", "v2", F.col("v1").alias("v3"))
    points, faces = mesh.repaired(doubled, f.select("object", "fid", "v1", "v2", "v3").unionByName(more).unionByName(flat))
    return faces.agg(F.count(F.lit(1)).alias("faces")).crossJoin(F.broadcast(points.agg(F.count(F.lit(1)).alias("points"))))


@query(with_sql("grid") + ", m AS (SELECT max(row) AS r FROM grid) SELECT 'terrain' AS object, 0::BIGINT AS loop, 2 * (63 + r) AS points FROM m")
def longest_loop(spark, d):
    return mesh.longest_loop(_mesh(spark, d)[1])


@query(FACE_SQL + ", k AS (SELECT * FROM f WHERE fid % 3 = 0), u AS (SELECT DISTINCT unnest([v1, v2, v3]) AS v FROM k) SELECT count(*) AS points, max(row_number) AS last, (SELECT count(*) FROM k) AS faces FROM (SELECT row_number() OVER (ORDER BY v) - 1 AS row_number FROM u)")
def mesh_reindex(spark, d):
    v, f = _mesh(spark, d)
    points, faces = mesh.reindexed(v, f.where(F.col("fid") % 3 == 0))
    return points.agg(F.count(F.lit(1)).alias("points"), F.max("vid").alias("last")).crossJoin(F.broadcast(faces.agg(F.count(F.lit(1)).alias("faces"))))


@query(FACE_SQL + " SELECT count(*) AS faces FROM f JOIN q ON q.v = CASE WHEN fid % 2 = 0 THEN v1 ELSE v1 - 1 END WHERE q.col + CASE WHEN fid % 2 = 0 THEN 1 ELSE 2 END / 3.0::DOUBLE <= 20.5 AND q.row + CASE WHEN fid % 2 = 0 THEN 1 ELSE 2 END / 3.0::DOUBLE <= 30.5")
def faces_inside(spark, d):
    """Faces whose centre lies in a box."""
    v, f = _mesh(spark, d)
    box = spark.range(1).select(*(F.lit(x).alias(n) for x, n in ((0.0, "a"), (0.0, "b"), (20.5, "c"), (30.5, "e"))))
    return layers.faces_inside(v, f.select("object", "fid", "v1", "v2", "v3"), box)[1].agg(F.count(F.lit(1)).alias("faces"))


def model(spark, d) -> Iterator[tuple[DataFrame, DataFrame]]:
    """A small model's layers, one after the other, as vertices and faces: the surface is the ground's, the walls its base."""
    # A ground of 32 rows and columns is held as rows, so that no layer plans and reads it again.
    g = spark.createDataFrame(_ground(spark, d).collect(), "row long, col long, z double")
    k = P.MODEL_MM / 992.0
    ends = g.agg(F.min("z").alias("a"), F.max("z").alias("b"))
    surface = g.crossJoin(F.broadcast(ends)).select(F.lit("terrain_surface").alias("object"), (F.col("row") * 32 + F.col("col")).alias("vid"), (F.col("col") * STEP * k).alias("x"), (F.col("row") * STEP * k).alias("y"), S.terrain_z(F.col("z"), F.col("a"), F.col("b")).alias("z"))
    top = raster.heightfield_faces(g).select(F.lit("terrain_surface").alias("object"), "fid", "v1", F.col("v3").alias("v2"), F.col("v2").alias("v3"))
    ground = surface.select((F.col("vid") / 32).cast("long").alias("row"), (F.col("vid") % 32).alias("col"), "z")
    ground = spark.createDataFrame(ground.collect(), "row long, col long, z double")
    walls = layers.base(ground, 0.0)
    named = lambda pair, name: tuple(x.withColumn("object", F.lit(name)) for x in _merged(pair))
    f = fx.features(spark, d)
    houses = f.where("type = 'STANDARD'").select(F.col("seq").alias("id"), shapes.box_region("xmin", "ymin", "xmax", "ymax").alias("rings"), F.lit(20.0).alias("est_height"))
    green = _regions(f.where("type = 'SMALL'"))
    wet = _water_features(spark, d)
    roads, points = _roads(spark, d), fx.nodes(spark, d)
    yield surface, top
    yield tuple(x.withColumn("object", F.lit("terrain_walls")) for x in (walls[0].withColumns({"x": F.col("x") * STEP * k, "y": F.col("y") * STEP * k}), walls[1]))
    yield named(layers.buildings(houses, ground, 1.0, k, STEP), "buildings")
    yield named(layers.roads(roads, points, ground, 1.0, k, STEP), "roads")
    yield named(layers.water(wet, (0, 0, 992, 992), k, 40.0, 64.0), "water")
    yield named(layers.vegetation(green, ground, k, STEP, 100.0), "vegetation")


def _merged(pair) -> tuple[DataFrame, DataFrame]:
    """Solids of many objects as one: points are numbered by their object's hash."""
    v, f = pair
    number = lambda c: F.xxhash64("object", c)
    return v.withColumn("vid", number("vid")), f.withColumns({"fid": number("fid"), **{f"v{k}": number(f"v{k}") for k in (1, 2, 3)}})


@query()
def mesh_rules(spark, d):
    """The twelve model rules and the verdict over a model of all layers."""
    # Layer by layer, a row each: one plan of all layers took longer to make than to run.
    told = [mesh.summary(*layer) for layer in model(spark, d)]
    objects = spark.createDataFrame([r for x in told for r in x.collect()], told[0].schema)
    names = spark.createDataFrame([(k, P.EXTRUDERS[k.split("_")[0]]) for k in P.COLOURS], "object string, extruder int")
    return mesh.check_summary(objects, names, names)


@query("SELECT * FROM (VALUES ('buildings', 1, 245, 230, 200), ('roads', 2, 90, 90, 90), ('terrain_surface', 1, 200, 180, 140), ('terrain_walls', 1, 70, 65, 55), ('vegetation', 4, 107, 142, 35), ('water', 3, 60, 150, 220)) t(object, extruder, red, green, blue)")
def layer_styles(spark, d):
    """Extruder and colour of each layer."""
    rows = spark.createDataFrame([(k, P.EXTRUDERS[k.split("_")[0]], v) for k, v in P.COLOURS.items()], "object string, extruder int, colour string")
    c = S.hex_colour(F.col("colour"))
    return rows.select("object", "extruder", *(c[i].alias(n) for i, n in enumerate(("red", "green", "blue"))))


@query("SELECT o_orderkey AS way, o_orderkey % 10 = 0 AS bridge FROM orders")
def bridge_flag(spark, d):
    """All roads, with whether they are bridges."""
    return _roads(spark, d).select("way", F.coalesce("bridge", F.lit(False)).alias("bridge"))
