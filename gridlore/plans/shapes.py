"""Queries over regions and lines: overlay, buffers, clipping, rings, grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlore.functions import crs
from gridlore.functions import geometry as G
from gridlore.functions import scalars as S
from gridlore.operators import assemble, layers, raster, shapes
from gridlore.operators import features as X
from gridlore.plans import fixtures as fx
from gridlore.plans.fixtures import with_sql
from gridlore.plans.queries import RING_SQL, _regions, _rings, _roads
from gridlore.plans.registry import query

WIN = (100.5, 100.5, 800.5, 800.5)
WIN_SQL = "greatest(least(xmax, 800.5) - greatest(xmin, 100.5), 0) * greatest(least(ymax, 800.5) - greatest(ymin, 100.5), 0)"


def _area(c: str = "rings"):
    return F.round(shapes.region_area(F.col(c)), 6)


@query(with_sql("feat") + f", k AS (SELECT seq, ((xmax - xmin) * (ymax - ymin))::DOUBLE AS own, ({WIN_SQL})::DOUBLE AS common FROM feat) SELECT seq AS id, common, own - common AS rest, 490000.0::DOUBLE + own - common AS whole FROM k")
def polygon_overlay(spark, d):
    """The areas of each rectangle's intersection with a window, of what is left of it, and of both together."""
    # The table is small next to the work that its rows make.
    x = _regions(fx.features(spark, d)).repartition("id").withColumn("window", shapes.box_region(*map(F.lit, WIN)))
    area = lambda c: F.round(shapes.region_area(c), 6)
    return x.select("id", area(shapes.intersection("rings", "window")).alias("common"), area(shapes.difference("rings", "window")).alias("rest"), area(shapes.union("rings", "window")).alias("whole"))


@query(with_sql("feat") + " SELECT count(*)::DOUBLE AS area FROM (SELECT DISTINCT x, y FROM (SELECT x, unnest(range(ymin, ymax)) AS y FROM (SELECT ymin, ymax, unnest(range(xmin, xmax)) AS x FROM feat WHERE type = 'ECONOMY')))")
def polygon_union(spark, d):
    """The area that all rectangles of a kind take together."""
    whole = shapes.united(_regions(fx.features(spark, d).where("type = 'ECONOMY'")), 64.0)
    return whole.agg(F.round(F.sum(shapes.region_area(F.col("rings"))), 6).alias("area"))


@query(with_sql("nodes") + """, e AS (SELECT way, count(*) AS n, arg_min(x, pos) AS xa, arg_min(y, pos) AS ya, arg_max(x, pos) AS xb, arg_max(y, pos) AS yb FROM nodes GROUP BY way)
    SELECT way, round(sqrt(((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya))::DOUBLE) * 5, 4) AS area FROM e WHERE n >= 2 AND (xa <> xb OR ya <> yb)""")
def buffer_line(spark, d):
    """The area of flat buffers, two and a half on each side, around the line from each way's first point to its last."""
    w = assemble.ways(fx.nodes(spark, d)).withColumn("ends", F.array(F.col("points")[0], F.element_at("points", -1)))
    x = w.where(F.col("ends")[0] != F.col("ends")[1]).select("way", shapes.buffer_flat(shapes.flat_line(F.col("ends")), F.lit(2.5)).alias("rings"))
    return x.select("way", F.round(shapes.region_area(F.col("rings")), 4).alias("area"))


@query()
def buffer_round(spark, d):
    """The area of round buffers around whole ways (arcs are polygons, so SQL has no closed form)."""
    w = assemble.ways(fx.nodes(spark, d))
    return w.select("way", F.round(shapes.buffer_round_area(shapes.flat_line(F.col("points")), F.lit(2.5)), 4).alias("area"))


@query(with_sql("feat") + f" SELECT seq AS id, ({WIN_SQL})::DOUBLE AS area FROM feat WHERE {WIN_SQL} > 0")
def clip_polygons(spark, d):
    """Rectangles cut to a window, those outside dropped."""
    x = _regions(fx.features(spark, d)).select("id", F.lit("polygon").alias("kind"), F.col("rings").alias("parts"))
    return shapes.clip_to_box(x, WIN).select("id", _area("parts").alias("area"))


INSIDE_SQL = """, c AS (SELECT *, sqrt(((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))::DOUBLE) AS l,
      greatest(0.0, CASE WHEN x2 <> x1 THEN least((100.5 - x1) / (x2 - x1)::DOUBLE, (800.5 - x1) / (x2 - x1)::DOUBLE) WHEN x1 BETWEEN 101 AND 800 THEN 0 ELSE 2 END, CASE WHEN y2 <> y1 THEN least((100.5 - y1) / (y2 - y1)::DOUBLE, (800.5 - y1) / (y2 - y1)::DOUBLE) WHEN y1 BETWEEN 101 AND 800 THEN 0 ELSE 2 END)::DOUBLE AS t0,
      least(1.0, CASE WHEN x2 <> x1 THEN greatest((100.5 - x1) / (x2 - x1)::DOUBLE, (800.5 - x1) / (x2 - x1)::DOUBLE) WHEN x1 BETWEEN 101 AND 800 THEN 1 ELSE -1 END, CASE WHEN y2 <> y1 THEN greatest((100.5 - y1) / (y2 - y1)::DOUBLE, (800.5 - y1) / (y2 - y1)::DOUBLE) WHEN y1 BETWEEN 101 AND 800 THEN 1 ELSE -1 END)::DOUBLE AS t1 FROM segs),
    i AS (SELECT way, sum(l) AS whole, sum(greatest(t1 - t0, 0) * l) AS inside FROM c GROUP BY way)"""


def _length(pieces):
    """Summed length of lines of flat coordinates."""
    one = lambda p: F.aggregate(F.transform(F.sequence(F.lit(0), (F.size(p) / 2 - 2).cast("int")), lambda i: F.hypot(F.get(p, 2 * i + 2) - F.get(p, 2 * i), F.get(p, 2 * i + 3) - F.get(p, 2 * i + 1))), F.lit(0.0), lambda a, v: a + v)
    return F.aggregate(F.transform(pieces, one), F.lit(0.0), lambda a, v: a + v)


@query(with_sql("nodes", "segs") + INSIDE_SQL + " SELECT way, round(inside, 5) AS length FROM i WHERE inside > 0.000001")
def clip_lines(spark, d):
    """Ways cut to a window, those outside dropped."""
    x = assemble.ways(fx.nodes(spark, d)).select("way", F.lit("line").alias("kind"), F.array(shapes.flat_line(F.col("points"))).alias("parts"))
    return shapes.clip_to_box(x, WIN).select("way", F.round(_length(F.col("parts")), 5).alias("length")).where("length > 0.000001")


@query(with_sql("nodes", "segs") + INSIDE_SQL + " SELECT way, round(inside, 5) AS bridge, round(whole - inside, 5) AS land FROM i")
def split_at_water(spark, d):
    """Ways split where they meet a region: the length over it and beside it."""
    x = assemble.ways(fx.nodes(spark, d)).select("way", shapes.split_at_boundary(shapes.flat_line(F.col("points")), shapes.box_region(*map(F.lit, WIN))).alias("s"))
    return x.select("way", F.round(_length(F.col("s.bridge")), 5).alias("bridge"), F.round(_length(F.col("s.land")), 5).alias("land"))


@query()
def repair_rings(spark, d):
    """The area and the number of rings of ways' rings made valid (crossings have no closed form in SQL)."""
    x = _rings(spark, d).select("way", shapes.repair(F.array(shapes.flat_ring(F.col("ring")))).alias("rings"))
    return x.select("way", F.size("rings").alias("rings"), F.round(shapes.region_area(F.col("rings")), 3).alias("area"))


@query(with_sql("feat") + " SELECT seq AS id, greatest((xmax - xmin) * (ymax - ymin), 9)::DOUBLE AS area, 2::BIGINT AS polygons FROM feat")
def largest_part(spark, d):
    """Of a region of two parts the area of the larger one, and the number of parts."""
    x = _regions(fx.features(spark, d)).withColumn("rings", F.concat("rings", shapes.box_region(*(F.lit(v) for v in (5000, 5000, 5003, 5003)))))
    return x.select("id", shapes.region_area(layers.largest_part("rings")).alias("area"), F.size(shapes.polygons("rings")).cast("long").alias("polygons"))


@query(with_sql("feat") + " SELECT id, count(*) AS parts, sum(area) AS area FROM (SELECT seq AS id, ((xmax - xmin) * (ymax - ymin))::DOUBLE AS area FROM feat UNION ALL SELECT seq, 9.0 FROM feat) WHERE area >= 50 GROUP BY id")
def flatten_parts(spark, d):
    """Multi-part regions as a row a part, those under an area left out."""
    x = _regions(fx.features(spark, d)).withColumn("rings", F.concat("rings", shapes.box_region(*(F.lit(v) for v in (5000, 5000, 5003, 5003)))))
    return layers.polygons_of(x, 50.0).groupBy("id").agg(F.count(F.lit(1)).alias("parts"), F.sum("area").alias("area"))


@query(RING_SQL + """, c AS (SELECT way, sum((x + qx) * (x * qy - qx * y))::DOUBLE AS cx, sum((y + qy) * (x * qy - qx * y))::DOUBLE AS cy FROM n WHERE c >= 3 GROUP BY way)
    SELECT way, round(cx / (6 * area), 4) AS x, round(cy / (6 * area), 4) AS y FROM c JOIN r USING (way) WHERE area <> 0""")
def ring_centroid(spark, d):
    x = _rings(spark, d).withColumn("c", G.ring_centroid(F.col("ring"))).where("c IS NOT NULL")
    return x.select("way", F.round("c.x", 4).alias("x"), F.round("c.y", 4).alias("y"))


@query(RING_SQL + " SELECT way, (2 * count(*) + 1)::BIGINT AS points, sum(x + qx)::DOUBLE + arg_min(0.75 * x + 0.25 * qx, pos) AS sum_x FROM n WHERE c >= 3 GROUP BY way")
def chaikin_ring(spark, d):
    w = _rings(spark, d).withColumn("p", G.chaikin_ring(F.col("ring")))
    return w.select("way", F.size("p").cast("long").alias("points"), F.aggregate("p", F.lit(0.0), lambda a, p: a + p["x"]).alias("sum_x"))


DENSE_SQL = ", k AS (SELECT way, CASE WHEN s > 100 THEN ceil(s / 100) ELSE 1 END::BIGINT AS n, s, qx <> x OR qy <> y AS moves FROM (SELECT *, sqrt(((qx - x) * (qx - x) + (qy - y) * (qy - y))::DOUBLE) AS s FROM n WHERE c >= 3))"


@query(RING_SQL + DENSE_SQL + " SELECT way, 1 + sum(n)::BIGINT AS ring, sum(n)::BIGINT AS inside, round(max(s), 6) AS longest, bool_or(s > 100) AS long FROM k GROUP BY way")
def densify_rings(spark, d):
    """Rings with edges of at most a hundred: points with and without the repeated last one; and the longest edge before."""
    x = _rings(spark, d).withColumns({"a": G.densify_ring(F.col("ring"), 100.0), "b": G.densify_inside(F.col("ring"), 100.0), "e": G.longest_edge(F.col("ring"))})
    return x.select("way", F.size("a").cast("long").alias("ring"), F.size("b").cast("long").alias("inside"), F.round("e", 6).alias("longest"), (F.col("e") > 100).alias("long"))


@query(RING_SQL + ", t AS (SELECT way, row_number() OVER (PARTITION BY way ORDER BY atan2(y - my, x - mx), x, y) AS k, x FROM (SELECT *, avg(x) OVER (PARTITION BY way) AS mx, avg(y) OVER (PARTITION BY way) AS my FROM n WHERE c >= 3)) SELECT way, sum(k * x)::DOUBLE AS s FROM t GROUP BY way HAVING count(*) = 3")
def angle_sort(spark, d):
    """The corners of triangles in the order of their angle around their mean: the sum of place times x."""
    w = assemble.ways(fx.nodes(spark, d)).where(F.size("points") == 3).withColumn("p", G.by_angle(F.col("points")))
    return w.select("way", F.aggregate(F.transform("p", lambda p, i: p["x"] * (i + 1)), F.lit(0.0), lambda a, v: a + v).alias("s"))


@query(with_sql("feat") + " SELECT seq AS id, 0 AS begins, 4 AS points FROM feat UNION ALL SELECT seq, 4, 4 FROM feat")
def ring_offsets(spark, d):
    """A region's rings of three points at least, with the running number of points before each."""
    two = F.concat(shapes.box_region("xmin", "ymin", "xmax", "ymax"), F.array(F.array(*(F.lit(0.0),) * 4)), shapes.box_region(*(F.lit(v) for v in (5000, 5000, 5003, 5003))))
    x = fx.features(spark, d).select(F.col("seq").alias("id"), F.explode(shapes.outlines(two)).alias("o"))
    return x.select("id", F.col("o.begins").alias("begins"), (F.size("o.ring") / 2).cast("int").alias("points"))


@query("""WITH b AS (SELECT s_suppkey AS id, 30.0::DOUBLE AS south, 120.0::DOUBLE AS west, 30.0::DOUBLE + (1 + s_suppkey % 5) / 8.0::DOUBLE AS north, 120.0::DOUBLE + (1 + s_suppkey % 7) / 8.0::DOUBLE AS east FROM supplier),
    s AS (SELECT *, CASE WHEN north - south >= east - west THEN 16 ELSE greatest(2, trunc(16 * (north - south) / (east - west))) END::BIGINT AS nr, CASE WHEN north - south >= east - west THEN greatest(2, trunc(16 * (east - west) / (north - south))) ELSE 16 END::BIGINT AS nc FROM b)
    SELECT id, nr * nc AS points, round(nc * nr * (south + north) / 2, 6) AS lat, round(nr * nc * (west + east) / 2, 6) AS lon FROM s""")
def grid_points(spark, d):
    """Points of grids over windows, by the ratio of their sides; their number and the sums of their places."""
    k = F.col("s_suppkey")
    b = fx.table(spark, d, "supplier").select(k.alias("id"), F.lit(30.0).alias("south"), F.lit(120.0).alias("west"), (30.0 + (1 + k % 5) / 8.0).alias("north"), (120.0 + (1 + k % 7) / 8.0).alias("east"))
    total = lambda c: F.round(F.sum(c), 6).alias(c)
    return raster.linspace_grid(b, 16).groupBy("id").agg(F.count(F.lit(1)).alias("points"), total("lat"), total("lon"))


@query(with_sql("grid") + " SELECT count(*) AS cells, count(*) FILTER (WHERE z IS NOT NULL) AS known, 0::BIGINT AS missing, round(sum(z), 4) AS total FROM grid")
def fill_missing(spark, d):
    """Grids of 64 rows filled: no cell is missing, and known cells stay as they are."""
    g = fx.raster(spark, d)
    out = raster.fill_missing(g.withColumn("grid", F.floor(F.col("row") / 64))).withColumnRenamed("z", "filled").join(g, ["row", "col"])
    return out.agg(F.count(F.lit(1)).alias("cells"), F.count("z").alias("known"), F.count_if(F.col("filled").isNull()).alias("missing"), F.round(F.sum(F.when(F.col("z").isNotNull(), F.col("filled"))), 4).alias("total"))


@query(with_sql("grid") + ", m AS (SELECT max(row) AS r FROM grid) SELECT CASE WHEN row = 0 THEN col WHEN col = 63 THEN 63 + row WHEN row = r THEN 126 + r - col ELSE 126 + 2 * r - row END::BIGINT AS place, row, col FROM grid, m WHERE row IN (0, r) OR col IN (0, 63)")
def boundary_loop(spark, d):
    return raster.boundary_loop(fx.raster(spark, d))


@query()
def local_frame(spark, d):
    """Cities in metres from the corner of a window (the projection's twin is `project_utm`)."""
    lat, lon = (F.col(c) / 1_000_000 for c in ("lat", "lon"))
    x, y = crs.local_frame(lat, lon, S.utm_zone(lon), F.lit(29.0), F.lit(118.5))
    return fx.cities(spark, d).where(S.utm_zone(lon) == 50).select("city", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("SELECT o_orderkey AS way, CASE o_orderpriority WHEN '1-URGENT' THEN 6.0 WHEN '2-HIGH' THEN 12.0 WHEN '3-MEDIUM' THEN 8.0 WHEN '4-NOT SPECIFIED' THEN 6.0 ELSE 4.0 END::DOUBLE * 2.5::DOUBLE AS width FROM orders")
def road_width(spark, d):
    return _roads(spark, d).select("way", S.road_width(F.col("highway")).alias("width"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 80 < 5 THEN 512 WHEN s_suppkey % 80 < 50 THEN 768 ELSE 1024 END AS points FROM supplier")
def grid_resolution(spark, d):
    return fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), S.grid_points((F.col("s_suppkey") % 80).cast("double")).alias("points"))


@query(with_sql("feat") + " SELECT CASE WHEN name IS NULL THEN 'no name' WHEN type = 'SMALL' THEN 'kind' WHEN (xmax - xmin) * (ymax - ymin) < 50 THEN 'small' ELSE 'kept' END AS reason, count(*) AS n FROM feat GROUP BY 1")
def skip_counters(spark, d):
    return X.skipped(fx.features(spark, d), **{"no name": F.col("name").isNull(), "kind": F.col("type") == "SMALL", "small": X.box_area() < 50})


@query("SELECT 0::BIGINT AS place, 'parts: ' || count(*) AS line FROM part UNION ALL SELECT row_number() OVER (ORDER BY count(*) DESC, p_type), '  ' || p_type || ': ' || count(*) FROM part GROUP BY p_type")
def text_report(spark, d):
    return X.report_lines("parts", X.frequency(fx.table(spark, d, "part"), "p_type"), "p_type")


@query(with_sql("feat") + " SELECT DISTINCT name FROM feat WHERE name IS NOT NULL ORDER BY name LIMIT 5")
def first_names(spark, d):
    """The first five names, for display."""
    return fx.features(spark, d).where("name IS NOT NULL").select("name").distinct().orderBy("name").limit(5)


@query(with_sql("feat") + " SELECT seq FROM feat WHERE NOT coalesce(name LIKE '%a%', false)")
def mask_complement(spark, d):
    """The rows that a mask does not have; an unknown mask is none."""
    return fx.features(spark, d).where(~F.coalesce(F.col("name").contains("a"), F.lit(False))).select("seq")
