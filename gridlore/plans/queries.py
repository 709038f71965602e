"""The registered queries over derived features, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlore import profiles as P
from gridlore.functions import crs
from gridlore.functions import geometry as G
from gridlore.functions import scalars as S
from gridlore.functions.simplify import simplify
from gridlore.operators import assemble, layers, mesh, raster, ribbon, shapes, spatial, tiles
from gridlore.operators import features as X
from gridlore.plans import fixtures as fx
from gridlore.plans.fixtures import with_sql
from gridlore.plans.registry import query

WATER_SQL = "type IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO')"
CLIP_SQL = "greatest(xmin, 100) AS xmin, greatest(ymin, 100) AS ymin, least(xmax, 800) AS xmax, least(ymax, 800) AS ymax"
MEETS_SQL = "xmin < 800 AND xmax > 100 AND ymin < 800 AND ymax > 100"


def _water(spark, d):
    return fx.features(spark, d).where(S.tag_filter(F.col("tags"), P.LAYERS["water"]))


@query(with_sql("feat") + f""", c AS (SELECT seq, osm_id, type, {CLIP_SQL} FROM feat WHERE {WATER_SQL} AND {MEETS_SQL}),
    u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY osm_id ORDER BY seq) AS n FROM c) WHERE n = 1)
    SELECT osm_id, type, CASE WHEN type = 'LARGE' THEN (xmax - xmin) * 60.0::DOUBLE ELSE ((xmax - xmin) * (ymax - ymin))::DOUBLE END AS est_area FROM u ORDER BY est_area DESC, osm_id LIMIT 500""")
def water_topk(spark: SparkSession, d: str) -> DataFrame:
    """Water features in the window, one an id, the 500 largest by estimated area."""
    x = X.dedupe_first(X.clip_boxes(_water(spark, d), fx.WINDOW))
    area = X.estimated_area(F.col("type") == "LARGE", (F.col("xmax") - F.col("xmin")).cast("double"))
    return X.top_by_size(x.select("osm_id", "type", area.alias("est_area")), "est_area", "osm_id", 500)


@query(with_sql("feat") + """ SELECT type, (type IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO')) AS water, type = 'SMALL' AS vegetation, type = 'STANDARD' AS buildings, false AS roads, false AS parks, count(*) AS n FROM feat GROUP BY type""")
def tag_or_filter(spark, d):
    tags = F.col("tags")
    return fx.features(spark, d).select("type", *(S.tag_filter(tags, rule).alias(k) for k, rule in P.LAYERS.items())).groupBy("type", *P.LAYERS).agg(F.count(F.lit(1)).alias("n"))


HIGHWAY = {"1-URGENT": "motorway;trunk", "2-HIGH": "primary", "3-MEDIUM": "secondary", "4-NOT SPECIFIED": "residential", "5-LOW": "service"}
HIGHWAY_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'motorway;trunk' WHEN '2-HIGH' THEN 'primary' WHEN '3-MEDIUM' THEN 'secondary' WHEN '4-NOT SPECIFIED' THEN 'residential' ELSE 'service' END"


def _roads(spark, d):
    p = F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", HIGHWAY["1-URGENT"]).when(p == "2-HIGH", "primary").when(p == "3-MEDIUM", "secondary").when(p == "4-NOT SPECIFIED", "residential").otherwise("service")
    return fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("way"), kind.alias("highway"), (F.col("o_orderkey") % 10 == 0).alias("bridge"))


@query(f"""SELECT o_orderkey AS way, {HIGHWAY_SQL} AS highway FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""")
def highway_isin(spark, d):
    """A list-valued tag passes if any of its elements is wanted."""
    wanted = F.array(*map(F.lit, ("motorway", "primary", "secondary")))
    return _roads(spark, d).where(F.arrays_overlap(F.split("highway", ";"), wanted)).select("way", "highway")


@query(with_sql("feat") + """, k AS (SELECT 'small' AS class, 30.0 AS least UNION ALL SELECT 'medium', 80.0 UNION ALL SELECT 'large', 200.0)
    SELECT class, count(*) AS n, sum((xmax - xmin) * (ymax - ymin))::DOUBLE AS area FROM feat, k WHERE type = 'STANDARD' AND (xmax - xmin) * (ymax - ymin) >= least GROUP BY class""")
def lod_filter(spark, d):
    """Buildings of the least area that each area class shows."""
    levels = F.explode(F.array(*(F.struct(F.lit(c).alias("class"), F.lit(a).alias("least")) for c, a in zip(("small", "medium", "large"), P.STYLE.building_min_area_m2, strict=True))))
    x = fx.features(spark, d).where(S.tag_filter(F.col("tags"), P.LAYERS["buildings"])).select(X.box_area().alias("area"), levels.alias("l"))
    return x.where("area >= l.least").groupBy("l.class").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"))


HEIGHT_SQL = r""", t AS (SELECT *, regexp_replace(height, '[^0-9.]', '', 'g') AS s FROM feat),
    h AS (SELECT *, CASE WHEN regexp_matches(s, '^([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN TRY_CAST(s AS DOUBLE) END AS a, TRY_CAST(levels AS DOUBLE) AS l FROM t),
    f AS (SELECT *, CASE WHEN a > 0 AND a <= 800 THEN a ELSE 10.0::DOUBLE END AS first FROM h),
    e AS (SELECT *, CASE WHEN first = 10 AND l > 0 THEN least(l * 3.5::DOUBLE, 800) ELSE first END AS est_height, ((xmax - xmin) * (ymax - ymin))::DOUBLE AS area FROM f)"""
PROXY_SQL = "CASE WHEN area < 100 THEN 8.0 WHEN area < 200 THEN 10.0 WHEN area < 500 THEN 15.0 WHEN area < 1000 THEN 25.0 WHEN area < 2000 THEN 40.0 ELSE 60.0 END::DOUBLE"


def _heights(spark, d):
    return fx.features(spark, d).select("seq", S.building_height(F.col("height"), F.col("levels")).alias("est_height"), X.box_area().alias("area"))


@query(with_sql("feat") + HEIGHT_SQL + " SELECT seq, est_height FROM e")
def height_estimate(spark, d):
    return _heights(spark, d).select("seq", "est_height")


@query(with_sql("feat") + HEIGHT_SQL + " SELECT avg(est_height) AS mean_height, max(est_height) AS max_height, count(*) AS n FROM e")
def height_summary(spark, d):
    return _heights(spark, d).agg(F.avg("est_height").alias("mean_height"), F.max("est_height").alias("max_height"), F.count(F.lit(1)).alias("n"))


@query(with_sql("feat") + HEIGHT_SQL + f" SELECT seq, {PROXY_SQL} AS height FROM e")
def height_proxy(spark, d):
    return _heights(spark, d).select("seq", S.height_of_area(F.col("area")).alias("height"))


@query(with_sql("feat") + HEIGHT_SQL + f", r AS (SELECT seq, CASE WHEN seq % 7 = 0 THEN {PROXY_SQL} ELSE est_height END AS real FROM e) SELECT seq, greatest(3.0::DOUBLE, least(5.3::DOUBLE, 3.0::DOUBLE + (real - 5.0::DOUBLE) / 145.0::DOUBLE * 2.3::DOUBLE)) AS mm FROM r")
def height_compress(spark, d):
    h = F.when(F.col("seq") % 7 == 0, F.lit(0.0)).otherwise(F.col("est_height"))
    return _heights(spark, d).select("seq", S.model_height(h, F.col("area")).alias("mm"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 80 < 5 THEN 'small' WHEN s_suppkey % 80 < 50 THEN 'medium' ELSE 'large' END AS class FROM supplier")
def area_class(spark, d):
    return fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), S.area_class((F.col("s_suppkey") % 80).cast("double")).alias("class"))


@query(r"""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 AND p_size > 0 THEN p_size::DOUBLE
    ELSE coalesce([500.0, 1000.0, 30.0, 12.0, 6.0, 4.0][p_partkey % 7 + 1], 60.0) END::DOUBLE AS width FROM part""")
def width_lookup(spark, d):
    k = F.col("p_partkey")
    tag = F.when(k % 3 == 0, F.col("p_size").cast("string")).when(k % 3 == 1, "about 12").otherwise(None)
    kind = F.element_at(F.array(*map(F.lit, ("river", "riverbank", "canal", "stream", "drain", "ditch", "tidal_channel"))), (k % 7 + 1).cast("int"))
    return fx.table(spark, d, "part").select(k.alias("id"), S.line_width(tag, kind, P.WATERWAY_WIDTHS).alias("width"))


@query("SELECT s_suppkey AS id, 196.0::DOUBLE / greatest(1000 + s_suppkey, 1500 - s_suppkey % 700) AS scale FROM supplier")
def model_scale(spark, d):
    k = F.col("s_suppkey")
    return fx.table(spark, d, "supplier").select(k.alias("id"), S.model_scale(1000 + k, 1500 - k % 700).alias("scale"))


@query(with_sql("feat") + " SELECT osm_id, seq, type FROM (SELECT *, row_number() OVER (PARTITION BY osm_id ORDER BY seq) AS n FROM feat) WHERE n = 1")
def dedupe_first(spark, d):
    return X.dedupe_first(fx.features(spark, d)).select("osm_id", "seq", "type")


@query(with_sql("feat") + " SELECT kind, count(*) AS n, count(area) AS with_area FROM (SELECT 'polygon' AS kind, (xmax - xmin) * (ymax - ymin) AS area FROM feat WHERE type <> 'LARGE' UNION ALL SELECT 'line', NULL FROM feat WHERE type = 'LARGE') GROUP BY kind")
def union_tiles(spark, d):
    f = fx.features(spark, d)
    polygons = f.where("type <> 'LARGE'").select(F.lit("polygon").alias("kind"), X.box_area().alias("area"))
    return X.union_all(polygons, f.where("type = 'LARGE'").select(F.lit("line").alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("area").alias("with_area"))


@query(with_sql("feat") + " SELECT seq, CASE WHEN type = 'LARGE' THEN (xmax - xmin)::DOUBLE ELSE ((xmax - xmin) * (ymax - ymin))::DOUBLE END AS size FROM feat ORDER BY size DESC, seq")
def mixed_size_sort(spark, d):
    """All features, polygons by area and lines by length in one order."""
    size = F.when(F.col("type") == "LARGE", (F.col("xmax") - F.col("xmin")).cast("double")).otherwise(X.box_area())
    return fx.features(spark, d).select("seq", size.alias("size")).orderBy(F.desc("size"), "seq")


@query(with_sql("nodes") + " SELECT way, count(*) AS points, sum(pos * x)::BIGINT AS check_x, sum(pos * y)::BIGINT AS check_y FROM nodes GROUP BY way HAVING count(*) >= 2")
def way_assembly(spark, d):
    total = lambda c: F.aggregate(F.transform("points", lambda p, i: (p[c] * (i + 1))), F.lit(0.0), lambda a, v: a + v).cast("long").alias(f"check_{c}")
    return assemble.ways(fx.nodes(spark, d)).select("way", F.size("points").alias("points"), total("x"), total("y"))


@query(with_sql("nodes", "segs") + " SELECT way, round(sum(sqrt(((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))::DOUBLE)), 6) AS length FROM segs GROUP BY way")
def way_length(spark, d):
    return assemble.ways(fx.nodes(spark, d)).select("way", F.round(G.line_length(F.col("points")), 6).alias("length"))


@query(with_sql("nodes") + """, e AS (SELECT way, count(*) AS n, arg_min(x, pos) AS xa, arg_min(y, pos) AS ya, arg_max(x, pos) AS xb, arg_max(y, pos) AS yb FROM nodes GROUP BY way)
    SELECT (n >= 4 AND xa = xb AND ya = yb) AS closed, count(*) AS n FROM e WHERE n >= 2 GROUP BY 1""")
def way_closed(spark, d):
    return assemble.ways(fx.nodes(spark, d)).groupBy("closed").agg(F.count(F.lit(1)).alias("n"))


RING_SQL = with_sql("nodes") + """, n AS (SELECT *, count(*) OVER (PARTITION BY way) AS c, coalesce(lead(x) OVER w, first_value(x) OVER w) AS qx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS qy FROM nodes WINDOW w AS (PARTITION BY way ORDER BY pos)),
    r AS (SELECT way, sum(x * qy - qx * y)::DOUBLE / 2 AS area, arg_min(x, pos) AS x0, arg_max(x, pos) AS xn FROM n WHERE c >= 3 GROUP BY way)"""


def _rings(spark, d):
    return assemble.ways(fx.nodes(spark, d)).where(F.size("points") >= 3).select("way", G.close_ring(F.col("points")).alias("ring"))


@query(RING_SQL + " SELECT way, area AS signed_area, abs(area) AS area FROM r")
def ring_area(spark, d):
    return _rings(spark, d).withColumn("signed_area", G.signed_area(F.col("ring"))).select("way", "signed_area", F.abs("signed_area").alias("area"))


@query(RING_SQL + ", s AS (SELECT way, arg_min(x, pos) FILTER (WHERE pos = 2) AS second FROM nodes GROUP BY way) SELECT r.way, abs(area) AS area, CASE WHEN area < 0 THEN xn ELSE second END::DOUBLE AS second_x FROM r JOIN s USING (way)")
def ring_orient(spark, d):
    r = _rings(spark, d).withColumn("ring", G.counter_clockwise(F.col("ring")))
    return r.select("way", G.signed_area(F.col("ring")).alias("area"), F.element_at("ring", 2)["x"].alias("second_x"))


@query(with_sql("nodes", "segs") + ", k AS (SELECT way, ceil(sqrt(((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))::DOUBLE) / 100)::BIGINT AS n, sqrt(((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))::DOUBLE) AS l FROM segs) SELECT way, 1 + sum(n)::BIGINT AS points, round(sum(l), 4) AS length FROM k GROUP BY way")
def densify_line(spark, d):
    w = assemble.ways(fx.nodes(spark, d)).withColumn("points", G.densify(F.col("points"), 100.0))
    return w.select("way", F.size("points").cast("long").alias("points"), F.round(G.line_length(F.col("points")), 4).alias("length"))


@query(with_sql("nodes", "segs") + """, c AS (SELECT way, count(*) AS n, sum(0.75 * x1 + 0.25 * x2 + 0.25 * x1 + 0.75 * x2) AS sx FROM segs GROUP BY way),
    e AS (SELECT way, arg_min(x, pos) AS a, arg_max(x, pos) AS b FROM nodes GROUP BY way)
    SELECT way, (2 * n + 2)::BIGINT AS points, (sx + a + b)::DOUBLE AS sum_x FROM c JOIN e USING (way)""")
def chaikin_line(spark, d):
    w = assemble.ways(fx.nodes(spark, d)).withColumn("points", G.chaikin(F.col("points")))
    return w.select("way", F.size("points").cast("long").alias("points"), F.aggregate("points", F.lit(0.0), lambda a, p: a + p["x"]).alias("sum_x"))


@query(RING_SQL + """, m AS (SELECT o_custkey AS relation, o_orderkey AS way, CASE WHEN o_orderstatus = 'P' THEN 'inner' ELSE 'outer' END AS role FROM orders)
    SELECT relation, count(*) FILTER (WHERE role = 'outer') AS outers, count(*) FILTER (WHERE role = 'inner') AS inners,
           coalesce(sum(abs(area)) FILTER (WHERE role = 'outer'), 0) - coalesce(sum(abs(area)) FILTER (WHERE role = 'inner'), 0) AS net_area FROM m JOIN r USING (way) GROUP BY relation""")
def relation_assembly(spark, d):
    members = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("relation"), F.col("o_orderkey").alias("way"), F.when(F.col("o_orderstatus") == "P", "inner").otherwise("outer").alias("role"))
    sizes = _rings(spark, d).select("way", F.abs(G.signed_area(F.col("ring"))).alias("area"))
    return assemble.relations(members, sizes)


CROSS_SQL = with_sql("feat", "nodes", "segs") + f""", p AS (
    SELECT way, pos, sqrt(((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))::DOUBLE) AS length,
      greatest(0.0, CASE WHEN x2 <> x1 THEN least((xmin - x1) / (x2 - x1)::DOUBLE, (xmax - x1) / (x2 - x1)::DOUBLE) ELSE 0 END, CASE WHEN y2 <> y1 THEN least((ymin - y1) / (y2 - y1)::DOUBLE, (ymax - y1) / (y2 - y1)::DOUBLE) ELSE 0 END)::DOUBLE AS t0,
      least(1.0, CASE WHEN x2 <> x1 THEN greatest((xmin - x1) / (x2 - x1)::DOUBLE, (xmax - x1) / (x2 - x1)::DOUBLE) ELSE 1 END, CASE WHEN y2 <> y1 THEN greatest((ymin - y1) / (y2 - y1)::DOUBLE, (ymax - y1) / (y2 - y1)::DOUBLE) ELSE 1 END)::DOUBLE AS t1
    FROM segs JOIN feat ON least(x1, x2) <= xmax AND greatest(x1, x2) >= xmin AND least(y1, y2) <= ymax AND greatest(y1, y2) >= ymin WHERE {WATER_SQL}),
    q AS (SELECT * FROM p WHERE t0 <= t1)"""
LENGTH_SQL = """, u AS (SELECT *, max(t1) OVER (PARTITION BY way, pos ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM q),
    l AS (SELECT way, sum(greatest(t1 - greatest(t0, coalesce(reach, 0)), 0) * length) AS water_length FROM u GROUP BY way)"""


def _boxes_of(features):
    return features.select(F.col("xmin").alias("bx0"), F.col("ymin").alias("by0"), F.col("xmax").alias("bx1"), F.col("ymax").alias("by1"))


def _crossings(spark, d):
    return spatial.crossings(fx.segments(spark, d), _boxes_of(_water(spark, d)))


@query(CROSS_SQL + " SELECT o_orderkey AS way FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey IN (SELECT way FROM q)")
def bridge_semi(spark, d):
    """Roads tagged as bridges that cross water."""
    return spatial.bridges(_roads(spark, d), spatial.crossing_ways(fx.segments(spark, d), _boxes_of(_water(spark, d)))).select("way")


@query(CROSS_SQL + LENGTH_SQL + " SELECT way, round(water_length, 5) AS water_length FROM l WHERE way % 10 = 0")
def bridge_overlay(spark, d):
    """The length of each tagged bridge over the union of the waters."""
    out = spatial.covered_length(_crossings(spark, d).where(F.col("way") % 10 == 0))
    return out.select("way", F.round("water_length", 5).alias("water_length"))


@query(CROSS_SQL + LENGTH_SQL + " SELECT (SELECT count(*) FROM orders) AS roads, (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 0) AS tagged, (SELECT count(*) FROM l) AS crossing, (SELECT round(sum(water_length), 3) FROM l) AS water_length")
def bridge_stats(spark, d):
    """Numbers of roads, and the length of those that cross water, over the waters united to boxes that do not overlap."""
    waters = spatial.disjoint(_boxes_of(_water(spark, d)))
    over = spatial.covered_length(spatial.crossings(fx.segments(spark, d), waters)).agg(F.count(F.lit(1)).alias("crossing"), F.round(F.sum("water_length"), 3).alias("water_length"))
    return _roads(spark, d).agg(F.count(F.lit(1)).alias("roads"), F.count_if("bridge").alias("tagged")).crossJoin(F.broadcast(over))


def _sides(df: DataFrame, side: str, *more: str) -> DataFrame:
    return df.select(*more, *(F.col(c).alias(n) for c, n in (("xmin", f"{side}x0"), ("ymin", f"{side}y0"), ("xmax", f"{side}x1"), ("ymax", f"{side}y1"))))


PAIR_SQL = """, pairs AS (SELECT a.seq AS a_id, b.seq AS b_id, (a.xmax - a.xmin) * (a.ymax - a.ymin) AS a_area, (b.xmax - b.xmin) * (b.ymax - b.ymin) AS b_area,
    greatest(least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin), 0) * greatest(least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin), 0) AS common FROM feat a JOIN feat b ON a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax
    WHERE a.type = 'LARGE' AND b.type IN ('ECONOMY', 'MEDIUM', 'PROMO'))"""


def _water_pair(spark, d):
    w = _water(spark, d).withColumn("a_id", F.col("seq"))
    return w.where("type = 'LARGE'"), w.where("type <> 'LARGE'")


COVER_SQL = """, cell AS (SELECT DISTINCT x, y FROM (SELECT x, unnest(range(ymin, ymax)) AS y FROM (SELECT ymin, ymax, unnest(range(xmin, xmax)) AS x FROM feat WHERE type = 'LARGE'))),
    own AS (SELECT seq, x, unnest(range(ymin, ymax)) AS y FROM (SELECT seq, ymin, ymax, unnest(range(xmin, xmax)) AS x FROM feat WHERE type IN ('ECONOMY', 'MEDIUM', 'PROMO'))),
    dom AS (SELECT seq AS b_id FROM own LEFT JOIN cell USING (x, y) GROUP BY seq HAVING count(cell.x) > 0.3 * count(*))"""


def _regions(features: DataFrame) -> DataFrame:
    return features.select(F.col("seq").alias("id"), shapes.box_region("xmin", "ymin", "xmax", "ymax").alias("rings"))


@query(with_sql("feat") + PAIR_SQL.replace("WHERE a.type", "AND a.type") + COVER_SQL + " SELECT seq AS a_id FROM feat WHERE type = 'LARGE' AND seq NOT IN (SELECT a_id FROM pairs JOIN dom USING (b_id) WHERE common > 0.3 * a_area)")
def overlap_anti_polygon(spark, d):
    """Polygon wins: a polygon that the lines' boxes together cover by over 0.3 is dominant; a line's box goes if any dominant polygon covers it by over 0.3."""
    lines, polygons = _water_pair(spark, d)
    shares = shapes.covered_shares(_regions(polygons), _regions(lines), 64.0)
    dominant = polygons.join(shares.where(F.col("share") > P.OVERLAP).select(F.col("id").alias("a_id")), "a_id", "left_semi")
    return spatial.dominated(_sides(lines, "a", "a_id"), _sides(dominant, "b")).select("a_id")


@query(with_sql("feat") + COVER_SQL + " SELECT seq AS a_id FROM feat WHERE type IN ('ECONOMY', 'MEDIUM', 'PROMO') AND seq NOT IN (SELECT b_id FROM dom)")
def overlap_anti_line(spark, d):
    """Line wins: a polygon goes if the lines' boxes together cover it by over 0.3."""
    lines, polygons = _water_pair(spark, d)
    return shapes.without_covered(_regions(polygons), _regions(lines), 64.0, P.OVERLAP).select(F.col("id").alias("a_id"))


@query(with_sql("feat") + """, cell AS (SELECT kind, x, y FROM (SELECT kind, x, unnest(range(ymin, ymax)) AS y FROM (SELECT type = 'LARGE' AS kind, ymin, ymax, unnest(range(xmin, xmax)) AS x FROM feat WHERE type IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO'))) GROUP BY ALL),
    own AS (SELECT seq, x, unnest(range(ymin, ymax)) AS y FROM (SELECT seq, ymin, ymax, unnest(range(xmin, xmax)) AS x FROM feat WHERE type = 'STANDARD')),
    n AS (SELECT seq, count(*) AS whole FROM own GROUP BY seq), c AS (SELECT seq, count(*) FILTER (WHERE kind) AS road, count(*) FILTER (WHERE NOT kind) AS water FROM own JOIN cell USING (x, y) GROUP BY seq)
    SELECT n.seq AS a_id FROM n LEFT JOIN c USING (seq) WHERE coalesce(water, 0) <= 0.3 * whole AND coalesce(road, 0) <= 0.5 * whole""")
def building_conflict(spark, d):
    """Buildings that water covers by no more than 0.3, and wide roads (the rivers' boxes here) by no more than half."""
    f = fx.features(spark, d)
    houses = _regions(f.where("type = 'STANDARD'"))
    return layers.without_conflicts(houses, _regions(f.where("type IN ('ECONOMY', 'MEDIUM', 'PROMO')")), _regions(f.where("type = 'LARGE'")), 64.0).select(F.col("id").alias("a_id"))


@query(with_sql("feat", "grid") + """, m AS (SELECT max(row) AS r FROM grid),
    w AS (SELECT seq, xmin % 48 + 3.5 AS x0, ymin % (r - 20) + 4.5 AS y0, xmin % 48 + 6.5 + seq % 7 AS x1, ymin % (r - 20) + 7.5 + seq % 5 AS y1 FROM feat, m WHERE type = 'ECONOMY'),
    p AS (SELECT seq, k, CASE WHEN k IN (1, 2) THEN x1 ELSE x0 END AS px, CASE WHEN k IN (2, 3) THEN y1 ELSE y0 END AS py FROM (SELECT *, unnest(range(0, 5)) AS k FROM w WHERE (x1 - x0) * (y1 - y0) >= 20)),
    q AS (SELECT *, unnest(range(floor(px)::BIGINT - 2, floor(px)::BIGINT + 4)) AS col FROM p),
    n AS (SELECT seq, k, z, row_number() OVER (PARTITION BY seq, k ORDER BY (g.col - px) * (g.col - px) + (g.row - py) * (g.row - py), g.row, g.col) AS i
          FROM (SELECT *, unnest(range(floor(py)::BIGINT - 2, floor(py)::BIGINT + 4)) AS row FROM q) q JOIN grid g ON g.row = q.row AND g.col = q.col WHERE z IS NOT NULL),
    l AS (SELECT seq, quantile_cont(z, 0.25) AS level FROM (SELECT seq, k, max(z) AS z FROM n WHERE i <= 8 GROUP BY seq, k) GROUP BY seq),
    c AS (SELECT row, col, min(level - 1) AS floor FROM (SELECT *, unnest(range(ceil(y0)::BIGINT, floor(y1)::BIGINT + 1)) AS row FROM (SELECT *, unnest(range(ceil(x0)::BIGINT, floor(x1)::BIGINT + 1)) AS col FROM w JOIN l USING (seq))) GROUP BY row, col)
    SELECT row, col, round(CASE WHEN z > c.floor THEN c.floor ELSE z END, 6) AS z FROM grid LEFT JOIN c USING (row, col)""")
def pip_carve(spark, d):
    """The ground with its vertices inside water polygons lowered to a metre under the lower quartile of the polygon's outline; the lowest of several."""
    g = fx.raster(spark, d)
    r, k = F.col("rows") - 1, F.col("seq")
    x0, y0 = F.col("xmin") % 48 + 3.5, F.col("ymin") % (r - 20) + 4.5
    w = raster.with_shape(fx.features(spark, d).where("type = 'ECONOMY'"), g).select(k.alias("id"), shapes.box_region(x0, y0, x0 + 3 + k % 7, y0 + 3 + k % 5).alias("rings"))
    return layers.carve(g, w, 20.0).select("row", "col", F.round("z", 6).alias("z"))


POINT_SQL = ", pt AS (SELECT s_suppkey AS id, (s_suppkey * 7 % 480) / 16.0::DOUBLE + 2.25::DOUBLE AS py, (s_suppkey * 11 % 900) / 16.0::DOUBLE + 2.5::DOUBLE AS px FROM supplier)"


def _points(spark, d):
    k = F.col("s_suppkey")
    return fx.table(spark, d, "supplier").select(k.alias("id"), ((k * 7 % 480) / 16.0 + 2.25).alias("py"), ((k * 11 % 900) / 16.0 + 2.5).alias("px"))


@query(with_sql("grid") + POINT_SQL + ", m AS (SELECT max(row) AS r FROM grid) SELECT id, row, col, z FROM pt CROSS JOIN m JOIN grid ON row = round_even(py / 33.0::DOUBLE * r, 0) AND col = least(63, round_even(px / 63.0::DOUBLE * 63, 0))")
def grid_sample(spark, d):
    p = _points(spark, d).select("id", (F.col("py") / 33).alias("u"), (F.col("px") / 63).alias("v"))
    return raster.sample_nearest(p, fx.raster(spark, d))


@query(with_sql("grid") + POINT_SQL + """, m AS (SELECT max(row) AS r FROM grid), s AS (SELECT row, col, z, lead(z) OVER (PARTITION BY row ORDER BY col) AS zr, lead(z) OVER (PARTITION BY col ORDER BY row) AS zu FROM grid),
    t AS (SELECT row, col, sqrt((zr - z) * (zr - z) + (zu - z) * (zu - z)) AS slope FROM s), e AS (SELECT max(row) AS r, max(col) AS c FROM t WHERE slope IS NOT NULL)
    SELECT id, round(slope, 6) AS slope, slope > 0.05 AS steep FROM pt CROSS JOIN e LEFT JOIN t ON row = round_even(py / 33.0::DOUBLE * r, 0) AND col = least(c, round_even(px / 63.0::DOUBLE * c, 0))""")
def slope_sample(spark, d):
    p = _points(spark, d).select("id", (F.col("py") / 33).alias("u"), (F.col("px") / 63).alias("v"))
    return raster.sample_slope(p, fx.raster(spark, d)).select("id", F.round("slope", 6).alias("slope"), "steep")


@query(with_sql("grid") + POINT_SQL + """, k AS (SELECT id, py, least(px, 63.0) AS px FROM pt), b AS (SELECT id, py, px, floor(py) AS r, least(floor(px), 62) AS c FROM k)
    SELECT id, CASE WHEN count(z) = 4 THEN round(sum(z * (1 - abs(row - py)) * (1 - abs(col - px))), 6) END AS z FROM b JOIN grid ON row IN (r, r + 1) AND col IN (c, c + 1) GROUP BY id""")
def bilinear(spark, d):
    p = _points(spark, d).select("id", F.col("py").alias("fr"), F.col("px").alias("fc"))
    return raster.bilinear(p, fx.raster(spark, d)).select("id", F.round("z", 6).alias("z"))


@query(with_sql("grid") + POINT_SQL + """, n AS (SELECT id, z, row_number() OVER (PARTITION BY id ORDER BY (col - px) * (col - px) + (row - py) * (row - py), row, col) AS k FROM pt JOIN grid ON row BETWEEN floor(py) - 7 AND floor(py) + 8 AND col BETWEEN floor(px) - 7 AND floor(px) + 8 WHERE z IS NOT NULL)
    SELECT id, max(z) AS z FROM n WHERE k <= 8 GROUP BY id""")
def knn_max8(spark, d):
    """The highest of the eight nearest grid vertices."""
    return spatial.nearest_max(_points(spark, d), fx.raster(spark, d))


@query(with_sql("grid") + """, g AS (SELECT row, col, coalesce(z, 0) AS z FROM grid), m AS (SELECT max(row) AS r FROM g), t AS (SELECT unnest(range(-4, 5)) AS d), w AS (SELECT d, exp(-0.5 * d * d) / (SELECT sum(exp(-0.5 * d * d)) FROM t) AS w FROM t),
    v AS (SELECT g.row, g.col, sum(w * s.z) AS z FROM g, w, m, g s WHERE s.row = greatest(0, least(m.r, g.row + d)) AND s.col = g.col GROUP BY g.row, g.col),
    h AS (SELECT v.row, v.col, sum(w * s.z) AS z FROM v, w, v s WHERE s.col = greatest(0, least(63, v.col + d)) AND s.row = v.row GROUP BY v.row, v.col)
    SELECT row, col, round(z, 6) AS z FROM h""")
def gauss_smooth(spark, d):
    g = fx.raster(spark, d).withColumn("z", F.coalesce("z", F.lit(0.0)))
    return raster.gaussian(g, 1.0).select("row", "col", F.round("z", 6).alias("z"))


@query(with_sql("grid") + " SELECT round(max(z) - min(z), 6) AS z_range, round(stddev_pop(z), 6) AS z_std, count(*) FILTER (WHERE z IS NULL) AS missing, CASE WHEN max(z) - min(z) < 30 AND stddev_pop(z) < 10 THEN 'flat' WHEN max(z) - min(z) > 100 OR stddev_pop(z) > 30 THEN 'mountain' ELSE 'moderate' END AS kind FROM grid")
def terrain_class(spark, d):
    return raster.terrain_class(fx.raster(spark, d)).withColumns({"z_range": F.round("z_range", 6), "z_std": F.round("z_std", 6)})


@query(with_sql("grid") + ", s AS (SELECT row, col, z, lead(z) OVER (PARTITION BY row ORDER BY col) AS zr, lead(z) OVER (PARTITION BY col ORDER BY row) AS zu FROM grid) SELECT row, col, round(sqrt((zr - z) * (zr - z) + (zu - z) * (zu - z)), 6) AS slope FROM s WHERE zr IS NOT NULL AND zu IS NOT NULL AND z IS NOT NULL")
def slope_grid(spark, d):
    return raster.slope(fx.raster(spark, d)).select("row", "col", F.round("slope", 6).alias("slope"))


#: The colours of low and of high ground.
LOW_GROUND, HIGH_GROUND = (200, 210, 170), (120, 95, 60)


@query(with_sql("grid") + """, m AS (SELECT min(z) AS a, max(z) AS b FROM grid), t AS (SELECT row, col, greatest(0, least(1, (z - a) / (b - a))) * 0.4::DOUBLE AS t FROM grid, m WHERE z IS NOT NULL)
    SELECT row, col, trunc(200 * (1 - t) + 120 * t)::INTEGER AS red, trunc(210 * (1 - t) + 95 * t)::INTEGER AS green, trunc(170 * (1 - t) + 60 * t)::INTEGER AS blue, 255 AS alpha FROM t""")
def colour_ramp(spark, d):
    g = fx.raster(spark, d).where("z IS NOT NULL")
    ends = g.agg(F.min("z").alias("a"), F.max("z").alias("b"))
    x = g.crossJoin(F.broadcast(ends)).withColumn("c", S.ramp(F.col("z"), F.col("a"), F.col("b"), LOW_GROUND, HIGH_GROUND))
    return x.select("row", "col", *(F.col("c")[k].alias(n) for k, n in enumerate(("red", "green", "blue", "alpha"))))


ENDS_SQL = ", m AS (SELECT row % 3 AS part, CASE WHEN row % 3 = 0 THEN 5.0 ELSE min(z) END::DOUBLE AS a, CASE WHEN row % 3 = 0 THEN 5.0 ELSE max(z) * CASE WHEN row % 3 = 1 THEN 1 ELSE 400 END END::DOUBLE AS b FROM grid WHERE z IS NOT NULL GROUP BY row % 3)"


def _with_ends(spark, d):
    """The raster in three parts: flat, low and high ground."""
    g = fx.raster(spark, d).where("z IS NOT NULL").withColumn("part", F.col("row") % 3)
    most = F.max("z") * F.when(F.col("part") == 1, 1).otherwise(400)
    ends = g.groupBy("part").agg(F.min("z").alias("lo"), most.alias("hi"))
    ends = ends.select("part", *(F.when(F.col("part") == 0, 5.0).otherwise(F.col(c)).alias(n) for c, n in (("lo", "a"), ("hi", "b"))))
    return g.join(F.broadcast(ends), "part")


@query(with_sql("grid") + ENDS_SQL + " SELECT row, col, round(CASE WHEN b - a > 0.01 THEN pow((z - a) / (b - a), 0.45) * 4.0 ELSE 2.0 END - 0.17, 6) AS mm FROM grid JOIN m ON part = row % 3 WHERE z IS NOT NULL")
def relief_curve(spark, d):
    """Elevation to the model's surface along a power curve; the middle on flat ground."""
    return _with_ends(spark, d).select("row", "col", F.round(S.terrain_z(F.col("z"), F.col("a"), F.col("b")), 6).alias("mm"))


@query(with_sql("grid") + ENDS_SQL + """, t AS (SELECT *, CASE WHEN b - a < 0.01 THEN 4.25 ELSE greatest(3.5, least(5.0, 200.0 * (b - a) / 25000.0 / 0.025)) END::DOUBLE AS thick FROM m)
    SELECT row, col, round(CASE WHEN b - a > 0.01 THEN (z - a) / (b - a) * thick ELSE thick / 2 END, 6) AS mm, round(thick, 6) AS thick FROM grid JOIN t ON part = row % 3 WHERE z IS NOT NULL""")
def relief_mapping(spark, d):
    """Elevation to millimetres by the range of heights, within bounds."""
    ends = (F.col("a"), F.col("b"))
    return _with_ends(spark, d).select("row", "col", F.round(S.relief_z(F.col("z"), *ends), 6).alias("mm"), F.round(S.relief_thickness(*ends), 6).alias("thick"))


@query(with_sql("city") + " SELECT b.city AS centre, c.city AS near FROM city b JOIN city c ON abs(b.lat - c.lat) <= 1000000 AND abs(b.lon - c.lon) <= 1000000")
def city_band_join(spark, d):
    """Cities within a degree of each city; cells of a degree make it an equi-join."""
    c, one = fx.cities(spark, d), 1_000_000
    around = lambda x: F.explode(F.sequence(F.floor(F.col(x) / one) - 1, F.floor(F.col(x) / one) + 1))
    centre = c.select(F.col("city").alias("centre"), F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    centre = centre.withColumn("y", around("clat")).withColumn("x", around("clon"))
    near = c.select(F.col("city").alias("near"), "lat", "lon", F.floor(F.col("lat") / one).alias("y"), F.floor(F.col("lon") / one).alias("x"))
    return centre.join(near, ["y", "x"]).where((F.abs(F.col("clat") - F.col("lat")) <= one) & (F.abs(F.col("clon") - F.col("lon")) <= one)).select("centre", "near")


BOX_SQL = with_sql("city") + """, b AS (SELECT city, lat AS lat0, lon AS lon0, lat + 40000 + city * 1000 % 90000 AS lat1, lon + 30000 + city * 1700 % 90000 AS lon1 FROM city),
    y AS (SELECT *, unnest(range((lat0 // 50000)::BIGINT, greatest(lat0 // 50000, ceil(lat1 / 50000.0)::BIGINT - 1) + 1)) AS ty FROM b),
    t AS (SELECT *, unnest(range((lon0 // 50000)::BIGINT, greatest(lon0 // 50000, ceil(lon1 / 50000.0)::BIGINT - 1) + 1)) AS tx FROM y)"""


def _boxes(spark, d):
    k = F.col("city")
    return fx.cities(spark, d).select(k, F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), (F.col("lat") + 40000 + k * 1000 % 90000).alias("lat1"), (F.col("lon") + 30000 + k * 1700 % 90000).alias("lon1"))


@query(BOX_SQL + " SELECT city, ty, tx, greatest(lat0, ty * 50000) AS lat0, least(lat1, (ty + 1) * 50000) AS lat1, greatest(lon0, tx * 50000) AS lon0, least(lon1, (tx + 1) * 50000) AS lon1 FROM t")
def tile_cover(spark, d):
    return tiles.cover(_boxes(spark, d)).select("city", "ty", "tx", "lat0", "lat1", "lon0", "lon1")


@query(BOX_SQL + ", m AS (SELECT DISTINCT ty, tx FROM t WHERE city % 3 = 0) SELECT city, t.ty, t.tx, m.ty IS NOT NULL AS hit FROM t LEFT JOIN m ON t.ty = m.ty AND t.tx = m.tx")
def tile_hits_misses(spark, d):
    t = tiles.cover(_boxes(spark, d)).select("city", "ty", "tx")
    return tiles.hits_and_misses(t, t.where(F.col("city") % 3 == 0)).select("city", "ty", "tx", "hit")


FACE_SQL = with_sql("grid") + """, m AS (SELECT max(row) AS r FROM grid), q AS (SELECT row, col, row * 64 + col AS v FROM grid, m WHERE row < r AND col < 63),
    f AS (SELECT (row * 63 + col) * 2 AS fid, v AS v1, v + 64 AS v2, v + 1 AS v3 FROM q UNION ALL SELECT (row * 63 + col) * 2 + 1, v + 1, v + 64, v + 65 FROM q)"""


def _faces(spark, d):
    return raster.heightfield_faces(fx.raster(spark, d))


@query(FACE_SQL + " SELECT fid, v1, v2, v3 FROM f")
def heightfield_faces(spark, d):
    return _faces(spark, d)


@query(FACE_SQL + ", e AS (SELECT least(v1, v2) AS a, greatest(v1, v2) AS b FROM f UNION ALL SELECT least(v2, v3), greatest(v2, v3) FROM f UNION ALL SELECT least(v3, v1), greatest(v3, v1) FROM f) SELECT a, b FROM e GROUP BY a, b HAVING count(*) = 1")
def boundary_edges(spark, d):
    return raster.boundary_edges(_faces(spark, d))


def _mesh(spark, d):
    v = fx.raster(spark, d).select(F.lit("terrain").alias("object"), (F.col("row") * 64 + F.col("col")).alias("vid"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), (F.coalesce("z", F.lit(0.0)) * 40).alias("z"))
    return v, _faces(spark, d).withColumn("object", F.lit("terrain"))


@query(FACE_SQL + """, v AS (SELECT row * 64 + col AS vid, col::DOUBLE AS x, row::DOUBLE AS y, coalesce(z, 0) * 40 AS z FROM grid),
    n AS (SELECT f.fid, (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) AS nx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) AS ny, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS nz FROM f JOIN v a ON a.vid = v1 JOIN v b ON b.vid = v2 JOIN v c ON c.vid = v3)
    SELECT 'terrain' AS object, fid, CASE WHEN sqrt(nx * nx + ny * ny + nz * nz) > 1e-10 AND nz / sqrt(nx * nx + ny * ny + nz * nz) > 0.1 THEN 'surface' ELSE 'wall' END AS part FROM n""")
def split_by_normal(spark, d):
    return mesh.split_by_normal(*_mesh(spark, d))


@query(with_sql("feat") + """, t AS (SELECT unnest([0, 50, 100, 250, 500, 1000]) AS threshold), x AS (SELECT *, type = 'LARGE' AS line, ((xmax - xmin) * (ymax - ymin))::DOUBLE AS area, (xmax - xmin)::DOUBLE AS length FROM feat WHERE type IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO')),
    k AS (SELECT *, CASE WHEN line THEN length * 60 ELSE area END >= threshold AS kept FROM x, t)
    SELECT threshold, count(*) FILTER (WHERE NOT line AND kept) AS polygons_kept, count(*) FILTER (WHERE NOT line AND NOT kept) AS polygons_skipped, count(*) FILTER (WHERE line AND kept) AS lines_kept, count(*) FILTER (WHERE line AND NOT kept) AS lines_skipped,
      coalesce(sum(area) FILTER (WHERE NOT line AND kept), 0) AS area_kept, coalesce(sum(area) FILTER (WHERE NOT line AND NOT kept), 0) AS area_skipped, coalesce(sum(length) FILTER (WHERE line AND kept), 0) AS length_kept, coalesce(sum(length) FILTER (WHERE line AND NOT kept), 0) AS length_skipped
    FROM k GROUP BY threshold""")
def threshold_panel(spark, d):
    return X.threshold_panel(_water(spark, d), (0, 50, 100, 250, 500, 1000), F.col("type") == "LARGE", X.box_area(), (F.col("xmax") - F.col("xmin")).cast("double"))


@query(f"SELECT {HIGHWAY_SQL} AS highway, count(*) AS n FROM orders GROUP BY 1")
def type_counts(spark, d):
    return X.frequency(_roads(spark, d), "highway")


@query(with_sql("feat") + " SELECT DISTINCT name FROM feat WHERE name IS NOT NULL")
def distinct_names(spark, d):
    return fx.features(spark, d).where("name IS NOT NULL").select("name").distinct()


@query(with_sql("feat") + ", e AS (SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM feat) SELECT *, greatest(0.02::DOUBLE * greatest(xmax - xmin, ymax - ymin), 500) AS margin FROM e")
def extent(spark, d):
    e = fx.features(spark, d).agg(*(f(c).alias(c) for c, f in (("xmin", F.min), ("ymin", F.min), ("xmax", F.max), ("ymax", F.max))))
    return e.withColumn("margin", F.greatest(0.02 * F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")), F.lit(500.0)))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS tags, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS links, length(array_to_string(regexp_extract_all(html, 'href="([^"]*)"', 1), '')) AS link_chars FROM pages""")
def markup_regex(spark, d):
    tags = F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), 1)
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return fx.table(spark, d, "pages").select("page_id", F.size(tags).alias("tags"), F.size(links).alias("links"), F.length(F.array_join(links, "")).alias("link_chars"))


@query("SELECT lang, count(*) FILTER (WHERE contains(text, 'é')) AS with_accent, count(*) FILTER (WHERE contains(text, 'the')) AS with_the, bool_or(contains(text, 'ß')) AS any_sharp FROM documents GROUP BY lang")
def text_name_search(spark, d):
    has = lambda s: F.col("text").contains(s)
    return fx.table(spark, d, "documents").groupBy("lang").agg(F.count_if(has("é")).alias("with_accent"), F.count_if(has("the")).alias("with_the"), F.bool_or(has("ß")).alias("any_sharp"))


AGE_SQL = "(SELECT event_id, (event_id * 7919 % 300000)::DOUBLE AS age, CASE event_id % 3 WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE 86400 END AS ttl FROM events)"


@query(f"SELECT event_id, CASE WHEN ttl < 0 THEN true WHEN ttl = 0 THEN false ELSE age < ttl END AS valid, CASE WHEN age < 60 THEN floor(age)::BIGINT::VARCHAR || 's' WHEN age < 3600 THEN floor(age / 60)::BIGINT::VARCHAR || 'm' WHEN age < 86400 THEN floor(age / 3600)::BIGINT::VARCHAR || 'h' ELSE floor(age / 86400)::BIGINT::VARCHAR || 'd' END AS said FROM {AGE_SQL}")
def cache_ttl(spark, d):
    k = F.col("event_id")
    age = (k * 7919 % 300000).cast("double")
    ttl = F.when(k % 3 == 0, -1).when(k % 3 == 1, 0).otherwise(86400)
    return fx.table(spark, d, "events").select("event_id", tiles.is_valid(age, ttl).alias("valid"), tiles.age_text(age).alias("said"))


@query("SELECT arg_min(s_name, s_suppkey) AS by_priority, arg_max(s_name, s_suppkey * 7 % 13 * 1000000 + s_suppkey) AS by_capacity FROM supplier WHERE s_nationkey % 2 = 0 AND s_suppkey * 7 % 13 >= 1")
def cache_path_policy(spark, d):
    k = F.col("s_suppkey")
    paths = fx.table(spark, d, "supplier").select(F.col("s_name").alias("path"), k.alias("priority"), (k * 7 % 13).alias("free_gb"), (F.col("s_nationkey") % 2 == 0).alias("writable"))
    return tiles.choose_path(paths.orderBy("priority"))


@query(with_sql("city") + " SELECT city, printf('N%02d', lat // 1000000) || printf('E%03d', lon // 1000000) || '.hgt' AS tile, (floor((lon / 1000000.0 + 180) / 6) + 1)::INTEGER AS zone, CASE WHEN city % 2 = 0 THEN 32600 ELSE 32700 END + (floor((lon / 1000000.0 + 180) / 6) + 1)::INTEGER AS epsg FROM city")
def hgt_and_zone(spark, d):
    lat, lon = (F.floor(F.col(c) / 1_000_000) for c in ("lat", "lon"))
    zone = S.utm_zone(F.col("lon") / 1_000_000)
    return fx.cities(spark, d).select("city", S.hgt_name(lat, lon).alias("tile"), zone.alias("zone"), S.utm_epsg(F.col("lon") / 1_000_000, F.col("lat") * F.when(F.col("city") % 2 == 0, 1).otherwise(-1)).alias("epsg"))


@query("SELECT p_partkey AS id, replace(replace(replace(replace(p_name || ' <&\">', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped, (p_partkey % 256)::INTEGER AS red, (p_size % 256)::INTEGER AS green, printf('%.6f', p_retailprice) AS price FROM part")
def text_scalars(spark, d):
    colour = S.hex_colour(F.format_string("#%02x%02xff", F.col("p_partkey") % 256, F.col("p_size") % 256))
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.xml_escape(F.concat("p_name", F.lit(' <&">'))).alias("escaped"), colour[0].alias("red"), colour[1].alias("green"), F.format_string("%.6f", "p_retailprice").alias("price"))


@query()
def seeded_sample(spark, d):
    """5000 roads in a seeded order (a sampling operator)."""
    return X.seeded_sample(_roads(spark, d).select("way"), "way", 5000)


def _krueger_sql() -> str:
    """The projection of `city` as text; rounded to a millimetre."""
    east = " + ".join(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(crs.FORWARD, 1))
    north = " + ".join(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(crs.FORWARD, 1))
    e = repr(crs.ECCENTRICITY)
    return with_sql("city") + f""", z AS (SELECT city, lat / 1000000.0::DOUBLE AS lat, lon / 1000000.0::DOUBLE AS lon, (floor((lon / 1000000.0 + 180) / 6) + 1)::INTEGER AS zone FROM city),
    t AS (SELECT *, radians(lon - (zone * 6 - 183)) AS lam, sinh(atanh(sin(radians(lat))) - {e}::DOUBLE * atanh({e}::DOUBLE * sin(radians(lat)))) AS t FROM z),
    x AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
    SELECT city, zone, round({crs.FALSE_EAST!r} + {crs.ARC!r}::DOUBLE * (eta + {east}), 3) AS east, round({crs.ARC!r}::DOUBLE * (xi + {north}), 3) AS north, round(lat, 9) AS lat, round(lon, 9) AS lon FROM x"""


@query(_krueger_sql())
def project_utm(spark, d):
    """Cities in their zone's grid, and back again."""
    lat, lon = (F.col(c) / 1_000_000 for c in ("lat", "lon"))
    zone = S.utm_zone(lon)
    east, north = crs.to_utm(lat, lon, zone)
    x = fx.cities(spark, d).select("city", zone.alias("zone"), east.alias("east"), north.alias("north"))
    back = crs.from_utm(F.col("east"), F.col("north"), F.col("zone"), F.lit(False))
    return x.select("city", "zone", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"), F.round(back[0], 9).alias("lat"), F.round(back[1], 9).alias("lon"))


@query(with_sql("feat") + " SELECT seq::VARCHAR AS object, 12::BIGINT AS faces, ((xmax - xmin) * (ymax - ymin) * (3 + seq % 7))::DOUBLE AS volume, 0::BIGINT AS degenerate, 0::BIGINT AS open_edges FROM feat WHERE type = 'STANDARD'")
def extrude_footprint(spark, d):
    """Buildings as solids: faces, volume, and that each solid is closed."""
    corner = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ring = F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax"), corner("xmin", "ymin"))
    x = fx.features(spark, d).where(S.tag_filter(F.col("tags"), P.LAYERS["buildings"]))
    solids = mesh.extrude(x.select(F.col("seq").cast("string").alias("object"), ring.alias("ring"), F.lit(0.0).alias("low"), (3 + F.col("seq") % 7).cast("double").alias("high")))
    return mesh.report(*solids).withColumn("volume", F.round("volume", 6))


@query()
def simplify_dp(spark, d):
    """Ways with the points that lie farther than 5 from the simpler line."""
    w = assemble.ways(fx.nodes(spark, d)).withColumn("simple", simplify(F.col("points"), 5.0))
    return w.select("way", F.size("points").cast("long").alias("points"), F.size("simple").cast("long").alias("left"), F.round(G.line_length(F.col("simple")), 6).alias("length"))


def _edge_sums(edges: DataFrame) -> DataFrame:
    total = lambda c: F.round(F.sum(c), 4).alias(c)
    return edges.groupBy("way").agg(F.count(F.lit(1)).alias("points"), *(total(c) for c in ("lx", "ly", "rx", "ry")))


SUMS_SQL = "SELECT way, count(*) AS points, round(sum(x + 4 * ox), 4) AS lx, round(sum(y + 4 * oy), 4) AS ly, round(sum(x - 4 * ox), 4) AS rx, round(sum(y - 4 * oy), 4) AS ry FROM o GROUP BY way"


@query(with_sql("nodes") + f""", s AS (SELECT *, count(*) OVER (PARTITION BY way) AS n, (coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x))::DOUBLE AS dx, (coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y))::DOUBLE AS dy FROM nodes WINDOW w AS (PARTITION BY way ORDER BY pos)),
    u AS (SELECT *, CASE WHEN dx <> 0 OR dy <> 0 THEN -dy / sqrt(dx * dx + dy * dy) END AS ux, CASE WHEN dx <> 0 OR dy <> 0 THEN dx / sqrt(dx * dx + dy * dy) END AS uy FROM s WHERE n >= 2),
    o AS (SELECT way, x, y, coalesce(last_value(ux IGNORE NULLS) OVER w, 0) AS ox, coalesce(last_value(uy IGNORE NULLS) OVER w, 1) AS oy FROM u WINDOW w AS (PARTITION BY way ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    {SUMS_SQL}""")
def ribbon_central(spark, d):
    return _edge_sums(ribbon.central_edges(fx.nodes(spark, d), 4.0))


@query(with_sql("nodes") + f""", b AS (SELECT *, lag(x) OVER w AS bx, lag(y) OVER w AS ay FROM nodes WINDOW w AS (PARTITION BY way ORDER BY pos)),
    k AS (SELECT way, pos, x, y, lag(x) OVER w AS bx, lag(y) OVER w AS by_ FROM (SELECT * FROM b WHERE bx IS NULL OR x <> bx OR y <> ay) WINDOW w AS (PARTITION BY way ORDER BY pos)),
    v AS (SELECT *, -(y - by_) / sqrt(((x - bx) * (x - bx) + (y - by_) * (y - by_))::DOUBLE) AS px, (x - bx) / sqrt(((x - bx) * (x - bx) + (y - by_) * (y - by_))::DOUBLE) AS py FROM k),
    q AS (SELECT *, lead(px) OVER w AS qx, lead(py) OVER w AS qy FROM v WINDOW w AS (PARTITION BY way ORDER BY pos)),
    o AS (SELECT way, x, y, CASE WHEN px IS NULL THEN qx WHEN qx IS NULL OR px * qx + py * qy <= -0.5 THEN px ELSE (px + qx) / (1 + px * qx + py * qy) END AS ox,
                 CASE WHEN py IS NULL THEN qy WHEN qy IS NULL OR px * qx + py * qy <= -0.5 THEN py ELSE (py + qy) / (1 + px * qx + py * qy) END AS oy FROM q WHERE px IS NOT NULL OR qx IS NOT NULL)
    {SUMS_SQL}""")
def ribbon_mitred(spark, d):
    return _edge_sums(ribbon.mitred_edges(fx.nodes(spark, d), 4.0))


@query(with_sql("nodes") + " SELECT way::VARCHAR AS object, (8 * (count(*) - 1) + 4)::BIGINT AS faces, 0::BIGINT AS open_edges FROM nodes GROUP BY way HAVING count(*) >= 2")
def ribbon_box(spark, d):
    """Closed road solids: faces, and edges that are not shared by two faces."""
    return mesh.report(*ribbon.box(ribbon.central_edges(fx.nodes(spark, d), 4.0), 0.51, 0.4)).select("object", "faces", "open_edges")
