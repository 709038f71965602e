"""Queries over scans: elements to features, tag expressions, files, caches and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.functions import scalars as S
from gridlore.operators import scan
from gridlore.plans import fixtures as fx
from gridlore.plans.fixtures import with_sql
from gridlore.plans.queries import _roads
from gridlore.plans.registry import query
from gridlore.plans.shapes import INSIDE_SQL, WIN, _length
from gridlore.sources import elevation


def elements(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, ways and relations out of the line items, orders and customers; coordinates are the fixtures' plane."""
    n = fx.nodes(spark, d).withColumn("id", F.col("way") * 100 + F.col("pos"))
    nodes = n.select("id", F.col("y").cast("double").alias("lat"), F.col("x").cast("double").alias("lon"), F.lit(None).cast("map<string,string>").alias("tags"))
    refs = n.groupBy("way").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda p: p["id"]).alias("nodes"))
    ways = _roads(spark, d).join(refs, "way").select(F.col("way").alias("id"), "nodes", F.create_map(F.lit("highway"), F.col("highway")).alias("tags"))
    relations = spark.createDataFrame([], "id long, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>")
    return nodes, ways, relations


@query(with_sql("nodes", "segs") + INSIDE_SQL + " SELECT way AS osm_id, round(inside, 5) AS length FROM i WHERE inside > 0.000001 AND way IN (SELECT way FROM nodes WHERE x BETWEEN 100.5 AND 800.5 AND y BETWEEN 100.5 AND 800.5) AND way NOT IN (SELECT way FROM nodes n GROUP BY way HAVING count(*) >= 4 AND arg_min(x, pos) = arg_max(x, pos) AND arg_min(y, pos) = arg_max(y, pos))")
def scan_roads(spark, d):
    """The road layer's scan: ways with a node in the window, assembled, filtered by tags and kind, and cut to it."""
    x = scan.fetch(elements(spark, d), "roads", (WIN[1], WIN[0], WIN[3], WIN[2]))
    return x.select("osm_id", F.round(_length(F.col("parts")), 5).alias("length")).where("length > 0.000001")


@query(with_sql("feat") + " SELECT CASE type WHEN 'ECONOMY' THEN 'natural=water' WHEN 'PROMO' THEN 'water=pond' WHEN 'LARGE' THEN 'waterway=river' WHEN 'MEDIUM' THEN 'landuse=reservoir' END AS label, CASE type WHEN 'LARGE' THEN 'waterway' WHEN 'ECONOMY' THEN 'natural' END AS category, count(*) AS n FROM feat GROUP BY 1, 2")
def water_labels(spark, d):
    """What makes a feature water, and the category it is shown in."""
    tags = F.col("tags")
    return fx.features(spark, d).select(scan.water_label(tags).alias("label"), scan.water_category(tags).alias("category")).groupBy("label", "category").agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("feat") + " SELECT type, (type IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO')) AS water, false AS roads, type = 'STANDARD' AS buildings, type = 'SMALL' AS vegetation, count(*) AS n FROM feat GROUP BY type")
def tag_expressions(spark, d):
    """Features by the layers' expressions, compiled to tag rules."""
    tags = F.col("tags")
    rules = {k: S.tag_filter(tags, scan.compile_expression(v)[0]) for k, v in scan.EXPRESSIONS.items()}
    return fx.features(spark, d).select("type", *(r.alias(k) for k, r in rules.items())).groupBy("type", *rules).agg(F.count(F.lit(1)).alias("n"))


@query(with_sql("nodes") + ", e AS (SELECT way % 50 AS file, min(y)::DOUBLE AS south, min(x)::DOUBLE AS west, max(y)::DOUBLE AS north, max(x)::DOUBLE AS east FROM nodes GROUP BY 1) SELECT * FROM e WHERE south < 500 AND north > 400 AND west < 300 AND east > 200")
def file_prefilter(spark, d):
    """Extents of files by their nodes, and those that overlap a window."""
    n = fx.nodes(spark, d).select((F.col("way") % 50).alias("file"), F.col("y").cast("double").alias("lat"), F.col("x").cast("double").alias("lon"))
    return scan.files_for(scan.file_extents(n), (400, 200, 500, 300))


@query(with_sql("city") + " SELECT DISTINCT 'root/city/' || (city % 7) || '.json' AS path FROM city WHERE abs(lat - 30000000) <= 1000000 AND abs(lon - 120000000) <= 1000000")
def city_files(spark, d):
    """The different cache files of the cities around a window."""
    index = fx.cities(spark, d).select((F.col("lat") / 1_000_000).alias("lat"), (F.col("lon") / 1_000_000).alias("lon"), F.array(F.concat(F.lit("city\\"), (F.col("city") % 7).cast("string"), F.lit(".json"))).alias("files"))
    return scan.city_files(index, (29.5, 119.5, 30.5, 120.5), root="root/")


@query(with_sql("city") + ", w AS (SELECT city AS id, lat / 1000000.0::DOUBLE AS s, lon / 1000000.0::DOUBLE AS w FROM city) SELECT id, lat, lon, printf('N%02d', lat) || printf('E%03d', lon) || '.hgt' AS name FROM (SELECT id, lat, unnest(range(floor(w)::BIGINT, floor(w + 1.2)::BIGINT + 1)) AS lon FROM (SELECT *, unnest(range(floor(s)::BIGINT, floor(s + 0.7)::BIGINT + 1)) AS lat FROM w))")
def elevation_tiles(spark, d):
    """The one-degree tiles of windows."""
    lat, lon = (F.col(c) / 1_000_000 for c in ("lat", "lon"))
    return elevation.tiles_of(fx.cities(spark, d).select(F.col("city").alias("id"), lat.alias("south"), lon.alias("west"), (lat + 0.7).alias("north"), (lon + 1.2).alias("east")))


@query(with_sql("city") + " SELECT city, printf('dem_%.4f_%.4f_%.4f_%.4f_%d.npy', lat / 1000000.0::DOUBLE, lon / 1000000.0::DOUBLE, lat / 1000000.0::DOUBLE + 0.25, lon / 1000000.0::DOUBLE + 0.5, 256) AS key FROM city")
def elevation_cache_key(spark, d):
    lat, lon = (F.col(c) / 1_000_000 for c in ("lat", "lon"))
    return fx.cities(spark, d).select("city", elevation.cache_key(lat, lon, lat + 0.25, lon + 0.5, F.lit(256)).alias("key"))


@query(with_sql("grid") + """, a AS (SELECT row // 16 AS id, row, col, CASE WHEN (row // 16) % 3 = 0 OR col % 5 <> 0 THEN z END AS z0, CASE WHEN (row // 16) % 3 <> 1 THEN z * 2 END AS z1, z * 3 AS z2 FROM grid),
    f AS (SELECT *, CASE WHEN id % 4 = 1 THEN NULL ELSE z0 END AS y0 FROM a), k AS (SELECT id, avg((y0 IS NOT NULL)::INT) AS k0, avg((z1 IS NOT NULL)::INT) AS k1 FROM f GROUP BY id)
    SELECT id, row, col, CASE WHEN k0 > 0.5 THEN coalesce(y0, z1, z2) WHEN k1 > 0.5 THEN coalesce(z1, z2, y0) ELSE coalesce(z2, y0, z1) END AS z FROM f JOIN k USING (id)""")
def elevation_assembly(spark, d):
    """Grids from the first source that knows over half of their points, with the others after it."""
    g = fx.raster(spark, d).select(F.floor(F.col("row") / 16).alias("id"), "row", "col", "z")
    i = F.col("id")
    first = g.withColumn("z", F.when(((i % 3 == 0) | (F.col("col") % 5 != 0)) & (i % 4 != 1), F.col("z")))
    return elevation.assembled(first, g.withColumn("z", F.when(i % 3 != 1, F.col("z") * 2)), g.withColumn("z", F.col("z") * 3))
