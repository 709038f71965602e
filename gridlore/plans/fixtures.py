"""Features derived from the star-schema tables by integer arithmetic: rectangles, ways, relations, cities and a raster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WINDOW = (100, 100, 800, 800)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle with tags for each part; every fourth repeats the id before it."""
    k = F.col("p_partkey")
    kind = F.col("p_type")
    tag = F.when(kind == "ECONOMY", F.array(F.lit("natural"), F.lit("water")))
    for value, key, word in (("LARGE", "waterway", "river"), ("MEDIUM", "landuse", "reservoir"), ("PROMO", "water", "pond"), ("SMALL", "landuse", "forest"), ("STANDARD", "building", "yes")):
        tag = tag.when(kind == value, F.array(F.lit(key), F.lit(word)))
    text = F.element_at(F.array(F.concat(F.col("p_size").cast("string"), F.lit(" m")), F.col("p_size").cast("string"), F.lit("10"), F.lit("10-12"), F.lit("-5"), F.lit("1.2.3"), F.lit(""), F.lit(None).cast("string")), (k % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        k.alias("seq"),
        F.when(k % 4 == 3, k - 1).otherwise(k).alias("osm_id"),
        kind.alias("type"),
        F.map_from_arrays(F.array(F.coalesce(tag[0], F.lit("kind"))), F.array(tag[1])).alias("tags"),
        F.when(k % 5 == 0, None).otherwise(F.col("p_name")).alias("name"),
        text.alias("height"),
        F.when(k % 3 == 0, None).otherwise((F.col("p_size") % 12).cast("string")).alias("levels"),
        (k * 37 % 997).alias("xmin"), (k * 61 % 991).alias("ymin"),
        (k * 37 % 997 + F.col("p_size")).alias("xmax"), (k * 61 % 991 + 1 + k % 23).alias("ymax"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way, pos, x, y: a vertex for each line item, in the order of line number, part and supplier."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    k = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        k.alias("way"), F.row_number().over(order).alias("pos"),
        (k * 53 % 997 + F.col("l_partkey") % 17).alias("x"), (k * 89 % 991 + F.col("l_suppkey") % 13).alias("y"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way, pos and both ends of each segment."""
    order = Window.partitionBy("way").orderBy("pos")
    n = nodes(spark, sf_dir)
    return n.select("way", "pos", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(order).alias("x2"), F.lead("y").over(order).alias("y2")).where("x2 IS NOT NULL")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, z of every embedding component; every 97th is missing."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v"))
    return e.select("row", F.col("col").cast("long").alias("col"), F.when((F.col("row") * 64 + F.col("col")) % 97 != 0, F.col("v").cast("double")).alias("z"))


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' places in micro-degrees."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("city"), (29_000_000 + k * 37_000 % 3_000_000).alias("lat"), (118_500_000 + k * 53_000 % 3_000_000).alias("lon"))


#: The same derivations as common table expressions.
SQL = {
    "feat": """feat AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 4 = 3 THEN p_partkey - 1 ELSE p_partkey END AS osm_id, p_type AS type,
        CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS name,
        CASE p_partkey % 8 WHEN 0 THEN p_size::VARCHAR || ' m' WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN '10' WHEN 3 THEN '10-12' WHEN 4 THEN '-5' WHEN 5 THEN '1.2.3' WHEN 6 THEN '' END AS height,
        CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_size % 12)::VARCHAR END AS levels,
        p_partkey * 37 % 997 AS xmin, p_partkey * 61 % 991 AS ymin, p_partkey * 37 % 997 + p_size AS xmax, p_partkey * 61 % 991 + 1 + p_partkey % 23 AS ymax FROM part)""",
    "nodes": """nodes AS (SELECT l_orderkey AS way, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos,
        l_orderkey * 53 % 997 + l_partkey % 17 AS x, l_orderkey * 89 % 991 + l_suppkey % 13 AS y FROM lineitem)""",
    "segs": """segs AS (SELECT * FROM (SELECT way, pos, x AS x1, y AS y1, lead(x) OVER (PARTITION BY way ORDER BY pos) AS x2, lead(y) OVER (PARTITION BY way ORDER BY pos) AS y2 FROM nodes) WHERE x2 IS NOT NULL)""",
    "grid": """grid AS (SELECT r AS row, c AS col, CASE WHEN (r * 64 + c) % 97 <> 0 THEN v::DOUBLE END AS z FROM (SELECT vec_id AS r, unnest(range(0, len(embedding))) AS c, unnest(embedding) AS v FROM embeddings))""",
    "city": """city AS (SELECT s_suppkey AS city, 29000000 + s_suppkey * 37000 % 3000000 AS lat, 118500000 + s_suppkey * 53000 % 3000000 AS lon FROM supplier)""",
}


def with_sql(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
