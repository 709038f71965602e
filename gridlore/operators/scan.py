"""Scans of map data: tag expressions, layers with their steps, relations, city caches and tile caches.

A feature is (osm_type, osm_id, tags, kind, parts): kind is polygon or line, parts are its rings or lines as flat coordinates (see
`shapes`). Elements come as three tables: nodes (id, lat, lon, tags), ways (id, nodes, tags) and relations (id, members, tags), as
`sources.osm.read_overpass` gives them.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore import profiles as P
from gridlore.functions import scalars as S
from gridlore.functions.geometry import counter_clockwise
from gridlore.operators import features as X
from gridlore.operators import shapes, tiles

# The layers' tag expressions of the command-line scan; of water only relations are asked for.
EXPRESSIONS = {
    "water": "r/natural=water r/water r/waterway r/landuse=reservoir",
    "roads": "nwr/highway",
    "buildings": "nwr/building",
    "vegetation": "nwr/landuse=forest,grass,meadow nwr/natural=wood,grassland,scrub",
}
#: Layers whose relations are put together before anything is cut to the window.
RELATIONS_FIRST = ("water",)
#: A road is shown from so many metres on.
ROAD_LEAST_M = 2.0
FEATURE = "osm_type string, osm_id long, tags map<string,string>, kind string, parts array<array<double>>"


def compile_expression(text: str) -> tuple[dict, set[str]]:
    """The tag rule and the element types of a space-separated expression: types before a slash (n, w, r; none means any), then a key, or
    a key = values parted by commas. Terms are joined by or; every term of an expression has the same types."""
    rule: dict = {}
    kinds: set[str] = set()
    names = {"n": "node", "w": "way", "r": "relation"}
    for term in text.split():
        types, _, tag = term.rpartition("/")
        kinds |= {names[c] for c in types or "nwr" if c in names}
        key, equals, values = tag.partition("=")
        if not equals:
            rule[key] = True
        elif rule.get(key) is not True:
            rule[key] = tuple(dict.fromkeys((*rule.get(key, ()), *values.split(","))))
    return rule, kinds


def water_label(tags: Column) -> Column:
    """What makes a feature water, the first that holds; null if nothing does."""
    has = lambda k: F.map_contains_key(tags, F.lit(k))
    return (
        F.when(tags["natural"] == "water", F.concat(F.lit("natural="), tags["natural"]))
        .when(has("water"), F.concat(F.lit("water="), tags["water"]))
        .when(has("waterway"), F.concat(F.lit("waterway="), tags["waterway"]))
        .when(tags["landuse"] == "reservoir", F.lit("landuse=reservoir"))
    )


def water_category(tags: Column) -> Column:
    """river, lake, waterway or natural: which part of the water a feature is shown in."""
    return F.when(tags["water"] == "river", "river").when(tags["water"] == "lake", "lake").when(tags["waterway"] == "river", "waterway").when(tags["natural"] == "water", "natural")


def way_shapes(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, tags, kind and parts of ways: points in order, unknown nodes left out; four points or more that close are a polygon, turned counter-clockwise; a way of one point goes."""
    at = nodes.select(F.col("id").alias("node"), "lon", "lat")
    placed = ways.select("id", F.posexplode("nodes").alias("pos", "node")).join(at, "node").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("p"))
    closed = (F.size("p") >= 4) & (F.col("p")[0]["x"] == F.element_at("p", -1)["x"]) & (F.col("p")[0]["y"] == F.element_at("p", -1)["y"])
    out = placed.where(F.size("p") >= 2).withColumn("closed", closed)
    points = F.transform("p", lambda q: F.struct(q["x"], q["y"]))
    ring, line = shapes.flat_ring(counter_clockwise(points)), shapes.flat_line(points)
    kind = F.when(F.col("closed"), "polygon").otherwise("line")
    return ways.select("id", "tags").join(out.select("id", kind.alias("kind"), F.array(F.when(F.col("closed"), ring).otherwise(line)).alias("parts")), "id")


def relation_shapes(relations: DataFrame, way_shapes_: DataFrame) -> DataFrame:
    """id, tags, kind and parts of multipolygon relations: closed member ways only; any role but inner is outer; an inner ring is a hole of the outer ring that contains it, and goes if none does."""
    import pyarrow as pa

    from gridlore.functions import plane

    members = relations.where(F.col("tags")["type"] == "multipolygon").select("id", F.explode("members").alias("m")).where("m.type = 'way'")
    rings = way_shapes_.where("kind = 'polygon'").select(F.col("id").alias("way"), F.col("parts")[0].alias("ring"))
    held = members.select("id", F.col("m.ref").alias("way"), (F.coalesce("m.role", F.lit("")) == "inner").alias("inner")).join(rings, "way")

    def whole(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("way").to_pylist(), table.column("inner").to_pylist(), table.column("ring").to_pylist(), strict=True), key=lambda r: r[:2])
        turned = lambda r, left: r if (plane.ring_area(r) > 0) == left else r[::-1]
        outer = [turned(plane.as_ring(r), True) for _, inner, r in rows if not inner]
        holes = [turned(plane.as_ring(r), False) for _, inner, r in rows if inner]
        kept = [h for h in holes if any(plane.contains([o], *plane._inner_point(h))[0] for o in outer)]
        some = slice(0, 1 if outer else 0)
        return pa.table({"id": table.column("id")[some], "parts": pa.array([shapes.to_lists([*outer, *kept])][some], pa.list_(pa.list_(pa.float64())))})

    found = held.groupBy("id").applyInArrow(whole, f"id long, parts {shapes.REGION}")
    return relations.select("id", "tags").join(found, "id").select("id", "tags", F.lit("polygon").alias("kind"), "parts")


def assemble(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """All elements as features, ways and relations."""
    w = way_shapes(ways, nodes)
    r = relation_shapes(relations, w)
    one = lambda df, kind: df.select(F.lit(kind).alias("osm_type"), F.col("id").alias("osm_id"), "tags", "kind", "parts")
    return one(w, "way").unionByName(one(r, "relation"))


def nodes_near(nodes: DataFrame, ways: DataFrame, window: tuple) -> DataFrame:
    """The ways that have a node in the window (south, west, north, east), whole."""
    s, w, n, e = window
    inside = nodes.where(F.col("lat").between(s, n) & F.col("lon").between(w, e)).select(F.col("id").alias("node"))
    hit = ways.select("id", F.explode("nodes").alias("node")).join(inside, "node", "left_semi").select("id").distinct()
    return ways.join(hit, "id", "left_semi")


@dataclass
class Layer:
    """A layer's scan in steps: raw, filtered, clipped, final. Each is a table that the next one reads; `extra` is a filter of the caller's own."""

    name: str
    window: tuple
    extra: Callable[[DataFrame], DataFrame] | None = None
    relations_only: bool = False
    steps: dict[str, DataFrame] = field(default_factory=dict)

    def run(self, elements: tuple[DataFrame, DataFrame, DataFrame], export: str | None = None, stop_early: bool = False) -> DataFrame:
        """The layer's features in the window. export: a folder that gets each step as a table. stop_early: an empty step ends the scan (a job a step), as its result would be empty anyway."""
        nodes, ways, relations = elements
        rule = P.LAYERS[self.name]
        s, w, n, e = self.window
        if self.name in RELATIONS_FIRST or self.relations_only:
            raw = assemble(nodes, ways, relations)  # whole relations, before anything is cut
        else:
            raw = assemble(nodes, nodes_near(nodes, ways, self.window), relations)
        if self.relations_only:
            raw = raw.where("osm_type = 'relation'")
        filtered = lambda df: (self.extra or (lambda x: x))(df.where(S.tag_filter(F.col("tags"), rule) & F.col("kind").isin(*P.KINDS[self.name])))
        clipped = lambda df: shapes.clip_to_box(df, (w, s, e, n))
        final = lambda df: X.dedupe_first(df.withColumn("seq", F.struct("osm_type", "osm_id")).withColumn("key", F.concat_ws("/", "osm_type", F.col("osm_id").cast("string"))), "key", "seq").drop("key", "seq")
        df = raw
        for name, step in (("raw", lambda x: x), ("filtered", filtered), ("clipped", clipped), ("final", final)):
            df = self.steps[name] = step(df)
            if export:
                path = f"{export}/{self.name}/{name}"
                df.write.mode("overwrite").parquet(path)
                df = self.steps[name] = df.sparkSession.read.parquet(path)
            if stop_early and df.isEmpty():
                return df
        return df


def fetch(elements, name: str, window: tuple, **options) -> DataFrame:
    return Layer(name, window, **options).run(elements)


def _local(geometry: str, scale_x: Column | float, scale_y: float) -> Column:
    """Degrees as metres on a plane that touches the window's middle."""
    return F.transform(geometry, lambda r: F.transform(r, lambda v, i: F.when(i % 2 == 0, v * scale_x).otherwise(v * scale_y)))


#: Metres of a degree of latitude.
DEGREE_M = 111_320.0


def metres(df: DataFrame, window: tuple) -> DataFrame:
    """df with area_m2 and length_m of its parts, measured on a plane of the window's middle latitude."""
    import math

    s, _, n, _ = window
    flat = _local("parts", DEGREE_M * math.cos(math.radians((s + n) / 2)), DEGREE_M)
    length = F.aggregate(F.transform(F.col("_m"), lambda r: F.aggregate(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.size(r) / 2 - 2).cast("int"))), lambda i: F.coalesce(F.hypot(F.get(r, 2 * i + 2) - F.get(r, 2 * i), F.get(r, 2 * i + 3) - F.get(r, 2 * i + 1)), F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)), F.lit(0.0), lambda a, v: a + v)
    x = df.withColumn("_m", flat)
    return x.withColumns({"area_m2": F.when(F.col("kind") == "polygon", F.abs(shapes.region_area(F.col("_m")))).otherwise(0.0), "length_m": F.when(F.col("kind") == "line", length).otherwise(0.0)}).drop("_m")


def highway_in(tags: Column, wanted: tuple | None) -> Column:
    """Whether any of a road's values is wanted; all pass without a list."""
    return F.lit(True) if not wanted else F.coalesce(F.arrays_overlap(F.split(tags["highway"], ";"), F.array(*map(F.lit, wanted))), F.lit(False))


def fetch_buildings(elements, window: tuple, least_m2: float = 0.0) -> DataFrame:
    x = metres(fetch(elements, "buildings", window), window).where(F.col("area_m2") >= least_m2)
    return x.withColumn("est_height", S.building_height(F.col("tags")["height"], F.col("tags")["building:levels"]))


def fetch_roads(elements, window: tuple, wanted: tuple | None = None) -> DataFrame:
    x = fetch(elements, "roads", window).where(highway_in(F.col("tags"), wanted))
    return metres(x, window).where(F.col("length_m") >= ROAD_LEAST_M)


def fetch_water(elements, window: tuple, least_m2: float = 0.0, relations_only: bool = False) -> DataFrame:
    """Polygons of the least area first, the largest first, then all lines by length."""
    x = metres(fetch(elements, "water", window, relations_only=relations_only), window)
    x = x.where((F.col("kind") == "line") | (F.col("area_m2") >= least_m2))
    return x.orderBy(F.desc("kind"), F.desc(F.greatest("area_m2", "length_m")), "osm_type", "osm_id")


def fetch_vegetation(elements, window: tuple) -> DataFrame:
    return metres(fetch(elements, "vegetation", window), window)


def file_extents(nodes: DataFrame) -> DataFrame:
    """file and the extent of its nodes (south, west, north, east), of nodes (file, lat, lon)."""
    return nodes.groupBy("file").agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))


def files_for(extents: DataFrame, window: tuple) -> DataFrame:
    """The files whose extent overlaps the window; touching it is not enough."""
    s, w, n, e = window
    return extents.where((F.col("south") < n) & (F.col("north") > s) & (F.col("west") < e) & (F.col("east") > w))


def read_city_index(spark: SparkSession, path: str) -> DataFrame:
    """key, lat, lon and files of a city index ({"name|lat|lon": {"lat", "lon", "cache_files": {"osm": [...]}}}); a missing index is empty, and keys without a place are skipped."""
    kind = "map<string,struct<lat:double,lon:double,cache_files:struct<osm:array<string>>>>"
    if "://" not in path and not os.path.exists(path):
        text = spark.createDataFrame([], "value string")
    else:
        text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", kind)).alias("key", "v"))
    parts = F.split("key", r"\|")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    out = entries.select("key", F.coalesce("v.lat", number(1)).alias("lat"), F.coalesce("v.lon", number(2)).alias("lon"), F.coalesce("v.cache_files.osm", F.array().cast("array<string>")).alias("files"))
    return out.where("lat IS NOT NULL AND lon IS NOT NULL")


def city_files(index: DataFrame, window: tuple, reach: float = 1.0, root: str = "") -> DataFrame:
    """The different files of the cities within a degree of the window's middle, as paths under the root."""
    s, w, n, e = window
    near = index.where((F.abs(F.col("lat") - (s + n) / 2) <= reach) & (F.abs(F.col("lon") - (w + e) / 2) <= reach))
    path = F.replace("file", F.lit("\\"), F.lit("/"))
    return near.select(F.explode("files").alias("file")).select(F.concat(F.lit(root), path).alias("path")).distinct()


def tile_of(df: DataFrame, tile: int = tiles.TILE) -> DataFrame:
    """df once for each tile (ty, tx) that a feature's bounds reach into; coordinates are degrees."""
    b = shapes.bounds(F.col("parts"))
    micro = lambda c, up: (F.ceil(c * 1_000_000) if up else F.floor(c * 1_000_000)).cast("long")
    boxes = df.withColumns({"lat0": micro(b["y0"], False), "lat1": micro(b["y1"], True), "lon0": micro(b["x0"], False), "lon1": micro(b["x1"], True)})
    return tiles.cover(boxes, tile).drop("lat0", "lat1", "lon0", "lon1")


def save_tiles(df: DataFrame, path: str, layer: str) -> None:
    """Unfiltered features as Parquet, a folder a layer and tile; tiles written again are replaced, empty tables write nothing."""
    out = tile_of(df).withColumn("layer", F.lit(layer))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer", "ty", "tx").parquet(path)


def cached_tiles(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """ty, tx of a layer's cached tiles; none if nothing was written."""
    try:
        return spark.read.parquet(path).where(F.col("layer") == layer).select(F.col("ty").cast("long").alias("ty"), F.col("tx").cast("long").alias("tx")).distinct()
    except Exception:  # noqa: BLE001  an unreadable cache is an empty one
        return spark.createDataFrame([], "ty long, tx long")


def read_tiles(spark: SparkSession, path: str, layer: str, window: tuple) -> DataFrame | None:
    """The layer's features from the cache, one an element, cut to the window; None unless every tile of the window is there."""
    s, w, n, e = (int(round(v * 1_000_000)) for v in window)
    box = spark.createDataFrame([(s, n, w, e)], "lat0 long, lat1 long, lon0 long, lon1 long")
    wanted = tiles.cover(box).select("ty", "tx")
    if not tiles.hits_and_misses(wanted, cached_tiles(spark, path, layer)).where("NOT hit").isEmpty():
        return None
    df = spark.read.parquet(path).where(F.col("layer") == layer).join(F.broadcast(wanted), ["ty", "tx"], "left_semi")
    df = df.drop("ty", "tx", "layer").dropDuplicates(["osm_type", "osm_id"])
    return shapes.clip_to_box(df, (window[1], window[0], window[3], window[2]))


def purge(spark: SparkSession, folder: str, ttl_seconds: float, now: float) -> list[str]:
    """Remove the cache files of a local folder that have outlived their time; the removed paths, sorted. Negative: none ever, zero: all."""
    gone = []
    for base, _, names in os.walk(folder):
        for name in names:
            path = os.path.join(base, name)
            if not (ttl_seconds < 0) and (ttl_seconds == 0 or now - os.path.getmtime(path) >= ttl_seconds):
                os.remove(path)
                gone.append(path)
    return sorted(gone)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and modified of a folder's files, by path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", "length", F.col("modificationTime").alias("modified")).orderBy("path")
