"""Readers: Overpass JSON, GeoJSON and HGT elevation tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.functions.geometry import signed_area

_ELEMENTS = "elements array<struct<type:string,id:long,lat:double,lon:double,nodes:array<long>,members:array<struct<type:string,ref:long,role:string>>,tags:map<string,string>>>"
_GEOJSON = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
VOID = -32768


def read_overpass(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (id, lat, lon, tags), ways (id, nodes, tags) and relations (id, members, tags) of Overpass documents."""
    e = spark.read.schema(_ELEMENTS).json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*")
    return (
        e.where("type = 'node'").select("id", "lat", "lon", "tags"),
        e.where("type = 'way'").select("id", "nodes", "tags"),
        e.where("type = 'relation'").select("id", "members", "tags"),
    )


def node_references(ways: DataFrame) -> DataFrame:
    """way, pos, node."""
    return ways.select(F.col("id").alias("way"), F.posexplode("nodes").alias("pos", "node"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """tags, kind and coordinates (as JSON) of a FeatureCollection's features; none of an empty one."""
    f = spark.read.schema(_GEOJSON).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return f.select(F.col("f.properties").alias("tags"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def feature_text(tags: str = "tags", kind: str = "kind", coordinates: str = "coordinates") -> F.Column:
    """A feature as GeoJSON text."""
    return F.concat(F.lit('{"type":"Feature","properties":'), F.coalesce(F.to_json(tags), F.lit("{}")), F.lit(',"geometry":{"type":"'), F.col(kind), F.lit('","coordinates":'), F.col(coordinates), F.lit("}}"))


def write_geojson(df: DataFrame, path: str) -> None:
    """A folder of FeatureCollections, one a partition (tags, kind, coordinates as JSON), which `read_geojson` reads."""
    import pyarrow as pa

    def collect(batches):
        first = True
        for batch in batches:
            for line in batch.column("value").to_pylist():
                yield pa.record_batch({"value": pa.array([('{"type":"FeatureCollection","features":[' if first else ",") + line])})
                first = False
        yield pa.record_batch({"value": pa.array(['{"type":"FeatureCollection","features":[]}' if first else "]}"])})

    df.select(feature_text().alias("value")).mapInArrow(collect, "value string").write.mode("overwrite").text(path)


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """tags, kind (polygon, line, point) and parts (flat coordinates; outer rings counter-clockwise, holes clockwise) of GeoJSON features; unknown types go."""
    f = read_geojson(spark, path)
    depth = {"Point": 0, "LineString": 1, "Polygon": 2, "MultiLineString": 2, "MultiPolygon": 3}
    out = None
    pair = lambda p: F.slice(p, F.lit(1), F.lit(2))
    line = lambda c: F.flatten(F.transform(c, pair))
    open_ring = lambda c: F.when((F.size(c) > 1) & (c[0] == F.element_at(c, -1)), F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(c)

    def turned(ring, i):
        flat = line(open_ring(ring))
        points = F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
        left = signed_area(points) >= 0
        return F.when(left == (i == 0), flat).otherwise(line(F.reverse(open_ring(ring))))

    for kind, d in depth.items():
        c = F.from_json("coordinates", "array<" * (d + 1) + "double" + ">" * (d + 1))
        parts = {
            "Point": F.array(pair(c)), "LineString": F.array(line(c)), "MultiLineString": F.transform(c, line),
            "Polygon": F.transform(c, turned), "MultiPolygon": F.flatten(F.transform(c, lambda p: F.transform(p, turned))),
        }[kind]
        name = "polygon" if "Polygon" in kind else "line" if "Line" in kind else "point"
        one = f.where(F.col("kind") == kind).select("tags", F.lit(name).alias("kind"), parts.alias("parts"))
        out = one if out is None else out.unionByName(one)
    return out


def read_hgt(spark: SparkSession, path: str) -> DataFrame:
    """lat, lon, row (0 = south), col, z of square big-endian tiles; voids are null. Samples are decoded row by row in batches."""
    import numpy as np
    import pyarrow as pa

    def work(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                file = name.rsplit("/", 1)[-1]
                lat = int(file[1:3]) * (1 if file[0] in "Nn" else -1)
                lon = int(file[4:7]) * (1 if file[3] in "Ee" else -1)
                z = np.frombuffer(content, ">i2")
                side = int(round(len(z) ** 0.5))
                if side * side != len(z):
                    raise ValueError(f"{file} is not square")
                z = z.reshape(side, side)[::-1]
                for at in range(0, side, 256):
                    part = z[at : at + 256].astype(np.float64).ravel()
                    n = len(part)
                    yield pa.record_batch({
                        "lat": pa.array(np.full(n, lat), pa.int32()), "lon": pa.array(np.full(n, lon), pa.int32()),
                        "row": pa.array(at + np.arange(n) // side, pa.int32()), "col": pa.array(np.arange(n) % side, pa.int32()),
                        "z": pa.array(part, pa.float64(), mask=part == VOID),
                    })

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, "lat int, lon int, row int, col int, z double")
