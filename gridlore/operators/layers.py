"""The model's layers: features in metres become solids in millimetres, as mesh tables (see `mesh`).

Features come as tables with a region (rings) or a line as rows (way, pos, x, y); the ground comes as a raster in long form
(row, col, z) whose vertex (row, col) lies at (col, row) times `step`. Scale is millimetres a metre. A feature that
is null or empty, or lies off the known ground, is left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore import profiles as P
from gridlore.functions import plane
from gridlore.functions import scalars as S
from gridlore.operators import raster, ribbon, shapes, spatial
from gridlore.operators.tables import settled


def sampled(points: DataFrame, ground: DataFrame, step: float = 1.0) -> DataFrame:
    """id and z: the highest of the eight nearest ground vertices of each point (id, x, y)."""
    return spatial.nearest_max(points.select("id", (F.col("x") / step).alias("px"), (F.col("y") / step).alias("py")), ground)


def polygons_of(regions: DataFrame, least: float | Column) -> DataFrame:
    """A row for each polygon (id, part, rings, area and the other columns) of at least that area, of regions with an id."""
    flat = spatial.dealt(regions.where("rings IS NOT NULL"), "id").select("*", F.posexplode(shapes.polygons("rings")).alias("part", "polygon"))
    flat = flat.drop("rings").withColumnRenamed("polygon", "rings")
    return flat.withColumn("area", shapes.region_area(F.col("rings"))).where(F.col("area") >= least)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def largest_part(rings: pd.Series) -> pd.Series:
    """The polygon of the largest area of a region."""
    return shapes._each(lambda x: shapes.to_lists(max(plane.parts(shapes.to_rings(x)), key=plane.area, default=[])), rings)


def footprints(buildings: DataFrame, km2: float) -> DataFrame:
    """id, part, rings, area and est_height of the buildings (id, rings, est_height) that an area of that size shows, simplified;
    of one that falls apart the largest part stays, and those under a square metre go."""
    kind = 0 if km2 < P.SMALL_KM2 else 1 if km2 < P.MEDIUM_KM2 else 2
    x = polygons_of(buildings.select("id", "rings", "est_height"), P.STYLE.building_min_area_m2[kind])
    x = x.withColumn("rings", shapes.simplify_region(F.col("rings"), P.BUILDING_TOLERANCE_M, largest=True))
    return x.withColumn("area", shapes.region_area(F.col("rings"))).where("area >= 1").select("id", "part", "rings", "area", "est_height")


def _scaled(rings: Column, scale: float) -> Column:
    return F.transform(rings, lambda r: F.transform(r, lambda v: v * scale))


def _on_ground(df: DataFrame, ground: DataFrame, step: float) -> DataFrame:
    """The rows (object, rings and more) with the ground's height (tz) at the region's centroid; those without any go."""
    x = settled(shapes.with_centroids(df))
    z = sampled(x.select(F.col("object").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y")), ground, step)
    return x.join(z.select(F.col("id").alias("object"), F.col("z").alias("tz")), "object").where("tz IS NOT NULL").drop("cx", "cy")


def _name(*columns: str) -> Column:
    return F.concat_ws(":", *(F.col(c).cast("string") for c in columns)).alias("object")


def buildings(features: DataFrame, ground: DataFrame, km2: float, scale: float, step: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of the building solids (object = id:part), their feet sunk into the ground."""
    x = _on_ground(footprints(features, km2).select(_name("id", "part"), "rings", "area", "est_height"), ground, step)
    tall = S.model_height(F.coalesce("est_height", F.lit(0.0)), F.col("area"))
    low = F.col("tz") - P.BUILDING_EMBED_MM
    return shapes.prisms(x.select("object", _scaled(F.col("rings"), scale).alias("rings"), low.alias("low"), (low + tall).alias("high")))


def shown_roads(roads: DataFrame, km2: float) -> DataFrame:
    """way, half (metres of half its shown width) of the roads (way, highway) that an area of that size shows; a list counts by its first value, none is residential."""
    kind = F.coalesce(F.element_at(F.split("highway", ";"), 1), F.lit("residential"))
    x = roads.withColumn("kind", kind)
    if km2 >= P.MEDIUM_KM2:
        x = x.where(F.col("kind").isin(*P.MAIN_ROADS))
    return x.select("way", (S.road_width(F.col("kind")) / 2).alias("half"))


def densified(points: DataFrame, step: float) -> DataFrame:
    """way, pos, x, y with equal parts of at most `step` on every segment."""
    order = Window.partitionBy("way").orderBy("pos")
    x = points.withColumns({"nx": F.lead("x").over(order), "ny": F.lead("y").over(order)})
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    n = F.greatest(F.lit(1), F.coalesce(F.ceil(F.sqrt((dx * dx + dy * dy).cast("double")) / step), F.lit(1))).cast("int")
    x = x.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda c: (F.col(c) + F.coalesce(F.col(f"n{c}") - F.col(c), F.lit(0)) * F.col("k") / F.col("n")).cast("double").alias(c)
    return x.select("way", F.row_number().over(Window.partitionBy("way").orderBy("pos", "k")).alias("pos"), at("x"), at("y"))


def roads(features: DataFrame, points: DataFrame, ground: DataFrame, km2: float, scale: float, step: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of closed road ribbons (object = way) over the ground: features has way and highway, points way, pos, x, y."""
    order = Window.partitionBy("way").orderBy("pos")
    gap = lambda c: F.col(c) - F.lag(c).over(order)
    length = points.withColumn("d", F.sqrt((gap("x") * gap("x") + gap("y") * gap("y")).cast("double"))).groupBy("way").agg(F.sum("d").alias("length"))
    kept = shown_roads(features, km2).join(length.where(F.col("length") >= P.ROAD_LEAST_M), "way")
    kept = settled(kept)
    dense = settled(densified(points.join(kept.select("way"), "way", "left_semi"), P.ROAD_STEP_M))
    z = sampled(dense.select(F.struct("way", "pos").alias("id"), "x", "y"), ground, step).select("id.way", "id.pos", F.col("z").alias("tz"))
    edges = ribbon.central_edges(dense, 1.0).join(kept.select("way", "half"), "way")
    # The edges lie one metre off; each is moved out to the road's own half width.
    middle = lambda c: (F.col(f"l{c}") + F.col(f"r{c}")) / 2
    out = lambda s, c: ((middle(c) + (F.col(f"{s}{c}") - middle(c)) * F.col("half")) * scale).alias(f"{s}{c}")
    edges = edges.select("way", "pos", *(out(s, c) for s in "lr" for c in "xy")).join(z, ["way", "pos"], "left")
    whole = edges.groupBy("way").agg(F.count_if(F.col("tz").isNull()).alias("n")).where("n = 0").select("way")
    # Vertices and faces are read from one table of edges.
    edges = settled(edges.join(whole, "way", "left_semi").select("way", "pos", "lx", "ly", "rx", "ry", F.col("tz").alias("z")))
    return ribbon.box(edges, P.ROAD_ABOVE_MM, P.ROAD_THICK_MM)


def water_regions(features: DataFrame, round_ends: bool, least: float = P.STYLE.min_water_area_m2, shortest: float = P.WATER_LINE_LEAST_M) -> tuple[DataFrame, DataFrame]:
    """Lines and polygons as regions (id, part, rings, area) of at least that area; features has id, kind, parts, waterway and width.

    Lines are buffered by half their width; with flat ends, those under the shortest length, ten metres, are left out before."""
    wide = S.line_width(F.col("width"), F.coalesce("waterway", F.lit("river")), P.WATERWAY_WIDTHS)
    lines = features.where("kind = 'line'").select("id", (wide / 2).alias("half"), F.posexplode("parts").alias("part", "line"))
    if not round_ends:
        length = F.aggregate(F.transform(F.sequence(F.lit(0), (F.size("line") / 2 - 2).cast("int")), lambda i: F.sqrt(F.pow(F.element_at("line", (2 * i + 3).cast("int")) - F.element_at("line", (2 * i + 1).cast("int")), F.lit(2)) + F.pow(F.element_at("line", (2 * i + 4).cast("int")) - F.element_at("line", (2 * i + 2).cast("int")), F.lit(2)))), F.lit(0.0), lambda a, v: a + v)
        lines = lines.where(F.size("line") >= 4).where(length >= shortest)
    buffer = shapes.buffer_round if round_ends else shapes.buffer_flat
    lines = lines.select("id", "part", buffer("line", "half").alias("rings")).withColumn("area", shapes.region_area(F.col("rings")))
    polygons = polygons_of(features.where("kind = 'polygon'").select("id", F.col("parts").alias("rings")), least).select("id", "part", "rings", "area")
    return lines.where(F.col("area") >= least), polygons


def _keyed(df: DataFrame) -> DataFrame:
    return df.select(_name("id", "part").alias("id"), "rings")


def water_plate(features: DataFrame, least: float = P.STYLE.min_water_area_m2, cell: float = 1000.0) -> DataFrame:
    """object, rings, low and high (metres) of the water relief, polygons first in rank: a polygon that the lines together cover
    by over 0.3 is dominant, and a buffered line that any dominant polygon covers by over 0.3 goes. Flat ends."""
    lines, polygons = water_regions(features, False, least)
    lines, polygons = settled(_keyed(lines)), settled(_keyed(polygons))
    dominant = settled(polygons.join(shapes.covered_shares(polygons, lines, cell).where(F.col("share") > P.OVERLAP).select("id"), "id", "left_semi"))
    kept = shapes.without_dominated(lines, dominant, P.OVERLAP)
    both = polygons.select(F.lit("polygon").alias("kind"), "id", "rings").unionAll(kept.select(F.lit("line").alias("kind"), "id", "rings"))
    return both.select(F.concat_ws(":", "kind", "id").alias("object"), "rings", F.lit(0.0).alias("low"), F.lit(P.WATER_HEIGHT_M).alias("high"))


def water_columns(features: DataFrame, least: float = P.STYLE.min_water_area_m2, cell: float = 1000.0) -> DataFrame:
    """object and rings of the water that is cut from the terrain, lines first in rank: a polygon that the lines together cover by over 0.3 goes. Round ends."""
    lines, polygons = water_regions(features, True, least)
    kept = shapes.without_covered(_keyed(polygons), _keyed(lines), cell, P.OVERLAP)
    both = _keyed(lines).select(F.lit("line").alias("kind"), "id", "rings").unionAll(kept.select(F.lit("polygon").alias("kind"), "id", "rings"))
    return both.select(F.concat_ws(":", "kind", "id").alias("object"), "rings")


def water(features: DataFrame, extent: tuple, scale: float, least: float = P.STYLE.min_water_area_m2, cell: float = 1000.0) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of the water layer: a base plate over the extent (object `plate`) and the relief on it, its bottom at the model's water level."""
    session = features.sparkSession
    x0, y0, x1, y1 = map(float, extent)
    thick = P.WATER_BASE_THICK_MM / scale
    plate = session.range(1).select(F.lit("plate").alias("object"), shapes.box_region(*map(F.lit, (x0, y0, x1, y1))).alias("rings"), F.lit(-thick).alias("low"), F.lit(0.0).alias("high"))
    solids = plate.unionByName(water_plate(features, least, cell))
    z = lambda c: (F.col(c) * scale + P.WATER_BOTTOM_MM + P.WATER_BASE_THICK_MM).alias(c)
    return shapes.prisms(solids.select("object", _scaled(F.col("rings"), scale).alias("rings"), z("low"), z("high")))


def vegetation(features: DataFrame, ground: DataFrame, scale: float, step: float = 1.0, least: float = P.VEGETATION_LEAST_M2, without: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of thin vegetation plates (object = id:part) a little over the ground; features has id and rings.

    The least area is asked for before and after simplifying. What `without` (rings) covers is cut out of the plates."""
    x = polygons_of(features.select("id", "rings"), least).withColumn("rings", shapes.simplify_region(F.col("rings"), P.VEGETATION_TOLERANCE_M))
    x = x.withColumn("area", shapes.region_area(F.col("rings"))).where(F.col("area") >= least)
    x = _on_ground(x.select(_name("id", "part"), "rings"), ground, step)
    if without is not None:
        x = cut_out(x, without, "object")
    low = F.col("tz") + P.VEGETATION_ABOVE_MM
    return shapes.prisms(x.select("object", _scaled(F.col("rings"), scale).alias("rings"), low.alias("low"), (low + P.VEGETATION_THICK_MM).alias("high")))


def cut_out(df: DataFrame, without: DataFrame, key: str) -> DataFrame:
    """df with rings less what the regions of `without` cover; those of which nothing is left go."""
    side = lambda x, s: shapes._sided(x, s, f"{s}_rings")
    a = side(df.select(F.col(key).alias("a_id"), F.col("rings").alias("a_rings")), "a")
    # Both sides are read for the cells' side and again for the join.
    a, b = a.persist(), side(without.select(F.col("rings").alias("b_rings")), "b").persist()
    # Boxes are united first, so that what a region meets does not grow with what lies one on another.
    boxes = spatial.disjoint(b.where(shapes.is_box(F.col("b_rings")))).withColumn("b_rings", shapes.box_region("bx0", "by0", "bx1", "by1"))
    rest = b.where(~F.coalesce(shapes.is_box(F.col("b_rings")), F.lit(False))).withColumns({c: F.col(c).cast("double") for c in ("bx0", "by0", "bx1", "by1")})
    pairs = spatial.box_join(a, boxes.unionByName(rest).persist()).select("a_id", "a_rings", "b_rings")

    def less(table: pa.Table) -> pa.Table:
        first, others = table.column("a_rings")[0].as_py(), table.column("b_rings").to_pylist()
        own, told = shapes._rectangle(first), [shapes._rectangle(x) for x in others]
        some = np.array([x for x in told if x], float).reshape(-1, 4)
        shaped = [shapes.to_rings(x) for x, t in zip(others, told, strict=True) if not t]
        left = shapes.to_rings(first)
        if own:
            left = plane.union([plane.box(*x) for x in plane.uncovered(own, some)])
        elif len(some):
            shaped += [plane.box(*x) for x in some]
        if left and shaped:
            left = plane.difference(left, plane.union(shaped))
        return pa.table({"a_id": table.column("a_id")[:1], "less": pa.array([shapes.to_lists(left)], pa.list_(pa.list_(pa.float64())))})

    kind = pairs.schema["a_id"].dataType.simpleString()
    cut = pairs.groupBy("a_id").applyInArrow(less, f"a_id {kind}, less {shapes.REGION}")
    out = df.join(cut.withColumnRenamed("a_id", key), key, "left").withColumn("rings", F.coalesce("less", "rings")).drop("less")
    return out.where(F.size("rings") > 0)


def excluded(buildings_: DataFrame | None = None, roads_: DataFrame | None = None, water_: DataFrame | None = None) -> DataFrame | None:
    """kind, id and rings (metres) that vegetation leaves out: buildings (id, rings) from ten square metres on, roads (id, line) from
    ten metres on widened by eight metres on each side, and water (id, rings). A switch that is off is a table that is None."""
    out = []
    if buildings_ is not None:
        x = polygons_of(buildings_.select("id", "rings"), P.EXCLUDED_BUILDING_M2)
        out.append(x.select(F.lit("building").alias("kind"), F.col("id").cast("string").alias("id"), "rings"))
    if roads_ is not None:
        x = roads_.withColumn("rings", shapes.buffer_round("line", F.lit(P.EXCLUDED_HALF_M)))
        long = F.col("length") >= P.EXCLUDED_ROAD_M
        out.append(x.where(long).select(F.lit("road").alias("kind"), F.col("id").cast("string").alias("id"), "rings"))
    if water_ is not None:
        out.append(water_.select(F.lit("water").alias("kind"), F.col("id").cast("string").alias("id"), "rings"))
    first, *rest = out or [None]
    for x in rest:
        first = first.unionByName(x)
    return first


def without_conflicts(houses: DataFrame, water_: DataFrame, roads_: DataFrame, cell: float = 1000.0) -> DataFrame:
    """The houses (id, rings) of which water covers no more than its share, and wide roads no more than half."""
    dry = shapes.without_covered(houses, water_, cell, P.OVERLAP)
    return shapes.without_covered(dry, roads_, cell, P.ROAD_OVERLAP)


def wide_roads(roads_: DataFrame) -> DataFrame:
    """id and rings of the motorways, trunk and primary roads (id, highway, line) at the width that they are shown with."""
    kept = roads_.where(F.col("highway").isin("motorway", "trunk", "primary"))
    return kept.select("id", shapes.buffer_flat("line", S.road_width(F.col("highway")) / 2).alias("rings"))


def exclusion_columns(buildings_: DataFrame, ground: DataFrame, scale: float, step: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of the columns over buildings (id, rings) that vegetation is cut with, from under the plants to over the roofs."""
    x = _on_ground(polygons_of(buildings_.select("id", "rings"), P.EXCLUDED_BUILDING_M2).select(_name("id", "part"), "rings"), ground, step)
    low, high = F.col("tz") - P.EXCLUDED_MARGIN_MM, F.col("tz") + P.EXCLUDED_TALL_MM + P.EXCLUDED_MARGIN_MM
    return shapes.prisms(x.select("object", _scaled(F.col("rings"), scale).alias("rings"), low.alias("low"), high.alias("high")))


def carve(ground: DataFrame, polygons: DataFrame, least: float = P.CARVE_LEAST_M2) -> DataFrame:
    """row, col, z: ground vertices inside water polygons (id, rings; in vertex units) lowered to a metre under the water.

    A polygon's water level is the lower quartile of the ground at its outer ring's points (the highest of the eight nearest
    vertices each); polygons under the least area, or with fewer than three known samples, carve nothing. Levels are those of
    the ground as it came, and where polygons overlap the lowest counts, so no order matters."""
    x = polygons.withColumn("area", shapes.region_area(F.col("rings"))).where(F.col("area") >= least).select("id", "rings")
    ring = x.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size(F.col("rings")[0]) / 2 - 1).cast("int")), lambda i: F.struct(F.element_at(F.col("rings")[0], (2 * i + 1).cast("int")).alias("x"), F.element_at(F.col("rings")[0], (2 * i + 2).cast("int")).alias("y")))).alias("k", "p"))
    # A ring is closed: its first point counts again as its last.
    ring = ring.unionAll(ring.where("k = 0").withColumn("k", F.lit(-1)))
    z = sampled(ring.select(F.struct("id", "k").alias("id"), "p.x", "p.y"), ground)
    level = z.where("z IS NOT NULL").groupBy(F.col("id.id").alias("id")).agg(F.percentile("z", F.lit(0.25)).alias("level"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= P.CARVE_SAMPLES)
    wet = x.join(level, "id").withColumn("b", shapes.bounds(F.col("rings")))
    span = lambda k: F.explode(F.sequence(F.ceil(F.col(f"b.{k}0")), F.floor(F.col(f"b.{k}1"))))
    ok = (F.ceil("b.x0") <= F.floor("b.x1")) & (F.ceil("b.y0") <= F.floor("b.y1"))
    cells = wet.where(ok).withColumn("row", span("y")).withColumn("col", span("x"))
    cells = cells.where(shapes.contains("rings", F.col("col").cast("double"), F.col("row").cast("double")))
    floor_ = cells.groupBy("row", "col").agg(F.min(F.col("level") - P.CARVE_DEPTH_M).alias("floor"))
    return ground.join(floor_, ["row", "col"], "left").select("row", "col", F.when(F.col("z") > F.col("floor"), F.col("floor")).otherwise(F.col("z")).alias("z"))


def _terrain_points(ground: DataFrame, scale: float, step: float) -> DataFrame:
    ends = ground.agg(F.min("z").alias("low"), F.max("z").alias("high"))
    x = raster.with_shape(ground.crossJoin(F.broadcast(ends)), ground)
    return x.select("row", "col", "rows", "cols", (F.col("col") * step * scale).alias("x"), (F.col("row") * step * scale).alias("y"), S.terrain_z(F.col("z"), F.col("low"), F.col("high")).alias("z"))


def terrain(ground: DataFrame, scale: float, step: float = 1.0, water_: DataFrame | None = None, bottom: float = P.TERRAIN_BASE_MM - 1.0) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces (object `terrain`) of the closed ground: its surface along the power curve, a flat bottom and walls at every edge that one face has.

    water_ (rings, metres): cells whose centre lies in water are left out, so that the solid has holes there."""
    points = _terrain_points(ground, scale, step)
    cells = points.where((F.col("row") < F.col("rows") - 1) & (F.col("col") < F.col("cols") - 1)).select("row", "col", "rows", "cols")
    if water_ is not None:
        centre = cells.withColumns({"ax0": (F.col("col") + 0.5) * step, "ay0": (F.col("row") + 0.5) * step}).withColumns({"ax1": F.col("ax0"), "ay1": F.col("ay0")})
        wet = shapes._sided(water_.select(F.col("rings").alias("b_rings")), "b", "b_rings")
        met = spatial.box_join(centre, wet).where(shapes.contains("b_rings", "ax0", "ay0")).select("row", "col").distinct()
        cells = cells.join(met, ["row", "col"], "left_anti")
    row, col, cols = F.col("row"), F.col("col"), F.col("cols")
    v = row * cols + col
    face = lambda *p: F.struct(*(x.cast("long").alias(f"v{k + 1}") for k, x in enumerate(p)))
    top = cells.select(F.col("rows") * cols, F.explode(F.array(face(v, v + 1, v + cols), face(v + 1, v + cols + 1, v + cols))).alias("f")).toDF("n", "f")
    under = top.select(face(F.col("f.v1") + F.col("n"), F.col("f.v3") + F.col("n"), F.col("f.v2") + F.col("n")).alias("f"))
    edge = lambda a, b: F.struct(F.col(f"f.{a}").alias("a"), F.col(f"f.{b}").alias("b"))
    edges = top.select("n", F.explode(F.array(edge("v1", "v2"), edge("v2", "v3"), edge("v3", "v1"))).alias("e"))
    once = edges.groupBy(F.least("e.a", "e.b").alias("p"), F.greatest("e.a", "e.b").alias("q")).agg(F.count(F.lit(1)).alias("k"), F.first("e").alias("e"), F.first("n").alias("n")).where("k = 1")
    a, b, n = F.col("e.a"), F.col("e.b"), F.col("n")
    walls = once.select(F.explode(F.array(face(a, a + n, b + n), face(a, b + n, b))).alias("f"))
    faces = top.select("f").unionAll(under).unionAll(walls).select(F.lit("terrain").alias("object"), F.xxhash64("f.v1", "f.v2", "f.v3").alias("fid"), "f.*")
    used = faces.select(F.explode(F.array("v1", "v2", "v3")).alias("vid")).distinct()
    number = row * cols + col
    vertices = points.select(number.alias("vid"), "x", "y", "z").unionAll(points.select(number + F.col("rows") * cols, "x", "y", F.lit(float(bottom))))
    return vertices.join(used, "vid", "left_semi").select(F.lit("terrain").alias("object"), F.col("vid").cast("long").alias("vid"), "x", "y", "z"), faces


def base(ground: DataFrame, thickness: float) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces (object `base`) of the walls and the bottom under a grid, the bottom `thickness` below its lowest point; the
    walls' upper points are the grid's edge in the order of `raster.boundary_loop`, so they close with its heightfield."""
    loop = raster.boundary_loop(ground).join(ground, ["row", "col"])
    one = loop.agg(F.count(F.lit(1)).alias("n"), F.max("col").alias("c"), F.max("row").alias("r"))
    low = ground.agg((F.min("z") - thickness).alias("bottom"))
    x = loop.crossJoin(F.broadcast(one)).crossJoin(F.broadcast(low))
    k, n = F.col("place"), F.col("n")
    point = lambda vid, z: F.struct(vid.cast("long").alias("vid"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), z.alias("z"))
    vertices = x.select(F.explode(F.array(point(k, F.col("z")), point(k + n, F.col("bottom")))).alias("v")).select(F.lit("base").alias("object"), "v.*")
    middle = one.crossJoin(F.broadcast(low)).where("n > 0").select(F.lit("base").alias("object"), (n * 2).cast("long").alias("vid"), (F.col("c") / 2).alias("x"), (F.col("r") / 2).alias("y"), F.col("bottom").alias("z"))
    vertices = vertices.unionByName(middle)
    after = (k + 1) % n
    face = lambda a, b, c: F.struct(a.cast("long").alias("v1"), b.cast("long").alias("v2"), c.cast("long").alias("v3"))
    walls = F.array(face(k, k + n, after + n), face(k, after + n, after))
    # The bottom is a fan around its middle.
    bottom = F.array(face(n * 2, after + n, k + n))
    faces = x.select(F.posexplode(F.concat(walls, bottom)).alias("i", "f"), "place").select(F.lit("base").alias("object"), (F.col("place") * 3 + F.col("i")).cast("long").alias("fid"), "f.*")
    return vertices, faces


def water_surfaces(features: DataFrame, ground: DataFrame, longest: float = P.WATER_EDGE_M, least: float = P.STYLE.min_water_area_m2) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of flat water surfaces (object = kind:id:part) at the lower quartile of the ground along their outline, with
    edges of at most `longest`; parts that leave the ground are cut off by their triangles' centres. Features lie in vertices of the
    ground, not in metres, and no line is too short."""
    lines, polygons = water_regions(features, False, least, 0.0)
    both = polygons.select(F.lit("polygon").alias("kind"), "id", "part", "rings").unionAll(lines.select(F.lit("line").alias("kind"), "id", "part", "rings"))
    both = both.where(F.size("rings") > 0).withColumn("object", F.concat_ws(":", "kind", F.col("id").cast("string"), F.col("part").cast("string")))
    outer = F.col("rings")[0]
    points = both.select("object", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size(outer) / 2 - 1).cast("int")), lambda i: F.struct(F.element_at(outer, (2 * i + 1).cast("int")).alias("x"), F.element_at(outer, (2 * i + 2).cast("int")).alias("y")))).alias("k", "p"))
    z = sampled(points.select(F.struct("object", "k").alias("id"), "p.x", "p.y"), ground)
    level = z.where("z IS NOT NULL").groupBy(F.col("id.object").alias("object")).agg(F.percentile("z", F.lit(0.25)).alias("z"))
    vertices, faces = shapes.surfaces(both.join(level, "object").select("object", "rings", "z"), longest)
    ends = ground.agg(F.min("col").cast("double").alias("x0"), F.min("row").cast("double").alias("y0"), F.max("col").cast("double").alias("x1"), F.max("row").cast("double").alias("y1"))
    return faces_inside(vertices, faces, ends)


def faces_inside(vertices: DataFrame, faces: DataFrame, extent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mesh without the faces whose centre lies outside a box (one row: its least x and y, its largest x and y), and without points that none uses."""
    from gridlore.operators import mesh

    c = mesh.corners(vertices, faces).crossJoin(F.broadcast(extent.toDF("left", "low", "right", "high")))
    at = lambda k: (F.col(f"{k}1") + F.col(f"{k}2") + F.col(f"{k}3")) / 3
    kept = c.where((at("x") >= F.col("left")) & (at("x") <= F.col("right")) & (at("y") >= F.col("low")) & (at("y") <= F.col("high"))).select("object", "fid", "v1", "v2", "v3")
    used = kept.select("object", F.explode(F.array("v1", "v2", "v3")).alias("vid")).distinct()
    return vertices.join(used, ["object", "vid"], "left_semi"), kept
