"""Mesh tables: vertices (object, vid, x, y, z) and faces (object, fid, v1, v2, v3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with the places of their three vertices; those of solids carry them (x1, y1, z1, ... z3) and are not joined to their vertices."""
    if {f"{c}{k}" for c in "xyz" for k in (1, 2, 3)} <= set(faces.columns):
        return faces
    for k in (1, 2, 3):
        v = vertices.select("object", F.col("vid").alias(f"v{k}"), *(F.col(c).alias(f"{c}{k}") for c in "xyz"))
        faces = faces.join(v, ["object", f"v{k}"])
    return faces


def normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with corners and unit normals; a face without area has the normal 0."""
    c = corners(vertices, faces)
    d = {f"{a}{k}": F.col(f"{a}{k}") - F.col(f"{a}1") for a in "xyz" for k in (2, 3)}
    nx = d["y2"] * d["z3"] - d["z2"] * d["y3"]
    ny = d["z2"] * d["x3"] - d["x2"] * d["z3"]
    nz = d["x2"] * d["y3"] - d["y2"] * d["x3"]
    size = F.sqrt(nx * nx + ny * ny + nz * nz)
    unit = lambda n: F.when(size > 1e-10, n / size).otherwise(F.lit(0.0))
    return c.withColumns({"nx": unit(nx), "ny": unit(ny), "nz": unit(nz)})


def split_by_normal(vertices: DataFrame, faces: DataFrame, least: float = 0.1) -> DataFrame:
    """fid and the part: surface where the normal points up by more than `least`, else wall."""
    return normals(vertices, faces).select("object", "fid", F.when(F.col("nz") > least, "surface").otherwise("wall").alias("part"))


def extrude(footprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of solids over counter-clockwise rings (object, ring, low, high): caps as fans around the
    first point, two wall faces an edge. The ring's last point repeats its first; holes are not cut; rings of
    fewer than three different points give nothing."""
    x = footprints.withColumn("n", F.size("ring") - 1).where("n >= 3")
    point = lambda z, base: F.transform(F.slice("ring", F.lit(1), F.col("n")), lambda p, i: F.struct((i + base).cast("long").alias("vid"), p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"), F.col(z).cast("double").alias("z")))
    vertices = x.select("object", F.explode(F.concat(point("low", F.lit(0)), point("high", F.col("n")))).alias("v")).select("object", "v.*")
    face = lambda a, b, c: F.struct(*(v.cast("long").alias(f"v{k}") for k, v in ((1, a), (2, b), (3, c))))
    n, first = F.col("n"), F.lit(0)
    caps = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.array(face(first, i + 1, i), face(n, n + i, n + i + 1)))
    walls = F.transform(F.sequence(first, n - 1), lambda i: F.array(face(i, (i + 1) % n, n + i), face((i + 1) % n, n + (i + 1) % n, n + i)))
    faces = x.select("object", F.posexplode(F.flatten(F.concat(caps, walls))).alias("fid", "f"))
    return vertices, faces.select("object", F.col("fid").cast("long").alias("fid"), "f.*")


def repaired(vertices: DataFrame, faces: DataFrame, digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """The mesh with equal points (to so many digits) merged, and without faces that repeat a point, have no area, or have the points of another face; unused points go.

    A merged point keeps its smallest number, and of equal faces the one with the smallest number stays. Holes are not filled."""
    key = [F.round(c, digits).alias(f"_{c}") for c in "xyz"]
    named = vertices.select("object", "vid", "x", "y", "z", *key)
    first = named.groupBy("object", "_x", "_y", "_z").agg(F.min("vid").alias("to"))
    to = named.join(first, ["object", "_x", "_y", "_z"]).select("object", "vid", "to")
    for k in (1, 2, 3):
        faces = faces.join(to.select("object", F.col("vid").alias(f"v{k}"), F.col("to").alias(f"_{k}")), ["object", f"v{k}"]).drop(f"v{k}").withColumnRenamed(f"_{k}", f"v{k}")
    faces = faces.where("v1 <> v2 AND v2 <> v3 AND v1 <> v3")
    faces = normals(vertices, faces).where("nx <> 0 OR ny <> 0 OR nz <> 0").select("object", "fid", "v1", "v2", "v3")
    faces = faces.withColumn("_set", F.array_sort(F.array("v1", "v2", "v3"))).groupBy("object", "_set").agg(F.min(F.struct("fid", "v1", "v2", "v3")).alias("f")).select("object", "f.*")
    used = faces.select("object", F.explode(F.array("v1", "v2", "v3")).alias("vid")).distinct()
    return vertices.join(used, ["object", "vid"], "left_semi").select("object", "vid", "x", "y", "z"), faces


def loops(faces: DataFrame) -> DataFrame:
    """object, loop, place and vid: the boundary of each object's mesh as closed walks along the directed edges that one face has.

    The edges of an object's boundary are walked in one task; a loop is named by its smallest point and begins there."""
    import pyarrow as pa

    edge = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    e = faces.select("object", F.explode(F.array(edge("v1", "v2"), edge("v2", "v3"), edge("v3", "v1"))).alias("e")).select("object", "e.a", "e.b")
    once = e.groupBy("object", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).agg(F.count(F.lit(1)).alias("n"), F.first("a").alias("a"), F.first("b").alias("b")).where("n = 1").select("object", "a", "b")

    def walk(table: pa.Table) -> pa.Table:
        name = table.column("object")[0].as_py()
        after: dict[int, list[int]] = {}
        for a, b in sorted(zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True), reverse=True):
            after.setdefault(a, []).append(b)
        rows: list[tuple[int, int, int]] = []
        for start in sorted(after):
            while after.get(start):
                path, at = [start], after[start].pop()
                while at != start and after.get(at):
                    path.append(at)
                    at = after[at].pop()
                rows += [(start, k, v) for k, v in enumerate(path)]
        return pa.table({"object": pa.array([name] * len(rows), pa.string()), **{k: pa.array([r[i] for r in rows], pa.int64()) for i, k in enumerate(("loop", "place", "vid"))}})

    return once.groupBy("object").applyInArrow(walk, "object string, loop long, place long, vid long")


def longest_loop(faces: DataFrame) -> DataFrame:
    """object, loop and points of each object's longest boundary loop (of equals the one with the smallest point)."""
    n = loops(faces).groupBy("object", "loop").agg(F.count(F.lit(1)).alias("points"))
    return n.groupBy("object").agg(F.min(F.struct((-F.col("points")).alias("n"), "loop")).alias("m")).select("object", "m.loop", (-F.col("m.n")).alias("points"))


def reindexed(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The referenced points numbered from 0 in the order of their old numbers, object by object, and the faces with the new ones."""
    used = faces.select("object", F.explode(F.array("v1", "v2", "v3")).alias("vid")).distinct()
    order = Window.partitionBy("object").orderBy("vid")
    v = vertices.join(used, ["object", "vid"], "left_semi").withColumn("to", (F.row_number().over(order) - 1).cast("long"))
    for k in (1, 2, 3):
        faces = faces.join(v.select("object", F.col("vid").alias(f"v{k}"), F.col("to").alias(f"_{k}")), ["object", f"v{k}"]).drop(f"v{k}").withColumnRenamed(f"_{k}", f"v{k}")
    return v.select("object", F.col("to").alias("vid"), "x", "y", "z"), faces.select("object", "fid", "v1", "v2", "v3")


RULES = (
    ("V1", "model side", "warning"), ("V2", "both terrain objects", "error"), ("V3", "terrain relief", "warning"), ("V4", "buildings below the highest ground", "error"),
    ("V5", "building embedding", "warning"), ("V6", "road faces up", "warning"), ("V7", "road relief", "warning"), ("V8", "water depth", "error"),
    ("V9", "water walls", "error"), ("V10", "extruders", "error"), ("V11", "vegetation relief", "warning"), ("V12", "vegetation faces flat", "warning"),
)


def summary(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """What the model's rules ask, a row an object: its extent (x0, x1, ... z1), and of its faces the share that points up (up), the largest
    share of a normal's vertical part under 0.9 (steep) and the share of level ones (flat)."""
    ends = [f(c).alias(f"{c}{k}") for c in "xyz" for k, f in ((0, F.min), (1, F.max))]
    tall = F.greatest("z1", "z2", "z3") - F.least("z1", "z2", "z3")
    turned = normals(vertices, faces).groupBy("object").agg(F.avg((F.col("nz") > 0.5).cast("double")).alias("up"), F.max(F.abs("nz") < 0.9).alias("steep"), F.avg((tall < 0.1).cast("double")).alias("flat"))
    return vertices.groupBy("object").agg(*ends).join(turned, "object", "full")


def check_model(vertices: DataFrame, faces: DataFrame, extruders: DataFrame, expected: DataFrame) -> DataFrame:
    """A row a rule: rule, title, severity, passed. Rules on an absent object pass."""
    return check_summary(summary(vertices, faces), extruders, expected)


def check_summary(objects: DataFrame, extruders: DataFrame, expected: DataFrame) -> DataFrame:
    """`check_model` of a model's summary."""
    of = lambda name: F.col("object") == name
    terrain = F.col("object").isin("terrain_surface", "terrain_walls")
    lo = lambda cond: F.min(F.when(cond, F.col("z0")))
    hi = lambda cond: F.max(F.when(cond, F.col("z1")))
    span = lambda cond: hi(cond) - lo(cond)
    held = lambda name: (F.count_if(of(name) & F.col("z0").isNotNull()) > 0).alias(name[8:])
    told = lambda name, c, to: F.max(F.when(of(name), F.col(c))).alias(to)
    v = objects.agg(
        F.greatest(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0")).alias("side"),
        held("terrain_surface"), held("terrain_walls"),
        span(terrain).alias("relief"), hi(terrain).alias("ground"), lo(of("buildings")).alias("low_building"),
        span(of("roads")).alias("roads"), span(of("water")).alias("water"), span(of("vegetation")).alias("plants"),
        told("roads", "up", "up"), told("water", "steep", "steep"), told("vegetation", "flat", "flat"),
    )
    same = extruders.join(expected.withColumnRenamed("extruder", "want"), "object", "left").agg(F.bool_and(F.col("want").isNull() | (F.col("want") == F.col("extruder"))).alias("same"))
    one = v.crossJoin(same)
    yes = lambda c: F.coalesce(c, F.lit(True))
    embed = F.col("ground") - F.col("low_building")
    results = (
        F.abs(F.col("side") - 196) < 2, F.col("surface") & F.col("walls"), F.abs(F.col("relief") - 4.0) < 0.6, F.col("low_building") < F.col("ground"),
        (embed > 0) & (embed < 6.0), F.col("up") >= 0.15, (F.col("roads") >= 0.35) & (F.col("roads") < 5.5), F.col("water") >= 0.4,
        F.col("steep") | (F.col("water") < 0.5), F.col("same"), F.col("plants") >= 0.1, F.col("flat") >= 0.9,
    )
    rows = F.array(*(F.struct(F.lit(a).alias("rule"), F.lit(b).alias("title"), F.lit(c).alias("severity"), yes(r).alias("passed")) for (a, b, c), r in zip(RULES, results, strict=True)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def verdict(rules: DataFrame) -> DataFrame:
    """One row: passed unless a rule of class error fails."""
    return rules.agg(F.bool_and(F.col("passed") | (F.col("severity") != "error")).alias("passed"))


def rule_text(rules: DataFrame) -> DataFrame:
    """One line of text a rule, in the order of their numbers, and a last one with the verdict."""
    number = F.substring("rule", 2, 3).cast("int")
    lines = rules.select(number.alias("at"), F.format_string("[%s] %s %s%s", F.when(F.col("passed"), "ok").otherwise("no"), F.col("rule"), F.col("title"), F.when(F.col("passed"), "").otherwise(F.concat(F.lit(" ("), F.col("severity"), F.lit(")")))).alias("line"))
    last = verdict(rules).select(F.lit(len(RULES) + 1).alias("at"), F.when(F.col("passed"), "model passed").otherwise("model failed").alias("line"))
    return lines.unionAll(last)


def report(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """By object: faces, faces without area, edges not shared by two faces, and the signed volume."""
    c = normals(vertices, faces)
    det = F.col("x1") * (F.col("y2") * F.col("z3") - F.col("z2") * F.col("y3")) - F.col("y1") * (F.col("x2") * F.col("z3") - F.col("z2") * F.col("x3")) + F.col("z1") * (F.col("x2") * F.col("y3") - F.col("y2") * F.col("x3"))
    flat = F.count_if((F.col("nx") == 0) & (F.col("ny") == 0) & (F.col("nz") == 0))
    whole = c.groupBy("object").agg(F.count(F.lit(1)).alias("faces"), (F.sum(det) / 6).alias("volume"), flat.alias("degenerate"))
    edge = lambda p, q: F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    e = faces.select("object", F.explode(F.array(edge("v1", "v2"), edge("v2", "v3"), edge("v3", "v1"))).alias("e")).groupBy("object", "e").agg(F.count(F.lit(1)).alias("n"))
    return whole.join(e.groupBy("object").agg(F.count_if(F.col("n") != 2).alias("open_edges")), "object")
