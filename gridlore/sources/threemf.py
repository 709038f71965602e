"""The 3MF archive: model XML as a text column, the single-file sink and the reader."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore import profiles as P

_QUOTE = {'"': "&quot;"}
SETTINGS = "Metadata/model_settings.config"
#: Fixed package parts.
CONTENT_TYPES = (
    '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="model" ContentType="application/vnd.ms-package.3dmanufacturing-3dmodel+xml"/></Types>'
)
RELS = (
    '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Target="/3D/3dmodel.model" Id="rel0" Type="http://schemas.microsoft.com/3dmanufacturing/2013/01/3dmodel"/></Relationships>'
)
HEAD = '<?xml version="1.0" encoding="UTF-8"?><model unit="millimeter" xmlns="http://schemas.microsoft.com/3dmanufacturing/core/2015/02"><resources>'
MODEL = "3D/3dmodel.model"


def object_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """object, part, at and one XML line for each vertex and face; vertices are renumbered from 0 by vid."""
    from pyspark.sql import Window

    index = F.row_number().over(Window.partitionBy("object").orderBy("vid")) - 1
    v = vertices.withColumn("i", index)
    out = v.select("object", F.lit(0).alias("part"), F.col("i").cast("long").alias("at"), F.format_string('<vertex x="%.6f" y="%.6f" z="%.6f"/>', "x", "y", "z").alias("line"))
    for k in (1, 2, 3):
        faces = faces.join(v.select("object", F.col("vid").alias(f"v{k}"), F.col("i").alias(f"i{k}")), ["object", f"v{k}"])
    return out.unionByName(faces.select("object", F.lit(1).alias("part"), F.col("fid").cast("long").alias("at"), F.format_string('<triangle v1="%d" v2="%d" v3="%d"/>', "i1", "i2", "i3").alias("line")))


def materials() -> str:
    """The base materials with the layers' colours, in their order."""
    names = "".join(f'<base name="{k}" displaycolor="{v}FF"/>' for k, v in P.COLOURS.items())
    return f'<basematerials id="1">{names}</basematerials>'


def settings(names: list[str], extruders: dict[str, int]) -> str:
    """The objects' names and extruders, which `read_extruders` reads."""
    rows = "".join(f'<object id="{i + 2}"><metadata key="name" value="{escape(n, _QUOTE)}"/><metadata key="extruder" value="{extruders.get(n, extruders.get(n.split("_")[0], 1))}"/></object>' for i, n in enumerate(names))
    return f'<?xml version="1.0" encoding="UTF-8"?><config>{rows}</config>'


def write_3mf(vertices: DataFrame, faces: DataFrame, path: str, extruders: dict[str, int] | None = None) -> None:
    """One archive on the driver, its lines streamed in order: the layers first, in the order of their colours, then other objects by name.

    Objects without faces are left out. An object's material is its layer's colour; names and extruders are written too."""
    held = faces.select("object").distinct()
    order = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for i, k in enumerate(P.COLOURS) for v in (k, i))), F.col("object")), F.lit(len(P.COLOURS)))
    lines = object_lines(vertices, faces.select("object", "fid", "v1", "v2", "v3")).join(held, "object", "left_semi").orderBy(order, "object", "part", "at")
    places = {k: i for i, k in enumerate(P.COLOURS)}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", CONTENT_TYPES)
        z.writestr("_rels/.rels", RELS)
        names: list[str] = []
        with z.open(MODEL, "w") as f:
            put = lambda s: f.write(s.encode())
            put(HEAD + materials())
            part = None
            for r in lines.toLocalIterator():
                if not names or names[-1] != r.object:
                    put("</triangles></mesh></object>" if names else "")
                    names.append(r.object)
                    colour = f' pid="1" pindex="{places[r.object]}"' if r.object in places else ""
                    put(f'<object id="{len(names) + 1}" name="{escape(r.object, _QUOTE)}"{colour} type="model"><mesh><vertices>')
                    part = 0
                if r.part != part:
                    put("</vertices><triangles>")
                    part = r.part
                put(r.line)
            put("</triangles></mesh></object>" if names else "")
            put("</resources><build>" + "".join(f'<item objectid="{i + 2}"/>' for i in range(len(names))) + "</build></model>")
        z.writestr(SETTINGS, settings(names, P.EXTRUDERS if extruders is None else extruders))


def read_extruders(spark: SparkSession, path: str) -> DataFrame:
    """object and extruder of archives; none of an archive without settings."""
    import pyarrow as pa

    def work(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    yield pa.record_batch({"xml": pa.array([z.read(SETTINGS).decode() if SETTINGS in z.namelist() else ""], pa.string())})

    xml = spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, "xml string")
    o = xml.select(F.explode(F.regexp_extract_all("xml", F.lit("(?s)(<object .*?</object>)"), 1)).alias("o"))
    value = lambda key: F.regexp_extract("o", f'key="{key}" value="([^"]*)"', 1)
    return o.select(unescaped(value("name")).alias("object"), value("extruder").cast("int").alias("extruder"))


def unescaped(text: F.Column) -> F.Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def read_3mf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vertices (object, vid, x, y, z) and faces (object, fid, v1, v2, v3) of archives; a nameless object is object_<id>."""
    import pyarrow as pa

    def work(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    yield pa.record_batch({"xml": pa.array([z.read(MODEL).decode()], pa.string())})

    xml = spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, "xml string")
    o = xml.select(F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)(<object .*?</object>)"), 1)).alias("o"))
    name = F.regexp_extract("o", r'<object [^>]*name="([^"]*)"', 1)
    o = o.select(F.when(name != "", unescaped(name)).otherwise(F.concat(F.lit("object_"), F.regexp_extract("o", r'<object [^>]*id="(\d+)"', 1))).alias("object"), "o")

    def numbers(tag, keys, kind):
        found = F.posexplode(F.regexp_extract_all("o", F.lit(rf"(<{tag} [^>]*>)"), 1)).alias("n", "t")
        return o.select("object", found).select("object", F.col("n").cast("long").alias("n"), *(F.regexp_extract("t", rf'{k}="([^"]*)"', 1).cast(kind).alias(k) for k in keys))

    return numbers("vertex", "xyz", "double").withColumnRenamed("n", "vid"), numbers("triangle", ("v1", "v2", "v3"), "long").withColumnRenamed("n", "fid")
