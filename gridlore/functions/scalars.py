"""Scalar rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlore import profiles as P


def number(text: Column) -> Column:
    """A plain decimal number, null if the text is anything else."""
    return F.when(text.rlike(r"^([0-9]+[.]?[0-9]*|[.][0-9]+)$"), text.try_cast("double"))


def building_height(height: Column, levels: Column) -> Column:
    """The height tag's digits and dots if they make a number over 0 and up to the limit; else (or at exactly the default) the levels; else the default."""
    tagged = number(F.regexp_replace(height, "[^0-9.]", ""))
    first = F.when((tagged > 0) & (tagged <= P.HEIGHT_LIMIT), tagged).otherwise(P.DEFAULT_HEIGHT)
    floors = number(levels)
    return F.when((first == P.DEFAULT_HEIGHT) & (floors > 0), F.least(floors * P.LEVEL_HEIGHT, F.lit(P.HEIGHT_LIMIT))).otherwise(first)


def height_of_area(area: Column) -> Column:
    return reduce(lambda rest, step: F.when(area < step[0], step[1]).otherwise(rest), reversed(P.AREA_HEIGHTS), F.lit(P.TALLEST))


def model_height(height: Column, area: Column) -> Column:
    """Millimetres; by the footprint where no height is known."""
    real = F.when(height > 0, height).otherwise(height_of_area(area))
    (a, b), (low, high) = P.REAL_RANGE, P.MODEL_RANGE
    return F.greatest(F.lit(low), F.least(F.lit(high), low + (real - a) / (b - a) * (high - low)))


def area_class(km2: Column) -> Column:
    return F.when(km2 < P.SMALL_KM2, "small").when(km2 < P.MEDIUM_KM2, "medium").otherwise("large")


def line_width(tag: Column, kind: Column, table: dict[str, float]) -> Column:
    """The width tag if it is a number between 0 and 10000, else the kind's width, else the default."""
    tagged = number(tag)
    known = reduce(lambda rest, kv: F.when(kind == kv[0], kv[1]).otherwise(rest), table.items(), F.lit(P.DEFAULT_LINE_WIDTH))
    return F.when((tagged > 0) & (tagged < 10000), tagged).otherwise(known)


def model_scale(width: Column, height: Column) -> Column:
    return P.MODEL_MM / F.greatest(width, height)


def road_width(highway: Column) -> Column:
    """Metres of a road as it is shown."""
    known = reduce(lambda rest, kv: F.when(highway == kv[0], kv[1]).otherwise(rest), P.ROAD_WIDTHS.items(), F.lit(P.DEFAULT_ROAD_WIDTH))
    return known * P.ROAD_WIDENING


def grid_points(km2: Column) -> Column:
    """Points along the longer side of the terrain grid."""
    kind = area_class(km2)
    return F.when(kind == "small", P.GRID_POINTS["small"]).when(kind == "medium", P.GRID_POINTS["medium"]).otherwise(P.GRID_POINTS["large"])


def relief_thickness(low: Column, high: Column) -> Column:
    """Millimetres of the terrain by its range of heights; the middle of the bounds on flat ground."""
    a, b = P.RELIEF_MM
    wanted = P.BASE_MM * (high - low) / P.RELIEF_SPAN_M / P.RELIEF_SHARE
    return F.when(high - low < P.FLAT_M, (a + b) / 2).otherwise(F.greatest(F.lit(a), F.least(F.lit(b), wanted)))


def relief_z(z: Column, low: Column, high: Column) -> Column:
    """Millimetres over the terrain's lowest point; half the thickness on flat ground."""
    thick = relief_thickness(low, high)
    return F.when(high - low > P.FLAT_M, (z - low) / F.when(high > low, high - low).otherwise(1.0) * thick).otherwise(thick / 2)


def terrain_z(z: Column, low: Column, high: Column) -> Column:
    """Millimetres of the terrain's surface along a power curve that lifts low ground; the middle on flat ground."""
    t = (z - low) / F.when(high > low, high - low).otherwise(1.0)
    return F.when(high - low > P.FLAT_M, F.pow(t, F.lit(P.TERRAIN_GAMMA)) * P.TERRAIN_THICK_MM).otherwise(P.TERRAIN_THICK_MM / 2) + P.TERRAIN_BASE_MM


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def hex_colour(colour: Column) -> Column:
    """[red, green, blue, 255] of #rrggbb."""
    return F.array(*(hex_channel(colour, k) for k in range(3)), F.lit(255))


def hex_channel(colour: Column, k: int) -> Column:
    """Red, green or blue (k = 0, 1, 2) of #rrggbb."""
    return F.conv(F.substring(colour, 2 + 2 * k, 2), 16, 10).cast("int")


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def hgt_name(lat: Column, lon: Column) -> Column:
    return F.format_string("%s%02d%s%03d.hgt", F.when(lat >= 0, "N").otherwise("S"), F.abs(lat), F.when(lon >= 0, "E").otherwise("W"), F.abs(lon))


def tag_filter(tags: Column, rule: dict) -> Column:
    """Whether any key of the rule matches: True asks for the key, a tuple for one of its values."""

    def one(key, want):
        return F.map_contains_key(tags, key) if want is True else F.coalesce(tags[key].isin(*want), F.lit(False))

    return reduce(lambda a, b: a | b, (one(k, v) for k, v in rule.items()))


def ramp(z: Column, low: Column, high: Column, a: tuple, b: tuple, share: float = 0.4) -> Column:
    """The colour (red, green, blue, alpha) between a and b by elevation, truncated; the low colour on flat ground. Only `share` of the way to b is gone."""
    t = F.when(high - low < 1e-3, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (z - low) / F.when(high > low, high - low).otherwise(1.0)))) * share
    channel = lambda x, y: F.greatest(F.lit(0), F.least(F.lit(255), (x * (1 - t) + y * t).cast("int")))
    return F.array(*(channel(x, y) for x, y in zip(a, b, strict=True)), F.lit(255))
