"""Model constants of the two profiles, and lookup tables."""

from __future__ import annotations

from dataclasses import dataclass

MODEL_MM = 196.0


@dataclass(frozen=True)
class Profile:
    smoothing_sigma: float
    min_water_area_m2: float
    river_width_m: float
    riverbank_width_m: float
    building_min_area_m2: tuple[float, float, float]
    extruder_roads: int
    extruder_water: int


STYLE = Profile(2.5, 50000.0, 500.0, 1000.0, (30.0, 80.0, 200.0), 2, 3)
BASE = Profile(1.0, 5.0, 60.0, 60.0, (0.0, 20.0, 50.0), 3, 2)

# Layers as OR-filters over tags (True = the key exists, a tuple = one of the values), and their geometry types.
LAYERS = {
    "water": {"natural": ("water",), "waterway": True, "landuse": ("reservoir",), "water": True},
    "vegetation": {"landuse": ("forest", "grass", "meadow", "village_green"), "natural": ("wood", "grassland", "scrub", "heath")},
    "buildings": {"building": True},
    "roads": {"highway": True},
    "parks": {"leisure": ("park", "garden", "nature_reserve"), "landuse": ("recreation_ground",)},
}
KINDS = {"water": ("polygon", "line"), "vegetation": ("polygon",), "buildings": ("polygon",), "roads": ("line",), "parks": ("polygon",)}

#: Upper bounds of a footprint in square metres, and the height in metres up to each; above the last, the last height.
AREA_HEIGHTS = ((100, 8.0), (200, 10.0), (500, 15.0), (1000, 25.0), (2000, 40.0))
TALLEST = 60.0
DEFAULT_HEIGHT, LEVEL_HEIGHT, HEIGHT_LIMIT = 10.0, 3.5, 800.0
#: Real heights in metres from 5 to 150 become model heights from 3.0 to 5.3 mm.
REAL_RANGE, MODEL_RANGE = (5.0, 150.0), (3.0, 5.3)
#: Square kilometres below which an area is small or medium.
SMALL_KM2, MEDIUM_KM2 = 5.0, 50.0
#: Overlap above which one water feature wins over another.
OVERLAP = 0.3
#: Overlap above which a road takes a building's place.
ROAD_OVERLAP = 0.5
DEFAULT_LINE_WIDTH = 60.0

# Metres of waterways and roads by their tag.
WATERWAY_WIDTHS = {"river": 500.0, "riverbank": 1000.0, "canal": 30.0, "stream": 12.0, "drain": 6.0, "ditch": 4.0}
ROAD_WIDTHS = {
    "motorway": 16.0, "motorway_link": 10.0, "trunk": 14.0, "trunk_link": 8.0, "primary": 12.0, "primary_link": 7.0, "secondary": 8.0,
    "secondary_link": 6.0, "tertiary": 7.0, "tertiary_link": 5.0, "residential": 6.0, "living_street": 5.0, "service": 4.0, "unclassified": 6.0,
}
DEFAULT_ROAD_WIDTH, ROAD_WIDENING = 6.0, 2.5
# The roads that a large area shows.
MAIN_ROADS = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link")

# Fixed values in metres or millimetres: what a feature needs to be shown, and where its solid lies.
ROAD_LEAST_M, ROAD_STEP_M, ROAD_ABOVE_MM, ROAD_THICK_MM = 10.0, 10.0, 0.51, 0.4
BUILDING_TOLERANCE_M, BUILDING_EMBED_MM = 2.0, 0.04
VEGETATION_LEAST_M2, VEGETATION_TOLERANCE_M, VEGETATION_ABOVE_MM, VEGETATION_THICK_MM = 5000.0, 5.0, 0.1, 0.2
WATER_EDGE_M, WATER_LINE_LEAST_M, WATER_HEIGHT_M, WATER_BASE_THICK_MM, WATER_BOTTOM_MM = 100.0, 10.0, 100.0, 0.4, -2.0
CARVE_LEAST_M2, CARVE_SAMPLES, CARVE_DEPTH_M = 500.0, 3, 1.0
EXCLUDED_BUILDING_M2, EXCLUDED_ROAD_M, EXCLUDED_HALF_M, EXCLUDED_MARGIN_MM, EXCLUDED_TALL_MM = 10.0, 10.0, 8.0, 0.5, 5.0
TERRAIN_THICK_MM, TERRAIN_BASE_MM, TERRAIN_GAMMA, FLAT_M = 4.0, -0.17, 0.45, 0.01
GRID_POINTS = {"small": 512, "medium": 768, "large": 1024}
#: Thickness by the range of heights: millimetres between these, for this share of the width of 25 km.
RELIEF_MM, RELIEF_SPAN_M, RELIEF_SHARE, BASE_MM = (3.5, 5.0), 25000.0, 0.025, 200.0
# Extruders and display colours.
EXTRUDERS = {"terrain": 1, "buildings": 1, "roads": 2, "water": 3, "vegetation": 4}
COLOURS = {"terrain_surface": "#C8B48C", "terrain_walls": "#464137", "buildings": "#F5E6C8", "roads": "#5A5A5A", "water": "#3C96DC", "vegetation": "#6B8E23"}
