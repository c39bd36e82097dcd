"""Fixed values of the domain and the small dimension frames built from them.

Every frame here has a row count fixed by the constants below (at most a few
dozen rows), so broadcasting one is always safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# These must stay exactly as they are for results to be right.
# --------------------------------------------------------------------------

# annotation label -> canonical damage type
LABEL_NAMES = {
    "1": "surface_scratch",
    "2": "dent",
    "3": "paint_peeling",
    "4": "deep_scratch",
    "5": "crack",
    "6": "missing_part",
    "7": "missing_accessory",
    "8": "misaligned_part",
}
UNKNOWN_TYPE = "unknown"
ODD_LABEL = "9"  # stray label that most steps leave out

# annotation label -> base padding share
PADDING = {
    "1": 0.35,
    "2": 0.25,
    "3": 0.30,
    "4": 0.30,
    "5": 0.40,
    "6": 0.20,
    "7": 0.20,
    "8": 0.35,
}
DEFAULT_PADDING = 0.30

# vehicle zone -> (name, description, area)
ZONES = {
    "1": ("front_left_fender", "Front left fender", "frontal"),
    "2": ("hood_center", "Center hood", "frontal"),
    "3": ("front_right_fender", "Front right fender", "frontal"),
    "4": ("rear_left_quarter", "Rear left quarter panel", "posterior"),
    "5": ("rear_bumper", "Rear bumper", "posterior"),
    "6": ("rear_right_quarter", "Rear right quarter panel", "posterior"),
    "7": ("driver_side_door", "Driver side door (left)", "lateral_left"),
    "8": ("driver_side_rocker", "Driver side rocker panel", "lateral_left"),
    "9": ("passenger_side_door", "Passenger side door (right)", "lateral_right"),
    "10": ("passenger_side_rocker", "Passenger side rocker panel", "lateral_right"),
}

# train label -> (benchmark label, confidence)
TAXONOMY = {
    "1": ("Scratch", 1.0),
    "2": ("Dent", 1.0),
    "3": ("Degraded varnish", 1.0),
    "4": ("Scratch", 1.0),
    "5": ("Crack", 1.0),
    "6": ("Missing part", 1.0),
    "7": ("Missing part", 0.9),
    "8": ("Deviated part", 1.0),
    "surface_scratch": ("Scratch", 1.0),
    "deep_scratch": ("Scratch", 1.0),
    "dent": ("Dent", 1.0),
    "paint_peeling": ("Degraded varnish", 1.0),
    "crack": ("Crack", 1.0),
    "missing_part": ("Missing part", 1.0),
    "missing_accessory": ("Missing part", 0.9),
    "misaligned_part": ("Deviated part", 1.0),
    "unknown": ("Unknown", 1.0),
    "no_damage": ("No damage", 1.0),
}
BENCHMARK_LABELS = [
    "Scratch",
    "Dent",
    "Degraded varnish",
    "Crack",
    "Fractured part",
    "Missing part",
    "Deviated part",
    "No damage",
    "Unknown",
]

# damage types that may share one cluster
COMPATIBLE_GROUPS = {
    "surface_damage": ["surface_scratch", "deep_scratch"],
    "structural": ["dent", "crack"],
    "coating": ["paint_peeling"],
    "missing": ["missing_part", "missing_accessory"],
    "alignment": ["misaligned_part"],
}

# relative area upper bounds (exclusive); anything above is very_large
SIZE_CUTS = [("very_small", 0.005), ("small", 0.02), ("medium", 0.08), ("large", 0.15)]

ALL_TYPES = [*LABEL_NAMES.values(), UNKNOWN_TYPE]

# thirds of the image used for the 3x3 spatial grid
THIRD_LOW, THIRD_HIGH = 0.33, 0.67

# spatial zone -> display text
SPATIAL_DISPLAY = {
    "top_left": "Upper left",
    "top_center": "Upper center",
    "top_right": "Upper right",
    "middle_left": "Left side",
    "middle_center": "Center",
    "middle_right": "Right side",
    "bottom_left": "Lower left",
    "bottom_center": "Lower center",
    "bottom_right": "Lower right",
}

# damage type -> (category, aliases, lowest severity, highest severity)
TYPE_DETAILS = {
    "surface_scratch": ("surface_damage", ["scratch", "light_scratch", "minor_abrasion"], 0.0, 0.3),
    "dent": ("structural_damage", ["depression", "ding", "impact_damage"], 0.3, 0.7),
    "paint_peeling": ("coating_damage", ["peeling", "flaking", "chipped_paint"], 0.4, 0.8),
    "deep_scratch": ("surface_damage", ["major_scratch", "gouge", "key_scratch"], 0.5, 0.9),
    "crack": ("structural_damage", ["fracture", "split", "break"], 0.6, 1.0),
    "missing_part": ("missing_component", ["missing_component", "torn_piece", "broken_off"], 0.7, 1.0),
    "missing_accessory": ("missing_component", ["missing_trim", "missing_badge", "missing_emblem"], 0.3, 0.6),
    "misaligned_part": ("alignment_issue", ["protruding_part", "misaligned_panel", "gap_issue"], 0.4, 0.7),
}

# damage type -> short plain wording
FRIENDLY = {
    "surface_scratch": "minor surface abrasion",
    "dent": "metal deformation",
    "paint_peeling": "paint layer detachment",
    "deep_scratch": "deep paint penetration",
    "crack": "structural fracture",
    "missing_part": "component absence",
    "missing_accessory": "accessory detachment",
    "misaligned_part": "panel misalignment",
}
FRIENDLY_DEFAULT = "unspecified damage"

# (zone name, vertical third) -> part of the vehicle
PARTS = {
    ("front_left_fender", "top"): "Upper front fender panel",
    ("front_left_fender", "center"): "Front fender mid-section",
    ("front_left_fender", "bottom"): "Front fender lower edge near wheel arch",
    ("hood_center", "front"): "Front hood edge near grille",
    ("hood_center", "center"): "Central hood panel",
    ("hood_center", "rear"): "Hood rear section near windshield",
    ("rear_left_quarter", "top"): "Upper rear quarter panel",
    ("rear_left_quarter", "center"): "Rear left corner panel near bumper junction",
    ("rear_left_quarter", "bottom"): "Lower rear quarter panel near wheel arch",
}

# search profile by corpus size: (name, exclusive upper bound on vectors)
SEARCH_PROFILES = [("poc", 10_000), ("production", 100_000)]
LARGEST_PROFILE = "large_scale"

# --------------------------------------------------------------------------
# Helpers over those values
# --------------------------------------------------------------------------


def lit_map(values: dict) -> Column:
    """Map literal from a constant dict."""
    flat = [F.lit(x) for pair in values.items() for x in pair]
    return F.create_map(*flat)


def lookup(values: dict, key: Column) -> Column:
    """Value of a constant dict for ``key``; NULL when absent."""
    return F.try_element_at(lit_map(values), key)


def group_of_type(damage_type: Column) -> Column:
    """Compatibility group of a damage type.

    Types outside every group are compatible with themselves only, so they
    form a group of their own.
    """
    flat = {t: g for g, ts in COMPATIBLE_GROUPS.items() for t in ts}
    return F.coalesce(lookup(flat, damage_type), damage_type)


def zone_dim(spark: SparkSession) -> DataFrame:
    rows = [(z, n, d, a) for z, (n, d, a) in ZONES.items()]
    return spark.createDataFrame(
        rows, "vehicle_zone string, zone_name string, zone_description string, zone_area string"
    )


def padding_dim(spark: SparkSession) -> DataFrame:
    rows = [(k, LABEL_NAMES[k], v) for k, v in PADDING.items()]
    return spark.createDataFrame(rows, "label string, damage_type string, base_padding double")


def taxonomy_dim(spark: SparkSession) -> DataFrame:
    rows = [(k, b, c) for k, (b, c) in TAXONOMY.items()]
    return spark.createDataFrame(rows, "label string, benchmark_label string, confidence double")


def benchmark_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b,) for b in BENCHMARK_LABELS], "benchmark_label string")


def group_dim(spark: SparkSession) -> DataFrame:
    rows = [(g, t) for g, ts in COMPATIBLE_GROUPS.items() for t in ts]
    return spark.createDataFrame(rows, "compat_group string, damage_type string")


def type_dim(spark: SparkSession) -> DataFrame:
    """Category, aliases and severity range of each damage type."""
    labels = {v: k for k, v in LABEL_NAMES.items()}
    rows = [(labels[t], t, c, al, lo, hi) for t, (c, al, lo, hi) in TYPE_DETAILS.items()]
    return spark.createDataFrame(
        rows,
        "label string, damage_type string, category string, aliases array<string>, "
        "severity_low double, severity_high double",
    )


def dims(spark: SparkSession) -> dict[str, DataFrame]:
    """All dimension frames by name."""
    return {
        "zones": zone_dim(spark),
        "padding": padding_dim(spark),
        "taxonomy": taxonomy_dim(spark),
        "benchmark": benchmark_dim(spark),
        "groups": group_dim(spark),
        "types": type_dim(spark),
    }
