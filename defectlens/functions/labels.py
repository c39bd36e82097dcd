"""Label, zone and name functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import LABEL_NAMES, SPATIAL_DISPLAY, TAXONOMY, UNKNOWN_TYPE, ZONES, lookup

# One pattern per file-name convention; group 1 is the zone.
ZONE_PATTERNS = {
    # "zona", "<digits>" tokens; an extension right after the digits is cut off
    "strip_ext": r"(?:^|_)zona_([0-9]+)(?=[._]|$)",
    # as above, but the token must be digits only
    "raw": r"(?:^|_)zona_([0-9]+)(?=_|$)",
    # "zone" spelling of the same tokens
    "zone_prefix": r"(?:^|_)zone_([0-9]+)(?=[._]|$)",
    # number glued to the first token, which is the data set number
    "dataset_prefix": r"(?:^|_)zona([0-9]+)(?=_|$)",
}


def vehicle_zone(name: Column, mode: str = "strip_ext") -> Column:
    """Vehicle zone written in a file name; ``unknown`` when there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(name, ZONE_PATTERNS[mode], 1), F.lit("")), F.lit("unknown"))


def zone_name(zone: Column) -> Column:
    return F.coalesce(lookup({k: v[0] for k, v in ZONES.items()}, zone), F.lit("unknown"))


def zone_description(zone: Column, default: str = "unknown") -> Column:
    return F.coalesce(lookup({k: v[1] for k, v in ZONES.items()}, zone), F.lit(default))


def zone_area(zone: Column, default: str = "unknown") -> Column:
    return F.coalesce(lookup({k: v[2] for k, v in ZONES.items()}, zone), F.lit(default))


def canonical_label(label: Column) -> Column:
    return F.coalesce(lookup(LABEL_NAMES, label), F.lit(UNKNOWN_TYPE))


def label_of(damage_type: Column) -> Column:
    """Inverse of :func:`canonical_label`; anything unknown is label 1."""
    return F.coalesce(lookup({v: k for k, v in LABEL_NAMES.items()}, damage_type), F.lit("1"))


def clean_label(label: Column) -> Column:
    """Lower case without surrounding white space."""
    return F.regexp_replace(F.lower(label), r"^\s+|\s+$", "")


def benchmark_label(label: Column) -> Column:
    return F.coalesce(lookup({k: v[0] for k, v in TAXONOMY.items()}, clean_label(label)), F.lit("Unknown"))


def is_mapped(label: Column) -> Column:
    return clean_label(label).isin(list(TAXONOMY))


def normalize_label(label: Column) -> Column:
    """Benchmark label, confidence, cleaned label and error code of a train label."""
    cleaned = clean_label(label)
    confidence = lookup({k: v[1] for k, v in TAXONOMY.items()}, cleaned)
    return F.struct(
        benchmark_label(label).alias("benchmark_label"),
        F.coalesce(confidence, F.lit(0.0)).alias("confidence"),
        cleaned.alias("original"),
        F.when(confidence.isNull(), F.concat(F.lit("NO_MAPPING_FOR_"), cleaned)).alias("error"),
    )


def in_label_space(label: Column, label_space: str) -> Column:
    """Label in the space both sides of a comparison are brought to."""
    if label_space == "raw":
        return label
    if label_space == "benchmark":
        return benchmark_label(label)
    raise ValueError(f"unknown label space: {label_space}")


def title(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def display_label(label: Column) -> Column:
    """Readable damage name for a label, a canonical type or a benchmark label."""
    return title(F.coalesce(lookup(LABEL_NAMES, label), label))


def display_zone(zone: Column) -> Column:
    """Readable text for a 3x3 zone; other texts pass through."""
    return F.coalesce(lookup(SPATIAL_DISPLAY, zone), zone)


def dominant_or_single(dominant: Column, single: Column, default: str = "unknown") -> Column:
    """First non-empty of the dominant and the single damage type."""
    return F.coalesce(F.nullif(dominant, F.lit("")), F.nullif(single, F.lit("")), F.lit(default))


def image_stem(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")
