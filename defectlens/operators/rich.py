"""Long damage contexts: part of the vehicle, plain wording and spatial pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import FRIENDLY, FRIENDLY_DEFAULT, PARTS, lookup
from ..functions import labels as L
from ..functions import text as X

CLUSTERED = "defects clustered together, suggesting single impact event"
SPREAD = "defects distributed across area, multiple impact points"
ISOLATED = "isolated damage"


def specific_part(zone_name: Column, rel_y: Column) -> Column:
    """Part of the vehicle from the zone and the vertical third."""
    third = F.when(rel_y < 0.33, "top").when(rel_y < 0.67, "center").otherwise("bottom")
    parts = {f"{z}/{t}": p for (z, t), p in PARTS.items()}
    rest = F.concat(F.replace(zone_name, F.lit("_"), F.lit(" ")), F.lit(" panel"))
    return F.coalesce(lookup(parts, F.concat_ws("/", zone_name, third)), rest)


def spatial_pattern(n_boxes: Column, mean_pair_distance: Column) -> Column:
    return F.when(n_boxes <= 1, ISOLATED).when(mean_pair_distance < 100, CLUSTERED).otherwise(SPREAD)


def describe_rich(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds ``rich_text`` to image records.

    ``records`` comes from ``image_rollup`` plus ``rel_y`` (vertical centre of the
    damage); ``pairs`` is ``pair_stats`` of the same boxes.
    """
    named = records.withColumn("zone_name", L.zone_name(F.col("vehicle_zone")))
    joined = named.join(pairs.select("image_id", "n_boxes", "mean_pair_distance"), "image_id", "left")
    friendly = lambda t: F.coalesce(lookup(FRIENDLY, t), F.lit(FRIENDLY_DEFAULT))
    types = F.array_join(
        F.transform(
            X.by_first(F.col("type_counts")),
            lambda c: F.concat(
                F.replace(c["name"], F.lit("_"), F.lit(" ")), F.lit(" ("), friendly(c["name"]), F.lit(", "),
                c["n"].cast("string"), F.lit(" instance"), X.plural(c["n"]), F.lit(")"),
            ),
        ),
        ", ",
    )
    part = specific_part(F.col("zone_name"), F.coalesce(F.col("rel_y"), F.lit(0.5)))
    place = F.concat(F.lit("Vehicle zone: "), F.col("zone_name"), F.lit(" ("), F.col("zone_area"), F.lit(" area). "))
    damaged = F.concat(
        place, F.lit("Affected part: "), part, F.lit(". Damage types: "), types, F.lit(". Spatial pattern: "),
        spatial_pattern(F.coalesce(F.col("n_boxes"), F.lit(0)), F.col("mean_pair_distance")), F.lit("."),
    )
    clean = F.concat(
        place, F.lit("Inspected part: "), part,
        F.lit(". Surface condition: Clean paint, no scratches or dents detected. Panel integrity: Normal alignment, intact surface."),
    )
    return joined.withColumn("rich_text", F.when(F.col("has_damage"), damaged).otherwise(clean))
