"""Image records: per-image roll-up of shapes and the texts built from it.

Every per-image array below holds one entry per damage type or per 3x3 zone.
Single boxes stay rows (``image_boxes``), so an image with very many shapes
never becomes one huge value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import ALL_TYPES, SPATIAL_DISPLAY
from ..functions import geometry as G
from ..functions import labels as L
from ..functions import text as X
from .shapes import CORNERS, with_position, with_types


def counted(df: DataFrame, by: list[str], item: str, position: str, name: str = "counts") -> DataFrame:
    """Per group: array of (count, first position, item), one entry per item.

    Two aggregations: the first combines map-side, so a hot group is reduced to
    its few distinct items before it meets in one task.
    """
    per_item = df.groupBy(*by, item).agg(F.count(F.lit(1)).alias("n"), F.min(position).cast("bigint").alias("first"))
    entry = F.struct(F.col("n"), F.col("first"), F.col(item).alias("name"))
    return per_item.groupBy(*by).agg(F.collect_list(entry).alias(name))


def fixed_counts(item: str, position: str, names: list[str], name: str) -> tuple[list[Column], Column]:
    """Aggregates and final column for counts over a fixed list of items.

    Two plain numbers per item keep the aggregation in one hash pass: no lists
    are built and a hot group is one short row per task before the shuffle. An
    item outside the list fails the query instead of going missing.
    """
    aggs = [F.count(item).alias(f"_{name}_all")]
    entries, total = [], F.lit(0)
    for i, value in enumerate(names):
        hit = F.col(item) == value
        aggs += [F.count_if(hit).alias(f"_{name}_n{i}"), F.min(F.when(hit, F.col(position))).cast("bigint").alias(f"_{name}_p{i}")]
        n = F.col(f"_{name}_n{i}")
        entries.append(F.struct(n.alias("n"), F.col(f"_{name}_p{i}").alias("first"), F.lit(value).alias("name")))
        total = total + n
    built = F.filter(F.array(*entries), lambda e: e["n"] > 0)
    wrong = F.raise_error(F.lit(f"{item} holds values outside {names}")).cast(COUNTS)
    return aggs, F.when(F.col(f"_{name}_all") == total, built).otherwise(wrong).alias(name)


COUNTS = "array<struct<n:bigint,first:bigint,name:string>>"


def no_counts() -> Column:
    return F.array().cast(COUNTS)


def image_rollup(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """One record per image; images without valid shapes become clean records."""
    area = G.box_area(*[F.col(c) for c in CORNERS])
    typed = with_position(with_types(boxes.select("image_id", "shape_idx", "label", *CORNERS, "image_w", "image_h")))
    type_aggs, type_counts = fixed_counts("damage_type", "shape_idx", ALL_TYPES, "type_counts")
    zone_aggs, zone_counts = fixed_counts("spatial_zone", "shape_idx", list(SPATIAL_DISPLAY), "zone_counts")
    totals = (
        typed.withColumn("area", area)
        .groupBy("image_id")
        .agg(
            F.count(F.lit(1)).alias("total_defects"),
            F.sum("area").alias("total_bbox_area"),
            F.max("area").alias("max_defect_size"),
            F.min("area").alias("min_defect_size"),
            *type_aggs,
            *zone_aggs,
        )
        .select(
            "image_id", "total_defects", "total_bbox_area", "max_defect_size", "min_defect_size", type_counts, zone_counts
        )
    )
    joined = images.join(totals, "image_id", "left")
    zone = L.vehicle_zone(F.col("image_name"))
    wide = joined.withColumns(
        {
            "vehicle_zone": zone,
            "zone_description": L.zone_description(zone, "unknown area"),
            "zone_area": L.zone_area(zone),
            "type_counts": F.coalesce("type_counts", no_counts()),
            "zone_counts": F.coalesce("zone_counts", no_counts()),
        }
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    has_damage = F.col("total_defects").isNotNull()
    return wide.select(
        "image_id",
        "image_name",
        "image_w",
        "image_h",
        has_damage.alias("has_damage"),
        "vehicle_zone",
        "zone_description",
        "zone_area",
        zero("total_defects"),
        zero("total_bbox_area"),
        F.coalesce(F.col("total_bbox_area") / F.col("total_defects"), F.lit(0.0)).alias("avg_defect_size"),
        zero("max_defect_size"),
        zero("min_defect_size"),
        "type_counts",
        "zone_counts",
        dominant_of(F.col("type_counts")).alias("dominant_type"),
        F.when(has_damage, X.describe_damage(F.col("type_counts"), F.col("zone_description"), F.col("zone_area")))
        .otherwise(X.describe_clean(L.zone_description(F.col("vehicle_zone"), "vehicle"), F.col("zone_area")))
        .alias("description"),
    )


def dominant_of(counts: Column) -> Column:
    """Most frequent name; ties go to the one seen first; ``unknown`` when empty."""
    return F.coalesce(F.get(X.by_count(counts), F.lit(0))["name"], F.lit("unknown"))


def counts_map(counts: Column) -> Column:
    return F.map_from_entries(F.transform(counts, lambda c: F.struct(c["name"], c["n"])))


def dominant_type(df: DataFrame, by: list[str], item: str, position: str) -> DataFrame:
    """Most frequent item of each group, first-seen on ties, without a sort."""
    per_item = df.groupBy(*by, item).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    return per_item.groupBy(*by).agg(
        F.max_by(F.col(item), F.struct(F.col("n"), -F.col("first"))).alias("dominant_type"),
        F.sum("n").alias("total"),
    )


def spatial_distribution(boxes: DataFrame) -> DataFrame:
    """Long form: image, 3x3 zone, boxes and first position."""
    return (
        with_position(boxes)
        .groupBy("image_id", "spatial_zone")
        .agg(F.count(F.lit(1)).alias("n_defects"), F.min("shape_idx").alias("first_idx"))
    )


def image_boxes(boxes: DataFrame, part_size: int = 4096) -> DataFrame:
    """Nested box lists of image records, ordered by position.

    ``shape_idx`` is the position in the document, from 0. A record of more than
    ``part_size`` boxes is laid out as several rows; every row says how many
    (``n_parts``), and ``part`` 0 of 1 is the whole list.
    """
    box = F.struct(F.col("shape_idx"), F.array(*[F.col(c).cast("int") for c in CORNERS]).alias("bbox"))
    parts = (
        boxes.withColumn("part", F.floor(F.col("shape_idx") / part_size).cast("bigint"))
        .groupBy("image_id", "part")
        .agg(F.sort_array(F.collect_list(box)).alias("bboxes"))
    )
    counted = boxes.groupBy("image_id").agg((F.floor(F.max("shape_idx") / part_size) + 1).cast("bigint").alias("n_parts"))
    return parts.join(counted, "image_id")


def having_min_defects(boxes: DataFrame, minimum: int = 5) -> DataFrame:
    return boxes.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_defects")).filter(F.col("n_defects") >= minimum)


def attach_zone(df: DataFrame, zones: DataFrame, default: str = "unknown") -> DataFrame:
    """Left join with the zone dimension (ten rows), defaults for unknown zones."""
    out = df.join(F.broadcast(zones), "vehicle_zone", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(default)) for c in zones.columns if c != "vehicle_zone"})


def union_corpora(*dfs: DataFrame) -> DataFrame:
    """Rows of all corpora; columns missing from one are NULL there."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def describe_crops(crops: DataFrame, defects: DataFrame) -> DataFrame:
    """Crop texts from crops (``crop_id, has_damage, vehicle_zone``) and their defect rows.

    ``defects`` has ``crop_id, position, label``; numeric labels become names,
    other labels lose their underscores.
    """
    label = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.lit("unknown"))
    canonical = L.canonical_label(label)
    named = F.when(canonical != "unknown", canonical).otherwise(F.replace(label, F.lit("_"), F.lit(" ")))
    counts = counted(defects.withColumn("name", named), ["crop_id"], "name", "position")
    zone = F.col("vehicle_zone")
    text = X.describe_crop(
        F.col("has_damage"),
        F.col("counts"),
        F.coalesce(F.nullif(L.zone_description(zone, ""), F.lit("")), F.concat(F.lit("Vehicle zone "), zone)),
        F.coalesce(F.nullif(L.zone_area(zone, ""), F.lit("")), F.lit("unknown area")),
    )
    return crops.join(counts, "crop_id", "left").withColumn("text_description", text).drop("counts")
