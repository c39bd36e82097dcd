"""Projections and scalar geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...dims import type_dim
from ...functions import geometry as G
from ...functions import labels as L
from ...operators import shapes as S
from ...operators.regions import plan_regions
from ..registry import big, query, r
from ..sql import near_edge, size_class



def _corners():
    return [F.col(c) for c in S.CORNERS]


@query(
    "p1_vehicle_zone",
    """SELECT image_id, vehicle_zone AS strip_ext, vehicle_zone AS raw_token, 'unknown' AS zone_prefix, '1' AS dataset_prefix
       FROM fx_images""",
)
def _(v):
    name = F.col("image_name")
    return v.images.select(
        "image_id",
        L.vehicle_zone(name).alias("strip_ext"),
        L.vehicle_zone(name, "raw").alias("raw_token"),
        L.vehicle_zone(name, "zone_prefix").alias("zone_prefix"),
        L.vehicle_zone(name, "dataset_prefix").alias("dataset_prefix"),
    )


@query("p2_polygons_only", "SELECT image_id, shape_idx, label FROM fx_polygons")
def _(v):
    return S.polygons_only(v.shapes).select("image_id", "shape_idx", "label")


@query("p3_without_odd_label", "SELECT label, count(*) AS n FROM fx_polygons WHERE label <> '9' GROUP BY label")
def _(v):
    return S.polygons_only(v.shapes, drop_odd_label=True).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("p4_bbox_from_points", "SELECT image_id, shape_idx, x_min, y_min, x_max, y_max FROM fx_polygons")
def _(v):
    return S.with_boxes(v.points).select("image_id", "shape_idx", *[big(c) for c in S.CORNERS])


@query("p4_bbox_late", "SELECT image_id, shape_idx, x_min, y_min, x_max, y_max FROM fx_polygons")
def _(v):
    return S.with_boxes(v.points, late=True).select("image_id", "shape_idx", *[big(c) for c in S.CORNERS])


@query(
    "p5_clamp_bbox",
    """SELECT image_id, shape_idx, greatest(0, x_min - 1300)::bigint AS x_min, greatest(0, y_min - 1000)::bigint AS y_min,
              least(image_w, x_max + 1300)::bigint AS x_max, least(image_h, y_max + 1000)::bigint AS y_max FROM fx_polygons""",
)
def _(v):
    shifted = v.polygons.withColumns(
        {
            "x_min": F.col("x_min") - 1300, "y_min": F.col("y_min") - 1000,
            "x_max": F.col("x_max") + 1300, "y_max": F.col("y_max") + 1000,
        }
    )
    return S.with_clamped_boxes(shifted).select("image_id", "shape_idx", *[big(c) for c in S.CORNERS])


@query(
    "p6_bbox_measures",
    """SELECT image_id, shape_idx, x_max - x_min AS box_w, y_max - y_min AS box_h, (x_max - x_min) * (y_max - y_min) AS area,
              (x_min + x_max) // 2 AS cx, (y_min + y_max) // 2 AS cy, round((x_max - x_min) / (y_max - y_min)::double, 6) AS aspect
       FROM fx_polygons""",
)
def _(v):
    return S.with_measures(v.polygons).select("image_id", "shape_idx", "box_w", "box_h", "area", "cx", "cy", r("aspect"))


@query(
    "p7_bbox_iou_distance",
    """SELECT image_id, shape_idx, round(CASE WHEN ix < 0 OR iy < 0 THEN 0 ELSE ix * iy / (a + b - ix * iy)::double END, 6) AS iou,
              round(sqrt(((cx - hx) * (cx - hx) + (cy - hy) * (cy - hy))::double), 6) AS distance
       FROM (SELECT p.image_id, p.shape_idx, least(p.x_max, f.x_max) - greatest(p.x_min, f.x_min) AS ix,
                    least(p.y_max, f.y_max) - greatest(p.y_min, f.y_min) AS iy,
                    (p.x_max - p.x_min) * (p.y_max - p.y_min) AS a, (f.x_max - f.x_min) * (f.y_max - f.y_min) AS b,
                    (p.x_min + p.x_max) // 2 AS cx, (p.y_min + p.y_max) // 2 AS cy, (f.x_min + f.x_max) // 2 AS hx, (f.y_min + f.y_max) // 2 AS hy
             FROM fx_polygons p JOIN (SELECT image_id, arg_min(x_min, shape_idx) AS x_min, arg_min(y_min, shape_idx) AS y_min,
                    arg_min(x_max, shape_idx) AS x_max, arg_min(y_max, shape_idx) AS y_max FROM fx_polygons GROUP BY image_id) f USING (image_id))""",
)
def _(v):
    # every box against the first box of its image: linear, not all pairs
    first = v.polygons.groupBy("image_id").agg(*[F.min_by(c, "shape_idx").alias(f"f_{c}") for c in S.CORNERS])
    joined = v.polygons.select("image_id", "shape_idx", *S.CORNERS).join(first, "image_id")
    related = S.relate_to_box(joined, [f"f_{c}" for c in S.CORNERS])
    return related.select("image_id", "shape_idx", r("iou"), r("distance"))


@query(
    "p8_filter_area_fixed",
    "SELECT label, count(*) AS n FROM fx_placed WHERE area BETWEEN 50 AND 300000 GROUP BY label",
)
def _(v):
    return S.filter_area(v.polygons).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p8_filter_area_adaptive",
    """WITH lim AS (SELECT greatest(50.0::double, quantile_cont(area, 0.05) * 0.1::double) AS lo, quantile_cont(area, 0.99) * 1.5::double AS hi FROM fx_placed)
       SELECT label, count(*) AS n, round(min(lo), 4) AS area_low, round(min(hi), 4) AS area_high
       FROM fx_placed, lim WHERE area >= lo AND area <= hi GROUP BY label""",
)
def _(v):
    limits = S.adaptive_area_limits(v.polygons)
    kept = S.filter_area_adaptive(v.polygons).withColumns(
        {"lo": limits.select("area_low").scalar(), "hi": limits.select("area_high").scalar()}
    )
    return kept.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), r(F.min("lo"), 4, "area_low"), r(F.min("hi"), 4, "area_high")
    )


@query(
    "p9_canonical_label",
    """SELECT p.label, coalesce(l.damage_type, 'unknown') AS damage_type, coalesce(l.label, '1') AS back, count(*) AS n
       FROM fx_polygons p LEFT JOIN dim_labels l USING (label) GROUP BY ALL""",
)
def _(v):
    typed = v.polygons.withColumn("damage_type", L.canonical_label(F.col("label")))
    return (
        typed.withColumn("back", L.label_of(F.col("damage_type"))).groupBy("label", "damage_type", "back").agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "p10_normalize_label",
    """SELECT v.id, coalesce(t.benchmark_label, 'Unknown') AS benchmark_label, coalesce(t.confidence, 0.0)::double AS confidence,
              lower(v.label_raw) AS original, CASE WHEN t.label IS NULL THEN 'NO_MAPPING_FOR_' || v.label_raw END AS error
       FROM fx_vectors v LEFT JOIN dim_taxonomy t ON t.label = v.label_raw""",
)
def _(v):
    spaced = F.concat(F.lit("  "), F.upper("label_raw"), F.lit("\t"))
    return v.vectors.select("id", L.normalize_label(spaced).alias("s")).select("id", "s.*")


@query(
    "p11_display_names",
    """SELECT damage_type, spatial_zone,
              array_to_string(list_transform(string_split(damage_type, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS shown_type,
              d.shown AS shown_zone, count(*) AS n FROM fx_placed JOIN dim_display d USING (spatial_zone) GROUP BY ALL""",
)
def _(v):
    placed = S.with_position(S.with_types(v.polygons))
    return (
        placed.groupBy("damage_type", "spatial_zone")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"shown_type": L.display_label(F.col("damage_type")), "shown_zone": L.display_zone(F.col("spatial_zone"))})
    )


@query(
    "p12_zone_details",
    """SELECT i.image_id, z.zone_name, z.zone_description, z.zone_area FROM fx_images i JOIN dim_zones z USING (vehicle_zone)""",
)
def _(v):
    zone = L.vehicle_zone(F.col("image_name"))
    return v.images.select(
        "image_id", L.zone_name(zone).alias("zone_name"), L.zone_description(zone).alias("zone_description"), L.zone_area(zone).alias("zone_area")
    )


@query(
    "p13_spatial_zone",
    "SELECT image_id, shape_idx, round(rel_x, 6) AS rel_x, round(rel_y, 6) AS rel_y, spatial_zone FROM fx_placed",
)
def _(v):
    return S.with_position(v.polygons).select("image_id", "shape_idx", r("rel_x"), r("rel_y"), "spatial_zone")


@query(
    "p14_size_class",
    f"""SELECT image_id, shape_idx, size_class, {size_class('area * 40')} AS class_40, {size_class('area * 400')} AS class_400 FROM fx_placed""",
)
def _(v):
    w, h = F.col("image_w"), F.col("image_h")
    area = G.box_area(*_corners())
    return v.polygons.select(
        "image_id",
        "shape_idx",
        G.size_class(area, w, h).alias("size_class"),
        G.size_class(area * 40, w, h).alias("class_40"),
        G.size_class(area * 400, w, h).alias("class_400"),
    )


@query(
    "p15_near_edge",
    f"SELECT image_id, shape_idx, near_edge, {near_edge('rel_x', 'rel_y', '0.4')} AS near_wide_edge FROM fx_placed",
)
def _(v):
    return S.with_position(v.polygons).select(
        "image_id", "shape_idx", "near_edge", G.near_edge(F.col("rel_x"), F.col("rel_y"), 0.4).alias("near_wide_edge")
    )


_PADDED = """
    SELECT b.*, greatest(0.15::double, least(0.60::double, coalesce(p.base_padding, 0.35)::double
             * CASE WHEN area < 500 THEN 1.8 WHEN area < 1500 THEN 1.5 WHEN area < 5000 THEN 1.2 WHEN area < 15000 THEN 1.0
                    WHEN area < 50000 THEN 0.85 ELSE 0.7 END::double
             * CASE WHEN rel_x < 0.1 OR rel_x > 0.9 OR rel_y < 0.1 OR rel_y > 0.9 THEN 0.7 ELSE 1.0 END::double
             * CASE WHEN area::double / (image_w * image_h) > 0.15 THEN 0.6 WHEN area::double / (image_w * image_h) > 0.08 THEN 0.8 ELSE 1.0 END::double)) AS factor
    FROM fx_placed b LEFT JOIN dim_padding p USING (label)"""


def _padded(v):
    placed = S.with_position(S.with_types(v.polygons)).withColumn("area", G.box_area(*_corners()))
    factor = G.padding_factor(
        F.col("area"), F.col("damage_type"), F.col("rel_x"), F.col("rel_y"), F.col("image_w"), F.col("image_h")
    )
    return placed.withColumn("factor", factor)


@query("p16_padding_factor", f"SELECT image_id, shape_idx, round(factor, 6) AS padding_factor FROM ({_PADDED})")
def _(v):
    return _padded(v).select("image_id", "shape_idx", r("factor", 6, "padding_factor"))


@query(
    "p17_crop_window",
    f"""SELECT image_id, shape_idx, greatest(0, x_min - floor((x_max - x_min) * factor)::bigint) AS x1,
              greatest(0, y_min - floor((y_max - y_min) * factor)::bigint) AS y1,
              least(image_w, x_max + floor((x_max - x_min) * factor)::bigint) AS x2, greatest(0, x_min - 30) AS fixed_x1
       FROM ({_PADDED})""",
)
def _(v):
    x1, y1, x2, y2 = _corners()
    w, h = F.col("image_w"), F.col("image_h")
    grow = lambda a, b: F.floor((b - a) * F.col("factor")).cast("bigint")
    padded = _padded(v).withColumns(
        {
            "a": G.crop_window(x1, y1, x2, y2, w, h, grow(x1, x2), grow(y1, y2)),
            "b": G.crop_window(x1, y1, x2, y2, w, h, F.lit(30), F.lit(30)),
        }
    )
    return padded.select("image_id", "shape_idx", "a.x1", "a.y1", "a.x2", F.col("b.x1").alias("fixed_x1"))


@query(
    "p18_letterbox",
    """SELECT image_id, shape_idx, round(scale, 6) AS scale, floor(w * scale)::bigint AS new_w, floor(h * scale)::bigint AS new_h,
              (448 - floor(w * scale)::bigint) // 2 AS x_offset, (448 - floor(h * scale)::bigint) // 2 AS y_offset
       FROM (SELECT image_id, shape_idx, x_max - x_min AS w, y_max - y_min AS h,
                    least(448.0::double / (x_max - x_min), 448.0::double / (y_max - y_min)) AS scale FROM fx_polygons)""",
)
def _(v):
    fitted = v.polygons.withColumn("l", G.letterbox(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")))
    return fitted.select("image_id", "shape_idx", r("l.scale", 6, "scale"), "l.new_w", "l.new_h", "l.x_offset", "l.y_offset")


@query(
    "p19_region_id",
    """SELECT image_id, shape_idx, replace(image_name, '.jpg', '') || '_roi_' || printf('%03d', shape_idx % 1000) AS crop_id,
              replace(image_name, '.jpg', '') || '_grid_' || x_min || '_' || y_min AS cell_id
       FROM fx_polygons JOIN fx_images USING (image_id)""",
)
def _(v):
    named = v.polygons.join(v.images.select("image_id", "image_name"), "image_id")
    stem = L.image_stem(F.col("image_name"))
    return named.select(
        "image_id",
        "shape_idx",
        G.region_id(stem, "roi", F.col("shape_idx") % 1000).alias("crop_id"),
        G.region_id(stem, "grid", F.col("x_min"), F.col("y_min")).alias("cell_id"),
    )


@query(
    "p21_padding_simple",
    """SELECT image_id, shape_idx, round(coalesce(p.base_padding, 0.30)::double * CASE WHEN area < 1000 THEN 1.5 WHEN area > 10000 THEN 0.8 ELSE 1.0 END::double, 6) AS padding_factor
       FROM fx_placed LEFT JOIN dim_padding p USING (label)""",
)
def _(v):
    typed = S.with_types(v.polygons)
    return typed.select(
        "image_id", "shape_idx", r(G.padding_factor(G.box_area(*_corners()), F.col("damage_type"), mode="simple"), 6, "padding_factor")
    )


@query(
    "p22_match_types",
    """SELECT v.id, a.damage_type, t.category FROM fx_vectors v JOIN dim_labels l ON l.label = v.label_raw
       JOIN dim_types t0 ON t0.damage_type = l.damage_type
       JOIN (SELECT damage_type, min(alias) AS term FROM dim_aliases GROUP BY 1) m ON m.damage_type = l.damage_type
       JOIN dim_aliases a ON a.alias = m.term JOIN dim_types t ON t.damage_type = a.damage_type""",
)
def _(v):
    from ...operators.search import match_types

    types = type_dim(v.spark)
    # the term asked for each vector is the first alias of its type, written with spaces
    first = types.select("damage_type", F.array_min(F.array_append("aliases", F.col("damage_type"))).alias("alias"))
    asked = v.vectors.select("id", L.canonical_label(F.col("label_raw")).alias("damage_type")).join(F.broadcast(first), "damage_type")
    terms = asked.select("id", F.initcap(F.replace("alias", F.lit("_"), F.lit(" "))).alias("term"))
    return match_types(terms, types).select("id", "damage_type", "category")


@query(
    "p23_embedding_kind",
    "SELECT id, 'visual' AS kind, 'hybrid' AS wide_kind FROM fx_vectors",
)
def _(v):
    from ...functions.vectors import embedding_kind

    wide = F.flatten(F.array_repeat("embedding", 22))
    return v.vectors.select("id", embedding_kind(F.col("embedding")).alias("kind"), embedding_kind(wide).alias("wide_kind"))




@query(
    "g8_individual_regions",
    f"""SELECT image_id, shape_idx, greatest(0, x_min - floor((x_max - x_min) * factor)::bigint) AS crop_x1,
              (x_min + x_max) // 2 AS center_x, area, round(factor, 6) AS padding_factor, spatial_zone, size_class, near_edge
       FROM ({_PADDED}) WHERE area BETWEEN 50 AND 500000""",
)
def _(v):
    return plan_regions(v.images, v.polygons, "individual").select(
        "image_id", "shape_idx", "crop_x1", "center_x", "area", r("padding_factor"), "spatial_zone", "size_class", "near_edge"
    )
