"""Profiles, distributions, corpus statistics, orders and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import labels as L
from ...functions import vectors as V
from ...operators import evaluate as E
from ...operators import profile as P
from ...operators import rollup as U
from ...operators import shapes as S
from ...ranks import stored
from ..registry import big, query, r
from ..sql import bench, dot, norm, order_key
from ..views import order_key as key_column


def _zones(v):
    return v.images.select("image_id", L.vehicle_zone(F.col("image_name")).alias("vehicle_zone"))


@query(
    "a1_profile_totals",
    """SELECT count(*) AS total_images, sum(n_defects)::bigint AS total_defects, round(avg(n_defects), 6) AS mean_defects,
              median(n_defects)::double AS median_defects, round(stddev_pop(n_defects), 6) AS std_defects,
              min(n_defects) AS min_defects, max(n_defects) AS max_defects FROM fx_per_polygon_image""",
)
def _(v):
    return P.profile_totals(v.polygons).select(
        "total_images", "total_defects", r("mean_defects"), "median_defects", r("std_defects"), "min_defects", "max_defects"
    )


@query(
    "a2_type_distribution",
    """SELECT p.label, coalesce(l.damage_type, 'unknown') AS damage_type, n, round(n * 100.0 / sum(n) OVER (), 4) AS pct,
              round(max(n) OVER () / min(n) OVER ()::double, 4) AS imbalance_ratio, 'balanced' AS imbalance
       FROM (SELECT label, count(*) AS n FROM fx_polygons GROUP BY label) p LEFT JOIN dim_labels l USING (label)""",
)
def _(v):
    return P.type_distribution(v.polygons).select("label", "damage_type", "n", r("pct", 4), r("imbalance_ratio", 4), "imbalance")


@query(
    "a3_zone_distribution",
    """SELECT vehicle_zone, zone_name, count(*) AS n_images, vehicle_zone::bigint AS position
       FROM fx_images JOIN dim_zones USING (vehicle_zone) GROUP BY vehicle_zone, zone_name""",
)
def _(v):
    zoned = v.images.withColumn("vehicle_zone", L.vehicle_zone(F.col("image_name")))
    return P.zone_distribution(zoned).select("vehicle_zone", "zone_name", "n_images", big("position"))


@query(
    "a4_zone_type_matrix",
    "SELECT i.vehicle_zone, p.label, count(*) AS n FROM fx_polygons p JOIN fx_images i USING (image_id) GROUP BY ALL",
)
def _(v):
    return P.zone_type_matrix(v.polygons, _zones(v)).select("vehicle_zone", "label", "n")


@query(
    "a4_zone_type_top3",
    """SELECT vehicle_zone, label, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_zone ORDER BY n DESC, first_image, first_shape) AS rank FROM (
         SELECT vehicle_zone, label, count(*) AS n, min(image_id) AS first_image, arg_min(shape_idx, (image_id, shape_idx)) AS first_shape
         FROM fx_polygons JOIN fx_images USING (image_id) GROUP BY vehicle_zone, label)) WHERE rank <= 3""",
)
def _(v):
    return P.top_types_by_zone(v.polygons, _zones(v)).select("vehicle_zone", "label", "n", big("rank"))


@query(
    "a5_density_fixed",
    """SELECT image_id, CASE WHEN n_defects <= 5 THEN 'low' WHEN n_defects <= 15 THEN 'medium' ELSE 'high' END AS density FROM fx_per_polygon_image""",
)
def _(v):
    return P.density_class(P.defects_per_image(v.polygons)).select("image_id", "density")


@query(
    "a5_density_terciles",
    """SELECT image_id, CASE WHEN n_defects <= a THEN 'low' WHEN n_defects <= b THEN 'medium' ELSE 'high' END AS density
       FROM fx_per_image, (SELECT quantile_cont(n_defects, 0.33) AS a, quantile_cont(n_defects, 0.66) AS b FROM fx_per_image)""",
)
def _(v):
    return P.density_class(v.per_image, "terciles").select("image_id", "density")


@query(
    "a5_density_quartiles",
    """SELECT image_id, CASE WHEN n_defects <= a THEN 'very_low' WHEN n_defects <= b THEN 'low' WHEN n_defects <= c THEN 'medium' ELSE 'high' END AS density
       FROM fx_per_image, (SELECT quantile_cont(n_defects, 0.25) AS a, quantile_cont(n_defects, 0.5) AS b, quantile_cont(n_defects, 0.75) AS c FROM fx_per_image)""",
)
def _(v):
    return P.density_class(v.per_image, "quartiles").select("image_id", "density")


@query(
    "a6_density_share",
    """SELECT density, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM (
         SELECT CASE WHEN n_defects <= 5 THEN 'low' WHEN n_defects <= 15 THEN 'medium' ELSE 'high' END AS density FROM fx_per_polygon_image) GROUP BY density""",
)
def _(v):
    return P.density_share(P.density_class(P.defects_per_image(v.polygons))).select("density", "n", r("pct", 4))


@query(
    "a7_histogram",
    """SELECT bin, round(lo + bin * (hi - lo) / 50.0, 4) AS bin_start, count(*) AS n FROM (
         SELECT lo, hi, least(floor((area - lo) * 50.0 / (hi - lo)), 49)::bigint AS bin
         FROM fx_placed, (SELECT min(area)::double AS lo, max(area)::double AS hi FROM fx_placed)) GROUP BY bin, lo, hi""",
)
def _(v):
    measured = S.with_measures(v.polygons)
    return P.histogram(measured, "area", 50).select("bin", r("bin_start", 4), "n")


@query(
    "a8_image_rollup",
    """SELECT image_id, has_damage, vehicle_zone, zone_area, total_defects, total_bbox_area, round(avg_defect_size, 4) AS avg_defect_size,
              max_defect_size, min_defect_size, dominant_type, description FROM fx_records""",
)
def _(v):
    return v.records.select(
        "image_id", "has_damage", "vehicle_zone", "zone_area", "total_defects", "total_bbox_area", r("avg_defect_size", 4),
        "max_defect_size", "min_defect_size", "dominant_type", "description",
    )


@query("a8_label_map", "SELECT image_id, damage_type, n FROM fx_type_counts")
def _(v):
    damaged = v.records.filter("has_damage")
    return damaged.select("image_id", F.explode(U.counts_map(F.col("type_counts"))).alias("damage_type", "n"))


@query(
    "a8_image_boxes",
    """SELECT image_id, 0::bigint AS part, 1::bigint AS n_parts, count(*) AS n_boxes,
              string_agg(x_min || ',' || y_min || ',' || x_max || ',' || y_max, ' ' ORDER BY shape_idx, x_min, y_min) AS boxes FROM fx_boxes GROUP BY image_id""",
)
def _(v):
    parts = U.image_boxes(v.indexed_boxes)
    text = F.array_join(F.transform("bboxes", lambda b: F.array_join(b["bbox"].cast("array<string>"), ",")), " ")
    return parts.select("image_id", "part", "n_parts", F.size("bboxes").cast("bigint").alias("n_boxes"), text.alias("boxes"))


@query(
    "a9_dominant_type",
    "SELECT image_id, first(damage_type ORDER BY n DESC, first) AS dominant_type, sum(n)::bigint AS total FROM fx_type_counts GROUP BY image_id",
)
def _(v):
    return U.dominant_type(S.with_types(v.boxes), ["image_id"], "damage_type", "shape_idx")


@query("a10_spatial_distribution", "SELECT image_id, spatial_zone, n AS n_defects, first AS first_idx FROM fx_zone_counts")
def _(v):
    return U.spatial_distribution(v.boxes)


@query(
    "a12_region_stats",
    """SELECT breakdown, value, count(*) AS n, round(count(*) FILTER (usable) * 100.0 / count(*), 4) AS usable_pct FROM (
         SELECT 'type' AS breakdown, damage_type AS value, area BETWEEN 50 AND 300000 AS usable FROM fx_placed
         UNION ALL SELECT 'zone', spatial_zone, area BETWEEN 50 AND 300000 FROM fx_placed
         UNION ALL SELECT 'size', size_class, area BETWEEN 50 AND 300000 FROM fx_placed) GROUP BY breakdown, value""",
)
def _(v):
    placed = S.with_measures(S.with_position(S.with_types(v.polygons)))
    return P.region_stats(placed.withColumn("is_usable", F.col("area").between(50, 300_000))).select(
        "breakdown", "value", "n", r("usable_pct", 4)
    )


@query(
    "a13_norm_stats",
    f"""SELECT has_damage, count(*) AS n, round(avg({norm('embedding')}), 6) AS mean_norm, round(min({norm('embedding')}), 6) AS min_norm,
              round(max({norm('embedding')}), 6) AS max_norm FROM fx_vectors GROUP BY has_damage""",
)
def _(v):
    return P.norm_stats(v.vectors, ["has_damage"]).select("has_damage", "n", r("mean_norm"), r("min_norm"), r("max_norm"))


@query(
    "a13_component_stats",
    """SELECT count(*) AS n, round(avg(x), 6) AS mean_value, round(stddev_pop(x), 6) AS std_value, round(min(x), 6) AS min_value, round(max(x), 6) AS max_value
       FROM (SELECT unnest(embedding)::double AS x FROM fx_vectors)""",
)
def _(v):
    stats = P.component_stats(v.vectors)
    return stats.select("n", *[r(c) for c in stats.columns if c != "n"])


@query(
    "a14_index_stats",
    """SELECT count(*) AS n_vectors, 64::bigint AS embedding_dim, sum(total_defects)::bigint AS total_defects, 'visual' AS kind,
              round(sum(total_defects) / count(*)::double, 6) AS avg_defects_per_image FROM fx_vectors""",
)
def _(v):
    return P.index_stats(v.vectors).select("n_vectors", "embedding_dim", "total_defects", "kind", r("avg_defects_per_image"))


@query(
    "a14_index_distributions",
    """SELECT 'type' AS kind, label_raw AS value, count(*) AS n FROM fx_vectors GROUP BY label_raw
       UNION ALL SELECT 'zone', vehicle_zone, count(*) FROM fx_vectors GROUP BY vehicle_zone""",
)
def _(v):
    pairs = F.explode(
        F.array(
            F.struct(F.lit("type").alias("kind"), F.col("label_raw").alias("value")),
            F.struct(F.lit("zone").alias("kind"), F.col("vehicle_zone").alias("value")),
        )
    )
    return v.vectors.select(pairs.alias("p")).select("p.*").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a15_damage_split_stats",
    """SELECT vehicle_zone, count(*) AS n_images, count(*) FILTER (has_damage) AS n_with_damage,
              count(*) FILTER (NOT has_damage) AS n_without_damage, min(zone_description) AS zone_description FROM fx_records GROUP BY vehicle_zone""",
)
def _(v):
    return P.damage_split_stats(v.records)


@query(
    "a15_overall_split",
    """SELECT count(*) AS total_images, count(*) FILTER (has_damage) AS n_with_damage, round(count(*) FILTER (has_damage) * 100.0 / count(*), 4) AS pct_with_damage,
              sum(total_defects)::bigint AS total_defects, round(sum(total_defects) / count(*) FILTER (has_damage)::double, 6) AS avg_defects_damaged FROM fx_records""",
)
def _(v):
    return P.overall_damage_split(v.records).select(
        "total_images", "n_with_damage", r("pct_with_damage", 4), "total_defects", r("avg_defects_damaged")
    )


@query(
    "a16_taxonomy_coverage",
    """SELECT count(*) AS total_samples, count(t.label) AS mapped_samples, count(*) - count(t.label) AS unmapped_samples,
              round(count(t.label) * 100.0 / count(*), 4) AS coverage_percent FROM fx_polygons p LEFT JOIN dim_taxonomy t ON t.label = p.label""",
)
def _(v):
    return P.taxonomy_coverage(v.polygons).select("total_samples", "mapped_samples", "unmapped_samples", r("coverage_percent", 4))


@query(
    "a16_coverage_double_count",
    """SELECT count(*) + count(DISTINCT image_id) AS total_samples, count(*) + count(DISTINCT image_id) AS mapped_samples FROM fx_placed_boxes""",
)
def _(v):
    # one group per image: its dominant type and all its members are counted
    typed = S.with_types(v.boxes)
    dominant = U.dominant_type(typed, ["image_id"], "damage_type", "shape_idx")
    return P.taxonomy_coverage(P.cluster_label_uses(dominant, typed)).select("total_samples", "mapped_samples")


@query(
    "a16_label_distribution",
    f"""SELECT label, count(*) AS n, {bench('label')} AS benchmark_label, label <> '9' AS is_mapped FROM fx_polygons GROUP BY label""",
)
def _(v):
    return P.label_distribution(v.polygons)


@query(
    "a17_missing_classes",
    f"""SELECT benchmark_label FROM dim_benchmark WHERE benchmark_label NOT IN ('No damage', 'Unknown')
        AND benchmark_label NOT IN (SELECT {bench('label')} FROM fx_polygons)""",
)
def _(v):
    return P.missing_classes(v.polygons)


@query(
    "a22_retrieved_zones",
    "SELECT query_id, vehicle_zone, count(*) AS n FROM fx_seen GROUP BY ALL",
)
def _(v):
    from .search import seen

    return E.retrieved_zones(seen(v))


def _pair_mean(src: str, by: str) -> str:
    return f"""SELECT {by} n AS n_vectors, n * (n - 1) // 2 AS n_pairs, round(m, 6) AS mean_cosine FROM (
        SELECT {by.replace(',', '') + ',' if by else ''} count(*) AS n FROM {src} {'GROUP BY ' + by.replace(',', '') if by else ''}) JOIN (
        SELECT {'a.' + by if by else ''} avg({dot('a.embedding', 'b.embedding')} / ({norm('a.embedding')} * {norm('b.embedding')})) AS m
        FROM {src} a JOIN {src} b ON a.id < b.id {'AND a.' + by.replace(',', '') + ' = b.' + by.replace(',', '') if by else ''} {'GROUP BY a.' + by.replace(',', '') if by else ''})
        {'USING (' + by.replace(',', '') + ')' if by else 'ON true'}"""


@query(
    "a23_intra_group_similarity",
    f"""WITH five AS (SELECT * FROM (SELECT id, label_raw, embedding, row_number() OVER (PARTITION BY label_raw ORDER BY id) AS rn FROM fx_vectors) WHERE rn <= 5)
        SELECT label_raw, n_vectors, n_pairs, mean_cosine, CASE WHEN mean_cosine > 0.7 THEN 'excellent' WHEN mean_cosine > 0.5 THEN 'good' ELSE 'low' END AS verdict
        FROM ({_pair_mean('five', 'label_raw,')}) WHERE n_vectors >= 2""",
)
def _(v):
    return P.intra_group_similarity(v.vectors, "label_raw", "id").select("label_raw", "n_vectors", "n_pairs", r("mean_cosine"), "verdict")


@query(
    "a24_diversity",
    f"""WITH pick AS (SELECT id, embedding FROM fx_vectors ORDER BY {order_key('id')}, id LIMIT 100)
        SELECT n_vectors, n_pairs, round(1 - mean_cosine, 6) AS mean_distance, CASE WHEN 1 - mean_cosine > 0.3 THEN 'good' ELSE 'low' END AS verdict
        FROM ({_pair_mean('pick', '')})""",
)
def _(v):
    out = P.diversity(v.vectors, "id", 100, order=key_column("id"))
    return out.select("n_vectors", "n_pairs", r("mean_distance"), "verdict")


@query("a24_diversity_all", f"SELECT n_vectors, n_pairs, round(1 - mean_cosine, 6) AS mean_distance FROM ({_pair_mean('fx_vectors', '')})")
def _(v):
    return P.diversity(v.vectors, "id", None).select("n_vectors", "n_pairs", r("mean_distance"))


@query(
    "a25_verdict",
    """SELECT config, round(recall_at_5, 6) AS recall, CASE WHEN recall_at_5 > 0.6 THEN 'excellent' WHEN recall_at_5 > 0.4 THEN 'good'
              WHEN recall_at_5 > 0.2 THEN 'moderate' ELSE 'low' END AS verdict FROM fx_metrics""",
)
def _(v):
    from ...functions.text import verdict

    bands = [(0.6, "excellent"), (0.4, "good"), (0.2, "moderate")]
    return v.metrics.select("config", r("recall_at_5", 6, "recall"), verdict(F.col("recall_at_5"), bands, "low").alias("verdict"))


# -- windows, orders, set operations ------------------------------------------------


@query(
    "w3_top_types_per_image",
    """SELECT image_id, damage_type, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, first) AS rank FROM fx_type_counts) WHERE rank <= 2""",
)
def _(v):
    counts = S.with_types(v.boxes).groupBy("image_id", "damage_type").agg(F.count(F.lit(1)).alias("n"), F.min("shape_idx").alias("first"))
    return P.top_n(counts, ["image_id"], [F.desc("n"), F.asc("first")], 2).select("image_id", "damage_type", "n", big("rank"))


@query(
    "o1_rank_by_metric",
    "SELECT image_id, total_bbox_area FROM fx_records ORDER BY total_bbox_area DESC, image_id LIMIT 100",
)
def _(v):
    return E.rank_by(v.records.select("image_id", "total_bbox_area"), "total_bbox_area", "image_id", limit=100)


@query(
    "o2_order_by_count",
    """SELECT image_id, string_agg(damage_type, '>' ORDER BY n DESC, first) AS order_text FROM fx_type_counts GROUP BY image_id""",
)
def _(v):
    from ...functions.text import by_count

    counts = U.counted(S.with_types(v.boxes), ["image_id"], "damage_type", "shape_idx")
    names = F.transform(by_count(F.col("counts")), lambda c: c["name"])
    return counts.select("image_id", F.array_join(names, ">").alias("order_text"))


@query(
    "o4_best_worst",
    """SELECT vehicle_zone, arg_max(image_id, (total_bbox_area, -image_id)) AS best_image, arg_min(image_id, (total_bbox_area, image_id)) AS worst_image
       FROM fx_records GROUP BY vehicle_zone""",
)
def _(v):
    return v.records.groupBy("vehicle_zone").agg(
        F.max_by("image_id", F.struct(F.col("total_bbox_area"), -F.col("image_id"))).alias("best_image"),
        F.min_by("image_id", F.struct(F.col("total_bbox_area"), F.col("image_id"))).alias("worst_image"),
    )


@query(
    "u2_merge_results",
    """SELECT config, round(recall_at_5, 6) AS recall_at_5, 'left' AS side FROM fx_metrics WHERE config <> 'visual_low'
       UNION ALL SELECT config, round(recall_at_1, 6), 'right' FROM fx_metrics WHERE config = 'visual_low'""",
)
def _(v):
    metrics = stored(v.metrics)  # a row for each configuration, read three times
    left = metrics.select("config", r("recall_at_5"), F.lit("left").alias("side"))
    right = metrics.filter("config = 'visual_low'").select("config", r("recall_at_1", 6, "recall_at_5"), F.lit("right").alias("side"))
    return E.merge_results(left, right)


_SETS = """SELECT image_id, list_distinct(list(damage_type)) AS a, list_distinct(list(CASE WHEN n > 1 THEN damage_type END)) AS b FROM fx_type_counts GROUP BY image_id"""


@query("u3_overlap_size", f"SELECT image_id, len(list_intersect(a, b))::bigint AS n_common FROM ({_SETS})")
def _(v):
    counts = U.counted(S.with_types(v.boxes), ["image_id"], "damage_type", "shape_idx")
    a, b = _two_sets()
    return counts.select("image_id", E.overlap_size(a, b).cast("bigint").alias("n_common"))


@query(
    "u4_set_difference",
    f"SELECT image_id, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS rest FROM ({_SETS})",
)
def _(v):
    counts = U.counted(S.with_types(v.boxes), ["image_id"], "damage_type", "shape_idx")
    a, b = _two_sets()
    return counts.select("image_id", F.array_join(F.array_sort(E.set_difference(a, b)), ",").alias("rest"))


def _two_sets():
    counts = F.col("counts")
    names = lambda c: F.transform(c, lambda x: x["name"])
    return names(counts), names(F.filter(counts, lambda x: x["n"] > 1))


@query(
    "v1_norm_and_normalize",
    f"""SELECT id, round({norm('embedding')}, 6) AS norm, round({norm('embedding')} / {norm('embedding')}, 6) AS unit_norm,
               round(embedding[1]::double / {norm('embedding')}, 6) AS first_value FROM fx_vectors""",
)
def _(v):
    unit = V.l2_normalize(F.col("embedding"))
    return v.vectors.select(
        "id", r(V.l2_norm(F.col("embedding")), 6, "norm"), r(V.l2_norm(unit), 6, "unit_norm"), r(F.get(unit, F.lit(0)), 6, "first_value")
    )


@query(
    "v2_fuse_concat",
    f"""SELECT id, round(0.6 * v[1]::double / {norm('v')} / sqrt(0.52::double), 6) AS first_value, round(0.4 * t[32]::double / {norm('t')} / sqrt(0.52::double), 6) AS last_value
        FROM (SELECT id, embedding[1:32] AS v, embedding[33:64] AS t FROM fx_vectors)""",
)
def _(v):
    fused = V.fuse_concat(F.col("visual"), F.col("text_part"))
    return v.parts.select("id", fused.alias("f")).select(
        "id", r(F.get("f", F.lit(0)), 6, "first_value"), r(F.get("f", F.lit(63)), 6, "last_value")
    )


@query(
    "v3_fuse_mean",
    f"""SELECT id, round((v[1]::double / {norm('v')} + t[1]::double / {norm('t')}) / 2
              / sqrt((2 + 2 * {dot('v', 't')} / {norm('v')} / {norm('t')}) / 4), 6) AS average_first,
              round((0.6 * v[1]::double / {norm('v')} + 0.4 * t[1]::double / {norm('t')})
              / sqrt(0.52 + 0.48 * {dot('v', 't')} / {norm('v')} / {norm('t')}), 6) AS weighted_first
        FROM (SELECT id, embedding[1:32] AS v, embedding[33:64] AS t FROM fx_vectors)""",
)
def _(v):
    first = lambda mode: F.get(V.fuse_mean(F.col("visual"), F.col("text_part"), mode), F.lit(0))
    return v.parts.select("id", r(first("average"), 6, "average_first"), r(first("weighted"), 6, "weighted_first"))


@query(
    "v5_vector_audit",
    """SELECT count(*) AS n_vectors, count(*) FILTER (id % 11 = 1) AS n_missing, count(*) FILTER (id % 11 IN (3, 4)) AS n_bad,
              count(*) FILTER (id % 11 = 2) AS n_zero, count(*) FILTER (id % 11 NOT IN (1, 2, 3, 4)) AS n_ok FROM fx_vectors""",
)
def _(v):
    return P.vector_audit(v.damaged_vectors)


@query("v6_cosine", f"SELECT id, round({dot('v', 't')} / ({norm('v')} * {norm('t')}), 6) AS cosine FROM (SELECT id, embedding[1:32] AS v, embedding[33:64] AS t FROM fx_vectors)")
def _(v):
    return v.parts.select("id", r(V.cosine(F.col("visual"), F.col("text_part")), 6, "cosine"))


@query(
    "v7_l2sq_similarity",
    f"""SELECT id, round(d, 6) AS distance, round((1 - d) * 100, 6) AS similarity_pct FROM (
          SELECT id, list_sum(list_transform(list_zip(v, t), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))) AS d
          FROM (SELECT id, embedding[1:32] AS v, embedding[33:64] AS t FROM fx_vectors))""",
)
def _(v):
    d = V.l2sq(F.col("visual"), F.col("text_part"))
    return v.parts.select("id", r(d, 6, "distance"), r(V.similarity_pct(d), 6, "similarity_pct"))
