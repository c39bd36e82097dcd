"""Descriptions, contexts, prompts and stored answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import labels as L
from ...functions import text as X
from ...operators import evaluate as E
from ...operators import rollup as U
from ...operators import shapes as S
from ...operators.rich import CLUSTERED, ISOLATED, SPREAD, describe_rich
from ...ranks import stored
from ..registry import query

_PLACE = "' on ' || z.zone_description || ' (' || z.zone_area || ' area)'"


def _described(mode: str, default: str = "unknown area"):
    def run(v):
        zone = F.col("vehicle_zone")
        return v.records.filter("has_damage").select(
            "image_id",
            X.describe_damage(F.col("type_counts"), L.zone_description(zone, default), L.zone_area(zone), mode).alias("text"),
        )

    return run


query(
    "t1_describe_full",
    f"SELECT image_id, t.and_text || {_PLACE} AS text FROM fx_texts t JOIN fx_images i USING (image_id) JOIN dim_zones z USING (vehicle_zone)",
)(_described("full"))
query(
    "t1_describe_short",
    f"SELECT image_id, t.and_text || replace({_PLACE}, ' area)', ')') AS text FROM fx_texts t JOIN fx_images i USING (image_id) JOIN dim_zones z USING (vehicle_zone)",
)(_described("short"))


@query(
    "t2_describe_v1",
    f"""SELECT i.image_id, coalesce(t.comma_text || {_PLACE}, 'no visible damage') AS text
        FROM fx_images i JOIN dim_zones z USING (vehicle_zone) LEFT JOIN fx_texts t USING (image_id)""",
)
def _(v):
    return v.records.select(
        "image_id", X.describe_damage(F.col("type_counts"), F.col("zone_description"), F.col("zone_area"), "v1").alias("text")
    )


@query(
    "t3_describe_v2",
    f"""SELECT i.image_id, coalesce(t.spaced_text, 'no visible damage') || {_PLACE} AS text
        FROM fx_images i JOIN dim_zones z USING (vehicle_zone) LEFT JOIN fx_texts t USING (image_id)""",
)
def _(v):
    return v.records.select(
        "image_id", X.describe_damage(F.col("type_counts"), F.col("zone_description"), F.col("zone_area"), "v2").alias("text")
    )


@query(
    "t4_describe_clean",
    f"SELECT i.image_id, 'No visible damage' || {_PLACE} AS text FROM fx_images i JOIN dim_zones z USING (vehicle_zone)",
)
def _(v):
    zone = L.vehicle_zone(F.col("image_name"))
    return v.images.select("image_id", X.describe_clean(L.zone_description(zone, "vehicle"), L.zone_area(zone)).alias("text"))


@query(
    "t5_describe_crop",
    """SELECT i.image_id AS crop_id, CASE WHEN s.image_id IS NULL THEN 'Clean surface of ' || z.zone_description || ' (' || z.zone_area || '). No defects visible. Inspection grid section.'
              WHEN t.image_id IS NULL THEN 'Damaged surface on ' || z.zone_description || ' (' || z.zone_area || '). Unspecified defects.'
              ELSE t.first_text || ' on ' || z.zone_description || ' (' || z.zone_area || '). Specific defects visible: ' || t.first_names || '.' END AS text_description
       FROM fx_images i JOIN dim_zones z USING (vehicle_zone) LEFT JOIN fx_texts t USING (image_id)
       LEFT JOIN (SELECT DISTINCT image_id FROM fx_shapes) s USING (image_id)""",
)
def _(v):
    have = v.shapes.select("image_id").distinct().withColumn("_h", F.lit(1))
    crops = v.images.join(have, "image_id", "left").select(
        F.col("image_id").alias("crop_id"), F.col("_h").isNotNull().alias("has_damage"), L.vehicle_zone(F.col("image_name")).alias("vehicle_zone")
    )
    defects = v.boxes.select(F.col("image_id").alias("crop_id"), F.col("shape_idx").alias("position"), "label")
    return U.describe_crops(crops, defects).select("crop_id", "text_description")


@query(
    "t6_topic_text",
    "SELECT image_id, replace(dominant_type, '_', ' ') || ' damage' AS topic FROM fx_records",
)
def _(v):
    kind = L.dominant_or_single(F.col("dominant_type"), F.lit(None).cast("string"))
    return v.records.select("image_id", X.topic_text(kind).alias("topic"))


@query(
    "t7_context_crops",
    f"""SELECT query_id, '## Similar Verified Cases:' || chr(10) || chr(10) || string_agg(chr(10) || '### Example ' || rank || ':' || chr(10) || '- **Damage Type**: '
              || damage_type || chr(10) || '- **Vehicle Area**: ' || vehicle_zone || chr(10) || '- **Similarity**: ' || printf('%.1f', (1 - distance) * 100) || '%'
              || CASE WHEN t.confidence < 0.95 THEN chr(10) || '- **Note**: Approximate match (original: ' || retrieved_type || ')' ELSE '' END, chr(10) ORDER BY rank) AS context
        FROM fx_seen s LEFT JOIN dim_taxonomy t ON t.label = s.retrieved_type WHERE rank <= 3 GROUP BY query_id""",
)
def _(v):
    from .search import seen

    rows = seen(v).withColumns(
        {"spatial_zone": F.col("vehicle_zone"), "all_damage_types": F.array("damage_type")}
    )
    found = E.context_crops(rows, include_confidence=True)
    return E.with_missing(found, v.queries, ["query_id"], E.NO_CROPS)


@query(
    "t8_context_images",
    """SELECT s.query_id, '## Similar Verified Cases from Database:' || chr(10) || chr(10) || string_agg(chr(10) || '### Example ' || rank || ':' || chr(10)
              || '**Description**: ' || r.description || chr(10) || '**Similarity**: ' || printf('%.1f', (1 - s.distance) * 100) || '%' || chr(10)
              || '**Total defects**: ' || r.total_defects || chr(10) || '**Damage types**: ' || coalesce(b.types, '') || chr(10)
              || '**Vehicle zone**: ' || r.zone_description || ' (' || r.zone_area || ')'
              || coalesce(chr(10) || '**Spatial distribution**: ' || p.spatial_text, '') || chr(10), chr(10) ORDER BY rank) AS context
       FROM fx_top5 s JOIN fx_records r ON r.image_id = s.id LEFT JOIN fx_spatial_texts p ON p.image_id = s.id
       LEFT JOIN (SELECT image_id, string_agg(t.benchmark_label, ', ' ORDER BY n DESC, first) AS types
                  FROM fx_type_counts c JOIN dim_taxonomy t ON t.label = c.damage_type GROUP BY image_id) b ON b.image_id = s.id
       WHERE rank <= 3 GROUP BY s.query_id""",
)
def _(v):
    from .search import self_free_top5

    # vector n stands for image n
    hits = stored(self_free_top5(v).withColumnRenamed("id", "image_id"))  # searched once, read three times
    # records of the images found, not of all images
    ids = hits.select("image_id").distinct()
    records = U.image_rollup(v.images.join(ids, "image_id", "left_semi"), v.boxes.join(ids, "image_id", "left_semi"))
    return E.context_images(hits.join(records, "image_id"))


@query("t9_format_spatial", "SELECT image_id, spatial_text FROM fx_spatial_texts")
def _(v):
    return v.records.filter("has_damage").select("image_id", X.format_spatial(F.col("zone_counts")).alias("spatial_text"))


_PROMPT_SQL = "'" + E.PROMPT.replace("'", "''") + "'"


@query("t10_build_prompts", f"SELECT image_id, replace({_PROMPT_SQL}, '%s', description) AS prompt FROM fx_records")
def _(v):
    return E.build_prompts(v.records.select("image_id", F.col("description").alias("context"))).select("image_id", "prompt")


@query(
    "t11_parse_answers",
    """SELECT image_id AS case_id, CASE WHEN image_id % 4 < 3 THEN count(DISTINCT damage_type) ELSE 0 END AS n_damages,
              CASE WHEN image_id % 4 < 3 THEN 'case ' || image_id END AS summary, image_id % 4 = 3 AS is_raw
       FROM fx_placed_boxes GROUP BY image_id""",
)
def _(v):
    parsed = E.parse_answers(v.answers)
    return parsed.select(
        "case_id",
        F.coalesce(F.size("damages"), F.lit(0)).cast("bigint").alias("n_damages"),
        "summary",
        F.col("raw_text").isNotNull().alias("is_raw"),
    )


@query(
    "t12_answer_or_error",
    """SELECT conv_id, turn, CASE WHEN role = 'user' THEN '{"damages":[],"summary":"Error","error":"no model"}'
              WHEN coalesce(text, '') = '' THEN '{"damages":[],"summary":"Analysis failed","error":""}' ELSE text END AS answer FROM conversations""",
)
def _(v):
    error = F.when(F.col("role") == "user", "no model")
    return v.table("conversations").select("conv_id", "turn", X.answer_or_error(F.col("text"), error).alias("answer"))


@query(
    "t13_describe_rich",
    f"""SELECT r.image_id, 'Vehicle zone: ' || z.zone_name || ' (' || z.zone_area || ' area). ' || CASE WHEN r.has_damage THEN 'Affected part: ' || coalesce(d.part, replace(z.zone_name, '_', ' ') || ' panel')
                || '. Damage types: ' || t.types || '. Spatial pattern: ' || CASE WHEN c.n <= 1 THEN '{ISOLATED}' WHEN p.mean < 100 THEN '{CLUSTERED}' ELSE '{SPREAD}' END || '.'
              ELSE 'Inspected part: ' || coalesce(d.part, replace(z.zone_name, '_', ' ') || ' panel')
                || '. Surface condition: Clean paint, no scratches or dents detected. Panel integrity: Normal alignment, intact surface.' END AS rich_text
       FROM fx_records r JOIN dim_zones z USING (vehicle_zone)
       LEFT JOIN (SELECT image_id, string_agg(replace(damage_type, '_', ' ') || ' (' || f.friendly || ', ' || n || ' instance'
              || CASE WHEN n > 1 THEN 's' ELSE '' END || ')', ', ' ORDER BY first) AS types FROM fx_type_counts JOIN dim_friendly f USING (damage_type) GROUP BY image_id) t USING (image_id)
       LEFT JOIN (SELECT image_id, count(*) AS n, ((min(y_min) + max(y_max)) / 2.0)::double / 2448 AS rel_y FROM fx_boxes GROUP BY 1) c USING (image_id)
       LEFT JOIN dim_parts d ON d.zone_name = z.zone_name AND d.third = CASE WHEN coalesce(c.rel_y, 0.5) < 0.33 THEN 'top' WHEN coalesce(c.rel_y, 0.5) < 0.67 THEN 'center' ELSE 'bottom' END
       LEFT JOIN (SELECT a.image_id, avg(sqrt((((a.x_min + a.x_max) - (b.x_min + b.x_max)) ** 2 + ((a.y_min + a.y_max) - (b.y_min + b.y_max)) ** 2)::double) / 2) AS mean
              FROM fx_boxes a JOIN fx_boxes b ON a.image_id = b.image_id AND a.shape_idx < b.shape_idx GROUP BY 1) p USING (image_id)""",
)
def _(v):
    centre = v.boxes.groupBy("image_id").agg(((F.min("y_min") + F.max("y_max")) / 2 / F.max("image_h")).alias("rel_y"))
    return describe_rich(v.records.join(centre, "image_id", "left"), S.pair_stats(v.boxes)).select("image_id", "rich_text")


@query(
    "t14_truncate_text",
    """SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' || chr(10) || chr(10) || '*(Truncated)*' ELSE text END AS shown FROM documents""",
)
def _(v):
    return v.table("documents").select("doc_id", X.truncate_text(F.col("text")).alias("shown"))
