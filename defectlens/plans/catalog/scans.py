"""Scans, sources and sinks."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from ...dims import zone_dim
from ...operators import shapes
from ...ranks import bucketed_row_number, dense_id
from ...sources import annotations as A
from ...sources import tables as T
from ..registry import big, query, r
from ..sql import bench, dot, l2sq, norm
from ..views import DENSITIES, EMBEDDING_TYPES, order_key


#: Polygons in one document at most; an image of more has several documents.
DOCUMENT_SHAPES = 4096
#: Documents in one file at most, and the characters from which no more are added to it.
FILE_DOCUMENTS, FILE_CHARS = 256, 1 << 20


def scratch(spark) -> str:
    """New folder beside the checkpoints, or a local temporary one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        return tempfile.mkdtemp(prefix=f"tables-{os.getpid()}-")
    return f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"


def _shape_documents(v) -> str:
    """Annotation documents as JSON lines, one per shape; documents of rectangles are cut off."""
    at = lambda x, y: F.array(F.col(x) + 0.7, F.col(y) + 0.4)
    points = F.array(at("x_min", "y_min"), at("x_max", "y_min"), at("x_max", "y_max"), at("x_min", "y_max"))
    shape = F.struct("label", F.lit("polygon").alias("shape_type"), points.alias("points"))
    doc = F.to_json(
        F.struct(
            F.col("image_id").cast("string").alias("imagePath"),
            F.col("image_w").alias("imageWidth"),
            F.col("image_h").alias("imageHeight"),
            F.array(shape).alias("shapes"),
        )
    )
    broken = F.col("shape_type") == "rectangle"
    text = F.when(broken, F.substring(doc, 1, 40)).otherwise(doc)
    folder = scratch(v.spark)
    v.shapes.select(text.alias("value")).write.mode("overwrite").text(folder)
    return folder


def _image_documents(v) -> str:
    """All polygons of each image, as JSON lines; an image of more than ``DOCUMENT_SHAPES`` has a document for each so many."""
    folder = scratch(v.spark)
    _documents_of(v.polygons, "image_id").select("value").write.mode("overwrite").text(folder)
    return folder


def _documents_of(polygons, key: str):
    """A document (``value``) of all polygons of each ``key``, in parts of bounded length."""
    at = lambda x, y: F.array(F.col(x) + 0.7, F.col(y) + 0.4)
    points = F.array(at("x_min", "y_min"), at("x_max", "y_min"), at("x_max", "y_max"), at("x_min", "y_max"))
    shape = F.struct("shape_idx", "label", F.lit("polygon").alias("shape_type"), points.alias("points"))
    bucket = F.expr("shape_idx div 1000000000000000")
    numbered = bucketed_row_number(polygons, [key], [F.col("shape_idx"), F.col("x_min"), F.col("y_min")], bucket, "position")
    part = F.floor((F.col("position") - 1) / DOCUMENT_SHAPES)
    grouped = numbered.groupBy(key, "image_w", "image_h", part.alias("part")).agg(F.sort_array(F.collect_list(shape)).alias("shapes"))
    doc = F.to_json(
        F.struct(F.col(key).cast("string").alias("imagePath"), F.col("image_w").alias("imageWidth"), F.col("image_h").alias("imageHeight"), "shapes")
    )
    return grouped.select(doc.alias("value"))


def _document_folder(v) -> str:
    """A folder of files of several lines with the documents of the customers' polygons, and torn files for rectangles."""
    owner = v.table("orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_custkey").alias("owner"))
    spread = F.regexp_replace("value", r'([,{\[])"', '$1\n  "')
    whole = _documents_of(v.polygons.join(owner, "image_id"), "owner").select(spread.alias("value"))
    torn = v.shapes.filter("shape_type = 'rectangle'").select("label").distinct()
    torn = torn.select(F.concat(F.lit('{\n  "imagePath": "torn.jpg",\n  "shapes": [ {\n "label": "'), "label").alias("value"))
    folder = scratch(v.spark)
    whole.mapInArrow(_lists_of_documents, "value string").unionByName(torn).write.mode("overwrite").option("maxRecordsPerFile", 1).text(folder)
    return folder


def _lists_of_documents(batches):
    """JSON lists of up to ``FILE_DOCUMENTS`` documents: the text of one file each, so that files are far fewer than documents."""
    held, size = [], 0
    listed = lambda: pa.RecordBatch.from_arrays([pa.array(["[\n" + ",\n".join(held) + "\n]"])], names=["value"])
    for batch in batches:
        for text in batch["value"].to_pylist():
            held.append(text)
            size += len(text)
            if len(held) == FILE_DOCUMENTS or size >= FILE_CHARS:
                yield listed()
                held, size = [], 0
    if held:
        yield listed()


@query(
    "s1_annotation_folder",
    """SELECT o_custkey AS owner, false AS is_broken, 'part-.txt' AS name_form, count(*) AS n_boxes, sum(x_min)::bigint AS sum_x, sum(y_max)::bigint AS sum_y
         FROM fx_polygons p JOIN orders o ON o.o_orderkey = p.image_id GROUP BY o_custkey
       UNION ALL SELECT NULL, true, 'part-.txt', count(DISTINCT label), NULL, NULL FROM fx_shapes WHERE shape_type = 'rectangle'""",
)
def _(v):
    # documents in files of several lines; torn files are kept apart
    docs = A.read_annotations(v.spark, _document_folder(v), "part-*.txt", multi_line=True)
    valid, broken = A.split_valid(docs)
    name = F.concat(F.substring("file_name", 1, 5), F.substring("file_name", -4, 4)).alias("name_form")
    boxes = shapes.with_boxes(shapes.explode_shapes(valid))
    sums = [F.count(F.lit(1)).alias("n_boxes"), F.sum("x_min").cast("bigint").alias("sum_x"), F.sum("y_max").cast("bigint").alias("sum_y")]
    read = boxes.groupBy(F.col("imagePath").cast("bigint").alias("owner"), F.lit(False).alias("is_broken"), name).agg(*sums)
    torn = broken.filter("reason = 'unreadable'").groupBy(name).agg(F.count(F.lit(1)).alias("n_boxes"))
    torn = torn.withColumns({"owner": F.lit(None).cast("bigint"), "is_broken": F.lit(True), "sum_x": F.lit(None).cast("bigint"), "sum_y": F.lit(None).cast("bigint")})
    return read.unionByName(torn)


@query(
    "s1_read_annotations",
    "SELECT image_id, label, x_min, y_min, x_max, y_max FROM fx_polygons",
)
def _(v):
    docs = A.read_annotations(v.spark, _image_documents(v), "*", multi_line=False)
    valid, _bad = A.split_valid(docs)
    boxes = shapes.with_boxes(shapes.explode_shapes(valid))
    return boxes.select(
        F.col("imagePath").cast("bigint").alias("image_id"), "label", *[big(c) for c in shapes.CORNERS]
    )


@query(
    "s2_quarantine",
    """SELECT CASE WHEN shape_type = 'polygon' THEN 'valid' ELSE 'unreadable' END AS reason, count(*) AS n
       FROM fx_shapes GROUP BY 1""",
)
def _(v):
    docs = A.read_annotations(v.spark, _shape_documents(v), "*", multi_line=False)
    valid, bad = A.split_valid(docs)
    marked = valid.select(F.lit("valid").alias("reason")).unionByName(bad.select("reason"))
    return marked.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s3_classify_images",
    """SELECT i.image_name AS file_name,
              CASE WHEN max(d.is_damage::int) = 1 THEN 'damaged' WHEN count(d.base) > 0 THEN 'clean' ELSE 'orphan' END AS status
       FROM fx_images i LEFT JOIN fx_documents d ON d.base = replace(i.image_name, '_imageDANO_original.jpg', '')
       GROUP BY i.image_name""",
)
def _(v):
    files = v.images.select(F.col("image_name").alias("file_name"))
    return A.classify_images(files, v.documents).select("file_name", "status")


@query(
    "s4_pair_masked",
    """SELECT i.image_name AS file_name, s.image_id IS NOT NULL AS is_found,
              CASE WHEN s.image_id IS NOT NULL THEN count(d.base) ELSE 0 END AS n_docs
       FROM fx_images i LEFT JOIN (SELECT DISTINCT image_id FROM fx_shapes) s USING (image_id)
       LEFT JOIN fx_documents d ON d.base = replace(i.image_name, '_imageDANO_original.jpg', '')
       GROUP BY i.image_name, s.image_id""",
)
def _(v):
    files = v.images.select("image_id", F.col("image_name").alias("file_name"))
    masked = files.join(v.shapes.select("image_id").distinct(), "image_id", "left_semi").select(
        F.concat(F.lit("masked_"), "file_name").alias("file_name")
    )
    return A.pair_masked(files, masked, v.documents).select("file_name", "is_found", "n_docs")


@query(
    "s5_attach_outline",
    """SELECT i.image_id, CASE WHEN c.image_id IS NULL THEN o.px[1] ELSE 0 END AS first_x, 6 - 2 * (c.image_id IS NOT NULL)::bigint AS n_points
       FROM fx_images i JOIN fx_outlines o USING (image_id) LEFT JOIN fx_clean c USING (image_id)""",
)
def _(v):
    named = v.outlines.join(v.images.select("image_id", "image_name"), "image_id")
    first = named.select(F.col("image_name").alias("filename"), F.col("outline").alias("polygon"), F.lit(0).alias("line"))
    # images without shapes are listed twice; the later entry counts
    clean = named.join(v.shapes.select("image_id").distinct(), "image_id", "left_anti")
    box = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0, 0), (99, 0), (99, 99), (0, 99))])
    second = clean.select(F.col("image_name").alias("filename"), box.alias("polygon"), F.lit(1).alias("line"))
    out = A.attach_outline(v.images, first.unionByName(second), "line")
    return out.select(
        "image_id", F.get(F.get("outline", F.lit(0)), F.lit(0)).cast("bigint").alias("first_x"), F.size("outline").cast("bigint").alias("n_points")
    )


@query(
    "s6_manifest",
    """SELECT row_number() OVER (ORDER BY total_defects, image_name) - 1 AS id, image_name AS image, vehicle_zone, total_defects
       FROM fx_records WHERE has_damage""",
)
def _(v):
    damaged = v.records.filter("has_damage")
    rows = damaged.select(
        F.col("image_name").alias("image"),
        F.regexp_replace("image_name", "_imageDANO_original\\.jpg$", "_labelDANO_modificado.json").alias("json"),
        "vehicle_zone",
        "zone_description",
        "zone_area",
        "total_defects",
        F.map_from_entries(F.transform("type_counts", lambda c: F.struct(c["name"], c["n"]))).alias("defect_distribution"),
        F.array(F.col("image_w").cast("int"), F.col("image_h").cast("int")).alias("image_size"),
    )
    folder = scratch(v.spark)
    T.write_manifest(rows, folder, [F.col("total_defects"), F.col("image")])
    return T.read_manifest(v.spark, folder).select("id", "image", "vehicle_zone", "total_defects")


@query("s7_vectors", f"SELECT id, label_raw, len(embedding) AS dim, round({norm('embedding')}, 6) AS norm, true AS vector_ok FROM fx_vectors")
def _(v):
    from ...functions.vectors import l2_norm

    folder = scratch(v.spark)
    T.write_vectors(v.vectors.select("id", "embedding"), v.vectors.drop("embedding"), folder)
    stored = T.read_vectors(v.spark, folder)
    return stored.select(
        "id", "label_raw", F.size("embedding").cast("bigint").alias("dim"), r(l2_norm(F.col("embedding")), 6, "norm"), "vector_ok"
    )


@query(
    "s8_save_index",
    "SELECT 'visual_' || density AS config, count(*) AS n, sum(id)::bigint AS id_sum FROM fx_vectors GROUP BY density",
)
def _(v):
    folder = scratch(v.spark)
    indexed = v.vectors.withColumn("config", F.concat_ws("_", F.lit("visual"), "density"))
    config = indexed.groupBy("config").agg(F.count(F.lit(1)).alias("n_vectors"))
    T.save_index(indexed, config, folder)
    stored = T.read_index(v.spark, folder)
    return stored.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


_STORED = ["recall_at_1", "recall_at_5", "precision_at_5", "mrr", "avg_total_time_ms"]


@query("s9_write_metrics", "SELECT config, " + ", ".join(f"round({c}, 6) AS {c}" for c in _STORED) + ", num_queries FROM fx_metrics")
def _(v):
    folder = scratch(v.spark)
    T.write_metrics(v.metrics, folder)
    stored = T.read_metric_rows(v.spark, folder, "config string, " + ", ".join(f"{c} double" for c in _STORED) + ", num_queries bigint")
    return stored.select("config", *[r(c) for c in _STORED], "num_queries")


@query(
    "x1_sql_functions",
    f"""SELECT id, coalesce(l.damage_type, 'unknown') AS canonical, {bench('label_raw')} AS benchmark, round({l2sq('embedding[1:32]', 'embedding[33:64]')}, 6) AS gap,
              round({dot('embedding[1:32]', 'embedding[33:64]')} / ({norm('embedding[1:32]')} * {norm('embedding[33:64]')}), 6) AS cosine
        FROM fx_vectors v LEFT JOIN dim_labels l ON l.label = v.label_raw""",
)
def _(v):
    from ...functions import register

    register(v.spark)
    return v.spark.sql(
        """SELECT id, canonical_label(label_raw) AS canonical, normalize_label(label_raw) AS benchmark,
                  round(l2sq(visual, text_part), 6) AS gap, round(cosine(visual, text_part), 6) AS cosine FROM {parts}""",
        parts=v.parts,
    )


@query("s9_write_results", "SELECT config, query_id, rank, id, round(distance, 6) AS distance FROM fx_results")
def _(v):
    folder = scratch(v.spark)
    T.write_results(v.results, folder)
    stored = T.read_results(v.spark, folder, "config string, query_id bigint, rank bigint, id bigint, distance double")
    return stored.select("config", "query_id", "rank", "id", r("distance"))


@query(
    "s10_read_metrics",
    """SELECT config, num_queries AS total_cases, num_queries AS successful_cases, 0::bigint AS failed_cases,
              round(avg_retrieval_time_ms, 6) AS avg_retrieval_time_ms FROM fx_metrics""",
)
def _(v):
    folder = scratch(v.spark)
    old_layout = v.metrics.select("config", F.col("num_queries").alias("num_cases"), "avg_retrieval_time_ms")
    old_layout.write.mode("overwrite").json(folder)
    return T.read_metrics(v.spark, folder).select(
        "config", "total_cases", "successful_cases", "failed_cases", r("avg_retrieval_time_ms")
    )


@query(
    "s11_dims",
    """SELECT z.zone_name, z.zone_area, l.damage_type, p.base_padding::double AS base_padding, t.benchmark_label, coalesce(g.compat_group, 'none') AS compat_group, count(*) AS n
       FROM fx_boxes b JOIN fx_images i USING (image_id) JOIN dim_zones z ON z.vehicle_zone = i.vehicle_zone
       JOIN dim_labels l ON l.label = b.label JOIN dim_padding p ON p.label = b.label JOIN dim_taxonomy t ON t.label = b.label
       LEFT JOIN dim_groups g ON g.damage_type = l.damage_type GROUP BY ALL""",
)
def _(v):
    from ...dims import dims
    from ...functions import labels as L
    from ...operators.profile import zone_type_matrix

    d = dims(v.spark)
    zoned = v.images.select("image_id", L.vehicle_zone(F.col("image_name")).alias("vehicle_zone"))
    counted = zone_type_matrix(v.boxes, zoned)
    wide = (
        counted.join(F.broadcast(d["zones"]), "vehicle_zone")
        .join(F.broadcast(d["padding"]), "label")
        .join(F.broadcast(d["taxonomy"]), "label")
        .join(F.broadcast(d["groups"]), "damage_type", "left")
    )
    return wide.select(
        "zone_name", "zone_area", "damage_type", "base_padding", "benchmark_label",
        F.coalesce("compat_group", F.lit("none")).alias("compat_group"), "n",
    )


@query(
    "s12_list_configs",
    """SELECT t.e || '_' || density AS config, t.e AS embedding_type, density, t.d AS embedding_dim, count(*) AS n_vectors
       FROM fx_vectors CROSS JOIN (VALUES ('visual', 64::bigint), ('text', 32::bigint)) t(e, d) GROUP BY ALL""",
)
def _(v):
    return T.list_configs(v.configs_vectors, EMBEDDING_TYPES, DENSITIES)


@query(
    "s13_existing_files",
    """SELECT count(d.base) AS n_valid, count(*) - count(d.base) AS n_missing
       FROM fx_images i LEFT JOIN fx_documents d ON d.base = replace(i.image_name, '_imageDANO_original.jpg', '')""",
)
def _(v):
    base = lambda c: F.regexp_replace(c, "_(imageDANO|labelDANO).*$", "").alias("base")
    return A.existence_counts(v.images.select(base("image_name")), v.documents.select(base("file_name")), "base")


@query(
    "s14_run_record",
    f"""SELECT count(*) AS n_vectors, 64::bigint AS embedding_dim, round(avg({norm('embedding')}), 6) AS mean_norm,
              round(min({norm('embedding')}), 6) AS min_norm, round(max({norm('embedding')}), 6) AS max_norm,
              'given' AS model, 0.6::double AS visual_weight FROM fx_vectors""",
)
def _(v):
    record = T.run_record(v.vectors, "given", visual_weight=0.6)
    return record.select("n_vectors", "embedding_dim", *[r(c) for c in ("mean_norm", "min_norm", "max_norm")], "model", "visual_weight")


@query(
    "w7_dense_id",
    "SELECT row_number() OVER (ORDER BY image_name) - 1 AS id, image_name FROM fx_images",
)
def _(v):
    return dense_id(v.images.select("image_name"), [F.col("image_name")]).select("id", "image_name")


@query(
    "j1_left_join_zone",
    """SELECT i.image_id, z.zone_name, coalesce(b.n, 0) AS n_boxes FROM fx_images i LEFT JOIN dim_zones z USING (vehicle_zone)
       LEFT JOIN (SELECT image_id, count(*) AS n FROM fx_boxes GROUP BY 1) b USING (image_id)""",
)
def _(v):
    from ...functions import labels as L
    from ...operators.rollup import attach_zone

    zoned = v.images.withColumn("vehicle_zone", L.vehicle_zone(F.col("image_name")))
    counts = v.per_image.withColumnRenamed("n_defects", "n_boxes")
    out = attach_zone(zoned, zone_dim(v.spark)).join(counts, "image_id", "left")
    return out.select("image_id", "zone_name", F.coalesce("n_boxes", F.lit(0)).cast("bigint").alias("n_boxes"))


@query(
    "j2_vectors_with_metadata",
    """SELECT v.id, v.label_raw, r.total_defects, r.description FROM fx_vectors v JOIN fx_records r ON r.image_id = v.id""",
)
def _(v):
    records = v.records.select(F.col("image_id").alias("id"), "total_defects", "description")
    return v.vectors.select("id", "label_raw").join(records, "id")


@query(
    "j3_semi_anti",
    """SELECT CASE WHEN s.image_id IS NULL THEN 'missing' ELSE 'present' END AS side, count(*) AS n, sum(i.image_id)::bigint AS id_sum
       FROM fx_images i LEFT JOIN (SELECT DISTINCT image_id FROM fx_shapes) s USING (image_id) GROUP BY 1""",
)
def _(v):
    from ...operators.split import remaining

    ids = v.images.select("image_id")
    present = A.existing_only(ids, v.shapes, "image_id").withColumn("side", F.lit("present"))
    missing = remaining(ids, v.shapes).withColumn("side", F.lit("missing"))
    return present.unionByName(missing).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("image_id").alias("id_sum"))


@query(
    "j7_leakage",
    "SELECT 0::bigint AS n_leaked, count(*) AS n_images FROM fx_per_image",
)
def _(v):
    from ...operators.split import leakage, stratified_split

    # Each part of a split must share no image with the other.
    split = stratified_split(v.per_image, ["n_defects"], "image_id", key_expr=order_key("image_id"), key_range=1 << 32)
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    leaked = leakage(train, test).select("image_id", F.lit(True).alias("leaked"))
    return v.per_image.join(leaked, "image_id", "left").agg(
        F.count("leaked").alias("n_leaked"), F.count(F.lit(1)).alias("n_images")
    )


@query(
    "u1_union_corpora",
    """SELECT has_damage, vehicle_zone, count(*) AS n, sum(total_defects)::bigint AS defects FROM fx_records GROUP BY ALL""",
)
def _(v):
    from ...operators.rollup import union_corpora

    damaged = v.records.filter("has_damage").select("has_damage", "vehicle_zone", "total_defects")
    clean = v.records.filter("not has_damage").select("has_damage", "vehicle_zone")
    both = union_corpora(damaged, clean)
    return both.groupBy("has_damage", "vehicle_zone").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("total_defects"), F.lit(0)).alias("defects")
    )
