"""Vector search and its filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import labels as L
from ...functions import text as X
from ...functions import vectors as V
from ...operators import encode as C
from ...operators import search as Q
from ...ranks import stored
from ..registry import query, r
from ..sql import bench, l2sq, norm


def self_free_top5(v):
    return Q.knn(v.queries, v.vectors, 5, exclude_self=True)


def labelled(v):
    """Corpus as the retriever sees it: a normalised label for filters, raw label kept."""
    return v.vectors.withColumns(
        {
            "damage_type": L.benchmark_label(F.col("label_raw")),
            "canonical_type": L.canonical_label(F.col("label_raw")),
            "spatial_zone": F.col("zone_area"),
            "damage_types": F.array(L.benchmark_label(F.col("label_raw"))),
            "defect_types": F.array("label_raw"),
        }
    )


def seen(v):
    """Top 5 of every query with the corpus columns."""
    corpus = v.vectors.withColumnRenamed("label_raw", "damage_type")
    return Q.with_metadata(self_free_top5(v), corpus)


@query("v8_knn_l2", "SELECT query_id, rank, id, round(distance, 6) AS distance FROM fx_top5")
def _(v):
    return self_free_top5(v).select("query_id", "rank", "id", r("distance"))


@query("v8_knn_by_config", "SELECT config, query_id, rank, id, round(distance, 6) AS distance FROM fx_results")
def _(v):
    return v.results.select("config", "query_id", "rank", "id", r("distance"))


@query("v8_knn_block_join", "SELECT query_id, rank, id, round(distance, 6) AS distance FROM fx_top5")
def _(v):
    # the way for two large sides, forced by a small limit
    hits = Q.knn(v.queries, v.vectors, 5, exclude_self=True, broadcast_bytes=64 << 10)
    return hits.select("query_id", "rank", "id", r("distance"))


@query("v9_ivf_all_cells", "SELECT query_id, rank, id, round(distance, 6) AS distance FROM fx_top5")
def _(v):
    # probing every cell must equal exact search
    hits = Q.ann_knn(v.queries, v.vectors, 5, "ivf", n_cells=8, nprobe=8, exclude_self=True)
    return hits.select("query_id", "rank", "id", r("distance"))


def _probed_sql(nprobe: int) -> str:
    return f"""SELECT query_id, rank, id, round(distance, 6) AS distance FROM (
        SELECT p.query_id, p.id, p.distance, row_number() OVER (PARTITION BY p.query_id ORDER BY p.distance, p.id) AS rank
        FROM fx_pairs p JOIN fx_cells c ON c.id = p.id AND c.near = 1 JOIN fx_cells q ON q.id = p.query_id AND q.cell = c.cell AND q.near <= {nprobe}
        WHERE p.query_id <> p.id) WHERE rank <= 5"""


@query("v9_ivf_probe", _probed_sql(4))
def _(v):
    hits = Q.ann_knn(v.queries, v.vectors, 5, "ivf", nprobe=4, exclude_self=True, centers=v.centers)
    return hits.select("query_id", "rank", "id", r("distance"))


def stored_index(v):
    """The vectors as an index in the shared folder: (index, centres)."""
    from ...sources import tables as T
    from .scans import scratch

    folder = scratch(v.spark)
    cells, centers = Q.build_ivf(v.vectors, v.centers)
    T.save_index(cells.withColumn("config", F.lit("all")), centers.select("cell"), folder, "cell")
    T.save_centers(centers, folder)
    return T.read_index(v.spark, folder, "all"), T.read_centers(v.spark, folder)


@query("v9_stored_index", _probed_sql(2))
def _(v):
    hits = Q.search_index(v.queries, *stored_index(v), 5, nprobe=2, exclude_self=True)
    return hits.select("query_id", "rank", "id", r("distance"))


def bounded_index(v):
    """The labelled vectors with cells and radii in the shared folder."""
    from ...sources import tables as T
    from .scans import scratch

    folder = scratch(v.spark)
    cells, centers = Q.build_bounded_index(labelled(v), v.centers)
    T.save_index(cells.withColumn("config", F.lit("all")), centers.select("cell"), folder, "cell")
    T.save_centers(centers, folder)
    return T.read_index(v.spark, folder, "all"), T.read_centers(v.spark, folder)


@query("v9_bounded_search", "SELECT query_id, rank, id, round(distance, 6) AS distance FROM fx_top5")
def _(v):
    hits = Q.bounded_search(v.queries, *bounded_index(v), 5, exclude_self=True)
    return hits.select("query_id", "rank", "id", r("distance"))


# Sign hashes whose directions follow from a rule, so that other engines can compute them.
LSH_TABLES, LSH_BITS = 24, 4


def _planes(dim: int, n: int):
    import numpy as np

    i, d = np.arange(1, n + 1)[None, :], np.arange(1, dim + 1)[:, None]
    return ((i * 7919 + d * 104729 + i * d * 31337) % 1009 - 504).astype(float)


_CODES = f"""codes AS (SELECT id, t, sum(CASE WHEN s > 0 THEN 1 << b ELSE 0 END) AS code FROM (
    SELECT id, (i - 1) // {LSH_BITS} AS t, ((i - 1) % {LSH_BITS})::int AS b, sum(x * ((i * 7919 + d * 104729 + i * d * 31337) % 1009 - 504)) AS s
    FROM (SELECT id, unnest(embedding)::double AS x, unnest(range(1, 65)) AS d FROM fx_vectors) CROSS JOIN range(1, {LSH_TABLES * LSH_BITS + 1}) r(i)
    GROUP BY id, i) GROUP BY id, t),
  meet AS (SELECT DISTINCT a.id AS query_id, b.id FROM codes a JOIN codes b USING (t, code) WHERE a.id <> b.id)"""
_LSH_TOP = """SELECT p.query_id, p.id, p.distance, row_number() OVER (PARTITION BY p.query_id ORDER BY p.distance, p.id) AS rank
    FROM fx_pairs p JOIN meet m ON m.query_id = p.query_id AND m.id = p.id"""


def _lsh(v):
    planes = _planes(64, LSH_TABLES * LSH_BITS)
    return Q.ann_knn(v.queries, v.vectors, 5, "lsh", tables=LSH_TABLES, bits=LSH_BITS, exclude_self=True, planes=planes)


@query("v9_lsh", f"WITH {_CODES} SELECT query_id, rank, id, round(distance, 6) AS distance FROM ({_LSH_TOP}) WHERE rank <= 5")
def _(v):
    return _lsh(v).select("query_id", "rank", "id", r("distance"))


@query(
    "v9_recall",
    f"""WITH {_CODES}, ivf AS ({_probed_sql(9)}), lsh AS (SELECT * FROM ({_LSH_TOP}) WHERE rank <= 5)
        SELECT method, n_exact, n_found, round(n_found / n_exact::double, 6) AS recall, n_found >= 0.9 * n_exact AS is_enough FROM (
          SELECT 'ivf' AS method, count(*) AS n_exact, count(i.id) AS n_found FROM fx_top5 e LEFT JOIN ivf i ON i.query_id = e.query_id AND i.id = e.id
          UNION ALL SELECT 'lsh', count(*), count(i.id) FROM fx_top5 e LEFT JOIN lsh i ON i.query_id = e.query_id AND i.id = e.id)""",
)
def _(v):
    exact = stored(self_free_top5(v))  # searched once, for both ways
    found = {"ivf": Q.ann_knn(v.queries, v.vectors, 5, "ivf", nprobe=9, exclude_self=True, centers=v.centers), "lsh": _lsh(v)}
    rows = [Q.recall_of(f, exact).withColumn("method", F.lit(m)) for m, f in found.items()]
    out = rows[0].unionByName(rows[1])
    return out.select("method", "n_exact", "n_found", r("recall"), (F.col("recall") >= 0.9).alias("is_enough"))


@query("v10_index_self_check", "SELECT count(*) AS n_checked, 0::bigint AS n_failed, 0.0::double AS max_distance FROM fx_vectors")
def _(v):
    return Q.index_self_check(v.vectors, *stored_index(v), None).select("n_checked", "n_failed", r("max_distance"))


@query("v16_choose_profile", "SELECT count(*) AS n_vectors, CASE WHEN count(*) < 10000 THEN 'poc' WHEN count(*) < 100000 THEN 'production' ELSE 'large_scale' END AS profile FROM fx_vectors")
def _(v):
    n = v.vectors.count()
    return v.vectors.agg(F.count(F.lit(1)).alias("n_vectors")).withColumn("profile", F.lit(Q.choose_profile(n)))


@query("v16_search_by_size", "SELECT query_id, id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM fx_pairs) WHERE rank <= 5")
def _(v):
    return Q.search(v.queries, v.vectors, 5).select("query_id", "id", r("distance"))


# -- filters -------------------------------------------------------------------


def _filtered_sql(where: str, k: int = 5) -> str:
    return f"""SELECT query_id, rank, id FROM (SELECT p.query_id, p.id, row_number() OVER (PARTITION BY p.query_id ORDER BY p.distance, p.id) AS rank
        FROM fx_pairs p JOIN fx_vectors v ON v.id = p.id WHERE p.query_id <> p.id AND ({where})) WHERE rank <= {k}"""


def _filtered(filters: dict, form: str = "crop"):
    def run(v):
        hits = Q.knn(v.queries, labelled(v), 5, exclude_self=True, filters=filters, form=form)
        return hits.select("query_id", "rank", "id")

    return run


query("f1_filter_type", _filtered_sql(f"{bench('v.label_raw')} IN ('Scratch', 'Dent')"))(
    _filtered({"damage_type": ["Scratch", "Dent"]})
)
query("f2_filter_any_type", _filtered_sql(f"{bench('v.label_raw')} IN ('Crack', 'Unknown')"))(
    _filtered({"damage_type": ["Crack", "Unknown"]}, "image")
)
query("f3_filter_spatial_zone", _filtered_sql("v.zone_area IN ('frontal')"))(_filtered({"spatial_zone": "frontal"}))
query("f4_filter_vehicle_zone", _filtered_sql("v.vehicle_zone IN ('1', '4', '7') AND v.zone_area IN ('frontal', 'posterior')"))(
    _filtered({"vehicle_zone": ["1", "4", "7"], "zone_area": ["frontal", "posterior"]}, "image")
)
query("f5_filter_defect_count", _filtered_sql("v.total_defects >= 5 AND v.total_defects <= 13"))(
    _filtered({"min_defects": 5, "max_defects": 13}, "image")
)
query("f6_filter_has_damage", _filtered_sql("NOT v.has_damage"))(_filtered({"has_damage": False}))
query("f11_filter_severity_category", _filtered_sql(
    "v.label_raw IN (SELECT l.label FROM dim_labels l JOIN dim_types t USING (damage_type) WHERE t.category IN ('structural_damage', 'surface_damage') AND t.severity_low <= 0.5 AND t.severity_high >= 0.4)"
))(_filtered({"category": ["structural_damage", "surface_damage"], "severity": (0.4, 0.5)}))


@query(
    "f7_overfetch_then_filter",
    f"""SELECT query_id, id, new_rank AS rank FROM (SELECT p.query_id, p.id, row_number() OVER (PARTITION BY p.query_id ORDER BY p.distance, p.id) AS new_rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rn FROM fx_pairs WHERE query_id <> id) p
        JOIN fx_vectors v ON v.id = p.id WHERE p.rn <= 25 AND {bench('v.label_raw')} IN ('Scratch')) WHERE new_rank <= 5""",
)
def _(v):
    hits = Q.knn(v.queries, labelled(v), 5, exclude_self=True, filters={"damage_type": "Scratch"}, overfetch=5)
    return hits.select("query_id", "id", "rank")


@query("f8_prefilter_then_search", _filtered_sql("v.vehicle_zone = '4' AND v.has_damage"))
def _(v):
    hits = Q.knn(v.queries, labelled(v), 5, exclude_self=True, filters={"vehicle_zone": "4", "has_damage": True})
    return hits.select("query_id", "rank", "id")


@query("f8_filter_in_index", _filtered_sql("v.vehicle_zone = '4' AND v.has_damage"))
def _(v):
    hits = Q.bounded_search(v.queries, *bounded_index(v), 5, exclude_self=True, filters={"vehicle_zone": "4", "has_damage": True})
    return hits.select("query_id", "rank", "id")


@query(
    "f7_overfetch_in_index",
    f"""SELECT query_id, id, new_rank AS rank FROM (SELECT p.query_id, p.id, row_number() OVER (PARTITION BY p.query_id ORDER BY p.distance, p.id) AS new_rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rn FROM fx_pairs WHERE query_id <> id) p
        JOIN fx_vectors v ON v.id = p.id WHERE p.rn <= 25 AND {bench('v.label_raw')} IN ('Scratch')) WHERE new_rank <= 5""",
)
def _(v):
    hits = Q.bounded_search(v.queries, *bounded_index(v), 5, exclude_self=True, filters={"damage_type": "Scratch"}, overfetch=5)
    return hits.select("query_id", "id", "rank")


@query(
    "f9_compatible_configs",
    "SELECT 'visual_' || density AS config, 64::bigint AS embedding_dim, count(*) AS n_vectors FROM fx_vectors GROUP BY density",
)
def _(v):
    from ...sources.tables import list_configs
    from ..views import DENSITIES, EMBEDDING_TYPES

    configs = list_configs(v.configs_vectors, EMBEDDING_TYPES, DENSITIES)
    checked = Q.assert_dim(v.queries, 64)
    return Q.compatible_configs(configs, checked).select("config", "embedding_dim", "n_vectors")


@query("f12_first_queries", "SELECT query_id, rank, id FROM fx_top5 WHERE query_id IN (SELECT id FROM fx_vectors ORDER BY id LIMIT 10)")
def _(v):
    first = Q.first_queries(v.queries, 10)
    return Q.knn(first, v.vectors, 5, exclude_self=True).select("query_id", "rank", "id")


@query("f10_having_min_defects", "SELECT image_id, n_defects FROM fx_per_polygon_image WHERE n_defects >= 5")
def _(v):
    from ...operators.rollup import having_min_defects

    return having_min_defects(v.polygons, 5)


# -- joins and windows over results -----------------------------------------------


@query("j4_query_corpus_topk", "SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM fx_pairs) WHERE rank <= 3")
def _(v):
    return Q.knn(v.queries, v.vectors, 3).select("query_id", "id", "rank")


@query(
    "j7_zero_distance_leakage",
    "SELECT t.id AS query_id, min(v.id) AS id FROM fx_leaked t JOIN fx_vectors v ON v.embedding = t.embedding WHERE v.density <> 'high' GROUP BY t.id",
)
def _(v):
    return Q.zero_distance_matches(v.vectors.filter("density <> 'high'"), v.leaked)


@query("w1_topk_per_query", "SELECT config, query_id, id, rank FROM fx_results WHERE rank <= 3")
def _(v):
    return Q.top_k(v.results.drop("rank"), ["config", "query_id"], 3).select("config", "query_id", "id", "rank")


# -- encoding ------------------------------------------------------------------------


def _letters_sql(text: str, dim: int = 32) -> str:
    """Unit vector of letter counts of a text expression, as floats."""
    count = lambda c: f"(2 * length({text}) - length(replace({text}, '{c}', '')) - length(replace({text}, '{c.upper()}', '')))" if c.isalpha() else f"(length({text}) - length(replace({text}, '{c}', '')))"
    counts = ", ".join(f"{count(c)}::double" for c in C.LETTERS[:dim])
    return f"[{counts}]"


def _unit_sql(source: str, keys: str, text: str) -> str:
    return f"""SELECT {keys}, list_transform(c, lambda x: CASE WHEN n > 0 THEN x / n ELSE x END::float) AS e FROM (
        SELECT *, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n FROM (SELECT {keys}, {_letters_sql(text)} AS c FROM {source}))"""


@query(
    "v4_encode_texts",
    f"""SELECT doc_id, true AS vector_ok, round(list_sum(list_transform(list_zip(e, range(1, 33)), lambda z: z[1]::double * z[2])), 6) AS weighed
        FROM ({_unit_sql('documents', 'doc_id', 'text')})""",
)
def _(v):
    docs = v.table("documents").select("doc_id", "text")
    coded = C.encode(docs, "text", lambda: C.letter_encoder(32), 32)
    weighed = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda acc, x: acc + x)
    return coded.select("doc_id", "vector_ok", r(weighed, 6, "weighed"))


@query(
    "v11_encode_consistency",
    f"""SELECT count(*) AS n, round(avg(list_sum(list_transform(e, lambda x: x::double * x::double))), 6) AS mean_similarity, 0::bigint AS n_below, 0::bigint AS n_failed
        FROM ({_unit_sql('conversations', 'conv_id', 'text')})""",
)
def _(v):
    out = C.encode_consistency(v.table("conversations").select("text"), "text", lambda: C.letter_encoder(32), 32)
    return out.select("n", r("mean_similarity"), "n_below", "n_failed")


@query(
    "v12_search_hybrid",
    f"""WITH named AS (SELECT v.id, v.embedding[1:32] AS visual, v.total_defects || ' ' || replace(coalesce(l.damage_type, 'unknown'), '_', ' ')
              || CASE WHEN v.total_defects > 1 THEN 's' ELSE '' END || ' on ' || v.zone_description || ' (' || v.zone_area || ' area)' AS t
            FROM fx_vectors v LEFT JOIN dim_labels l ON l.label = v.label_raw),
          texted AS ({_unit_sql('named', 'id', 't')}),
          joined AS (SELECT id, list_concat(list_transform(visual, lambda x: x::double / {norm('visual')} * 0.6::double), list_transform(e, lambda x: x::double / {norm('e')} * 0.4::double)) AS f
            FROM named JOIN texted USING (id)),
          fused AS (SELECT id, list_transform(f, lambda x: x / sqrt(list_sum(list_transform(f, lambda y: y * y)))) AS u FROM joined)
        SELECT query_id, rank, id, round(distance, 6) AS distance FROM (
          SELECT q.id AS query_id, c.id, {l2sq('q.u', 'c.u')} AS distance, row_number() OVER (PARTITION BY q.id ORDER BY {l2sq('q.u', 'c.u')}, c.id) AS rank
          FROM fused q JOIN fused c ON q.id <> c.id) WHERE rank <= 5""",
)
def _(v):
    counts = F.array(
        F.struct(F.col("total_defects").alias("n"), F.lit(0).cast("bigint").alias("first"), L.canonical_label(F.col("label_raw")).alias("name"))
    )
    text = X.describe_damage(counts, F.col("zone_description"), F.col("zone_area"), "v2")
    records = v.parts.drop("embedding", "text_part")
    texted = C.encode(records.withColumn("_text", text), "_text", lambda: C.letter_encoder(32), 32, name="_t")
    corpus = texted.select("id", V.fuse_concat(F.col("visual"), F.col("_t")).alias("embedding"))
    asked = records.withColumnRenamed("id", "query_id")
    return C.search_hybrid(asked, text, corpus, lambda: C.letter_encoder(32), 32, 5, exclude_self=True).select(
        "query_id", "rank", "id", r("distance")
    )


@query(
    "v13_pool_patches",
    f"""SELECT id AS image_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS norm_sq, round(u[1] / {norm('u')}, 6) AS first_value FROM (
          SELECT id, list_transform(list_zip(e, m), lambda z: 0.6 * z[1]::double + 0.4 * z[2]) AS u FROM (
            SELECT g.id, g.embedding AS e, list(m.x ORDER BY m.d) AS m FROM fx_vectors g JOIN (
              SELECT zone_area, d, avg(x) AS x FROM (SELECT zone_area, unnest(embedding)::double AS x, unnest(range(1, 65)) AS d FROM fx_vectors) GROUP BY zone_area, d) m
            USING (zone_area) GROUP BY g.id, g.embedding))""",
)
def _(v):
    # the vectors of one area act as the patches of every image of that area
    patches = v.vectors.select("zone_area", "embedding")
    whole = v.vectors.select(F.col("id").alias("image_id"), "zone_area", "embedding")
    pooled = C.pool_patches(patches, whole, key="zone_area")
    raw = whole.select("image_id", F.col("embedding").alias("_e"))
    joined = pooled.select("image_id", "embedding").join(raw, "image_id")
    # |0.6 g + 0.4 m|^2 follows from one element before and after normalising
    mean_first = v.vectors.groupBy("zone_area").agg(F.avg(F.get("embedding", F.lit(0)).cast("double")).alias("_m"))
    first = lambda c: F.get(c, F.lit(0)).cast("double")
    zoned = joined.join(whole.select("image_id", "zone_area"), "image_id").join(mean_first, "zone_area")
    mixed = first("_e") * 0.6 + F.col("_m") * 0.4
    return zoned.select(
        "image_id", r((mixed / first("embedding")) ** 2, 6, "norm_sq"), r(first("embedding"), 6, "first_value")
    )


@query(
    "v14_rerank",
    f"""SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS new_rank FROM (
          SELECT s.query_id, s.id, 0.6 * (1 - s.distance / 2) + 0.25 * ({bench('q.label_raw')} = s.damage_type)::int
                 + 0.15 * CASE WHEN q.vehicle_zone = s.vehicle_zone THEN 1.0 WHEN q.zone_area = s.zone_area THEN 0.5 ELSE 0.0 END::double AS score
          FROM fx_seen s JOIN fx_vectors q ON q.id = s.query_id)""",
)
def _(v):
    asked = v.vectors.select(
        F.col("id").alias("query_id"), F.col("vehicle_zone").alias("qz"), F.col("zone_area").alias("qa"), L.benchmark_label(F.col("label_raw")).alias("ql")
    )
    rows = seen(v).join(asked, "query_id")
    near = F.when(F.col("qz") == F.col("vehicle_zone"), 1.0).when(F.col("qa") == F.col("zone_area"), 0.5).otherwise(0.0)
    out = Q.rerank(rows, 1 - F.col("distance") / 2, F.col("ql") == F.col("damage_type"), near)
    return out.select("query_id", "id", r("score"), "new_rank")


@query(
    "v15_search_two_stage",
    f"""WITH chosen AS (SELECT query_id, id AS image_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rn FROM fx_pairs) WHERE rn <= 10),
        regions AS (SELECT id * 2 + h AS id, id AS image_id, CASE WHEN h = 0 THEN embedding ELSE list_concat(embedding[33:64], embedding[1:32]) END AS embedding
                    FROM fx_vectors CROSS JOIN (VALUES (0), (1)) t(h))
        SELECT query_id, id, rank FROM (SELECT c.query_id, r.id, row_number() OVER (PARTITION BY c.query_id ORDER BY {l2sq('q.embedding', 'r.embedding')}, r.id) AS rank
        FROM chosen c JOIN regions r USING (image_id) JOIN fx_vectors q ON q.id = c.query_id) WHERE rank <= 5""",
)
def _(v):
    # two regions per image: the vector itself and its swapped halves
    swapped = F.concat(F.slice("embedding", 33, 32), F.slice("embedding", 1, 32))
    both = F.explode(F.array(F.struct(F.lit(0).alias("h"), F.col("embedding").alias("e")), F.struct(F.lit(1).alias("h"), swapped.alias("e"))))
    regions = v.vectors.select("id", both.alias("p")).select(
        (F.col("id") * 2 + F.col("p.h")).alias("id"), F.col("id").alias("image_id"), F.col("p.e").alias("embedding")
    )
    return Q.search_two_stage(v.queries, v.vectors, regions).select("query_id", "id", "rank")
