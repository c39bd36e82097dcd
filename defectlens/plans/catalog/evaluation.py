"""Retrieval metrics and comparison tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import labels as L
from ...operators import evaluate as E
from ...operators import regions as R
from ...operators.search import BROADCAST_BYTES
from ...ranks import stored
from ..registry import big, query, r
from ..sql import bench, l2sq
from .regions import _MERGES


def _judged(v):
    return E.judged(v.results, v.truth)


_E1 = [f"{m}_at_{k}" for k in (1, 3, 5) for m in ("recall", "precision")]


@query(
    "e1_retrieval_metrics",
    "SELECT config, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in [*_E1, "mrr", "avg_retrieval_time_ms", "avg_generation_time_ms", "avg_total_time_ms"])
    + ", num_queries FROM fx_metrics",
)
def _(v):
    return v.metrics.select("config", *[r(c) for c in v.metrics.columns if c not in ("config", "num_queries")], "num_queries")


@query("e1_type_counts", "SELECT config, retrieved_type, count(*) AS n FROM fx_results GROUP BY ALL")
def _(v):
    return E.type_counts(v.results)


@query("w4_first_hit_rank", "SELECT config, query_id, first_hit FROM fx_per_query")
def _(v):
    return E.first_hit_rank(_judged(v)).select("config", "query_id", "first_hit")


def _recall_sql(found: str, truth: str) -> str:
    return f"""SELECT t.query_id, count(*) AS n_true, count(f.label) AS n_hit, round(count(f.label) / count(*)::double, 6) AS recall
        FROM (SELECT DISTINCT query_id, label FROM ({truth})) t LEFT JOIN (SELECT DISTINCT query_id, label FROM ({found})) f
        ON f.query_id = t.query_id AND f.label = t.label GROUP BY t.query_id"""


# image labels: every image's types are true for the vector of the same number
_IMAGE_TRUTH = "SELECT image_id AS query_id, damage_type AS label FROM fx_type_counts WHERE image_id IN (SELECT id FROM fx_vectors)"
_IMAGE_FOUND = "SELECT t.query_id, c.damage_type AS label FROM fx_top5 t JOIN fx_type_counts c ON c.image_id = t.id"
_BENCH = f"SELECT query_id, {bench('label')} AS label FROM ({{}})"


def _image_labels(v):
    from ...operators.shapes import with_types
    from .search import self_free_top5

    labels = with_types(v.boxes).select("image_id", F.col("damage_type").alias("label")).distinct()
    ids = v.queries.select("query_id")
    truth = labels.withColumnRenamed("image_id", "query_id").join(ids, "query_id", "left_semi")
    found = self_free_top5(v).select("query_id", F.col("id").alias("image_id")).join(labels, "image_id").select("query_id", "label")
    return found, truth


def _rounded(df):
    return df.select("query_id", "n_true", "n_hit", r("recall"))


@query("e2_set_recall_crops", _recall_sql("SELECT query_id, retrieved_type AS label FROM fx_top5x", "SELECT id AS query_id, label_raw AS label FROM fx_vectors"))
def _(v):
    from .search import seen

    found = seen(v).select("query_id", F.col("damage_type_original").alias("label"))
    truth = v.queries.select("query_id", F.col("expected_type").alias("label"))
    return _rounded(E.set_recall(found, truth))


@query("e3_set_recall_images", _recall_sql(_IMAGE_FOUND, _IMAGE_TRUTH))
def _(v):
    return _rounded(E.set_recall(*_image_labels(v)))


@query("e4_set_recall_benchmark", _recall_sql(_BENCH.format(_IMAGE_FOUND), _BENCH.format(_IMAGE_TRUTH)))
def _(v):
    return _rounded(E.set_recall(*_image_labels(v), label_space="benchmark"))


@query(
    "e5_recall_summary",
    f"""SELECT round(avg(recall), 6) AS avg_recall, round(stddev_pop(recall), 6) AS std_recall, round(median(recall), 6) AS median_recall,
               min(recall) AS min_recall, max(recall) AS max_recall FROM ({_recall_sql(_IMAGE_FOUND, _IMAGE_TRUTH).replace('round(count(f.label) / count(*)::double, 6)', '(count(f.label) / count(*)::double)')})""",
)
def _(v):
    out = E.recall_summary(E.set_recall(*_image_labels(v)))
    return out.select(r("avg_recall"), r("std_recall"), r("median_recall"), "min_recall", "max_recall")


_CASES = _recall_sql(_IMAGE_FOUND, _IMAGE_TRUTH)


@query(
    "a20_recall_buckets",
    f"""SELECT count(*) FILTER (recall = 0) AS zero, count(*) FILTER (recall > 0 AND recall <= 0.3) AS low,
               count(*) FILTER (recall > 0.3 AND recall <= 0.7) AS medium, count(*) FILTER (recall > 0.7) AS high FROM ({_CASES})""",
)
def _(v):
    return E.recall_buckets(E.set_recall(*_image_labels(v)))


@query(
    "a21_run_success",
    f"""SELECT count(*) AS total_cases, count(c.query_id) AS successful_cases, count(*) - count(c.query_id) AS failed_cases,
               round(count(c.query_id) / count(*)::double, 6) AS success_rate, round(avg(c.recall), 4) AS avg_recall
        FROM fx_vectors v LEFT JOIN ({_CASES}) c ON c.query_id = v.id""",
)
def _(v):
    # a query whose image has no labels counts as failed
    cases = v.queries.select("query_id").join(E.set_recall(*_image_labels(v)), "query_id", "left")
    out = E.run_success(cases.withColumn("error", F.when(F.col("recall").isNull(), "no ground truth")))
    return out.select("total_cases", "successful_cases", "failed_cases", r("success_rate"), r("avg_recall", 4))


@query(
    "e6_evaluate_configs",
    """SELECT config, num_queries, round(recall_at_5, 6) AS recall_at_5, round(mrr, 6) AS mrr FROM fx_metrics""",
)
def _(v):
    from ...sources.tables import list_configs
    from ..views import DENSITIES, EMBEDDING_TYPES
    from ..evaluate import evaluate_configs

    configs = list_configs(v.configs_vectors, EMBEDDING_TYPES, DENSITIES)
    corpora = v.configs_vectors.select("config", "id", "embedding", F.col("label_raw").alias("retrieved_type"))
    truth = v.truth.select("query_id", "expected_type").distinct()
    metrics = evaluate_configs(configs, corpora, v.queries.select("query_id", "embedding"), truth, exclude_self=True)
    return metrics.select("config", "num_queries", r("recall_at_5"), r("mrr"))


@query(
    "e7_executive_summary",
    """SELECT arg_max(config, (recall_at_5, -o)) AS best_recall, arg_max(config, (mrr, -o)) AS best_mrr, arg_min(config, (avg_total_time_ms, o)) AS fastest,
              round(min(recall_at_5), 6) AS min_recall, round(max(recall_at_5), 6) AS max_recall, round(max(recall_at_5) - min(recall_at_5), 6) AS recall_delta,
              round(min(mrr), 6) AS min_mrr, round(max(mrr), 6) AS max_mrr, round(min(avg_total_time_ms), 6) AS min_latency, round(max(avg_total_time_ms), 6) AS max_latency
       FROM (SELECT *, row_number() OVER (ORDER BY config) AS o FROM fx_metrics)""",
)
def _(v):
    out = E.executive_summary(v.metrics)
    names = ["best_recall", "best_mrr", "fastest"]
    return out.select(*names, *[r(c) for c in out.columns if c not in names])


@query(
    "e8_metrics_table",
    """SELECT row_number() OVER (ORDER BY recall_at_5 DESC, config) AS position, config, 'visual' AS embedding_type, split_part(config, '_', 2) AS density,
              round(recall_at_5, 6) AS recall_at_5, round(avg_total_time_ms, 6) AS avg_total_time_ms FROM fx_metrics""",
)
def _(v):
    return E.metrics_table(v.metrics).select(
        big("position"), "config", "embedding_type", "density", r("recall_at_5"), r("avg_total_time_ms")
    )


@query(
    "e9_by_embedding",
    """WITH m AS (SELECT 'visual' AS embedding_type, config, recall_at_5, mrr, avg_total_time_ms FROM fx_metrics UNION ALL
                  SELECT 'text', 'text_' || density, recall_at_5, mrr, avg_total FROM fx_text_metrics JOIN (
                    SELECT density, avg(value / length('text_' || density)) + avg(value * 3) AS avg_total
                    FROM events CROSS JOIN (VALUES ('high'), ('medium'), ('low')) d(density) GROUP BY density) USING (density)),
            t AS (SELECT embedding_type, count(*) AS n_configs, avg(recall_at_5) AS a, avg(mrr) AS b, avg(avg_total_time_ms) AS c FROM m GROUP BY embedding_type)
       SELECT embedding_type, n_configs, round(a, 6) AS mean_recall_at_5, round(b, 6) AS mean_mrr, round(c, 6) AS mean_latency_ms,
              a = max(a) OVER () AS is_best_recall, round(max(a) OVER () - a, 6) AS recall_gap, round(max(c) OVER () / c, 6) AS speed_up FROM t""",
)
def _(v):
    out = E.by_embedding(v.metrics_both)
    plain = ["embedding_type", "n_configs", "is_best_recall"]
    return out.select(*[c if c in plain else r(c) for c in out.columns])


@query(
    "e10_by_density",
    """SELECT split_part(config, '_', 2) AS density, count(*) AS n_configs, round(avg(recall_at_5), 6) AS mean_recall_at_5, round(avg(mrr), 6) AS mean_mrr
       FROM fx_metrics GROUP BY 1""",
)
def _(v):
    return E.by_density(v.metrics).select("density", "n_configs", r("mean_recall_at_5"), r("mean_mrr"))


@query(
    "e11_latency_top3",
    """SELECT kind, config, round(ms, 6) AS ms, rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ms, config) AS rank FROM (
         SELECT config, 'retrieval' AS kind, avg_retrieval_time_ms AS ms FROM fx_metrics UNION ALL SELECT config, 'generation', avg_generation_time_ms FROM fx_metrics
         UNION ALL SELECT config, 'total', avg_total_time_ms FROM fx_metrics)) WHERE rank <= 3""",
)
def _(v):
    # generation times are equal for all configurations up to summation order
    metrics = v.metrics.withColumns({c: F.round(c, 9) for c in ("avg_retrieval_time_ms", "avg_generation_time_ms", "avg_total_time_ms")})
    return E.latency_top3(metrics).select("kind", "config", r("ms"), big("rank"))


@query(
    "e12_retrieved_type_share",
    """SELECT config, retrieved_type, n, round(pct, 4) AS pct, rank FROM (SELECT *, n * 100.0 / sum(n) OVER (PARTITION BY config) AS pct,
              row_number() OVER (PARTITION BY config ORDER BY n DESC, retrieved_type) AS rank FROM (
         SELECT config, retrieved_type, count(*) AS n FROM fx_results GROUP BY ALL)) WHERE rank <= 5""",
)
def _(v):
    return E.retrieved_type_share(E.type_counts(v.results)).select("config", "retrieved_type", "n", r("pct", 4), big("rank"))


@query(
    "e13_recommend",
    """SELECT arg_max(config, (recall_at_5, -o)) AS for_precision, arg_min(config, (avg_total_time_ms, o)) AS for_speed,
              arg_max(config, (recall_at_5 * 0.7 - avg_total_time_ms / 1000 * 0.3, -o)) AS for_balance, round(max(recall_at_5 * 0.7 - avg_total_time_ms / 1000 * 0.3), 6) AS balance
       FROM (SELECT *, row_number() OVER (ORDER BY config) AS o FROM fx_metrics)""",
)
def _(v):
    return E.recommend(v.metrics).select("for_precision", "for_speed", "for_balance", r("balance"))


_FIRST = "SELECT config, query_id, row_number() OVER (PARTITION BY config ORDER BY query_id) AS query_no FROM (SELECT DISTINCT config, query_id FROM fx_judged)"


@query(
    "e14_detail_rows",
    f"""SELECT j.config, f.query_no, j.query_id, j.expected_type, j.rank, j.retrieved_type, j.is_match, round(j.distance, 6) AS distance,
              round(t.r, 6) AS retrieval_time_ms, round(t.g, 6) AS generation_time_ms,
              CASE j.query_id % 4 WHEN 0 THEN 'fenced' WHEN 1 THEN 'fenced' WHEN 2 THEN 'plain' ELSE 'broken' END AS answer_form
        FROM fx_judged j JOIN ({_FIRST}) f ON f.config = j.config AND f.query_id = j.query_id
        JOIN (SELECT config, query_id, avg(retrieval_time_ms) AS r, avg(generation_time_ms) AS g FROM fx_run_log GROUP BY ALL) t
          ON t.config = j.config AND t.query_id = j.query_id
        JOIN (SELECT DISTINCT image_id FROM fx_boxes) b ON b.image_id = j.query_id WHERE f.query_no <= 3""",
)
def _(v):
    answers = v.answers.withColumnRenamed("case_id", "query_id")
    rows = E.detail_rows(_judged(v), 3, v.run_log, answers).filter(F.col("generated_answer").isNotNull())
    text = F.col("generated_answer")
    form = F.when(F.startswith(text, F.lit("```")), "fenced").when(F.startswith(text, F.lit("{")), "plain").otherwise("broken")
    return rows.select(
        "config", big("query_no"), "query_id", "expected_type", "rank", "retrieved_type", "is_match", r("distance"),
        r("retrieval_time_ms"), r("generation_time_ms"), form.alias("answer_form"),
    )


@query("w6_first_queries_per_config", f"SELECT config, query_id, query_no FROM ({_FIRST}) WHERE query_no <= 3")
def _(v):
    return E.first_per_group(_judged(v), 3).select("config", "query_id", big("query_no")).distinct()


def _ndcg_sql(k: int) -> str:
    return (
        f"round(avg(CASE WHEN expected_type IS NOT NULL THEN CASE WHEN hits > 0 THEN dcg_{k} / "
        f"list_sum(list_transform(range(1, least(hits, {k}) + 1), lambda i: 1.0::double / log2(i + 1))) ELSE 0 END END), 6) AS ndcg_at_{k}"
    )


@query(
    "e15_ndcg",
    f"""SELECT config, {_ndcg_sql(5)}, {_ndcg_sql(10)}, round(avg(CASE WHEN expected_type IS NOT NULL THEN (hits > 0)::int END), 6) AS recall_at_10,
              round(avg(CASE WHEN expected_type IS NOT NULL THEN hits / 10.0::double END), 6) AS precision_at_10 FROM (
         SELECT config, query_id, expected_type, count(*) FILTER (is_match) AS hits,
                coalesce(sum(1.0::double / log2(rank + 1)) FILTER (is_match AND rank <= 5), 0) AS dcg_5,
                coalesce(sum(1.0::double / log2(rank + 1)) FILTER (is_match), 0) AS dcg_10
         FROM fx_judged10 GROUP BY config, query_id, expected_type) GROUP BY config""",
)
def _(v):
    out = E.retrieval_metrics(E.judged(v.results10, v.truth), ks=(1, 3, 5, 10), ndcg=(5, 10))
    return out.select("config", *[r(c) for c in ("ndcg_at_5", "ndcg_at_10", "recall_at_10", "precision_at_10")])


@query(
    "e16_latency_percentiles",
    """SELECT config, round(quantile_cont(t, 0.5), 6) AS p50_ms, round(quantile_cont(t, 0.95), 6) AS p95_ms, round(quantile_cont(t, 0.99), 6) AS p99_ms,
              round(count(*) * 1000.0 / sum(t), 6) AS queries_per_second FROM (SELECT config, retrieval_time_ms + generation_time_ms AS t FROM fx_run_log) GROUP BY config""",
)
def _(v):
    out = E.latency_percentiles(v.run_log)
    return out.select("config", *[r(c) for c in out.columns if c != "config"])


@query(
    "e17_answer_quality",
    f"""WITH t AS (SELECT DISTINCT image_id AS case_id, {bench('label')} AS label FROM fx_boxes),
        c AS (SELECT DISTINCT image_id AS case_id, {bench('label')} AS label FROM fx_polygons),
        a AS (SELECT * FROM t WHERE case_id % 4 < 3),
        per AS (SELECT c.case_id, count(a.label) AS n_a, count(t.label) AS n_t FROM c LEFT JOIN t USING (case_id, label) LEFT JOIN a USING (case_id, label) GROUP BY c.case_id)
        SELECT count(*) AS n_cases, round(avg(n_a / nullif(n_t, 0)::double), 6) AS correctness, round(coalesce(avg(n_a / nullif(n_a, 0)::double), 0), 6) AS faithfulness,
               0.0::double AS invented_rate FROM per""",
)
def _(v):
    parsed = E.parse_answers(v.answers)
    said = parsed.select("case_id", F.explode("damages").alias("d")).select("case_id", F.col("d.type").alias("label"))
    truth = v.boxes.select(F.col("image_id").alias("case_id"), "label")
    context = v.polygons.select(F.col("image_id").alias("case_id"), "label")
    return E.answer_quality(said, truth, context).select("n_cases", r("correctness"), r("faithfulness"), r("invented_rate"))


@query(
    "e18_class_coverage",
    """SELECT query_has_damage, count(*) AS n_queries, round(avg(share), 6) AS coverage, avg(share) >= 0.6 AS is_enough FROM (
         SELECT s.query_id, q.has_damage AS query_has_damage, count(*) FILTER (s.has_damage = q.has_damage) / 5.0::double AS share
         FROM fx_seen s JOIN fx_vectors q ON q.id = s.query_id GROUP BY ALL) GROUP BY query_has_damage""",
)
def _(v):
    from .search import seen

    rows = seen(v).join(v.queries.select("query_id", "query_has_damage"), "query_id")
    return E.class_coverage(rows).select("query_has_damage", "n_queries", r("coverage"), "is_enough")


@query(
    "e19_context_checks",
    """SELECT has_damage, count(*) AS n_texts, count(*) FILTER (length(description) <= 50) AS n_short,
              count(*) FILTER (NOT contains(description, zone_description)) AS n_without_zone,
              count(*) FILTER (NOT CASE WHEN has_damage THEN contains(lower(description), 'damage') AND total_defects > 0
                ELSE contains(lower(description), 'no damage') OR contains(lower(description), 'clean') END) AS n_without_word
       FROM fx_records GROUP BY has_damage""",
)
def _(v):
    return E.context_checks(v.records)


# Members of merged clusters, each with a region vector where its image has one, as two indexes: single
# boxes under their own type, clusters under the dominant one with the mean of their members' vectors.
_STRATEGIES = f"""{_MERGES},
    box_vectors AS (
      SELECT m.image_id, m.seed_idx, m.image_id || ':' || m.shape_idx AS id, m.damage_type AS item_type, e.embedding
      FROM members m JOIN fx_vectors i ON i.id = m.image_id JOIN fx_vectors e ON e.id = m.shape_idx % (SELECT count(*) FROM fx_vectors)),
    pooled AS (
      SELECT p.image_id || ':' || p.seed_idx AS id, c.dominant_type AS item_type, p.embedding
      FROM (SELECT image_id, seed_idx, list(m ORDER BY d) AS embedding FROM (
              SELECT image_id, seed_idx, d, round(avg(x), 6) AS m FROM (
                SELECT image_id, seed_idx, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS d FROM box_vectors) GROUP BY ALL)
            GROUP BY ALL) p JOIN cluster_rows c USING (image_id, seed_idx)),
    asked AS (
      SELECT v.id AS query_id, v.embedding, coalesce(l.damage_type, 'unknown') AS expected_type FROM fx_vectors v LEFT JOIN dim_labels l ON l.label = v.label_raw)"""


#: Of a broadcast number, with what a hash table needs for it.
ID_BYTES = 64
#: What clusters are made from: the sweep moves whole rows.
_SWEPT = ["image_id", "shape_idx", "damage_type", "x_min", "y_min", "x_max", "y_max"]


def _strategy_recall(index: str) -> str:
    return f"""SELECT expected_type AS dataset, avg(hit) AS recall, count(*) AS n_queries FROM (
        SELECT query_id, expected_type, max(CASE WHEN item_type = expected_type THEN 1 ELSE 0 END) AS hit FROM (
          SELECT q.query_id, q.expected_type, c.item_type, row_number() OVER (PARTITION BY q.query_id ORDER BY {l2sq('q.embedding', 'c.embedding')}, c.id) AS rank
          FROM asked q CROSS JOIN {index} c) WHERE rank <= 5 GROUP BY ALL) GROUP BY expected_type"""


def _strategy_indexes(v):
    """Single boxes and clusters, each as rows (``id, item_type, ref``) and the vectors that these name (``ref, embedding``).

    A box has the vector numbered by its key, and a cluster of one box the pooled vector of that number: many rows name one vector.
    """
    n = v.vectors.count()
    have = v.vectors.select(F.col("id").alias("image_id"))
    given = v.vectors.select(F.col("id").cast("string").alias("ref"), "embedding")
    # clusters never leave their image: only images that have a vector are swept, once, and every index is searched as a table;
    # their numbers are broadcast while they are few, so that the boxes of all other images are read once and never moved
    have = F.broadcast(have) if n * ID_BYTES <= BROADCAST_BYTES else have
    members = stored(R.cluster_boxes(stored(v.typed_boxes.select(*_SWEPT).join(have, "image_id", "left_semi"))))
    key = lambda c: F.concat_ws(":", "image_id", c)
    placed = members.withColumn("ref", (F.col("shape_idx") % n).cast("string"))
    cluster, box = ["image_id", "seed_idx"], ["image_id", "shape_idx"]
    sizes = placed.groupBy(*cluster).agg(F.count(F.lit(1)).alias("_n"), F.min("ref").alias("_one"))
    lone = sizes.filter("_n = 1").select(F.col("_one").alias("ref")).distinct().withColumn("_of", F.col("ref"))
    several = placed.join(sizes.filter("_n > 1"), cluster, "left_semi")
    theirs = placed.join(several.select(*box), box, "left_semi").join(given, "ref")
    pooled = E.pool_members(several, theirs, cluster, box).select(key("seed_idx").alias("ref"), "embedding")
    pooled = pooled.unionByName(E.pool_members(lone, given.withColumnRenamed("ref", "_of"), ["ref"], ["_of"]))
    named = R.clusters(members).select(*cluster, "dominant_type").join(sizes, cluster)
    own = F.when(F.col("_n") == 1, F.col("_one")).otherwise(key("seed_idx"))
    return (
        placed.select(key("shape_idx").alias("id"), F.col("damage_type").alias("item_type"), "ref"),
        given,
        stored(named.select(key("seed_idx").alias("id"), F.col("dominant_type").alias("item_type"), own.alias("ref"))),
        stored(pooled),
    )


def _strategy_recalls(v):
    """Recall by type of single boxes and of clusters, one searched after the other."""
    boxes, given, clusters, pooled = _strategy_indexes(v)
    return tuple(stored(E.recall_by_type(_asked(v), rows, vectors=vectors)) for rows, vectors in ((boxes, given), (clusters, pooled)))


def _asked(v):
    return v.queries.select("query_id", "embedding", L.canonical_label(F.col("expected_type")).alias("expected_type"))


@query(
    "e20_strategy_recall",
    f"""WITH {_STRATEGIES} SELECT 'individual' AS strategy, dataset, round(recall, 6) AS recall, n_queries FROM ({_strategy_recall("box_vectors")})
        UNION ALL SELECT 'clustered', dataset, round(recall, 6), n_queries FROM ({_strategy_recall("pooled")})""",
)
def _(v):
    named = zip(("individual", "clustered"), _strategy_recalls(v))
    one, two = (recall.select(F.lit(n).alias("strategy"), "dataset", r("recall"), "n_queries") for n, recall in named)
    return one.unionByName(two)


@query(
    "e20_compare_strategies",
    f"""WITH {_STRATEGIES} SELECT a.damage_type AS dataset, round(1 - b.n / a.n, 6) AS reduction, round(p.recall / nullif(s.recall, 0), 6) AS recall_kept, round(a.n / b.n, 6) AS speed_up,
              1 - b.n / a.n >= 0.55 AS enough_reduction, p.recall / nullif(s.recall, 0) >= 0.95 AS recall_is_kept, a.n / b.n >= 2 AS fast_enough
        FROM (SELECT damage_type, count(*)::double AS n FROM fx_placed WHERE area BETWEEN 50 AND 500000 GROUP BY 1) a
        JOIN (SELECT dominant_type, count(*)::double AS n FROM cluster_rows GROUP BY 1) b ON b.dominant_type = a.damage_type
        LEFT JOIN ({_strategy_recall("box_vectors")}) s ON s.dataset = a.damage_type LEFT JOIN ({_strategy_recall("pooled")}) p ON p.dataset = a.damage_type""",
)
def _(v):
    # per damage type: individual crops against clustered ones; time grows with the number of regions
    count = F.count(F.lit(1)).alias("n_regions")
    individual = stored(R.individual_regions(v.images, v.polygons).groupBy(F.col("damage_type").alias("dataset")).agg(count))
    clusters = R.plan_clusters(v.typed_boxes.select(*_SWEPT))[1]
    clustered = stored(clusters.groupBy(F.col("dominant_type").alias("dataset")).agg(count))
    single, pooled = (recall.drop("n_queries") for recall in _strategy_recalls(v))
    summary = lambda df, recall: df.join(recall, "dataset", "left").select("dataset", "n_regions", "recall", (F.col("n_regions") * 0.0058).alias("seconds"))
    out = E.compare_strategies(summary(individual, single), summary(clustered, pooled))
    return out.select("dataset", *[r(c) for c in ("reduction", "recall_kept", "speed_up")], "enough_reduction", "recall_is_kept", "fast_enough")
