"""Retrieval metrics, comparison tables and answer quality.

Results are rows ``config, query_id, rank, id, distance, retrieved_type``; truth
has ``query_id, expected_type``. Everything groups by (config, query) first and
by config second, so partial aggregation does most of the work.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as X
from ..ranks import exact_percentiles
from ..schemas import ANSWER
from .profile import all_rows, top_n
from .search import knn, knn_referred

KS = (1, 3, 5)


# -- results ---------------------------------------------------------------


def judged(results: DataFrame, truth: DataFrame, label_space: str = "benchmark") -> DataFrame:
    """Result rows with ``expected_type`` and ``is_match``, both sides in one label space.

    Queries without results stay, with NULL rank, for the counts.
    """
    expected = truth.select(*truth.columns).withColumn(
        "expected_type", F.nullif(F.col("expected_type"), F.lit(""))
    )
    keys = [c for c in ("config", "query_id") if c in truth.columns and c in results.columns]
    out = expected.join(results, keys, "left")
    same = L.in_label_space(F.col("retrieved_type"), label_space) == L.in_label_space(F.col("expected_type"), label_space)
    known = F.col("expected_type").isNotNull() & F.col("retrieved_type").isNotNull()
    return out.withColumn("is_match", known & F.coalesce(same, F.lit(False)))


def first_hit_rank(judged_rows: DataFrame) -> DataFrame:
    """Rank of the first correct result per query; NULL when there is none."""
    return judged_rows.groupBy("config", "query_id", "expected_type").agg(
        F.min(F.when(F.col("is_match"), F.col("rank"))).alias("first_hit")
    )


def per_query(judged_rows: DataFrame, ks: tuple = KS, ndcg: tuple = ()) -> DataFrame:
    """Hits within k and the first hit of each query; nDCG on request."""
    hit = lambda k: F.count_if(F.col("is_match") & (F.col("rank") <= k))
    gain = lambda k: F.sum(
        F.when(F.col("is_match") & (F.col("rank") <= k), 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    )
    aggs = [hit(k).alias(f"hits_{k}") for k in ks] + [gain(k).alias(f"dcg_{k}") for k in ndcg]
    aggs.append(F.count_if("is_match").alias("hits_all"))
    aggs.append(F.min(F.when(F.col("is_match"), F.col("rank"))).alias("first_hit"))
    return judged_rows.groupBy("config", "query_id", "expected_type").agg(*aggs)


def retrieval_metrics(judged_rows: DataFrame, ks: tuple = KS, ndcg: tuple = (), run_log: DataFrame | None = None) -> DataFrame:
    """One metric row per configuration.

    Recall@k is hit or no hit, Precision@k divides by k, MRR looks at the whole
    list. Queries without an expected type only count in ``num_queries`` and in
    the latency means, which come from ``run_log`` (config, query_id,
    retrieval_time_ms, generation_time_ms). nDCG@k takes the query's retrieved
    matches as its ideal list. A list that ends before the largest k because it was
    not searched deep enough is the caller's to avoid: search with that k.
    """
    q = per_query(judged_rows, ks, ndcg)
    known = F.col("expected_type").isNotNull()
    mean = lambda c: F.coalesce(F.avg(F.when(known, c)), F.lit(0.0))
    aggs = []
    for k in ks:
        aggs.append(mean((F.col(f"hits_{k}") > 0).cast("double")).alias(f"recall_at_{k}"))
        aggs.append(mean(F.col(f"hits_{k}") / F.lit(k)).alias(f"precision_at_{k}"))
    aggs.append(mean(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))).alias("mrr"))
    for k in ndcg:
        best = F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("hits_all"), F.lit(k))).cast("int")),
            F.lit(0.0),
            lambda acc, i: acc + 1.0 / F.log2(i.cast("double") + 1),
        )
        aggs.append(mean(F.col(f"dcg_{k}") / best).alias(f"ndcg_at_{k}"))
    aggs.append(F.count(F.lit(1)).alias("num_queries"))
    metrics = q.groupBy("config").agg(*aggs)
    if run_log is not None:
        metrics = metrics.join(latency_means(run_log), "config", "left")
    return metrics


def latency_means(run_log: DataFrame) -> DataFrame:
    return run_log.groupBy("config").agg(
        F.avg("retrieval_time_ms").alias("avg_retrieval_time_ms"),
        F.avg("generation_time_ms").alias("avg_generation_time_ms"),
        (F.avg("retrieval_time_ms") + F.avg("generation_time_ms")).alias("avg_total_time_ms"),
    )


def type_counts(results: DataFrame, k: int = 5) -> DataFrame:
    """Retrieved types among the first k, long form."""
    kept = results.filter(F.col("rank") <= k)
    return kept.groupBy("config", "retrieved_type").agg(F.count(F.lit(1)).alias("n"))


def latency_percentiles(run_log: DataFrame) -> DataFrame:
    """p50, p95, p99 and throughput from recorded times."""
    timed = run_log.select("config", (F.col("retrieval_time_ms") + F.col("generation_time_ms")).alias("total_ms"))
    points = exact_percentiles(timed, ["config"], "total_ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    rate = timed.groupBy("config").agg(
        (F.count(F.lit(1)) * 1000.0 / F.nullif(F.sum("total_ms"), F.lit(0.0))).alias("queries_per_second")
    )
    return points.join(rate, "config")


# -- set recall ----------------------------------------------------------------


def overlap_size(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(F.array_distinct(a), F.array_distinct(b)))


def set_difference(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def set_recall(results: DataFrame, truth_labels: DataFrame, label_space: str = "raw") -> DataFrame:
    """Share of a case's true labels that occur among its retrieved labels.

    ``results`` is ``query_id, label`` (one row per retrieved label; flattened
    image labels simply give more rows), ``truth_labels`` is ``query_id, label``.
    Labels become distinct per case before the join, which bounds its fan-out by
    the taxonomy.
    """
    space = lambda df: df.select("query_id", L.in_label_space(F.col("label"), label_space).alias("label")).distinct()
    truth, found = space(truth_labels), space(results).withColumn("_found", F.lit(1))
    return (
        truth.join(found, ["query_id", "label"], "left")
        .groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("n_true"), F.count("_found").alias("n_hit"))
        .withColumn("recall", F.col("n_hit") / F.col("n_true"))
    )


def recall_summary(cases: DataFrame, recall: str = "recall") -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return cases.agg(
        zero(F.avg(recall)).alias("avg_recall"),
        zero(F.stddev_pop(recall)).alias("std_recall"),
        zero(F.median(recall)).alias("median_recall"),
        zero(F.min(recall)).alias("min_recall"),
        zero(F.max(recall)).alias("max_recall"),
    )


def recall_buckets(cases: DataFrame, recall: str = "recall") -> DataFrame:
    r = F.col(recall)
    return cases.agg(
        F.count_if(r == 0).alias("zero"),
        F.count_if((r > 0) & (r <= 0.3)).alias("low"),
        F.count_if((r > 0.3) & (r <= 0.7)).alias("medium"),
        F.count_if(r > 0.7).alias("high"),
    )


def run_success(cases: DataFrame) -> DataFrame:
    """Success counts; the recall mean covers successful cases and is 0 without any."""
    ok = F.col("error").isNull()
    n = F.count(F.lit(1))
    return cases.agg(
        n.alias("total_cases"),
        F.count_if(ok).alias("successful_cases"),
        F.count_if(~ok).alias("failed_cases"),
        F.coalesce(F.count_if(ok) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.avg(F.when(ok, F.col("recall"))), F.lit(0.0)).alias("avg_recall"),
    )


# -- comparison tables -----------------------------------------------------------


def best(metrics: DataFrame, column: str) -> Column:
    """Configuration with the highest value (the first by name on ties), as an aggregate."""
    return F.max_by("config", F.struct(F.col(column), -F.col("_order")))


def worst(metrics: DataFrame, column: str) -> Column:
    return F.min_by("config", F.struct(F.col(column), F.col("_order")))


def _ordered(metrics: DataFrame) -> DataFrame:
    """Number the metric rows by name. There is one per configuration."""
    return metrics.withColumn("_order", F.row_number().over(all_rows().orderBy("config")))


def executive_summary(metrics: DataFrame) -> DataFrame:
    m = _ordered(metrics)
    recall, mrr, latency = "recall_at_5", "mrr", "avg_total_time_ms"
    return m.agg(
        best(m, recall).alias("best_recall"),
        best(m, mrr).alias("best_mrr"),
        worst(m, latency).alias("fastest"),
        F.min(recall).alias("min_recall"),
        F.max(recall).alias("max_recall"),
        (F.max(recall) - F.min(recall)).alias("recall_delta"),
        F.min(mrr).alias("min_mrr"),
        F.max(mrr).alias("max_mrr"),
        F.min(latency).alias("min_latency"),
        F.max(latency).alias("max_latency"),
    )


def split_name(metrics: DataFrame) -> DataFrame:
    """Embedding and density from ``<embedding>_<density>``."""
    parts = F.split("config", "_")
    return metrics.withColumns(
        {"embedding_type": F.get(parts, F.lit(0)), "density": F.coalesce(F.get(parts, F.lit(1)), F.lit("unknown"))}
    )


def metrics_table(metrics: DataFrame) -> DataFrame:
    order = F.row_number().over(all_rows().orderBy(F.desc("recall_at_5"), "config"))
    return split_name(metrics).withColumn("position", order)


def by_embedding(metrics: DataFrame) -> DataFrame:
    """Means per embedding type with the lead in recall and the speed-up over the slowest."""
    m = split_name(metrics).groupBy("embedding_type").agg(
        F.count(F.lit(1)).alias("n_configs"),
        F.avg("recall_at_5").alias("mean_recall_at_5"),
        F.avg("mrr").alias("mean_mrr"),
        F.avg("avg_total_time_ms").alias("mean_latency_ms"),
    )
    return m.withColumns(
        {
            "is_best_recall": F.col("mean_recall_at_5") == F.max("mean_recall_at_5").over(all_rows()),
            "recall_gap": F.max("mean_recall_at_5").over(all_rows()) - F.col("mean_recall_at_5"),
            "speed_up": F.max("mean_latency_ms").over(all_rows()) / F.nullif(F.col("mean_latency_ms"), F.lit(0.0)),
        }
    )


def by_density(metrics: DataFrame) -> DataFrame:
    return split_name(metrics).groupBy("density").agg(
        F.count(F.lit(1)).alias("n_configs"),
        F.avg("recall_at_5").alias("mean_recall_at_5"),
        F.avg("mrr").alias("mean_mrr"),
    )


def latency_top3(metrics: DataFrame, n: int = 3) -> DataFrame:
    """Fastest configurations by retrieval, generation and total time."""
    kinds = {"retrieval": "avg_retrieval_time_ms", "generation": "avg_generation_time_ms", "total": "avg_total_time_ms"}
    long = metrics.select(
        "config", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("ms")) for k, c in kinds.items()])).alias("t")
    ).select("config", "t.kind", "t.ms")
    return top_n(long, ["kind"], [F.asc("ms"), F.asc("config")], n)


def retrieved_type_share(counts: DataFrame, n: int = 5) -> DataFrame:
    """Top types of each configuration with their share of all its retrieved types."""
    total = F.sum("n").over(Window.partitionBy("config"))
    return top_n(counts.withColumn("pct", F.col("n") * 100.0 / total), ["config"], [F.desc("n"), F.asc("retrieved_type")], n)


def recommend(metrics: DataFrame) -> DataFrame:
    """Best recall, fastest, and best balance of 0.7 recall against 0.3 latency in seconds."""
    scored = _ordered(metrics).withColumn("balance", F.col("recall_at_5") * 0.7 - F.col("avg_total_time_ms") / 1000 * 0.3)
    return scored.agg(
        best(scored, "recall_at_5").alias("for_precision"),
        worst(scored, "avg_total_time_ms").alias("for_speed"),
        best(scored, "balance").alias("for_balance"),
        F.max("balance").alias("balance"),
    )


def rank_by(df: DataFrame, column: str, key: str, descending: bool = True, limit: int | None = None) -> DataFrame:
    out = df.orderBy(F.desc(column) if descending else F.asc(column), F.asc(key))
    return out.limit(limit) if limit else out


def first_per_group(results: DataFrame, n: int = 3) -> DataFrame:
    """Rows of the first n queries of each configuration."""
    queries = results.select("config", "query_id").distinct()
    return results.join(top_n(queries, ["config"], [F.col("query_id")], n, "query_no"), ["config", "query_id"])


def detail_rows(judged_rows: DataFrame, n: int = 3, run_log: DataFrame | None = None, answers: DataFrame | None = None) -> DataFrame:
    """Expected and ranked types, match flag and distance of the first queries, with their mean times and answer where given.

    ``run_log`` has ``config, query_id`` and the two times, ``answers`` ``query_id`` and ``generated_answer``.
    """
    rows = first_per_group(judged_rows, n)
    columns = ["config", "query_no", "query_id", "expected_type", "rank", "retrieved_type", "is_match", "distance"]
    if run_log is not None:
        times = ["retrieval_time_ms", "generation_time_ms"]
        asked = rows.select("config", "query_id").distinct()
        means = run_log.join(asked, ["config", "query_id"], "left_semi").groupBy("config", "query_id").agg(*[F.avg(t).alias(t) for t in times])
        rows, columns = rows.join(means, ["config", "query_id"], "left"), columns + times
    if answers is not None:
        rows, columns = rows.join(answers.select("query_id", "generated_answer"), "query_id", "left"), columns + ["generated_answer"]
    return rows.select(*columns)


def merge_results(left: DataFrame, right: DataFrame, key: str = "config") -> DataFrame:
    """Both result sets; where a configuration is in both, the right one wins."""
    return right.unionByName(left.join(right.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def pool_members(members: DataFrame, vectors: DataFrame, by: list[str], on: list[str], digits: int = 6) -> DataFrame:
    """``by`` and ``embedding``: the mean of the members' vectors, combined before the shuffle.

    Members without a vector, or with a null one, take no part; a group without any is left out. Means are rounded, so
    that groups of equal members tie whatever the order of addition.
    """
    known = members.select(*dict.fromkeys([*by, *on])).join(vectors.select(*on, F.col("embedding").alias("_v")).filter("_v is not null"), on)
    means = known.groupBy(*by).agg(Summarizer.mean(array_to_vector(F.col("_v").cast("array<double>"))).alias("_m"))
    return means.select(*by, F.transform(vector_to_array("_m"), lambda x: F.round(x, digits)).alias("embedding"))


def recall_by_type(queries: DataFrame, index: DataFrame, k: int = 5, vectors: DataFrame | None = None) -> DataFrame:
    """``dataset, recall, n_queries``: share of each expected type's queries with that type among the k nearest of ``index``.

    ``queries`` has ``query_id, embedding, expected_type``, ``index`` has ``id, embedding, item_type``, or ``id, ref,
    item_type`` where ``vectors`` has ``ref, embedding``. Queries without an expected type are left out; one that finds nothing
    counts as a miss.
    """
    asked = queries.filter("expected_type is not null")
    near = knn(asked, index, k).join(index.select("id", "item_type"), "id") if vectors is None else knn_referred(asked, index, vectors, k)
    hits = (
        near.select("query_id", "item_type")
        .join(asked.select("query_id", "expected_type"), "query_id")
        .groupBy("query_id")
        .agg(F.max((F.col("item_type") == F.col("expected_type")).cast("int")).alias("_hit"))
    )
    judged = asked.select("query_id", F.col("expected_type").alias("dataset")).join(hits, "query_id", "left")
    return judged.groupBy("dataset").agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"), F.count(F.lit(1)).alias("n_queries"))


def compare_strategies(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Reduction, kept recall and speed-up of two one-row strategy summaries.

    Both have ``dataset, n_regions, recall, seconds``.
    """
    b = base.select("dataset", *[F.col(c).alias(f"base_{c}") for c in ("n_regions", "recall", "seconds")])
    j = candidate.join(b, "dataset")
    ratio = lambda a, c: F.col(a) / F.nullif(F.col(c).cast("double"), F.lit(0.0))
    j = j.withColumns(
        {
            "reduction": 1 - ratio("n_regions", "base_n_regions"),
            "recall_kept": ratio("recall", "base_recall"),
            "speed_up": ratio("base_seconds", "seconds"),
        }
    )
    return j.select(
        "dataset",
        "reduction",
        "recall_kept",
        "speed_up",
        (F.col("reduction") >= 0.55).alias("enough_reduction"),
        (F.col("recall_kept") >= 0.95).alias("recall_is_kept"),
        (F.col("speed_up") >= 2.0).alias("fast_enough"),
    )


# -- coverage, context and answers --------------------------------------------------


def class_coverage(hits: DataFrame, k: int = 5, threshold: float = 0.6) -> DataFrame:
    """Mean share of the first k results with the query's own damage flag.

    ``hits`` has ``query_has_damage`` and ``has_damage``.
    """
    same = F.col("query_has_damage") == F.col("has_damage")
    per = hits.filter(F.col("rank") <= k).groupBy("query_id", "query_has_damage").agg((F.count_if(same) / k).alias("_share"))
    return (
        per.groupBy("query_has_damage")
        .agg(F.count(F.lit(1)).alias("n_queries"), F.avg("_share").alias("coverage"))
        .withColumn("is_enough", F.col("coverage") >= threshold)
    )


def context_checks(records: DataFrame, text: str = "description") -> DataFrame:
    """Counts of texts that are too short, do not name the zone, or lack the expected word."""
    t = F.col(text)
    low = F.lower(t)
    word = F.when(F.col("has_damage"), F.contains(low, F.lit("damage")) & (F.col("total_defects") > 0)).otherwise(
        F.contains(low, F.lit("no damage")) | F.contains(low, F.lit("clean"))
    )
    return records.groupBy("has_damage").agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.count_if(F.length(t) <= 50).alias("n_short"),
        F.count_if(~F.contains(t, F.col("zone_description"))).alias("n_without_zone"),
        F.count_if(~word).alias("n_without_word"),
    )


def parse_answers(answers: DataFrame, column: str = "generated_answer") -> DataFrame:
    """Parsed damages and summary; an answer that is not JSON stays as ``raw_text``."""
    parsed = F.from_json(X.strip_fence(F.col(column)), ANSWER)
    ok = parsed["damages"].isNotNull() | parsed["summary"].isNotNull()
    return answers.withColumns(
        {
            "damages": parsed["damages"],
            "summary": parsed["summary"],
            "raw_text": F.when(~F.coalesce(ok, F.lit(False)), F.col(column)),
        }
    )


def answer_quality(answers: DataFrame, truth: DataFrame, context: DataFrame) -> DataFrame:
    """Correct, supported and invented types per case.

    ``answers``, ``truth`` and ``context`` are ``case_id, label`` rows; labels are
    compared in the benchmark space. An invented type is in neither the truth
    nor the context.
    """
    space = lambda df, flag: df.select(
        "case_id", L.benchmark_label(F.col("label")).alias("label"), F.lit(1).alias(flag)
    ).distinct()
    joined = (
        space(answers, "_a").join(space(truth, "_t"), ["case_id", "label"], "full").join(
            space(context, "_c"), ["case_id", "label"], "full"
        )
    )
    a, t, c = (F.col(x).isNotNull() for x in ("_a", "_t", "_c"))
    per = joined.groupBy("case_id").agg(
        F.count_if(a).alias("n_answered"),
        F.count_if(t).alias("n_true"),
        F.count_if(a & t).alias("n_correct"),
        F.count_if(a & c).alias("n_supported"),
        F.count_if(a & ~t & ~c).alias("n_invented"),
    )
    share = lambda x, y: F.coalesce(F.avg(F.col(x) / F.nullif(F.col(y), F.lit(0))), F.lit(0.0))
    return per.agg(
        F.count(F.lit(1)).alias("n_cases"),
        share("n_correct", "n_true").alias("correctness"),
        share("n_supported", "n_answered").alias("faithfulness"),
        share("n_invented", "n_answered").alias("invented_rate"),
    )


# -- context and prompts --------------------------------------------------------------

NO_CROPS = "No similar examples found."
NO_IMAGES = "No similar examples found in the database."


def _context(rows: DataFrame, by: list[str], line: Column, head: str, max_examples: int) -> DataFrame:
    kept = rows.filter(F.col("rank") <= max_examples)
    examples = F.sort_array(F.collect_list(F.struct("rank", line.alias("text"))))
    body = F.array_join(F.transform(examples, lambda e: e["text"]), "\n")
    return kept.groupBy(*by).agg(F.concat(F.lit(head + "\n"), body).alias("context"))


def with_missing(contexts: DataFrame, queries: DataFrame, by: list[str], text: str) -> DataFrame:
    """Queries without any result get the fixed text."""
    return queries.select(*by).join(contexts, by, "left").withColumn("context", F.coalesce("context", F.lit(text)))


def context_crops(results: DataFrame, by: list[str] | None = None, max_examples: int = 3, include_confidence: bool = False) -> DataFrame:
    """Context of each query from its best crops.

    Needs ``rank, damage_type, spatial_zone, distance, confidence,
    damage_type_original`` and, for clusters, ``all_damage_types`` (one entry per
    distinct type; listed in order of name).
    """
    similarity = F.format_string("%.1f", (1 - F.col("distance")) * 100)
    types = F.col("all_damage_types")
    line = F.concat(
        F.lit("\n### Example "), F.col("rank").cast("string"), F.lit(":\n- **Damage Type**: "), F.col("damage_type"),
        F.lit("\n- **Vehicle Area**: "), L.display_zone(F.col("spatial_zone")),
        F.lit("\n- **Similarity**: "), similarity, F.lit("%"),
        F.when(
            F.lit(include_confidence) & (F.col("confidence") < 0.95),
            F.concat(F.lit("\n- **Note**: Approximate match (original: "), F.col("damage_type_original"), F.lit(")")),
        ).otherwise(""),
        F.when(
            F.size(types) > 1,
            F.concat(F.lit("\n- **Additional damages**: "), F.array_join(F.sort_array(F.array_distinct(types)), ", ")),
        ).otherwise(""),
    )
    return _context(results, by or ["query_id"], line, "## Similar Verified Cases:\n", max_examples)


def context_images(results: DataFrame, by: list[str] | None = None, max_examples: int = 3, include_spatial: bool = True) -> DataFrame:
    """Context of each query from its best images.

    Needs ``rank, description, distance, total_defects, type_counts,
    zone_description, zone_area, zone_counts``.
    """
    similarity = F.format_string("%.1f", (1 - F.col("distance")) * 100)
    types = F.array_join(F.transform(X.by_count(F.col("type_counts")), lambda c: L.benchmark_label(c["name"])), ", ")
    zones = F.col("zone_counts")
    line = F.concat(
        F.lit("\n### Example "), F.col("rank").cast("string"), F.lit(":\n**Description**: "), F.col("description"),
        F.lit("\n**Similarity**: "), similarity, F.lit("%\n**Total defects**: "), F.col("total_defects").cast("string"),
        F.lit("\n**Damage types**: "), types,
        F.lit("\n**Vehicle zone**: "), F.col("zone_description"), F.lit(" ("), F.col("zone_area"), F.lit(")"),
        F.when(
            F.lit(include_spatial) & (F.size(zones) > 0),
            F.concat(F.lit("\n**Spatial distribution**: "), X.format_spatial(zones)),
        ).otherwise(""),
        F.lit("\n"),
    )
    return _context(results, by or ["query_id"], line, "## Similar Verified Cases from Database:\n", max_examples)


PROMPT = (
    "You inspect vehicle damage. Name each damage type, where it is and how severe it is.\n\n"
    "Similar verified cases:\n%s\n\n"
    'Answer as JSON: {"damages": [{"type": "", "location": "", "severity": ""}], "summary": ""}'
)


def build_prompts(contexts: DataFrame, template: str = PROMPT) -> DataFrame:
    return contexts.withColumn("prompt", F.format_string(template, F.col("context")))


def retrieved_zones(results: DataFrame) -> DataFrame:
    return results.groupBy("query_id", "vehicle_zone").agg(F.count(F.lit(1)).alias("n"))
