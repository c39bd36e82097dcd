"""Metrics, comparison tables and texts built from results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from defectlens.operators import evaluate as E
from defectlens.operators.profile import top_n

# Stored metrics of one recorded run: recall@1/3/5, precision@5, mrr, latency and
# the retrieved types, for two embeddings at three densities. Fixed values.
RUN = {
    "visual_high": (1.0, 1.0, 1.0, 0.9419921874999999, 1.0, 0.0724459532648325),
    "visual_medium": (0.8916015625, 0.9541015625, 0.9599609375, 0.880859375, 0.9225423177083333, 0.04754704423248768),
    "visual_low": (0.4951171875, 0.8642578125, 0.9560546875, 0.36601562500000007, 0.6771972656249999, 0.015522819012403488),
    "text_high": (1.0, 1.0, 1.0, 0.9822265625, 1.0, 0.046529341489076614),
    "text_medium": (0.9619140625, 0.9853515625, 0.986328125, 0.961328125, 0.9730631510416667, 0.029674731194972992),
    "text_low": (0.9462890625, 0.9765625, 0.98828125, 0.9246093750000001, 0.9629231770833333, 0.014463439583778381),
}
TYPES = {
    "visual_low": {"misaligned_part": 101, "paint_peeling": 830, "deep_scratch": 46, "dent": 1359, "crack": 758, "surface_scratch": 1937, "missing_part": 89},
}


@pytest.fixture(scope="module")
def run(spark):
    rows = [(c, *v[:3], v[3], v[4], v[5], 0.0, v[5]) for c, v in RUN.items()]
    return spark.createDataFrame(
        rows,
        "config string, recall_at_1 double, recall_at_3 double, recall_at_5 double, precision_at_5 double, mrr double, "
        "avg_retrieval_time_ms double, avg_generation_time_ms double, avg_total_time_ms double",
    )


def test_recorded_tables(run):
    s = E.executive_summary(run).first()
    assert (s.fastest, round(s.recall_delta, 4), round(s.min_mrr, 3)) == ("text_low", 0.0439, 0.677)
    order = [r.config for r in E.metrics_table(run).orderBy("position").collect()]
    assert order == ["text_high", "visual_high", "text_low", "text_medium", "visual_medium", "visual_low"]
    by = {r.embedding_type: r for r in E.by_embedding(run).collect()}
    assert round(by["visual"].mean_recall_at_5, 4) == 0.9720 and round(by["text"].mean_recall_at_5, 4) == 0.9915
    assert by["text"].is_best_recall and round(by["text"].speed_up, 2) == 1.49 and round(by["visual"].recall_gap, 4) == 0.0195
    density = {r.density: (r.n_configs, round(r.mean_recall_at_5, 4), round(r.mean_mrr, 3)) for r in E.by_density(run).collect()}
    assert density == {"high": (2, 1.0, 1.0), "medium": (2, 0.9731, 0.948), "low": (2, 0.9722, 0.820)}
    fastest = [r.config for r in E.latency_top3(run).filter("kind = 'total'").orderBy("rank").collect()]
    assert fastest == ["text_low", "visual_low", "text_medium"]
    advice = E.recommend(run).first()
    assert (advice.for_speed, advice.for_balance, round(advice.balance, 6)) == ("text_low", "text_high", 0.699986)


def test_recorded_type_shares(spark):
    rows = [(c, t, n) for c, ts in TYPES.items() for t, n in ts.items()]
    shares = E.retrieved_type_share(spark.createDataFrame(rows, "config string, retrieved_type string, n long"))
    got = [(r.retrieved_type, round(r.pct, 1)) for r in shares.orderBy("rank").collect()]
    assert got == [("surface_scratch", 37.8), ("dent", 26.5), ("paint_peeling", 16.2), ("crack", 14.8), ("misaligned_part", 2.0)]


def results(spark, lists, config="c"):
    rows = [(config, q, r + 1, 100 * q + r, r / 10, t) for q, ts in lists.items() for r, t in enumerate(ts)]
    return spark.createDataFrame(rows, "config string, query_id long, rank long, id long, distance double, retrieved_type string")


def truth(spark, expected, config="c"):
    return spark.createDataFrame([(config, q, e) for q, e in expected.items()], "config string, query_id long, expected_type string")


def test_metric_rules(spark):
    lists = {1: ["dent", "crack", "dent"], 2: ["crack", "crack", "crack", "crack", "dent"], 3: ["crack"], 4: ["dent"], 5: ["dent"] * 5}
    expected = {1: "dent", 2: "dent", 3: "dent", 4: None, 5: ""}
    log = spark.createDataFrame([("c", q, float(q), 1.0) for q in lists], "config string, query_id long, retrieval_time_ms double, generation_time_ms double")
    m = E.retrieval_metrics(E.judged(results(spark, lists), truth(spark, expected)), ks=(1, 3, 5, 10), ndcg=(5,), run_log=log).first()
    assert m.num_queries == 5  # queries without an expected type count here only
    assert (m.recall_at_1, m.recall_at_3, m.recall_at_5) == pytest.approx((1 / 3, 1 / 3, 2 / 3))
    assert m.precision_at_3 == pytest.approx((2 / 3 + 0 + 0) / 3)  # divided by k, not by the rows returned
    assert m.precision_at_5 == pytest.approx((2 / 5 + 1 / 5) / 3)
    assert m.mrr == pytest.approx((1 + 1 / 5 + 0) / 3)
    dcg1, ideal1 = 1 + 1 / 2, 1 + 1 / 1.584962500721156
    assert m.ndcg_at_5 == pytest.approx((dcg1 / ideal1 + 1 / 2.584962500721156 + 0) / 3)
    assert (m.avg_retrieval_time_ms, m.avg_total_time_ms) == (3.0, 4.0)


def test_label_spaces(spark):
    res, exp = results(spark, {1: ["deep_scratch"]}), truth(spark, {1: "surface_scratch"})
    assert E.judged(res, exp, "raw").first().is_match is False
    assert E.judged(res, exp).first().is_match is True
    with pytest.raises(ValueError):
        E.judged(res, exp, "other")


def test_query_without_results_counts_as_miss(spark):
    m = E.retrieval_metrics(E.judged(results(spark, {1: ["dent"]}), truth(spark, {1: "dent", 2: "dent"}))).first()
    assert (m.num_queries, m.recall_at_1, m.mrr) == (2, 0.5, 0.5)


def labels(spark, rows):
    return spark.createDataFrame(rows, "query_id long, label string")


def test_set_recall(spark):
    found = labels(spark, [(1, "deep_scratch"), (1, "deep_scratch"), (1, "dent"), (3, "crack")])
    true = labels(spark, [(1, "surface_scratch"), (1, "dent"), (1, "dent"), (2, "crack")])
    raw = {r.query_id: (r.n_true, r.n_hit) for r in E.set_recall(found, true).collect()}
    assert raw == {1: (2, 1), 2: (1, 0)}
    bench = {r.query_id: r.recall for r in E.set_recall(found, true, "benchmark").collect()}
    assert bench == {1: 1.0, 2: 0.0}


def test_buckets_and_success(spark):
    df = spark.createDataFrame([(v, None) for v in (0.0, 0.3, 0.31, 0.7, 0.71)] + [(None, "lost")], "recall double, error string")
    assert tuple(E.recall_buckets(df).first()) == (1, 1, 2, 1)
    assert tuple(E.run_success(df).first()) == (6, 5, 1, pytest.approx(5 / 6), pytest.approx(2.02 / 5))
    nothing = E.run_success(df.filter("error is not null")).first()
    assert (nothing.success_rate, nothing.avg_recall) == (0.0, 0.0)
    empty = E.recall_summary(df.filter("recall > 5").select("recall")).first()
    assert set(empty.asDict().values()) == {0.0}


def test_merge_right_wins(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1)], "config string, v int")
    b = spark.createDataFrame([("y", 2), ("z", 2)], "config string, v int")
    assert sorted(map(tuple, E.merge_results(a, b).collect())) == [("x", 1), ("y", 2), ("z", 2)]


def test_contexts(spark):
    rows = [(1, 1, "Dent", "top_left", 0.25, 1.0, "dent", ["Dent"]), (1, 2, "Missing part", "odd", 1.5, 0.9, "missing_accessory", ["Scratch", "Dent", "Dent"])]
    df = spark.createDataFrame(rows, "query_id long, rank long, damage_type string, spatial_zone string, distance double, confidence double, damage_type_original string, all_damage_types array<string>")
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = {r.query_id: r.context for r in E.with_missing(E.context_crops(df, include_confidence=True), asked, ["query_id"], E.NO_CROPS).collect()}
    assert got[2] == "No similar examples found."
    assert got[1] == (
        "## Similar Verified Cases:\n\n"
        "\n### Example 1:\n- **Damage Type**: Dent\n- **Vehicle Area**: Upper left\n- **Similarity**: 75.0%"
        "\n\n### Example 2:\n- **Damage Type**: Missing part\n- **Vehicle Area**: odd\n- **Similarity**: -50.0%"
        "\n- **Note**: Approximate match (original: missing_accessory)\n- **Additional damages**: Dent, Scratch"
    )
    assert "Example 2" not in E.context_crops(df, max_examples=1).first().context
    assert "Note" not in E.context_crops(df).first().context


def test_answers(spark):
    texts = ['```json\n{"damages": [{"type": "dent"}], "summary": "s"}\n```', '{"summary": "only"}', "no json", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "case_id long, generated_answer string")
    rows = E.parse_answers(df).orderBy("case_id").collect()
    assert rows[0].damages[0].type == "dent" and rows[0].raw_text is None
    assert rows[1].summary == "only" and rows[1].raw_text is None
    assert rows[2].raw_text == "no json" and rows[3].raw_text is None


def test_answer_quality(spark):
    case = lambda rows: spark.createDataFrame(rows, "case_id long, label string")
    q = E.answer_quality(case([(1, "dent"), (1, "crack"), (1, "2")]), case([(1, "2"), (1, "3")]), case([(1, "dent")])).first()
    assert (q.n_cases, q.correctness, q.faithfulness, q.invented_rate) == (1, 0.5, 0.5, 0.5)


def test_strategies(spark):
    s = lambda n, r, t: spark.createDataFrame([("d", n, r, t)], "dataset string, n_regions long, recall double, seconds double")
    out = E.compare_strategies(s(100, 0.9, 10.0), s(45, 0.855, 5.0)).first()
    assert (out.enough_reduction, out.recall_is_kept, out.fast_enough) == (True, True, True)
    out = E.compare_strategies(s(100, 0.9, 10.0), s(46, 0.85, 5.1)).first()
    assert (out.enough_reduction, out.recall_is_kept, out.fast_enough) == (False, False, False)


def test_top_n_limits_before_the_shuffle(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    plan = top_n(df, ["g"], [F.col("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_recall_of_pooled_groups(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 4)).round(2)
    owner = rng.integers(0, 25, 60)
    kind = [f"t{i % 3}" for i in range(60)]
    members = spark.createDataFrame([(int(owner[i]), i) for i in range(60)] + [(99, 60), (0, 61)], "g long, i long").repartition(4)
    vectors = spark.createDataFrame([(i, v[i].tolist()) for i in range(60)] + [(61, None)], "i long, embedding array<double>").repartition(3)
    pooled = {r.g: r.embedding for r in E.pool_members(members, vectors, ["g"], ["i"]).collect()}
    assert set(pooled) == set(owner.tolist())  # nothing for a group without vectors
    for g, m in pooled.items():
        assert np.allclose(m, v[owner == g].mean(axis=0), atol=1e-6)
    asked = rng.normal(size=(20, 4)).round(2)
    want = ["t0", "t1", None, "t2"] * 5
    queries = spark.createDataFrame([(i, asked[i].tolist(), want[i]) for i in range(20)], "query_id long, embedding array<double>, expected_type string")
    index = spark.createDataFrame([(i, v[i].tolist(), kind[i]) for i in range(60)], "id long, embedding array<double>, item_type string")
    got = {r.dataset: (r.recall, r.n_queries) for r in E.recall_by_type(queries, index, 2).collect()}
    for t in ("t0", "t1", "t2"):
        own = [i for i in range(20) if want[i] == t]
        hits = [any(kind[j] == t for j in np.argsort(((v - asked[i]) ** 2).sum(1), kind="stable")[:2]) for i in own]
        assert got[t] == (pytest.approx(np.mean(hits)), 5)
    assert set(got) == {"t0", "t1", "t2"}


def test_searched_results_and_indexes_are_tables(views):
    from defectlens.plans.catalog.evaluation import _strategy_indexes

    for df in (views.results, views.results10, *_strategy_indexes(views)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan and "FlatMapCoGroups" not in plan  # before, every use searched or swept again


def test_strategies_measure_a_named_vector_once(views):
    from defectlens.plans.catalog.evaluation import _asked, _strategy_indexes

    boxes, given, clusters, pooled = _strategy_indexes(views)
    for rows, vectors in ((boxes, given), (clusters, pooled)):
        assert vectors.count() == vectors.select("ref").distinct().count()
        held = rows.join(vectors, "ref")
        assert vectors.count() < held.count() == held.select("id").distinct().count()
        once, each = (sorted(map(tuple, E.recall_by_type(_asked(views), *a).collect())) for a in ((rows, 5, vectors), (held, 5)))
        assert once == each and sum(x[2] for x in once) == views.vectors.count()


def test_stored_tables_leave_no_shuffles(spark):
    import gc
    import time
    from pathlib import Path

    from defectlens.ranks import stored

    def shuffled_bytes():
        manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return sum(p.stat().st_size for x in manager.localDirs() for p in Path(str(x.getPath())).rglob("shuffle_*.data") if p.exists())

    df = spark.range(200_000).groupBy((F.col("id") * 7919 % 150_001).alias("k")).count()
    before, _ = shuffled_bytes(), gc.disable()
    try:
        kept = stored(df.join(df.withColumnRenamed("count", "other"), "k"))
        for _ in range(100):
            if shuffled_bytes() <= before:
                break
            time.sleep(0.1)
        assert shuffled_bytes() <= before
    finally:
        gc.enable()
    assert kept.count() == 150_001
