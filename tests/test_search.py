"""Search against direct computation, all execution ways, copies and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from defectlens.operators import encode as C
from defectlens.operators import search as Q

RNG = np.random.default_rng(11)


def vectors(spark, x, key, ids=None, **extra):
    ids = list(range(len(x))) if ids is None else ids
    rows = [(i, v.tolist(), *[c[n] for c in extra.values()]) for n, (i, v) in enumerate(zip(ids, x))]
    kind = "string" if isinstance(ids[0], str) else "long"
    fields = "".join(f", {n} {'boolean' if isinstance(c[0], bool) else 'string'}" for n, c in extra.items())
    return spark.createDataFrame(rows, f"{key} {kind}, embedding array<float>{fields}").repartition(4)


def brute(q, c, k, qids, cids, exclude_self=False):
    q, c = q.astype(np.float32).astype(float), c.astype(np.float32).astype(float)
    out = {}
    for i, v in zip(qids, q):
        d = ((c - v) ** 2).sum(1)
        order = sorted((x, j) for x, j in zip(d, cids) if not (exclude_self and i == j))
        out[i] = [j for _, j in order[:k]]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


WAYS = {"scan_corpus": 64 << 20, "scan_queries": 9000, "block_join": 2000}


@pytest.mark.parametrize("way", WAYS)
def test_exact_ways(spark, way, monkeypatch):
    q, c = RNG.standard_normal((60, 8)), RNG.standard_normal((120, 8))
    c[30:70] = c[0]  # a third of the corpus are copies of one row
    q[5] = c[0]
    used = []
    for name in ("_scan_corpus", "_scan_queries", "_block_join"):
        real = getattr(Q, name)
        monkeypatch.setattr(Q, name, lambda *a, _n=name, _r=real: (used.append(_n), _r(*a))[1])
    limit = WAYS[way]
    if way == "scan_queries":
        q = np.concatenate([q, RNG.standard_normal((100, 8))])
    hits = Q.knn(vectors(spark, q, "query_id"), vectors(spark, c, "id"), 7, broadcast_bytes=limit)
    assert answers(hits) == brute(q, c, 7, range(len(q)), range(len(c)))
    assert used[0] == f"_{way}"


def test_string_ids_and_self(spark):
    x = RNG.standard_normal((40, 5))
    ids = [f"v{i:02d}" for i in range(40)]
    hits = Q.knn(vectors(spark, x, "query_id", ids), vectors(spark, x, "id", ids), 3, exclude_self=True)
    assert answers(hits) == brute(x, x, 3, ids, ids, True)


@pytest.mark.parametrize("way", ["scan_corpus", "block_join"])
def test_separate_corpora(spark, way):
    q, c = RNG.standard_normal((30, 6)), RNG.standard_normal((90, 6))
    names = ["a" if i % 3 else "b" for i in range(90)]
    hits = Q.knn(vectors(spark, q, "query_id"), vectors(spark, c, "id", config=names), 4, by="config", broadcast_bytes=WAYS[way] // 4 if way != "scan_corpus" else WAYS[way])
    for name in "ab":
        rows = [i for i in range(90) if names[i] == name]
        assert answers(hits.filter(F.col("config") == name)) == brute(q, c[rows], 4, range(30), rows)


def test_fewer_rows_than_k_and_missing_vectors(spark):
    x = RNG.standard_normal((3, 4))
    corpus = vectors(spark, x, "id").unionByName(spark.createDataFrame([(9, None)], "id long, embedding array<float>"))
    hits = Q.knn(vectors(spark, x, "query_id"), corpus, 5)
    assert hits.count() == 9 and hits.filter("id = 9").count() == 0
    assert Q.knn(vectors(spark, x, "query_id").limit(0), corpus, 5).count() == 0


def test_filters_before_and_after(spark):
    x = RNG.standard_normal((80, 4))
    labels = ["Dent" if i % 8 == 0 else "Scratch" for i in range(80)]
    corpus, asked = vectors(spark, x, "id", damage_type=labels), vectors(spark, x, "query_id")
    dents = [i for i in range(80) if labels[i] == "Dent"]
    before = Q.knn(asked, corpus, 5, filters={"damage_type": "Dent"})
    assert answers(before) == brute(x, x[dents], 5, range(80), dents)
    after = answers(Q.knn(asked, corpus, 5, filters={"damage_type": "Dent"}, overfetch=5))
    wide = brute(x, x, 25, range(80), range(80))
    assert after == {i: w for i in wide if (w := [j for j in wide[i] if j in dents][:5])}


def test_ivf_all_cells_is_exact_and_hot_cell_is_split(spark):
    x = RNG.standard_normal((300, 6))
    x[:150] = x[0] + RNG.standard_normal((150, 6)) * 1e-3  # half of the rows in one cell
    hits = Q.ann_knn(vectors(spark, x, "query_id"), vectors(spark, x, "id"), 4, n_cells=6, nprobe=6, block_bytes=6 * 8 * 40)
    assert answers(hits) == brute(x, x, 4, range(300), range(300))


@pytest.mark.parametrize("method", ["ivf", "lsh"])
def test_approximate_recall(spark, method):
    centres = RNG.standard_normal((12, 16)) * 3
    x = centres[RNG.integers(0, 12, 600)] + RNG.standard_normal((600, 16)) * 0.3
    got = answers(Q.ann_knn(vectors(spark, x, "query_id"), vectors(spark, x, "id"), 5, method, n_cells=12, nprobe=4))
    exact = brute(x, x, 5, range(600), range(600))
    recall = np.mean([len(set(got[i]) & set(exact[i])) / 5 for i in exact])
    assert recall > 0.9


def test_profile():
    assert [Q.choose_profile(n) for n in (9_999, 10_000, 99_999, 100_000)] == ["poc", "production", "production", "large_scale"]


def test_wrong_dimension_fails(spark):
    with pytest.raises(Exception, match="embedding dimension is not 5"):
        Q.assert_dim(vectors(spark, RNG.standard_normal((2, 4)), "id"), 5).collect()


def test_self_check_and_leakage(spark):
    x = RNG.standard_normal((50, 4))
    index, centers = Q.build_ivf(vectors(spark, x, "id"), n_cells=4)
    assert tuple(Q.index_self_check(vectors(spark, x, "id"), index, centers, 10).select("n_checked", "n_failed").first()) == (10, 0)
    part = index.filter("id <> 7").withColumn("cell", F.when(F.col("id") == 9, F.col("cell") + 1).otherwise(F.col("cell")))
    assert Q.index_self_check(vectors(spark, x, "id"), part, centers, None).first().n_failed == 2
    train, test = vectors(spark, x[:40], "id"), vectors(spark, np.concatenate([x[38:], x[:1]]), "id", list(range(100, 113)))
    assert sorted(r.query_id for r in Q.zero_distance_matches(train, test).collect()) == [100, 101, 112]


BAD = [[float("nan"), 1.0, 1.0, 1.0], [float("inf"), 0.0, 0.0, 0.0], [1.0, None, 0.0, 0.0], None]


def with_bad(spark, x, key):
    rows = [(1000 + i, v) for i, v in enumerate(BAD)]
    return vectors(spark, x, key).unionByName(spark.createDataFrame(rows, f"{key} long, embedding array<float>"))


@pytest.mark.parametrize("way", [*WAYS, "ivf", "lsh"])
def test_vectors_that_are_not_finite_take_no_part(spark, way):
    q, c = RNG.standard_normal((130, 4)), RNG.standard_normal((150, 4))
    asked, corpus = with_bad(spark, q, "query_id"), with_bad(spark, c, "id")
    if way == "lsh":
        got = Q.ann_knn(asked, corpus, 5, "lsh", tables=1, bits=1, planes=np.zeros((4, 1)))  # one bucket
    elif way == "ivf":
        got = Q.ann_knn(asked, corpus, 5, n_cells=4, nprobe=4)
    else:
        got = Q.knn(asked, corpus, 5, broadcast_bytes={"scan_corpus": 64 << 20, "scan_queries": 8000, "block_join": 1000}[way])
    assert answers(got) == brute(q, c, 5, range(130), range(150))


@pytest.mark.parametrize("method", ["exact", "ivf", "lsh"])
def test_other_dimensions_fail(spark, method):
    x = RNG.standard_normal((20, 4))
    mixed = vectors(spark, x, "id").unionByName(spark.createDataFrame([(50, [1.0] * 6), (51, [1.0] * 2)], "id long, embedding array<float>"))
    with pytest.raises(ValueError, match="different dimensions"):
        Q.search(vectors(spark, x, "query_id"), mixed, 3, method)
    with pytest.raises(ValueError, match="different dimensions"):
        Q.search(vectors(spark, x[:, :3], "query_id"), vectors(spark, x, "id"), 3, method)


def test_search_is_exact_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(Q, "SEARCH_PROFILES", [("poc", 10), ("production", 100)])
    x = RNG.standard_normal((150, 6))
    assert answers(Q.search(vectors(spark, x, "query_id"), vectors(spark, x, "id"), 4)) == brute(x, x, 4, range(150), range(150))


def test_a_third_of_the_corpus_in_one_group(spark):
    q, c = RNG.standard_normal((40, 4)), RNG.standard_normal((300, 4))
    names = ["hot" if i % 3 == 0 else f"g{i}" for i in range(300)]
    hits = Q.knn(vectors(spark, q, "query_id"), vectors(spark, c, "id", config=names), 3, by="config", broadcast_bytes=600)
    rows = [i for i in range(300) if names[i] == "hot"]
    assert answers(hits.filter("config = 'hot'")) == brute(q, c[rows], 3, range(40), rows)


def test_stored_index_reads_only_probed_cells(spark, tmp_path):
    from defectlens.sources import tables as T

    centres = RNG.standard_normal((8, 5)) * 5
    x = centres[RNG.integers(0, 8, 400)] + RNG.standard_normal((400, 5)) * 0.2
    cells, centers = Q.build_ivf(vectors(spark, x, "id"), n_cells=8)
    T.save_index(cells.withColumn("config", F.lit("all")), centers.select("cell"), str(tmp_path / "i"), "cell", rows_per_file=50)
    T.save_centers(centers, str(tmp_path / "i"))
    index, stored = T.read_index(spark, str(tmp_path / "i"), "all"), T.read_centers(spark, str(tmp_path / "i"))
    assert answers(Q.search_index(vectors(spark, x, "query_id"), index, stored, 5, nprobe=8)) == brute(x, x, 5, range(400), range(400))
    few = Q.search_index(vectors(spark, x[:1], "query_id"), index, stored, 5, nprobe=1)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1].split("]")[0]


def test_two_stage_stays_inside_images(spark):
    x = RNG.standard_normal((20, 4))
    images = vectors(spark, x, "id")
    parts = np.repeat(x, 3, axis=0) + RNG.standard_normal((60, 4)) * 0.1
    regions = vectors(spark, parts, "id").withColumn("image_id", F.floor(F.col("id") / 3).cast("long"))
    hits = Q.search_two_stage(vectors(spark, x, "query_id"), images, regions, n_images=2, k=4)
    near = brute(x, x, 2, range(20), range(20))
    assert all(r.id // 3 in near[r.query_id] for r in hits.collect()) and hits.count() == 80


def test_failing_rows_are_flagged(spark):
    def build():
        hashing = C.hashing_encoder(8)

        def run(texts):
            if any(t == "bad" for t in texts):
                raise ValueError("cannot encode")
            return hashing(texts)

        return run

    df = spark.createDataFrame([(i, "bad" if i == 3 else f"word {i}") for i in range(20)] + [(99, None)], "i long, t string").repartition(2)
    rows = {r.i: r for r in C.encode(df, "t", build, 8, batch_size=5).collect()}
    assert [i for i, r in rows.items() if not r.vector_ok] in ([3, 99], [99, 3])
    assert sum(map(abs, rows[3].embedding)) == 0 and rows[4].vector_ok


def test_pool_patches(spark):
    whole = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "image_id long, embedding array<float>")
    patches = spark.createDataFrame([(1, [0.0, 1.0]), (1, [0.0, 3.0])], "image_id long, embedding array<float>")
    got = {r.image_id: r.embedding for r in C.pool_patches(patches, whole).collect()}
    n = (0.36 + 0.64) ** 0.5
    assert got[1] == pytest.approx([0.6 / n, 0.8 / n]) and got[2] == [0.0, 1.0]


def test_rerank_weights(spark):
    hits = spark.createDataFrame([(1, 7, 0.9, False), (1, 8, 0.8, True)], "query_id long, id long, s double, m boolean")
    got = Q.rerank(hits, F.col("s"), F.col("m"), F.lit(0.0)).orderBy("new_rank").collect()
    assert [r.id for r in got] == [8, 7] and got[0].score == pytest.approx(0.73)


def test_filters_reach_the_scan(spark, tmp_path):
    x = RNG.standard_normal((20, 4))
    vectors(spark, x, "id", vehicle_zone=[str(i % 4) for i in range(20)], has_damage=[i % 2 == 0 for i in range(20)]).write.parquet(str(tmp_path / "v"))
    corpus = spark.read.parquet(str(tmp_path / "v"))
    cond = Q.filter_condition({"vehicle_zone": ["1", "2"], "has_damage": True})
    plan = corpus.filter(cond).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "In(vehicle_zone, [1,2])" in plan and "EqualTo(has_damage,true)" in plan
    assert "embedding" not in plan.split("ReadSchema")[1]


def test_missing_values_in_filters(spark):
    df = spark.createDataFrame([(1, None, None), (2, "unknown", 3), (3, "4", 0)], "id long, vehicle_zone string, total_defects long")
    ids = lambda f: sorted(r.id for r in df.filter(Q.filter_condition(f, "image")).collect())
    assert ids({"vehicle_zone": "unknown"}) == [1, 2] and ids({"vehicle_zone": ["4"]}) == [3]
    assert ids({"min_defects": 0}) == [1, 2, 3] and ids({"min_defects": 1}) == [2] and ids({"max_defects": 2}) == [1, 3]
    assert tuple(Q.assert_filters(df, {"vehicle_zone": "4"}, "image").first()) == (3, 2, False)


def test_image_form_uses_raw_types_only_without_normalised_ones(spark):
    df = spark.createDataFrame([(1, ["Dent"], ["dent"]), (2, [], ["Dent"]), (3, None, None)], "id long, damage_types array<string>, defect_types array<string>")
    assert [r.id for r in df.filter(Q.filter_condition({"damage_type": "Dent"}, "image")).collect()] == [1, 2]


def clustered(seed, n, groups=40, dim=8, spread=0.05):
    rnd = np.random.default_rng(seed)
    return rnd.normal(0, 10, (groups, dim))[rnd.integers(0, groups, n)] + rnd.normal(0, spread, (n, dim))


@pytest.mark.parametrize("n_cells", [2, 9, 40])
def test_bounded_search_is_exact_and_reads_few_cells(spark, tmp_path, n_cells, monkeypatch):
    from defectlens.sources import tables as T

    x = clustered(1, 1500)
    corpus = vectors(spark, x, "id").withColumn("vehicle_zone", (F.col("id") % 7).cast("string"))
    cells, centers = Q.build_bounded_index(corpus, n_cells=n_cells)
    folder = str(tmp_path / "b")
    T.save_index(cells.withColumn("config", F.lit("all")), centers.select("cell"), folder, "cell", rows_per_file=100)
    T.save_centers(centers, folder)
    index, stored = T.read_index(spark, folder, "all"), T.read_centers(spark, folder)
    read = []
    whole = Q._block_join
    monkeypatch.setattr(Q, "_block_join", lambda q, c, *more: read.append(q.select("query_id", "_cell")) or whole(q, c, *more))
    asked = vectors(spark, x[:60], "query_id")
    assert answers(Q.bounded_search(asked, index, stored, 4)) == brute(x[:60], x, 4, range(60), range(1500))
    probed = read[0].unionByName(read[1])
    assert probed.count() == probed.distinct().count() <= 60 * n_cells
    if n_cells == 40:
        assert probed.count() < 0.25 * 60 * n_cells
    for zone in ("3", "none"):
        mine = [i for i in range(1500) if str(i % 7) == zone]
        got = Q.bounded_search(asked, index, stored, 4, filters={"vehicle_zone": zone})
        assert answers(got) == (brute(x[:60], x[mine], 4, range(60), mine) if mine else {})


def test_a_filter_that_few_rows_pass(spark, tmp_path):
    x = clustered(2, 400, groups=12)
    corpus = vectors(spark, x, "id").withColumn("vehicle_zone", F.when(F.col("id").isin(7, 300, 301), "rare").otherwise("common"))
    index, centers = Q.build_bounded_index(corpus, n_cells=12)
    got = answers(Q.bounded_search(vectors(spark, x[:30], "query_id"), index, centers, 5, filters={"vehicle_zone": "rare"}))
    assert got == brute(x[:30], x[[7, 300, 301]], 5, range(30), [7, 300, 301])
    assert len(next(iter(got.values()))) == 3


def test_top_k_sorts_only_the_slice_it_searched(monkeypatch):
    x = RNG.standard_normal((3000, 8))
    ids = np.arange(3000)
    sizes = []
    real = np.lexsort
    monkeypatch.setattr(Q.np, "lexsort", lambda keys: (sizes.append(len(keys[0])), real(keys))[1])
    top = Q._TopK(ids, x, 5, True)
    for s in range(0, 3000, 500):
        top.add(ids[s : s + 500], x[s : s + 500])
    # before, every slice sorted the results of all queries again, 15 000 rows each time
    assert max(sizes) < 15_000
    gap = ((x[:50, None, :] - x[None]) ** 2).sum(2)
    gap[np.arange(50), np.arange(50)] = np.inf
    assert (top.id[:50] == np.argsort(gap, axis=1, kind="stable")[:, :5]).all()


@pytest.mark.parametrize("scale,shift", [(1.0, 0.0), (1e-3, 50.0), (1e17, 0.0), (1e-25, 0.0)])
def test_top_k_is_exact_at_any_scale(scale, shift):
    x = (RNG.standard_normal((1500, 6)) + shift) * scale
    x[200:260] = x[0]
    ids = RNG.permutation(1500)
    top = Q._TopK(ids[:300], x[:300], 7, True)
    top.add(ids[:1000], x[:1000])
    top.add(ids[1000:], x[1000:])
    for n in range(300):
        gap = ((x - x[n]) ** 2).sum(1)
        order = [ids[i] for i in np.lexsort((ids, gap)) if ids[i] != ids[n]][:7]
        assert top.id[n].tolist() == order


def test_blocks_do_not_shrink_with_the_limit_of_broadcasts(spark, monkeypatch):
    given, real = [], Q._block_join
    monkeypatch.setattr(Q, "_block_join", lambda *a: (given.append(a[5]), real(*a))[1])
    x = RNG.standard_normal((200, 6))
    hits = Q.knn(vectors(spark, x, "query_id"), vectors(spark, x, "id"), 3, broadcast_bytes=500)
    assert given == [Q.BLOCK_BYTES]  # before, 200 rows a side made hundreds of blocks of ten rows
    assert answers(hits) == brute(x, x, 3, range(200), range(200))


@pytest.mark.parametrize("group", [None, "g"])
def test_many_blocks_and_shares(spark, monkeypatch, group):
    monkeypatch.setattr(Q, "TASK_PAIRS", 2000)
    x = RNG.standard_normal((300, 6))
    q, c = (vectors(spark, x, key).withColumn("g", F.lit("a")).withColumnRenamed("embedding", "_v") for key in ("query_id", "id"))
    found = Q._block_join(q, c, group, 4, False, 6 * 8 * 70, 6, {"q": 300, "c": 300})
    assert answers(Q.top_k(found, ["query_id"], 4)) == brute(x, x, 4, range(300), range(300))
    assert answers(Q.knn(vectors(spark, x, "query_id"), vectors(spark, x, "id"), 4)) == brute(x, x, 4, range(300), range(300))


def test_rows_that_name_a_vector_are_found_like_rows_that_hold_it(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 4)).round(1)
    x[3], x[7] = x[2], x[2]  # three numbers of one vector
    given = [(str(i), [float(e) for e in v]) for i, v in enumerate(x)] + [("nan", [float("nan")] * 4), ("none", None), ("idle", [0.0] * 4), ("4", [9.0] * 4)]
    refs = [str(i) for i in rng.integers(0, 12, 60)] + ["5"] * 40 + ["nan", "none", "unknown", None]  # one number with a third of the rows
    rows = [(f"{i % 7}:{i}", ref, f"t{i % 3}") for i, ref in enumerate(refs)] + [("2:2", refs[2], "t2")]  # and a row that comes twice
    named = spark.createDataFrame(rows, "id string, ref string, item_type string").repartition(3)
    held = spark.createDataFrame(given, "ref string, embedding array<double>").repartition(2)
    asked = vectors(spark, np.vstack([x, rng.normal(size=(20, 4))]), "query_id")
    for k in (1, 5, 30):
        got = Q.knn_referred(asked, named, held, k)
        assert {r.id: r.item_type for r in got.collect()}.items() <= {r[0]: r[2] for r in rows}.items()
        want = Q.knn(asked, named.join(held, "ref"), k)
        as_rows = lambda df: sorted((r.query_id, r["rank"], r.id, r.distance) for r in df.select("query_id", "rank", "id", "distance").collect())
        assert as_rows(got) == as_rows(want)
