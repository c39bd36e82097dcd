"""Row numbers, splits and samples."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from defectlens.operators import profile as P
from defectlens.operators import split as M
from defectlens.ranks import bucketed_row_number, dense_id, exact_percentiles, hash_key


def test_bucketed_row_number_equals_window(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.randrange(500), i) for i in range(3000)] + [(None, 5, 9001), (None, 4, 9002)]
    df = spark.createDataFrame(rows, "g string, x long, id long")
    order = [F.col("x"), F.col("id")]
    got = bucketed_row_number(df, ["g"], order, F.expr("x div 50"), "rn", "total")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("bigint")).withColumn(
        "total", F.count("*").over(Window.partitionBy("g"))
    )
    key = lambda d: sorted((r.id, r.g, r.rn, r.total) for r in d.collect())
    assert key(got) == key(want)


def test_dense_id_is_consecutive(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, i) for i in range(1000)], "x long, i long").repartition(6)
    rows = dense_id(df, [F.col("x")], partitions=5).collect()
    assert sorted((r.id, r.x) for r in rows) == [(x, x) for x in range(1000)]


@pytest.mark.parametrize("partitions", [1, 2, 7, 40])
def test_dense_id_of_any_keys(spark, partitions):
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"g{i % 11}", i * 7919 % 4001) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, i long").repartition(5)
    got = dense_id(df, [F.col("g"), F.col("i")], partitions=partitions)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert sorted((r.id, r.g, r.i) for r in got.collect()) == [(n, *r) for n, r in enumerate(want)]
    assert [r.id for r in dense_id(df.limit(1), [F.col("i")]).collect()] == [0]
    assert dense_id(df.limit(0), [F.col("i")]).count() == 0
    assert "Checkpoint" not in got._jdf.queryExecution().toString()


def test_dense_id_in_any_layout(spark):
    """What a repeated task reads may come in another order; ranges and ids stay."""
    df = spark.range(3000).selectExpr("id * 7919 % 3001 AS x")
    key = F.struct(F.col("x").alias("o0"))
    from defectlens.ranks import with_range

    ids, ranges = [], []
    for n in (1, 6, 13):
        laid = df.repartition(n)
        ids.append(sorted((r.id, r.x) for r in dense_id(laid, [F.col("x")], partitions=8).collect()))
        ranges.append(sorted((r.x, r._range) for r in with_range(laid, key, 8).collect()))
    assert ids[0] == ids[1] == ids[2] == list(enumerate(sorted(x for _, x in ids[0])))
    assert ranges[0] == ranges[1] == ranges[2]


def test_ranges_are_even(spark):
    from defectlens.ranks import with_range

    df = spark.range(20_000).selectExpr("id * 7919 % 20011 AS x")
    sizes = [r["count"] for r in with_range(df, F.struct("x"), 20, "r").groupBy("r").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2000


def test_hash_key_is_never_negative(spark):
    low = spark.range(2000).select(F.min(hash_key(F.col("id")))).first()[0]
    assert low >= 0


@pytest.mark.parametrize("side", ["train", "test"])
def test_split_counts(spark, side):
    sizes = {"a": 1, "b": 4, "c": 10, "hot": 3000}
    df = spark.createDataFrame([(s, f"{s}{i}") for s, n in sizes.items() for i in range(n)], "s string, k string")
    out = M.stratified_split(df, ["s"], "k", 0.8, side)
    got = {(r.s, r.split): r["count"] for r in out.groupBy("s", "split").count().collect()}
    other = "test" if side == "train" else "train"
    for s, n in sizes.items():
        assert got.get((s, side), 0) == int(n * 0.8) and got.get((s, other), 0) == n - int(n * 0.8)
    again = M.stratified_split(df.repartition(3), ["s"], "k", 0.8, side)
    assert sorted(map(tuple, out.select("k", "split").collect())) == sorted(map(tuple, again.select("k", "split").collect()))


def test_balanced_sample(spark):
    images = spark.createDataFrame([(i, 5 + i % 3 if i else 1) for i in range(60)], "image_id long, n_defects long")
    labels = spark.createDataFrame([(i, str(1 + j % 9)) for i in range(60) for j in (i, i + 1)], "image_id long, label string")
    out = M.balanced_sample(images, labels, n=40).collect()
    assert len(out) == 40 == len({r.image_id for r in out}) and 0 not in {r.image_id for r in out}
    repeats = M.balanced_sample(images, labels, n=40, dedup=False)
    per_label = {r.label: r["count"] for r in repeats.filter("label is not null").groupBy("label").count().collect()}
    assert per_label == {str(k): 5 for k in range(1, 9)}


def test_density_subsets_of_a_small_set(spark):
    df = spark.createDataFrame([(i, i // 2) for i in range(11)], "image_id long, n_defects long")
    got = {}
    for r in M.density_subsets(df, 4).collect():
        got.setdefault(r.subset, []).append(r.image_id)
    assert {k: sorted(v) for k, v in got.items()} == {"low_density": [0, 1, 2, 3], "high_density": [7, 8, 9, 10], "medium_density": [3, 4, 5, 6]}


def test_density_class_limits(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (3, 15), (4, 16)], "image_id long, n_defects long")
    got = {r.image_id: r.density for r in P.density_class(df).collect()}
    assert got == {1: "low", 2: "medium", 3: "medium", 4: "high"}


def test_imbalance_verdict(spark):
    rows = [("1",)] * 120 + [("2",)] * 2
    out = P.type_distribution(spark.createDataFrame(rows, "label string")).collect()
    assert {(r.imbalance_ratio, r.imbalance) for r in out} == {(60.0, "extreme")}


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([(3,)] * 5, "x long")
    assert [tuple(r) for r in P.histogram(df, "x", 50).collect()] == [(0, 3.0, 5)]


def test_missing_classes(spark):
    df = spark.createDataFrame([(x,) for x in "1235678"], "label string")
    assert [r[0] for r in P.missing_classes(df).collect()] == ["Fractured part"]


def test_vector_audit(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, None), (5, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    assert tuple(P.vector_audit(df).first()) == (5, 1, 2, 1, 1)


def test_mean_pair_cosine_equals_all_pairs(spark):
    import numpy as np

    x = np.random.default_rng(2).standard_normal((30, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.mean([u[i] @ u[j] for i in range(30) for j in range(i)])
    assert P.mean_pair_cosine(df, []).first().mean_cosine == pytest.approx(want)


def test_exact_percentiles(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    values = {"hot": np.r_[rng.normal(size=700), np.full(900, 1.25)], "one": np.array([4.0]), "two": np.array([1.0, 2.0])}
    rows = [(g, float(x)) for g, xs in values.items() for x in xs]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = {"a": 0.5, "b": 0.95, "c": 0.013}
    for r in exact_percentiles(df, ["g"], "x", shares, buckets=8).collect():
        for name, share in shares.items():
            assert r[name] == pytest.approx(np.percentile(values[r.g], share * 100))
