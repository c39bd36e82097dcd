"""Region planning against direct computation, with ordinary and hot images."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from defectlens.dims import COMPATIBLE_GROUPS
from defectlens.operators import regions as R
from defectlens.operators import shapes as S

TYPES = [t for ts in COMPATIBLE_GROUPS.values() for t in ts] + ["unknown"]
SCHEMA = "image_id long, shape_idx long, label string, damage_type string, x_min long, y_min long, x_max long, y_max long, image_w long, image_h long"


def random_boxes(seed, sizes, w=3264, h=2448, biggest=260):
    rng = random.Random(seed)
    rows = []
    for image, n in enumerate(sizes):
        for idx in range(n):
            x, y = rng.randrange(w - biggest), rng.randrange(h - biggest)
            bw, bh = rng.randrange(5, biggest), rng.randrange(5, biggest)
            rows.append((image, idx, "1", rng.choice(TYPES), x, y, x + bw, y + bh, w, h))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def expected_merges(rows):
    """Direct reading of the rule: seed of each box."""
    group = {t: g for g, ts in COMPATIBLE_GROUPS.items() for t in ts}
    out = {}
    for image in {r[0] for r in rows}:
        opened = []
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: (r[5], r[4], r[1])):
            _, idx, _, kind, x1, y1, x2, y2 = r[:8]
            centre = ((x1 + x2) // 2, (y1 + y2) // 2)
            near = []
            for order, c in enumerate(opened):
                if c["group"] != group.get(kind, kind):
                    continue
                b = c["box"]
                d = np.hypot((b[0] + b[2]) // 2 - centre[0], (b[1] + b[3]) // 2 - centre[1])
                if d < 100:
                    near.append((d, order))
            target = opened[min(near)[1]] if near else None
            if target is not None:
                b = target["box"]
                hull = [min(b[0], x1), min(b[1], y1), max(b[2], x2), max(b[3], y2)]
                if (hull[2] - hull[0]) * (hull[3] - hull[1]) > 420**2:
                    target = None
                else:
                    target["box"] = hull
            if target is None:
                target = {"group": group.get(kind, kind), "box": [x1, y1, x2, y2], "seed": idx, "n": 0}
                opened.append(target)
            out[image, idx] = (target["seed"], target["n"])
            target["n"] += 1
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cluster_boxes(spark, seed):
    rows = random_boxes(seed, [1, 40, 400, 5, 900, 60, 70])
    members, clusters = R.plan_clusters(frame(spark, rows))
    got = {(r.image_id, r.shape_idx): (r.seed_idx, r.member_pos) for r in members.collect()}
    assert got == expected_merges(rows)
    numbers = clusters.groupBy("image_id").agg(F.count("*").alias("n"), F.max("cluster_idx").alias("top"), F.countDistinct("cluster_idx").alias("d"))
    assert all(r.n == r.d == r.top + 1 for r in numbers.collect())
    first = {}
    for r in sorted(clusters.collect(), key=lambda r: (r.image_id, r.seed_y, r.seed_x, r.seed_idx)):
        assert r.cluster_idx == first.get(r.image_id, 0)
        first[r.image_id] = r.cluster_idx + 1


@pytest.mark.parametrize("seed", [4, 5, 6, 7])
def test_parts_of_a_sparse_image_merge_as_the_whole(spark, seed):
    rows = random_boxes(seed, [300, 120], w=12_000, h=9_000, biggest=200)
    got = {(r.image_id, r.shape_idx): (r.seed_idx, r.member_pos) for r in R.cluster_boxes(frame(spark, rows)).collect()}
    assert got == expected_merges(rows)


def test_merge_limits(spark):
    def seeds(a, b):
        rows = [(0, i, "1", "dent", *box, 9999, 9999) for i, box in enumerate((a, b))]
        return len({r.seed_idx for r in R.plan_clusters(frame(spark, rows))[0].collect()})

    assert seeds((0, 0, 10, 10), (100, 0, 110, 10)) == 2  # 100 px apart
    assert seeds((0, 0, 10, 10), (99, 0, 109, 10)) == 1
    assert seeds((0, 0, 420, 210), (0, 0, 210, 420)) == 2  # centres 148 px apart
    assert seeds((0, 0, 420, 400), (0, 20, 420, 420)) == 1  # exactly 176400 px
    assert seeds((0, 0, 421, 400), (0, 20, 421, 420)) == 2


def test_hot_image_is_cut_into_parts(spark):
    rows = random_boxes(3, [3000], w=6000, h=6000, biggest=30)
    sparse = [r for r in rows if r[5] % 900 < 300 and r[4] % 900 < 300]
    df = frame(spark, sparse).withColumn("_group", F.lit("g"))
    parts = R.connected_parts(df, 100)
    assert parts.count() == len(sparse)
    found = parts.groupBy("_part").agg(*[(F.min if c.endswith("min") else F.max)(c).alias(c) for c in R.CORNERS]).collect()
    assert len(found) > 30
    for a in found:
        for b in found:
            gap = [max(b[f"{c}_min"] - a[f"{c}_max"], a[f"{c}_min"] - b[f"{c}_max"], 0) for c in "xy"]
            assert a._part == b._part or np.hypot(*gap) >= 100
    plan = R.cluster_boxes(frame(spark, sparse))._jdf.queryExecution().toString()
    assert "_part" in plan.split("hashpartitioning")[1].split(")")[0] or any("_part" in p.split(")")[0] for p in plan.split("hashpartitioning")[1:])


def expected_seeds(rows):
    out = {}
    for image in {r[0] for r in rows}:
        seeds = []
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: r[1]):
            c = ((r[4] + r[6]) / 2, (r[5] + r[7]) / 2)
            hit = next((s for s, o in seeds if np.hypot(c[0] - o[0], c[1] - o[1]) < 100), None)
            if hit is None:
                seeds.append((r[1], c))
            out[image, r[1]] = r[1] if hit is None else hit
    return out


def test_cluster_seed(spark):
    rows = random_boxes(4, [3, 60, 500])
    rows += [(1, 1000 + i, "1", "dent", 50, 50, 60, 60, 3264, 2448) for i in range(50)]  # copies
    got = {(r.image_id, r.shape_idx): r.seed_idx for r in R.cluster_seed(frame(spark, rows)).collect()}
    assert got == expected_seeds(rows)


def doubled_centres(spark, rows):
    firsts = {}
    for r in rows:
        key = (r[0], r[4] + r[6], r[5] + r[7])
        firsts[key] = min(firsts.get(key, r[1]), r[1])
    return spark.createDataFrame([(*k, i) for k, i in firsts.items()], "image_id long, _sx long, _sy long, shape_idx long").repartition(5)


@pytest.mark.parametrize("block_cells", [1, 3, 8])
def test_seeds_across_the_borders_of_blocks(spark, block_cells):
    rows = random_boxes(8, [900, 40, 1], w=2600, h=1900)
    rows = [(*r[:4], r[4] - 1300, r[5] - 900, r[6] - 1300, r[7] - 900, *r[8:]) for r in rows]  # also negative coordinates
    got = {(r.image_id, r.shape_idx): r.seed_idx for r in R.cluster_seed(frame(spark, rows), block_cells=block_cells).collect()}
    want = expected_seeds(rows)
    assert got == want
    seeds, rounds = R.seed_centres(doubled_centres(spark, rows), block_cells=block_cells)
    assert {(r.image_id, r.shape_idx): r.seed_idx for r in seeds.collect()}.items() <= want.items()
    assert 1 < rounds <= 30


def test_one_block_takes_one_round_and_a_large_image_several_tasks(spark):
    small = doubled_centres(spark, random_boxes(9, [200, 200], w=900, h=900))
    assert R.seed_centres(small)[1] == 1
    # a row of centres, each in reach of the one before: every third block waits for the second
    chain = [(7, i, "1", "dent", 60 * i, 0, 60 * i + 10, 10, 0, 0) for i in range(120)]
    seeds, rounds = R.seed_centres(doubled_centres(spark, chain), block_cells=16)
    assert sorted((r.shape_idx, r.seed_idx) for r in seeds.collect()) == [(i, i - i % 2) for i in range(120)]
    assert rounds == 7  # 7 150 pixels in blocks of 1 128


@pytest.mark.parametrize("dist", [0, 1, 7])
def test_seeds_with_small_reach(spark, dist):
    rows = [(1, i, "1", "dent", i % 9, i // 9 % 5, i % 9 + 4, i // 9 % 5 + 4, 9, 9) for i in range(90)]
    got = {r.shape_idx: r.seed_idx for r in R.cluster_seed(frame(spark, rows), dist, block_cells=2).collect()}
    seeds, want = [], {}
    for i in range(90):
        x, y = i % 9, i // 9 % 5
        hit = next((s for s, a, b in seeds if (a, b) == (x, y) or (a - x) ** 2 + (b - y) ** 2 < dist * dist), None)
        if hit is None:
            seeds.append((i, x, y))
        want[i] = i if hit is None else hit
    assert got == want


def test_seeds_of_nulls_and_of_nothing(spark):
    rows = [(1, 5, "1", "dent", 10, 10, 20, 20, 0, 0), (None, 6, "1", "dent", 10, 10, 20, 20, 0, 0), (1, 7, "1", "dent", None, 10, 20, 20, 0, 0)]
    assert [(r.shape_idx, r.seed_idx) for r in R.cluster_seed(frame(spark, rows)).collect()] == [(5, 5)]
    assert R.cluster_seed(frame(spark, [])).count() == 0


def test_boxes_with_equal_keys_all_stay(spark):
    rows = [(1, 5, "1", "dent", 10, 10, 20, 20, 3264, 2448), (1, 5, "1", "dent", 900, 900, 920, 920, 3264, 2448), (1, 5, "1", "dent", 10, 10, 20, 20, 3264, 2448), (1, 6, "1", "dent", 30, 30, 40, 40, 3264, 2448)]
    got = sorted((r.shape_idx, r.x_min, r.seed_idx) for r in R.cluster_seed(frame(spark, rows)).collect())
    assert got == [(5, 10, 5), (5, 10, 5), (5, 900, 5), (6, 30, 5)]


def expected_tiles(box, w, h, size=336):
    def axis(lo, hi, limit):
        if hi - lo <= size:
            return [max(0, min((lo + hi) // 2 - size // 2, limit - size))]
        found, at = [], lo
        while at + size < hi:
            if max(0, at) + size <= limit:
                found.append(max(0, at))
            at += 268
        return sorted({*found, max(0, min(hi - size, limit - size))})

    x1, y1, x2, y2 = box
    return {(x, y) for y in axis(y1, y2, h) for x in axis(x1, x2, w) if x + size <= w and y + size <= h}


def test_tiles(spark):
    rng = random.Random(5)
    boxes = [(10, 10, 50, 60), (0, 0, 337, 10), (0, 0, 336, 336), (100, 100, 1500, 300), (3000, 2300, 3264, 2448), (0, 0, 3264, 2448)]
    boxes += [(x, y, x + rng.randrange(1, 1200), y + rng.randrange(1, 1200)) for x, y in ((rng.randrange(2000), rng.randrange(1200)) for _ in range(40))]
    rows = [(i, *b, w, h) for i, (b, w, h) in enumerate([(b, 3264, 2448) for b in boxes] + [((0, 0, 100, 100), 300, 300)])]
    df = spark.createDataFrame(rows, "image_id long, x_min long, y_min long, x_max long, y_max long, image_w long, image_h long")
    got = {}
    for r in R.tile_plan(df).collect():
        got.setdefault(r.image_id, set()).add((r.tile_x, r.tile_y))
    for i, x1, y1, x2, y2, w, h in rows:
        assert got.get(i, set()) == expected_tiles((x1, y1, x2, y2), w, h)


def test_grid_and_coverage(spark):
    polygon = [[100, 100], [900, 50], [1200, 700], [600, 500], [150, 800]]
    df = spark.createDataFrame(
        [(1, 1300, 900, polygon), (2, 1300, 900, None)], "image_id long, image_w long, image_h long, outline array<array<int>>"
    )
    cells = R.coverage_filter(R.grid_plan(df, outline="outline"), "outline", 0.0)
    for r in cells.collect():
        w, h = r.cell_x2 - r.grid_x, r.cell_y2 - r.grid_y
        assert w >= 168 and h >= 168
        if r.image_id == 2:
            assert r.vehicle_ratio == 1.0
            continue
        xs, ys = np.meshgrid(np.arange(r.grid_x, r.cell_x2) + 0.5, np.arange(r.grid_y, r.cell_y2) + 0.5)
        inside = np.zeros(xs.shape, dtype=bool)
        for (px, py), (qx, qy) in zip(polygon, polygon[1:] + polygon[:1]):
            crosses = (py > ys) != (qy > ys)
            inside ^= crosses & (xs < (qx - px) * (ys - py) / ((qy - py) or 1) + px)
        assert r.vehicle_ratio == pytest.approx(inside.mean(), abs=0.002)
    starts = {(r.grid_x, r.grid_y) for r in cells.filter("image_id = 2").collect()}
    assert starts == {(x, y) for x in range(0, 1300, 235) for y in range(0, 900, 235) if 1300 - x >= 168 and 900 - y >= 168}


CROSSING = {
    "bow-tie": [[0, 0], [400, 400], [400, 0], [0, 400]],
    "star": [[300, 0], [480, 560], [10, 210], [590, 210], [120, 560]],
    "hole": [[0, 0], [600, 0], [600, 600], [0, 600], [0, 0], [150, 150], [450, 150], [450, 450], [150, 450], [150, 150]],
    "touching": [[0, 0], [300, 300], [600, 0], [600, 600], [300, 300], [0, 600]],
    "twice": [[0, 0], [500, 0], [500, 500], [0, 500]] * 2,
    "flat": [[0, 0], [500, 0]],
}


@pytest.mark.parametrize("name", list(CROSSING))
def test_coverage_of_outlines_that_cross_themselves(spark, name):
    polygon = CROSSING[name]
    rows = [(x, y, x + 200, y + 150, polygon) for x in range(0, 600, 100) for y in range(0, 600, 75)]
    df = spark.createDataFrame(rows, "grid_x long, grid_y long, cell_x2 long, cell_y2 long, outline array<array<int>>")
    got = R.coverage_filter(df, "outline", 0.0).collect()
    assert len(got) == len(rows)
    for r in got:
        xs, ys = np.meshgrid(np.arange(r.grid_x, r.cell_x2) + 0.4999, np.arange(r.grid_y, r.cell_y2) + 0.5001)
        inside = np.zeros(xs.shape, dtype=bool)
        for (px, py), (qx, qy) in zip(polygon, polygon[1:] + polygon[:1]):
            crosses = (py > ys) != (qy > ys)
            inside ^= crosses & (xs < (qx - px) * (ys - py) / ((qy - py) or 1) + px)
        assert r.vehicle_ratio == pytest.approx(inside.mean(), abs=0.012)


def test_bow_tie_is_half_covered(spark):
    df = spark.createDataFrame([(0, 0, 100, 100, [[0, 0], [100, 100], [100, 0], [0, 100]])], "grid_x long, grid_y long, cell_x2 long, cell_y2 long, outline array<array<int>>")
    assert R.coverage_filter(df).count() == 0
    assert [r.vehicle_ratio for r in R.coverage_filter(df, min_ratio=0.5).collect()] == [0.5]


def test_grid_drops_below_ratio(spark):
    df = spark.createDataFrame([(1, 672, 336, [[0, 0], [336, 0], [336, 336], [0, 336]])], "image_id long, image_w long, image_h long, outline array<array<int>>")
    full = R.grid_plan(df).withColumn("keep", F.lit(1))
    kept = R.coverage_filter(full, "outline", 0.6).collect()
    assert [(r.grid_x, r.vehicle_ratio) for r in kept if r.grid_y == 0] == [(0, 1.0)]


def test_pair_stats_for_few_and_many_centres(spark):
    rows = random_boxes(6, [1, 2, 13, 90], w=700, h=700)
    rows += [(4, i, "1", "dent", 10, 10, 20, 20, 700, 700) for i in range(300)]
    rng = random.Random(7)
    rows += [(5, i, "1", "dent", x, y, x + 3, y + 4, 700, 700) for i, (x, y) in enumerate((rng.randrange(150), rng.randrange(120)) for _ in range(6000))]
    got = {r.image_id: r for r in S.pair_stats(frame(spark, rows)).collect()}
    cut = {r.image_id: r for r in S.pair_stats(frame(spark, rows), block=300).collect()}  # many blocks of an image
    assert all(cut[i][:3] == got[i][:3] and cut[i][3] == pytest.approx(got[i][3]) for i in got)
    for image in range(6):
        c = np.array([((r[4] + r[6]) / 2, (r[5] + r[7]) / 2) for r in rows if r[0] == image])
        n = len(c)
        assert got[image].n_boxes == n and got[image].n_pairs == n * (n - 1) // 2
        if n == 1:
            assert got[image].mean_pair_distance is None
            continue
        total = sum(np.hypot(*(c[i + 1 :] - c[i]).T).sum() for i in range(n - 1))
        assert got[image].mean_pair_distance == pytest.approx(total / (n * (n - 1) / 2), abs=1e-6)


def test_area_limits(spark):
    rows = [(0, i, "1", "dent", 0, 0, w, h, 3264, 2448) for i, (w, h) in enumerate([(7, 7), (5, 10), (600, 500), (300001, 1)])]
    kept = S.filter_area(frame(spark, rows)).collect()
    assert sorted(r.shape_idx for r in kept) == [1, 2]


def test_record_parts(spark):
    rows = [(0, i, "1", "dent", 0, 0, 10, 10, 3264, 2448) for i in range(25)]
    members, clusters = R.plan_clusters(frame(spark, rows))
    images = spark.createDataFrame([(0, "a.jpg", 3264, 2448)], "image_id long, image_name string, image_w long, image_h long")
    parts = R.region_record(R.cluster_regions(images, clusters), members, part_size=10).orderBy("part").collect()
    assert [len(p.included_defects) for p in parts] == [10, 10, 5]
    assert [d.defect_idx for p in parts for d in p.included_defects] == list(range(25))


def test_mixed_plan_grids_only_unannotated_images(spark):
    boxes = frame(spark, [(1, 0, "1", "dent", 500, 500, 600, 600, 3264, 2448)])
    images = spark.createDataFrame([(i, f"zona1_ok_zona_{i}_x.jpg", 3264, 2448) for i in (1, 2, 3)], "image_id long, image_name string, image_w long, image_h long")
    annotated = spark.createDataFrame([(1,), (3,)], "image_id long")
    plan = R.plan_regions(images, boxes, "mixed", annotated=annotated)
    got = {r.image_id: (r.generation_method, r.vehicle_zone) for r in plan.collect()}
    assert got == {1: ("clustered_defects", "1"), 2: ("grid_masked_polygon", "2")}


def test_unknown_names_fail_instead_of_going_missing(spark):
    boxes = frame(spark, [(1, 0, "1", "rust", 5, 5, 60, 60, 3264, 2448)])
    with pytest.raises(Exception, match="holds values outside"):
        R.plan_clusters(boxes)[1].select("type_counts").collect()


def test_calm_and_crowded_images_give_the_same_clusters(spark, monkeypatch):
    df = frame(spark, random_boxes(9, [1, 40, 400], w=3000, h=2000, biggest=60))
    got = []
    for crowd in (10_000, 100, 0):
        monkeypatch.setattr(R, "CROWD", crowd)
        members, rows = R.plan_clusters(df)
        got.append((sorted(map(tuple, members.collect())), sorted(map(str, rows.collect()))))
        assert sorted(map(tuple, R.cluster_boxes(df).collect())) == got[-1][0]
    assert got[0] == got[1] == got[2]
    monkeypatch.setattr(R, "CROWD", 10_000)
    calm, crowded = R._by_crowd(df)
    assert calm.count() == df.count() and crowded.count() == 0  # before, the hulls of every image were joined


def test_images_stay_whole_where_a_join_becomes_a_broadcast_join(spark):
    n = 3000  # images of four boxes on one spot: one cluster each
    boxes = spark.range(4 * n, numPartitions=6).select(
        (F.col("id") % n).alias("image_id"), F.col("id").alias("shape_idx"), F.lit("dent").alias("damage_type"),
        F.lit(100).cast("bigint").alias("x_min"), F.lit(100).cast("bigint").alias("y_min"), F.lit(140).cast("bigint").alias("x_max"), F.lit(140).cast("bigint").alias("y_max"),
    )
    ids = spark.range(0, 2 * n, 2).select(F.col("id").alias("image_id"))
    limits = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
    before = {k: spark.conf.get(k, None) for k in limits}
    try:
        for k, value in limits.items():
            spark.conf.set(k, value)
        members = R.cluster_boxes(boxes.join(ids, "image_id", "left_semi"))
        above = members._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0]
        found = members.groupBy("image_id").agg(F.count_distinct("seed_idx").alias("n"), F.count("*").alias("m")).collect()
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)
    assert len(found) == n // 2 and {(r.n, r.m) for r in found} == {(1, 4)}
    assert "REPARTITION_BY_COL" in above  # a shuffle of the join alone may be read by its map tasks, in pieces
