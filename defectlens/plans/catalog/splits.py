"""Splits, samples and subsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import labels as L
from ...operators import profile as P
from ...operators import split as M
from ..registry import big, query, r
from ..sql import order_key
from ..views import order_key as key_column

KEY_RANGE = 1 << 32

_STRATA = f"""SELECT image_id, vehicle_zone, density, row_number() OVER (PARTITION BY density, vehicle_zone ORDER BY {order_key('image_id')}, image_id) AS position,
                count(*) OVER (PARTITION BY density, vehicle_zone) AS stratum_size
         FROM (SELECT p.*, i.vehicle_zone, CASE WHEN n_defects <= a THEN 'low' WHEN n_defects <= b THEN 'medium' ELSE 'high' END AS density
               FROM fx_per_image p JOIN fx_images i USING (image_id),
                    (SELECT quantile_cont(n_defects, 0.33) AS a, quantile_cont(n_defects, 0.66) AS b FROM fx_per_image))"""
_SPLIT = f"SELECT *, CASE WHEN position <= floor(stratum_size * 0.8::double) THEN 'train' ELSE 'test' END AS split FROM ({_STRATA})"


def _strata(v):
    zones = v.images.select("image_id", L.vehicle_zone(F.col("image_name")).alias("vehicle_zone"))
    return P.density_class(v.per_image, "terciles").join(zones, "image_id")


def _split(v):
    return M.stratified_split(
        _strata(v), ["density", "vehicle_zone"], "image_id", 0.8, "train", key_expr=key_column("image_id"), key_range=KEY_RANGE
    )


@query("w2_stratum_position", f"SELECT image_id, position, stratum_size FROM ({_STRATA})")
def _(v):
    ranked = M.stratum_position(
        _strata(v), ["density", "vehicle_zone"], "image_id", key_expr=key_column("image_id"), key_range=KEY_RANGE
    )
    return ranked.select("image_id", "position", big("stratum_size"))


@query("m1_stratified_split", f"SELECT image_id, density, vehicle_zone, split FROM ({_SPLIT})")
def _(v):
    return _split(v).select("image_id", "density", "vehicle_zone", "split")


@query(
    "m2_split_floor_test",
    f"""SELECT image_id, density, CASE WHEN position <= floor(size * 0.7::double) THEN 'test' ELSE 'train' END AS split FROM (
          SELECT image_id, density, row_number() OVER (PARTITION BY density ORDER BY {order_key('image_id')}, image_id) AS position, count(*) OVER (PARTITION BY density) AS size FROM (
            SELECT image_id, CASE WHEN n_defects <= a THEN 'very_low' WHEN n_defects <= b THEN 'low' WHEN n_defects <= c THEN 'medium' ELSE 'high' END AS density
            FROM fx_per_image, (SELECT quantile_cont(n_defects, 0.25) AS a, quantile_cont(n_defects, 0.5) AS b, quantile_cont(n_defects, 0.75) AS c FROM fx_per_image)))""",
)
def _(v):
    classed = P.density_class(v.per_image, "quartiles")
    out = M.stratified_split(classed, ["density"], "image_id", 0.7, "test", key_expr=key_column("image_id"), key_range=KEY_RANGE)
    return out.select("image_id", "density", "split")


_SAMPLE = f"""WITH pool AS (SELECT image_id, n_defects, {order_key('image_id')} AS h FROM fx_per_polygon_image WHERE n_defects >= 5),
      drawn AS (SELECT label, image_id, h, n_defects FROM (SELECT l.label, p.*, row_number() OVER (PARTITION BY l.label ORDER BY h, p.image_id) AS rn
        FROM (SELECT DISTINCT image_id, label FROM fx_polygons WHERE label <> '9') l JOIN pool p USING (image_id)) WHERE rn <= 12),
      uniq AS (SELECT image_id, n_defects, h, min(label) AS label FROM drawn GROUP BY ALL)"""


def _sample(v, dedup: bool):
    labels = v.polygons.select("image_id", "label")
    return M.balanced_sample(P.defects_per_image(v.polygons), labels, 100, 5, dedup=dedup, key_expr=key_column("image_id"))


@query(
    "m3_balanced_sample",
    f"""{_SAMPLE} SELECT image_id, n_defects, label FROM (SELECT *, 0 AS stage FROM uniq UNION ALL
          SELECT image_id, n_defects, h, NULL AS label, 1 AS stage FROM pool WHERE image_id NOT IN (SELECT image_id FROM uniq))
        ORDER BY stage, label NULLS FIRST, h, image_id LIMIT 100""",
)
def _(v):
    return _sample(v, True)


@query(
    "m3_balanced_sample_repeats",
    f"""{_SAMPLE} SELECT image_id, n_defects, label FROM (SELECT image_id, n_defects, h, label, 0 AS stage FROM drawn UNION ALL
          SELECT image_id, n_defects, h, NULL AS label, 1 AS stage FROM pool WHERE image_id NOT IN (SELECT image_id FROM drawn))
        ORDER BY stage, label NULLS FIRST, h, image_id LIMIT 100""",
)
def _(v):
    return _sample(v, False)


_SLICES = """SELECT image_id, n_defects, row_number() OVER (ORDER BY n_defects, image_id) - 1 AS position, count(*) OVER () AS total FROM fx_per_image"""


def _subset_sql(n: int) -> str:
    return f"""SELECT image_id, n_defects, position, 'low_density' AS subset FROM ({_SLICES}) WHERE position < {n}
        UNION ALL SELECT image_id, n_defects, position, 'high_density' FROM ({_SLICES}) WHERE position >= total - {n}
        UNION ALL SELECT image_id, n_defects, position, 'medium_density' FROM ({_SLICES})
          WHERE position >= greatest(0, total // 2 - {n // 2}) AND position < greatest(0, total // 2 - {n // 2}) + {n}"""


@query("m4_density_subsets", f"SELECT image_id, n_defects, subset FROM ({_subset_sql(20)})")
def _(v):
    return M.density_subsets(v.per_image, 20).select("image_id", "n_defects", "subset")


@query("w5_slice_by_position", _subset_sql(50))
def _(v):
    out = M.slice_by_position(v.per_image, "n_defects", "image_id", 50)
    return out.select("image_id", "n_defects", "position", "subset")


@query(
    "m5_split_sizes",
    """SELECT floor(count(*) * 0.8::double)::bigint AS train_images, floor(count(*) * 0.2::double)::bigint AS test_images,
              round(sum(n_defects) * 0.8::double, 4) AS train_defects FROM fx_per_image""",
)
def _(v):
    return M.split_sizes(v.per_image).select("train_images", "test_images", r("train_defects", 4))


@query("m6_seeded_pick", f"SELECT image_id, n_defects FROM fx_per_image ORDER BY {order_key('image_id', 7)}, image_id LIMIT 25")
def _(v):
    return P.seeded_pick(v.per_image, 25, "image_id", order=key_column("image_id", 7))


_BALANCE = f"""SELECT b.label, count(*) FILTER (s.split = 'train') AS n_train, count(*) FILTER (s.split = 'test') AS n_test
               FROM fx_boxes b JOIN ({_SPLIT}) s USING (image_id) GROUP BY b.label"""


def _balance(v):
    return M.split_balance(_split(v), v.boxes).select("label", "n_train", "n_test", r("test_pct", 4))


@query("a18_split_balance", f"SELECT label, n_train, n_test, round(n_test * 100.0 / (n_train + n_test), 4) AS test_pct FROM ({_BALANCE})")
def _(v):
    return _balance(v)


@query("j8_full_outer_counts", f"SELECT label, n_train, n_test FROM ({_BALANCE})")
def _(v):
    split = _split(v).select("image_id", "split")
    counts = P.label_counts(v.boxes)
    side = lambda s: (
        counts.join(split.filter(F.col("split") == s), "image_id").groupBy("label").agg(F.sum("n").alias(f"n_{s}"))
    )
    both = side("train").join(side("test"), "label", "full")
    return both.select("label", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_train", "n_test")])


@query(
    "a19_subset_stats",
    """SELECT label, count(*) AS n, min(area) AS min_value, max(area) AS max_value, round(avg(area), 4) AS mean_value, round(median(area), 4) AS median_value
       FROM fx_placed GROUP BY label""",
)
def _(v):
    from ...operators.shapes import with_measures

    return P.subset_stats(with_measures(v.polygons), ["label"], "area").select(
        "label", "n", "min_value", "max_value", r("mean_value", 4), r("median_value", 4)
    )
