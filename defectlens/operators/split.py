"""Stratified splits, balanced samples and density subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import LABEL_NAMES
from ..ranks import bucketed_row_number, hash_key
from .profile import label_counts, top_n, with_share

HASH_RANGE = 1 << 63


def stratum_position(
    df: DataFrame,
    strata: list[str],
    key: str,
    seed: int = 42,
    key_expr: Column | None = None,
    key_range: int = HASH_RANGE,
    buckets: int = 64,
) -> DataFrame:
    """Shuffled position and size of each stratum (``position``, ``stratum_size``).

    The shuffle is the order of a key hash. Buckets of the hash range split a
    stratum, so one stratum with a third of all rows is ranked by many tasks.
    """
    h = key_expr if key_expr is not None else hash_key(F.col(key), seed)
    hashed = df.withColumn("_h", h)
    width = max(1, key_range // buckets)
    bucket = F.floor(F.col("_h") / F.lit(width)) if key_range < (1 << 53) else F.expr(f"_h div {width}L")
    ranked = bucketed_row_number(
        hashed, strata, [F.col("_h"), F.col(key)], bucket.cast("bigint"), "position", "stratum_size"
    )
    return ranked.drop("_h")


def stratified_split(
    df: DataFrame,
    strata: list[str],
    key: str,
    share: float = 0.8,
    floor_side: str = "train",
    seed: int = 42,
    key_expr: Column | None = None,
    key_range: int = HASH_RANGE,
) -> DataFrame:
    """Adds ``split``. The floored side gets floor(share * size) rows of each stratum."""
    other = {"train": "test", "test": "train"}[floor_side]
    ranked = stratum_position(df, strata, key, seed, key_expr, key_range)
    limit = F.floor(F.col("stratum_size") * F.lit(share))
    return ranked.withColumn("split", F.when(F.col("position") <= limit, floor_side).otherwise(other))


def balanced_sample(
    images: DataFrame,
    labels: DataFrame,
    n: int = 100,
    min_defects: int = 5,
    seed: int = 42,
    dedup: bool = True,
    key_expr: Column | None = None,
) -> DataFrame:
    """n images: n/8 per damage label, then filled from the remaining ones.

    ``images`` has ``image_id, n_defects``; ``labels`` one row per (image, label)
    present. With ``dedup=False`` an image drawn for two labels appears twice.
    """
    pool = images.filter(F.col("n_defects") >= min_defects)
    order = key_expr if key_expr is not None else hash_key(F.col("image_id"), seed)
    pool = pool.withColumn("_h", order)
    quota = n // len(LABEL_NAMES)
    wanted = labels.filter(F.col("label").isin(list(LABEL_NAMES))).select("image_id", "label").distinct()
    drawn = top_n(wanted.join(pool, "image_id"), ["label"], [F.col("_h"), F.col("image_id")], quota, "pick")
    drawn = drawn.select("image_id", "n_defects", "label", "_h")
    if dedup:
        drawn = drawn.groupBy("image_id", "n_defects", "_h").agg(F.min("label").alias("label"))
    rest = pool.join(drawn.select("image_id").distinct(), "image_id", "left_anti")
    fill = rest.orderBy("_h", "image_id").limit(n).select("image_id", "n_defects", F.lit(None).cast("string").alias("label"), "_h")
    both = drawn.withColumn("_stage", F.lit(0)).unionByName(fill.withColumn("_stage", F.lit(1)))
    # at most 2n rows are left here
    return both.orderBy("_stage", "label", "_h", "image_id").limit(n).drop("_stage", "_h")


def slice_by_position(df: DataFrame, lead: str, key: str, n: int, buckets: int = 64) -> DataFrame:
    """First n, last n and n around the middle by (``lead``, ``key``), as rows with ``position`` and ``subset``.

    ``lead`` is a count with few values, ``key`` a whole number. Both ends are a
    top-n. For the middle the rows are counted by ``lead``; only those whose
    value covers the wanted places are ranked, in ranges of the key.
    """
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    start = F.greatest(F.lit(0), F.expr("_total div 2") - n // 2)
    before = Window.orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)  # one row per value of lead
    counts = df.groupBy(F.col(lead).alias("_lead")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    counts = counts.withColumn("_total", total).withColumn("_start", start)
    # at most n values cover n places
    cover = counts.filter((F.col("_base") < F.col("_start") + n) & (F.col("_base") + F.col("_n") > F.col("_start"))).select("_lead", "_base", "_start")
    inside = df.join(F.broadcast(cover), F.col(lead).eqNullSafe(F.col("_lead")))
    ends = df.agg(F.struct(F.min(key).alias("low"), F.max(key).alias("high")).alias("ends")).scalar()
    width = F.greatest((ends["high"] - ends["low"]) / buckets, F.lit(1.0))
    bucket = F.floor((F.col(key) - ends["low"]) / width).cast("bigint")
    ranked = bucketed_row_number(inside, ["_lead"], [F.col(key)], bucket, "_rn").withColumn("position", F.col("_base") + F.col("_rn") - 1)
    middle = ranked.filter((F.col("position") >= F.col("_start")) & (F.col("position") < F.col("_start") + n)).select(*df.columns, "position")

    def end(order: list[Column], place) -> DataFrame:
        numbered = df.orderBy(*order).limit(n).withColumn("_rn", F.row_number().over(Window.orderBy(*order)))  # n rows
        return numbered.withColumn("position", place(F.col("_rn")).cast("bigint")).select(*df.columns, "position")

    low = end([F.col(lead), F.col(key)], lambda rn: rn - 1)
    high = end([F.desc(lead), F.desc(key)], lambda rn: total - rn)
    parts = {"low_density": low, "medium_density": middle, "high_density": high}
    out = [rows.withColumn("subset", F.lit(name)) for name, rows in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def density_subsets(per_image: DataFrame, n: int = 20, count: str = "n_defects") -> DataFrame:
    return slice_by_position(per_image, count, "image_id", n)


def split_sizes(per_image: DataFrame, train: float = 0.8, test: float = 0.2, count: str = "n_defects") -> DataFrame:
    total = F.count(F.lit(1))
    return per_image.agg(
        F.floor(total * train).cast("bigint").alias("train_images"),
        F.floor(total * test).cast("bigint").alias("test_images"),
        (F.sum(count) * train).alias("train_defects"),
    )


def split_balance(split: DataFrame, boxes: DataFrame) -> DataFrame:
    """Train and test counts by label with the test share.

    ``split`` has ``image_id, split``. Boxes are counted per image and label
    before they meet the split.
    """
    joined = label_counts(boxes).join(split.select("image_id", "split"), "image_id")
    on = lambda side: F.coalesce(F.sum(F.when(F.col("split") == side, F.col("n"))), F.lit(0))
    wide = joined.groupBy("label").agg(on("train").alias("n_train"), on("test").alias("n_test"))
    total = F.col("n_train") + F.col("n_test")
    return wide.withColumn("test_pct", F.col("n_test") * 100.0 / F.nullif(total, F.lit(0)))


def split_shares(split: DataFrame) -> DataFrame:
    return with_share(split.groupBy("split").agg(F.count(F.lit(1)).alias("n")))


def leakage(train: DataFrame, test: DataFrame, key: str = "image_id") -> DataFrame:
    """Test rows whose key also occurs in train."""
    return test.join(train.select(key).distinct(), key, "left_semi")


def remaining(pool: DataFrame, taken: DataFrame, key: str = "image_id") -> DataFrame:
    return pool.join(taken.select(key), key, "left_anti")
