"""Row numbers that do not funnel a large group through one task."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; fall back to a temporary folder only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix=f"checkpoint-{os.getpid()}-")
    sc.setCheckpointDir(folder)


def stored(df: DataFrame) -> DataFrame:
    """The rows from a table written to the shared folder; what lost executors computed before is not computed again.

    What was shuffled for it is deleted at once; otherwise it would stay until the driver's next collection of garbage.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def hash_key(key: Column, seed: int = 42) -> Column:
    """Seeded non-negative 63-bit order key; the replacement for a random shuffle."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 1)


def bucketed_row_number(
    df: DataFrame, by: list[str], order: list[Column], bucket: Column, name: str = "rn", total: str | None = None
) -> DataFrame:
    """``row_number() over (partition by <by> order by <order>)`` in buckets.

    ``bucket`` must not decrease along ``order``. Rows are numbered inside
    (group, bucket) and shifted by the counts of the earlier buckets, so a group
    holding a third of all rows is sorted by as many tasks as it has buckets.
    Only the counts (groups x buckets rows) meet in one window.
    """
    inner = df.withColumn("_bucket", bucket)
    keys = [*by, "_bucket"]
    counts = inner.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(group).alias("_total"),
    )
    numbered = inner.withColumn("_in", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = numbered.join(offsets, match, "inner").withColumn(name, (F.col("_offset") + F.col("_in")).cast("bigint"))
    drop = ["_bucket", "_in", "_offset", *[f"_k{i}" for i in range(len(keys))]]
    if total is None:
        drop.append("_total")
    else:
        joined = joined.withColumnRenamed("_total", total)
    return joined.drop(*drop)


def exact_percentiles(
    df: DataFrame, by: list[str], value: str, shares: dict[str, float], buckets: int = 64
) -> DataFrame:
    """Linear-interpolated percentiles of each group, as columns named by ``shares``.

    Equal values are counted first. Value ranges from approximate percentiles
    then split every group, so neither a hot group nor a hot value meets in one
    task; only the rows next to a wanted position are kept.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = df.agg(F.percentile_approx(value, F.array(*[F.lit(c) for c in cuts]), F.lit(10_000)).alias("b")).scalar()
    keyed = counted.withColumn("_cuts", bounds).withColumn(
        "_bucket", F.size(F.filter("_cuts", lambda b: b < F.col(value)))
    )
    keys = [*by, "_bucket"]
    group = Window.partitionBy(*by)
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # groups x buckets rows
    offsets = (
        keyed.groupBy(*keys)
        .agg(F.sum("_n").alias("_bn"))
        .select(*keys, F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_offset"), F.sum("_bn").over(group).alias("_total"))
    )
    inner = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.drop("_cuts").withColumn("_upto", F.sum("_n").over(inner)).join(offsets, keys)
    last = F.col("_offset") + F.col("_upto") - 1  # position of the last copy of the value, from 0
    first = last - F.col("_n") + 1
    aggs = []
    for name, share in shares.items():
        at = (F.col("_total") - 1) * F.lit(share)
        pick = lambda p: F.max(F.when((first <= p) & (p <= last), F.col(value)))
        low, high = pick(F.floor(at)), pick(F.ceil(at))
        aggs.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return placed.groupBy(*by).agg(*aggs)


#: Keys in the sample for each range that it cuts.
SAMPLE = 64


def with_range(df: DataFrame, key: Column, parts: int, name: str = "_range") -> DataFrame:
    """``df`` with the number of the range of ``key`` among about ``parts`` ranges of similar size.

    The cuts come from the keys with the least hashes, a sample that depends on the keys alone: any
    pass over the same rows, also one repeated after a loss, sees the same ranges. They are held in
    runs, of which the first cuts are searched first.
    """
    sample = df.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(SAMPLE * parts)
    ordered = sample.agg(F.sort_array(F.collect_list("k")).alias("s"))
    cuts = ordered.select(F.filter("s", lambda _, i: (i % SAMPLE == 0) & (i > 0)).alias("s"))
    run = max(1, int(parts**0.5))
    starts = F.when(F.size("s") > 0, F.sequence(F.lit(1), F.size("s"), F.lit(run))).otherwise(F.array().cast("array<int>"))
    found = cuts.select(F.struct(F.filter("s", lambda _, i: i % run == 0).alias("firsts"), F.transform(starts, lambda i: F.slice("s", i, run)).alias("runs"))).scalar()
    place = F.size(F.filter("_cuts.firsts", lambda x: x <= F.col("_key")))
    inside = F.size(F.filter("_run", lambda x: x <= F.col("_key")))
    held = df.withColumns({"_cuts": found, "_key": key}).withColumn("_place", place).withColumn("_run", F.get("_cuts.runs", F.col("_place") - 1))
    number = F.when(F.col("_place") == 0, F.lit(0)).otherwise((F.col("_place") - 1) * run + inside)
    return held.withColumn(name, number).drop("_cuts", "_key", "_place", "_run")


def dense_id(df: DataFrame, order: list[Column], name: str = "id", partitions: int | None = None) -> DataFrame:
    """Consecutive ids from 0 in a global ascending order, nulls first.

    Rows are numbered inside ranges of the key and shifted by the counts of the ranges before. Cuts
    between ranges follow from the keys, so counting and numbering agree without a copy of the table. Include a
    unique column in ``order``; equal keys lie in one range and get ids in any order.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    ranged = with_range(df, key, parts)
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range: bounded by the number of partitions
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    numbered = ranged.withColumn("_in", inside).join(F.broadcast(offsets), "_range")
    return numbered.withColumn(name, (F.col("_offset") + F.col("_in")).cast("bigint")).drop("_range", "_in", "_offset")
