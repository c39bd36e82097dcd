"""Shuffling a table that no machine can hold, in two passes. DataFrame functions only.

The first pass scatters records over buckets by a seeded hash, so that a bucket holds
some megabytes, whatever the order or the keys of the input. The second loads one
bucket at a time, puts it into a random order (Spark's ``shuffle`` is a Fisher-Yates
shuffle) and writes it. One bucket after the other is a random order of the whole table,
which is cut into shards of equal length.
"""

from __future__ import annotations

import uuid
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep

#: Bytes of text in a bucket. A task loads one bucket, so this is set by the memory of a core.
BUCKET_BYTES = 32 << 20
#: Buckets whose counts are added up by one task.
RUN = 4096


def size_of(text: Column) -> Column:
    """Bytes of a text in UTF-8 and one more; null counts as empty."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def _keys(docs: DataFrame, seed: int) -> list[Column]:
    """Two hashes of a whole record, so that records that differ are told apart."""
    whole = [F.col(f"`{c}`") for c in docs.columns]
    return [F.xxhash64(F.lit(seed + i), *whole).alias(f"h{i}") for i in range(2)]


def _bucket(seed: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "h0", "h1", "copy"), F.lit(buckets)).cast("int")


def _before(counts: DataFrame) -> DataFrame:
    """``bucket`` and ``base``, the records in all earlier buckets; runs of buckets are added up first."""
    run = (F.col("bucket") / RUN).cast("int")
    rows = Window.unboundedPreceding, -1
    totals = counts.groupBy(run.alias("run")).agg(F.sum("n").alias("n"))
    # one row for each 4 096 buckets
    starts = totals.select("run", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("run").rowsBetween(*rows)), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("run").orderBy("bucket").rowsBetween(*rows)), F.lit(0))
    return counts.withColumn("run", run).withColumn("inside", inside).join(starts, "run").select("bucket", (F.col("start") + F.col("inside")).alias("base"))


def shard_of(place: Column, rows: int, shards: int) -> tuple[Column, Column]:
    """(shard, slot) of a place in the order: the first shards hold one record more where the number does not divide."""
    each, more = divmod(rows, shards)
    edge = more * (each + 1)
    late = place - edge
    shard = F.when(place < edge, F.floor(place / (each + 1))).otherwise(more + F.floor(late / max(each, 1)))
    slot = F.when(place < edge, place % (each + 1)).otherwise(late % max(each, 1))
    return shard.cast("int"), slot.cast("bigint")


def write_shards(docs: DataFrame, path: str, shards: int = 8, text: str = "text", seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write all records in random order into ``shards`` folders of Parquet files.

    A file holds ``row`` (all columns of the record), ``shard`` and ``slot`` (its place
    in the shard, from 0 without gaps), in the order of the slots. Numbers of records differ by one at
    most. The same records, seed and bucket size give the same order, also after an executor is lost:
    a record's bucket comes from a hash of its columns. Records that are equal in all columns are counted,
    their copies numbered and scattered each for itself, so a third of all rows being the same
    record makes no large bucket. Nulls are values like others, and a null text is empty; maps can't be hashed
    and are no columns here. An empty table gives empty shards.
    """
    keyed = docs.select(*_keys(docs, seed), size_of(F.col(f"`{text}`")).alias("size"))
    records = keep(keyed.groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size")))
    repeats = F.coalesce(F.sum(F.when(F.col("n") > 1, 1)), F.lit(0))
    rows, size, repeated = records.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)), repeats).first()
    buckets = max(1, ceil(size / bucket_bytes))

    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    whole = docs.select(*_keys(docs, seed), record.alias("row"))
    once = F.lit(0).cast("bigint").alias("copy")
    keys, entries = records.filter("n = 1").select("h0", "h1", once), whole.withColumn("copy", once)
    if repeated:
        often = keep(records.filter("n > 1").select("h0", "h1", "n"))
        # very many copies of one record are numbered in parts, each by a task of its own
        parts = often.select("h0", "h1", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / RUN))).alias("part")).repartition("h0", "part")
        last = F.least((F.col("part") + 1) * RUN, F.col("n")) - 1
        copies = keep(parts.select("h0", "h1", F.explode(F.sequence(F.col("part") * RUN, last)).alias("copy")))
        keys = keys.unionByName(copies)
        alone = whole.join(often, ["h0", "h1"], "left_anti").withColumn("copy", once)
        # equal records meet as one before they are moved
        one = whole.join(often, ["h0", "h1"], "left_semi").groupBy("h0", "h1").agg(F.first("row").alias("row"))
        entries = alone.unionByName(one.join(copies, ["h0", "h1"]))
    bases = _before(keys.groupBy(_bucket(seed, buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n")))
    entries = entries.select(_bucket(seed, buckets).alias("bucket"), F.struct("h0", "h1", "copy", "row").alias("entry"), F.lit(None).cast("bigint").alias("base"))
    heads = bases.select("bucket", F.lit(None).cast(entries.schema["entry"].dataType).alias("entry"), "base")

    # one task for each bucket, so that the generator of the shuffle starts anew with it
    scattered = entries.unionByName(heads).repartitionById(buckets, F.col("bucket"))
    loaded = scattered.groupBy("bucket").agg(F.collect_list("entry").alias("entries"), F.max("base").alias("base"))
    # an order of its own first: what a task receives comes in any order
    mixed = loaded.select("base", F.shuffle(F.array_sort("entries", _first), seed).alias("entries"))
    placed = mixed.select("base", F.posexplode("entries").alias("at", "entry"))
    shard, slot = shard_of(F.col("base") + F.col("at"), rows, shards)
    out = placed.select(F.col("entry.row").alias("row"), shard.alias("shard"), slot.alias("slot"))
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def _first(a: Column, b: Column) -> Column:
    """Order of two entries by their hashes."""
    less = (a["h0"] < b["h0"]) | ((a["h0"] == b["h0"]) & ((a["h1"] < b["h1"]) | ((a["h1"] == b["h1"]) & (a["copy"] < b["copy"]))))
    return F.when(less, F.lit(-1)).otherwise(F.lit(1))


def read_shards(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """``row``, ``shard`` and ``slot`` of written shards; ``docs`` gives the columns of the records."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).schema["row"].dataType.simpleString()
    return spark.read.schema(f"row {row}, slot long, shard int").parquet(path)


def shared_path(spark: SparkSession) -> str:
    return f"{spark.sparkContext.getCheckpointDir()}/shards-{uuid.uuid4().hex}"
