"""Reading and writing manifests, vectors, indexes, results and run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..ranks import dense_id
from ..schemas import MANIFEST, METRICS


def write_manifest(df: DataFrame, path: str, order: list[Column]) -> None:
    """Manifest rows with consecutive ids in the given order."""
    dense_id(df, order, "id").write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)


def write_vectors(vectors: DataFrame, metadata: DataFrame, path: str, key: str = "id") -> None:
    """Vectors and metadata in one table by key; fails when a key is on one side only."""
    odd = (
        vectors.select(key).withColumn("_v", F.lit(1))
        .join(metadata.select(key).withColumn("_m", F.lit(1)), key, "full")
        .filter(F.col("_v").isNull() | F.col("_m").isNull())
        .agg(F.count("_v").alias("v"), F.count("_m").alias("m"))
        .first()
    )
    if odd["v"] or odd["m"]:
        raise ValueError(f"{odd['v']} vectors without metadata, {odd['m']} metadata rows without vector")
    joined = vectors.withColumn("vector_ok", vector_ok()).join(metadata, key)
    joined.write.mode("overwrite").parquet(path)


def vector_ok(column: str = "embedding") -> Column:
    v = F.col(column)
    return F.coalesce(~V.has_bad_values(v) & (V.l2_norm(v) > 0), F.lit(False))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_index(df: DataFrame, config: DataFrame, path: str, cell: str | None = None, rows_per_file: int = 1_000_000) -> None:
    """Index table partitioned by configuration (and cell) with its configuration rows beside it.

    A partition is written by as many tasks as it has files of ``rows_per_file``, so
    a configuration of any size is not one task.
    """
    parts = ["config", cell] if cell else ["config"]
    sizes = df.groupBy(*parts).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).cast("int").alias("_files"))
    salt = F.pmod(F.xxhash64("id"), F.lit(64)).cast("int")
    spread = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    filed = df.withColumn("_salt", salt).join(spread, [*parts, "_salt"])
    filed = filed.withColumn("_file", F.pmod(F.xxhash64("id", F.lit(1)), F.col("_files"))).drop("_salt", "_files")
    dealt = filed.repartition(*parts, "_file").drop("_file")
    dealt.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(*parts).parquet(f"{path}/vectors")
    config.write.mode("overwrite").json(f"{path}/config")


def save_centers(centers: DataFrame, path: str) -> None:
    """The cells' centres beside the index they belong to."""
    centers.write.mode("overwrite").parquet(f"{path}/centers")


def read_centers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/centers")


def read_index(spark: SparkSession, path: str, config: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{path}/vectors")
    return df if config is None else df.filter(F.col("config") == config)


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("config").json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """One metric row per configuration, beside the results."""
    df.write.mode("overwrite").json(path)


def read_metric_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Metric rows as they were written."""
    return spark.read.schema(schema).json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric rows of either layout under one set of names."""
    return unify_metrics(spark.read.schema(METRICS).json(path))


def unify_metrics(raw: DataFrame) -> DataFrame:
    total = F.coalesce("total_cases", "num_cases", F.lit(0))
    return raw.select(
        "config",
        total.alias("total_cases"),
        F.coalesce("successful_cases", total).alias("successful_cases"),
        F.coalesce("failed_cases", F.lit(0)).alias("failed_cases"),
        *[
            F.coalesce(c, F.lit(0.0)).alias(c)
            for c in ("avg_recall_at_k", "avg_retrieval_time_ms", "avg_generation_time_ms")
        ],
    )


def list_configs(vectors: DataFrame, catalog_types: list[str], densities: list[str]) -> DataFrame:
    """Configurations (embedding type x density) that have an index, with size and dimension.

    The grid of names is two exploded literal arrays. Types may end in
    ``_indices``; the configuration name leaves that out.
    """
    spark = vectors.sparkSession
    grid = (
        spark.range(1)
        .select(F.explode(F.array(*[F.lit(t) for t in catalog_types])).alias("index_dir"))
        .withColumn("density", F.explode(F.array(*[F.lit(d) for d in densities])))
        .withColumn("embedding_type", F.regexp_replace("index_dir", "_indices$", ""))
        .withColumn("config", F.concat_ws("_", "embedding_type", "density"))
    )
    found = vectors.groupBy("config").agg(
        F.count(F.lit(1)).alias("n_vectors"), F.max(F.size("embedding")).cast("bigint").alias("embedding_dim")
    )
    return grid.join(found, "config").select("config", "embedding_type", "density", "embedding_dim", "n_vectors")


def run_record(vectors: DataFrame, model: str, **settings) -> DataFrame:
    """One row that describes a vector run; settings become constant columns."""
    norm = V.l2_norm(F.col("embedding"))
    return vectors.agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.max(F.size("embedding")).cast("bigint").alias("embedding_dim"),
        F.avg(norm).alias("mean_norm"),
        F.stddev_pop(norm).alias("std_norm"),
        F.min(norm).alias("min_norm"),
        F.max(norm).alias("max_norm"),
    ).withColumns({"model": F.lit(model), **{k: F.lit(v) for k, v in settings.items()}})
