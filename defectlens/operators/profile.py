"""Data-set profile, corpus statistics and vector diagnostics.

Shares of a total are taken over already aggregated rows (one per type, zone or
class), so the single-row windows used here never see the data itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..dims import BENCHMARK_LABELS
from ..functions import labels as L
from ..functions import text as X
from ..functions import vectors as V
from ..ranks import hash_key

def all_rows() -> WindowSpec:
    """Window over every row; only for tables that are already aggregated."""
    return Window.partitionBy(F.lit(0))


def defects_per_image(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_defects"))


def profile_totals(boxes: DataFrame) -> DataFrame:
    return defects_per_image(boxes).agg(
        F.count(F.lit(1)).alias("total_images"),
        F.sum("n_defects").alias("total_defects"),
        F.avg("n_defects").alias("mean_defects"),
        F.median("n_defects").alias("median_defects"),
        F.stddev_pop("n_defects").alias("std_defects"),
        F.min("n_defects").alias("min_defects"),
        F.max("n_defects").alias("max_defects"),
    )


def with_share(counts: DataFrame, n: str = "n", name: str = "pct") -> DataFrame:
    return counts.withColumn(name, F.col(n) * 100.0 / F.sum(n).over(all_rows()))


def type_distribution(boxes: DataFrame) -> DataFrame:
    """Counts and shares by label with the imbalance ratio and its verdict."""
    counts = boxes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    ratio = F.max("n").over(all_rows()) / F.min("n").over(all_rows())
    return (
        with_share(counts)
        .withColumn("damage_type", L.canonical_label(F.col("label")))
        .withColumn("imbalance_ratio", ratio)
        .withColumn("imbalance", X.verdict(F.col("imbalance_ratio"), [(50, "extreme"), (10, "high")], "balanced"))
    )


def zone_distribution(images: DataFrame) -> DataFrame:
    """Images by vehicle zone in numeric order, unknown last."""
    counts = images.groupBy("vehicle_zone").agg(F.count(F.lit(1)).alias("n_images"))
    order = F.coalesce(F.col("vehicle_zone").try_cast("int"), F.lit(999))
    position = F.row_number().over(all_rows().orderBy(order, "vehicle_zone"))
    return counts.withColumn("zone_name", L.zone_name(F.col("vehicle_zone"))).withColumn("position", position)


def label_counts(boxes: DataFrame) -> DataFrame:
    """Boxes and first position of each (image, label): small input for joins on the image."""
    return boxes.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("shape_idx").alias("first"))


def zone_type_matrix(boxes: DataFrame, zones: DataFrame) -> DataFrame:
    """Boxes by vehicle zone and label; ``zones`` has ``image_id, vehicle_zone``.

    Boxes are counted per image before the join, so an image with very many of
    them takes part with one row per label.
    """
    joined = label_counts(boxes).join(zones.select("image_id", "vehicle_zone"), "image_id")
    return joined.groupBy("vehicle_zone", "label").agg(
        F.sum("n").alias("n"), F.min(F.struct("image_id", "first")).alias("first")
    )


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """First n rows of each group; Spark limits each partition before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= n)


def top_types_by_zone(boxes: DataFrame, zones: DataFrame, n: int = 3) -> DataFrame:
    return top_n(zone_type_matrix(boxes, zones), ["vehicle_zone"], [F.desc("n"), F.asc("first")], n)


FIXED_DENSITY = [(5, "low"), (15, "medium")]
DENSITY_SHARES = {
    "terciles": ([0.33, 0.66], ["low", "medium", "high"]),
    "quartiles": ([0.25, 0.50, 0.75], ["very_low", "low", "medium", "high"]),
}


def density_class(per_image: DataFrame, mode: str = "fixed", count: str = "n_defects") -> DataFrame:
    """Density class of each image from fixed or percentile limits (inclusive upper bounds).

    Percentiles come from a scalar subquery over the distinct counts.
    """
    value = F.col(count)
    if mode == "fixed":
        limits, names = [F.lit(b) for b, _ in FIXED_DENSITY], [n for _, n in FIXED_DENSITY] + ["high"]
    else:
        shares, names = DENSITY_SHARES[mode]
        cuts = per_image.agg(F.percentile(value, F.array(*[F.lit(s) for s in shares])).alias("cuts")).scalar()
        limits = [F.get(cuts, F.lit(i)) for i in range(len(shares))]
    chain = None
    for limit, name in zip(limits, names):
        chain = F.when(value <= limit, name) if chain is None else chain.when(value <= limit, name)
    return per_image.withColumn("density", chain.otherwise(names[-1]))


def density_share(classed: DataFrame) -> DataFrame:
    return with_share(classed.groupBy("density").agg(F.count(F.lit(1)).alias("n")))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between minimum and maximum; the last bin is closed."""
    value = F.col(column).cast("double")
    ends = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high")).alias("ends")).scalar()
    bounded = df.select(value.alias("v"), ends["low"].alias("low"), ends["high"].alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    position = F.floor((F.col("v") - F.col("low")) * bins / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))
    bin_ = F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1)).cast("bigint")
    return (
        bounded.groupBy(bin_.alias("bin"), F.col("low").alias("_low"), width.alias("_width"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bin", (F.col("_low") + F.col("bin") * F.col("_width")).alias("bin_start"), "n")
    )


def region_stats(regions: DataFrame, total: str = "is_usable") -> DataFrame:
    """Region counts by type, zone and size class in one pass, with the usable rate."""
    grouped = regions.groupingSets(
        [[F.col("damage_type")], [F.col("spatial_zone")], [F.col("size_class")]], "damage_type", "spatial_zone", "size_class"
    ).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(total)).alias("n_usable"))
    return grouped.select(
        F.when(F.col("damage_type").isNotNull(), "type")
        .when(F.col("spatial_zone").isNotNull(), "zone")
        .otherwise("size")
        .alias("breakdown"),
        F.coalesce("damage_type", "spatial_zone", "size_class").alias("value"),
        "n",
        (F.col("n_usable") * 100.0 / F.col("n")).alias("usable_pct"),
    )


def subset_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.avg(value).alias("mean_value"),
        F.median(value).alias("median_value"),
    )


# -- taxonomy ---------------------------------------------------------------


def taxonomy_coverage(labels: DataFrame, label: str = "label") -> DataFrame:
    """Totals over label rows; pass one row per label use."""
    counts = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    mapped = F.coalesce(F.sum(F.when(L.is_mapped(F.col(label)), F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return counts.agg(
        total.alias("total_samples"),
        mapped.alias("mapped_samples"),
        (total - mapped).alias("unmapped_samples"),
        F.coalesce(mapped * 100.0 / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("coverage_percent"),
    )


def cluster_label_uses(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Label uses with clusters counted by their dominant type and by every member."""
    return clusters.select(F.col("dominant_type").alias("label")).unionByName(
        members.select(F.col("damage_type").alias("label"))
    )


def label_distribution(labels: DataFrame, label: str = "label") -> DataFrame:
    return (
        labels.groupBy(F.col(label).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("benchmark_label", L.benchmark_label(F.col("label")))
        .withColumn("is_mapped", L.is_mapped(F.col("label")))
    )


def missing_classes(labels: DataFrame, label: str = "label") -> DataFrame:
    """Benchmark classes (special cases aside) that no label row maps to."""
    special = ["No damage", "Unknown"]
    wanted = labels.sparkSession.createDataFrame(
        [(b,) for b in BENCHMARK_LABELS if b not in special], "benchmark_label string"
    )
    seen = labels.select(L.benchmark_label(F.col(label)).alias("benchmark_label")).distinct()
    return wanted.join(seen, "benchmark_label", "left_anti")


# -- vectors ----------------------------------------------------------------


def norm_stats(vectors: DataFrame, by: list[str] | None = None, column: str = "embedding") -> DataFrame:
    normed = vectors.withColumn("_norm", V.l2_norm(F.col(column)))
    return normed.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_norm").alias("mean_norm"),
        F.stddev_pop("_norm").alias("std_norm"),
        F.min("_norm").alias("min_norm"),
        F.max("_norm").alias("max_norm"),
    )


def component_stats(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Statistics over all elements of all vectors; each vector is summed up inside its row first."""
    v = V.as_double(F.col(column))
    add = lambda f: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + f(x))
    rows = vectors.select(
        F.size(v).alias("n"), add(lambda x: x).alias("s"), add(lambda x: x * x).alias("q"), F.array_min(v).alias("low"), F.array_max(v).alias("high")
    ).filter("n > 0")
    total, n = rows.agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")], F.min("low").alias("low"), F.max("high").alias("high")), F.col("n")
    spread = F.greatest(F.col("q") / n - (F.col("s") / n) ** 2, F.lit(0.0))
    return total.select(
        F.coalesce(n, F.lit(0)).cast("bigint").alias("n"), (F.col("s") / n).alias("mean_value"), F.sqrt(spread).alias("std_value"),
        F.col("low").alias("min_value"), F.col("high").alias("max_value"),
    )


def vector_audit(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Zero, broken and usable vectors."""
    v = F.col(column)
    bad = F.coalesce(V.has_bad_values(v), F.lit(True))
    zero = F.coalesce(V.l2_norm(v) == 0, F.lit(False))
    return vectors.agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.count_if(v.isNull()).alias("n_missing"),
        F.count_if(bad & v.isNotNull()).alias("n_bad"),
        F.count_if(zero & ~bad).alias("n_zero"),
        F.count_if(~bad & ~zero).alias("n_ok"),
    )


def mean_pair_cosine(vectors: DataFrame, by: list[str], column: str = "embedding") -> DataFrame:
    """Mean cosine similarity over all pairs of each group, without forming pairs.

    For unit vectors the pair sum is (|sum of vectors|^2 - n) / 2, so one
    map-side combined sum per dimension is enough, whatever the group size.
    """
    unit = vectors.select(*by, V.l2_normalize(F.col(column)).alias("_u"))
    sums = (
        unit.select(*by, F.posexplode("_u").alias("_d", "_x"))
        .groupBy(*by, "_d")
        .agg(F.sum("_x").alias("_s"), F.sum(F.col("_x") * F.col("_x")).alias("_q"), F.count(F.lit(1)).alias("_n"))
    )
    pairs = F.col("n_vectors") * (F.col("n_vectors") - 1) / 2
    return (
        sums.groupBy(*by)
        .agg(
            F.sum(F.col("_s") * F.col("_s")).alias("_ss"),
            F.sum("_q").alias("_qq"),
            F.max("_n").alias("n_vectors"),
        )
        .select(
            *by,
            "n_vectors",
            pairs.cast("bigint").alias("n_pairs"),
            ((F.col("_ss") - F.col("_qq")) / 2 / F.nullif(pairs, F.lit(0.0))).alias("mean_cosine"),
        )
    )


SIMILARITY_BANDS = [(0.7, "excellent"), (0.5, "good")]


def intra_group_similarity(vectors: DataFrame, by: str, key: str, first: int = 5) -> DataFrame:
    """Mean pair cosine over the first members (by key) of every group with two or more."""
    members = top_n(vectors.select(by, key, "embedding"), [by], [F.col(key)], first, "_rn")
    stats = mean_pair_cosine(members, [by]).filter(F.col("n_vectors") >= 2)
    return stats.withColumn("verdict", X.verdict(F.col("mean_cosine"), SIMILARITY_BANDS, "low"))


def seeded_pick(df: DataFrame, n: int, key: str, seed: int = 42, order: Column | None = None) -> DataFrame:
    """n rows in hash order of the key: a repeatable random pick."""
    return df.orderBy(order if order is not None else hash_key(F.col(key), seed), key).limit(n)


def diversity(vectors: DataFrame, key: str, sample: int | None = 100, seed: int = 42, order: Column | None = None) -> DataFrame:
    """Mean pair cosine distance of a seeded sample; ``sample=None`` uses every vector."""
    picked = vectors if sample is None else seeded_pick(vectors, sample, key, seed, order)
    return (
        mean_pair_cosine(picked, [])
        .withColumn("mean_distance", 1 - F.col("mean_cosine"))
        .drop("mean_cosine")
        .withColumn("verdict", X.verdict(F.col("mean_distance"), [(0.3, "good")], "low"))
    )


def index_stats(vectors: DataFrame) -> DataFrame:
    """One row per corpus: vectors, dimension, kind and defects per image."""
    return vectors.agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.max(F.size("embedding")).cast("bigint").alias("embedding_dim"),
        F.coalesce(F.sum("total_defects"), F.lit(0)).alias("total_defects"),
    ).withColumns(
        {
            "kind": F.when(F.col("embedding_dim") > 1024, "hybrid").otherwise("visual"),
            "avg_defects_per_image": F.coalesce(
                F.col("total_defects") / F.nullif(F.col("n_vectors"), F.lit(0)), F.lit(0.0)
            ),
        }
    )


def damage_split_stats(records: DataFrame) -> DataFrame:
    """Images with and without damage by zone; the zone text is the first one seen."""
    return records.groupBy("vehicle_zone").agg(
        F.count(F.lit(1)).alias("n_images"),
        F.count_if("has_damage").alias("n_with_damage"),
        F.count_if(~F.col("has_damage")).alias("n_without_damage"),
        F.min_by("zone_description", "image_id").alias("zone_description"),
    )


def overall_damage_split(records: DataFrame) -> DataFrame:
    damaged = F.count_if("has_damage")
    return records.agg(
        F.count(F.lit(1)).alias("total_images"),
        damaged.alias("n_with_damage"),
        (damaged * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("pct_with_damage"),
        F.sum("total_defects").alias("total_defects"),
        (F.sum("total_defects") / F.nullif(damaged, F.lit(0))).alias("avg_defects_damaged"),
    )
