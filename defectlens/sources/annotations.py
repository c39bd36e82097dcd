"""Reading annotation documents and outlines, and listing files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ANNOTATION, OUTLINE

DAMAGE_GLOB = "*labelDANO_modificado.json"
IMAGE_SUFFIX = "_imageDANO_original.jpg"
DAMAGE_SUFFIX = "_labelDANO_modificado.json"
CLEAN_SUFFIX = "_imageDANO_original.json"


def read_annotations(spark: SparkSession, path: str, glob: str = DAMAGE_GLOB, multi_line: bool = True) -> DataFrame:
    """One row per document with its file name; broken documents carry ``_corrupt``.

    ``multi_line=False`` reads files that hold one document per line.
    """
    docs = (
        spark.read.schema(ANNOTATION)
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .json(path)
    )
    return docs.select(
        F.col("_metadata.file_name").alias("file_name"),
        "imagePath",
        F.col("imageWidth").alias("image_w"),
        F.col("imageHeight").alias("image_h"),
        "shapes",
        "_corrupt",
    )


def split_valid(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid documents, quarantined documents with a reason)."""
    reason = (
        F.when(F.col("_corrupt").isNotNull(), "unreadable")
        .when(F.col("imagePath").isNull(), "no image path")
        .when(F.col("shapes").isNull(), "no shapes")
    )
    marked = docs.withColumn("reason", reason)
    return marked.filter(F.col("reason").isNull()).drop("reason", "_corrupt"), marked.filter(F.col("reason").isNotNull())


def read_outlines(spark: SparkSession, path: str) -> DataFrame:
    """Outline list: one JSON array of ``{filename, polygon}``, or one object per line."""
    return spark.read.schema(OUTLINE).option("multiLine", True).json(path)


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """File names under a folder; only the path column is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"))


def classify_images(images: DataFrame, annots: DataFrame, strict: bool = True) -> DataFrame:
    """Damaged, clean or orphan by the documents that exist for each image.

    Both frames have ``file_name``. ``strict=False`` follows the region script:
    every image without a damage document is clean, and names of another shape
    use their stem.
    """
    base = F.regexp_replace("file_name", F.lit(IMAGE_SUFFIX.replace(".", r"\.") + "$"), F.lit(""))
    stem = F.when(F.endswith("file_name", F.lit(IMAGE_SUFFIX)), base).otherwise(
        F.regexp_replace("file_name", r"\.[^.]*$", "")
    )
    keyed = images.withColumn("_base", stem)
    damage = _documents(annots, DAMAGE_SUFFIX, "damage_doc")
    clean = _documents(annots, CLEAN_SUFFIX, "clean_doc")
    joined = keyed.join(damage, "_base", "left").join(clean, "_base", "left")
    status = F.when(F.col("damage_doc").isNotNull(), "damaged")
    if strict:
        status = status.when(F.col("clean_doc").isNotNull(), "clean").otherwise("orphan")
    else:
        status = status.otherwise("clean")
    return joined.withColumn("status", status).drop("_base")


def _documents(annots: DataFrame, suffix: str, name: str) -> DataFrame:
    cut = F.regexp_replace("file_name", F.lit(suffix.replace(".", r"\.") + "$"), F.lit(""))
    found = annots.filter(F.endswith("file_name", F.lit(suffix))).select(cut.alias("_base"), F.col("file_name").alias(name))
    return found.groupBy("_base").agg(F.min(name).alias(name))


def pair_masked(originals: DataFrame, masked: DataFrame, annots: DataFrame) -> DataFrame:
    """Masked partner and number of documents of each original image.

    Documents belong to an image when their name starts with its identifier. The
    identifier ends before a fixed word, so the document's own identifier is cut
    the same way and the prefix test becomes an equi-join.
    """
    ident = lambda: F.regexp_replace("file_name", r"_(imageDANO|labelDANO).*$|\.[^.]*$", "")
    counts = annots.select(ident().alias("_ident")).groupBy("_ident").agg(F.count(F.lit(1)).alias("n_docs"))
    have = masked.select(F.regexp_replace("file_name", "^masked_", "").alias("_partner")).distinct().withColumn("_m", F.lit(1))
    return (
        originals.withColumns({"_ident": ident(), "_partner": F.col("file_name")})
        .join(have, "_partner", "left")
        .join(counts, "_ident", "left")
        .select(
            "file_name",
            F.concat(F.lit("masked_"), F.col("file_name")).alias("masked_name"),
            F.col("_m").isNotNull().alias("is_found"),
            F.when(F.col("_m").isNotNull(), F.coalesce("n_docs", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("n_docs"),
        )
    )


def pair_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count_if("is_found").alias("n_found"), F.count_if(~F.col("is_found")).alias("n_missing"), F.sum("n_docs").alias("n_docs")
    )


def attach_outline(images: DataFrame, outlines: DataFrame, order: str) -> DataFrame:
    """Left join by file name; of several outlines the one last in ``order`` counts."""
    last = outlines.groupBy(F.col("filename").alias("image_name")).agg(F.max_by("polygon", order).alias("outline"))
    return images.join(last, "image_name", "left")


def existing_only(df: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    return df.join(listing.select(key).distinct(), key, "left_semi")


def existence_counts(df: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    have = listing.select(key).distinct().withColumn("_e", F.lit(1))
    return df.join(have, key, "left").agg(
        F.count("_e").alias("n_valid"), (F.count(F.lit(1)) - F.count("_e")).alias("n_missing")
    )
