"""The reference data model as views over the given tables.

``orders`` stand for images, ``lineitem`` rows for polygon annotations,
``embeddings`` for region vectors. Nothing is invented besides the mapping:
every row comes from one table row, so the work grows with the tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import regions, shapes
from ..operators.rollup import image_rollup
from ..ranks import bucketed_row_number, stored

DENSITIES = ["high", "medium", "low"]
EMBEDDING_TYPES = ["visual_indices", "text_indices"]


class Views:
    """Lazily built views for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def images(self) -> DataFrame:
        """image_id, image_name, image_w, image_h."""
        flag = F.when(F.col("o_orderstatus") == "F", "ko").otherwise("ok")
        zone = (F.col("o_custkey") % 10 + 1).cast("string")
        name = F.concat(
            F.lit("zona1_"), flag, F.lit("_2_3_"), F.col("o_orderkey").cast("string"), F.lit("_zona_"), zone,
            F.lit("_imageDANO_original.jpg"),
        )
        return self.table("orders").select(
            F.col("o_orderkey").alias("image_id"),
            name.alias("image_name"),
            F.lit(3264).cast("bigint").alias("image_w"),
            F.lit(2448).cast("bigint").alias("image_h"),
        )

    @cached_property
    def shapes(self) -> DataFrame:
        """One row per annotation with its box; every ninth label is the odd one.

        ``shape_idx`` orders the annotations of an image. It packs the row's own
        columns, so no window over an image is needed to number them.
        """
        part, supp = F.col("l_partkey"), F.col("l_suppkey")
        x, y = part * 37 % 400 + supp * 11 % 400 + 1200, part * 53 % 400 + supp * 29 % 400 + 900
        w, h = part * 3 % 220 + 4, (supp * 7 + part) % 180 + 4
        packed = ((F.col("l_linenumber").cast("bigint") * 10_000_000 + part) * 1_000_000 + supp) * 100
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("image_id"),
            (packed + F.col("l_quantity").cast("bigint")).alias("shape_idx"),
            ((supp + part) % 9 + 1).cast("string").alias("label"),
            F.when(F.col("l_tax") > 0.075, "rectangle").otherwise("polygon").alias("shape_type"),
            x.alias("x_min"),
            y.alias("y_min"),
            (x + w).alias("x_max"),
            (y + h).alias("y_max"),
            F.lit(3264).cast("bigint").alias("image_w"),
            F.lit(2448).cast("bigint").alias("image_h"),
        )

    @cached_property
    def polygons(self) -> DataFrame:
        return shapes.polygons_only(self.shapes)

    @cached_property
    def boxes(self) -> DataFrame:
        """Polygons without the odd label."""
        return shapes.polygons_only(self.shapes, drop_odd_label=True)

    @cached_property
    def indexed_boxes(self) -> DataFrame:
        """Boxes with their position 0..n-1 in the image's document as ``shape_idx``.

        Line numbers lead the order and cut an image into buckets, so no image is
        numbered by one task.
        """
        bucket = F.expr("shape_idx div 1000000000000000")
        numbered = bucketed_row_number(self.boxes, ["image_id"], [F.col("shape_idx"), F.col("x_min"), F.col("y_min")], bucket, "position")
        return numbered.withColumn("shape_idx", F.col("position") - 1).drop("position")

    @cached_property
    def points(self) -> DataFrame:
        """Polygons with fractional corner points instead of a box."""
        at = lambda x, dx, y, dy: F.array((F.col(x) + dx).cast("double"), (F.col(y) + dy).cast("double"))
        corners = F.array(
            at("x_min", 0.7, "y_min", 0.2), at("x_max", 0.9, "y_min", 0.5),
            at("x_max", 0.3, "y_max", 0.8), at("x_min", 0.4, "y_max", 0.6),
        )
        return self.polygons.withColumn("points", corners).drop("x_min", "y_min", "x_max", "y_max")

    @cached_property
    def documents(self) -> DataFrame:
        """File names of the annotation documents.

        An image with line items has a damage document. Of the others, urgent
        orders have no document and the rest a clean one.
        """
        have = self.shapes.select("image_id").distinct().withColumn("_h", F.lit(1))
        urgent = self.table("orders").select(
            F.col("o_orderkey").alias("image_id"), F.startswith("o_orderpriority", F.lit("1")).alias("_urgent")
        )
        named = self.images.join(have, "image_id", "left").join(urgent, "image_id")
        suffix = F.when(F.col("_h").isNotNull(), "_labelDANO_modificado.json").otherwise("_imageDANO_original.json")
        return named.filter(F.col("_h").isNotNull() | ~F.col("_urgent")).select(
            F.concat(F.regexp_replace("image_name", "_imageDANO_original\\.jpg$", ""), suffix).alias("file_name")
        )

    @cached_property
    def records(self) -> DataFrame:
        return image_rollup(self.images, self.boxes)

    @cached_property
    def per_image(self) -> DataFrame:
        return self.boxes.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_defects"))

    @cached_property
    def typed_boxes(self) -> DataFrame:
        return shapes.with_types(shapes.filter_area(self.polygons, 50, 300_000))

    @cached_property
    def clustering(self) -> tuple[DataFrame, DataFrame]:
        """Members and rows of the merged clusters."""
        return regions.plan_clusters(self.typed_boxes)

    @cached_property
    def seed_members(self) -> DataFrame:
        return regions.cluster_seed(self.boxes)

    @cached_property
    def outlines(self) -> DataFrame:
        """A six-cornered vehicle outline per image, from the order key and total."""
        shift = F.col("o_orderkey") % 500
        drop = (F.col("o_custkey") % 300).cast("bigint")
        point = lambda x, y: F.array(x.cast("int"), y.cast("int"))
        polygon = F.array(
            point(F.lit(200) + shift, F.lit(700) + drop), point(F.lit(900) + shift, F.lit(300) + drop),
            point(F.lit(2000) + shift, F.lit(350) + drop), point(F.lit(2700) + shift, F.lit(900) + drop),
            point(F.lit(2600) + shift, F.lit(1900) + drop), point(F.lit(300) + shift, F.lit(1800) + drop),
        )
        return self.table("orders").select(F.col("o_orderkey").alias("image_id"), polygon.alias("outline"))

    @cached_property
    def crossing_outlines(self) -> DataFrame:
        """The corners of the outlines in an order in which edges cross."""
        return self.outlines.select("image_id", F.array(*[F.col("outline")[i] for i in (0, 3, 1, 4, 2, 5)]).alias("outline"))

    @cached_property
    def vectors(self) -> DataFrame:
        """id, embedding, raw label, zone, density and damage flag of each region vector."""
        raw = (
            F.when(F.col("label") <= 7, (F.col("label") + 1).cast("string"))
            .when(F.col("label") == 8, "unknown")
            .otherwise("no_damage")
        )
        density = F.get(F.array(*[F.lit(d) for d in DENSITIES]), (F.col("vec_id") % 3).cast("int"))
        zone = (F.col("vec_id") % 10 + 1).cast("string")
        return self.table("embeddings").select(
            F.col("vec_id").alias("id"),
            "embedding",
            raw.alias("label_raw"),
            zone.alias("vehicle_zone"),
            L.zone_description(zone).alias("zone_description"),
            L.zone_area(zone).alias("zone_area"),
            density.alias("density"),
            (F.col("label") != 9).alias("has_damage"),
            (F.col("label") * F.lit(2) + F.lit(1)).cast("bigint").alias("total_defects"),
        )

    @cached_property
    def queries(self) -> DataFrame:
        """Every vector as a query with its expected type."""
        return self.vectors.select(
            F.col("id").alias("query_id"),
            "embedding",
            F.col("label_raw").alias("expected_type"),
            F.col("vehicle_zone").alias("query_zone"),
            F.col("has_damage").alias("query_has_damage"),
        )

    @cached_property
    def parts(self) -> DataFrame:
        """Vectors with their first half as visual and second half as text part."""
        return self.vectors.withColumns(
            {"visual": F.slice("embedding", 1, 32), "text_part": F.slice("embedding", 33, 32)}
        )

    @cached_property
    def configs_vectors(self) -> DataFrame:
        """Vectors under their configurations: the whole vector and its text half."""
        visual = self.vectors.withColumn("config", F.concat_ws("_", F.lit("visual"), "density"))
        text = self.parts.withColumn("embedding", F.col("text_part")).drop("visual", "text_part")
        return visual.unionByName(text.withColumn("config", F.concat_ws("_", F.lit("text"), "density")))

    @cached_property
    def results(self) -> DataFrame:
        """Top 5 of every query in each of the three visual corpora, self left out."""
        from ..operators.search import knn

        corpus = self.vectors.withColumn("config", F.concat_ws("_", F.lit("visual"), "density"))
        hits = stored(knn(self.queries, corpus, 5, by="config", exclude_self=True))  # read more than once
        return hits.join(self.vectors.select("id", F.col("label_raw").alias("retrieved_type")), "id")

    @cached_property
    def results10(self) -> DataFrame:
        """As ``results``, ten deep."""
        from ..operators.search import knn

        corpus = self.vectors.withColumn("config", F.concat_ws("_", F.lit("visual"), "density"))
        hits = stored(knn(self.queries, corpus, 10, by="config", exclude_self=True))
        return hits.join(self.vectors.select("id", F.col("label_raw").alias("retrieved_type")), "id")

    @cached_property
    def metrics_both(self) -> DataFrame:
        """Metric rows of the whole vectors and of their text halves."""
        from .evaluate import evaluate_configs
        from ..sources.tables import list_configs

        corpora = self.configs_vectors.select("config", "id", "embedding", F.col("label_raw").alias("retrieved_type"))
        configs = list_configs(self.configs_vectors, EMBEDDING_TYPES, DENSITIES)
        truth = self.truth.select("query_id", "expected_type").distinct()
        halves = self.parts.select(F.col("id").alias("query_id"), F.col("text_part").alias("embedding"))
        out = [evaluate_configs(configs, corpora, q, truth, exclude_self=True, run_log=self.run_log_both) for q in (self.queries.select("query_id", "embedding"), halves)]
        return out[0].unionByName(out[1])

    @cached_property
    def centers(self) -> DataFrame:
        """Mean vector of each label: cells that other engines can compute as well."""
        parts = self.table("embeddings").select("label", F.posexplode("embedding").alias("d", "x"))
        means = parts.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
        listed = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("d", "m"))).alias("p"))
        return listed.select(F.col("label").cast("bigint").alias("cell"), F.transform("p", lambda p: p["m"]).alias("center"))

    @cached_property
    def leaked(self) -> DataFrame:
        """Test vectors: those of high density, and copies of every seventh of the others."""
        copies = self.vectors.filter("density <> 'high' AND id % 7 = 0").withColumn("id", F.col("id") + 1_000_000)
        return self.vectors.filter("density = 'high'").unionByName(copies)

    @cached_property
    def damaged_vectors(self) -> DataFrame:
        """The vectors, some of them missing, zero, NaN or infinite."""
        n = F.col("id") % 11
        bad = lambda x: F.transform("embedding", lambda e, i: F.when(i == 3, F.lit(x).cast("float")).otherwise(e))
        vector = (
            F.when(n == 1, F.lit(None).cast("array<float>"))
            .when(n == 2, F.transform("embedding", lambda e: F.lit(0.0).cast("float")))
            .when(n == 3, bad(float("nan")))
            .when(n == 4, bad(float("inf")))
            .otherwise(F.col("embedding"))
        )
        return self.vectors.withColumn("embedding", vector)

    @cached_property
    def truth(self) -> DataFrame:
        """Expected type of each query under each configuration; vectors of label 8 have none."""
        names = F.array(*[F.lit(f"visual_{d}") for d in DENSITIES])
        expected = F.when(F.col("expected_type") == "unknown", "").otherwise(F.col("expected_type"))
        return self.queries.select("query_id", expected.alias("expected_type")).withColumn("config", F.explode(names))

    @cached_property
    def run_log(self) -> DataFrame:
        """Recorded times of each (configuration, query): the event values, dealt to the queries in turn."""
        return self._times("visual")

    @cached_property
    def run_log_both(self) -> DataFrame:
        """The recorded times under the configurations of both embedding types."""
        return self._times("visual").unionByName(self._times("text"))

    def _times(self, embedding_type: str) -> DataFrame:
        names = F.array(*[F.lit(f"{embedding_type}_{d}") for d in DENSITIES])
        n = self.queries.agg(F.count(F.lit(1))).scalar()
        return (
            self.table("events").select(F.pmod("event_id", n).alias("query_id"), "value")
            .withColumn("config", F.explode(names))
            .select(
                "config",
                "query_id",
                (F.col("value") / F.length("config")).alias("retrieval_time_ms"),
                (F.col("value") * 3).alias("generation_time_ms"),
            )
        )

    @cached_property
    def metrics(self) -> DataFrame:
        from ..operators.evaluate import judged, retrieval_metrics

        return retrieval_metrics(judged(self.results, self.truth), run_log=self.run_log)

    @cached_property
    def answers(self) -> DataFrame:
        """A stored answer per image: JSON of its distinct labels, fenced, plain or broken."""
        items = self.boxes.groupBy("image_id").agg(F.sort_array(F.collect_set("label")).alias("labels"))
        damages = F.transform(
            F.col("labels"),
            lambda x: F.struct(
                L.canonical_label(x).alias("type"), F.concat(F.lit("spot "), x).alias("location"), F.lit("low").alias("severity")
            ),
        )
        body = F.to_json(F.struct(damages.alias("damages"), F.concat(F.lit("case "), F.col("image_id").cast("string")).alias("summary")))
        kind = F.col("image_id") % 4
        text = (
            F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .when(kind == 1, F.concat(F.lit("```\n"), body, F.lit("\n```")))
            .when(kind == 2, body)
            .otherwise(F.concat(F.lit("Seen: "), F.array_join("labels", " ")))
        )
        return items.select(F.col("image_id").alias("case_id"), text.alias("generated_answer"))


def order_key(column: str, seed: int = 42) -> Column:
    """Arithmetic shuffle key that other SQL engines can compute too."""
    return F.pmod(F.col(column) % F.lit(1 << 31) * F.lit(2654435761) + F.lit(seed), F.lit(1 << 32))
