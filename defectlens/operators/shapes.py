"""Shape rows: exploding annotations, boxes, area limits, box relations.

Common columns: ``image_id, shape_idx, label, x_min, y_min, x_max, y_max,
image_w, image_h``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import ODD_LABEL
from ..functions import geometry as G
from ..functions import labels as L

CORNERS = ["x_min", "y_min", "x_max", "y_max"]


def explode_shapes(annots: DataFrame, drop_odd_label: bool = False) -> DataFrame:
    """One row per polygon, with its position in the document."""
    rows = annots.select(
        *[c for c in annots.columns if c != "shapes"], F.posexplode("shapes").alias("shape_idx", "_shape")
    ).select("*", "_shape.label", "_shape.shape_type", "_shape.points")
    return polygons_only(rows.drop("_shape"), drop_odd_label)


def polygons_only(shapes: DataFrame, drop_odd_label: bool = False) -> DataFrame:
    kept = shapes.filter(F.col("shape_type") == "polygon")
    return kept.filter(F.col("label") != ODD_LABEL) if drop_odd_label else kept


def with_boxes(shapes: DataFrame, points: str = "points", late: bool = False) -> DataFrame:
    """Integer box columns from the polygon points.

    Points are truncated before min/max; with ``late`` the extremes are
    truncated afterwards and clamped to the image, as the tile plan does.
    """
    p = F.col(points)
    box = G.bbox_from_points_late(p, F.col("image_w"), F.col("image_h")) if late else G.bbox_from_points(p)
    boxed = shapes.withColumn("_box", box)
    return boxed.select("*", *[F.col(f"_box.{c}") for c in CORNERS]).drop("_box")


def with_clamped_boxes(shapes: DataFrame) -> DataFrame:
    clamped = G.clamp_bbox(*[F.col(c) for c in CORNERS], F.col("image_w"), F.col("image_h"))
    return shapes.withColumn("_box", clamped).drop(*CORNERS).select("*", "_box.*").drop("_box")


def with_measures(boxes: DataFrame) -> DataFrame:
    """Width, height, area, floored centre and aspect ratio."""
    x1, y1, x2, y2 = (F.col(c) for c in CORNERS)
    return boxes.withColumns(
        {
            "box_w": (x2 - x1).cast("bigint"),
            "box_h": (y2 - y1).cast("bigint"),
            "area": G.box_area(x1, y1, x2, y2),
            "cx": G.half(x1, x2),
            "cy": G.half(y1, y2),
            "aspect": G.aspect_ratio(x2 - x1, y2 - y1),
        }
    )


def with_position(boxes: DataFrame) -> DataFrame:
    """Relative centre, 3x3 zone, size class and edge flag."""
    x1, y1, x2, y2 = (F.col(c) for c in CORNERS)
    w, h = F.col("image_w"), F.col("image_h")
    placed = boxes.withColumns({"rel_x": G.relative_centre(x1, x2, w), "rel_y": G.relative_centre(y1, y2, h)})
    return placed.withColumns(
        {
            "spatial_zone": G.spatial_zone(F.col("rel_x"), F.col("rel_y")),
            "size_class": G.size_class(G.box_area(x1, y1, x2, y2), w, h),
            "near_edge": G.near_edge(F.col("rel_x"), F.col("rel_y")),
        }
    )


def with_types(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("damage_type", L.canonical_label(F.col("label")))


def filter_area(boxes: DataFrame, low: float | Column = 50, high: float | Column = 300_000) -> DataFrame:
    """Keep boxes whose area lies in the closed range."""
    area = G.box_area(*[F.col(c) for c in CORNERS])
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return boxes.filter((area >= low) & (area <= high))


def adaptive_area_limits(boxes: DataFrame) -> DataFrame:
    """One row ``area_low, area_high`` from the 5th and 99th area percentiles.

    ``percentile`` merges per-partition counts of distinct areas, which are
    whole pixels, so its state is bounded by the image resolution.
    """
    area = G.box_area(*[F.col(c) for c in CORNERS])
    return boxes.agg(
        F.greatest(F.lit(50.0), F.percentile(area, F.lit(0.05)) * 0.1).alias("area_low"),
        (F.percentile(area, F.lit(0.99)) * 1.5).alias("area_high"),
    )


def filter_area_adaptive(boxes: DataFrame) -> DataFrame:
    """Area filter with data-driven limits, read as scalar subqueries."""
    limits = adaptive_area_limits(boxes)
    return filter_area(boxes, limits.select("area_low").scalar(), limits.select("area_high").scalar())


def relate_to_box(boxes: DataFrame, other: list[str]) -> DataFrame:
    """IoU and centre distance of each box and the box in the ``other`` columns."""
    a = [F.col(c) for c in CORNERS]
    b = [F.col(c) for c in other]
    return boxes.withColumns({"iou": G.bbox_iou(*a, *b), "distance": G.bbox_distance(*a, *b)})


#: Distinct centres of an image in a block, and parts of an image's centres when they meet its number of blocks.
BLOCK_CENTRES, SALTS = 2048, 32


def pair_stats(boxes: DataFrame, image: str = "image_id", block: int = BLOCK_CENTRES) -> DataFrame:
    """Boxes, box pairs and mean centre distance over all pairs of each image.

    No pair is ever a row. Boxes are first counted by centre, which bounds a group
    by the image resolution however many boxes share it. The centres of an image
    are cut into blocks; pairs inside a block and pairs of two blocks are added up
    in separate tasks, so a crowded image is no single task.
    """
    centres = (
        boxes.select(
            image,
            (F.col("x_min") + F.col("x_max")).cast("bigint").alias("sx"),
            (F.col("y_min") + F.col("y_max")).cast("bigint").alias("sy"),
        )
        .groupBy(image, "sx", "sy")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    sizes = centres.groupBy(image).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    sizes = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("_blocks") > 1, SALTS - 1).otherwise(0))))
    several = sizes.filter("_blocks > 1")  # images of very many centres
    salted = centres.withColumn("_salt", F.pmod(F.xxhash64("sx", "sy"), F.lit(SALTS)).cast("int"))
    crowded = salted.join(several, [image, "_salt"]).drop("_salt")
    own = F.pmod(F.xxhash64("sx", "sy", F.lit(1)), F.col("_blocks")).cast("int")
    crowded = crowded.withColumn("_block", own)
    calm = centres.join(several.select(image).distinct(), image, "left_anti").withColumn("_block", F.lit(0))
    inner = calm.unionByName(crowded.drop("_blocks"))
    kind = dict(boxes.dtypes)[image]
    keys = [image, "_block"]
    ordered = inner.repartition(*keys).sortWithinPartitions(*keys)
    inside = ordered.mapInPandas(lambda batches: _pair_summaries(batches, keys), f"`{image}` {kind}, _block int, n_boxes bigint, distances double")
    meet = crowded.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).filter("_other <> _block")
    meet = meet.withColumns({"_i": F.least("_block", "_other"), "_j": F.greatest("_block", "_other")})
    across = meet.groupBy(image, "_i", "_j").applyInPandas(lambda pdf: _between_blocks(pdf, image), f"`{image}` {kind}, distances double")
    both = inside.select(image, "n_boxes", "distances").unionByName(across.withColumn("n_boxes", F.lit(0).cast("bigint")))
    total = both.groupBy(image).agg(F.sum("n_boxes").alias("n_boxes"), F.sum("distances").alias("_d"))
    pairs = F.expr("n_boxes * (n_boxes - 1) div 2")
    return total.select(image, "n_boxes", pairs.alias("n_pairs"), (F.col("_d") / F.nullif(pairs, F.lit(0))).alias("mean_pair_distance"))


def _between_blocks(pdf, image: str):
    """Sum of the distances between the boxes of two blocks."""
    import numpy as np
    import pandas as pd

    first = (pdf["_block"] == pdf["_i"]).to_numpy()
    x, y, n = (pdf[c].to_numpy().astype(np.float64) for c in ("sx", "sy", "n"))
    total = sum(float(n[i] * (n[~first] * np.hypot(x[~first] - x[i], y[~first] - y[i])).sum()) for i in np.flatnonzero(first)) / 2
    return pd.DataFrame({image: [pdf[image].iloc[0]], "distances": [total]})


def _pair_summaries(batches: Iterator, keys: list[str]) -> Iterator:
    """Boxes and sums of pair distances of whole blocks, from rows sorted by image and block."""
    import pandas as pd

    held: list = []  # rows of the block the last batch ended in
    at = lambda pdf, i: tuple(pdf[k].iloc[i] for k in keys)
    for pdf in batches:
        if len(pdf) == 0:
            continue
        last = at(pdf, -1)
        if at(pdf, 0) == last and held and at(held[-1], -1) == last:
            held.append(pdf)
            continue
        whole = pd.concat([*held, pdf], ignore_index=True) if held else pdf
        open_rows = (whole[keys[0]] == last[0]) & (whole[keys[1]] == last[1])
        yield _summarise_blocks(whole[~open_rows], keys)
        held = [whole[open_rows]]
    if held:
        yield _summarise_blocks(pd.concat(held, ignore_index=True), keys)


FEW_CENTRES = 64


def _summarise_blocks(rows, keys: list[str]):
    import numpy as np
    import pandas as pd

    image, block = (rows[k].to_numpy() for k in keys)
    n = rows["n"].to_numpy().astype(np.float64)
    sx, sy = rows["sx"].to_numpy(), rows["sy"].to_numpy()
    new = (image[1:] != image[:-1]) | (block[1:] != block[:-1])
    start = np.flatnonzero(np.r_[True, new]) if len(image) else np.empty(0, dtype=np.int64)
    size = np.diff(np.r_[start, len(image)])
    group = np.repeat(np.arange(len(start)), size)
    total = np.zeros(len(start))
    small = size[group] <= FEW_CENTRES if len(start) else np.zeros(0, dtype=bool)
    # blocks of few centres, all at once: pair each row with the one k places on
    for k in range(1, min(int(size.max(initial=1)), FEW_CENTRES)):
        i = np.flatnonzero((group[:-k] == group[k:]) & small[:-k])
        total += np.bincount(group[i], n[i] * n[i + k] * np.hypot(sx[i] - sx[i + k], sy[i] - sy[i + k]) / 2, len(start))
    for g in np.flatnonzero(size > FEW_CENTRES):
        part = slice(start[g], start[g] + size[g])
        total[g] = _distance_sum(sx[part], sy[part], n[part])
    boxes = np.add.reduceat(n, start).astype(np.int64) if len(start) else np.empty(0, dtype=np.int64)
    return pd.DataFrame({keys[0]: image[start], keys[1]: block[start], "n_boxes": boxes, "distances": total})


def _distance_sum(sx, sy, n) -> float:
    import numpy as np

    far = lambda i: np.hypot(sx[i + 1 :] - sx[i], sy[i + 1 :] - sy[i]) / 2
    return sum(float(n[i] * (n[i + 1 :] * far(i)).sum()) for i in range(len(n) - 1))
