"""Box, zone and padding arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import DEFAULT_PADDING, LABEL_NAMES, PADDING, SIZE_CUTS, THIRD_HIGH, THIRD_LOW, lookup


def _i(c: Column) -> Column:
    return c.cast("int")


def bbox_from_points(points: Column) -> Column:
    """Integer box of a polygon; each coordinate is truncated before min/max."""
    xs = F.transform(points, lambda p: _i(p[0]))
    ys = F.transform(points, lambda p: _i(p[1]))
    return F.struct(
        F.array_min(xs).alias("x_min"),
        F.array_min(ys).alias("y_min"),
        F.array_max(xs).alias("x_max"),
        F.array_max(ys).alias("y_max"),
    )


def bbox_from_points_late(points: Column, image_w: Column, image_h: Column) -> Column:
    """Integer box truncated after min/max and clamped to the image."""
    xs = F.transform(points, lambda p: p[0])
    ys = F.transform(points, lambda p: p[1])
    return clamp_bbox(
        _i(F.array_min(xs)), _i(F.array_min(ys)), _i(F.array_max(xs)), _i(F.array_max(ys)), image_w, image_h
    )


def clamp_bbox(x_min, y_min, x_max, y_max, image_w, image_h) -> Column:
    """Low corner not below zero, high corner not beyond the image."""
    return F.struct(
        F.greatest(F.lit(0), x_min).alias("x_min"),
        F.greatest(F.lit(0), y_min).alias("y_min"),
        F.least(image_w, x_max).alias("x_max"),
        F.least(image_h, y_max).alias("y_max"),
    )


def box_area(x_min, y_min, x_max, y_max) -> Column:
    return (x_max - x_min).cast("bigint") * (y_max - y_min).cast("bigint")


def half(a: Column, b: Column) -> Column:
    """Integer midpoint, rounded down."""
    return F.floor((a + b) / 2).cast("bigint")


def aspect_ratio(w: Column, h: Column) -> Column:
    return F.when(h > 0, w / h).otherwise(F.lit(1.0))


def bbox_iou(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) -> Column:
    """Intersection over union; 0 for disjoint boxes or an empty union."""
    ix = F.least(ax2, bx2) - F.greatest(ax1, bx1)
    iy = F.least(ay2, by2) - F.greatest(ay1, by1)
    inter = ix.cast("bigint") * iy.cast("bigint")
    union = box_area(ax1, ay1, ax2, ay2) + box_area(bx1, by1, bx2, by2) - inter
    return F.when((ix < 0) | (iy < 0) | (union <= 0), F.lit(0.0)).otherwise(inter / F.nullif(union, F.lit(0)))


def bbox_distance(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) -> Column:
    """Distance between the (floored) centres of two boxes."""
    dx = half(ax1, ax2) - half(bx1, bx2)
    dy = half(ay1, ay2) - half(by1, by2)
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def relative_centre(lo: Column, hi: Column, size: Column) -> Column:
    """Centre of an extent as a share of the image; 0.5 when the size is unknown."""
    return F.when(size > 0, ((lo + hi) / 2) / F.nullif(size, F.lit(0))).otherwise(F.lit(0.5))


def spatial_zone(rel_x: Column, rel_y: Column) -> Column:
    """Cell of the 3x3 grid, as ``<vertical>_<horizontal>``."""
    across = F.when(rel_x < THIRD_LOW, "left").when(rel_x < THIRD_HIGH, "center").otherwise("right")
    down = F.when(rel_y < THIRD_LOW, "top").when(rel_y < THIRD_HIGH, "middle").otherwise("bottom")
    return F.concat_ws("_", down, across)


def size_class(area: Column, image_w: Column, image_h: Column) -> Column:
    ratio = area / F.nullif(image_w.cast("bigint") * image_h.cast("bigint"), F.lit(0))
    chain = None
    for name, cut in SIZE_CUTS:
        chain = F.when(ratio < cut, name) if chain is None else chain.when(ratio < cut, name)
    return chain.otherwise("very_large")


def near_edge(rel_x: Column, rel_y: Column, threshold: float = 0.15) -> Column:
    far = 1 - threshold
    return (rel_x < threshold) | (rel_x > far) | (rel_y < threshold) | (rel_y > far)


def base_padding(damage_type: Column) -> Column:
    """Base padding of a canonical type; unknown types use label 1's."""
    first = next(iter(PADDING))
    by_type = {LABEL_NAMES[k]: v for k, v in PADDING.items()}
    return F.coalesce(lookup(by_type, damage_type), F.lit(PADDING[first]))


def _steps(value: Column, cuts: list[tuple[float, float]], rest: float) -> Column:
    chain = None
    for bound, factor in cuts:
        chain = F.when(value < bound, factor) if chain is None else chain.when(value < bound, factor)
    return chain.otherwise(F.lit(rest))


# Area steps (exclusive upper bound, factor), edge and share factors.
AREA_STEPS = [(500, 1.8), (1500, 1.5), (5000, 1.2), (15000, 1.0), (50000, 0.85)]
AREA_REST = 0.7
EDGE_SHARE, EDGE_FACTOR = 0.1, 0.7
PADDING_RANGE = (0.15, 0.60)
SIMPLE_SMALL, SIMPLE_LARGE = (1000, 1.5), (10000, 0.8)


def padding_factor(
    area: Column,
    damage_type: Column,
    rel_x: Column | None = None,
    rel_y: Column | None = None,
    image_w: Column | None = None,
    image_h: Column | None = None,
    mode: str = "adaptive",
) -> Column:
    """Share of the box added on each side.

    ``adaptive`` multiplies base, area, edge and relative-area factors and clamps
    the product; ``simple`` only scales small and large boxes.
    """
    if mode == "simple":
        by_type = {LABEL_NAMES[k]: v for k, v in PADDING.items()}
        base = F.coalesce(lookup(by_type, damage_type), F.lit(DEFAULT_PADDING))
        scale = (
            F.when(area < SIMPLE_SMALL[0], SIMPLE_SMALL[1])
            .when(area > SIMPLE_LARGE[0], SIMPLE_LARGE[1])
            .otherwise(F.lit(1.0))
        )
        return base * scale
    if mode != "adaptive":
        raise ValueError(f"unknown padding mode: {mode}")
    edge = F.when(near_edge(rel_x, rel_y, EDGE_SHARE), EDGE_FACTOR).otherwise(F.lit(1.0))
    share = area / F.nullif(image_w.cast("bigint") * image_h.cast("bigint"), F.lit(0))
    relative = F.when(share > 0.15, 0.6).when(share > 0.08, 0.8).otherwise(F.lit(1.0))
    raw = base_padding(damage_type) * _steps(area, AREA_STEPS, AREA_REST) * edge * relative
    low, high = PADDING_RANGE
    return F.greatest(F.lit(low), F.least(F.lit(high), raw))


def crop_window(x_min, y_min, x_max, y_max, image_w, image_h, pad_x, pad_y) -> Column:
    """Box grown by the padding in pixels and cut at the image border."""
    return F.struct(
        F.greatest(F.lit(0), x_min - pad_x).cast("bigint").alias("x1"),
        F.greatest(F.lit(0), y_min - pad_y).cast("bigint").alias("y1"),
        F.least(image_w, x_max + pad_x).cast("bigint").alias("x2"),
        F.least(image_h, y_max + pad_y).cast("bigint").alias("y2"),
    )


def letterbox(w: Column, h: Column, target: int = 448) -> Column:
    """Scale, size and offsets that fit a window into a square canvas."""
    scale = F.least(F.lit(float(target)) / w, F.lit(float(target)) / h)
    new_w = F.floor(w * scale).cast("bigint")
    new_h = F.floor(h * scale).cast("bigint")
    return F.struct(
        scale.alias("scale"),
        new_w.alias("new_w"),
        new_h.alias("new_h"),
        F.floor((F.lit(target) - new_w) / 2).cast("bigint").alias("x_offset"),
        F.floor((F.lit(target) - new_h) / 2).cast("bigint").alias("y_offset"),
    )


def region_id(image_stem: Column, kind: str, number: Column, second: Column | None = None) -> Column:
    """``<stem>_<kind>_<number>``; grid cells carry x and y, other kinds pad to three digits."""
    if kind == "grid":
        return F.format_string("%s_grid_%d_%d", image_stem, number, second)
    return F.format_string(f"%s_{kind}_%03d", image_stem, number)
