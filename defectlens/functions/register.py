"""SQL names for the column functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..dims import LABEL_NAMES, TAXONOMY, THIRD_HIGH, THIRD_LOW


def _sql_map(values: dict) -> str:
    items = ", ".join(f"'{k}', " + (f"'{v}'" if isinstance(v, str) else f"{v}D") for k, v in values.items())
    return f"map({items})"


def register(spark: SparkSession) -> list[str]:
    """Create temporary SQL functions; they are inlined by Catalyst, not Python UDFs."""
    label_map = _sql_map({k: v[0] for k, v in TAXONOMY.items()})
    name_map = _sql_map(LABEL_NAMES)
    cleaned = r"regexp_replace(lower(label), '^\\s+|\\s+$', '')"
    dbl = "array<double>"
    bodies = {
        "l2sq(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE": (
            f"aggregate(zip_with(cast(a AS {dbl}), cast(b AS {dbl}), (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"
        ),
        "cosine(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE": (
            f"aggregate(zip_with(cast(a AS {dbl}), cast(b AS {dbl}), (x, y) -> x * y), 0D, (s, x) -> s + x)"
            f" / nullif(sqrt(aggregate(cast(a AS {dbl}), 0D, (s, x) -> s + x * x))"
            f" * sqrt(aggregate(cast(b AS {dbl}), 0D, (s, x) -> s + x * x)), 0D)"
        ),
        "canonical_label(label STRING) RETURNS STRING": f"coalesce(try_element_at({name_map}, label), 'unknown')",
        "normalize_label(label STRING) RETURNS STRING": f"coalesce(try_element_at({label_map}, {cleaned}), 'Unknown')",
        "spatial_zone(rel_x DOUBLE, rel_y DOUBLE) RETURNS STRING": (
            f"concat_ws('_', CASE WHEN rel_y < {THIRD_LOW}D THEN 'top' WHEN rel_y < {THIRD_HIGH}D THEN 'middle' ELSE 'bottom' END,"
            f" CASE WHEN rel_x < {THIRD_LOW}D THEN 'left' WHEN rel_x < {THIRD_HIGH}D THEN 'center' ELSE 'right' END)"
        ),
        "bbox_iou(ax1 BIGINT, ay1 BIGINT, ax2 BIGINT, ay2 BIGINT, bx1 BIGINT, by1 BIGINT, bx2 BIGINT, by2 BIGINT)"
        " RETURNS DOUBLE": (
            "CASE WHEN least(ax2, bx2) < greatest(ax1, bx1) OR least(ay2, by2) < greatest(ay1, by1) THEN 0D ELSE "
            "coalesce((least(ax2, bx2) - greatest(ax1, bx1)) * (least(ay2, by2) - greatest(ay1, by1)) / nullif("
            "(ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1)"
            " - (least(ax2, bx2) - greatest(ax1, bx1)) * (least(ay2, by2) - greatest(ay1, by1)), 0), 0D) END"
        ),
    }
    for head, body in bodies.items():
        name_args, returns = head.split(" RETURNS ")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name_args} RETURNS {returns} RETURN {body}")
    return [h.split("(")[0] for h in bodies]
