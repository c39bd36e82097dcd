"""The views once more as SQL text, for checking results with another engine.

``compose`` puts the named parts a statement uses in front of it as CTEs.
"""

from __future__ import annotations

import re

from .. import dims


def _values(name: str, columns: str, rows) -> str:
    lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS {name}({columns})"


def zone3(x: str, y: str) -> str:
    return (
        f"(CASE WHEN {y} < 0.33 THEN 'top' WHEN {y} < 0.67 THEN 'middle' ELSE 'bottom' END || '_' || "
        f"CASE WHEN {x} < 0.33 THEN 'left' WHEN {x} < 0.67 THEN 'center' ELSE 'right' END)"
    )


def size_class(area: str, w: str = "image_w", h: str = "image_h") -> str:
    r = f"({area})::double / ({w} * {h})"
    return (
        f"CASE WHEN {r} < 0.005 THEN 'very_small' WHEN {r} < 0.02 THEN 'small' WHEN {r} < 0.08 THEN 'medium' "
        f"WHEN {r} < 0.15 THEN 'large' ELSE 'very_large' END"
    )


def near_edge(x: str = "rel_x", y: str = "rel_y", t: str = "0.15") -> str:
    return f"({x} < {t} OR {x} > 1 - {t}::double OR {y} < {t} OR {y} > 1 - {t}::double)"


def bench(label: str) -> str:
    """Benchmark label of a label expression (scalar lookup)."""
    cases = " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in dims.TAXONOMY.items())
    return f"(CASE trim(lower({label})) {cases} ELSE 'Unknown' END)"


def l2sq(a: str, b: str) -> str:
    return (
        f"list_sum(list_transform(list_zip({a}, {b}), "
        "lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))"
    )


def norm(v: str) -> str:
    return f"sqrt(list_sum(list_transform({v}, lambda x: x::double * x::double)))"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double))"


def order_key(column: str, seed: int = 42) -> str:
    return f"((({column} % 2147483648) * 2654435761 + {seed}) % 4294967296)"


CTES = {
    "dim_zones": _values("d", "vehicle_zone, zone_name, zone_description, zone_area", [(k, *v) for k, v in dims.ZONES.items()]),
    "dim_labels": _values("d", "label, damage_type", dims.LABEL_NAMES.items()),
    "dim_padding": _values("d", "label, base_padding", dims.PADDING.items()),
    "dim_taxonomy": _values("d", "label, benchmark_label, confidence", [(k, *v) for k, v in dims.TAXONOMY.items()]),
    "dim_groups": _values("d", "compat_group, damage_type", [(g, t) for g, ts in dims.COMPATIBLE_GROUPS.items() for t in ts]),
    "dim_types": _values(
        "d", "damage_type, category, severity_low, severity_high", [(k, v[0], v[2], v[3]) for k, v in dims.TYPE_DETAILS.items()]
    ),
    "dim_aliases": _values("d", "damage_type, alias", [(k, a) for k, v in dims.TYPE_DETAILS.items() for a in [*v[1], k]]),
    "dim_friendly": _values("d", "damage_type, friendly", dims.FRIENDLY.items()),
    "dim_parts": _values("d", "zone_name, third, part", [(*k, v) for k, v in dims.PARTS.items()]),
    "dim_display": _values("d", "spatial_zone, shown", dims.SPATIAL_DISPLAY.items()),
    "dim_benchmark": _values("d", "benchmark_label", [(b,) for b in dims.BENCHMARK_LABELS]),
    "fx_images": """
        SELECT o_orderkey AS image_id,
               'zona1_' || CASE WHEN o_orderstatus = 'F' THEN 'ko' ELSE 'ok' END || '_2_3_' || o_orderkey || '_zona_'
                 || (o_custkey % 10 + 1) || '_imageDANO_original.jpg' AS image_name,
               3264::bigint AS image_w, 2448::bigint AS image_h,
               (o_custkey % 10 + 1)::varchar AS vehicle_zone
        FROM orders""",
    "fx_shapes": """
        SELECT l_orderkey AS image_id,
               ((l_linenumber::bigint * 10000000 + l_partkey) * 1000000 + l_suppkey) * 100 + l_quantity::bigint AS shape_idx,
               ((l_suppkey + l_partkey) % 9 + 1)::varchar AS label,
               CASE WHEN l_tax > 0.075 THEN 'rectangle' ELSE 'polygon' END AS shape_type,
               l_partkey * 37 % 400 + l_suppkey * 11 % 400 + 1200 AS x_min,
               l_partkey * 53 % 400 + l_suppkey * 29 % 400 + 900 AS y_min,
               l_partkey * 37 % 400 + l_suppkey * 11 % 400 + 1200 + l_partkey * 3 % 220 + 4 AS x_max,
               l_partkey * 53 % 400 + l_suppkey * 29 % 400 + 900 + (l_suppkey * 7 + l_partkey) % 180 + 4 AS y_max,
               3264::bigint AS image_w, 2448::bigint AS image_h
        FROM lineitem""",
    "fx_polygons": "SELECT * FROM fx_shapes WHERE shape_type = 'polygon'",
    "fx_boxes": "SELECT * FROM fx_polygons WHERE label <> '9'",
    "fx_placed": f"""
        SELECT *, {zone3('rel_x', 'rel_y')} AS spatial_zone, {size_class('area')} AS size_class, {near_edge()} AS near_edge
        FROM (SELECT p.*, coalesce(l.damage_type, 'unknown') AS damage_type,
                     (x_max - x_min) * (y_max - y_min) AS area,
                     ((x_min + x_max) / 2.0)::double / image_w AS rel_x, ((y_min + y_max) / 2.0)::double / image_h AS rel_y
              FROM fx_polygons p LEFT JOIN dim_labels l USING (label))""",
    "fx_placed_boxes": "SELECT * FROM fx_placed WHERE label <> '9'",
    "fx_per_image": "SELECT image_id, count(*) AS n_defects FROM fx_boxes GROUP BY image_id",
    "fx_per_polygon_image": "SELECT image_id, count(*) AS n_defects FROM fx_polygons GROUP BY image_id",
    "fx_type_counts": """
        SELECT image_id, damage_type, count(*) AS n, min(shape_idx) AS first FROM fx_placed_boxes GROUP BY image_id, damage_type""",
    "fx_zone_counts": """
        SELECT image_id, spatial_zone, count(*) AS n, min(shape_idx) AS first FROM fx_placed_boxes GROUP BY image_id, spatial_zone""",
    "fx_texts": """
        SELECT image_id,
               string_agg(n || ' ' || damage_type || CASE WHEN n > 1 THEN 's' ELSE '' END, ' and ' ORDER BY n DESC, first) AS and_text,
               string_agg(n || ' ' || damage_type || CASE WHEN n > 1 THEN 's' ELSE '' END, ', ' ORDER BY n DESC, first) AS comma_text,
               string_agg(n || ' ' || replace(damage_type, '_', ' ') || CASE WHEN n > 1 THEN 's' ELSE '' END, ', ' ORDER BY n DESC, first) AS spaced_text,
               string_agg(n || ' ' || damage_type || CASE WHEN n > 1 THEN 's' ELSE '' END, ' and ' ORDER BY first) AS first_text,
               string_agg(damage_type, ', ' ORDER BY first) AS first_names,
               first(damage_type ORDER BY n DESC, first) AS dominant_type
        FROM fx_type_counts GROUP BY image_id""",
    "fx_spatial_texts": """
        SELECT image_id, string_agg(n || ' defect' || CASE WHEN n > 1 THEN 's' ELSE '' END || ' in '
                 || upper(split_part(spatial_zone, '_', 1)[1]) || split_part(spatial_zone, '_', 1)[2:] || ' '
                 || upper(split_part(spatial_zone, '_', 2)[1]) || split_part(spatial_zone, '_', 2)[2:], ', ' ORDER BY n DESC, first) AS spatial_text
        FROM fx_zone_counts GROUP BY image_id""",
    "fx_records": """
        SELECT i.image_id, i.image_name, i.image_w, i.image_h, t.image_id IS NOT NULL AS has_damage, i.vehicle_zone,
               z.zone_description, z.zone_area, coalesce(b.total_defects, 0) AS total_defects,
               coalesce(b.total_bbox_area, 0)::bigint AS total_bbox_area,
               coalesce(b.total_bbox_area / b.total_defects::double, 0.0) AS avg_defect_size,
               coalesce(b.max_defect_size, 0) AS max_defect_size, coalesce(b.min_defect_size, 0) AS min_defect_size,
               coalesce(t.dominant_type, 'unknown') AS dominant_type,
               CASE WHEN t.image_id IS NULL THEN 'No visible damage on ' || z.zone_description ELSE t.and_text || ' on ' || z.zone_description END
                 || ' (' || z.zone_area || ' area)' AS description
        FROM fx_images i JOIN dim_zones z USING (vehicle_zone) LEFT JOIN fx_texts t USING (image_id)
        LEFT JOIN (SELECT image_id, count(*) AS total_defects, sum(area) AS total_bbox_area, max(area) AS max_defect_size,
                          min(area) AS min_defect_size FROM fx_placed_boxes GROUP BY image_id) b USING (image_id)""",
    "fx_documents": """
        SELECT replace(i.image_name, '_imageDANO_original.jpg', '') || CASE WHEN s.image_id IS NOT NULL THEN '_labelDANO_modificado.json'
                 ELSE '_imageDANO_original.json' END AS file_name,
               replace(i.image_name, '_imageDANO_original.jpg', '') AS base, s.image_id IS NOT NULL AS is_damage
        FROM fx_images i JOIN orders o ON o.o_orderkey = i.image_id
        LEFT JOIN (SELECT DISTINCT image_id FROM fx_shapes) s USING (image_id)
        WHERE s.image_id IS NOT NULL OR NOT starts_with(o.o_orderpriority, '1')""",
    "fx_vectors": """
        SELECT v.vec_id AS id, v.embedding, v.label, (v.vec_id % 10 + 1)::varchar AS vehicle_zone, z.zone_description, z.zone_area,
               CASE WHEN label <= 7 THEN (label + 1)::varchar WHEN label = 8 THEN 'unknown' ELSE 'no_damage' END AS label_raw,
               CASE vec_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS density,
               label <> 9 AS has_damage, (label * 2 + 1)::bigint AS total_defects
        FROM embeddings v JOIN dim_zones z ON z.vehicle_zone = (v.vec_id % 10 + 1)::varchar""",
    "fx_pairs": f"""
        SELECT q.id AS query_id, c.id, c.density, {l2sq('q.embedding', 'c.embedding')} AS distance
        FROM fx_vectors q CROSS JOIN fx_vectors c""",
    "fx_top5": """
        SELECT query_id, id, distance, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM fx_pairs WHERE query_id <> id)
        WHERE rank <= 5""",
    "fx_results": """
        SELECT 'visual_' || r.density AS config, r.query_id, r.id, r.distance, r.rank, v.label_raw AS retrieved_type FROM (
          SELECT *, row_number() OVER (PARTITION BY density, query_id ORDER BY distance, id) AS rank FROM fx_pairs WHERE query_id <> id) r
        JOIN fx_vectors v ON v.id = r.id WHERE r.rank <= 5""",
    "fx_truth": """
        SELECT 'visual_' || d.density AS config, v.id AS query_id, nullif(CASE WHEN label_raw = 'unknown' THEN '' ELSE label_raw END, '') AS expected_type
        FROM fx_vectors v CROSS JOIN (VALUES ('high'), ('medium'), ('low')) d(density)""",
    "fx_judged": f"""
        SELECT t.config, t.query_id, t.expected_type, r.rank, r.id, r.distance, r.retrieved_type,
               coalesce({bench('r.retrieved_type')} = {bench('t.expected_type')} AND t.expected_type IS NOT NULL AND r.retrieved_type IS NOT NULL, false) AS is_match
        FROM fx_truth t LEFT JOIN fx_results r ON r.config = t.config AND r.query_id = t.query_id""",
    "fx_run_log": """
        SELECT 'visual_' || d.density AS config, e.event_id % (SELECT count(*) FROM embeddings) AS query_id,
               e.value / length('visual_' || d.density) AS retrieval_time_ms, e.value * 3 AS generation_time_ms
        FROM events e CROSS JOIN (VALUES ('high'), ('medium'), ('low')) d(density)""",
    "fx_results10": """
        SELECT 'visual_' || r.density AS config, r.query_id, r.id, r.distance, r.rank, v.label_raw AS retrieved_type FROM (
          SELECT *, row_number() OVER (PARTITION BY density, query_id ORDER BY distance, id) AS rank FROM fx_pairs WHERE query_id <> id) r
        JOIN fx_vectors v ON v.id = r.id WHERE r.rank <= 10""",
    "fx_judged10": f"""
        SELECT t.config, t.query_id, t.expected_type, r.rank,
               coalesce({bench('r.retrieved_type')} = {bench('t.expected_type')} AND t.expected_type IS NOT NULL AND r.retrieved_type IS NOT NULL, false) AS is_match
        FROM fx_truth t LEFT JOIN fx_results10 r ON r.config = t.config AND r.query_id = t.query_id""",
    "fx_text_metrics": f"""
        SELECT density, avg(CASE WHEN expected_type IS NOT NULL THEN (hits > 0)::int END) AS recall_at_5,
               avg(CASE WHEN expected_type IS NOT NULL THEN coalesce(1.0::double / first_hit, 0) END) AS mrr FROM (
          SELECT density, query_id, expected_type, count(*) FILTER (is_match) AS hits, min(CASE WHEN is_match THEN rank END) AS first_hit FROM (
            SELECT p.density, p.query_id, p.rank, nullif(CASE WHEN q.label_raw = 'unknown' THEN '' ELSE q.label_raw END, '') AS expected_type,
                   coalesce({bench('c.label_raw')} = {bench('q.label_raw')} AND q.label_raw <> 'unknown', false) AS is_match
            FROM (SELECT *, row_number() OVER (PARTITION BY density, query_id ORDER BY distance, id) AS rank FROM (
                    SELECT q.id AS query_id, c.id, c.density, {l2sq('q.embedding[33:64]', 'c.embedding[33:64]')} AS distance
                    FROM fx_vectors q JOIN fx_vectors c ON q.id <> c.id)) p
            JOIN fx_vectors q ON q.id = p.query_id JOIN fx_vectors c ON c.id = p.id WHERE p.rank <= 5)
          GROUP BY ALL) GROUP BY density""",
    "fx_centers": """
        SELECT label AS cell, list(m ORDER BY d) AS center FROM (
          SELECT label, d, avg(x) AS m FROM (SELECT label, unnest(embedding)::double AS x, unnest(range(1, 65)) AS d FROM embeddings) GROUP BY label, d)
        GROUP BY label""",
    "fx_cells": f"""
        SELECT v.id, c.cell, row_number() OVER (PARTITION BY v.id ORDER BY {l2sq('v.embedding', 'c.center')}, c.cell) AS near
        FROM fx_vectors v CROSS JOIN fx_centers c""",
    "fx_leaked": """
        SELECT id, embedding FROM fx_vectors WHERE density = 'high' UNION ALL
        SELECT id + 1000000, embedding FROM fx_vectors WHERE density <> 'high' AND id % 7 = 0""",
    "fx_per_query": """
        SELECT config, query_id, expected_type, count(*) FILTER (is_match AND rank <= 1) AS hits_1,
               count(*) FILTER (is_match AND rank <= 3) AS hits_3, count(*) FILTER (is_match AND rank <= 5) AS hits_5,
               min(CASE WHEN is_match THEN rank END) AS first_hit
        FROM fx_judged GROUP BY config, query_id, expected_type""",
    "fx_metrics": """
        SELECT * FROM (SELECT config,
               avg(CASE WHEN expected_type IS NOT NULL THEN (hits_1 > 0)::int END) AS recall_at_1,
               avg(CASE WHEN expected_type IS NOT NULL THEN (hits_3 > 0)::int END) AS recall_at_3,
               avg(CASE WHEN expected_type IS NOT NULL THEN (hits_5 > 0)::int END) AS recall_at_5,
               avg(CASE WHEN expected_type IS NOT NULL THEN hits_1::double END) AS precision_at_1,
               avg(CASE WHEN expected_type IS NOT NULL THEN hits_3 / 3.0::double END) AS precision_at_3,
               avg(CASE WHEN expected_type IS NOT NULL THEN hits_5 / 5.0::double END) AS precision_at_5,
               avg(CASE WHEN expected_type IS NOT NULL THEN coalesce(1.0::double / first_hit, 0) END) AS mrr,
               count(*) AS num_queries
        FROM fx_per_query GROUP BY config)
        JOIN (SELECT config, avg(retrieval_time_ms) AS avg_retrieval_time_ms, avg(generation_time_ms) AS avg_generation_time_ms,
                     avg(retrieval_time_ms) + avg(generation_time_ms) AS avg_total_time_ms FROM fx_run_log GROUP BY config) USING (config)""",
    "fx_seen": f"""
        SELECT r.*, {bench('r.retrieved_type')} AS damage_type, v.vehicle_zone, v.zone_description, v.zone_area, v.total_defects, v.has_damage
        FROM fx_top5x r JOIN fx_vectors v USING (id)""",
    "fx_top5x": """
        SELECT t.*, v.label_raw AS retrieved_type FROM fx_top5 t JOIN fx_vectors v USING (id)""",
    "fx_outlines": """
        SELECT o_orderkey AS image_id, [(200 + o_orderkey % 500), (900 + o_orderkey % 500), (2000 + o_orderkey % 500),
                 (2700 + o_orderkey % 500), (2600 + o_orderkey % 500), (300 + o_orderkey % 500)] AS px,
               [700 + o_custkey % 300, 300 + o_custkey % 300, 350 + o_custkey % 300, 900 + o_custkey % 300, 1900 + o_custkey % 300, 1800 + o_custkey % 300] AS py
        FROM orders""",
    "fx_crossing": "SELECT image_id, [px[i] FOR i IN [1, 4, 2, 5, 3, 6]] AS px, [py[i] FOR i IN [1, 4, 2, 5, 3, 6]] AS py FROM fx_outlines",
    "fx_clean": "SELECT i.* FROM fx_images i WHERE i.image_id NOT IN (SELECT image_id FROM fx_shapes)",
}


def compose(sql: str) -> str:
    """Statement with all the CTEs it needs, in dependency order."""
    done: dict[str, str] = {}

    def need(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b(?:fx|dim)_\w+\b", text)):
            if name in CTES and name not in done:
                need(CTES[name])
                done[name] = CTES[name]

    need(sql)
    if not done:
        return sql
    heavy = {"fx_pairs", "fx_cells", "fx_results", "fx_judged", "fx_metrics"}
    parts = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in heavy else ''}({t})" for n, t in done.items())
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if own:  # the statement has CTEs of its own: one list for all
        return f"WITH {own.group(1) or ''}{parts},\n{sql[own.end():]}"
    return f"WITH {parts}\n{sql}"
