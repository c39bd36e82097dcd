"""Region planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import regions as R
from ...operators import shapes as S
from ..registry import query, r
from ..sql import near_edge, size_class, zone3

# First seed within 100 px in annotation order, as a recursive statement: in every
# step each image's first unassigned box becomes a seed and takes its neighbours.
_SEEDS = """
    RECURSIVE step AS (
      SELECT image_id, shape_idx, x_min, y_min, x_max, y_max, NULL::bigint AS seed_idx, 0 AS n FROM fx_boxes
      UNION ALL
      SELECT s.image_id, s.shape_idx, s.x_min, s.y_min, s.x_max, s.y_max,
             CASE WHEN (s.x_min + s.x_max - f.sx) ** 2 + (s.y_min + s.y_max - f.sy) ** 2 < 40000 THEN f.seed END, s.n + 1
      FROM step s JOIN (SELECT image_id, n, min(shape_idx) AS seed, arg_min(x_min + x_max, shape_idx) AS sx, arg_min(y_min + y_max, shape_idx) AS sy
                        FROM step WHERE seed_idx IS NULL GROUP BY image_id, n) f ON f.image_id = s.image_id AND f.n = s.n
      WHERE s.seed_idx IS NULL)"""


# Greedy merging as a recursive statement: step n of each (image, group) places its
# n-th box, with the open clusters carried along as a list.
_MERGES = """
    RECURSIVE ranked AS (
      SELECT *, row_number() OVER (PARTITION BY image_id, grp ORDER BY y_min, x_min, shape_idx) AS n FROM (
        SELECT p.*, coalesce(g.compat_group, p.damage_type) AS grp FROM fx_placed p LEFT JOIN dim_groups g USING (damage_type) WHERE area BETWEEN 50 AND 300000)),
    sweep AS (
      SELECT image_id, grp, 0::bigint AS n, NULL::bigint AS seed_idx, NULL::bigint AS shape_idx,
             []::STRUCT(x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT, seed BIGINT)[] AS cs
      FROM (SELECT DISTINCT image_id, grp FROM ranked)
      UNION ALL
      SELECT image_id, grp, n, CASE WHEN fits THEN cs[best].seed ELSE shape_idx END, shape_idx,
             CASE WHEN fits THEN list_transform(cs, lambda c, i: CASE WHEN i = best THEN {'x1': least(c.x1, x_min), 'y1': least(c.y1, y_min),
                    'x2': greatest(c.x2, x_max), 'y2': greatest(c.y2, y_max), 'seed': c.seed} ELSE c END)
                  ELSE list_append(cs, {'x1': x_min, 'y1': y_min, 'x2': x_max, 'y2': y_max, 'seed': shape_idx}) END
      FROM (SELECT *, best IS NOT NULL AND coalesce((greatest(cs[best].x2, x_max) - least(cs[best].x1, x_min)) * (greatest(cs[best].y2, y_max) - least(cs[best].y1, y_min)) <= 176400, false) AS fits
            FROM (SELECT b.image_id, b.grp, b.n, b.shape_idx, b.x_min, b.y_min, b.x_max, b.y_max, s.cs,
                         list_min(list_filter(list_transform(s.cs, lambda c, i: {'d': ((c.x1 + c.x2) // 2 - (b.x_min + b.x_max) // 2) ** 2
                           + ((c.y1 + c.y2) // 2 - (b.y_min + b.y_max) // 2) ** 2, 'i': i}), lambda t: t.d < 10000)).i AS best
                  FROM sweep s JOIN ranked b ON b.image_id = s.image_id AND b.grp = s.grp AND b.n = s.n + 1))),
    members AS (
      SELECT r.*, s.seed_idx, row_number() OVER (PARTITION BY r.image_id, s.seed_idx ORDER BY r.y_min, r.x_min, r.shape_idx) - 1 AS member_pos
      FROM sweep s JOIN ranked r ON r.image_id = s.image_id AND r.shape_idx = s.shape_idx),
    per_type AS (
      SELECT image_id, seed_idx, damage_type, count(*) AS n, min(member_pos) AS first FROM members GROUP BY ALL),
    cluster_rows AS (
      SELECT m.*, t.dominant_type, row_number() OVER (PARTITION BY m.image_id ORDER BY m.seed_y, m.seed_x, m.seed_idx) - 1 AS cluster_idx
      FROM (SELECT image_id, seed_idx, min(x_min) AS x_min, min(y_min) AS y_min, max(x_max) AS x_max, max(y_max) AS y_max, count(*) AS defect_count,
                   arg_min(x_min, member_pos) AS seed_x, arg_min(y_min, member_pos) AS seed_y FROM members GROUP BY image_id, seed_idx) m
      JOIN (SELECT image_id, seed_idx, first(damage_type ORDER BY n DESC, first) AS dominant_type FROM per_type GROUP BY ALL) t USING (image_id, seed_idx)),
    regions AS (
      SELECT *, (x_max - x_min) * (y_max - y_min) AS area, ((x_min + x_max) / 2.0)::double / 3264 AS rel_x, ((y_min + y_max) / 2.0)::double / 2448 AS rel_y,
             3264 AS image_w, 2448 AS image_h FROM cluster_rows)"""


@query("g1_cluster_boxes", f"WITH {_MERGES} SELECT image_id, shape_idx, damage_type, seed_idx, member_pos FROM members")
def _(v):
    return v.clustering[0].select("image_id", "shape_idx", "damage_type", "seed_idx", "member_pos")


@query(
    "g2_compatible_types",
    """SELECT p.damage_type, q.damage_type AS other_type, coalesce(a.compat_group, p.damage_type) AS compat_group, p.n, q.n AS other_n
       FROM (SELECT damage_type, count(*) AS n FROM fx_placed GROUP BY 1) p LEFT JOIN dim_groups a ON a.damage_type = p.damage_type
       JOIN (SELECT damage_type, count(*) AS n FROM fx_placed GROUP BY 1) q ON true LEFT JOIN dim_groups b ON b.damage_type = q.damage_type
       WHERE coalesce(a.compat_group, p.damage_type) = coalesce(b.compat_group, q.damage_type)""",
)
def _(v):
    from ...dims import group_of_type

    counts = S.with_types(v.polygons).groupBy("damage_type").agg(F.count(F.lit(1)).alias("n"))
    grouped = counts.withColumn("compat_group", group_of_type(F.col("damage_type")))
    other = grouped.select("compat_group", F.col("damage_type").alias("other_type"), F.col("n").alias("other_n"))
    return grouped.join(other, "compat_group").select("damage_type", "other_type", "compat_group", "n", "other_n")


@query("g3_cluster_seed", f"WITH {_SEEDS} SELECT image_id, shape_idx, seed_idx FROM step WHERE seed_idx IS NOT NULL")
def _(v):
    return v.seed_members.select("image_id", "shape_idx", "seed_idx")


_MERGED = f"""WITH {_SEEDS}, merged AS (
      SELECT image_id, seed_idx, min(x_min) AS x_min, min(y_min) AS y_min, max(x_max) AS x_max, max(y_max) AS y_max, count(*) AS defect_count
      FROM step WHERE seed_idx IS NOT NULL GROUP BY image_id, seed_idx)"""


@query(
    "g4_merge_boxes",
    f"""{_MERGED} SELECT image_id, seed_idx, x_min, y_min, x_max, y_max, defect_count, (x_max - x_min) * (y_max - y_min) AS cluster_area,
        (x_min + x_max) // 2 AS cx, (y_min + y_max) // 2 AS cy FROM merged""",
)
def _(v):
    return R.merge_boxes(v.seed_members)


def _axis(lo: str, hi: str, limit: str) -> str:
    last = f"greatest(0, least({hi} - 336, {limit} - 336))"
    return (
        f"CASE WHEN {hi} - {lo} <= 336 THEN [greatest(0, least(({lo} + {hi}) // 2 - 168, {limit} - 336))] ELSE list_sort(list_distinct(list_append("
        f"list_filter(list_transform(range(ceil(({hi} - 336 - {lo}) / 268.0)::bigint), lambda i: greatest(0, {lo} + i * 268)), lambda c: c + 336 <= {limit}), {last}))) END"
    )


@query(
    "g5_tile_plan",
    f"""SELECT image_id, tile_x, unnest(ys) AS tile_y, is_tiled FROM (
          SELECT image_id, unnest({_axis('x_min', 'x_max', 'image_w')}) AS tile_x, {_axis('y_min', 'y_max', 'image_h')} AS ys,
                 x_max - x_min > 336 OR y_max - y_min > 336 AS is_tiled
          FROM (SELECT image_id, min(x_min) AS x_min, min(y_min) AS y_min, max(x_max) AS x_max, max(y_max) AS y_max,
                       3264::bigint AS image_w, 2448::bigint AS image_h FROM fx_boxes GROUP BY image_id))""",
)
def _(v):
    # the hull of all boxes of an image is often wider than one tile
    hulls = R.merge_boxes(v.boxes, ["image_id"]).join(v.images.select("image_id", "image_w", "image_h"), "image_id")
    return R.tile_plan(hulls).select("image_id", "tile_x", "tile_y", "is_tiled")


_CELLS = """
    SELECT image_id, x AS grid_x, y AS grid_y, least(x + 336, hx, image_w) AS cell_x2, least(y + 336, hy, image_h) AS cell_y2 FROM (
      SELECT image_id, image_w, image_h, hx, hy, x, unnest(range(ly, hy, 235)) AS y FROM (
        SELECT *, unnest(range(lx, hx, 235)) AS x FROM ({src})))
    WHERE least(x + 336, hx, image_w) - x >= 168 AND least(y + 336, hy, image_h) - y >= 168"""


@query(
    "g6_grid_plan",
    "SELECT image_id, grid_x, grid_y, cell_x2, cell_y2 FROM ("
    + _CELLS.format(src="SELECT *, 0::bigint AS lx, 0::bigint AS ly, image_w AS hx, image_h AS hy FROM fx_clean")
    + ")",
)
def _(v):
    clean = v.images.join(v.shapes.select("image_id").distinct(), "image_id", "left_anti")
    return R.grid_plan(clean).select("image_id", "grid_x", "grid_y", "cell_x2", "cell_y2")


# Polygon area inside a cell: signed sum over the edges of the limited height integral.
_COVER = (
    """
    SELECT image_id, grid_x, grid_y, abs(sum(part)) / ((cell_x2 - grid_x) * (cell_y2 - grid_y))::double AS ratio FROM (
      SELECT *, CASE WHEN qx = px THEN 0 WHEN yb = ya THEN (b - a) * (least(greatest(ya, grid_y), cell_y2) - grid_y)
               ELSE (b - a) / (yb - ya) * ((greatest(yb - grid_y, 0) ** 2 - greatest(yb - cell_y2, 0) ** 2) / 2
                    - (greatest(ya - grid_y, 0) ** 2 - greatest(ya - cell_y2, 0) ** 2) / 2) END AS part
      FROM (SELECT *, py + (qy - py) / nullif(qx - px, 0) * (a - px) AS ya, py + (qy - py) / nullif(qx - px, 0) * (b - px) AS yb
            FROM (SELECT c.*, e.px, e.py, e.qx, e.qy, greatest(c.grid_x, least(c.cell_x2, e.px))::double AS a,
                         greatest(c.grid_x, least(c.cell_x2, e.qx))::double AS b
                  FROM ("""
    + _CELLS.format(
        src="SELECT i.*, list_min(o.px) AS lx, list_min(o.py) AS ly, list_max(o.px) + 1 AS hx, list_max(o.py) + 1 AS hy FROM fx_clean i JOIN fx_outlines o USING (image_id)"
    )
    + """) c JOIN (SELECT image_id, unnest(px)::double AS px, unnest(py)::double AS py, unnest(list_append(px[2:], px[1]))::double AS qx,
                         unnest(list_append(py[2:], py[1]))::double AS qy FROM fx_outlines) e USING (image_id))))
    GROUP BY image_id, grid_x, grid_y, cell_x2, cell_y2"""
)


@query("g7_coverage", f"SELECT image_id, grid_x, grid_y, round(ratio, 6) AS vehicle_ratio FROM ({_COVER}) WHERE ratio >= 0.6")
def _(v):
    clean = v.images.join(v.shapes.select("image_id").distinct(), "image_id", "left_anti").join(v.outlines, "image_id")
    cells = R.coverage_filter(R.grid_plan(clean, outline="outline"), "outline", 0.6)
    return cells.select("image_id", "grid_x", "grid_y", r("vehicle_ratio"))


# Filled area by the even-odd rule: edges cut at all corners and crossings, signs by their order from below.
_CROSSED = (
    """WITH edges AS (SELECT image_id, row_number() OVER () AS k, least(px, qx)::double AS ax, greatest(px, qx)::double AS bx,
        CASE WHEN px < qx THEN py ELSE qy END::double AS ay, (qy - py)::double / (qx - px) AS m
      FROM (SELECT image_id, unnest(px) AS px, unnest(py) AS py, unnest(list_append(px[2:], px[1])) AS qx, unnest(list_append(py[2:], py[1])) AS qy FROM fx_crossing)
      WHERE px <> qx),
    xs AS (SELECT image_id, ax AS x FROM edges UNION SELECT image_id, bx FROM edges
      UNION SELECT image_id, x FROM (SELECT e.image_id, ((f.ay - f.m * f.ax) - (e.ay - e.m * e.ax)) / (e.m - f.m) AS x, greatest(e.ax, f.ax) AS low, least(e.bx, f.bx) AS high
        FROM edges e JOIN edges f ON e.image_id = f.image_id AND e.k < f.k AND e.m <> f.m) WHERE x > low AND x < high),
    slabs AS (SELECT image_id, x AS a, lead(x) OVER (PARTITION BY image_id ORDER BY x) AS b FROM xs),
    pieces AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY image_id, sa ORDER BY ya + yb) % 2 = 0 THEN 1 ELSE -1 END AS sign
      FROM (SELECT e.image_id, s.a AS sa, s.b AS sb, ay + m * (s.a - ax) AS ya, ay + m * (s.b - ax) AS yb FROM edges e JOIN slabs s ON e.image_id = s.image_id AND s.a >= ax AND s.b <= bx)),
    cells AS (SELECT * FROM ("""
    + _CELLS.format(
        src="SELECT i.*, list_min(o.px) AS lx, list_min(o.py) AS ly, list_max(o.px) + 1 AS hx, list_max(o.py) + 1 AS hy FROM fx_clean i JOIN fx_crossing o USING (image_id)"
    )
    + """))
    SELECT image_id, grid_x, grid_y, round(sum(part) / ((cell_x2 - grid_x) * (cell_y2 - grid_y)), 6) AS vehicle_ratio FROM (
      SELECT *, sign * CASE WHEN abs(hb - ha) < 1e-9 THEN (b - a) * greatest(least(ha, high), 0)
        ELSE (b - a) / (hb - ha) * ((greatest(hb, 0) ** 2 - greatest(hb - high, 0) ** 2) / 2 - (greatest(ha, 0) ** 2 - greatest(ha - high, 0) ** 2) / 2) END AS part
      FROM (SELECT *, ya + (yb - ya) / (sb - sa) * (a - sa) - grid_y AS ha, ya + (yb - ya) / (sb - sa) * (b - sa) - grid_y AS hb, cell_y2 - grid_y AS high
        FROM (SELECT c.image_id, c.grid_x, c.grid_y, c.cell_x2, c.cell_y2, p.sa, p.sb, p.ya, p.yb, p.sign,
              greatest(c.grid_x, least(c.cell_x2, p.sa)) AS a, greatest(c.grid_x, least(c.cell_x2, p.sb)) AS b FROM cells c JOIN pieces p USING (image_id))))
    GROUP BY image_id, grid_x, grid_y, cell_x2, cell_y2 HAVING sum(part) / ((cell_x2 - grid_x) * (cell_y2 - grid_y)) >= 0.4"""
)


@query("g7_crossing_outlines", _CROSSED)
def _(v):
    clean = v.images.join(v.shapes.select("image_id").distinct(), "image_id", "left_anti").join(v.crossing_outlines, "image_id")
    cells = R.coverage_filter(R.grid_plan(clean, outline="outline"), "outline", 0.4)
    return cells.select("image_id", "grid_x", "grid_y", r("vehicle_ratio"))


@query(
    "g8_clustered_regions",
    f"""WITH {_MERGES} SELECT r.image_id, replace(i.image_name, '.jpg', '') || '_cluster_' || printf('%03d', cluster_idx) AS crop_id,
              CASE WHEN defect_count > 1 THEN 'multi_defect' ELSE 'single_defect' END AS cluster_type, defect_count, dominant_type,
              greatest(0, x_min - 30) AS crop_x1, greatest(0, y_min - 30) AS crop_y1, least(3264, x_max + 30) AS crop_x2, least(2448, y_max + 30) AS crop_y2,
              area, {zone3('rel_x', 'rel_y')} AS spatial_zone, {size_class('area', 'r.image_w', 'r.image_h')} AS size_class, {near_edge()} AS near_edge
        FROM regions r JOIN fx_images i USING (image_id)""",
)
def _(v):
    out = R.plan_regions(v.images, v.polygons, "clustered")
    return out.select(
        "image_id", "crop_id", "cluster_type", "defect_count", "dominant_type", "crop_x1", "crop_y1", "crop_x2", "crop_y2", "area",
        "spatial_zone", "size_class", "near_edge",
    )


_TILES = f"""{_MERGED}, tiles AS (
      SELECT *, unnest(ys) AS tile_y FROM (
        SELECT *, unnest({_axis('x_min', 'x_max', 'image_w')}) AS tile_x, {_axis('y_min', 'y_max', 'image_h')} AS ys, x_max - x_min > 336 OR y_max - y_min > 336 AS is_tiled
        FROM (SELECT *, 3264::bigint AS image_w, 2448::bigint AS image_h FROM merged))),
    numbered AS (SELECT t.image_id, replace(i.image_name, '.jpg', '') || '_cluster_'
        || printf('%03d', row_number() OVER (PARTITION BY t.image_id ORDER BY seed_idx, tile_y, tile_x) - 1) || '.jpg' AS crop_id,
        i.vehicle_zone, defect_count, is_tiled, tile_x, tile_y FROM tiles t JOIN fx_images i USING (image_id))"""


@query(
    "g8_tiled_regions",
    f"{_TILES} SELECT image_id, crop_id, vehicle_zone, defect_count, is_tiled, tile_x AS crop_x1, tile_y AS crop_y1 FROM numbered",
)
def _(v):
    out = R.plan_regions(v.images, v.boxes, "optimised")
    return out.select("image_id", "crop_id", "vehicle_zone", "defect_count", "is_tiled", "crop_x1", "crop_y1")


@query(
    "g8_grid_regions",
    f"""SELECT image_id, replace(image_name, '.jpg', '') || '_grid_' || grid_x || '_' || grid_y || '.jpg' AS crop_id, round(ratio, 6) AS vehicle_ratio
        FROM ({_COVER}) JOIN fx_images USING (image_id) WHERE ratio >= 0.4""",
)
def _(v):
    clean = v.images.join(v.shapes.select("image_id").distinct(), "image_id", "left_anti")
    return R.plan_regions(clean, v.boxes, "grid", v.outlines).select("image_id", "crop_id", r("vehicle_ratio"))


@query(
    "g8_mixed_regions",
    f"""{_TILES} SELECT image_id, crop_id, true AS has_damage, 'clustered_defects' AS generation_method, tile_x AS crop_x1, tile_y AS crop_y1, tile_x + 336 AS crop_x2, tile_y + 336 AS crop_y2 FROM numbered
        UNION ALL SELECT c.image_id, replace(i.image_name, '.jpg', '') || '_grid_' || grid_x || '_' || grid_y || '.jpg', false, 'grid_masked_polygon', grid_x, grid_y, cell_x2, cell_y2
        FROM ({_COVER.replace('SELECT image_id, grid_x, grid_y, abs', 'SELECT image_id, grid_x, grid_y, cell_x2, cell_y2, abs', 1)}) c JOIN fx_images i USING (image_id) WHERE ratio >= 0.4""",
)
def _(v):
    out = R.plan_regions(v.images, v.boxes, "mixed", v.outlines, annotated=v.shapes)
    return out.select("image_id", "crop_id", "has_damage", "generation_method", "crop_x1", "crop_y1", "crop_x2", "crop_y2")


@query(
    "a11_cluster_stats",
    f"""WITH {_MERGES} SELECT count(*) AS n_clusters, sum(defect_count)::bigint AS n_defects, count(*) FILTER (defect_count = 1) AS n_single,
              count(*) FILTER (defect_count > 1) AS n_multi, max(defect_count) AS max_size, round(count(*) FILTER (defect_count > 1) * 100.0::double / count(*), 6) AS multi_pct,
              round(avg(CASE WHEN defect_count > 1 THEN defect_count END), 6) AS mean_multi_size,
              round((1 - count(*) / sum(defect_count)::double) * 100, 6) AS reduction_pct, round(sum(defect_count) / count(*)::double, 6) AS defects_per_cluster FROM cluster_rows""",
)
def _(v):
    stats = R.cluster_stats(v.clustering[1])
    counts = ["n_clusters", "n_defects", "n_single", "n_multi", "max_size"]
    return stats.select(*counts, *[r(c) for c in stats.columns if c not in counts])


@query(
    "j5_pair_stats",
    """SELECT image_id, n AS n_boxes, n * (n - 1) // 2 AS n_pairs, round(mean, 6) AS mean_pair_distance FROM (
         SELECT image_id, count(*) AS n FROM fx_boxes GROUP BY 1) LEFT JOIN (
         SELECT a.image_id, avg(sqrt((((a.x_min + a.x_max) - (b.x_min + b.x_max)) ** 2 + ((a.y_min + a.y_max) - (b.y_min + b.y_max)) ** 2)::double) / 2) AS mean
         FROM fx_boxes a JOIN fx_boxes b ON a.image_id = b.image_id AND a.shape_idx < b.shape_idx GROUP BY 1) USING (image_id)""",
)
def _(v):
    return S.pair_stats(v.boxes).select("image_id", "n_boxes", "n_pairs", r("mean_pair_distance"))


@query(
    "j6_name_grid",
    """SELECT x.image_id, g.gx, g.gy FROM (SELECT image_id FROM fx_clean) x
       CROSS JOIN (SELECT a.i AS gx, b.i AS gy FROM range(0, 3264, 335) a(i) CROSS JOIN range(0, 2448, 335) b(i)) g""",
)
def _(v):
    clean = v.images.join(v.shapes.select("image_id").distinct(), "image_id", "left_anti")
    steps = lambda limit: F.sequence(F.lit(0), F.col(limit) - 1, F.lit(335))
    return clean.select("image_id", F.explode(steps("image_w")).alias("gx"), "image_h").select(
        "image_id", "gx", F.explode(steps("image_h")).alias("gy")
    )


@query(
    "o3_sorted_boxes",
    """SELECT image_id, shape_idx, row_number() OVER (PARTITION BY image_id ORDER BY y_min, x_min, shape_idx) AS position FROM fx_boxes""",
)
def _(v):
    from ...ranks import bucketed_row_number

    order = [F.col("y_min"), F.col("x_min"), F.col("shape_idx")]
    ranked = bucketed_row_number(v.boxes, ["image_id"], order, F.expr("y_min div 64"), "position")
    return ranked.select("image_id", "shape_idx", "position")


@query(
    "p20_region_record",
    f"""WITH {_MERGES} SELECT r.image_id, replace(i.image_name, '.jpg', '') || '_cluster_' || printf('%03d', r.cluster_idx) AS crop_id, 0::bigint AS part, r.defect_count, r.dominant_type,
              string_agg(m.shape_idx || ':' || m.damage_type || ':' || m.x_min || ',' || m.y_min || ',' || m.x_max || ',' || m.y_max, ' ' ORDER BY m.member_pos) AS included
        FROM regions r JOIN fx_images i USING (image_id) JOIN members m ON m.image_id = r.image_id AND m.seed_idx = r.seed_idx GROUP BY ALL""",
)
def _(v):
    members, rows = v.clustering
    record = R.region_record(R.cluster_regions(v.images, rows), members)
    text = F.transform(
        "included_defects",
        lambda d: F.concat_ws(":", d["defect_idx"].cast("string"), d["damage_type"], F.array_join(d["bbox"].cast("array<string>"), ",")),
    )
    return record.select(
        "image_id", "crop_id", "part", "defect_count", "dominant_type", F.array_join(text, " ").alias("included")
    )
