"""Region planning: clusters, tiles, grid cells and their records.

Boxes carry ``image_id, shape_idx, x_min, y_min, x_max, y_max``, plus
``damage_type`` for :func:`cluster_boxes`.

Both clusterings depend on the order of the boxes, so they run as a sweep over
rows that Spark has already shuffled and sorted. A sweep keeps only the
clusters still within reach; it never holds a whole image. Images are cut into parts
that cannot influence each other, and parts are swept by different tasks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..arrow import arrow_schema
from ..dims import ALL_TYPES, group_of_type
from ..functions import geometry as G
from ..functions import labels as L
from ..ranks import bucketed_row_number, stored
from .rollup import dominant_of, fixed_counts
from .shapes import CORNERS, filter_area, filter_area_adaptive, with_position, with_types

MERGE_DISTANCE = 100
MAX_CLUSTER_AREA = 420 * 420
#: Side of the squares by whose first corners boxes are taken together when an image is cut into parts.
PART_CELL = 128
#: An image of more boxes is crowded: it is cut into parts and numbered by height.
CROWD = 4096
#: Blocks of the seed search have so many squares a side (about 2 250 pixels at 100 pixels of reach).
SEED_BLOCK = 32


# -- clusters by nearest centre ----------------------------------------------


def cluster_boxes(boxes: DataFrame, dist: int = MERGE_DISTANCE, max_area: int = MAX_CLUSTER_AREA) -> DataFrame:
    """Greedy merging of compatible boxes, top to bottom and left to right.

    A box tries the cluster with the nearest centre among those of a compatible
    type closer than ``dist``; it opens a cluster of its own when there is none
    or when the merged box would exceed ``max_area``. Adds ``seed_idx, seed_x,
    seed_y`` (the box that opened the cluster) and ``member_pos``.

    Clusters never mix compatibility groups nor reach over a gap of ``dist``, so every part of
    a crowded image and group is a sweep of its own, and parts are dealt to tasks. Other images
    are swept as they are, one group after the other. Boxes without an image, type or first corner are left out.
    """
    calm, crowded = _by_crowd(boxes)
    return _swept(calm, False, dist, max_area).unionByName(_swept(crowded, True, dist, max_area))


def _by_crowd(boxes: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(boxes of images of at most ``most`` boxes, boxes of the crowded images)."""
    counts = boxes.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    # one row for more than ``most`` boxes
    busy = F.broadcast(counts.filter(F.col("_n") > (CROWD if most is None else most)).select("image_id"))
    return boxes.join(busy, "image_id", "left_anti"), boxes.join(busy, "image_id", "left_semi")


def _swept(boxes: DataFrame, in_parts: bool, dist: int, max_area: int) -> DataFrame:
    """``boxes`` with their clusters; ``in_parts`` cuts each image and group into parts before."""
    grouped = boxes.withColumn("_group", group_of_type(F.col("damage_type")))
    keys = ["image_id", "_group", "_part"]
    known = F.col("image_id").isNotNull() & F.col("_group").isNotNull() & F.col("x_min").isNotNull() & F.col("y_min").isNotNull()
    parts = connected_parts(grouped, dist) if in_parts else grouped.filter(known).withColumn("_part", F.lit(0))
    parts = parts.select("image_id", *[c for c in grouped.columns if c != "image_id"], "_part")
    # by a hash of the image: a partitioning by the image itself is left out after a join by image, and where that join becomes
    # a broadcast join at run time an image would be swept in pieces
    dealt = parts.repartition(*keys) if in_parts else parts.repartition(F.xxhash64("image_id"))
    ordered = dealt.sortWithinPartitions(*keys, "y_min", "x_min", "shape_idx")
    types = dict(boxes.dtypes)
    extra = f", seed_idx {types['shape_idx']}, seed_x bigint, seed_y bigint, member_pos bigint"
    schema = ", ".join(f"`{c}` {t}" for c, t in ordered.dtypes) + extra

    arrow = arrow_schema(schema, boxes.sparkSession)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _nearest_centre_sweep(batches, keys, dist, max_area, arrow)

    return ordered.mapInArrow(sweep, schema).drop("_group", "_part")


def connected_parts(grouped: DataFrame, dist: int) -> DataFrame:
    """Boxes with ``_part``, so that no cluster of one part of an (image, group) can reach another part.

    The hull of a part holds the hulls and centres of all its clusters, so parts whose
    hulls are ``dist`` or more apart never meet. Boxes are first taken together by square
    (each a partial aggregate, so a crowded image shuffles no more rows than it has squares); then the hulls of
    squares are joined while any two are too near.
    """
    cells = {"_cx": F.floor(F.col("x_min") / PART_CELL), "_cy": F.floor(F.col("y_min") / PART_CELL)}
    placed = grouped.withColumns(cells)
    keys = ["image_id", "_group", "_cx", "_cy"]
    hulls = placed.groupBy(*keys).agg(
        *[(F.min if c.endswith("min") else F.max)(c).cast("bigint").alias(c) for c in CORNERS]
    )
    types = dict(hulls.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + ", _part int"
    arrow = arrow_schema(schema, grouped.sparkSession)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["image_id", "_group"]):
            ends = _ends(table, ["image_id", "_group"])
            boxes = np.column_stack([table[c].to_numpy() for c in CORNERS])
            part = np.concatenate([_joined_hulls(boxes[i:j], dist) for i, j in zip([0, *ends[:-1]], ends)])
            columns = [table[c].combine_chunks().cast(arrow.field(c).type) for c in keys]
            yield from pa.table([*columns, pa.array(part, pa.int32())], schema=arrow).to_batches()

    sorted_hulls = hulls.repartition("image_id", "_group").sortWithinPartitions("image_id", "_group")
    return placed.join(sorted_hulls.mapInArrow(number, schema), keys).drop("_cx", "_cy")


def _ends(table: pa.Table, keys: list[str]) -> list[int]:
    """End of every run of rows with equal keys."""
    if not table.num_rows:
        return []
    codes = np.zeros(table.num_rows, np.int64)
    for k in keys:
        own = pc.dictionary_encode(table[k].combine_chunks(), null_encoding="encode").indices.to_numpy()
        codes = codes * (int(own.max()) + 1) + own
    return [*(np.flatnonzero(np.diff(codes)) + 1).tolist(), table.num_rows]


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by the keys; the last group waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        ends = _ends(table, keys)
        if len(ends) > 1:
            yield table.slice(0, ends[-2])
            table = table.slice(ends[-2])
        held = table.combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _joined_hulls(hulls: np.ndarray, dist: int) -> np.ndarray:
    """Number of the part of each hull: parts are joined while their hulls are less than ``dist`` apart."""
    part = np.arange(len(hulls))
    own = hulls.copy()
    open_ = list(range(len(hulls)))
    alive = np.ones(len(hulls), bool)
    while open_:
        i = open_.pop()
        if not alive[i]:
            continue
        x1, y1, x2, y2 = own[i]
        gap_x = np.maximum(np.maximum(own[:, 0] - x2, x1 - own[:, 2]), 0)
        gap_y = np.maximum(np.maximum(own[:, 1] - y2, y1 - own[:, 3]), 0)
        near = alive & (gap_x * gap_x + gap_y * gap_y < dist * dist)
        near[i] = False
        others = np.flatnonzero(near)
        if len(others):
            own[i, :2] = np.minimum(own[i, :2], own[others, :2].min(0))
            own[i, 2:] = np.maximum(own[i, 2:], own[others, 2:].max(0))
            alive[others] = False
            part[np.isin(part, others)] = i
            open_.append(i)
    return part


# An open cluster is a list: x1, y1, x2, y2, order, seed index, seed x, seed y, members.


@lru_cache
def _rings(reach: int) -> list[list[tuple]]:
    """Cell offsets by their distance from the middle cell."""
    square = range(-reach, reach + 1)
    return [[(r, c) for r in square for c in square if max(abs(r), abs(c)) == n] for n in range(reach + 1)]


class _OpenClusters:
    """Open clusters of one sweep that a later box can still reach.

    A short list is scanned as it is. Beyond ``FEW`` clusters they are kept by
    grid cell and exact centre: cells are searched outward from the box, so a
    crowded image costs a few cells per box, and grid lines above the sweep are
    dropped.
    """

    FEW = 24
    CELL = 20

    def __init__(self, dist: int):
        self.dist = dist
        self.few: list | None = []
        self.rows: dict[int, dict[int, dict[tuple, list]]] = {}
        self.rings = _rings(-(-dist // self.CELL))

    def drop_above(self, y: int) -> None:
        if self.few is None:
            for row in [r for r in self.rows if (r + 1) * self.CELL <= y]:
                del self.rows[row]

    def add(self, cluster: list) -> None:
        if self.few is not None:
            self.few.append(cluster)
            if len(self.few) > self.FEW:
                clusters, self.few = self.few, None
                for c in clusters:
                    self._place(c)
        else:
            self._place(cluster)

    def grow(self, cluster: list, hull: tuple) -> None:
        if self.few is None:
            self._remove(cluster)
        cluster[:4] = hull
        if self.few is None:
            self._place(cluster)

    def _place(self, cluster: list) -> None:
        cx, cy = centre = ((cluster[0] + cluster[2]) // 2, (cluster[1] + cluster[3]) // 2)
        cell = self.rows.setdefault(cy // self.CELL, {}).setdefault(cx // self.CELL, {})
        queue = cell.setdefault(centre, deque())
        if queue and queue[-1][4] > cluster[4]:
            queue = cell[centre] = deque(sorted([*queue, cluster], key=lambda c: c[4]))
        else:
            queue.append(cluster)

    def _remove(self, cluster: list) -> None:
        # only the first cluster of a centre is ever found, so only it grows
        cx, cy = centre = ((cluster[0] + cluster[2]) // 2, (cluster[1] + cluster[3]) // 2)
        cell = self.rows[cy // self.CELL][cx // self.CELL]
        cell[centre].popleft()
        if not cell[centre]:
            del cell[centre]

    def nearest(self, cx: int, cy: int) -> list | None:
        """Cluster with the nearest centre in reach; the older one on ties."""
        best, best_d2 = None, self.dist * self.dist
        if self.few is not None:  # in order of opening, so the first minimum is the oldest
            for c in self.few:
                d2 = ((c[0] + c[2]) // 2 - cx) ** 2 + ((c[1] + c[3]) // 2 - cy) ** 2
                if d2 < best_d2:
                    best, best_d2 = c, d2
            return best
        row, col = cy // self.CELL, cx // self.CELL
        for n, ring in enumerate(self.rings):
            if best is not None and n and best_d2 < ((n - 1) * self.CELL + 1) ** 2:
                break  # every centre of this ring is farther away
            for r, c in ring:
                cells = self.rows.get(row + r)
                if not cells:
                    continue
                for centre, queue in cells.get(col + c, {}).items():
                    d2 = (centre[0] - cx) ** 2 + (centre[1] - cy) ** 2
                    if d2 < best_d2 or (d2 == best_d2 and best is not None and queue[0][4] < best[4]):
                        best, best_d2 = queue[0], d2
        return best


def _lists(batch: pa.RecordBatch, names: list[str]) -> list[list]:
    return [batch[n].to_pylist() for n in names]


def _with_columns(batch: pa.RecordBatch, columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    """Batch with new columns behind the untouched ones."""
    extra = [pa.array(c, type=f.type) for c, f in zip(columns, list(schema)[batch.num_columns :])]
    given = [a.cast(f.type) for a, f in zip(batch.columns, schema)]
    return pa.RecordBatch.from_arrays([*given, *extra], schema=schema)


def _nearest_centre_sweep(batches, keys: list[str], dist: int, max_area: int, schema: pa.Schema):
    current, opened, order = None, None, 0
    for batch in batches:
        seeds, xs, ys, members = [], [], [], []
        rows = zip(zip(*_lists(batch, keys)), *_lists(batch, ["shape_idx", *CORNERS]))
        for key, idx, x1, y1, x2, y2 in rows:
            if key != current:
                current, opened, order = key, _OpenClusters(dist), 0
            opened.drop_above(y1 - dist)
            cluster = opened.nearest((x1 + x2) // 2, (y1 + y2) // 2)
            if cluster is not None:
                hull = (min(cluster[0], x1), min(cluster[1], y1), max(cluster[2], x2), max(cluster[3], y2))
                if (hull[2] - hull[0]) * (hull[3] - hull[1]) > max_area:
                    cluster = None
                else:
                    cluster[8] += 1
                    if hull != tuple(cluster[:4]):
                        opened.grow(cluster, hull)
            if cluster is None:
                cluster = [x1, y1, x2, y2, order, idx, x1, y1, 1]
                order += 1
                opened.add(cluster)
            seeds.append(cluster[5])
            xs.append(cluster[6])
            ys.append(cluster[7])
            members.append(cluster[8] - 1)
        yield _with_columns(batch, [seeds, xs, ys, members], schema)


# -- clusters around a seed ----------------------------------------------------


def cluster_seed(boxes: DataFrame, dist: int = MERGE_DISTANCE, block_cells: int = SEED_BLOCK) -> DataFrame:
    """Each box joins the earliest seed closer than ``dist``, else becomes one.

    Boxes with one centre share their fate, so distinct centres are settled
    (:func:`seed_centres`), each with its first ``shape_idx``, and all boxes get the seed of their
    centre by a join on image and centre. Adds ``seed_idx``; boxes with equal
    keys all stay, boxes without an image or a corner have no seed and are left out.
    """
    spots = boxes.withColumns(
        {"_sx": (F.col("x_min") + F.col("x_max")).cast("bigint"), "_sy": (F.col("y_min") + F.col("y_max")).cast("bigint")}
    )
    firsts = spots.filter("image_id is not null and _sx is not null and _sy is not null").groupBy("image_id", "_sx", "_sy")
    settled, _ = seed_centres(firsts.agg(F.min("shape_idx").alias("shape_idx")), dist, block_cells)
    return spots.join(settled.drop("shape_idx"), ["image_id", "_sx", "_sy"]).select(*boxes.columns, "seed_idx")


#: What is known of a centre: nothing yet, a seed, no seed but its own seed not known yet, its seed known.
_OPEN, _SEED, _COVERED, _DONE = range(4)


def seed_centres(centres: DataFrame, dist: int = MERGE_DISTANCE, block_cells: int = SEED_BLOCK) -> tuple[DataFrame, int]:
    """(``image_id, _sx, _sy, shape_idx, seed_idx``, number of rounds) of distinct doubled centres.

    The seeds are the first maximal independent set in order of ``shape_idx``: a centre is a seed
    when every earlier one in reach is settled as no seed. Images are cut into
    blocks; a round settles in every block, in order, what depends on nothing open
    beyond its border, and hands seeds and open centres near a border on to the next block. An
    image of one block takes one round, a larger one as many as chains of
    dependent centres cross borders. The earliest open centre is settled in every round, so
    it ends. Each round is a table in the shared folder.
    """
    side = max(1, isqrt(2 * dist * dist))  # all points of such a square are in reach of each other, so it holds one seed at most
    reach = -(-2 * dist // side)
    block_cells = max(block_cells, reach)
    blocks = ["image_id", "_bx", "_by"]
    edge = lambda c, by: F.floor((F.floor(F.col(c) / side) + by) / block_cells)
    every = lambda c: F.explode(F.sequence(edge(c, -reach), edge(c, reach)))
    own = (F.col("_bx") == edge("_sx", 0)) & (F.col("_by") == edge("_sy", 0))
    spread = lambda df: df.withColumn("_bx", every("_sx")).withColumn("_by", every("_sy")).withColumn("_own", own)
    new = centres.select("image_id", "_sx", "_sy", "shape_idx", F.col("shape_idx").alias("seed_idx"), F.lit(_OPEN).alias("_state"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)
    arrow = arrow_schema(schema, centres.sparkSession)
    still, settled, rounds = new, None, 0
    while True:
        rows = spread(still).filter(F.col("_own") | (F.col("_state") == _OPEN))
        if settled is not None:
            seeds = spread(settled.filter(F.col("_state") == _SEED)).join(rows.select(*blocks).distinct(), blocks, "left_semi")
            rows = rows.unionByName(seeds.select(*rows.columns))
        rows = rows.repartition(*blocks).sortWithinPartitions(*blocks, "shape_idx", "_sx", "_sy")
        round_ = stored(rows.mapInArrow(lambda batches: _settle(batches, blocks, side, reach, dist, arrow), schema))
        rounds += 1
        known = F.col("_state").isin(_SEED, _DONE)
        fresh, still = round_.filter(known), round_.filter(~known)
        settled = fresh if settled is None else settled.unionByName(fresh)
        if still.isEmpty():
            return settled.drop("_state"), rounds


def _settle(batches: Iterator[pa.RecordBatch], blocks: list[str], side: int, reach: int, dist: int, schema: pa.Schema):
    """Every block's own centres with what is known of them now; rows come by block and in order of ``shape_idx``."""
    current, seeds, waiting, limit = None, {}, {}, 4 * dist * dist
    window = sorted(((a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)), key=lambda w: abs(w[0]) + abs(w[1]))

    def near(x: int, y: int, col: int, row: int, held: dict) -> Iterator:
        """``shape_idx`` of what is held in reach."""
        lists = held.values() if len(held) < len(window) else (held.get((col + a, row + b), ()) for a, b in window)
        return (idx for spots in lists for p, q, idx in spots if (p - x) ** 2 + (q - y) ** 2 < limit)

    for batch in batches:
        rows, found, states = [], [], []
        for n, (*block, x, y, idx, state, mine) in enumerate(zip(*_lists(batch, [*blocks, "_sx", "_sy", "shape_idx", "_state", "_own"]))):
            if block != current:
                current, seeds, waiting = block, {}, {}
            col, row = at = (x // side, y // side)
            seed = idx
            if state == _SEED:
                seeds.setdefault(at, []).append((x, y, idx))
                continue
            first = min(near(x, y, col, row, seeds), default=None)
            if first is not None:  # no seed, whatever becomes of the rest; an earlier one may still open beside it
                seed = first
                state = _COVERED if mine and any(i < first for i in near(x, y, col, row, waiting)) else _DONE
            elif state == _COVERED:
                pass
            elif mine and not any(True for _ in near(x, y, col, row, waiting)):
                seeds.setdefault(at, []).append((x, y, idx))
                state = _SEED
            else:
                waiting.setdefault(at, []).append((x, y, idx))
            if mine:
                rows.append(n)
                found.append(seed)
                states.append(state)
        picked = batch.select(schema.names[:4]).take(pa.array(rows, pa.int64()))
        new = [pa.array(found, schema[4].type), pa.array(states, schema[5].type)]
        yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(picked.columns, schema)), *new], schema=schema)


# -- cluster rows ------------------------------------------------------------


def merge_boxes(members: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Hull, members, area and floored centre of every cluster."""
    by = by or ["image_id", "seed_idx"]
    merged = members.groupBy(*by).agg(
        F.min("x_min").alias("x_min"),
        F.min("y_min").alias("y_min"),
        F.max("x_max").alias("x_max"),
        F.max("y_max").alias("y_max"),
        F.count(F.lit(1)).alias("defect_count"),
    )
    x1, y1, x2, y2 = (F.col(c) for c in CORNERS)
    return merged.withColumns({"cluster_area": G.box_area(x1, y1, x2, y2), "cx": G.half(x1, x2), "cy": G.half(y1, y2)})


def plan_clusters(boxes: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """(members, clusters) of the merged boxes, safe for images of any size."""
    limits = {"dist": MERGE_DISTANCE, "max_area": MAX_CLUSTER_AREA} | limits
    calm, crowded = _by_crowd(boxes)
    some, many = _swept(calm, False, **limits), _swept(crowded, True, **limits)
    return some.unionByName(many), clusters(some, False).unionByName(clusters(many))


def clusters(members: DataFrame, any_size: bool = True) -> DataFrame:
    """One row per cluster of :func:`cluster_boxes`, numbered in order of opening.

    ``damage_type`` must be canonical. Members are combined before each shuffle and
    the numbering is split by height, so an image may hold any share of the boxes. With
    ``any_size=False`` no image is crowded: the members of each meet once, for merging and numbering.
    """
    members = members if any_size else members.repartition("image_id")
    by = ["image_id", "seed_idx", "seed_x", "seed_y"]
    aggs, type_counts = fixed_counts("damage_type", "member_pos", ALL_TYPES, "type_counts")
    rows = (
        members.groupBy(*by)
        .agg(
            F.min("x_min").alias("x_min"),
            F.min("y_min").alias("y_min"),
            F.max("x_max").alias("x_max"),
            F.max("y_max").alias("y_max"),
            F.count(F.lit(1)).alias("defect_count"),
            *aggs,
        )
        .select(*by, *CORNERS, "defect_count", type_counts)
    )
    order = [F.col("seed_y"), F.col("seed_x"), F.col("seed_idx")]
    if any_size:
        rows = bucketed_row_number(rows, ["image_id"], order, F.floor(F.col("seed_y") / 1024), "_rn")
    else:
        rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("image_id").orderBy(*order)))
    return rows.withColumns(
        {"cluster_idx": (F.col("_rn") - 1).cast("bigint"), "dominant_type": dominant_of(F.col("type_counts"))}
    ).drop("_rn")


def cluster_regions(images: DataFrame, cluster_rows: DataFrame, padding: int = 30, target: int = 448) -> DataFrame:
    """Crop record of every cluster (single values; members stay in their own table)."""
    wide = with_position(cluster_rows.join(images.select("image_id", "image_name", "image_w", "image_h"), "image_id"))
    corners = [F.col(c) for c in CORNERS]
    window = G.crop_window(*corners, F.col("image_w"), F.col("image_h"), F.lit(padding), F.lit(padding))
    wide = wide.withColumn("window", window)
    stem = L.image_stem(F.col("image_name"))
    return wide.select(
        "image_id",
        G.region_id(stem, "cluster", F.col("cluster_idx")).alias("crop_id"),
        F.lit("clustered").alias("method"),
        "cluster_idx",
        "seed_idx",
        F.when(F.col("defect_count") > 1, "multi_defect").otherwise("single_defect").alias("cluster_type"),
        "defect_count",
        "dominant_type",
        "type_counts",
        *[F.col(f"window.{c}").alias(f"crop_{c}") for c in ("x1", "y1", "x2", "y2")],
        F.floor((corners[0] + corners[2]) / 2).cast("bigint").alias("center_x"),
        F.floor((corners[1] + corners[3]) / 2).cast("bigint").alias("center_y"),
        G.box_area(*corners).alias("area"),
        "rel_x",
        "rel_y",
        "spatial_zone",
        "size_class",
        "near_edge",
        F.lit(padding).cast("bigint").alias("padding_applied"),
        F.lit(target).cast("bigint").alias("crop_size"),
    )


def region_record(regions: DataFrame, members: DataFrame, part_size: int = 4096) -> DataFrame:
    """Nested crop records with their included defects.

    The member list is cut into parts of bounded length, so a crop that holds
    very many boxes becomes several rows; an ordinary crop is one row, part 0.
    """
    box = F.array(*[F.col(c).cast("int") for c in CORNERS])
    member = F.struct(
        F.col("member_pos"),
        F.col("shape_idx").alias("defect_idx"),
        F.col("damage_type"),
        box.alias("bbox"),
        G.box_area(*[F.col(c) for c in CORNERS]).alias("area"),
    )
    parts = (
        members.withColumn("part", F.floor(F.col("member_pos") / part_size).cast("bigint"))
        .groupBy("image_id", "seed_idx", "part")
        .agg(F.sort_array(F.collect_list(member)).alias("included_defects"))
    )
    return regions.join(parts, ["image_id", "seed_idx"])


def cluster_stats(cluster_rows: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    multi = F.count_if(F.col("defect_count") > 1)
    defects = F.sum("defect_count")
    return cluster_rows.agg(
        n.alias("n_clusters"),
        defects.alias("n_defects"),
        F.count_if(F.col("defect_count") == 1).alias("n_single"),
        multi.alias("n_multi"),
        (multi * 100.0 / n).alias("multi_pct"),
        F.max("defect_count").alias("max_size"),
        F.avg(F.when(F.col("defect_count") > 1, F.col("defect_count"))).alias("mean_multi_size"),
        ((1 - n / defects) * 100).alias("reduction_pct"),
        (defects / n).alias("defects_per_cluster"),
    )


# -- tiles and grid ----------------------------------------------------------


def cover(start: Column, end: Column, limit: Column, size: int, overlap: float) -> Column:
    """Window starts along one axis that cover ``[start, end]``.

    One centred window when the extent fits; otherwise steps of the overlapped
    size plus a last window that ends with the extent.
    """
    clamp = lambda s: F.greatest(F.lit(0).cast("bigint"), F.least(s, limit - size))
    step = int(size * (1 - overlap))
    start, end, limit = start.cast("bigint"), end.cast("bigint"), limit.cast("bigint")
    centred = F.array(clamp(G.half(start, end) - size // 2))
    count = F.ceil((end - size - start) / step)
    cursors = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.greatest(count - 1, F.lit(0))),
        lambda i: F.greatest(F.lit(0).cast("bigint"), start + i * step),
    )
    stepped = F.filter(cursors, lambda c: c + size <= limit)
    covering = F.sort_array(F.array_distinct(F.concat(stepped, F.array(clamp(end - size)))))
    return F.when(end - start <= size, centred).otherwise(covering)


def tile_plan(cluster_rows: DataFrame, size: int = 336, overlap: float = 0.2) -> DataFrame:
    """Fixed-size tiles over each cluster; tiles that leave the image are dropped."""
    w, h = F.col("image_w"), F.col("image_h")
    x1, y1, x2, y2 = (F.col(c) for c in CORNERS)
    return (
        cluster_rows.withColumn("is_tiled", (x2 - x1 > size) | (y2 - y1 > size))
        .withColumn("tile_y", F.explode(cover(y1, y2, h, size, overlap)))
        .withColumn("tile_x", F.explode(cover(x1, x2, w, size, overlap)))
        .filter((F.col("tile_x") + size <= w) & (F.col("tile_y") + size <= h))
        .withColumns({"tile_x2": F.col("tile_x") + size, "tile_y2": F.col("tile_y") + size})
    )


def grid_plan(images: DataFrame, size: int = 336, overlap: float = 0.3, outline: str | None = None) -> DataFrame:
    """Grid cells over the image, or over the bounding box of its outline column."""
    stride = int(size * (1 - overlap))
    w, h = F.col("image_w").cast("bigint"), F.col("image_h").cast("bigint")
    if outline is None:
        low_x = low_y = F.lit(0).cast("bigint")
        high_x, high_y = w, h
    else:
        # extent of the outline pixels; the far end is one past the last pixel
        box = G.bbox_from_points(F.col(outline))
        given = F.coalesce(F.size(outline), F.lit(0)) > 0
        pick = lambda c, extra, rest: F.when(given, box[c].cast("bigint") + extra).otherwise(rest)
        low_x, low_y = pick("x_min", 0, F.lit(0)), pick("y_min", 0, F.lit(0))
        high_x, high_y = pick("x_max", 1, w), pick("y_max", 1, h)
    bounded = images.withColumns({"_lx": low_x, "_ly": low_y, "_hx": high_x, "_hy": high_y})
    steps = lambda lo, hi: F.sequence(F.col(lo), F.col(hi) - 1, F.lit(stride).cast("bigint"))
    return (
        bounded.filter((F.col("_hx") > F.col("_lx")) & (F.col("_hy") > F.col("_ly")))
        .withColumn("grid_y", F.explode(steps("_ly", "_hy")))
        .withColumn("grid_x", F.explode(steps("_lx", "_hx")))
        .withColumns(
            {
                "cell_x2": F.least(F.col("grid_x") + size, F.col("_hx"), w),
                "cell_y2": F.least(F.col("grid_y") + size, F.col("_hy"), h),
            }
        )
        .drop("_lx", "_ly", "_hx", "_hy")
        .filter((F.col("cell_x2") - F.col("grid_x") >= size * 0.5) & (F.col("cell_y2") - F.col("grid_y") >= size * 0.5))
    )


def coverage_filter(cells: DataFrame, outline: str = "outline", min_ratio: float = 0.6) -> DataFrame:
    """Share of each cell inside the outline; cells below the ratio are dropped.

    What is inside follows the even-odd rule, so outlines may cross or touch themselves, as a
    filled mask would show them. The clipped area is exact; counting filled pixels would
    differ by at most the border pixels of the outline. A whole Arrow batch of
    cells is measured at once, each outline of it cut into pieces once.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in cells.dtypes) + ", vehicle_ratio double"
    arrow = arrow_schema(schema, cells.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            box = [batch[c].to_numpy().astype(float) for c in ("grid_x", "grid_y", "cell_x2", "cell_y2")]
            yield _with_columns(batch, [_covered_share(batch[outline], *box)], arrow)

    return cells.mapInArrow(measure, schema).filter(F.col("vehicle_ratio") >= min_ratio)


def _crossings(x1, y1, x2, y2, slope):
    """Abscissae at which two edges cross inside both; a block of edges meets all others at once."""
    found = []
    base = y1 - slope * x1
    for low in range(0, len(x1), 256):
        i = slice(low, low + 256)
        with np.errstate(divide="ignore", invalid="ignore"):
            x = (base[None, :] - base[i, None]) / (slope[i, None] - slope[None, :])
        inside = (x > np.maximum(x1[i, None], x1[None, :])) & (x < np.minimum(x2[i, None], x2[None, :]))
        found.append(x[inside])
    return np.concatenate(found) if found else np.empty(0)


def even_odd_pieces(points: np.ndarray) -> np.ndarray:
    """Edges of an outline cut into pieces between neighbouring corners and crossings, as rows ``x1, y1, x2, y2, sign``.

    Between two such abscissae no edges cross; from below, every second one ends what is
    inside. The sum of sign times the area under the piece is the filled area.
    """
    p, q = points, np.roll(points, -1, axis=0)
    back = p[:, 0] > q[:, 0]
    p, q = np.where(back[:, None], q, p), np.where(back[:, None], p, q)
    wide = p[:, 0] < q[:, 0]
    (x1, y1), (x2, y2) = p[wide].T, q[wide].T
    slope = (y2 - y1) / (x2 - x1)
    cuts = np.unique(np.concatenate([x1, x2, _crossings(x1, y1, x2, y2, slope)]))
    first, last = np.searchsorted(cuts, x1), np.searchsorted(cuts, x2)
    n = last - first
    edge = np.repeat(np.arange(len(x1)), n)
    slab = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[edge]
    a, b = cuts[slab], cuts[slab + 1]
    ya, yb = y1[edge] + slope[edge] * (a - x1[edge]), y1[edge] + slope[edge] * (b - x1[edge])
    order = np.lexsort((ya + yb, slab))
    place = np.arange(len(order)) - np.searchsorted(slab[order], slab[order])
    return np.column_stack([a[order], ya[order], b[order], yb[order], np.where(place % 2, 1.0, -1.0)])


def _covered_share(outlines: pa.Array, x1, y1, x2, y2):
    """Covered share of each rectangle; 1.0 where there is no outline.

    A piece of an edge contributes the integral of its height, limited to the
    rectangle's heights, over its x-range inside the rectangle.
    """
    size = pc.fill_null(pc.list_value_length(outlines), 0).to_numpy(zero_copy_only=False)
    points = outlines.flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 2)
    ends = np.cumsum(size)
    known: dict[bytes, int] = {}
    pieces, numbers = [np.empty((0, 5))], np.zeros(len(size), np.int64)
    for i in np.flatnonzero(size):
        own = points[ends[i] - size[i] : ends[i]]
        key = own.tobytes()
        if key not in known:
            known[key] = len(pieces)
            pieces.append(even_odd_pieces(own))
        numbers[i] = known[key]
    counts = np.array([len(p) for p in pieces])
    starts, flat = np.cumsum(counts) - counts, np.concatenate(pieces)
    n = counts[numbers]
    cell = np.repeat(np.arange(len(size)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + starts[numbers][cell]
    px, py, qx, qy, sign = flat[at].T
    left, right, low, top = x1[cell], x2[cell], y1[cell], (y2 - y1)[cell]
    slope = (qy - py) / (qx - px)
    a, b = np.clip(px, left, right), np.clip(qx, left, right)
    ya = py + slope * (a - px) - low
    yb = py + slope * (b - px) - low

    def primitive(t):  # antiderivative of min(max(t, 0), top)
        return (np.maximum(t, 0) ** 2 - np.maximum(t - top, 0) ** 2) / 2

    level = np.clip(ya, 0, top)
    mean = np.divide(primitive(yb) - primitive(ya), yb - ya, out=level, where=np.abs(yb - ya) > 1e-9)
    area = np.maximum(np.bincount(cell, sign * (b - a) * mean, len(size)), 0.0)
    return np.where(size > 0, area / ((x2 - x1) * (y2 - y1)), 1.0)


# -- whole plans ---------------------------------------------------------------


def individual_regions(images: DataFrame, boxes: DataFrame, adaptive: bool = False, target: int = 448) -> DataFrame:
    """One padded crop per box with the adaptive padding rule."""
    limited = filter_area_adaptive(boxes) if adaptive else filter_area(boxes, 50, 500_000)
    kept = with_position(with_types(limited))
    wide = kept.join(images.select("image_id", "image_name"), "image_id")
    x1, y1, x2, y2 = (F.col(c) for c in CORNERS)
    area = G.box_area(x1, y1, x2, y2)
    factor = G.padding_factor(
        area, F.col("damage_type"), F.col("rel_x"), F.col("rel_y"), F.col("image_w"), F.col("image_h")
    )
    wide = wide.withColumn("padding_factor", factor).withColumns(
        {
            "pad_x": F.floor((x2 - x1) * F.col("padding_factor")).cast("bigint"),
            "pad_y": F.floor((y2 - y1) * F.col("padding_factor")).cast("bigint"),
        }
    )
    window = G.crop_window(x1, y1, x2, y2, F.col("image_w"), F.col("image_h"), F.col("pad_x"), F.col("pad_y"))
    wide = wide.withColumn("window", window)
    stem = L.image_stem(F.col("image_name"))
    return wide.select(
        "image_id",
        G.region_id(stem, "roi", F.col("shape_idx")).alias("crop_id"),
        F.lit("individual").alias("method"),
        "shape_idx",
        "damage_type",
        F.col("label").alias("damage_label"),
        *[F.col(f"window.{c}").alias(f"crop_{c}") for c in ("x1", "y1", "x2", "y2")],
        F.floor((x1 + x2) / 2).cast("bigint").alias("center_x"),
        F.floor((y1 + y2) / 2).cast("bigint").alias("center_y"),
        area.alias("area"),
        G.aspect_ratio(x2 - x1, y2 - y1).alias("aspect"),
        "rel_x",
        "rel_y",
        "spatial_zone",
        "size_class",
        "near_edge",
        "padding_factor",
        "pad_x",
        "pad_y",
        F.lit(target).cast("bigint").alias("crop_size"),
    )


def tile_regions(images: DataFrame, boxes: DataFrame, size: int = 336) -> DataFrame:
    """Seed clusters of labelled boxes, covered by fixed-size tiles."""
    members = cluster_seed(boxes)
    merged = merge_boxes(members).join(images.select("image_id", "image_name", "image_w", "image_h"), "image_id")
    tiles = tile_plan(merged, size)
    # seeds and tiles per image are bounded by the image size, so is this window
    order = Window.partitionBy("image_id").orderBy("seed_idx", "tile_y", "tile_x")
    numbered = tiles.withColumn("_rn", F.row_number().over(order) - 1)
    stem = L.image_stem(F.col("image_name"))
    return numbered.select(
        "image_id",
        F.concat(G.region_id(stem, "cluster", F.col("_rn")), F.lit(".jpg")).alias("crop_id"),
        F.col("image_name").alias("source_image"),
        F.lit(True).alias("has_damage"),
        L.vehicle_zone(F.col("image_name")).alias("vehicle_zone"),
        F.lit("clustered_defects").alias("generation_method"),
        "seed_idx",
        "defect_count",
        "is_tiled",
        F.col("tile_x").alias("crop_x1"),
        F.col("tile_y").alias("crop_y1"),
        F.col("tile_x2").alias("crop_x2"),
        F.col("tile_y2").alias("crop_y2"),
    )


def grid_regions(images: DataFrame, size: int = 336, overlap: float = 0.3, min_ratio: float = 0.4) -> DataFrame:
    """Grid cells of images with an ``outline`` column that lie on the vehicle."""
    cells = coverage_filter(grid_plan(images, size, overlap, "outline"), "outline", min_ratio)
    stem = L.image_stem(F.col("image_name"))
    return cells.select(
        "image_id",
        F.concat(G.region_id(stem, "grid", F.col("grid_x"), F.col("grid_y")), F.lit(".jpg")).alias("crop_id"),
        F.col("image_name").alias("source_image"),
        F.lit(False).alias("has_damage"),
        L.vehicle_zone(F.col("image_name")).alias("vehicle_zone"),
        F.lit("grid_masked_polygon").alias("generation_method"),
        "vehicle_ratio",
        "grid_x",
        "grid_y",
        F.col("grid_x").alias("crop_x1"),
        F.col("grid_y").alias("crop_y1"),
        F.col("cell_x2").alias("crop_x2"),
        F.col("cell_y2").alias("crop_y2"),
    )


def plan_regions(
    images: DataFrame,
    boxes: DataFrame,
    method: str = "mixed",
    outlines: DataFrame | None = None,
    annotated: DataFrame | None = None,
) -> DataFrame:
    """Region table by method: individual, clustered, optimised, grid or mixed.

    ``outlines`` has ``image_id, outline``; images without one use their full area.
    ``annotated`` lists the images with a damage document (default: those with
    boxes); ``mixed`` lays a grid over all others.
    """
    if method == "individual":
        return individual_regions(images, boxes)
    if method == "clustered":
        kept = with_types(filter_area(boxes, 50, 300_000))
        return cluster_regions(images, plan_clusters(kept)[1])
    if method == "optimised":
        return tile_regions(images, boxes)
    if outlines is None:
        traced = images.withColumn("outline", F.lit(None).cast("array<array<int>>"))
    else:
        traced = images.join(outlines, "image_id", "left")
    if method == "grid":
        return grid_regions(traced)
    if method == "mixed":
        damaged = (boxes if annotated is None else annotated).select("image_id")
        clean = traced.join(damaged, "image_id", "left_anti")
        return tile_regions(images, boxes).unionByName(grid_regions(clean), allowMissingColumns=True)
    raise ValueError(f"unknown region method: {method}")
