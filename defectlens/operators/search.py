"""Nearest-neighbour search in batch, filters, re-ranking and search checks.

Exact search picks one of three ways by measured size:

* few queries       they are broadcast; one pass over the corpus, of which every task hands on k rows per query
* small corpus      it is broadcast; one pass over the queries, also when both would fit but the queries are many
* both large        both sides are cut into blocks and every pair of blocks is
                    one task (``_block_join``)

Each way hands on at most k rows per query and task. A broadcast never exceeds
``BROADCAST_BYTES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..arrow import arrow_schema
from ..dims import LARGEST_PROFILE, SEARCH_PROFILES, TYPE_DETAILS, lookup
from ..functions import labels as L
from ..functions import vectors as V
from ..ranks import ensure_checkpoint_dir, stored
from .profile import seeded_pick, top_n

BROADCAST_BYTES = 64 << 20
#: Vectors of one side that a task of a block join holds.
BLOCK_BYTES = 32 << 20
SLICE_CELLS = 2_000_000
#: Pairs of query and row from which a search is shared by more tasks (a second or two of one core).
TASK_PAIRS = 1 << 28
#: More queries than these are not broadcast when the corpus can be.
FEW_QUERIES = 4096


# -- top-k arithmetic inside a task --------------------------------------------


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column as a float64 matrix."""
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = chunk.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(chunk), -1) if len(chunk) else values.reshape(0, 0)


def _finite(x: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows without a missing, NaN or infinite element, and what belongs to them."""
    good = np.isfinite(x).all(axis=1)
    return (x, *others) if good.all() else (x[good], *(o[good] for o in others))


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_integer(chunk.type):
        return chunk.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.array(chunk.to_pylist(), dtype=str)


class _TopK:
    """Running k best (distance, id) of a fixed set of queries.

    A product of single precision only preselects: every row that may lie within the k-th value by its
    rounding error is measured again by differences. Slices of queries meet chunks of rows that stay in
    the processor's cache, and only the results of the slice are merged.
    """

    FIRST, CHUNK, SLICE = 1024, 2048, 512

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, exclude_self: bool):
        self.query_ids, self.queries, self.k, self.exclude_self = query_ids, queries, k, exclude_self
        self.square = (queries * queries).sum(axis=1)
        self.distance = np.full((len(queries), k), np.inf)
        self.id = None

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        if len(ids) == 0 or len(self.queries) == 0:
            return
        kind = ids.dtype if self.id is None else np.promote_types(ids.dtype, self.id.dtype)
        self.id = np.zeros(self.distance.shape, kind) if self.id is None else self.id.astype(kind, copy=False)
        for s in range(0, len(ids), 1 << 16):
            self._add_rows(ids[s : s + (1 << 16)], x[s : s + (1 << 16)])

    def _add_rows(self, ids: np.ndarray, x: np.ndarray) -> None:
        square = (x * x).sum(axis=1)
        kind = np.float32 if max(square.max(), self.square.max()) < 1e30 else np.float64
        # relative to the squares, more than the rounding error of a product of this precision
        error = 4.0 * (x.shape[1] + 8) * np.finfo(kind).eps
        right = np.column_stack([-2.0 * x, square * (1.0 - error)]).astype(kind).T
        for a in range(0, len(self.queries), self.SLICE):
            b = min(a + self.SLICE, len(self.queries))
            left = np.column_stack([self.queries[a:b], np.ones(b - a)]).astype(kind)
            s = 0
            while s < len(ids):
                is_open = np.isinf(self.distance[a:b, -1]).any()
                e = min(len(ids), s + (self.FIRST if is_open else self.CHUNK))
                self._add_slice(a, b, left @ right[:, s:e], error, ids[s:e], x[s:e], square[s:e], is_open)
                s = e

    def _add_slice(self, a: int, b: int, rough: np.ndarray, error: float, ids: np.ndarray, x: np.ndarray, square: np.ndarray, is_open: bool) -> None:
        """``rough`` is, but for the query's square, never more than the distance."""
        own, bound = self.square[a:b], self.distance[a:b, -1]
        if is_open:
            if self.exclude_self:
                rough[self.query_ids[a:b, None] == ids[None, :]] = np.inf
            if len(ids) > self.k:
                kth = np.partition(rough, self.k - 1, axis=1)[:, self.k - 1].astype(np.float64)
                bound = np.minimum(bound, kth + own + 2 * error * (own + square.max()))
        with np.errstate(over="ignore"):
            limit = np.nextafter((bound - own + error * (own + bound) + 1e-35).astype(rough.dtype), rough.dtype.type(np.inf))
        some = np.flatnonzero(~(rough.min(axis=1) > limit))  # later chunks have nothing for most queries
        if len(some) < len(rough):
            rough, limit = rough[some], limit[some]
        place = np.flatnonzero(rough <= limit[:, None])
        if len(place) == 0:
            return
        place = place[np.isfinite(rough.reshape(-1)[place])]
        q, c = np.divmod(place, len(ids))
        q = some[q]
        if self.exclude_self and not is_open:
            other = self.query_ids[a + q] != ids[c]
            q, c = q[other], c[other]
        exact = np.empty(len(q))
        for s in range(0, len(q), 50_000):
            gap = self.queries[a + q[s : s + 50_000]] - x[c[s : s + 50_000]]
            exact[s : s + 50_000] = (gap * gap).sum(axis=1)
        near = exact <= self.distance[a + q, -1]
        self._merge(a + q[near], exact[near], ids[c[near]])

    def _merge(self, row: np.ndarray, distance: np.ndarray, ids: np.ndarray) -> None:
        """New hits, in order of their query, among the k best of these queries."""
        touched = row[np.flatnonzero(np.diff(row, prepend=-1))]
        row = np.concatenate([np.repeat(touched, self.k), row])
        distance = np.concatenate([self.distance[touched].reshape(-1), distance])
        ids = np.concatenate([self.id[touched].reshape(-1), ids])
        order = np.lexsort((ids, distance, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        best = place < self.k
        self.distance[row[best], place[best]] = distance[order][best]
        self.id[row[best], place[best]] = ids[order][best]

    def batch(self, names: list[str], schema: pa.Schema, **fixed) -> pa.RecordBatch:
        row, place = np.nonzero(np.isfinite(self.distance))
        columns = {
            "query_id": self.query_ids[row],
            "id": self.id[row, place] if self.id is not None else np.empty(0, dtype=np.int64),
            "distance": self.distance[row, place],
            **{name: [value] * len(row) for name, value in fixed.items()},
        }
        return pa.RecordBatch.from_arrays([pa.array(columns[c], type=schema.field(c).type) for c in names], schema=schema)


# -- exact search -----------------------------------------------------------------


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there and finite in every element; ``vector_audit`` counts the others."""
    return df.filter(F.col(vector).isNotNull() & ~V.has_bad_values(F.col(vector)))


def measure(**sides: DataFrame) -> tuple[int, dict[str, int]]:
    """Dimension of the vectors ``_v`` of all sides and the rows of each, in one job; mixed dimensions fail."""
    size = F.size("_v")
    parts = [df.agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("n"), F.min(size).alias("low"), F.max(size).alias("high")) for name, df in sides.items()]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    rows = [r for r in both.collect() if r["n"]]  # one row for each side
    dims = {r["low"] for r in rows} | {r["high"] for r in rows}
    if len(dims) > 1:
        raise ValueError(f"vectors of different dimensions: {sorted(dims)}")
    return max(dims, default=1), {name: next((r["n"] for r in rows if r["side"] == name), 0) for name in sides}


def assert_dim(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Fail the query when a vector has another dimension."""
    wrong = F.raise_error(F.concat(F.lit(f"embedding dimension is not {dim}: "), F.size(vector).cast("string")))
    return df.withColumn(vector, F.when(F.size(vector) == dim, F.col(vector)).otherwise(wrong.cast(df.schema[vector].dataType)))


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    by: str | None = None,
    exclude_self: bool = False,
    filters: dict | None = None,
    overfetch: int | None = None,
    form: str = "crop",
    vector: str = "embedding",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Exact k nearest corpus rows of every query by (squared L2 distance, id).

    ``queries`` has ``query_id`` and the vector, ``corpus`` has ``id``, the vector
    and, with ``by``, the column of independent corpora to search separately.
    Filters apply before the search; with ``overfetch=n`` the k*n nearest are
    fetched first and filtered afterwards, so fewer than k rows may come back.
    Vectors that are null or hold an element that is not finite take no part; the tasks leave
    them out as they meet them.
    """
    if filters and overfetch:
        wide = knn(queries, corpus, k * overfetch, by, exclude_self, None, None, form, vector, broadcast_bytes)
        kept = corpus.filter(filter_condition(filters, form)).select("id")
        return top_k(wide.drop("rank").join(kept, "id", "left_semi"), _groups(by), k)
    if filters:
        corpus = corpus.filter(filter_condition(filters, form))
    q = queries.select("query_id", F.col(vector).alias("_v")).filter("_v is not null")
    c = corpus.select(*([by] if by else []), "id", F.col(vector).alias("_v")).filter("_v is not null")
    dim, rows = measure(q=q, c=c)
    types = {"query_id": dict(q.dtypes)["query_id"], "id": dict(c.dtypes)["id"], "distance": "double"}
    if by:
        types[by] = dict(c.dtypes)[by]
    names = list(types)
    schema = ", ".join(f"`{n}` {t}" for n, t in types.items())
    small_corpus = rows["c"] * dim * 8 <= broadcast_bytes
    few_queries = rows["q"] * (dim + 3 * k) * 8 <= broadcast_bytes
    # what the tasks hand on, against one copy of the corpus for a block join
    handed = _tasks(c.sparkSession, rows["q"] * rows["c"]) * rows["q"] * k * 24
    if few_queries and (rows["q"] <= FEW_QUERIES or not small_corpus and handed <= rows["c"] * dim * 4):
        found = _scan_corpus(q, _shared(c, rows), k, by, exclude_self, names, schema)
    elif small_corpus:
        found = _scan_queries(_shared(q, rows), c, k, by, exclude_self, names, schema)
    else:
        found = _block_join(_per_group(q, c, by) if by else q, c, by, k, exclude_self, BLOCK_BYTES, dim, rows)
    return top_k(found, _groups(by), k)


def knn_referred(queries: DataFrame, rows: DataFrame, vectors: DataFrame, k: int = 5, vector: str = "embedding") -> DataFrame:
    """Exact k nearest ``rows`` of every query, as ``knn`` ranks them, where a row names its vector instead of holding it.

    ``rows`` has ``id, ref`` and more, which the result keeps; ``vectors`` has ``ref`` and the vector. A vector is measured once,
    under the first id of the rows that name it, however many these are. A vector that is not among the k nearest by (distance, first
    id) has k rows before its first one, so the k nearest rows are among the first k rows of the k nearest vectors.
    """
    upto = Window.partitionBy("ref").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = rows.filter("ref is not null").withColumn("_first", F.min("id").over(upto))
    firsts = top_n(named, ["ref"], [F.col("id")], k, "_place")
    corpus = stored(firsts.filter("_place = 1").join(vectors.filter(F.col(vector).isNotNull()), "ref").select("id", vector))
    near = knn(queries, corpus, k, vector=vector).select("query_id", "distance", F.col("id").alias("_first"))
    found = near.join(firsts.drop("ref", "_place"), "_first").drop("_first")
    return top_k(found, ["query_id"], k)


def _tasks(spark: SparkSession, pairs: int) -> int:
    """Tasks for so many pairs: one for each ``TASK_PAIRS``, at most three for each core."""
    return max(1, min(3 * spark.sparkContext.defaultParallelism, -(-pairs // TASK_PAIRS)))


def _shared(df: DataFrame, rows: dict[str, int]) -> DataFrame:
    """The scanned side dealt to as many tasks as the pairs are worth; files may come in few partitions."""
    tasks = _tasks(df.sparkSession, rows["q"] * rows["c"])
    return df if tasks == 1 else df.repartition(tasks)


def _groups(by: str | None) -> list[str]:
    return [by, "query_id"] if by else ["query_id"]


def _per_group(q: DataFrame, c: DataFrame, by: str) -> DataFrame:
    """Every query once per corpus: the query set asked of each of them."""
    names = c.groupBy(F.col(by).alias("_name")).agg(F.count(F.lit(1)).alias("_n")).select(F.col("_name").alias(by))
    return q.join(names, F.lit(True))


def top_k(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """k nearest rows of each query, ranked by (distance, id)."""
    w = Window.partitionBy(*by).orderBy("distance", "id")
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def _scan_corpus(q, c, k, by, exclude_self, names, schema) -> DataFrame:
    """Few queries: broadcast them and scan the corpus once."""
    spark = c.sparkSession
    table = q.toArrow()
    given, asked = _finite(_matrix(table["_v"]), _ids(table["query_id"]))
    held = spark.sparkContext.broadcast((asked, given))
    arrow = arrow_schema(schema, spark)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = held.value
        best: dict = {}
        for batch in batches:
            if by is None:
                x, rows = _finite(_matrix(batch["_v"]), _ids(batch["id"]))
                best.setdefault(None, _TopK(ids, matrix, k, exclude_self)).add(rows, x)
                continue
            x, rows, groups = _finite(_matrix(batch["_v"]), _ids(batch["id"]), np.array(batch[by].to_pylist(), dtype=object))
            for g in dict.fromkeys(groups.tolist()):
                mine = groups == g
                best.setdefault(g, _TopK(ids, matrix, k, exclude_self)).add(rows[mine], x[mine])
        for g, top in best.items():
            yield top.batch(names, arrow, **({by: g} if by else {}))

    return c.mapInArrow(scan, schema)


def _scan_queries(q, c, k, by, exclude_self, names, schema) -> DataFrame:
    """Small corpus: broadcast it and answer each batch of queries on the spot."""
    spark = c.sparkSession
    table = c.toArrow()
    groups = np.array(table[by].to_pylist(), dtype=object) if by else np.full(table.num_rows, None, dtype=object)
    given, groups, own = _finite(_matrix(table["_v"]), groups, _ids(table["id"]))
    held = spark.sparkContext.broadcast((groups, own, given))
    arrow = arrow_schema(schema, spark)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, ids, matrix = held.value
        for batch in batches:
            x, query_ids = _finite(_matrix(batch["_v"]), _ids(batch["query_id"]))
            for g in dict.fromkeys(labels.tolist()):
                mine = np.flatnonzero(labels == g)
                top = _TopK(query_ids, x, k, exclude_self)
                for s in range(0, len(mine), 1 << 16):
                    top.add(ids[mine[s : s + (1 << 16)]], matrix[mine[s : s + (1 << 16)]])
                yield top.batch(names, arrow, **({by: g} if by else {}))

    return q.mapInArrow(scan, schema)


#: Parts into which both sides of a group are dealt before they meet the group's size.
SALTS = 32


def _sized(df: DataFrame, sizes: DataFrame, group: str, key: str) -> DataFrame:
    """``df`` with its group's block numbers; salted, so that a hot group is not dealt to one task."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    spread = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, [group, "_salt"]).drop("_salt")


def _block_join(
    q: DataFrame, c: DataFrame, group: str | None, k: int, exclude_self: bool, block_bytes: int, dim: int, n: dict[str, int] | None = None
) -> DataFrame:
    """Search inside each group with both sides cut into blocks of bounded size.

    A group of any size (one cell with a third of the corpus, say) becomes
    (corpus blocks x query blocks) tasks; each row is copied once per block of
    the other side and every task returns at most k rows per query. Larger blocks
    mean fewer copies: ``block_bytes`` should be what a task can hold. Where the pairs are worth
    more tasks than there are blocks, the queries are cut further. ``n`` has the rows of both sides.
    """
    spark = c.sparkSession
    rows = max(k, block_bytes // (dim * 8))
    if group is None:
        n = n or measure(q=q, c=c)[1]
        n_corpus = max(1, -(-n["c"] // rows))
        n_query = max(1, -(-n["q"] // rows), -(-_tasks(spark, n["q"] * n["c"]) // n_corpus))
        corpus_blocks, query_blocks = F.lit(n_corpus), F.lit(n_query)
        keys = ["_cb", "_qb"]
    else:
        # one row per group: a cell, a configuration or an image
        most = 3 * spark.sparkContext.defaultParallelism
        worth = F.least(F.lit(most), F.ceil(F.col("_nc").cast("double") * F.col("_nq") / TASK_PAIRS))
        sizes = (
            c.groupBy(group).agg(F.count(F.lit(1)).alias("_nc"))
            .join(q.groupBy(group).agg(F.count(F.lit(1)).alias("_nq")), group)
            .withColumn("_cs", F.ceil(F.col("_nc") / rows))
            .select(group, "_cs", F.greatest(F.ceil(F.col("_nq") / rows), F.ceil(worth / F.col("_cs"))).alias("_qs"))
        )
        q, c = _sized(q, sizes, group, "query_id"), _sized(c, sizes, group, "id")
        corpus_blocks, query_blocks = F.col("_cs"), F.col("_qs")
        keys = [group, "_cb", "_qb"]
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1))
    part = lambda key, n: F.pmod(F.xxhash64(key), n)
    left = q.withColumn("_qb", part("query_id", query_blocks)).withColumn("_cb", spread(corpus_blocks))
    right = c.withColumn("_cb", part("id", corpus_blocks)).withColumn("_qb", spread(query_blocks))
    types = {**dict(left.dtypes), **dict(c.dtypes)}
    names = [*([group] if group else []), "query_id", "id", "distance"]
    types["distance"] = "double"
    schema = ", ".join(f"`{n}` {types[n]}" for n in names)
    arrow = arrow_schema(schema, spark)

    def search(key, a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows == 0 or b.num_rows == 0:
            return pa.Table.from_batches([], schema=arrow)
        asked, query_ids = _finite(_matrix(a["_v"]), _ids(a["query_id"]))
        top = _TopK(query_ids, asked, k, exclude_self)
        x, ids = _finite(_matrix(b["_v"]), _ids(b["id"]))
        top.add(ids, x)
        return pa.Table.from_batches([top.batch(names, arrow, **({group: key[0].as_py()} if group else {}))])

    left, right = left.select(*keys, "query_id", "_v"), right.select(*keys, "id", "_v")
    if n and _tasks(spark, n["q"] * n["c"]) > 1:
        # the work of a block grows with its pairs, not its bytes: blocks of few bytes stay apart
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 12 * spark.sparkContext.defaultParallelism)
        left, right = left.repartition(parts, *keys), right.repartition(parts, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, schema)


# -- approximate search --------------------------------------------------------------


def ann_knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    method: str = "ivf",
    n_cells: int = 16,
    nprobe: int = 4,
    tables: int = 8,
    bits: int = 6,
    exclude_self: bool = False,
    seed: int = 42,
    vector: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
    centers: DataFrame | None = None,
    planes: np.ndarray | None = None,
) -> DataFrame:
    """k nearest rows among those sharing a cell with the query.

    ``ivf`` puts every corpus row into its nearest cell and searches the ``nprobe``
    nearest cells (all cells make it exact); the cells are those of ``centers``
    (``cell``, ``center``) or of ``n_cells`` k-means centres. ``lsh`` uses ``tables``
    sign hashes of ``bits`` directions each, random ones or the columns of ``planes``.
    """
    q = usable(queries.select("query_id", F.col(vector).alias("_v")), "_v")
    c = usable(corpus.select("id", F.col(vector).alias("_v")), "_v")
    dim, n = measure(q=q, c=c)
    if method == "ivf":
        names, matrix = center_matrix(centers if centers is not None else train_cells(c, "_v", n_cells, seed), dim)
        qc = _with_cells(q, "query_id", lambda x: names[_nearest_cells(x, matrix, min(nprobe, len(matrix)))])
        cc = _with_cells(c, "id", lambda x: names[_nearest_cells(x, matrix, 1)])
    elif method == "lsh":
        planes = np.random.default_rng(seed).standard_normal((dim, tables * bits)) if planes is None else planes
        codes = lambda x: _sign_codes(x, planes, tables, bits)
        qc, cc = _with_cells(q, "query_id", codes), _with_cells(c, "id", codes)
    else:
        raise ValueError(f"unknown method: {method}")
    found = _block_join(qc, cc, "_cell", k, exclude_self, block_bytes, dim, n).select("query_id", "id", "distance")
    return top_k(found.distinct() if method == "lsh" else found, ["query_id"], k)  # only hash tables find a row twice


def train_cells(corpus: DataFrame, vector: str = "embedding", n_cells: int = 16, seed: int = 42) -> DataFrame:
    """``cell`` and ``center`` of k-means over all rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = corpus.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=max(2, n_cells), seed=seed, maxIter=8, initMode="random").fit(ready)
    rows = [(i, x.tolist()) for i, x in enumerate(model.clusterCenters())]  # n_cells rows
    return corpus.sparkSession.createDataFrame(rows, "cell bigint, center array<double>")


def center_matrix(centers: DataFrame, dim: int, most_bytes: int = BROADCAST_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Cell numbers and centres as arrays; refused above the broadcast limit."""
    n = centers.count()
    if n * dim * 8 > most_bytes:
        raise ValueError(f"{n} centres of {dim} elements are more than {most_bytes} bytes")
    table = centers.select("cell", "center").orderBy("cell").toArrow()
    matrix = _matrix(table["center"])
    if len(matrix) and matrix.shape[1] != dim:
        raise ValueError(f"centres of dimension {matrix.shape[1]}, vectors of {dim}")
    return np.array(table["cell"].to_pylist(), dtype=np.int64), matrix


def _nearest_cells(x: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """Places of the n nearest centres, by slices, so that no rows x centres matrix is held whole."""
    step, square = max(1, SLICE_CELLS // len(centers)), (centers * centers).sum(1)
    out = np.empty((len(x), n), dtype=np.int64)
    for s in range(0, len(x), step):
        gap = square[None, :] - 2 * x[s : s + step] @ centers.T
        out[s : s + step] = np.argpartition(gap, n - 1, axis=1)[:, :n] if n < len(centers) else np.arange(n)
    return out


def _sign_codes(x: np.ndarray, planes: np.ndarray, tables: int, bits: int) -> np.ndarray:
    signs = (x @ planes > 0).reshape(len(x), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(axis=2) + np.arange(tables) * (1 << bits)


def _with_cells(df: DataFrame, key: str, cells_of) -> DataFrame:
    """One row per cell of each vector; ``cells_of`` maps a matrix to cell numbers. Vectors keep their type."""
    types = dict(df.dtypes)
    schema = f"`{key}` {types[key]}, _v {types['_v']}, _cell bigint"
    arrow = arrow_schema(schema, df.sparkSession)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cells = cells_of(_matrix(batch["_v"]))
            take = pa.array(np.repeat(np.arange(len(cells)), cells.shape[1]))
            columns = [batch[key].take(take), batch["_v"].take(take), pa.array(cells.reshape(-1).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(assign, schema)


# -- stored cell index -----------------------------------------------------------------


def build_ivf(corpus: DataFrame, centers: DataFrame | None = None, n_cells: int = 16, seed: int = 42, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(``id``, vector, ``cell`` of every usable row; ``cell``, ``center``) for ``save_index`` and ``search_index``."""
    c = usable(corpus.select("id", F.col(vector).alias("_v")), "_v")
    dim, _ = measure(c=c)
    centers = centers if centers is not None else train_cells(c, "_v", n_cells, seed)
    names, matrix = center_matrix(centers, dim)
    celled = _with_cells(c, "id", lambda x: names[_nearest_cells(x, matrix, 1)])
    return celled.select("id", F.col("_v").alias(vector), F.col("_cell").alias("cell")), centers


def search_index(
    queries: DataFrame, index: DataFrame, centers: DataFrame, k: int = 5, nprobe: int = 4, exclude_self: bool = False, vector: str = "embedding", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """k nearest rows of a stored index in the ``nprobe`` nearest cells of each query.

    The index is partitioned by ``cell``: only the cells that some query probes are
    read, their list being at most one entry per centre.
    """
    q = usable(queries.select("query_id", F.col(vector).alias("_v")), "_v")
    dim, n = measure(q=q)
    names, matrix = center_matrix(centers, dim)
    qc = _with_cells(q, "query_id", lambda x: names[_nearest_cells(x, matrix, min(nprobe, len(matrix)))])
    probed = [r[0] for r in qc.select("_cell").distinct().collect()]
    held = index.filter(F.col("cell").isin(probed)).select("id", F.col(vector).alias("_v"), F.col("cell").cast("bigint").alias("_cell"))
    n["c"] = held.count()
    return top_k(_block_join(qc, held, "_cell", k, exclude_self, block_bytes, dim, n).select("query_id", "id", "distance"), ["query_id"], k)


# -- exact search in a stored index ----------------------------------------------------


def build_bounded_index(corpus: DataFrame, centers: DataFrame | None = None, n_cells: int = 16, seed: int = 42, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(all columns of every usable row and its ``cell``; ``cell``, ``center`` and ``radius``) for ``bounded_search``.

    The radius of a cell is the distance of its farthest row from the centre.
    """
    c = usable(corpus, vector)
    dim, _ = measure(c=c.select(F.col(vector).alias("_v")))
    centers = centers if centers is not None else train_cells(c, vector, n_cells, seed)
    names, matrix = center_matrix(centers, dim)
    schema = ", ".join(f"`{n}` {t}" for n, t in c.dtypes) + ", cell bigint, _gap double"
    arrow = arrow_schema(schema, c.sparkSession)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = _matrix(batch[vector])
            own = _nearest_cells(x, matrix, 1)[:, 0]
            gap = np.sqrt(((x - matrix[own]) ** 2).sum(axis=1))
            given = [a.cast(f.type) for a, f in zip(batch.columns, arrow)]
            yield pa.RecordBatch.from_arrays([*given, pa.array(names[own]), pa.array(gap)], schema=arrow)

    celled = c.mapInArrow(assign, schema)
    radii = celled.groupBy("cell").agg(F.max("_gap").alias("radius"))
    return celled.drop("_gap"), centers.select("cell", "center").join(radii, "cell", "left").withColumn("radius", F.coalesce("radius", F.lit(-1.0)))


def bounded_search(
    queries: DataFrame,
    index: DataFrame,
    centers: DataFrame,
    k: int = 5,
    exclude_self: bool = False,
    filters: dict | None = None,
    overfetch: int | None = None,
    form: str = "crop",
    vector: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Exact k nearest rows of a stored index, as ``knn`` finds them, from the cells that can hold them.

    First every query searches its nearest cells until they hold k rows that pass the filter; how
    many a cell holds is counted on the columns of the filter alone. Its k-th distance then bounds the rest: by the triangle
    inequality no row of a cell is nearer than the centre's distance less the cell's radius, so only cells within the
    bound are searched as well. Cells and filter both prune the scan. ``filters`` and ``overfetch`` mean what they
    mean in ``knn``.
    """
    if filters and overfetch:
        wide = bounded_search(queries, index, centers, k * overfetch, exclude_self, None, None, form, vector, block_bytes)
        kept = index.filter(filter_condition(filters, form)).select("id")
        return top_k(wide.drop("rank").join(kept, "id", "left_semi"), ["query_id"], k)
    held = index.filter(filter_condition(filters, form)) if filters else index
    q = usable(queries.select("query_id", F.col(vector).alias("_v")), "_v")
    dim, n = measure(q=q)
    names, matrix = center_matrix(centers, dim)
    # one row for each cell, like the centres themselves
    counts = {r["cell"]: r["n"] for r in held.groupBy(F.col("cell").cast("bigint").alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}
    radius = {r["cell"]: r["radius"] for r in centers.select("cell", "radius").collect()}
    size, reach = np.array([counts.get(int(c), 0) for c in names]), np.array([radius[int(c)] for c in names])
    full = np.flatnonzero(size)
    names, matrix, size, reach = names[full], matrix[full], size[full], reach[full]
    n["c"] = int(size.sum())
    wanted = k + exclude_self

    def first_cells(x: np.ndarray, _: np.ndarray) -> np.ndarray:
        order = np.argsort(_distances(x, matrix), axis=1, kind="stable")
        before = np.cumsum(size[order], axis=1) - size[order]
        chosen = np.zeros(order.shape, bool)
        np.put_along_axis(chosen, order, before < wanted, axis=1)
        return chosen

    def more_cells(x: np.ndarray, bound: np.ndarray) -> np.ndarray:
        near = np.maximum(_distances(x, matrix) - reach - 1e-6 * (1 + reach), 0)
        return (near * near <= bound[:, None]) & ~first_cells(x, bound)

    def found_in(asked: DataFrame, chosen) -> DataFrame:
        probes = _probes(asked, names, chosen)
        cells = [r[0] for r in probes.select("_cell").distinct().collect()]  # one for each centre at most
        rows = held.filter(F.col("cell").isin(cells)).select("id", F.col(vector).alias("_v"), F.col("cell").cast("bigint").alias("_cell"))
        return _block_join(probes, rows, "_cell", k, exclude_self, block_bytes, dim, n).select("query_id", "id", "distance")

    ensure_checkpoint_dir(q.sparkSession)
    first = top_k(found_in(q.withColumn("_bound", F.lit(0.0)), first_cells), ["query_id"], k).drop("rank").checkpoint()
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.max("distance").alias("_far"))
    bound = F.when(F.col("_n") >= k, F.col("_far")).otherwise(F.lit(float("inf")))
    again = q.join(kth, "query_id", "left").select("query_id", "_v", F.coalesce(bound, F.lit(float("inf"))).alias("_bound"))
    return top_k(first.unionByName(found_in(again, more_cells)).distinct(), ["query_id"], k)


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Distance of every row from every centre."""
    gap = (x * x).sum(1)[:, None] + (centers * centers).sum(1)[None, :] - 2 * x @ centers.T
    return np.sqrt(np.maximum(gap, 0))


def _probes(asked: DataFrame, names: np.ndarray, chosen) -> DataFrame:
    """One row of every query (``query_id``, ``_v``, ``_bound``) for each cell that ``chosen`` marks for it."""
    types = dict(asked.dtypes)
    schema = f"query_id {types['query_id']}, _v {types['_v']}, _cell bigint"
    arrow = arrow_schema(schema, asked.sparkSession)
    step = max(1, SLICE_CELLS // max(len(names), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                row, cell = np.nonzero(chosen(_matrix(part["_v"]), part["_bound"].to_numpy()))
                take = pa.array(row)
                columns = [part["query_id"].take(take), part["_v"].take(take), pa.array(names[cell].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(columns, arrow)], schema=arrow)

    return asked.select("query_id", "_v", "_bound").mapInArrow(run, schema)


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits (``query_id``, ``id``) that were found."""
    hit = found.select("query_id", "id").withColumn("_f", F.lit(1))
    joined = exact.select("query_id", "id").join(hit, ["query_id", "id"], "left")
    return joined.agg(F.count(F.lit(1)).alias("n_exact"), F.count("_f").alias("n_found")).withColumn("recall", F.col("n_found") / F.col("n_exact"))


def choose_profile(n_vectors: int) -> str:
    """Search profile for a corpus size."""
    return next((name for name, bound in SEARCH_PROFILES if n_vectors < bound), LARGEST_PROFILE)


def search(queries: DataFrame, corpus: DataFrame, k: int = 5, method: str = "exact", **options) -> DataFrame:
    """Exact search, unless the caller names ``ivf`` or ``lsh``; the size of the corpus changes nothing."""
    if method == "exact":
        return knn(queries, corpus, k, **options)
    return ann_knn(queries, corpus, k, method, **options)


# -- filters ---------------------------------------------------------------------------


def _allowed(value) -> list:
    return [value] if isinstance(value, str) else list(value)


def filter_condition(filters: dict, form: str = "crop") -> Column:
    """Boolean column for a filter dict.

    Keys: damage_type, spatial_zone, vehicle_zone, zone_area, min_defects,
    max_defects, has_damage, category, severity (low, high). The crop form tests
    the row's one normalised label; the image form tests any of ``damage_types``
    (normalised), or ``defect_types`` (raw) when that list is empty.
    """

    # A missing value counts as "unknown" or 0. It is spelled as a test on the bare
    # column, which the Parquet scan can take over.
    def within(column: str, allowed: list) -> Column:
        test = F.col(column).isin(allowed)
        return test | F.col(column).isNull() if "unknown" in allowed else test

    out = F.lit(True)
    for name, value in filters.items():
        if name == "damage_type" and form == "crop":
            label = F.col("damage_type")
            test = label.isNull() | (label == "") | label.isin(_allowed(value))
        elif name == "damage_type":
            wanted = F.array(*[F.lit(v) for v in _allowed(value)])
            normal, raw = F.col("damage_types"), F.col("defect_types")
            test = F.when(F.coalesce(F.size(normal), F.lit(0)) > 0, F.arrays_overlap(normal, wanted)).otherwise(
                F.coalesce(F.arrays_overlap(raw, wanted), F.lit(False))
            )
        elif name in ("spatial_zone", "vehicle_zone", "zone_area"):
            test = within(name, _allowed(value))
        elif name == "min_defects":
            test = F.col("total_defects") >= value
            test = test if value > 0 else test | F.col("total_defects").isNull()
        elif name == "max_defects":
            test = F.col("total_defects") <= value
            test = test if value < 0 else test | F.col("total_defects").isNull()
        elif name == "has_damage":
            test = F.col("has_damage") == value
        elif name == "category":
            categories = {t: d[0] for t, d in TYPE_DETAILS.items()}
            test = F.coalesce(lookup(categories, F.col("canonical_type")).isin(_allowed(value)), F.lit(False))
        elif name == "severity":
            low, high = value
            lows = lookup({t: d[2] for t, d in TYPE_DETAILS.items()}, F.col("canonical_type"))
            highs = lookup({t: d[3] for t, d in TYPE_DETAILS.items()}, F.col("canonical_type"))
            test = F.coalesce((lows <= high) & (highs >= low), F.lit(False))
        else:
            raise ValueError(f"unknown filter: {name}")
        out = out & test
    return out


def match_types(terms: DataFrame, types: DataFrame) -> DataFrame:
    """Damage types whose name or alias equals a search term (``term`` column)."""
    names = types.select("damage_type", "category", F.explode(F.array_append("aliases", F.col("damage_type"))).alias("alias"))
    key = F.replace(F.lower(F.trim("term")), F.lit(" "), F.lit("_"))
    return terms.withColumn("alias", key).join(F.broadcast(names), "alias")


def compatible_configs(configs: DataFrame, queries: DataFrame, vector: str = "embedding") -> DataFrame:
    """Configurations whose dimension equals that of the queries."""
    dims = queries.select(F.size(vector).alias("embedding_dim")).distinct()
    return configs.join(dims, "embedding_dim", "left_semi")


def first_queries(df: DataFrame, n: int | None, key: str = "query_id") -> DataFrame:
    return df if not n else df.orderBy(key).limit(n)


def assert_filters(results: DataFrame, filters: dict, form: str = "crop") -> DataFrame:
    """Rows, rows that break the filter, and whether all satisfy it."""
    bad = F.count_if(~F.coalesce(filter_condition(filters, form), F.lit(False)))
    return results.agg(F.count(F.lit(1)).alias("n_rows"), bad.alias("n_violations")).withColumn(
        "holds", F.col("n_violations") == 0
    )


# -- results ---------------------------------------------------------------------------


def with_metadata(hits: DataFrame, corpus: DataFrame, normalise: bool = True) -> DataFrame:
    """Result rows with the corpus columns (vectors left out) and the display label.

    ``corpus`` carries ``dominant_type`` and/or ``damage_type``; the first
    non-empty one is the label.
    """
    columns = set(corpus.columns)
    pick = lambda c: F.col(c) if c in columns else F.lit(None).cast("string")
    label = L.dominant_or_single(pick("dominant_type"), pick("damage_type"))
    meta = corpus.drop("embedding").withColumn("damage_type_original", label)
    norm = L.normalize_label(F.col("damage_type_original"))
    shown = norm["benchmark_label"] if normalise else F.col("damage_type_original")
    sure = norm["confidence"] if normalise else F.lit(1.0)
    out = hits.join(meta.drop("damage_type"), "id")
    return out.withColumns(
        {"damage_type": shown, "confidence": sure, "similarity_pct": V.similarity_pct(F.col("distance"))}
    )


RERANK_WEIGHTS = (0.6, 0.25, 0.15)


def rerank(
    hits: DataFrame, similarity: Column, type_match: Column, proximity: Column, weights=RERANK_WEIGHTS, by: list[str] | None = None
) -> DataFrame:
    """New rank by a weighted sum of similarity, type match and spatial proximity."""
    ws, wt, wp = weights
    score = similarity * ws + type_match.cast("double") * wt + proximity * wp
    w = Window.partitionBy(*(by or ["query_id"])).orderBy(F.desc("score"), "id")
    return hits.withColumn("score", score).withColumn("new_rank", F.row_number().over(w).cast("bigint"))


def search_two_stage(queries: DataFrame, images: DataFrame, regions: DataFrame, n_images: int = 10, k: int = 5) -> DataFrame:
    """Nearest images first, then the nearest regions inside them.

    ``regions`` has ``id, image_id, embedding``. Queries and regions meet per
    chosen image in blocks of bounded size, so an image with very many regions,
    or one that very many queries choose, is shared by many tasks.
    """
    chosen = knn(queries, images, n_images).select("query_id", F.col("id").alias("image_id"))
    asked = chosen.join(queries.select("query_id", F.col("embedding").alias("_v")), "query_id")
    inside = usable(regions.select("image_id", "id", F.col("embedding").alias("_v")), "_v")
    dim, _ = measure(q=usable(queries.select(F.col("embedding").alias("_v")), "_v"), c=inside)
    found = _block_join(asked, inside, "image_id", k, False, BLOCK_BYTES, dim)
    return top_k(found.drop("image_id"), ["query_id"], k)


def index_self_check(
    vectors: DataFrame, index: DataFrame, centers: DataFrame, n: int | None = 10, tolerance: float = 0.01, seed: int = 42
) -> DataFrame:
    """Sampled vectors (all with ``n=None``) must be found in the stored index under their own id and within the tolerance.

    A vector lies in its nearest cell, so that one is probed; the id is compared with
    all copies at the least distance.
    """
    sample = usable(vectors if n is None else seeded_pick(vectors, n, "id", seed))
    dim, _ = measure(c=sample.select(F.col("embedding").alias("_v")))
    names, matrix = center_matrix(centers, dim)
    celled = _with_cells(sample.select(F.col("id").alias("query_id"), F.col("embedding").alias("_v")), "query_id", lambda x: names[_nearest_cells(x, matrix, 1)])
    held = index.select(F.col("id").alias("query_id"), F.col("embedding").alias("_held"), F.col("cell").cast("bigint").alias("_at"))
    near = celled.join(held, (celled["query_id"] == held["query_id"]) & (F.col("_cell") == F.col("_at")), "left").select("_v", "_held")
    distance = V.l2sq(F.col("_v"), F.col("_held"))
    failed = F.count_if(F.coalesce(distance >= tolerance, F.lit(True)))
    return near.agg(F.count(F.lit(1)).alias("n_checked"), failed.alias("n_failed"), F.max(distance).alias("max_distance"))


def zero_distance_matches(train: DataFrame, test: DataFrame) -> DataFrame:
    """Test vectors that also occur in train: leakage by content.

    Rows meet by a hash of the vector and are then compared, so the cost is one
    join by equality. The least id of the equal train rows stands for them; copies
    are reduced to it before the join.
    """
    key = F.xxhash64(F.transform("embedding", lambda x: x.cast("double") + 0.0))  # -0.0 equals 0.0
    seen = usable(train).groupBy(key.alias("_h"), "embedding").agg(F.min("id").alias("id")).withColumnRenamed("embedding", "_e")
    asked = usable(test).select(F.col("id").alias("query_id"), "embedding", key.alias("_h"))
    same = F.col("embedding") == F.col("_e")
    return asked.join(seen, (asked["_h"] == seen["_h"]) & same).select("query_id", "id")
