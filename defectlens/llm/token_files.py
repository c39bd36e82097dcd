"""Token-id files with directly addressable codes.

An id is cut into bytes. Level 0 holds the lowest byte of every id and a bitmap
that says which ids go on; level 1 holds the next byte of those, and so on. A rank
directory over each bitmap (ones before every 512th bit) gives the place in the
next level, so any id is read from a few bytes without decoding its neighbours.

A file is a run of shards, each followed by one line break that the writer adds.
A shard: magic, number of documents, ids and levels, its length in bytes; document
ids and a bitmap of those that are null; first id of each document and the end; then for each level its number of
bytes, the bytes, the bitmap and the directory. All numbers are little-endian.

Beside the files lies a manifest, a Parquet table with one row for each shard: its file and
place there and the number of ids before it. With it any id of the corpus is found by its position
and read with a few short reads (``read_at``).
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_blocks
from .tokens import encoder

MAGIC = b"DACTOKN2"
RANK_BITS = 512
#: Shards in a file, so that a file stays of a size that one task reads.
SHARDS_PER_FILE = 16
#: Bytes of texts sent to a worker at once, bytes of texts in a shard, and pieces a worker remembers.
BATCH_BYTES, SHARD_BYTES, PIECES = 16 << 20, 2 << 20, 280_000
#: Positions in a cell; a shard lies in a few of them.
CELL = 1 << 20


def encode_levels(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, bitmap, directory) of each level."""
    levels, rest = [], values.astype(np.uint32)
    while len(rest) or not levels:
        more = rest > 0xFF
        padded = np.zeros(-(-len(rest) // RANK_BITS) * RANK_BITS, bool)
        padded[: len(rest)] = more
        ones = padded.reshape(-1, RANK_BITS).sum(1)
        directory = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        levels.append(((rest & 0xFF).astype(np.uint8), np.packbits(padded, bitorder="little"), directory))
        rest = rest[more] >> np.uint32(8)
    return levels


class Shard:
    """One shard of a file: whole documents, or single ids at any place."""

    def __init__(self, raw: memoryview):
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("not a token file")
        n_docs, self.n_ids, n_levels, self.size = np.frombuffer(raw, "<u8", 4, 8).tolist()
        at = 40
        self.doc_ids = np.frombuffer(raw, "<i8", n_docs, at)
        at += 8 * n_docs
        self.no_id = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n_docs // 8), at), count=n_docs, bitorder="little").astype(bool)
        at += -(-n_docs // 8)
        self.starts = np.frombuffer(raw, "<u8", n_docs + 1, at).astype(np.int64)
        at += 8 * (n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            (n,) = np.frombuffer(raw, "<u8", 1, at).tolist()
            blocks = -(-n // RANK_BITS)
            chunk = np.frombuffer(raw, np.uint8, n, at + 8)
            bits = np.frombuffer(raw, np.uint8, blocks * RANK_BITS // 8, at + 8 + n)
            at += 8 + n + len(bits)
            self.levels.append((chunk, bits, np.frombuffer(raw, "<u4", blocks + 1, at)))
            at += 4 * (blocks + 1)

    def get(self, places: np.ndarray) -> np.ndarray:
        """The ids at the given places, read through the directories."""
        places = np.asarray(places, np.int64)
        out = np.zeros(len(places), np.uint32)
        open_ = np.arange(len(places))
        for k, (chunk, bits, directory) in enumerate(self.levels):
            out[open_] |= chunk[places].astype(np.uint32) << np.uint32(8 * k)
            on = (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
            places, open_ = places[on], open_[on]
            block = places // RANK_BITS
            own = bits.reshape(-1, RANK_BITS // 8)[block]
            bit = np.arange(RANK_BITS // 8)[None, :] * 8
            below = np.clip(places[:, None] % RANK_BITS - bit, 0, 8).astype(np.uint16)
            mask = ((np.uint16(1) << below) - 1).astype(np.uint8)
            places = directory[block].astype(np.int64) + np.bitwise_count(own & mask).sum(1, dtype=np.int64)
        return out

    def all(self) -> np.ndarray:
        """Every id of the shard."""
        value = np.empty(0, np.uint32)
        for chunk, bits, _ in reversed(self.levels):
            own = chunk.astype(np.uint32)
            own[np.unpackbits(bits, count=len(chunk), bitorder="little").astype(bool)] |= value << np.uint32(8)
            value = own
        return value


def shard_bytes(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray, no_id: np.ndarray | None = None) -> bytes:
    levels = encode_levels(ids)
    no_id = np.zeros(len(doc_ids), bool) if no_id is None else no_id
    parts = [doc_ids.astype("<i8").tobytes(), np.packbits(no_id, bitorder="little").tobytes(), starts.astype("<u8").tobytes()]
    for chunk, bits, directory in levels:
        parts += [np.array([len(chunk)], "<u8").tobytes(), chunk.tobytes(), bits.tobytes(), directory.tobytes()]
    size = 40 + sum(map(len, parts))
    head = MAGIC + np.array([len(doc_ids), len(ids), len(levels), size], "<u8").tobytes()
    return b"".join([head, *parts])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = 2) -> None:
    """Write the ids of all documents in ascending id order.

    Documents are dealt out by ranges of their id (and a hash of the text, so that
    rows with the same id may lie in several ranges) and sorted inside; the file
    names follow that order. Null texts are empty; a document always has ``end_id``.
    Rows with a null id come first and are read back with a null id. The manifest is
    written last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, PIECES)
        for batch in batches:
            no_id = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            doc_ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for row, data, offsets in text_blocks(batch.column(1), SHARD_BYTES):
                ids, at = coder.encode(data, offsets)
                starts = at + np.arange(len(at))
                whole = np.full(starts[-1], end_id, np.uint32)
                inside = np.ones(starts[-1], bool)
                inside[starts[1:] - 1] = False
                whole[inside] = ids
                raw = shard_bytes(doc_ids[row : row + len(at) - 1], starts, whole, no_id[row : row + len(at) - 1])
                yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["raw"])

    slim = docs.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    tie = F.xxhash64("text")
    ordered = slim.repartitionByRange("id", tie).sortWithinPartitions("id", tie)
    shards = ordered.mapInArrow(run, "raw binary").select(F.col("raw").cast("string").alias("value"))
    with small_batches(docs.sparkSession):
        shards.write.option("maxRecordsPerFile", SHARDS_PER_FILE).text(path)
        _with_bases(_heads(docs.sparkSession, path)).write.parquet(manifest_path(path))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Less memory for what is on its way to the workers while a job runs."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def manifest_path(path: str) -> str:
    return f"{path.rstrip('/')}-manifest"


def shards_of(content: bytes) -> Iterator[tuple[int, Shard]]:
    """(place in the file, shard)."""
    view, at = memoryview(content), 0
    while at < len(view):
        shard = Shard(view[at:])
        yield at, shard
        at += shard.size + 1


def _heads(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``part`` (number of the writing task), ``at`` (place in the file) and ``n`` (ids) of every shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                heads = [(at, s.n_ids) for at, s in shards_of(content.as_buffer())]
                at, n = (pa.array(x, pa.int64()) for x in zip(*heads)) if heads else (pa.array([], pa.int64()),) * 2
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(heads), pa.string()), at, n], ["file", "at", "n"])

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, at long, n long")
    return found.select("file", F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("int").alias("part"), "at", "n")


def _with_bases(heads: DataFrame) -> DataFrame:
    """Also ``base``, the ids in all shards before: added up inside the files of a task first, then over the tasks."""
    rows = Window.unboundedPreceding, -1
    parts = heads.groupBy("part").agg(F.sum("n").alias("n"))
    # one row for each task that wrote
    starts = parts.select("part", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(*rows)), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("file", "at").rowsBetween(*rows)), F.lit(0))
    return heads.withColumn("inside", inside).join(starts, "part").select("file", "at", "n", (F.col("start") + F.col("inside")).alias("base"))


def read_tokens(spark: SparkSession, path: str, ids: Column | None = None) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` of every document in the files.

    Documents are decoded in one pass and get their shard's base from the manifest. A
    column made of the ids (a checksum, say) may be asked for instead of them; it is
    made before the two are joined, so the ids themselves need not be shuffled.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                for at, s in shards_of(content.as_buffer()):
                    ids, n = s.all().astype("<u4"), len(s.doc_ids)
                    body = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((4 * s.starts).astype(np.int32)), pa.py_buffer(ids)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name.as_py()] * n, pa.string()), pa.array([at] * n, pa.int64()), pa.array(s.doc_ids, mask=s.no_id), pa.array(s.starts[:-1]), pa.array(np.diff(s.starts)), body],
                        ["file", "at", "doc_id", "inside", "n_tokens", "ids"],
                    )

    docs = files.mapInArrow(bodies, "file string, at long, doc_id long, inside long, n_tokens long, ids binary")
    docs = docs if ids is None else docs.withColumn("ids", ids)
    bases = read_manifest(spark, path).select("file", "at", "base")
    return docs.join(bases, ["file", "at"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file string, at long, n long, base long").parquet(manifest_path(path))


def _pick(read, at: int, places: np.ndarray) -> np.ndarray:
    """Ids at places of the shard that starts at byte ``at``; ``read(start, length)`` is called for what they need only."""
    n_docs, _, n_levels, _ = np.frombuffer(read(at + 8, 32), "<u8").tolist()
    at += 40 + 8 * n_docs - (-n_docs // 8) + 8 * (n_docs + 1)
    out, open_ = np.zeros(len(places), np.uint32), np.arange(len(places))
    for k in range(n_levels):
        if not len(places):
            break
        (n,) = np.frombuffer(read(at, 8), "<u8").tolist()
        blocks, chunk = -(-n // RANK_BITS), at + 8
        bitmap = chunk + n
        directory = bitmap + blocks * RANK_BITS // 8
        further = np.full(len(places), -1, np.int64)
        for i, place in enumerate(places.tolist()):
            out[open_[i]] |= np.uint32(read(chunk + place, 1)[0] << 8 * k)
            block, bit = divmod(place, RANK_BITS)
            own = int.from_bytes(read(bitmap + block * RANK_BITS // 8, RANK_BITS // 8), "little")
            if own >> bit & 1:
                before = int.from_bytes(read(directory + 4 * block, 4), "little")
                further[i] = before + (own & ((1 << bit) - 1)).bit_count()
        places, open_ = further[further >= 0], open_[further >= 0]
        at = directory + 4 * (blocks + 1)
    return out


def read_at(spark: SparkSession, path: str, positions: DataFrame, position: str = "position") -> DataFrame:
    """``position`` and ``token`` of the wanted positions of the corpus, counted from 0 over all documents in order.

    Positions find their shard in the manifest by cells of equal length; tasks then read a few bytes for each
    of them from the files. Positions outside the corpus and nulls have no row; repeated ones are repeated.
    """
    shards = read_manifest(spark, path).filter("n > 0").withColumn("last", F.col("base") + F.col("n"))
    cells = F.explode(F.sequence(F.floor(F.col("base") / CELL), F.floor((F.col("last") - 1) / CELL))).alias("cell")
    wanted = positions.select(F.col(f"`{position}`").cast("bigint").alias("position")).withColumn("cell", F.floor(F.col("position") / CELL))
    met = wanted.join(shards.select("file", "at", "base", "last", cells), "cell").filter("position >= base and position < last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            rows = batch.to_pandas()
            for file, own in rows.groupby("file"):
                system, name = fs.FileSystem.from_uri(file)
                with system.open_input_file(name) as raw:
                    read = lambda start, length: raw.read_at(length, start)
                    for at, few in own.groupby("at"):
                        token = _pick(read, int(at), (few["position"] - few["base"]).to_numpy(np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(few["position"].to_numpy(np.int64)), pa.array(token.astype(np.int64))], ["position", "token"])

    return met.select("file", "at", "base", "position").mapInArrow(run, "position long, token long")


def shared_path(spark: SparkSession) -> str:
    return f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
