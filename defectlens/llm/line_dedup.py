"""Fuzzy line deduplication over all documents.

Lines, copies, buckets, classes and results are DataFrame work. Signatures and the
comparison of lines run in Arrow batches: a form in DataFrame functions only took ten times
the time that is allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .classes import components, leader_pairs, unsettled
from .common import SpanHash, discard, keep, mapped, mix, text_blocks

#: Lines are equal in kind when the sets of their shingles of so many characters have this Jaccard similarity or more.
SHINGLE = 5
SIMILARITY = 0.8
#: Signatures are of the same shingles. Two lines at the limit share a bucket with probability 0.9983, at 0.82 with 0.9993.
BANDS, ROWS = 16, 5
VALUES = BANDS * ROWS
#: Equal values with which a pair is compared in full: a pair at the limit has fewer with a probability of 1e-5.
LIKELY = 47
#: Lines and bytes of lines in a block; members of a bucket that the leaders leave open meet block by block.
BLOCK_OF_LINES, BLOCK_OF_BYTES = 2048, 4 << 20
#: Members of a bucket that meet as pairs, which are at most so many times the members.
FEW = 32
#: Bytes of lines that are hashed at once: all the values of a block stay in the processor's cache.
HASHED_BYTES = 256 << 10

_ODD = (mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)


def normal(text: Column) -> Column:
    """The form in which lines are compared: lower case, white space as one space, trimmed at both ends of a line later.

    Whole texts are put into this form before they are split: the expressions cost more by the call than by the byte.
    """
    low = F.lower(text)
    plain = F.when(low.rlike("[\t\x0b\x0c\r]"), F.translate(low, "\t\x0b\x0c\r", "    ")).otherwise(low)
    return F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, "  +", " ")).otherwise(plain)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of five characters of each line, and the first of each line; a shorter line is its own shingle."""
    chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first = np.searchsorted(chars, offsets)
    own = np.maximum(np.diff(first) - SHINGLE + 1, np.minimum(np.diff(first), 1))
    at = np.concatenate([[0], np.cumsum(own)])
    place = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], own)
    end = np.minimum(place + SHINGLE, np.repeat(first[1:], own))
    return SpanHash(data)(chars[place], chars[end]), at


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values, cut to 16 bits, one row for each line."""
    out = np.empty((VALUES, len(at) - 1), np.uint16)
    narrow = (h >> np.uint64(32)).astype(np.uint32)
    buffer = np.empty_like(narrow)
    for k in range(VALUES if len(narrow) else 0):
        np.multiply(narrow, _ODD[2 * k] | np.uint32(1), out=buffer)
        np.add(buffer, _ODD[2 * k + 1], out=buffer)
        least = np.minimum.reduceat(buffer, at[:-1])
        out[k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)  # the least values have empty high bits
    return np.ascontiguousarray(out.T)


def _bands(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``id`` and bucket hashes (``bands``) of each line."""
    for row, data, offsets in text_blocks(batch.column("norm"), HASHED_BYTES):
        values = signatures(*shingles(data, offsets)).astype(np.uint64)
        out = np.empty((len(values), BANDS), np.uint64)
        for b in range(BANDS):
            h = np.full(len(values), b + 1, np.uint64)
            for j in range(ROWS):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + values[:, b * ROWS + j])
            out[:, b] = h
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * BANDS), pa.array(out.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("id").slice(row, len(values)), lists], ["id", "bands"])


def _sign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch with the signature of each line (``sig``)."""
    for row, data, offsets in text_blocks(batch.column("norm"), HASHED_BYTES):
        values = signatures(*shingles(data, offsets))
        raw = pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer((np.arange(len(values) + 1) * 2 * VALUES).astype(np.int32)), pa.py_buffer(values.astype("<u2"))])
        own = batch.slice(row, len(offsets) - 1)
        yield pa.RecordBatch.from_arrays([*own.columns, raw], [*own.schema.names, "sig"])


def _values(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, VALUES)


def _sets(lines: pa.Array) -> list[np.ndarray]:
    """Distinct shingles of each line, ascending."""
    sets = []
    for _, data, offsets in text_blocks(lines, HASHED_BYTES):
        h, at = shingles(data, offsets)
        sets += [np.unique(h[x:y]) for x, y in zip(at, at[1:])]
    return sets


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have the wanted Jaccard similarity."""
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same >= SIMILARITY * (len(a) + len(b) - same)


def _prune(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if batch.num_rows:
        same = (_values(batch.column("sig_a")) == _values(batch.column("sig_b"))).sum(1)
        yield batch.select(["a", "b"]).take(pa.array(np.flatnonzero(same >= LIKELY)))


def _check(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    pairs = zip(_sets(batch.column("norm_a")), _sets(batch.column("norm_b")))
    yield batch.select(["a", "b"]).take(pa.array([i for i, (x, y) in enumerate(pairs) if _alike(x, y)], pa.int64()))


def _links_in_blocks(group: pa.Table) -> pa.Table:
    """Links between two blocks of a bucket that join classes; what is joined already is not compared.

    Values are compared for slices of the block at once; shingle sets are made only for lines of pairs that have enough equal values.
    """
    i, j = (group.column(c)[0].as_py() for c in ("i", "j"))
    ids, block = group.column("id").to_numpy(), group.column("block").to_numpy()
    values = _values(group.column("sig"))
    _, own = np.unique(group.column("class").to_numpy(), return_inverse=True)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    step = max(1, BLOCK_OF_BYTES // (VALUES * max(1, len(right))))
    sets: dict[int, np.ndarray] = {}
    out = []
    for k in range(0, len(left), step):
        rows = left[k : k + step]
        same = (values[rows][:, None] == values[right][None]).sum(2, dtype=np.uint8)
        good = (same >= LIKELY) & (own[rows][:, None] != own[right][None])
        if i == j:
            good &= rows[:, None] < right[None]
        x, y = np.nonzero(good)
        new = [r for r in np.unique(np.concatenate([rows[x], right[y]])).tolist() if r not in sets]
        if new:
            sets.update(zip(new, _sets(group.column("norm").take(pa.array(new)))))
        for at in np.argsort(-same[x, y].astype(np.int64), kind="stable"):  # likely pairs first
            a, b = int(rows[x[at]]), int(right[y[at]])
            if own[a] != own[b] and _alike(sets[a], sets[b]):
                out.append(sorted((int(ids[a]), int(ids[b]))))
                own[own == own[b]] = own[a]
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _rows(docs: DataFrame, id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{id}`").alias("doc_id"), F.unhex(F.md5(t)).alias("node"), F.split(t, "\n").alias("lines"))


def _occurrences(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``doc_id``, ``node``, ``pos`` and ``norm`` of each line that is not blank."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = docs.select(F.col(f"`{id}`").alias("doc_id"), F.unhex(F.md5(t)).alias("node"), normal(t).alias("low"))
    lines = own.select("doc_id", "node", F.posexplode(F.split("low", "\n")).alias("pos", "line"))
    return lines.select("doc_id", "node", "pos", F.btrim("line").alias("norm")).filter("norm <> ''")


def classify_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(distinct lines with ``id``, ``key`` (digest of the line) and ``n``, kept; classes of the lines that have links).

    Lines that share a bucket are compared with its leader; what is then still in several classes is compared in
    full: small buckets as pairs, the others block by block. Values are compared before lines are moved, and no pairs
    leave a block but links that join classes.
    """
    distinct = _occurrences(docs, id, text).groupBy("norm").agg(F.count(F.lit(1)).alias("n"))
    # the numbers are written, so they stay
    lines = keep(distinct.withColumn("id", F.monotonically_increasing_id()), "zstd")
    bands = mapped(lines.select("id", "norm"), _bands, "id long, bands array<long>").select(F.explode("bands").alias("bucket"), "id")
    members = keep(bands.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("bucket"))).filter("n > 1"))
    # the lines that share a bucket; their values are computed again rather than written for all lines
    wanted = keep(members.select("id").distinct())
    signed = keep(mapped(lines.join(wanted, "id").select("id", "norm"), _sign, "id long, norm string, sig binary"), "zstd")
    numbers = keep(lines.select("id", F.unhex(F.md5("norm")).alias("key"), "n"))
    discard(lines, wanted)

    def beside(pairs: DataFrame, value: str) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(signed.select(F.col("id").alias(side), F.col(value).alias(f"{value}_{side}")), side)
        return pairs.select("a", "b", f"{value}_a", f"{value}_b")

    def linked(pairs: DataFrame) -> DataFrame:
        likely = keep(mapped(beside(pairs, "sig"), _prune, "a long, b long"))
        links = keep(mapped(beside(likely, "norm"), _check, "a long, b long"))
        discard(pairs, likely)
        return links

    direct = linked(leader_pairs(members))
    open_ = unsettled(members, direct)
    discard(members)
    counted = keep(open_.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("bucket"))))
    discard(open_)
    few = counted.filter(F.col("n") <= FEW)
    other = few.select("bucket", F.col("id").alias("b"), F.col("class").alias("of"))
    pairs = few.join(other, "bucket").filter("id < b and class <> of").select(F.col("id").alias("a"), "b").distinct()
    near = linked(keep(pairs))
    left = keep(counted.filter(F.col("n") > FEW).drop("n").join(signed, "id"))
    discard(counted, signed)
    bytes_ = F.sum(F.octet_length("norm") + 2 * VALUES)
    sizes = left.groupBy("bucket").agg(F.ceil(F.greatest(bytes_ / BLOCK_OF_BYTES, F.count(F.lit(1)) / BLOCK_OF_LINES)).cast("int").alias("blocks"))
    # a bucket of several blocks is one of thousands of lines, so these are few
    dealt = left.join(F.broadcast(sizes.filter("blocks > 1")), "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = dealt.select("bucket", "id", "class", "block", "sig", "norm", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    rest = met.groupBy("bucket", "i", "j").applyInArrow(_links_in_blocks, "a long, b long").distinct()
    found = components(direct.unionByName(near).unionByName(rest))
    discard(left, near, direct)
    return numbers, found


def dropped_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``node`` (digest of the text) and ``dropped`` (ascending line numbers from 0) of documents that lose lines.

    Of each class of equal or similar lines the first stays, by document id and line
    number. Blank lines take no part. Rows that agree in id and text are one
    document and get the same answer; null texts are empty.
    """
    numbers, found = classify_lines(docs, id, text)
    heads = numbers.join(found, "id", "left").filter("n > 1 or class is not null")
    heads = keep(heads.select("key", F.coalesce("class", "id").alias("class")))
    discard(numbers)
    where = _occurrences(docs, id, text).select(F.unhex(F.md5("norm")).alias("key"), F.struct("doc_id", "node", "pos").alias("place"))
    placed = keep(where.join(heads, "key").select("class", "place"))
    stays = placed.groupBy("class").agg(F.min("place").alias("stays"))
    gone = placed.join(stays, "class").filter(~F.col("place").eqNullSafe(F.col("stays")))
    return gone.select("place.*").distinct().groupBy("doc_id", "node").agg(F.sort_array(F.collect_list("pos")).alias("dropped"))


def line_report(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_lines`` and ``dropped`` of every row."""
    own = _rows(docs, id, text).select("doc_id", "node", F.size("lines").cast("bigint").alias("n_lines"))
    gone = dropped_lines(docs, id, text).select(F.col("doc_id").alias("d"), F.col("node").alias("m"), "dropped")
    joined = own.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("node") == F.col("m")), "left")
    return joined.select("doc_id", "n_lines", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def drop_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents in their own columns, without the dropped lines; texts that lose none stay as they are, null ones too."""
    gone = dropped_lines(docs, id, text).select(F.col("doc_id").alias("d"), F.col("node").alias("m"), "dropped")
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    own = docs.select(columns.alias("row"), F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))).alias("node"))
    joined = own.join(gone, F.col(f"row.`{id}`").eqNullSafe(F.col("d")) & (F.col("node") == F.col("m")), "left")
    # runs of lines between the dropped ones, so that long texts cost no search per line
    cut = joined.select("row", "dropped", F.split(F.col(f"row.`{text}`"), "\n").alias("lines"))
    ends = F.array_append("dropped", F.size("lines"))

    def run(end: Column, k: Column) -> Column:
        begin = F.when(k == 0, F.lit(0)).otherwise(F.get(F.col("dropped"), k - 1) + 1)
        return F.slice(F.col("lines"), begin + 1, end - begin)

    rest = F.array_join(F.flatten(F.transform(ends, run)), "\n")
    edited = F.when(F.col("dropped").isNull(), F.col(f"row.`{text}`")).otherwise(rest)
    return cut.withColumn("edited", edited).select(*[F.col("edited").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])
