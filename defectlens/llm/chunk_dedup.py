"""Repeated passages across documents by content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SpanHash, keep, mapped, text_blocks, word_spans

#: A word starts a chunk when its gear hash is the least among so many words to both sides.
REACH = 3
#: Words of a passage that counts, of its whole chunks at least, and of a run of chunks from one place at least.
PASSAGE, CORE, RUN = 50, 25, 8

_GEAR = np.random.default_rng(16).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rolling gear hash modulo 2**16 at every byte: ``h = (h << 1) + table[byte]``, from zero at each text's start.

    Sixteen shifts push a byte out, so each value depends on the last 16 bytes of
    its own text only; they are added up by doubling.
    """
    h, k = _GEAR[data], 1
    while k < 16 and len(h):
        older = np.zeros_like(h)
        older[k:] = h[:-k] << np.uint16(k)
        edge = (offsets[:-1, None] + np.arange(k)).ravel()
        older[edge[edge < len(h)]] = 0
        h = h + older
        k *= 2
    return h


def chunk_starts(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indices of the words that start a chunk; every text's first word does.

    The rule looks at nothing but the neighbourhood, so an insertion moves no cut
    beyond it. Equal neighbours (a word repeated over and over) make no cut.
    """
    n = len(starts)
    if not n:
        return np.empty(0, np.int64)
    value = np.full(n, np.iinfo(np.uint16).max, np.int64)
    inside = np.ones(n, bool)
    inside[first[:-1][first[:-1] < n]] = False
    value[inside] = gear(data, offsets)[starts[inside] - 1]
    least = inside.copy()
    for d in range(1, REACH + 1):
        least[d:] &= value[d:] < value[:-d]
        least[:-d] &= value[:-d] <= value[d:]
    least[~inside] = True
    return np.flatnonzero(least)


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """One row per chunk: digest of its words, its document, first word and number of words."""
    for row, data, offsets in text_blocks(batch.column("text")):
        starts, ends, first = word_spans(data, offsets)
        begin = chunk_starts(data, offsets, starts, first)
        if not len(begin):
            continue
        words = SpanHash(data)(starts, ends)
        end = np.append(begin[1:], len(starts))
        text = np.searchsorted(first, begin, side="right") - 1
        digest = SpanHash(words)(begin, end).view(np.int64)
        own = batch.slice(row, len(offsets) - 1)
        take = pa.array(text)
        yield pa.RecordBatch.from_arrays(
            [pa.array(digest), own.column("doc_id").take(take), own.column("h").take(take), pa.array((begin - first[text]).astype(np.int32)), pa.array((end - begin).astype(np.int32))],
            ["digest", "doc_id", "h", "at", "n"],
        )


def _extend(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Regions with the words before and after them that agree with the places they repeat."""

    def words(column: str) -> list[np.ndarray]:
        out = []
        for _, data, offsets in text_blocks(batch.column(column)):
            starts, ends, first = word_spans(data, offsets)
            h = SpanHash(data)(starts, ends)
            out += [h[a:b] for a, b in zip(first, first[1:])]
        return out

    more = []
    rows = zip(words("text"), words("left_text"), words("right_text"), *(batch.column(c).to_pylist() for c in ("start", "end", "left_shift", "right_shift")))
    for own, left, right, start, end, left_shift, right_shift in rows:
        low = high = 0
        while low < PASSAGE and start - low > 0 and start - low - left_shift > 0 and own[start - low - 1] == left[start - low - 1 - left_shift]:
            low += 1
        while high < PASSAGE and end + high < len(own) and end + high - right_shift < len(right) and own[end + high] == right[end + high - right_shift]:
            high += 1
        more.append((start - low, end + high))
    columns = [batch.column("doc_id"), batch.column("h"), pa.array([a for a, _ in more], pa.int32()), pa.array([b for _, b in more], pa.int32()), batch.column("firsts")]
    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "start", "end", "firsts"])


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """Number of words at the beginning of both that agree."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def _widen(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs with all words before and after them that agree with the document they repeat, over chunks of other sources too."""

    def words(column: str) -> list[np.ndarray]:
        out = []
        for _, data, offsets in text_blocks(batch.column(column)):
            starts, ends, first = word_spans(data, offsets)
            h = SpanHash(data)(starts, ends)
            out += [h[a:b] for a, b in zip(first, first[1:])]
        return out

    take, low, high = [], [], []
    for k, (own, other, spans) in enumerate(zip(words("text"), words("source_text"), batch.column("spans").to_pylist())):
        found = set()
        for s in spans:
            start, end, shift = s["start"], s["end"], s["shift"]
            if not any(d == shift and x <= start and end <= y for x, y, d in found):
                x = start - _agreeing(own[:start][::-1], other[: start - shift][::-1])
                found.add((x, end + _agreeing(own[end:], other[end - shift :]), shift))
        for x, y in {(x, y) for x, y, _ in found if y - x >= PASSAGE}:
            take.append(k)
            low.append(x)
            high.append(y)
    rows = pa.array(take, pa.int64())
    yield pa.RecordBatch.from_arrays(
        [batch.column("doc_id").take(rows), batch.column("h").take(rows), pa.array(low, pa.int32()), pa.array(high, pa.int32()), batch.column("firsts").take(rows)], ["doc_id", "h", "start", "end", "firsts"]
    )


def repeated_passages(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``h`` (hash of the text), ``start``, ``end`` (words) and ``firsts`` (ids of the documents that had it before).

    Chunks with equal digests are the same; a chunk's place of least document id
    keeps it. Neighbouring chunks that repeat the same stretch of another document
    form a run, touching runs a region. A region of ``PASSAGE`` words counts; one of
    fewer, but ``CORE``, is lengthened word by word on both sides where the texts
    agree beyond the last whole chunk, and counts if it then has ``PASSAGE`` words.
    Repeats inside one document and shorter ones are no passages. Rows that agree
    in id and text are one document; null and blank texts have no words.
    """
    kind = docs.schema[id].dataType.simpleString()
    slim = docs.select(F.col(f"`{id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    slim = slim.withColumn("h", F.xxhash64("text"))
    chunks = mapped(slim, _chunks, f"digest long, doc_id {kind}, h long, at int, n int")
    # counted and joined: a digest of very many documents is counted before the shuffle and split in the join
    shared = chunks.groupBy("digest").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("digest")
    several = keep(chunks.join(shared, "digest"))
    place = F.struct("doc_id", "h", "at")
    heads = several.groupBy("digest").agg(F.min(place).alias("head"))
    repeats = several.join(heads, "digest").filter(~(F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("h") == F.col("head.h"))))
    repeats = repeats.select("doc_id", "h", "at", "n", F.col("head.doc_id").alias("of"), F.col("head.h").alias("of_h"), (F.col("at") - F.col("head.at")).alias("shift")).distinct()
    line = Window.partitionBy("doc_id", "h").orderBy("at")
    same = (F.lag("of").over(line).eqNullSafe(F.col("of"))) & (F.lag("of_h").over(line) == F.col("of_h")) & (F.lag("shift").over(line) == F.col("shift"))
    goes_on = same & (F.lag(F.col("at") + F.col("n")).over(line) == F.col("at"))
    marked = repeats.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("new").over(line))
    runs = marked.groupBy("doc_id", "h", "run").agg(
        F.min("at").alias("start"), F.max(F.col("at") + F.col("n")).alias("end"), F.min(F.struct("of", "of_h", "shift")).alias("source")
    ).filter(F.col("end") - F.col("start") >= RUN)
    row = Window.partitionBy("doc_id", "h").orderBy("start")
    touching = F.lag("end").over(row) == F.col("start")
    grouped = runs.withColumn("region", F.sum(F.when(touching, 0).otherwise(1)).over(row))
    grouped = keep(grouped)
    regions = grouped.groupBy("doc_id", "h", "region").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min_by("source", "start").alias("left"),
        F.max_by("source", "start").alias("right"),
        F.sort_array(F.collect_set("source.of")).alias("firsts"),
    )
    regions = keep(regions.filter(F.col("end") - F.col("start") >= CORE).drop("region"))
    out = ["doc_id", "h", "start", "end", "firsts"]
    long_enough = regions.filter(F.col("end") - F.col("start") >= PASSAGE).select(out)
    short = regions.filter(F.col("end") - F.col("start") < PASSAGE)
    sides = {"": ("doc_id", "h"), "left_": ("left.of", "left.of_h"), "right_": ("right.of", "right.of_h")}
    wanted = short.select(F.explode(F.array(*[F.struct(F.col(a).alias("doc_id"), F.col(b).alias("h")) for a, b in sides.values()])).alias("w")).select("w.*").distinct()
    match = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["h"] == y["h"])
    texts = keep(slim.join(wanted, match(slim, wanted), "left_semi").dropDuplicates(["doc_id", "h"]))
    joined = short
    for side, (a, b) in sides.items():
        named = texts.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("text").alias(f"{side}text"))
        joined = joined.join(named, F.col(a).eqNullSafe(F.col("d")) & (F.col(b) == F.col("g"))).drop("d", "g")
    joined = joined.select("doc_id", "h", "start", "end", "firsts", F.col("left.shift").alias("left_shift"), F.col("right.shift").alias("right_shift"), "text", "left_text", "right_text")
    lengthened = mapped(joined, _extend, f"doc_id {kind}, h long, start int, end int, firsts array<{kind}>")
    whole = Window.partitionBy("doc_id", "h", "region")
    broken = grouped.withColumn("size", F.max("end").over(whole) - F.min("start").over(whole)).filter(F.col("size") < PASSAGE)
    pairs = broken.groupBy("doc_id", "h", F.col("source.of").alias("of"), F.col("source.of_h").alias("of_h")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", F.col("source.shift").alias("shift")))).alias("spans")
    )
    pairs = keep(pairs.withColumn("firsts", F.array("of")))
    needed = pairs.select("doc_id", "h").unionByName(pairs.select(F.col("of").alias("doc_id"), F.col("of_h").alias("h"))).distinct()
    sources = keep(slim.join(needed, match(slim, needed), "left_semi").dropDuplicates(["doc_id", "h"]))
    for side, (x, y) in {"": ("doc_id", "h"), "source_": ("of", "of_h")}.items():
        named = sources.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("text").alias(f"{side}text"))
        pairs = pairs.join(named, F.col(x).eqNullSafe(F.col("d")) & (F.col(y) == F.col("g"))).drop("d", "g")
    widened = mapped(pairs.select("doc_id", "h", "spans", "firsts", "text", "source_text"), _widen, f"doc_id {kind}, h long, start int, end int, firsts array<{kind}>")
    found = long_enough.unionByName(lengthened.filter(F.col("end") - F.col("start") >= PASSAGE)).unionByName(widened)
    before = Window.partitionBy("doc_id", "h").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id", "h").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    apart = F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True)).cast("int")
    merged = found.withColumn("apart", apart).withColumn("passage", F.sum("apart").over(upto)).groupBy("doc_id", "h", "passage").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("firsts")))).alias("firsts")
    )
    return merged.select(out)


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Texts without the given spans of words, and the white space after them."""
    out = []
    spans = batch.column("spans").to_pylist()
    for row, data, offsets in text_blocks(batch.column("text")):
        starts, _, first = word_spans(data, offsets)
        for i in range(len(offsets) - 1):
            if spans[row + i] is None:
                out.append(batch.column("text")[row + i].as_py())
                continue
            at = np.append(starts[first[i] : first[i + 1]], offsets[i + 1])
            gone, parts, begin = sorted((s["start"], s["end"]) for s in spans[row + i]), [], int(offsets[i])
            for s, e in gone:
                parts.append(data[begin : max(begin, int(at[s]))].tobytes())
                begin = max(begin, int(at[e]))
            out.append(b"".join([*parts, data[begin : offsets[i + 1]].tobytes()]).decode("utf-8", "replace"))
    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names[:-2]), pa.array(out, pa.string())], [*batch.schema.names[:-2], "text"])


def drop_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` of every row, without the passages that an earlier document has; null texts stay null."""
    kind = docs.schema[id].dataType.simpleString()
    spans = repeated_passages(docs, id, text).groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = spans.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "spans")
    own = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    own = own.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = own.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left").select("doc_id", "spans", "text")
    return mapped(joined, _cut, f"doc_id {kind}, text string")
