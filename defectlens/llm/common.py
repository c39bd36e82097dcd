"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ranks import ensure_checkpoint_dir
from ..ship import ship_package

#: Bytes of text that are worked on at once inside a task; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Base of the rolling polynomial hash, odd, so that it can be inverted modulo 2**64.
BASE = 0x9E3779B97F4A7C15
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def ready(spark: SparkSession) -> None:
    """Make the package importable in the workers and the shared folder known."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session that holds while the body runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def keep(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, so lost executors cost no recomputation.

    What was shuffled for it is deleted at once; otherwise it would stay until the driver's next collection of garbage.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", codec).parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Delete what ``keep`` wrote, once nothing reads it any more."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(conf).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over every Arrow batch of every partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def text_blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts; null texts are empty."""
    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
    if not len(texts):
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, at, body = texts.buffers()
    offsets = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        low, high = offsets[row], offsets[end]
        yield row, data[low:high], offsets[row : end + 1] - low
        row = end


class SpanHash:
    """64-bit hashes of byte spans of one block in constant time each, by prefix sums of a polynomial."""

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._powers) < n:
            for name, base in (("_powers", BASE), ("_inverse", pow(BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))

    def __init__(self, values: np.ndarray):
        self._grow(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        terms = values.astype(np.uint64)
        terms += np.uint64(1)
        terms *= self._powers[: len(values)]
        np.cumsum(terms, out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.sums[ends] - self.sums[starts]
        h *= self._inverse[starts]
        return mix(h ^ (ends - starts).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finisher that spreads every input bit over the word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_table() -> tuple[np.ndarray, np.ndarray]:
    inside = np.ones(256, bool)
    inside[list(WHITE.encode())] = False
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return inside, lower


INSIDE, LOWER = _word_table()


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = INSIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` bytes that do not cross texts, and the first word of each text."""
    is_word = inside[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a text's first byte starts anew
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | first[:-1]))
    last = np.empty(len(data), bool)
    if len(data):
        last[-1] = True
        last[:-1] = ~is_word[1:] | first[1:-1]
    ends = np.flatnonzero(is_word & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``values[s : s + n]`` over the given starts and lengths."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    return values[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]
