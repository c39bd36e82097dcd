"""Packing of token ids into sequences by order-preserving dynamic programming."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks
from .tokens import encoder

LENGTH = 1024
#: Costs in tokens of padding, of a cut after a sentence inside a document and of a cut elsewhere in it.
SENTENCE_CUT = 1.0
FREE_CUT = 8.0
#: Cuts inside sentences are tried at multiples of this many tokens.
GRID = 32
#: Lengths below LENGTH that need no padding and are tried; the other powers of two only where they happen to fit.
SHORT = (512, 256, 128)


def plan(points: np.ndarray, penalty: np.ndarray, length: int = LENGTH, short: tuple[int, ...] = SHORT) -> list[int]:
    """Cheapest cuts (the last point is always one) of the stretch from 0 to the last point.

    ``best[j] = penalty[j] + min over i of best[i] + padding(points[j] - points[i])``
    with windows of at most ``length``. Padding is linear in both ends, so the
    minimum over the sliding range of ``i`` is that of ``best[i] + points[i]``,
    kept in a monotone queue; unpadded shorter lengths are looked up.
    """
    at, cost = [0, *points.tolist()], [0.0, *penalty.tolist()]
    index = {p: i for i, p in enumerate(at)}
    best, came, key = [0.0] * len(at), [0] * len(at), [0.0] * len(at)
    queue = deque([0])
    for j in range(1, len(at)):
        p = at[j]
        while at[queue[0]] < p - length:
            queue.popleft()
        i = queue[0]
        least = key[i] + length - p
        for n in short:
            other = index.get(p - n)
            if other is not None and best[other] < least:
                least, i = best[other], other
        best[j], came[j] = least + cost[j], i
        key[j] = k = best[j] + p
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = came[j]
    return cuts[::-1]


@lru_cache
def _sentence_ends(path: str) -> np.ndarray:
    """Which ids end a sentence: those that end in a stop or hold a line break."""
    tokenizer = encoder(path).tokenizer
    names = [(tokenizer.id_to_token(i) or "").removesuffix("</w>") for i in range(tokenizer.get_vocab_size())]
    return np.array([n.endswith((".", "!", "?")) or "Ċ" in n for n in names])


def pack_ids(ids: np.ndarray, bounds: np.ndarray, ends_sentence: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(piece bounds, sequence bounds) of the documents ``ids[bounds[k]:bounds[k + 1]]`` in their order."""
    total = int(bounds[-1])
    cost = np.full(total + 1, np.inf)
    cost[::GRID] = FREE_CUT
    cost[1:][ends_sentence[ids]] = SENTENCE_CUT
    cost[bounds] = 0.0
    points = np.flatnonzero(np.isfinite(cost))[1:]
    sequences = np.array([0, *plan(points, cost[points], length)])
    return np.union1d(sequences, bounds), sequences


def pack(
    docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = 0, length: int = LENGTH
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids`` (little-endian 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``.

    A document is its ids and ``end_id``; a null or empty text is ``end_id``
    alone. Documents keep their order in the table and are packed block by block
    inside each partition, so nothing is shuffled and no task needs more than a
    block; a block is at least one document. Sequence ids are unique, ascending in
    a partition, but not consecutive over partitions. Repeated rows are documents
    of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        coder, ends_sentence = encoder(tokenizer), _sentence_ends(tokenizer)
        for batch in batches:
            for row, data, offsets in text_blocks(batch.column(1)):
                ids, at = coder.encode(data, offsets)
                bounds = at + np.arange(len(at))
                whole = np.full(bounds[-1], end_id, np.uint32)
                inside = np.ones(bounds[-1], bool)
                inside[bounds[1:] - 1] = False
                whole[inside] = ids
                cuts, sequences = pack_ids(whole, bounds, ends_sentence, length)
                starts = cuts[:-1]
                doc = np.searchsorted(bounds, starts, side="right") - 1
                sequence = np.searchsorted(sequences, starts, side="right") - 1
                body = pa.Array.from_buffers(
                    pa.large_binary(), len(starts), [None, pa.py_buffer((4 * cuts).astype(np.int64)), pa.py_buffer(whole.astype("<u4"))]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(at) - 1).take(pa.array(doc)),
                        pa.array(starts - bounds[doc]),
                        pa.array(np.diff(cuts)),
                        body.cast(pa.binary()),
                        pa.array((bounds[doc + 1] - bounds[doc])),
                        pa.array(first + sequence),
                        pa.array(starts - sequences[sequence]),
                    ],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
                first += len(sequences) - 1

    kind = docs.schema[id].dataType.simpleString()
    slim = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
