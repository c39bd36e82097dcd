"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all passages of the corpus.
2. One pass for ``Z = A' A W``, with A the TF-IDF passages and W a random matrix: each
   task adds up its own part, Spark sums the parts. The randomised (Nystrom) form of
   the singular value decomposition then follows from Z and W alone.
3. One pass that projects every window of every document and compares it with the
   benchmark's windows by cosine; candidates are checked by their longest common
   subsequence with the item, and doubtful ones by the item's answer. Items of fewer
   words than the shortest window are found by their rarest words instead: of n words
   with k in the subsequence, one of any n - k + 1 must be there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SpanHash, ragged, text_blocks, word_spans

#: Hashed words, and random directions; as many singular directions are kept.
FEATURES, DIRECTIONS = 8192, 64
#: Words of a passage of the matrix; the lengths of windows by the length of an item, and the words between windows of each length.
PASSAGE, LENGTHS, STRIDES = 32, (16, 32), (4, 4)
#: Windows whose words are looked up at once.
HITS = 20_000
#: Cosine from which a window is a candidate for an item.
COSINE = 0.5
#: Share of an item's words in a common subsequence: contaminated, and contaminated if the answer is there too.
SAME, PARAPHRASE, ANSWER = 0.8, 0.6, 0.8
#: Benchmark bytes that are compared with the corpus in one pass; a larger benchmark takes more passes.
PASS_BYTES = 16 << 20
BLOCK = 1 << 19
SLICES = 64

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True


def _words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, first word of each text and the end) by blocks; words are letters, digits and other scripts in lower case."""
    for row, data, offsets in text_blocks(texts, BLOCK):
        starts, ends, first = word_spans(data, offsets, _INSIDE)
        yield row, SpanHash(LOWER[data])(starts, ends), first


def _feature(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(FEATURES - 1)).astype(np.uint16)


def _cuts(first: np.ndarray, step: int) -> np.ndarray:
    """Starts of the runs of ``step`` words that each text is cut into."""
    counts = -(-np.diff(first) // step)
    at = np.cumsum(counts)
    return np.repeat(first[:-1], counts) + step * (np.arange(int(at[-1]) if len(at) else 0) - np.repeat(at - counts, counts))


def _summed(docs: DataFrame, start: Callable[[], np.ndarray], add: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """Sum over all tasks of the array that ``add`` fills from word hashes and text starts; it has FEATURES rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = start(), False
        for batch in batches:
            for _, words, first in _words(batch.column(0)):
                if len(words):
                    add(total, words, first)
                    any_ = True
        if any_:
            parts = list(total.reshape(SLICES, -1))
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.list_(pa.float64()))], ["slice", "v"])

    parts = docs.select("text").mapInArrow(run, "slice int, v array<double>")
    sums = parts.groupBy("slice").agg(Summarizer.sum(array_to_vector("v")).alias("v")).select("slice", vector_to_array("v").alias("v"))
    out = start().reshape(SLICES, -1)
    for r in sums.toLocalIterator():  # SLICES rows
        out[r.slice] = r.v
    return out.reshape(start().shape)


def frequencies(docs: DataFrame) -> tuple[np.ndarray, float]:
    """In how many passages each feature occurs, and the number of passages."""

    def add(total: np.ndarray, words: np.ndarray, first: np.ndarray) -> None:
        starts = _cuts(first, PASSAGE)
        passage = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words))))
        once = np.unique(passage * FEATURES + _feature(words))
        total[:, 0] += np.bincount(once % FEATURES, minlength=FEATURES)
        total[0, 1] += len(starts)

    sums = _summed(docs, lambda: np.zeros((FEATURES, 2)), add)
    return sums[:, 0], float(sums[0, 1])


def random_directions() -> np.ndarray:
    return np.random.default_rng(20).standard_normal((FEATURES, DIRECTIONS)).astype(np.float32)


def latent_space(docs: DataFrame) -> np.ndarray:
    """Vector of each feature: its inverse document frequency times the leading right singular vectors, each over its squared singular value.

    The first directions tell languages and common words apart and would make all
    windows of a language alike; so divided they count least.
    """
    df, n = frequencies(docs)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32)
    spark = docs.sparkSession
    weights = spark.sparkContext.broadcast(idf)  # FEATURES numbers

    def add(total: np.ndarray, words: np.ndarray, first: np.ndarray) -> None:
        w = weights.value
        if not hasattr(add, "rows"):
            add.rows = np.vstack([random_directions() * w[:, None], np.zeros((1, DIRECTIONS), np.float32)])
        f = _feature(words).astype(np.int64)
        # every text is filled up to whole passages with a feature of zeros
        counts = np.diff(first)
        at = PASSAGE * np.concatenate([[0], np.cumsum(-(-counts // PASSAGE))])
        place = np.arange(len(words)) + np.repeat(at[:-1] - first[:-1], counts)
        filled = np.full(at[-1], FEATURES)
        filled[place] = f
        projected = np.ascontiguousarray(add.rows[filled].reshape(-1, PASSAGE, DIRECTIONS).sum(1).T)
        passage = place // PASSAGE
        for c in range(DIRECTIONS):
            total[:, c] += np.bincount(f, projected[c][passage], FEATURES) * w

    z = _summed(docs, lambda: np.zeros((FEATURES, DIRECTIONS)), add)
    omega = random_directions().astype(np.float64)
    shift = 1e-7 * max(np.linalg.norm(z), 1.0)
    y = z + shift * omega
    core = omega.T @ y
    low = np.linalg.cholesky((core + core.T) / 2)
    u, s, _ = np.linalg.svd(np.linalg.solve(low, y.T).T, full_matrices=False)
    values = np.maximum(s**2 - shift, 0)
    kept = values > 1e-9 * max(values[0], 1e-300)
    scale = np.where(kept, values[0] / np.where(kept, values, 1.0), 0.0)
    return (idf[:, None] * u * scale).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def common_subsequence(item: list[int], other: list[int]) -> int:
    """Length of the longest common subsequence, with one bit per word of the item."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in other:
        if m := masks.get(w):
            u = v & m
            v = (v + u | v - u) & full
    return len(item) - v.bit_count()


class Benchmark:
    """The items of one pass: their words, answers and windows."""

    def __init__(self, texts: list[str], vectors: np.ndarray):
        self.words: list[list[int]] = []
        self.answers: list[list[int]] = []
        for own, out in ((texts, self.words), ([_answer(t) for t in texts], self.answers)):
            for _, words, first in _words(pa.array(own, pa.string())):
                out += [words[a:b].tolist() for a, b in zip(first, first[1:])]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.repeats = np.array([len(w) - len(set(w)) for w in self.words], np.int64)
        self.vocabulary = np.unique(np.array([w for own in self.words for w in own], np.uint64))
        self.holds = np.zeros((len(self.words), len(self.vocabulary) + 1), bool)  # the last column: other words
        for i, own in enumerate(self.words):
            self.holds[i, np.searchsorted(self.vocabulary, np.array(own, np.uint64))] = True
        self.queries: dict[int, np.ndarray] = {}
        self.places: dict[int, np.ndarray] = {}  # item and offset of each query
        for length in LENGTHS:
            places, rows = [], []
            for i, own in enumerate(self.words):
                if len(own) < LENGTHS[0] or _length(len(own)) != length:
                    continue
                starts = sorted({*range(0, max(1, len(own) - length + 1), length), max(0, len(own) - length)})
                for s in starts:
                    f = _feature(np.array(own[s : s + length], np.uint64))
                    places.append((i, s))
                    rows.append(vectors[f].sum(0))
            self.places[length] = np.array(places, np.int64).reshape(-1, 2)
            self.queries[length] = _unit(np.array(rows, np.float32).reshape(-1, DIRECTIONS)).T.copy()

        self.short = np.flatnonzero((self.sizes > 0) & (self.sizes < LENGTHS[0]))
        self.short_words = np.full((len(self.short), LENGTHS[0] - 1), -1)
        for row, i in enumerate(self.short.tolist()):
            self.short_words[row, : self.sizes[i]] = np.searchsorted(self.vocabulary, np.array(self.words[i], np.uint64))
        self.least = np.array([n if n < 5 else next(k for k in range(n + 1) if k / n >= PARAPHRASE) for n in self.sizes[self.short].tolist()], np.int64)
        self.in_short = np.zeros(len(self.vocabulary) + 1, bool)
        self.in_short[self.short_words[self.short_words >= 0]] = True

    def verdict(self, item: int, region: list[int]) -> float:
        """Share of the item in a common subsequence with the region, or 0 if it doesn't count as found."""
        own = self.words[item]
        if len(own) < 5:
            return float(any(region[k : k + len(own)] == own for k in range(len(region) - len(own) + 1)))
        inside = set(own)
        if sum(w in inside for w in region) < PARAPHRASE * len(own):
            return 0.0
        share = common_subsequence(own, region) / len(own)
        if share >= SAME:
            return share
        answer = self.answers[item]
        found = share >= PARAPHRASE and answer and common_subsequence(answer, region) >= ANSWER * len(answer)
        return share if found else 0.0


def _answer(text: str) -> str:
    """The last sentence of an item stands for its answer."""
    parts = [p for p in text.replace("\n", ". ").replace("?", ".").replace("!", ".").split(". ") if p.strip(" .")]
    return parts[-1] if len(parts) > 1 else ""


def _length(n: int) -> int:
    """Length of the windows in which an item of n words is looked for."""
    return max((x for x in LENGTHS if x <= n), default=LENGTHS[0])


def _find_short(items: Benchmark, known: np.ndarray, words: np.ndarray, first: np.ndarray, best: dict[tuple[int, int], float]) -> None:
    """Adds the items of fewer words than a window to ``best``; ``known`` are the words' numbers in the vocabulary."""
    at = np.flatnonzero(items.in_short[known[:-1]])
    if not len(at):
        return
    at = at[np.argsort(known[at], kind="stable")]
    counts = np.bincount(known[at], minlength=len(items.vocabulary) + 1)
    begins = np.cumsum(counts) - counts
    there = items.short_words >= 0
    order = np.argsort(np.where(there, counts[items.short_words], len(words) + 1), axis=1, kind="stable")
    n = items.sizes[items.short]
    row, column = np.nonzero(np.arange(order.shape[1]) < (n - items.least + 1)[:, None])
    column = order[row, column]
    word = items.short_words[row, column]
    # runs of triggers with about HITS occurrences together
    size = counts[word]
    upto = np.cumsum(size)
    cuts = np.searchsorted(upto, np.arange(HITS, int(upto[-1]) + HITS, HITS), side="left") + 1
    tried: set[tuple[int, int]] = set()
    for a, b in zip([0, *cuts], [*cuts, len(word)]):
        of, place = np.repeat(np.arange(a, min(b, len(word))), size[a:b]), ragged(at, begins[word[a:b]], size[a:b])
        for s in range(0, len(place), HITS):
            own, p = of[s : s + HITS], place[s : s + HITS]
            r, begin = row[own], p - column[own]
            text = np.searchsorted(first, p, side="right") - 1
            slack = np.where(n[r] < 5, 0, n[r] // 4 + 4)
            low, high = np.maximum(begin - slack, first[text]), np.minimum(begin + n[r] + slack, first[text + 1])
            spot = low[:, None] + np.arange(int((high - low).max()))
            inside = known[np.where(spot < high[:, None], spot, len(words))]
            enough = np.flatnonzero(items.holds[items.short[r][:, None], inside].sum(1) >= items.least[r])
            for t, i, x, y in zip(text[enough].tolist(), items.short[r[enough]].tolist(), low[enough].tolist(), high[enough].tolist()):
                if best.get((t, i), 0.0) == 1.0 or (i, x) in tried:
                    continue
                tried.add((i, x))
                share = items.verdict(i, words[x:y].tolist())
                if share > best.get((t, i), 0.0):
                    best[t, i] = share


def _find(items: Benchmark, vectors: np.ndarray, words: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], float]:
    """(text, item) -> share, over the texts of one block."""
    starts = _cuts(first, STRIDES[0])
    if not len(starts):
        return {}
    text = np.searchsorted(first, starts, side="right") - 1
    known = np.searchsorted(items.vocabulary, words)
    known[known == len(items.vocabulary)] = 0
    known = np.where(items.vocabulary[known] == words, known, len(items.vocabulary)) if len(items.vocabulary) else np.zeros(len(words), np.int64)
    known = np.append(known, len(items.vocabulary))
    # texts are filled up to whole strides with zeros
    counts = np.diff(first)
    at = STRIDES[0] * np.concatenate([[0], np.cumsum(-(-counts // STRIDES[0]))])
    filled = np.zeros((at[-1], vectors.shape[1]), np.float32)
    filled[np.arange(len(words)) + np.repeat(at[:-1] - first[:-1], counts)] = vectors[_feature(words)]
    sums = filled.reshape(-1, STRIDES[0], vectors.shape[1]).sum(1)
    best: dict[tuple[int, int], float] = {}
    _find_short(items, known, words, first, best)
    tried: set[tuple[int, int, int]] = set()
    window, covered = sums.copy(), 1
    for length, stride in zip(LENGTHS, STRIDES):
        for k in range(covered, length // STRIDES[0]):
            same = text[k:] == text[:-k] if k < len(text) else np.zeros(0, bool)
            window[: len(same)] += sums[k:] * same[:, None]
        covered = length // STRIDES[0]
        places = items.places[length]
        if not len(places):
            continue
        taken = np.flatnonzero((starts - first[text]) % stride == 0)
        hit, query = np.nonzero(_unit(window[taken]) @ items.queries[length] >= COSINE)
        hit = taken[hit]
        around = np.arange(-stride, length + stride)
        for s in range(0, len(hit), HITS):
            # few candidates have enough of the item's words in and around the window
            h, q = hit[s : s + HITS], query[s : s + HITS]
            item = places[q, 0]
            at = starts[h, None] + around
            at = np.where((at >= first[text[h], None]) & (at < first[text[h] + 1, None]), at, len(words))
            there, least = known[at], PARAPHRASE * np.minimum(length, items.sizes[item])
            held = items.holds[item[:, None], there]
            enough = np.flatnonzero(held.sum(1) >= least)
            # a word counts as often only as the item repeats words
            own = np.sort(np.where(held[enough], there[enough], -1), axis=1)
            distinct = (own[:, 1:] > own[:, :-1]).sum(1) + (own[:, 0] >= 0)
            enough = enough[distinct + items.repeats[item[enough]] >= least[enough]]
            for g, i, offset in zip(h[enough].tolist(), item[enough].tolist(), places[q[enough], 1].tolist()):
                t, n = int(text[g]), int(items.sizes[i])
                begin = (int(starts[g]) - offset) // 8 * 8
                if best.get((t, i), 0.0) == 1.0 or (t, i, begin) in tried:
                    continue
                tried.add((t, i, begin))
                slack = n // 4 + 4
                region = words[max(int(first[t]), begin - slack) : min(int(first[t + 1]), begin + 8 + n + slack)]
                share = items.verdict(i, region.tolist())
                if share > best.get((t, i), 0.0):
                    best[t, i] = share
    return best


def _passes(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str) -> Iterator[tuple[object, object]]:
    """For each pass over the documents the items of the pass (a broadcast Arrow table) and the latent space (broadcast)."""
    items = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text")).filter("text <> ''")
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-n_bytes // PASS_BYTES)
    if not passes:
        return
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(latent_space(docs.select(F.col(f"`{text}`").alias("text"))))
    for p in range(passes):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(passes)) == p) if passes > 1 else items
        yield context.broadcast(part.toArrow()), vectors  # about PASS_BYTES


def find_leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id``, ``item_id`` and ``share`` (of the item's words) for every document that holds an item.

    An item counts as held when a common subsequence with a stretch of its own
    length and a little more has 0.8 of its words, or 0.6 if its answer (its last
    sentence) is there as well. Items of fewer than five words must occur as they
    are. Null and empty texts hold nothing, null and empty items are never held.
    Repeated rows are judged one by one; repeated items are reported one by one.
    """
    kind, item_kind = docs.schema[id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    slim = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    out = slim.select("doc_id", F.lit(None).cast(item_kind).alias("item_id"), F.lit(None).cast("double").alias("share")).filter("false")
    for held, vectors in _passes(docs, benchmark, text, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], held=held, vectors=vectors) -> Iterator[pa.RecordBatch]:
            table = held.value
            names = table.column("item_id").combine_chunks()
            known = Benchmark(table.column("text").to_pylist(), vectors.value)
            for batch in batches:
                for row, words, first in _words(batch.column(1)):
                    best = _find(known, vectors.value, words, first)
                    rows = pa.array([row + t for t, _ in best], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), names.take(pa.array([i for _, i in best], pa.int64())), pa.array(list(best.values()), pa.float64())],
                        ["doc_id", "item_id", "share"],
                    )

        out = out.unionByName(slim.mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, share double"))
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows that hold no item, in their own columns. Each row is judged where it lies, so nothing is shuffled."""
    out, place = docs, docs.columns.index(text)
    for held, vectors in _passes(docs, benchmark, text, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], held=held, vectors=vectors) -> Iterator[pa.RecordBatch]:
            known = Benchmark(held.value.column("text").to_pylist(), vectors.value)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for row, words, first in _words(batch.column(place)):
                    clean[[row + t for t, _ in _find(known, vectors.value, words, first)]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
