"""Join of documents on the Jaccard similarity of their word shingles, with Bayesian pruning of candidates."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classes import components, in_company, leader_pairs, unsettled
from .common import SpanHash, keep, mapped, mix, ragged, text_blocks, word_spans

WORDS = 5
SIMILARITY = 0.8
#: MinHash values of a document; BANDS bands of ROWS of them: two texts at 0.8 share a bucket with probability 0.99995.
VALUES, BANDS, ROWS = 128, 25, 5
#: Bytes of texts in a block; members of a bucket meet block by block.
BLOCK_OF_TEXTS = 4 << 20
#: Texts of one class in a block when all its links are counted.
BLOCK_OF_NODES = 512
#: Values that are compared between two looks at the posterior, and the posterior below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-4

_ODD = mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles and the first one of each text. A text of fewer words has one shingle of them all."""
    starts, ends, first = word_spans(data, offsets)
    words = SpanHash(data)(starts, ends)
    counts = np.diff(first)
    own = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(own)])
    place = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], own)
    end = np.repeat(first[1:], own)
    h = np.zeros(at[-1], np.uint64)
    for j in range(WORDS):
        there = place + j < end
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(there, words[np.minimum(place + j, max(len(words) - 1, 0))] if len(words) else 0, np.uint64(j))
    return mix(h), at


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values, one row for each text that has shingles."""
    starts = at[:-1][np.diff(at) > 0]
    out = np.empty((VALUES, len(starts)), np.uint32)
    buffer = np.empty_like(h)
    for k in range(VALUES if len(starts) else 0):
        np.multiply(h, _ODD[2 * k], out=buffer)
        np.add(buffer, _ODD[2 * k + 1], out=buffer)
        np.right_shift(buffer, np.uint64(32), out=buffer)
        out[k] = np.minimum.reduceat(buffer, starts)
    return np.ascontiguousarray(out.T)


def buckets(values: np.ndarray) -> np.ndarray:
    """One hash per band of each row of values."""
    out = np.empty((len(values), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(values), b + 1, np.uint64)
        for j in range(ROWS):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + values[:, b * ROWS + j].astype(np.uint64))
        out[:, b] = h
    return out.view(np.int64)


def least_matches() -> dict[int, int]:
    """For each number of compared values the least number of matches with which a pair goes on.

    With a uniform prior the similarity after m matches of n has the posterior
    Beta(m + 1, n - m + 1), and P(similarity >= s) = P(Binomial(n + 1, s) <= m).
    """
    out, s = {}, SIMILARITY
    for n in range(STEP, VALUES + 1, STEP):
        below = 0.0
        for m in range(n + 1):
            below += comb(n + 1, m) * s**m * (1 - s) ** (n + 1 - m)
            if below >= TOLERANCE:
                out[n] = m
                break
    return out


def _sign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch with bucket hashes (``bands``) and MinHash values (``sig``) of each text; both null without words."""
    for row, data, offsets in text_blocks(batch.column("text")):
        h, at = shingles(data, offsets)
        has = np.diff(at) > 0
        values = signatures(h, at)
        take = pa.array(np.where(has, np.cumsum(has) - 1, 0), mask=~has)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * BANDS), pa.array(buckets(values).ravel()))
        raw = pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer((np.arange(len(values) + 1) * 4 * VALUES).astype(np.int32)), pa.py_buffer(values.astype("<u4"))])
        own = batch.slice(row, len(offsets) - 1)
        yield pa.RecordBatch.from_arrays([*own.columns, bands.take(take), raw.take(take)], [*own.schema.names, "bands", "sig"])


def _sign_only(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """As ``_sign``, with the bucket hashes only."""
    for part in _sign(batch):
        yield part.select(["doc_id", "node", "bands"])


def _prune(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pairs whose posterior stays above the tolerance while more and more values are compared."""
    read = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, VALUES)
    if not batch.num_rows:
        return
    left, right = read("sig_a"), read("sig_b")
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for n, least in least_matches().items():
        matches[alive] += (left[alive, n - STEP : n] == right[alive, n - STEP : n]).sum(1)
        alive = alive[matches[alive] >= least]
    yield batch.select(["a", "b"]).take(pa.array(alive))


def _check(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pairs whose shingle sets have the wanted Jaccard similarity."""
    sets = []
    for c in ("text_a", "text_b"):
        own = []
        for _, data, offsets in text_blocks(batch.column(c)):
            h, at = shingles(data, offsets)
            own += [np.unique(h[i:j]) for i, j in zip(at, at[1:])]
        sets.append(own)
    same = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(*sets)]
    good = [i for i, (n, a, b) in enumerate(zip(same, *sets)) if n >= SIMILARITY * (len(a) + len(b) - n)]
    yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))


def _sets(texts: pa.Array) -> list[np.ndarray]:
    """Distinct shingles of each text, ascending."""
    sets = []
    for _, data, offsets in text_blocks(texts):
        h, at = shingles(data, offsets)
        sets += [np.unique(h[x:y]) for x, y in zip(at, at[1:])]
    return sets


def _links_in_blocks(group: pa.Table) -> pa.Table:
    """Links between two blocks of a bucket that join classes; pairs that are joined already are not compared.

    Each pair is looked at in the first bucket only that it shares: values step by
    step, then the sets themselves, likely pairs first.
    """
    bucket, i, j = (group.column(c)[0].as_py() for c in ("bucket", "i", "j"))
    ids, block = group.column("id").to_numpy(), group.column("block").to_numpy()
    bands = np.array(group.column("bands").to_pylist(), np.int64)
    values = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u4").reshape(-1, VALUES)
    sets = _sets(group.column("text"))
    _, own = np.unique(group.column("class").to_numpy(), return_inverse=True)
    band = int(np.flatnonzero(bands[0] == bucket)[0])
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    out, bounds = [], least_matches()
    for a in left:
        other = right[right > a] if i == j else right
        other = other[own[other] != own[a]]
        other = other[(bands[other, :band] != bands[a, :band]).all(1)]
        matches = np.zeros(len(other), np.int64)
        for n, least in bounds.items():
            matches += (values[other, n - STEP : n] == values[a, n - STEP : n]).sum(1)
            good = matches >= least
            other, matches = other[good], matches[good]
        for b in other[np.argsort(-matches, kind="stable")]:
            if own[a] != own[b]:
                same = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if same >= SIMILARITY * (len(sets[a]) + len(sets[b]) - same):
                    out.append(sorted((int(ids[a]), int(ids[b]))))
                    own[own == own[b]] = own[a]
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _degrees_in_blocks(group: pa.Table) -> pa.Table:
    """Number of links of each text between two blocks of a class; texts without any are left out.

    All pairs whose sizes allow a link are compared by the sets themselves, so none is
    lost: the shingles of one text are marked and counted in all partners at once.
    """
    i, j = (group.column(c)[0].as_py() for c in ("i", "j"))
    ids, block = group.column("id").to_numpy(), group.column("block").to_numpy()
    sets = _sets(group.column("text"))
    sizes = np.array([len(s) for s in sets], np.int64)
    first = np.cumsum(sizes) - sizes
    known, number = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(known), np.int32)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    degree = np.zeros(len(ids), np.int64)
    for a in left:
        other = right[right > a] if i == j else right
        other = other[np.minimum(sizes[other], sizes[a]) >= SIMILARITY * np.maximum(sizes[other], sizes[a])]
        if not len(other):
            continue
        own = number[first[a] : first[a] + sizes[a]]
        marked[own] = 1
        same = np.add.reduceat(marked[ragged(number, first[other], sizes[other])], np.cumsum(sizes[other]) - sizes[other])
        marked[own] = 0
        linked = other[same >= SIMILARITY * (sizes[a] + sizes[other] - same)]
        degree[a] += len(linked)
        degree[linked] += 1
    some = np.flatnonzero(degree)
    return pa.table({"id": pa.array(ids[some], pa.int64()), "n_links": pa.array(degree[some])})


def _degrees(classes: DataFrame, near: DataFrame) -> DataFrame:
    """``id`` and ``n_links`` of every text in ``classes``. Links lie inside classes; two texts of one class are one link."""
    sizes = classes.join(near.select("id", F.octet_length("text").alias("bytes")), "id").groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    sizes = keep(sizes.select("class", "n", F.ceil(F.greatest(F.col("bytes") / BLOCK_OF_TEXTS, F.col("n") / BLOCK_OF_NODES)).cast("int").alias("blocks")))
    two = classes.join(sizes.filter("n = 2"), "class").select("id", F.lit(1).cast("bigint").alias("n_links"))
    dealt = classes.join(sizes.filter("n > 2"), "class").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = dealt.join(near, "id").select("class", "id", "block", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    parts = met.groupBy("class", "i", "j").applyInArrow(_degrees_in_blocks, "id long, n_links long")
    return two.unionByName(parts.groupBy("id").agg(F.sum("n_links").alias("n_links")))


def classify(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``node`` (digest of the text), ``class_id``, ``n_links`` and ``n_same`` of every row.

    Two texts are linked when the sets of their shingles of five words have a
    Jaccard similarity of 0.8 or more; classes are connected texts, named by their
    least id. Equal texts are one node, so copies make no pairs: ``n_same`` counts the
    other rows with the same text, ``n_links`` the number of other texts that the text
    is linked to. Null, empty and blank texts have no shingles: each is a class of its
    own with no copies. Repeated rows are copies.

    Candidates share a bucket. Each is first compared with its bucket's leader; what
    is then still in several classes meets block by block, and no pairs leave a task
    but links that join classes. Links are counted afterwards: all texts of a class
    meet block by block, and tasks give numbers of links, not pairs.
    """
    kind = docs.schema[id].dataType.simpleString()
    slim = docs.select(F.col(f"`{id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    slim = slim.withColumn("node", F.unhex(F.md5("text")))
    signed = mapped(slim.select("doc_id", "node", "text"), _sign_only, f"doc_id {kind}, node binary, bands array<long>")
    signed = keep(signed.withColumn("row_no", F.monotonically_increasing_id()))  # the numbers are written, so they stay
    worded = signed.filter("bands is not null")
    nodes = worded.groupBy("node").agg(F.min(F.struct("doc_id", "row_no")).alias("one"), F.count(F.lit(1)).alias("n"))
    nodes = keep(nodes.select("node", F.col("one.row_no").alias("id"), F.col("one.doc_id").alias("first"), "n"))
    single = nodes.select("id")
    bands = worded.select(F.col("row_no").alias("id"), "bands").join(single, "id").select(F.explode("bands").alias("bucket"), "id")
    members = in_company(bands)
    pairs = leader_pairs(members)
    wanted = members.select("id").distinct()
    # the texts that share a bucket, one row each; their values are computed again rather than shuffled
    named = nodes.join(wanted, "id").select("id", F.col("node").alias("own"), F.col("first").alias("own_id"))
    texts = slim.join(named, (F.col("node") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("own_id")))
    texts = texts.dropDuplicates(["id", "own", "own_id"]).select("id", "text")
    near = keep(mapped(texts, _sign, "id long, text string, bands array<long>, sig binary"))

    def beside(pairs: DataFrame, value: str) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(near.select(F.col("id").alias(side), F.col(value).alias(f"{value}_{side}")), side)
        return pairs

    likely = keep(mapped(beside(pairs, "sig").select("a", "b", "sig_a", "sig_b"), _prune, "a long, b long"))
    direct = keep(mapped(beside(likely, "text").select("a", "b", "text_a", "text_b"), _check, "a long, b long"))
    open_ = unsettled(members, direct).join(near, "id")
    sizes = open_.groupBy("bucket").agg(F.ceil(F.sum(F.octet_length("text")) / BLOCK_OF_TEXTS).cast("int").alias("blocks"))
    dealt = open_.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    meet = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = dealt.select("bucket", "id", "class", "block", "sig", "bands", "text", meet)
    met = met.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    links = direct.unionByName(keep(met.groupBy("bucket", "i", "j").applyInArrow(_links_in_blocks, "a long, b long").distinct()))
    found = keep(components(links))
    degree = keep(_degrees(found, near))
    classed = nodes.join(found, "id", "left").join(degree, "id", "left").withColumn("class", F.coalesce("class", "id"))
    names = classed.groupBy("class").agg(F.min("first").alias("class_id"))
    known = classed.join(names, "class").select("node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("n") - 1).alias("n_same"))
    return signed.select("doc_id", "node").join(known, "node", "left").select(
        "doc_id", "node", F.coalesce("class_id", "doc_id").alias("class_id"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_links", "n_same")]
    )


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without all but one of each class: the one with the least id stays, once. Texts without words all stay."""
    stay = keep(classify(docs, id, text).filter("doc_id <=> class_id").select("node", "doc_id").distinct())
    columns = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    own = docs.select(columns.alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    own = own.withColumn("node", F.unhex(F.md5("t"))).withColumn("blank", ~F.col("t").rlike(r"[^\x20\x09-\x0D]")).drop("t")
    blank = own.filter("blank").select("row.*")
    kept = own.filter("not blank").join(
        stay.select(F.col("node").alias("stay"), F.col("doc_id").alias("stay_id")), (F.col("node") == F.col("stay")) & F.col(f"row.`{id}`").eqNullSafe(F.col("stay_id"))
    )
    return kept.dropDuplicates(["node", "stay_id"]).select("row.*").unionByName(blank)
