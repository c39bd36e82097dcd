"""Alignment of two tokenizers over the same bytes.

Both token sequences of a text are complete before they are compared. Where both end
at the same byte, before a token that is marked as starting with a space in both, lies an
anchor; anchors cut a text into windows of token ids, most of them a word. What a window's
ids link and how they group depends on the ids alone, so it is worked out once per worker
and remembered by the two id tuples.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, keep, ragged, text_blocks
from .token_files import small_batches
from .tokens import Encoder

#: Ids of windows a worker remembers before it starts anew, ids up to which a window is remembered, and pieces of either tokenizer.
MEMO_IDS = 1_000_000
PIECES = 300_000
LONG_WINDOW = 64
#: Links that are sent to every executor at most: those in most documents. The others are joined.
SENT_LINKS = 1_000_000
#: Bytes of text worked on at once.
BLOCK = 1 << 20
_SPACE = 32


class WordPieces(Encoder):
    """Ids of a ``sentencepiece`` file for texts that have been given a space in front.

    No piece of the vocabulary crosses from a word into the space after it (which is
    checked), so every run of spaces with what follows it is encoded once per worker.
    Texts with U+2581 itself may differ; their bytes can't be told from spaces anyway.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("a piece of the vocabulary crosses a space")
        self.space = names.index("▁")
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self._forget()

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (data[1:] == _SPACE) & (data[:-1] != _SPACE)
        cut[offsets] = True
        return np.flatnonzero(cut[: len(data)])

    def _learn(self, pieces: list[bytes]) -> None:
        own = self.model.encode([p[1:].decode() for p in pieces], num_threads=1)
        self._remember(pieces, [i or [self.space] for i in own])


class PlainText(Encoder):
    """Ids of a ``tokenizers`` file, strings of its special tokens being ordinary text, and the bytes of each id."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        # Byte-level files show the visible characters of Latin-1 as they are and the other bytes from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        size = self.tokenizer.get_vocab_size()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.bytes = [bytes(byte[c] for c in n) if all(c in byte for c in n) else n.encode() for n in names]


class Side:
    """One tokenizer of a worker with the bytes of its ids in one table."""

    def __init__(self, coder: Encoder):
        self.coder = coder
        self.lengths = np.fromiter(map(len, coder.bytes), np.int64, len(coder.bytes))
        self.at = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(coder.bytes) + b"\0", np.uint8)
        self.spaced = (self.flat[self.at] == _SPACE) & (self.lengths > 0)

    def same(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Texts whose ids stand for exactly their bytes."""
        lengths = self.lengths[ids]
        total = np.concatenate([[0], np.cumsum(lengths)])[first]
        good = np.diff(total) == np.diff(offsets)
        whole = np.repeat(good, np.diff(first))
        made = ragged(self.flat, self.at[ids[whole]], lengths[whole])
        given = data[np.repeat(good, np.diff(offsets))]
        wrong = np.concatenate([[0], np.cumsum(made != given)])
        ends = np.concatenate([[0], np.cumsum(np.where(good, np.diff(offsets), 0))])
        return good & (wrong[ends[1:]] == wrong[ends[:-1]])


def _fragments(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of every id's number before ``,``, ``|`` and ``;``, with starts and lengths by ``3 * id + mark``."""
    texts = [str(i).encode() + mark for i in range(size) for mark in (b",", b"|", b";")]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths, lengths


class Windows:
    """Alignments of windows, remembered by their two id tuples."""

    def __init__(self, a: Side, b: Side):
        self.lengths = a.lengths, b.lengths
        self.fragments = _fragments(max(map(len, self.lengths)))
        self.forget()

    def forget(self) -> None:
        self.known: dict[tuple[tuple[int, ...], tuple[int, ...]], int] = {}
        self.groups: list[str] = []
        self.n_groups: list[int] = []
        self.links = np.empty(1 << 16, np.int64)
        self.ends = np.zeros(1, np.int64)
        self.size = 0

    def align(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(group texts, numbers of groups, numbers of links, all links) of windows whose ids lie one after the other.

        A link is ``a << 32 | b``, one for each pair of tokens that overlap: every stretch of bytes between two
        neighbouring ends belongs to one such pair.
        """
        end_a, end_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        ends = np.union1d(end_a, end_b)
        in_a, in_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        links = (a[in_a].astype(np.int64) << 32) | b[in_b].astype(np.int64)
        window = end_a[np.cumsum(n_a) - 1]
        sizes = np.diff(np.searchsorted(ends, window, side="right"), prepend=0)
        both = (end_a[in_a] == ends) & (end_b[in_b] == ends)
        last_a, last_b = in_a[both], in_b[both]  # the last tokens of every group
        groups = np.diff(np.cumsum(both)[np.searchsorted(ends, window)], prepend=0)
        # in the text A's tokens of a group come before B's
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[last_a], mark_b[last_b] = 1, 2
        place_a = np.arange(len(a)) + np.repeat(np.append(0, last_b[:-1] + 1), np.diff(last_a, prepend=-1))
        place_b = np.arange(len(b)) + np.repeat(last_a + 1, np.diff(last_b, prepend=-1))
        order = np.empty(len(a) + len(b), np.int64)
        order[place_a], order[place_b] = 3 * a.astype(np.int64) + mark_a, 3 * b.astype(np.int64) + mark_b
        flat, at, lengths = self.fragments
        text = ragged(flat, at[order], lengths[order]).tobytes().decode()
        stops = np.cumsum(lengths[order])[np.cumsum(n_a + n_b) - 1].tolist()
        return [text[i : j - 1] for i, j in zip([0, *stops], stops)], groups, sizes, links

    def numbers(self, a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int, int, int]]) -> np.ndarray:
        """Numbers of the windows at ``bounds`` in the two id arrays; those not known yet are aligned together."""
        list_a, list_b = a.tolist(), b.tolist()
        out, new = [], []
        known, n = self.known, len(self.groups)
        for bound in bounds:
            i, j, k, m = bound
            key = tuple(list_a[i:j]), tuple(list_b[k:m])
            at = known.get(key)
            if at is None:
                at = n + len(new)
                new.append(bound)
                if j - i + m - k <= LONG_WINDOW:
                    known[key] = at
            out.append(at)
        if new:
            from_a, to_a, from_b, to_b = np.array(new, np.int64).T
            n_a, n_b = to_a - from_a, to_b - from_b
            texts, groups, sizes, links = self.align(ragged(a, from_a, n_a), ragged(b, from_b, n_b), n_a, n_b)
            self.groups += texts
            self.n_groups += groups.tolist()
            self.size += int(n_a.sum() + n_b.sum())
            used = int(self.ends[-1])
            if used + len(links) > len(self.links):
                self.links = np.resize(self.links, 2 * (used + len(links)))
            self.links[used : used + len(links)] = links
            self.ends = np.concatenate([self.ends, used + np.cumsum(sizes)])
        return np.array(out, np.int64)


def _cuts(a: Side, b: Side, ids_a: np.ndarray, ids_b: np.ndarray, text_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the windows in A's and in B's tokens; both sides stand for the same bytes."""
    end_a, end_b = np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b])
    shared, at_a, at_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
    next_a, next_b = np.append(a.spaced[ids_a][1:], True), np.append(b.spaced[ids_b][1:], True)
    anchor = (next_a[at_a] & next_b[at_b]) | np.isin(shared, text_ends, assume_unique=True)
    return at_a[anchor] + 1, at_b[anchor] + 1


class Aligner:
    """What a worker keeps: both tokenizers and the windows it has seen."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Side(PlainText(path_a)), Side(WordPieces(path_b))
        self.a.coder.most = self.b.coder.most = PIECES
        self.windows = Windows(self.a, self.b)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
        """(n_a, n_b, n_groups, group text, linked pairs, how often each) of each text of a block; None without tokens.

        Every text starts with a space that is no part of it; a text of that space alone has no tokens.
        """
        ids_a, at_a = self.a.coder.encode(data, offsets)
        ids_b, at_b = self.b.coder.encode(data, offsets)
        good = np.diff(offsets) > 1
        good &= self.a.same(data, offsets, ids_a, at_a)
        good &= self.b.same(data, offsets, ids_b, at_b)
        n_a, n_b = np.diff(at_a)[good], np.diff(at_b)[good]
        ids_a, ids_b = ids_a[np.repeat(good, np.diff(at_a))], ids_b[np.repeat(good, np.diff(at_b))]
        if self.windows.size > MEMO_IDS:
            self.windows.forget()
        if len(ids_a):
            text_ends = np.cumsum(np.diff(offsets)[good])
            cut_a, cut_b = _cuts(self.a, self.b, ids_a, ids_b, text_ends)
            from_a, from_b = np.append(0, cut_a[:-1]), np.append(0, cut_b[:-1])
            # equal windows of the block are looked up once
            key = SpanHash(ids_a)(from_a, cut_a) * np.uint64(31) + SpanHash(ids_b)(from_b, cut_b)
            codes, distinct = pd.factorize(key)
            first = np.empty(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            bounds = list(zip(from_a[first].tolist(), cut_a[first].tolist(), from_b[first].tolist(), cut_b[first].tolist()))
            number = self.windows.numbers(ids_a, ids_b, bounds)[codes]
            last = np.searchsorted(cut_a, np.cumsum(n_a))  # the window that ends a text
            w = self.windows
            sizes = w.ends[number + 1] - w.ends[number]
            links = ragged(w.links, w.ends[number], sizes)
            link_ends = np.cumsum(sizes)[last].tolist()
            numbers, last = number.tolist(), last.tolist()
        k = begin = link = 0
        for ok in good.tolist():
            if not ok:
                yield None
                continue
            own = numbers[begin : last[k] + 1]
            pairs, often = np.unique(links[link : link_ends[k]], return_counts=True)
            begin, link = last[k] + 1, link_ends[k]
            yield int(n_a[k]), int(n_b[k]), sum(map(w.n_groups.__getitem__, own)), ";".join(map(w.groups.__getitem__, own)), pairs, often
            k += 1


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]


def align(docs: DataFrame, path_a: str, path_b: str, carried: list[str], text: str = "text", spans: bool = False) -> DataFrame:
    """``row`` (the carried columns), ``n_a``, ``n_b``, ``n_groups``, ``groups_sha256``, ``pairs`` and ``often`` of every row.

    A group is a shortest run of tokens of A and of B that ends at the same byte on both sides; ``pairs``
    holds the linked ids (``a << 32 | b``) and ``often`` how many token pairs are so linked. With ``spans``
    there is also ``groups``, the groups as text: ``a1,a2|b1;a3|b2``. Texts that are null, empty or not
    rebuilt byte for byte by both tokenizers have no tokens: zeros, empty lists and an empty digest.
    """
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = aligner(path_a, path_b)
        for batch in batches:
            texts = pc.binary_join_element_wise(pa.scalar(" "), pc.fill_null(batch.column(1), ""), "")
            for row, data, offsets in text_blocks(texts, BLOCK):
                rows, pairs, often = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for found in find(data, offsets):
                    if found is None:
                        rows.append((0, 0, 0, "", "", 0))
                        continue
                    n_a, n_b, n, groups, own, counts = found
                    rows.append((n_a, n_b, n, hashlib.sha256(groups.encode()).hexdigest(), groups if spans else "", len(own)))
                    pairs.append(own)
                    often.append(counts)
                n_a, n_b, n, sha, groups, sizes = zip(*rows)
                at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                arrays = [batch.column(0).slice(row, len(rows)), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())]
                arrays += [pa.ListArray.from_arrays(at, pa.array(np.concatenate(pairs))), pa.ListArray.from_arrays(at, pa.array(np.concatenate(often).astype(np.int32)))]
                names = ["row", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "often"]
                if spans:
                    arrays, names = [*arrays, pa.array(groups, pa.string())], [*names, "groups"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"row {slim.schema['row'].dataType.simpleString()}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<bigint>, often array<int>"
    return slim.mapInArrow(run, schema + (", groups string" if spans else ""))


def link_counts(aligned: DataFrame) -> DataFrame:
    """``pair``, ``n`` (documents that hold it linked) and ``best`` (no other pair of its A id is in more); kept.

    A task counts its own documents' pairs first and hands on each of them once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            own, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            at, pairs = pd.factorize(np.concatenate([pairs, own]))
            counts = np.bincount(at, np.concatenate([counts, n]), len(pairs)).astype(np.int64)
            if len(pairs) > SENT_LINKS:  # bounds what a task remembers
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])
                pairs, counts = pairs[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])

    held = aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    held = keep(held.withColumn("a", F.shiftright("pair", 32)))
    most = held.groupBy("a").agg(F.max("n").alias("most"))
    return keep(held.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def score(aligned: DataFrame, counts: DataFrame, sent: int = SENT_LINKS) -> DataFrame:
    """``key``, ``n_links``, ``n_best`` and ``count_sum`` of every row of ``aligned`` that has links.

    The pairs held by most documents go to every executor, ``sent`` at most; they are all the hot keys
    of the join. What is left is joined by pair.
    """
    scales = counts.groupBy(F.floor(F.log2("n")).alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()  # 63 rows at most
    low, total = 64, 0
    for r in sorted(scales, key=lambda r: -r.s):
        total += r.k
        if total > sent:
            break
        low = r.s
    limit = F.lit(1 << min(low, 62))
    links = aligned.select("key", F.explode(F.arrays_zip("pairs", "often")).alias("l")).select("key", F.col("l.pairs").alias("pair"), F.col("l.often").alias("often"))
    sums = [F.sum("often").alias("n_links"), F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("n_best"), F.sum(F.col("often") * F.col("n")).alias("count_sum")]
    hot = F.broadcast(counts.filter(F.col("n") >= limit))
    scored = links.join(hot, "pair").groupBy("key").agg(*sums)
    if total > sent:
        rest = links.join(hot.select("pair"), "pair", "left_anti").join(counts.filter(F.col("n") < limit), "pair").groupBy("key").agg(*sums)
        scored = scored.unionByName(rest).groupBy("key").agg(*[F.sum(c).alias(c) for c in scored.columns[1:]])
    return scored


def link_report(docs: DataFrame, path_a: str, path_b: str, carried: list[str], text: str = "text", sent: int = SENT_LINKS) -> DataFrame:
    """``row``, counts of tokens, groups and links, ``n_best``, ``count_sum`` and ``groups_sha256`` of every row.

    A pair's count is the number of rows of the whole table that hold it linked; ``n_best`` counts the links whose
    count is the highest of their A id, ties included, ``count_sum`` adds up the counts of all links. Texts are tokenised
    once; what the counts need of them is kept in the shared folder. Repeated rows stay and count one each.
    """
    # numbers given before the table is written stay what they are
    with small_batches(docs.sparkSession):
        aligned = keep(align(docs, path_a, path_b, carried, text).withColumn("key", F.monotonically_increasing_id()))
    scored = score(aligned, link_counts(aligned), sent)
    own = aligned.select("row", "key", "n_a", "n_b", "n_groups", "groups_sha256")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_links", "n_best", "count_sum")]
    return own.join(scored, "key", "left").select("row", "n_a", "n_b", "n_groups", *zero, "groups_sha256")
