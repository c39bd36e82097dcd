"""Token ids of whole texts, with each distinct piece of text encoded once per worker."""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pandas as pd

from .common import SpanHash, ragged

#: Pieces a worker remembers: those of late and as many that were met before; bounds its memory.
CACHE_PIECES = 1_000_000
#: Pieces that are joined by a line break (or ``!`` where white space is dropped) and encoded in one call.
TOGETHER = 64
_PLAIN = re.compile(rb" ?[\x22-\x7e\x80-\xbf\xc3-\xdf]+")

#: Normalizers that change nothing in small ASCII letters, digits, marks and single spaces.
_HARMLESS = [{"type": "Lowercase"}, {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}]

_CUT_BEFORE = np.zeros(256, bool)  # bytes that surely start no white space
_CUT_BEFORE[0x21:0x7F] = True
_CUT_BEFORE[0xC3:0xE1] = True
_CUT_BEFORE[0xE4:] = True
_ASCII = np.zeros(256, bool)
_ASCII[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_ACCENT = np.zeros(256, bool)  # first bytes of the marks that may join the letter before them
_ACCENT[0xCC:0xCE] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:?!#$%&*+-/=@^~\"()[]{}")] = True  # no apostrophe, and none of the characters of special tokens


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where a text may be cut without a change of its ids.

    Both public BPE files split texts at white space before merging: a space or
    a single line break before a visible character always starts, or is, a part
    of its own, and so does a mark after a letter. Bytes that might begin Unicode white space are left uncut.
    """
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        visible = _CUT_BEFORE[data[1:]]
        cut[:-2] |= (data[:-1] == 32) & visible
        line = (data[1:] == 10) & _ASCII[data[:-1]]
        cut[1:-1] |= line
        cut[2:-1] |= line[:-1] & visible[1:]
        cut[1:-1] |= _MARK[data[1:]] & _LETTER[data[:-1]]
    cut[offsets] = True
    return np.flatnonzero(cut[: len(data)])


class Encoder:
    """Ids of ``tokenizers`` files; ``encode`` gives what encoding each whole text gives."""

    most = CACHE_PIECES
    #: Whether capital ASCII letters have the ids of small ones, and the strings that are ids by themselves.
    folds, special, bare = False, (), None

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        line = self.tokenizer.encode("a\nb", add_special_tokens=False).ids
        self.join = "\n" if len(line) == 3 else " ! "
        (self.join_id,) = self.tokenizer.encode(self.join.strip(" "), add_special_tokens=False).ids
        normalizer = json.loads(self.tokenizer.to_str())["normalizer"] or {}
        steps = normalizer.get("normalizers", [normalizer])
        if {"type": "Lowercase"} in steps and all(n in _HARMLESS for n in steps):
            # small ASCII letters in pieces are normal already
            self.folds, self.bare = True, Tokenizer.from_file(path)
            self.bare.normalizer = None
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.ends = np.zeros(1, np.int64)
        self.before = self.known, self.flat, self.ends

    def _turn(self) -> None:
        """Start anew; what was learned last can still be taken over."""
        last = self.known, self.flat, self.ends
        self._forget()
        self.before = last

    def _take_over(self, pieces: list[bytes]) -> list[bytes]:
        """The pieces that were not learned before the last turn; the others are known again."""
        known, flat, ends = self.before
        found = list(map(known.get, pieces))
        at = np.array([x for x in found if x is not None], np.int64)
        if len(at):
            sizes = ends[at + 1] - ends[at]
            self._add([p for p, x in zip(pieces, found) if x is not None], ragged(flat, ends[at], sizes), sizes)
        return [p for p, x in zip(pieces, found) if x is None]

    def _folded(self, data: np.ndarray) -> np.ndarray:
        """The bytes with small letters where case makes no difference; a capital under an accent may."""
        low = data.tobytes().lower() if self.folds else b""
        if not self.folds or any(t in low for t in self.special):
            return data
        capital = _UPPER[data]
        capital[:-1] &= ~_ACCENT[data[1:]]
        return data | (capital.view(np.uint8) << 5)

    def _learn(self, pieces: list[bytes]) -> None:
        small, plain, rest = [], [], []
        for p in pieces:
            if not _PLAIN.fullmatch(p):
                rest.append(p)
            elif self.folds and p.isascii() and p == p.lower():
                small.append(p)
            else:
                plain.append(p)
        runs, joined = [], []
        for coder, own in ((self.bare, small), (self.tokenizer, plain)):
            few = [own[i : i + TOGETHER] for i in range(0, len(own), TOGETHER)]
            if few:
                joined += coder.encode_batch_fast([self.join.join(p.decode("utf-8", "replace") for p in run) for run in few], add_special_tokens=False)
                runs += few
        alone = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in rest], add_special_tokens=False)
        parts, lengths = [], []
        for run, e in zip(runs, joined):
            ids = np.array(e.ids, np.uint32)
            breaks = np.flatnonzero(ids == self.join_id)
            if len(breaks) != len(run) - 1:
                raise ValueError("the joining mark is not an id of its own")
            lengths.append(np.diff(np.concatenate([[-1], breaks, [len(ids)]])) - 1)
            parts.append(ids[ids != self.join_id])
        own = [e.ids for e in alone]
        lengths.append(np.fromiter(map(len, own), np.int64, len(own)))
        parts.append(np.fromiter(chain.from_iterable(own), np.uint32, int(lengths[-1].sum())))
        self._add([*small, *plain, *rest], np.concatenate(parts), np.concatenate(lengths))

    def _remember(self, pieces: list[bytes], own: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        self._add(pieces, np.fromiter(chain.from_iterable(own), np.uint32, int(sizes.sum())), sizes)

    def _add(self, pieces: list[bytes], new: np.ndarray, sizes: np.ndarray) -> None:
        used = int(self.ends[-1])
        if used + len(new) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (used + len(new)))
        self.flat[used : used + len(new)] = new
        n = len(self.known)
        self.known.update(zip(pieces, range(n, n + len(pieces))))
        self.ends = np.concatenate([self.ends, used + np.cumsum(sizes)])

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return piece_starts(data, offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, first id of each text and the end) of one block of texts."""
        data = self._folded(data)
        starts = self.starts(data, offsets)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        codes, distinct = pd.factorize(SpanHash(data)(starts, ends))
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        raw = data.tobytes()
        pieces = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())]
        if len(self.known) > self.most // 2:
            self._turn()
        found = list(map(self.known.get, pieces))
        if None in found:
            new = self._take_over([p for p, at in zip(pieces, found) if at is None])
            if new:
                self._learn(new)
            found = list(map(self.known.get, pieces))
        own = np.array(found, np.int64)[codes]
        lengths = self.ends[own + 1] - self.ends[own]
        before = np.concatenate([[0], np.cumsum(lengths)])
        return ragged(self.flat, self.ends[own], lengths), before[np.searchsorted(starts, offsets)]


_LOADED: dict[str, Encoder] = {}


def encoder(path: str, most: int = CACHE_PIECES) -> Encoder:
    """The worker's encoder of a file, remembering ``most`` pieces."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    _LOADED[path].most = most
    return _LOADED[path]
