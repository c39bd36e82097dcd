"""Personal data: exact base spans, and further spans that boosted trees choose among candidates."""

from __future__ import annotations

import random
import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

#: Order of kinds in span lists; the first four have base rules.
KINDS = ("email", "ip", "card", "phone", "secret")
#: The classifier is fitted on candidates of at most so many documents and on at most so many candidates, those of least hash.
TRAIN_DOCUMENTS, TRAIN_ROWS = 4_000, 20_000
TREES, DEPTH = 20, 4
#: A candidate is chosen where its calibrated probability is at least this.
PRECISION = 0.99

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?i)\b(?:password|passwd|token|secret|api_?key)\s{0,3}[=:]\s{0,3}[\"']?([^\s\"']{8,})|\b(AKIA[0-9A-Z]{16})\b")
_SPELLED = re.compile(r"(?i)\b[a-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[a-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[a-z0-9-]{1,63})+")
_NUMBER = re.compile(r"[+(]?(?<!\w)[0-9](?:[\x20().-]{0,2}[0-9])+(?!\w)")
_TOKEN = re.compile(r"[^\s,;<>()\"']+")
_MARKED = re.compile(r"[0-9@]")
_LONG = re.compile(r"(?<![0-9])[0-9]{13,}")
_BLANK = re.compile(r"[\x20()]")
_EDGES = re.compile(r"[\x20.-]*([+(]?[0-9](?:[\x20().0-9-]*[0-9])?)")
_DATE = re.compile(r"\b(?:19|20)[0-9]{2}[.-][01]?[0-9]\b|\b[0-3]?[0-9][.-][01]?[0-9][.-](?:19|20)[0-9]{2}\b")
_HINTS = (
    re.compile(r"(?i)tel|phone|call|fax|mobil|whatsapp"),
    re.compile(r"(?i)card|visa|credit|iban|account"),
    re.compile(r"(?i)mail|contact|write|address"),
    re.compile(r"(?i)passw|token|secret|key|\bip\b|server|host"),
)


def _luhn(digits: str) -> bool:
    own = [int(c) for c in reversed(digits)]
    return sum(own[::2] + [x * 2 - 9 * (x > 4) for x in own[1::2]]) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base rules, by kind and start; each is leftmost and without overlap in its kind."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:  # a local part holds no @, so each @ has one possible match
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            last = domain.end()
            out.append((0, begin, last))
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


class _Taken:
    """Spans that may not be overlapped, joined where they touch each other."""

    def __init__(self, spans: list[tuple[int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, s: int, e: int) -> bool:
        at = bisect_right(self.ends, s)
        return at < len(self.starts) and self.starts[at] < e

    def add(self, s: int, e: int) -> None:
        """A span that meets none."""
        insort(self.starts, s)
        insort(self.ends, e)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _pieces(text: str, start: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """Cards and phones that stand side by side in one long run of digits and separators."""
    at = start
    for m in [*_LONG.finditer(text, start, end), None]:
        to = m.start() if m else end
        part = _EDGES.match(text, at, to)
        if part and 7 <= len(_digits(part[1])) <= 15:
            yield 3, *part.span(1), -1
        if m:
            if len(m[0]) <= 19:
                yield 2, *m.span(), int(_luhn(m[0]))
            at = m.end()


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(kind or -1, start, end, label) of high recall; they may overlap each other, but no base span.

    Label 1: a base span, a secret by its form or a run of digits with the check digit of a card; 0: surely none, as a number
    of a card's length without that check digit, or an address with a part beyond 255; -1: unknown.
    """
    out = [(k, s, e, 1) for k, s, e in base]
    seen, taken = set(), _Taken([(s, e) for _, s, e in base])

    def add(kind: int, s: int, e: int, label: int) -> None:
        if (s, e) not in seen and not taken.meets(s, e):
            seen.add((s, e))
            out.append((kind, s, e, label))

    for m in _SECRET.finditer(text):
        add(4, *m.span(1 if m[1] else 2), 1)
    low = text.lower()
    if "at]" in low or "at)" in low:
        for m in _SPELLED.finditer(text):
            add(0, *m.span(), -1)
    for m in _NUMBER.finditer(text):
        n = sum(c.isdigit() for c in m[0])
        if n >= 7:
            if m[0].count(".") == 3 and len(m[0]) == n + 3:
                add(1, *m.span(), 0)  # a right one is a base span
            elif n > 12 and (n > 19 or _BLANK.search(m[0])):
                for piece in _pieces(text, *m.span()):
                    add(*piece)
            if n <= 12:
                add(3, *m.span(), -1)
            elif n <= 19:
                add(2, *m.span(), -1 if _luhn(_digits(m[0])) else 0)
    for m in _TOKEN.finditer(text):
        own = m[0]
        if _MARKED.search(own):
            n = sum(c.isdigit() for c in own)
            if len(own) >= 16 and n >= 4 and own.isalnum() and n < len(own):
                add(4, *m.span(), -1)
            elif n < 7:
                add(-1, *m.span(), 0)
    return out


def _sort_of(text: str, at: int) -> int:
    if not 0 <= at < len(text):
        return 0
    c = text[at]
    return 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4


def features(text: str, kind: int, s: int, e: int) -> list[float]:
    """Proposed kind, format of the span and what stands around it."""
    own = text[s:e]
    number = _digits(own)
    digits = sum(c.isdigit() for c in own)
    letters = sum(c.isalpha() for c in own)
    groups = [len(g) for g in re.findall(r"[0-9]+", own)] or [0]
    share = [own.count(c) / len(own) for c in set(own)]
    before, after = text[max(0, s - 30) : s], text[e : e + 30]
    return [
        float(x)
        for x in (
            e - s, digits, letters, sum(c.isupper() for c in own), own.count("."), own.count("-") + own.count(" "), own.count("("), own.startswith("+"), "@" in own,
            digits / len(own), len(groups), groups[0], groups[-1], max(groups), -sum(p * log2(p) for p in share), _sort_of(text, s - 1), _sort_of(text, e),
            *(bool(h.search(before)) for h in _HINTS), before.rstrip(" \"'")[-1:] in ("=", ":"), sum(c.isdigit() for c in before + after), s == 0 or text[s - 1] == "\n",
            kind, len(number) > 12 and _luhn(number), groups[len(groups) // 2], bool(_DATE.search(own)), sum(a.isdigit() != b.isdigit() for a, b in zip(own, own[1:])),
        )
    ]


def _planted(text: str, kind: int, real: bool, rnd: random.Random) -> tuple[str, int, int]:
    """A stretch of the text with a made-up span in it, and where the span is.

    Real ones are personal data written so that no base rule finds them, others are of the same shape: dates,
    part numbers, numbers without a check digit, long names of things.
    """
    n = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda k: "".join(rnd.choice("abcdefghiklmnoprstuvw") for _ in range(k))
    if kind == 0 and real:
        at, dot = rnd.choice((" [at] ", "(at)", " (at) ", "[at]")), rnd.choice((".", "[dot]", " (dot) "))
        span = f"{word(rnd.randint(3, 9))}{at}{word(rnd.randint(3, 9))}{dot}{rnd.choice(('com', 'org', 'net', 'de'))}"
    elif kind == 0:
        span = f"{word(rnd.randint(1, 3))}{rnd.choice(('(at)', '[at]'))}{n(rnd.randint(1, 3))}.{n(rnd.randint(1, 3))}"
    elif kind == 2:
        span = n(rnd.randint(13, 19))
        while _luhn(span) != real:
            span = n(len(span))
        if rnd.random() < 0.5:
            span = rnd.choice((".", "  ")).join(span[i : i + 4] for i in range(0, len(span), 4))
    elif kind == 3 and real:
        a, b, c = n(3), n(3), n(4)
        span = rnd.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"0{n(2)} {n(4)} {n(4)}", f"+1 ({a}) {b}-{c}"))
    elif kind == 3:
        year, low = f"{rnd.choice((19, 20))}{n(2)}", lambda k: f"{rnd.randint(1, k):02d}"
        span = rnd.choice((f"{year}-{low(12)}-{low(28)}", f"{low(28)}.{low(12)}.{year}", f"{year}-{low(12)}-{low(28)} {low(23)}", n(rnd.randint(7, 12)), f"{n(1)}-{n(5)}-{n(2)}-{n(1)}", f"{n(2)}.{n(5)}.{n(2)}", f"{n(1)}.{n(3)}.{n(3)}"))
    elif real:
        span = "".join(rnd.choice("abcdef0123456789" if rnd.random() < 0.5 else "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(rnd.randint(20, 40)))
    else:
        span = f"{word(rnd.randint(4, 9))}{n(rnd.randint(2, 4))}{word(rnd.randint(4, 9))}{n(rnd.randint(2, 4))}"
    hint = {0: ("write to ", "contact: "), 2: ("card ", "visa: "), 3: ("call ", "phone: ", "tel. "), 4: ("the key ", "secret ", "token ")}[kind]
    lead = rnd.choice(hint) if rnd.random() < (0.7 if real else 0.1) else rnd.choice(("", "no. ", "see ", "item ")) if rnd.random() < 0.5 else ""
    middle = rnd.randint(0, len(text))
    before, after = text[max(0, middle - 60) : middle], text[middle : middle + 60]
    before = f"{before} {lead}" if before else lead
    return f"{before}{span} {after}", len(before), len(before) + len(span)


@dataclass
class Trees:
    """Boosted regression trees as flat arrays, and for each kind what their margins mean."""

    trees: list[tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    #: For each kind the ascending margins of the held-out rows and the calibrated probability from each on.
    levels: dict[int, tuple[np.ndarray, np.ndarray]]

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for weight, feature, cut, left, right, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = left[node] >= 0
                goes = x[np.arange(len(x)), np.maximum(feature[node], 0)] <= cut[node]
                node = np.where(inner, np.where(goes, left[node], right[node]), node)
            total += weight * value[node]
        return np.round(total, 9)  # equal sums in another order stay equal


    def probabilities(self, kinds: np.ndarray, margins: np.ndarray) -> np.ndarray:
        """Calibrated by kind; 0 for kinds without held-out rows and below the least held-out margin."""
        out = np.zeros(len(margins))
        for kind, (at, share) in self.levels.items():
            own = kinds == kind
            out[own] = np.append(0.0, share)[np.searchsorted(at, margins[own], side="right")]
        return out


def calibrated(margins: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of the label on the margin: ascending distinct margins and the probability from each on."""
    at, inverse = np.unique(margins, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    mean = np.bincount(inverse, labels) / weight
    pools: list[list[float]] = []
    for m, w in zip(mean, weight):
        pools.append([m, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m2, w2, n2 = pools.pop()
            m1, w1, n1 = pools[-1]
            pools[-1] = [(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return at, np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def _flat(tree) -> tuple[np.ndarray, ...]:
    rows: list[list[float]] = []

    def visit(node) -> int:
        at = len(rows)
        rows.append([-1, 0.0, -1, -1, node.prediction()])
        if node.subtreeDepth() > 0:
            split = node.split()
            rows[at][0], rows[at][1] = split.featureIndex(), split.threshold()
            rows[at][2] = visit(node.leftChild())
            rows[at][3] = visit(node.rightChild())
        return at

    visit(tree._call_java("rootNode"))
    f, c, left, right, value = np.array(rows, float).T
    return f.astype(int), c, left.astype(int), right.astype(int), value


def _texts(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def training_rows(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``kind``, ``features``, ``label`` and ``held_out`` of labelled candidates of the sampled documents.

    Besides the candidates with a label of their own, every sampled document gets one real and one false span of every
    kind that is scored, so that no label rests on length alone. Whole documents are held out, one in five by hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels, kinds, held = [], [], [], []

            def row(t, kind, s, e, label, out):
                rows.append(features(t, kind, s, e))
                labels.append(float(label))
                kinds.append(kind)
                held.append(out)

            for t, h in zip(*(c.to_pylist() for c in batch.columns)):
                for kind, s, e, label in candidates(t, base_spans(t)):
                    if label >= 0 and kind >= 0:
                        row(t, kind, s, e, label, h % 5 == 0)
                rnd = random.Random(crc32(t.encode()))
                for kind in (0, 2, 3, 4):
                    for real in (True, False):
                        row(*(x := _planted(t, kind, real, rnd))[:1], kind, *x[1:], real, h % 5 == 0)
            columns = [pa.array(kinds, pa.int32()), pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.float64()), pa.array(held, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "features", "label", "held_out"])

    marked = _texts(docs, id, text).filter(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("text").alias("h"))
    # only hashes meet in one task; copies of a text count once
    cut = marked.select("h").distinct().orderBy("h").limit(TRAIN_DOCUMENTS).agg(F.max("h")).first()[0]
    sample = marked.filter(F.col("h") <= F.lit(cut)).select("text", "h").distinct()
    rows = sample.mapInArrow(run, "kind int, features array<double>, label double, held_out boolean")
    return rows.orderBy(F.xxhash64("kind", "features", "label")).limit(TRAIN_ROWS)


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text") -> Trees | None:
    """Trees fitted on the labelled sample, their margins calibrated by kind on its held-out documents.

    None if the sample lacks one of the two labels; then there are base spans only.
    """
    rows = keep(training_rows(docs, id, text)).coalesce(1)  # at most TRAIN_ROWS
    fitted = rows.filter("not held_out")
    counts = {r["label"]: r["count"] for r in fitted.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, cacheNodeIds=False).fit(fitted.select(array_to_vector("features").alias("features"), "label"))
    trees = Trees([(w, *_flat(t)) for w, t in zip(model.treeWeights, model.trees)], {})
    held = rows.filter("held_out").toArrow()
    if not held.num_rows:
        return None
    margin = trees.margins(np.array(held.column("features").to_pylist()))
    kind, label = (held.column(c).to_numpy() for c in ("kind", "label"))
    for k in np.unique(kind):
        own = kind == k
        trees.levels[int(k)] = calibrated(margin[own], label[own])
    return trees


def _chosen(text: str, base: list[tuple[int, int, int]], trees: Trees | None) -> list[tuple[int, int, int]]:
    """Base spans and the candidates that are probable enough; where those overlap the more probable, then the longer one stays."""
    more = [c for c in candidates(text, base)[len(base) :] if c[3] != 0 and c[0] >= 0] if trees else []
    if not more:
        return base
    margin = trees.margins(np.array([features(text, k, s, e) for k, s, e, _ in more]))
    sure = trees.probabilities(np.array([c[0] for c in more]), margin)
    picked: list[tuple[int, int, int]] = []
    taken = _Taken()
    for i in sorted(np.flatnonzero(sure >= PRECISION), key=lambda i: (-sure[i], -margin[i], more[i][1] - more[i][2], more[i][1])):
        kind, s, e, _ = more[i]
        if not taken.meets(s, e):
            taken.add(s, e)
            picked.append((kind, s, e))
    return sorted(base + picked)


def find(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` (arrays of kind, start, end in code points) of every row.

    ``base`` holds what the base rules find, ``spans`` those and the candidates that
    the trees choose. Null and empty texts have none; repeated rows are taken one by
    one. Texts are read whole; the sample for fitting is bounded, all else covers
    every row.
    """
    kind = docs.schema[id].dataType.simpleString()
    trees = fit(docs, id, text)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = []
            for t in batch.column(1).to_pylist():
                base = base_spans(t) if _MARKED.search(t) else []
                both.append((base, _chosen(t, base, trees)))
            columns = [pa.array([[dict(zip(("kind", "start", "end"), (KINDS[k], s, e))) for k, s, e in x[j]] for x in both], pa.list_(span)) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "base", "spans"])

    out = "array<struct<kind:string,start:int,end:int>>"
    return _texts(docs, id, text).mapInArrow(run, f"doc_id {kind}, base {out}, spans {out}")


def redact(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` with every span replaced by its kind in angle brackets; where spans overlap the first stands for both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                base = base_spans(t) if _MARKED.search(t) else []
                parts, at = [], 0
                for k, s, e in sorted(_chosen(t, base, trees), key=lambda x: (x[1], -x[2])):
                    if s >= at:
                        parts += [t[at:s], f"<{KINDS[k]}>"]
                    at = max(at, e)
                out.append("".join([*parts, t[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    trees = fit(docs, id, text)
    return _texts(docs, id, text).mapInArrow(run, f"doc_id {docs.schema[id].dataType.simpleString()}, text string")

