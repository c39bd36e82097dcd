import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from defectlens.llm import alignment, catalog
from defectlens.llm.common import text_blocks

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "B", "é", " ", "\n", "  ", "\t", " ", " ", "'s", "1", "23", ".", ",", " the", " running", "<|endoftext|>", "ß", "中文", "!", "\r\n", "\x00", "ﬁ", "<0x41>", "</s>", "😀", "\x85"]


def some_texts():
    rnd = random.Random(8)
    made = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    return [None, "", " ", "word", "▁", "a ▁b", "  two", "end ", *made, "nospace" * 3000, "Some longer text, with a stop. " * 3000, "word", "word"]


def brute_tokens(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    out = []
    for t in texts:
        if not t:
            out.append(([], []))
            continue
        ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        same = b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode()
        out.append((list(zip(ids_a, bytes_a)), list(zip(ids_b, bytes_b))) if same else ([], []))
    return out


def brute(texts):
    docs, counts = [], Counter()
    for a, b in brute_tokens(texts):
        groups, links, i, j, at_a, at_b, ga, gb = [], [], 0, 0, 0, 0, [], []
        spans_a, spans_b = [], []
        for side, spans in ((a, spans_a), (b, spans_b)):
            at = 0
            for t, raw in side:
                spans.append((t, at, at + len(raw)))
                at += len(raw)
        low = 0
        for t, s, e in spans_a:
            while spans_b[low][2] <= s:
                low += 1
            k = low
            while k < len(spans_b) and spans_b[k][1] < e:
                links.append((t, spans_b[k][0]))
                k += 1
        ends = sorted({e for *_, e in spans_a} & {e for *_, e in spans_b})
        last = 0
        for e in ends:
            ga = [t for t, s, x in spans_a if last < x <= e] if len(ends) < 50 else None
            gb = [t for t, s, x in spans_b if last < x <= e] if len(ends) < 50 else None
            groups.append((ga, gb))
            last = e
        if len(ends) >= 50:
            groups, ia, ib = [], 0, 0
            for e in ends:
                ga, gb = [], []
                while ia < len(spans_a) and spans_a[ia][2] <= e:
                    ga.append(spans_a[ia][0])
                    ia += 1
                while ib < len(spans_b) and spans_b[ib][2] <= e:
                    gb.append(spans_b[ib][0])
                    ib += 1
                groups.append((ga, gb))
        counts.update(set(links))
        docs.append((len(a), len(b), groups, links))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for n_a, n_b, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), sha))
    return out


def test_tokens_are_those_of_whole_texts():
    texts = some_texts()
    find = alignment.Aligner(A, B)
    own = {find.a: [], find.b: []}
    for _, data, offsets in text_blocks(pa.array([" " + (t or "") for t in texts]), 5000):
        for side, got in own.items():
            ids, at = side.coder.encode(data, offsets)
            good = side.same(data, offsets, ids, at)
            got += [ids[i:j].tolist() if g else None for i, j, g in zip(at, at[1:], good)]
    for t, a, b, (want_a, want_b) in zip(texts, own[find.a], own[find.b], brute_tokens(texts)):
        if want_a:
            assert (a, b) == ([i for i, _ in want_a], [i for i, _ in want_b])
        elif t:
            assert a is None or b is None


@pytest.mark.parametrize("sent", [alignment.SENT_LINKS, 100, 0])
def test_report(spark, table, sent):
    texts = some_texts()
    docs = table(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.row.doc_id: tuple(r)[1:] for r in alignment.link_report(docs, A, B, ["doc_id", "row"], sent=sent).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_little_memory(spark, table, monkeypatch):
    # windows are forgotten between blocks and pairs handed on early
    texts = some_texts()[:300]
    find = alignment.Aligner(A, B)
    monkeypatch.setattr(alignment, "MEMO_IDS", 10)
    monkeypatch.setattr(alignment, "LONG_WINDOW", 3)
    got = []
    for _, data, offsets in text_blocks(pa.array([" " + (t or "") for t in texts]), 500):
        got += [(*f[:3], f[3]) if f else (0, 0, 0, "") for f in find(data, offsets)]
    want = brute(texts)
    assert [(*g[:3], hashlib.sha256(g[3].encode()).hexdigest() if g[3] else "") for g in got] == [(*w[:3], w[6]) for w in want]


def test_groups_as_text(spark, table):
    docs = table([(1, "some words here"), (2, None)], "doc_id long, text string")
    rows = {r.row.doc_id: r for r in alignment.align(docs, A, B, ["doc_id"], spans=True).collect()}
    assert rows[1].groups.count(";") == rows[1].n_groups - 1 and rows[2].groups == "" and rows[2].pairs == []
    assert hashlib.sha256(rows[1].groups.encode()).hexdigest() == rows[1].groups_sha256
    assert alignment.link_report(docs.limit(0), A, B, ["doc_id"]).count() == 0


def test_query(spark, data_dir):
    rows = sorted(tuple(r) for r in catalog.QUERIES["op11_alignment"](spark, data_dir).collect())
    given = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect())
    want = brute([t for _, t in given])
    assert rows == [(i, *w) for (i, _), w in zip(given, want)]
    assert np.mean([r[1] > 0 for r in rows]) > 0.5
