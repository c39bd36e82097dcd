import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from defectlens.llm import catalog, chunk_dedup
from defectlens.llm.common import text_blocks, word_spans


def test_gear_is_rolling_and_local():
    texts = ["abc" * 40, "", "x", "some other text, with words " * 3]
    (_, data, offsets), = text_blocks(pa.array(texts))
    got = chunk_dedup.gear(data, offsets)
    for t, a in zip(texts, offsets):
        h = 0
        for k, b in enumerate(t.encode()):
            h = (2 * h + int(chunk_dedup._GEAR[b])) % 65536
            assert got[a + k] == h


def cuts(text):
    (_, data, offsets), = text_blocks(pa.array([text]))
    starts, _, first = word_spans(data, offsets)
    return set(chunk_dedup.chunk_starts(data, offsets, starts, first).tolist())


def test_cuts_resist_insertions():
    rnd = random.Random(3)
    body = [f"w{rnd.randrange(500)}" for _ in range(400)]
    plain = cuts(" ".join(body))
    moved = cuts(" ".join(body[:100] + ["inserted", "words", "here"] + body[100:]))
    assert {c for c in plain if c > 115} == {c - 3 for c in moved if c > 118}
    assert min(np.diff(sorted(plain))[1:]) > chunk_dedup.REACH
    assert max(cuts("same " * 500)) < 10  # only while the hash still fills


def longest_repeats(rows, n):
    """Documents with a stretch of n words that another document has too."""
    seen = defaultdict(set)
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - n + 1):
            seen[tuple(w[k : k + n])].add(i)
    return {i for docs in seen.values() if len(docs) > 1 for i in docs}


def test_passages(table):
    rnd = random.Random(8)
    make = lambda n: [f"{rnd.choice('abcdefgh')}{rnd.randrange(60)}" for _ in range(n)]
    shared = [make(n) for n in (51, 55, 60, 80, 150, 300)]
    short = [make(n) for n in (12, 20, 30, 40, 44)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "word"), (5, "same " * 5000)]
    for d in range(300):
        body = make(rnd.randint(5, 200))
        for pool, chance in ((shared, 0.3), (short, 0.5)):
            if rnd.random() < chance:
                at = rnd.randrange(len(body) + 1)
                body[at:at] = rnd.choice(pool)
        rows.append((10 + d, "\n".join([" ".join(body[:30]), " ".join(body[30:])])))
    whole = " ".join(make(70))
    rows += [(500 + i, whole) for i in range(40)] + [(600, whole + "  "), (600, whole + "  "), (700, " ".join(make(40_000)) + " " + whole)]
    docs = table(rows, "doc_id long, text string").repartition(5)
    found = chunk_dedup.repeated_passages(docs).collect()
    named = {r.doc_id for r in found} | {i for r in found for i in r.firsts}
    must, may = longest_repeats(rows, 52), longest_repeats(rows, 50)
    assert named <= may
    assert len(must - named) <= 0.03 * len(must)  # a passage of little over 50 words may hold too few cuts
    assert {*range(500, 540), 600, 700} <= named
    texts = defaultdict(list)
    for r in chunk_dedup.drop_repeats(docs).collect():
        texts[r.doc_id].append(r.text)
    assert texts[1] == [None] and texts[500] == [whole] and texts[501] == [""] and len(texts[600]) == 2
    assert sorted(texts) == sorted({i for i, _ in rows})
    assert chunk_dedup.repeated_passages(docs.limit(0)).count() == 0 and chunk_dedup.drop_repeats(docs.limit(0)).count() == 0


def test_inner_phrases_of_earlier_documents(table):
    rnd = random.Random(10)
    make = lambda n: [f"{rnd.choice('abcdefgh')}{rnd.randrange(5000)}" for _ in range(n)]
    rows, shared = [], [make(62) for _ in range(60)]
    for k, passage in enumerate(shared):
        middle = passage[24:38]
        rows.append((k, " ".join(make(30) + middle + make(30))))
        rows += [(1000 * (i + 1) + k, " ".join(make(40) + passage + make(40))) for i in range(2)]
    found = chunk_dedup.repeated_passages(table(rows, "doc_id long, text string").repartition(4)).collect()
    of = {r.doc_id: (r.start, r.end) for r in found}
    assert len(of) == len(found) and set(of) <= {*range(2000, 2060)}
    missing = [k for k in range(60) if 2000 + k not in of]
    assert not missing
    assert all(40 <= x and y <= 102 and y - x >= 50 for x, y in of.values())


def test_query(spark, data_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = catalog.QUERIES["op7_substring_dedup"](spark, data_dir).collect()
    named = {r.doc_id for r in found} | {i for r in found for i in r.first_doc_ids}
    must, may = longest_repeats(rows, 52), longest_repeats(rows, 50)
    assert named <= may and len(must - named) <= 0.02 * len(must)
