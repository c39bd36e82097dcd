import gc
import random
import re
import time
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from defectlens.llm import catalog, line_dedup, ngram_join
from defectlens.llm.classes import components
from defectlens.llm.common import keep


def classes_of(items, linked):
    """Brute-force components: least member of each."""
    parent = {i: i for i in items}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {i: find(i) for i in items}


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, j) for j in range(5001, 5400)]
    links = [tuple(sorted(x)) for x in links if x[0] != x[1]]
    got = {r.id: r["class"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == classes_of({i for x in links for i in x}, links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def word_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_documents(rows):
    by_text = defaultdict(list)
    for i, t in rows:
        by_text[t or ""].append(i)
    sets = {t: word_shingles(t) for t in by_text}
    texts = [t for t in by_text if sets[t]]
    inverted = defaultdict(list)
    for t in texts:
        for s in sets[t]:
            inverted[s].append(t)
    pairs = {tuple(sorted((a, b))) for ts in inverted.values() for i, a in enumerate(ts) for b in ts[:i]}
    linked = [(a, b) for a, b in pairs if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    of_text = classes_of(texts, linked)
    least = defaultdict(list)
    for t in texts:
        least[of_text[t]] += by_text[t]
    linked_texts = {t for x in linked for t in x}
    return {(i, t or ""): min(least[of_text[t or ""]]) if sets[t or ""] else i for i, t in rows}, linked_texts


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def some_documents():
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, "  \n "), (4, "tiny text"), (5, "tiny text"), (6, "tiny  text"), (7, "tiny other"), (7, "tiny other"), (8, "a b c d e"), (9, "a b c d e f")]
    shared = [rnd.choice(vocabulary) for _ in range(60)]
    for g in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(40, 400))]
        rows += [(100 * (g + 1) + k, edited(rnd, base, rnd.choice([0, 1, 2, 4, len(base) // 25, len(base) // 12]))) for k in range(8)]
        rows.append((100 * (g + 1) + 50, " ".join(base[: len(base) // 2] + shared)))
    rows += [(9000 + i, " ".join(shared + [rnd.choice(vocabulary) for _ in range(30)])) for i in range(60)]
    rows.append((9900, "long " * 30_000 + " ".join(map(str, range(30_000)))))
    rows.append((9901, "long " * 30_000 + " ".join(map(str, range(30_001)))))
    return rows


def test_ngram_join(table, some_documents):
    docs = table(some_documents, "doc_id long, text string").repartition(6)
    want, linked = brute_documents(some_documents)
    rows = ngram_join.classify(docs).collect()
    assert sorted((r.doc_id, r.class_id) for r in rows) == sorted((i, want[(i, t or "")]) for i, t in some_documents)
    of_id = {i: t for i, t in some_documents}
    assert {r.doc_id for r in rows if r.n_links} == {i for i, t in of_id.items() if t in linked}
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c in want.values()})
    assert ngram_join.classify(docs.limit(0)).count() == 0 and ngram_join.keep_one(docs.limit(0)).count() == 0


def test_ngram_degrees(table, some_documents, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_OF_NODES", 40)
    rnd = random.Random(12)
    base = [f"v{rnd.randrange(2000)}" for _ in range(300)]
    rows = some_documents[:-2] + [(20_000 + i, edited(rnd, base, rnd.randint(0, 12))) for i in range(200)]
    rows += [(30_000 + i, " ".join(["one", "after", "other", *base[:100], f"tail{i}"])) for i in range(5)] + [(30_000, " ".join(base))]
    texts = {t for _, t in rows if word_shingles(t)}
    sets = {t: word_shingles(t) for t in texts}
    want = {t: sum(o != t and 10 * len(s & sets[o]) >= 8 * len(s | sets[o]) for o in texts) for t, s in sets.items()}
    got = sorted((r.doc_id, r.n_links) for r in ngram_join.classify(table(rows, "doc_id long, text string").repartition(6)).collect())
    assert got == sorted((i, want.get(t, 0)) for i, t in rows)
    assert max(want.values()) > 50


def test_ngram_query(spark, data_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()]
    want, _ = brute_documents(rows)
    assert {(r.doc_id, r.class_id) for r in catalog.QUERIES["op9_ngram_join"](spark, data_dir).collect()} == {(i, want[(i, t)]) for i, t in rows}


def brute_lines(rows):
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")
    sets, first, places = {}, {}, []
    for i, t in rows:
        for pos, line in enumerate((t or "").split("\n")):
            if n := norm(line):
                sets.setdefault(n, frozenset(n[k : k + 5] for k in range(len(n) - 4)) if len(n) > 5 else frozenset([n]))
                places.append((i, pos, n))
                first[n] = min(first.get(n, (i, pos)), (i, pos))
    inverted = defaultdict(set)
    for n, s in sets.items():
        for x in s:
            inverted[x].add(n)
    linked = []
    for n, s in sets.items():
        count = defaultdict(int)
        for x in s:
            for other in inverted[x]:
                count[other] += 1
        linked += [(n, o) for o, k in count.items() if o < n and 10 * k >= 8 * (len(s) + len(sets[o]) - k)]
    of = classes_of(sets, linked)
    stays = {}
    for n, c in of.items():
        stays[c] = min(stays.get(c, first[n]), first[n])
    return {(i, pos) for i, pos, n in places if stays[of[n]] != (i, pos)}, linked


def test_line_dedup(spark, table):
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    pool = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(3, 40))) for _ in range(60)]
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "abcd\nABCD \nabc\n abcd"), (5, "x" * 60_000 + "\n" + "x" * 60_000 + "\n" + "é" * 9)]
    for i in range(80):
        lines = []
        for _ in range(rnd.randint(1, 12)):
            line = rnd.choice(pool) if rnd.random() < 0.6 else " ".join(rnd.choice(vocabulary) for _ in range(25))
            if rnd.random() < 0.5 and len(line) > 60:
                line = line[:30] + "Q" + line[31:]
            lines.append(line)
        rows.append((10 + i, "\n".join(lines)))
    docs = table(rows, "doc_id long, text string").repartition(5)
    want, _ = brute_lines(rows)
    got = {(r.doc_id, p) for r in line_dedup.dropped_lines(docs).collect() for p in r.dropped}
    assert len(got ^ want) <= 0.02 * len(want)  # banding may miss a link at the very limit
    texts = {r.doc_id: r.text for r in line_dedup.drop_lines(docs).collect()}
    assert texts[1] is None and line_dedup.drop_lines(docs).columns == docs.columns
    assert texts == {i: t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in got) for i, t in rows}
    assert line_dedup.drop_lines(docs.limit(0)).count() == 0
    twice = table([(1, "one line of it\nanother line"), (1, "one line of it\nanother line"), (2, "one line of it")], "doc_id long, text string")
    assert sorted(r.text for r in line_dedup.drop_lines(twice).collect()) == ["", "one line of it\nanother line", "one line of it\nanother line"]


def test_links_that_leaders_leave(table, monkeypatch):
    """Small buckets as pairs, large ones block by block: the same classes."""
    rnd = random.Random(21)
    base = "".join(rnd.choice("abcdefghij ") for _ in range(90)).strip(" ")
    rows = [(0, base)]
    for i in range(1, 60):  # chains of edits away from one line, so that most links are none of the leader's
        line = list(rows[rnd.randrange(len(rows))][1])
        line[rnd.randrange(len(line))] = rnd.choice("xyzuvw")
        rows.append((i, "".join(line)))
    want, _ = brute_lines(rows)
    found = []
    for few, lines in ((32, 2048), (1, 2048), (1, 8)):
        monkeypatch.setattr(line_dedup, "FEW", few)
        monkeypatch.setattr(line_dedup, "BLOCK_OF_LINES", lines)
        found.append({(r.doc_id, p) for r in line_dedup.dropped_lines(table(rows, "doc_id long, text string").repartition(4)).collect() for p in r.dropped})
    assert found[0] == found[1] == found[2] and len(found[0] ^ want) <= 0.05 * len(want) and len(want) > 20


def shuffled_bytes(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [str(x.getPath()) for x in manager.localDirs()]
    return sum(p.stat().st_size for folder in folders for p in Path(folder).rglob("shuffle_*.data") if p.exists())


def test_kept_tables_leave_no_shuffles(spark):
    df = spark.range(200_000).groupBy((F.col("id") * 7919 % 150_001).alias("k")).count()
    before, _ = shuffled_bytes(spark), gc.disable()
    try:
        kept = keep(df.join(df.withColumnRenamed("count", "other"), "k"))
        for _ in range(100):
            if shuffled_bytes(spark) <= before:
                break
            time.sleep(0.1)
        assert shuffled_bytes(spark) <= before
    finally:
        gc.enable()
    assert kept.count() == 150_001
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") != "true"


def test_lines_with_edits_anywhere(table):
    """Each line and its edited copy are a document each; only the copies that are links count."""
    rnd = random.Random(14)
    spaced = lambda n: "".join(rnd.choice("abcdefghijklmno ") for _ in range(n)).strip(" ").ljust(n, "p")
    unspaced = lambda n: "".join(chr(rnd.randrange(0x4E00, 0x5E00)) for _ in range(n))
    rows, pairs = [], []
    for k in range(600):
        n = rnd.randint(40, 120)
        line = (spaced if k % 2 else unspaced)(n)
        at = {0: {0}, 1: {n - 1}, 2: {0, n - 1}, 3: {3}, 4: {rnd.randrange(n)}, 5: {rnd.randrange(n), rnd.randrange(n)}}[k % 6 if k % 4 else k // 4 % 6]
        copy = "".join("#" if i in at else c for i, c in enumerate(line))
        rows += [(2 * k, line), (2 * k + 1, copy)]
        pairs.append((2 * k, 2 * k + 1))
    want, _ = brute_lines(rows)
    got = {(r.doc_id, p) for r in line_dedup.dropped_lines(table(rows, "doc_id long, text string").repartition(5)).collect() for p in r.dropped}
    assert len(want) > 400 and got <= want and len(want - got) <= 0.002 * len(want)


def test_line_query(spark, data_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()]
    want, linked = brute_lines(rows)
    got = {(r.doc_id, int(p)) for r in catalog.QUERIES["op8_line_dedup"](spark, data_dir).collect() for p in r.dropped.split(",") if p}
    assert len(want) > 50 and len(got ^ want) <= 0.02 * len(want)


def test_lines_are_normalised_within_their_text(spark):
    text = "A\t\x0b B  \n \n\x0c\nΟΔΟΣ\nΣ\r\n  Two   words\t\n\nİx"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {(r.pos, r.norm) for r in line_dedup._occurrences(rows, "doc_id", "text").collect()}
    want = set()
    for pos, line in enumerate(text.split("\n")):
        norm = " ".join(line.lower().split())
        if norm:
            want.add((pos, norm))
    assert got == want
