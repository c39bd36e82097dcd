import random
import re

import numpy as np
import pyarrow as pa

from defectlens.llm import catalog, decontaminate


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def held(text, item):
    """Whether any stretch of about the item's length holds it; also the share that the item's words must reach."""
    w, own = words(text), words(item)
    n = len(own)
    return any(lcs(own, w[k : k + n + n // 4 + 8]) >= 0.8 * n for k in range(max(1, len(w) - n + 1))) if own else False


def test_common_subsequence():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randint(1, 30))] for _ in "ab")
        assert decontaminate.common_subsequence(a, b) == lcs(a, b)


def test_latent_space_is_that_of_the_matrix(spark):
    """Features with few directions: the randomised form finds the leading right singular vectors."""
    rnd = random.Random(2)
    topics = [[f"t{t}w{i}" for i in range(12)] for t in range(6)]
    texts = [" ".join(rnd.choice(topics[t]) for _ in range(32)) for t in range(6) for _ in range(30 + 10 * t)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    df, n = decontaminate.frequencies(docs)
    assert n == len(texts)
    dense = np.zeros((len(texts), decontaminate.FEATURES))
    for row, hashed, first in decontaminate._words(pa.array(texts)):
        for i, (a, b) in enumerate(zip(first, first[1:])):
            np.add.at(dense[row + i], decontaminate._feature(hashed[a:b]), 1)
    assert ((dense > 0).sum(0) == df).all()
    idf = np.log((1 + n) / (1 + df))
    _, s, v = np.linalg.svd(dense * idf, full_matrices=False)
    own = decontaminate.latent_space(docs)[:, :6] / idf[:, None]
    own /= np.linalg.norm(own, axis=0)
    assert np.linalg.norm(v[:6] @ own, axis=1).min() > 0.99


def test_leaks(spark, table):
    rnd = random.Random(7)
    common = ["the", "of", "and", "to", "in", "a", "is"]
    vocabulary = [f"{a}{b}" for a in "abcdefghijklmnop" for b in ("or", "an", "ti", "re", "st", "en", "ou", "ing")]
    make = lambda n: [rnd.choice(common) if rnd.random() < 0.35 else rnd.choice(vocabulary) + rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(make(rnd.randint(15, 60)))) for i in range(40)] + [(90, None), (91, ""), (92, "Tiny item")]
    rows, want = [(1, None), (2, ""), (3, "short")], set()
    for d in range(400):
        body = make(rnd.randint(20, 300))
        if d % 4 == 0:
            i, text = items[rnd.randrange(40)]
            leak = text.split()
            for _ in range(rnd.choice([0, 0, len(leak) // 12])):
                leak[rnd.randrange(len(leak))] = "changed"
            at = rnd.randrange(len(body))
            body[at:at] = [w.upper() + "," if d % 8 == 0 else w for w in leak]
            want.add((10 + d, i))
        rows.append((10 + d, " ".join(body)))
    rows += [(900, "here is a tiny, ITEM of"), (901, "tiny other item"), (902, " ".join(make(60_000)) + " " + items[3][1])]
    want |= {(900, 92), (902, 3)}
    docs = table(rows, "doc_id long, text string").repartition(4)
    benchmark = table(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.share for r in decontaminate.find_leaks(docs, benchmark).collect()}
    assert set(got) == want
    assert all(0.6 <= s <= 1 for s in got.values())
    clean = decontaminate.remove_leaks(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _ in rows if i not in {d for d, _ in want})
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), benchmark).count() == 0


def test_short_items_and_paraphrases(table):
    """Short items inside long documents, whole or changed, and paraphrases of 0.6 to 0.8 that keep the answer."""
    rnd = random.Random(9)
    common = ["the", "of", "and", "to", "in", "a", "is"]
    stems = [f"{a}{b}" for a in "abcdefghijklmnop" for b in ("or", "an", "ti", "re", "st", "en", "ou", "ing")]
    make = lambda n: [rnd.choice(common) if rnd.random() < 0.35 else rnd.choice(stems) + rnd.choice(stems) for _ in range(n)]
    short = [make(n) for n in (2, 3, 4, 5, 6, 8, 10, 13, 15) for _ in range(8)]
    asked = [(make(rnd.randint(20, 45)), make(6)) for _ in range(60)]
    items = [(i, " ".join(w)) for i, w in enumerate(short)] + [(100 + i, " ".join(q) + ". " + " ".join(a)) for i, (q, a) in enumerate(asked)]
    rows, planted = [], {}
    for d, (i, item) in enumerate([x for x in items for _ in range(2)]):
        own = item.replace(".", "").split()
        n, free = len(own), len(own) - (6 if i >= 100 else 0)
        lost = rnd.randint(n // 5, 2 * n // 5) if i >= 100 else (n // 5 if n >= 5 and d % 2 else 0)
        for k in rnd.sample(range(free), lost):
            own[k] = f"other{rnd.randrange(999)}"
        body = make(rnd.randint(150, 300))
        at = rnd.randrange(len(body))
        rows.append((d, " ".join(body[:at] + own + body[at:])))
        planted[d] = i
    texts = {i: words(t) for i, t in items}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(table(rows, "doc_id long, text string").repartition(4), table(items, "item_id long, text string")).collect()}
    short_lost = {(d, i) for d, i in planted.items() if i < 100} - got
    long_lost = {(d, i) for d, i in planted.items() if i >= 100 and lcs(texts[i], words(rows[d][1])) >= 0.6 * len(texts[i])} - got
    assert not short_lost
    assert not long_lost


def test_query(spark, data_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in catalog.QUERIES["op3_decontamination"](spark, data_dir).collect()}
    exact = {(d, i) for d, t in docs for i, x in items if x in t}
    assert exact and exact <= got
    texts, asked = dict(docs), dict(items)
    assert all(held(texts[d], asked[i]) or lcs(words(asked[i]), words(texts[d])) >= 0.6 * len(words(asked[i])) for d, i in got)
