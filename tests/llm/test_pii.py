import hashlib
import random
import re
import time

import numpy as np

from defectlens.llm import catalog, pii


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    """The base rules as they are worded."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_rules():
    rnd = random.Random(1)
    parts = ["a", "Z", "@", ".", "-", " ", "+", "1", "22", "255", "256", "(", ")", "x@y.z", "4111 1111 1111 1111", "4111-1111", "+1 (555) 123-4567", "é", "0.0.0.0", "\n", "%"]
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(text)] == brute(text), text
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "@" * 300_000, "a@b" * 100_000):
        assert [x for x in pii.base_spans(text) if x[0] == 1] == [] or text.startswith("1.")
        pii.candidates(text, [])


def some_documents():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9)))
    make = lambda: " ".join(word() for _ in range(rnd.randint(20, 80)))
    number = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    card = lambda: next(c for c in iter(lambda: "4" + number(15), None) if luhn(c))
    forms = [
        lambda: f"{word()}.{number(2)}@{word()}.com", lambda: ".".join(str(rnd.randrange(256)) for _ in range(4)), card,
        lambda: f"+1 ({number(3)}) 555-{number(4)}", lambda: f"password={number(3)}ab{number(9)}", lambda: f"in {1900 + rnd.randrange(120)}", lambda: f"version {rnd.randrange(9)}.{rnd.randrange(9)}", lambda: f"x{rnd.randrange(99)}",
    ]
    rows = [(1, None), (2, ""), (3, "nothing here")]
    rows += [(10 + i, f"{make()} {rnd.choice(forms)()} {make()} {rnd.choice(forms)()}") for i in range(600)]
    rows += [(900, f"call me by phone {number(3)}-{number(3)}-{number(4)} at once"), (901, "b " * 100_000 + "ab@cd.ef"), (901, "b " * 100_000 + "ab@cd.ef")]
    return rows


def test_spans(table):
    rows = some_documents()
    docs = table(rows, "doc_id long, text string").repartition(4)
    found = pii.find(docs).collect()
    assert sorted(r.doc_id for r in found) == sorted(i for i, _ in rows)
    texts = dict(rows)
    for r in found:
        base = [tuple(x) for x in r.base]
        assert base == brute(texts[r.doc_id] or "")
        assert set(base) <= {tuple(x) for x in r.spans}
        order = [(pii.KINDS.index(x.kind), x.start) for x in r.spans]
        assert order == sorted(order)
    extra = {r.doc_id: [x.kind for x in r.spans if x not in r.base] for r in found}
    secrets = {i for i, t in rows if t and "password=" in t}
    assert len({i for i in secrets if "secret" in extra[i]}) >= 0.95 * len(secrets)
    plain = [i for i, t in rows if not t or not re.search(r"[0-9@]", t)]
    assert not any(extra[i] for i in plain)
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[901].endswith("b <email>") and clean[3] == "nothing here" and clean[1] == ""
    assert pii.find(docs.limit(0)).count() == 0


def test_held_out_accuracy_of_each_kind(spark, table):
    docs = table(some_documents(), "doc_id long, text string")
    rows = pii.training_rows(docs).filter("held_out").collect()
    trees = pii.fit(docs)
    margin = trees.margins(np.array([r.features for r in rows]))
    kind, label = np.array([r.kind for r in rows]), np.array([r.label for r in rows]) > 0
    sure = trees.probabilities(kind, margin)
    for k in (0, 2, 3, 4):
        own = kind == k
        assert 0.1 < label[own].mean() < 0.9, k
        picked = own & (sure >= pii.PRECISION)
        assert label[picked].mean() >= pii.PRECISION, k
        assert picked.sum() >= 0.75 * (label & own).sum(), k


def test_calibration_is_monotone():
    rng = np.random.default_rng(1)
    margins = rng.normal(size=500).round(1)
    labels = (rng.random(500) < 1 / (1 + np.exp(-3 * margins))).astype(float)
    at, share = pii.calibrated(margins, labels)
    assert (np.diff(at) > 0).all() and (np.diff(share) >= 0).all()
    total = sum(share[i] * (margins == m).sum() for i, m in enumerate(at))
    assert abs(total - labels.sum()) < 1e-6


def test_planted_spans_are_found_and_decoys_left(spark, table):
    rnd = random.Random(5)
    train = [t for _, t in some_documents()]
    words = lambda: " ".join("".join(rnd.choice("klmnopq") for _ in range(6)) for _ in range(12))
    number = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    card = lambda want: next(c for c in iter(lambda: "4" + number(15), None) if luhn(c) == want)
    real = [f"{words()} phone: ({number(3)}) {number(3)}-{number(4)} {words()}" for _ in range(40)]
    both = [f"{words()} +1 ({number(3)}) 555-{number(4)} {card(True)} {words()}" for _ in range(40)]
    spelled = [f"{words()} write to jo.doe{i} [at] mail.example.com {words()}" for i in range(40)]
    false = [f"{words()} {rnd.choice((card(False), '2021-03-' + number(1) + '4', '3.14.' + number(4), '978-' + number(1) + '-' + number(5)))} {words()}" for _ in range(120)]
    docs = table(list(enumerate([*real, *both, *spelled, *false, *train])), "doc_id long, text string").repartition(4)
    extra = {r.doc_id: [x for x in r.spans if x not in r.base] for r in pii.find(docs).collect()}
    found = lambda lo, n, kind: sum(any(x.kind == kind for x in extra[i]) for i in range(lo, lo + n)) / n
    assert found(0, 40, "phone") >= 0.8 and found(40, 40, "card") >= 0.95 and found(80, 40, "email") >= 0.8
    assert sum(bool(extra[i]) for i in range(120, 240)) <= 3


def test_text_full_of_spans_takes_linear_time(table):
    text = " ".join(f"{i % 10}{1234567 + i} x{i}@ab.cd" if i % 3 else f"555-{i % 1000:03d}-{i % 10000:04d}" for i in range(60_000))
    start = time.time()
    base = pii.base_spans(text)
    assert len(pii.candidates(text, base)) > 60_000
    taken = pii._Taken()
    for i in range(0, 400_000, 2):
        assert not taken.meets(i, i + 1)
        taken.add(i, i + 1)
    assert taken.meets(10, 13) and not taken.meets(11, 12) and not taken.meets(400_000, 400_001)
    assert time.time() - start < 20


def test_query(spark, data_dir):
    texts = dict(tuple(r) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect())
    for r in catalog.QUERIES["op4_pii"](spark, data_dir).collect():
        base = brute(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in base) for x in ("email", "ip", "card", "phone"))
        assert not base or set(joined.split(",")) <= set(r.spans.split(","))
