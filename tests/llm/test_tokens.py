import random
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from defectlens.llm import catalog, packing, token_files
from defectlens.llm.common import text_blocks
from defectlens.llm.tokens import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
PARTS = ["a", "B", "é", " ", "\n", "  ", "\t", " ", " ", "'s", "'S", "1", "23", ".", ",", "the", "<|endoftext|>", "Σ", "ß", "́", "中", "!", "\r\n", "\x85"]


def some_texts():
    rnd = random.Random(5)
    return [None, "", " ", "word", *("".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 60))) for _ in range(3000)), "Some longer text, with a stop. " * 5000]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    texts = some_texts()
    path = public_tokenizers.path(name)
    own, got = Encoder(path), []
    for _, data, offsets in text_blocks(pa.array(texts, pa.string()), 5000):
        ids, at = own.encode(data, offsets)
        got += [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    want = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert got == [e.ids for e in want]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_are_learned_once(name):
    """Capitals where they make no difference, marks after words, and pieces met again after the worker has turned to new ones."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    marks = ["", "", *"!#$%&*+-/=@^~\"()[]{}'<|>_`\\", "!!", "$$$", "<|endoftext|>", "<|ENDOFTEXT|>", "\u030a", "W\u030a", "T\u0308", "=\u0338", "İ", "K", "'S"]
    shaped = lambda w: rnd.choice([w, w.upper(), w.title()]) + rnd.choice(marks)
    texts = [" ".join(shaped(rnd.choice(words)) for _ in range(20)) for _ in range(400)]
    path = public_tokenizers.path(name)
    own, learned, got = Encoder(path), [], []
    own.most, learn = 200, own._learn
    own._learn = lambda pieces: (learned.extend(pieces), learn(pieces))
    for _, data, offsets in text_blocks(pa.array(texts, pa.string()), 3000):
        ids, at = own.encode(data, offsets)
        got += [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert got == [e.ids for e in want]
    own, learned = Encoder(path), []
    learn = own._learn
    own._learn = lambda pieces: (learned.extend(pieces), learn(pieces))
    own.most = 40
    blocks = [["common words first", "rare one"], ["common words first", "second rare"], ["common words first", "third"]]
    for k in range(30):
        for _, data, offsets in text_blocks(pa.array([*blocks[k % 3], " ".join(f"x{chr(97 + k % 26)}{chr(97 + i)}" for i in range(15))])):
            own.encode(data, offsets)
    assert learned.count(b" words") == 1
    assert own.folds == (name == "word_bpe_49k.json")


def brute_plan(points, penalty, length, short):
    at = [0, *points]
    best = [0.0] + [float("inf")] * len(points)
    for j in range(1, len(at)):
        for i in range(j):
            n = at[j] - at[i]
            if n <= length:
                best[j] = min(best[j], best[i] + penalty[j - 1] + (0 if n in short else length - n))
    return best[-1]


def test_plan_is_optimal():
    rnd = random.Random(2)
    for _ in range(300):
        points = sorted(rnd.sample(range(1, 200), rnd.randint(1, 40)))
        points = sorted({*points, *range(16, points[-1], 16)})
        penalty = [rnd.choice([0.0, 1.0, 8.0]) for _ in points]
        cuts = packing.plan(np.array(points), np.array(penalty), 32, (16, 8))
        cost = sum(0 if b - a in (16, 8) else 32 - (b - a) for a, b in zip([0, *cuts], cuts))
        cost += sum(penalty[points.index(c)] for c in cuts)
        assert cuts[-1] == points[-1] and max(np.diff([0, *cuts])) <= 32
        assert cost == brute_plan(points, penalty, 32, (16, 8))


def check_pieces(rows, texts, path):
    coder = Tokenizer.from_file(path)
    ids = {i: [*coder.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts}
    by_doc = sorted(rows, key=lambda r: (r.doc_id, r.start))
    assert {r.doc_id for r in rows} == set(ids)
    for doc, pieces in groupby(by_doc, key=lambda r: r.doc_id):
        at = 0
        for p in pieces:
            assert (p.start, p.doc_tokens) == (at, len(ids[doc]))
            assert p.length > 0 and p.ids_crc32 == crc(ids[doc][at : at + p.length])
            at += p.length
        assert at == len(ids[doc])
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values(), default=0) <= 1024
    return sequences


def test_packing(spark, data_dir, table):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(list(enumerate(some_texts())), "doc_id long, text string")
    check_pieces(packing.digests(packing.pack(docs, path)).collect(), list(enumerate(some_texts())), path)
    assert packing.pack(docs.limit(0), path).count() == 0
    rows = catalog.QUERIES["op2_packing"](spark, data_dir).collect()
    given = [tuple(r) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()]
    sequences = check_pieces(rows, given, path)
    padding = sum(1024 - n for n in sequences.values() if n & (n - 1))
    assert padding < 0.02 * sum(sequences.values())


def test_codes_are_addressable():
    rnd = np.random.default_rng(1)
    for values in (np.empty(0, np.uint32), np.array([0, 255, 256, 65535, 65536, 2**32 - 1], np.uint32), (2 ** rnd.uniform(0, 32, 5000)).astype(np.uint32)):
        shard = token_files.Shard(memoryview(token_files.shard_bytes(np.array([1]), np.array([0, len(values)]), values)))
        assert shard.all().tolist() == values.tolist()
        places = rnd.integers(0, max(1, len(values)), 700 if len(values) else 0)
        assert shard.get(places).tolist() == values[places].tolist()


def test_token_files(spark, table, tmp_path, data_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = some_texts()
    rows = [(3 * len(texts) - 3 * i, t) for i, t in enumerate(texts)]
    docs = table(rows, "doc_id long, text string")
    token_files.write_tokens(docs.repartition(5), str(tmp_path / "a"), path)
    got = {r.doc_id: (r.start, r.n_tokens, bytes(r.ids)) for r in token_files.read_tokens(spark, str(tmp_path / "a")).collect()}
    coder, at, want = Tokenizer.from_file(path), 0, {}
    for i, t in sorted(rows):
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert got == want
    token_files.write_tokens(docs.limit(0), str(tmp_path / "b"), path)
    assert token_files.read_tokens(spark, str(tmp_path / "b")).count() == 0
    out = catalog.QUERIES["op6_token_files"](spark, data_dir).orderBy("doc_id").collect()
    given = sorted(tuple(r) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect())
    at = 0
    for r, (i, t) in zip(out, given, strict=True):
        ids = [*coder.encode(t, add_special_tokens=False).ids, 2]
        assert tuple(r) == (i, at, len(ids), crc(ids))
        at += len(ids)


def test_documents_without_id(spark, table, tmp_path):
    rows = [(5, "five"), (None, "no id"), (0, "zero"), (None, None), (-3, "less")]
    path = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_tokens(table(rows, "doc_id long, text string").repartition(2), str(tmp_path / "n"), path)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.read_tokens(spark, str(tmp_path / "n")).collect())
    assert [i for _, i, _ in got] == [None, None, -3, 0, 5]
    assert [s for s, _, _ in got] == [sum(n for _, _, n in got[:k]) for k in range(5)]


def test_single_ids_of_many_files(spark, table, tmp_path, monkeypatch):
    for name, value in [("CELL", 1000), ("SHARD_BYTES", 20_000), ("SHARDS_PER_FILE", 2)]:
        monkeypatch.setattr(token_files, name, value)
    path, texts = public_tokenizers.path("word_bpe_49k.json"), some_texts()
    docs = table(list(enumerate(texts)), "doc_id long, text string")
    token_files.write_tokens(docs, str(tmp_path / "r"), path)
    assert len(list((tmp_path / "r").glob("part-*"))) > 1
    whole = np.concatenate([np.frombuffer(r.ids, "<u4") for r in token_files.read_tokens(spark, str(tmp_path / "r")).orderBy("start").collect()])
    rnd = np.random.default_rng(2)
    wanted = [0, len(whole) - 1, 5, 5, *rnd.integers(0, len(whole), 500).tolist()]
    frame = spark.createDataFrame([(p,) for p in [*wanted, -1, len(whole), None]], "position long")
    got = sorted(tuple(r) for r in token_files.read_at(spark, str(tmp_path / "r"), frame).collect())
    assert got == sorted((p, int(whole[p])) for p in wanted)


def test_reads_are_few():
    values = (2 ** np.random.default_rng(1).uniform(0, 32, 50_000)).astype(np.uint32)
    raw = token_files.shard_bytes(np.arange(9), np.arange(10), values)
    read = []
    pick = token_files._pick(lambda at, n: read.append(n) or raw[at : at + n], 0, np.array([7, 40_000]))
    assert pick.tolist() == values[[7, 40_000]].tolist() and sum(read) < 1000
