"""Each stage of the pipeline against brute force on its own input."""

from collections import Counter

import pytest
from test_decontaminate import held, lcs, words
from test_native import brute_quality
from test_similar import brute_documents, brute_lines
from test_tokens import check_pieces

import corpus_pipeline


@pytest.fixture(scope="module")
def steps(spark, data_dir, tmp_path_factory):
    """Inputs and outputs of the stages."""
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, tables[-1], data_dir).write.parquet(path)
        tables.append(spark.read.parquet(path))
    return tables


def test_order_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "decontamination", "packing"]
    assert all(t.columns == steps[0].columns for t in steps[:-1])


def test_quality(steps):
    base = lambda t: (m := brute_quality(t))[0] >= 10 and 100 * m[4] <= 20 * m[0]
    want = [r for r in steps[0].collect() if base(r.text)]
    assert Counter(map(tuple, steps[1].collect())) == Counter(map(tuple, want))  # no host of the tables is rejected


def test_lines(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    gone, _ = brute_lines(rows)
    want = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in rows}
    got = {r.doc_id: r.text for r in steps[2].collect()}
    assert set(got) == set(want)
    assert sum(got[i] != want[i] for i in want) <= 0.02 * len(want)


def test_documents(steps):
    rows = [(r.doc_id, r.text) for r in steps[2].collect()]
    classes, _ = brute_documents(rows)
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted(set(classes.values()))


def test_benchmark(spark, steps, data_dir):
    items = [r.text for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in steps[3].collect()}
    kept = {r.doc_id for r in steps[4].collect()}
    assert {i for i, t in rows.items() if not any(x in t for x in items)} >= kept
    for i in set(rows) - kept:
        assert any(held(rows[i], x) or lcs(words(x), words(rows[i])) >= 0.6 * len(words(x)) for x in items)


def test_packing(steps):
    import public_tokenizers

    rows = [(r.doc_id, r.text) for r in steps[4].collect()]
    check_pieces(steps[5].collect(), rows, public_tokenizers.path("byte_bpe_50k.json"))


def test_run(spark, steps, data_dir):
    run = corpus_pipeline.run(spark, data_dir)
    shared = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    count = lambda df: (df.groupBy("doc_id").agg({"length": "sum"}).count(), df.agg({"length": "sum"}).first()[0])
    assert set(shared) <= set(run.columns) and count(run) == count(steps[-1])
