import zlib
from collections import Counter

import pytest

from defectlens.llm import catalog, shards


def laws(rows, n_shards=8):
    """Counts differ by one at most, slots are gapless from 0; returns (shard, slot) by record."""
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    counts = [len(slots.get(s, [])) for s in range(n_shards)]
    assert set(slots) <= set(range(n_shards)) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_query(spark, data_dir):
    rows = catalog.QUERIES["op12_sharding"](spark, data_dir).collect()
    laws(rows)
    text = lambda t: (t or "").encode()
    given = Counter((r.doc_id, len(text(r.text)) + 1, zlib.crc32(text(r.text))) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == given
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def written(spark, docs, path, **more):
    shards.write_shards(docs, path, **more)
    return shards.read_shards(spark, path, docs).collect()


def test_order_is_random_and_repeatable(spark, table, tmp_path):
    rows = [(i, "x" * (i % 50), "hot" if i % 3 else f"s{i}") for i in range(3000)]
    docs = table(rows, "doc_id long, text string, source string")
    place = {}
    for name, frame, more in [
        ("a", docs, {}), ("b", docs.repartition(13).orderBy("text"), {}), ("c", docs, {"seed": 7}), ("d", docs, {"bucket_bytes": 1 << 30}),
    ]:
        got = written(spark, frame, str(tmp_path / name), shards=5, bucket_bytes=more.pop("bucket_bytes", 5000), **more)
        laws(got, 5)
        assert Counter(r.row.doc_id for r in got) == Counter(range(3000))
        place[name] = {r.row.doc_id: r.shard * 600 + r.slot for r in got}
    assert place["a"] == place["b"] != place["c"]
    for at in place.values():
        # every tenth of the input is spread over every tenth of the output
        cells = Counter((i // 300, p // 300) for i, p in at.items())
        assert len(cells) == 100 and max(cells.values()) < 60
        # neighbours are not kept together, and few records stay where they were
        assert sum(abs(at[i] - at[i + 1]) == 1 for i in range(2999)) < 15 and sum(at[i] == i for i in at) < 10


def test_files_hold_the_order(spark, table, tmp_path):
    docs = table([(i, "some text") for i in range(500)], "doc_id long, text string")
    shards.write_shards(docs, str(tmp_path / "o"), shards=3, bucket_bytes=1500)
    import pyarrow.parquet as pq

    for folder in (tmp_path / "o").glob("shard=*"):
        runs = [pq.ParquetFile(f).read(["slot"])["slot"].to_pylist() for f in folder.glob("*.parquet")]
        assert len(runs) > 1 and all(run == list(range(run[0], run[0] + len(run))) for run in runs)


def test_bases_over_many_runs(spark, monkeypatch):
    monkeypatch.setattr(shards, "RUN", 7)
    counts = spark.range(100).selectExpr("cast(id as int) AS bucket", "id % 4 AS n")
    assert sorted(tuple(r) for r in shards._before(counts).collect()) == [(b, sum(i % 4 for i in range(b))) for b in range(100)]


def test_equal_records_nulls_and_empty_tables(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "RUN", 16)
    rows = [(1, "copy", "a")] * 200 + [(None, None, None)] * 3 + [(i, "t" * i, None) for i in range(2, 100)] + [(7, "", "a"), (1, "copy", "b"), (500, "long " * 20_000, "a")]
    docs = table(rows, "doc_id long, text string, source string")
    got = written(spark, docs, str(tmp_path / "e"), bucket_bytes=300)
    laws(got)
    key = lambda r: (r.doc_id, r.text, r.source)
    assert Counter(key(r.row) for r in got) == Counter(rows)
    # copies of one record are spread over all shards
    assert len({r.shard for r in got if key(r.row) == rows[0]}) == 8
    for n in (0, 3):
        few = written(spark, docs.limit(n), str(tmp_path / f"n{n}"))
        assert len(few) == n
        laws(few)


@pytest.mark.parametrize("rows, count", [(0, 8), (5, 8), (8, 8), (83, 8), (7, 1)])
def test_cut(spark, rows, count):
    from pyspark.sql import functions as F

    shard, slot = shards.shard_of(F.col("id"), rows, count)
    got = spark.range(rows).select(shard.alias("shard"), slot.alias("slot")).collect()
    laws(got, count)
    assert [r.shard for r in got] == sorted(r.shard for r in got)
