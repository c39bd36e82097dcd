"""Files: documents, listings, manifests, vectors, indexes and results."""

import json

import pytest
from pyspark.sql import functions as F

from defectlens.operators import shapes as S
from defectlens.sources import annotations as A
from defectlens.sources import tables as T


def document(name, shapes):
    return {"imagePath": name, "imageWidth": 3264, "imageHeight": 2448, "shapes": shapes}


def shape(label, points, kind="polygon"):
    return {"label": label, "shape_type": kind, "points": points}


def test_annotation_folder(spark, tmp_path):
    base = "zona1_ko_2_3_{}_zona_{}"
    square = [[1.9, 2.9], [11.2, 2.0], [11.9, 22.7]]
    good = document(base.format(1, 4) + "_imageDANO_original.jpg", [shape("2", square), shape("9", square), shape("3", square, "line")])
    (tmp_path / (base.format(1, 4) + "_labelDANO_modificado.json")).write_text(json.dumps(good, indent=2))
    (tmp_path / (base.format(2, 5) + "_labelDANO_modificado.json")).write_text(json.dumps(good)[:80])
    (tmp_path / (base.format(3, 5) + "_labelDANO_modificado.json")).write_text(json.dumps({"imagePath": "x.jpg"}))
    (tmp_path / (base.format(4, 5) + "_imageDANO_original.json")).write_text("{}")
    docs = A.read_annotations(spark, str(tmp_path))
    valid, bad = A.split_valid(docs)
    assert {r.file_name.split("_")[4]: r.reason for r in bad.collect()} == {"2": "unreadable", "3": "no shapes"}
    rows = S.with_boxes(S.explode_shapes(valid)).collect()
    assert [(r.shape_idx, r.label, r.x_min, r.y_min, r.x_max, r.y_max) for r in sorted(rows, key=lambda r: r.shape_idx)] == [
        (0, "2", 1, 2, 11, 22),
        (1, "9", 1, 2, 11, 22),
    ]
    assert S.explode_shapes(valid, drop_odd_label=True).count() == 1
    for i, z in ((1, 4), (4, 5), (7, 5)):
        (tmp_path / (base.format(i, z) + "_imageDANO_original.jpg")).write_bytes(b"x")
    images, files = A.list_files(spark, str(tmp_path), "*.jpg"), A.list_files(spark, str(tmp_path), "*.json")
    status = {r.file_name.split("_")[4]: r.status for r in A.classify_images(images, files).collect()}
    assert status == {"1": "damaged", "4": "clean", "7": "orphan"}
    loose = {r.file_name.split("_")[4]: r.status for r in A.classify_images(images, files, strict=False).collect()}
    assert loose == {"1": "damaged", "4": "clean", "7": "clean"}


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "file_name string")


def test_masked_pairs(spark):
    originals = names(spark, "a_zona_1_imageDANO_original.jpg", "b_zona_2_imageDANO_original.jpg")
    masked = names(spark, "masked_a_zona_1_imageDANO_original.jpg")
    docs = names(spark, "a_zona_1_labelDANO_modificado.json", "a_zona_1_imageDANO_original.json", "b_zona_2_labelDANO_modificado.json")
    pairs = A.pair_masked(originals, masked, docs)
    assert sorted((r.file_name[0], r.is_found, r.n_docs) for r in pairs.collect()) == [("a", True, 2), ("b", False, 0)]
    assert tuple(A.pair_summary(pairs).first()) == (1, 1, 2)


def test_last_outline_counts(spark):
    images = spark.createDataFrame([("a",), ("b",)], "image_name string")
    outlines = spark.createDataFrame([("a", [[1, 1]], 0), ("a", [[2, 2]], 1)], "filename string, polygon array<array<int>>, line int")
    got = {r.image_name: r.outline for r in A.attach_outline(images, outlines, "line").collect()}
    assert got == {"a": [[2, 2]], "b": None}


def test_vector_table_needs_both_sides(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "id long, embedding array<float>")
    meta = spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string")
    T.write_vectors(v, meta, str(tmp_path / "v"))
    assert {r.id: r.vector_ok for r in T.read_vectors(spark, str(tmp_path / "v")).collect()} == {1: True, 2: False}
    with pytest.raises(ValueError, match="1 vectors without metadata"):
        T.write_vectors(v, meta.filter("id = 1"), str(tmp_path / "w"))


def test_index_is_partitioned(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0], "visual_low", 0), (2, [2.0], "visual_high", 1)], "id long, embedding array<float>, config string, cell int")
    T.save_index(v, v.groupBy("config").count(), str(tmp_path / "i"), "cell")
    low = T.read_index(spark, str(tmp_path / "i"), "visual_low")
    assert [r.id for r in low.collect()] == [1]
    assert "PartitionFilters: [isnotnull(config" in low._jdf.queryExecution().executedPlan().toString()


def test_manifest_ids(spark, tmp_path):
    df = spark.createDataFrame([(f"i{n}.jpg", n % 4) for n in range(12)], "image string, total_defects long")
    T.write_manifest(df, str(tmp_path / "m"), [F.col("total_defects"), F.col("image")])
    rows = T.read_manifest(spark, str(tmp_path / "m")).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(12))
    assert [(r.total_defects, r.image) for r in rows] == sorted((n % 4, f"i{n}.jpg") for n in range(12))


def test_both_metric_layouts(spark, tmp_path):
    lines = [
        {"config": "new", "total_cases": 9, "successful_cases": 7, "failed_cases": 2, "avg_recall_at_k": 0.5},
        {"config": "old", "num_cases": 4, "avg_retrieval_time_ms": 1.5},
    ]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, lines)))
    got = {r.config: tuple(r)[1:] for r in T.read_metrics(spark, str(tmp_path)).collect()}
    assert got == {"new": (9, 7, 2, 0.5, 0.0, 0.0), "old": (4, 4, 0, 0.0, 1.5, 0.0)}


def test_configs_without_index_are_left_out(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0], "visual_low")], "id long, embedding array<float>, config string")
    got = T.list_configs(v, ["visual_indices", "text_indices"], ["high", "low"]).collect()
    assert [tuple(r) for r in got] == [("visual_low", "visual", "low", 2, 1)]


def test_documents_of_an_image_are_bounded(spark, views, monkeypatch):
    from types import SimpleNamespace

    from defectlens.plans.catalog import scans

    monkeypatch.setattr(scans, "DOCUMENT_SHAPES", 50)
    hot = views.polygons.withColumns({"image_id": F.lit(7).cast("bigint"), "image_w": F.lit(100), "image_h": F.lit(100)}).limit(1000)
    folder = scans._image_documents(SimpleNamespace(spark=spark, polygons=hot))
    sizes = [r.n for r in A.read_annotations(spark, folder, "*", multi_line=False).select(F.size("shapes").alias("n")).collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 50


def test_many_documents_share_a_file(spark, tmp_path):
    from defectlens.plans.catalog import scans

    square = [[1.9, 2.9], [11.2, 2.0], [11.9, 22.7]]
    texts = [json.dumps(document(f"{i}.jpg", [shape("2", square)]), indent=1) for i in range(600)]
    docs = spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1)
    files = docs.mapInArrow(scans._lists_of_documents, "value string")
    files.write.option("maxRecordsPerFile", 1).text(str(tmp_path / "docs"))
    assert len(list((tmp_path / "docs").glob("part-*.txt"))) == 3
    valid, bad = A.split_valid(A.read_annotations(spark, str(tmp_path / "docs"), "part-*.txt"))
    assert bad.count() == 0 and sorted(r.imagePath for r in valid.collect()) == sorted(f"{i}.jpg" for i in range(600))
