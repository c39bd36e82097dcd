"""Column functions at their thresholds."""

import pytest
from pyspark.sql import functions as F

from defectlens.dims import LABEL_NAMES, TAXONOMY
from defectlens.functions import geometry as G
from defectlens.functions import labels as L
from defectlens.functions import register
from defectlens.functions import text as X
from defectlens.functions import vectors as V


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return list(row) if len(columns) > 1 else row[0]


def test_thirds_and_edges(spark):
    zone = lambda x, y: G.spatial_zone(F.lit(x), F.lit(y))
    assert one(spark, zone(0.3299, 0.33), zone(0.33, 0.67), zone(0.67, 0.0)) == ["middle_left", "bottom_center", "top_right"]
    edge = lambda x, y: G.near_edge(F.lit(x), F.lit(y))
    assert one(spark, edge(0.15, 0.5), edge(0.1499, 0.5), edge(0.5, 0.8501), edge(0.85, 0.85)) == [False, True, True, False]


@pytest.mark.parametrize(
    "area,name",
    [(49, "very_small"), (50, "small"), (199, "small"), (200, "medium"), (800, "large"), (1500, "very_large")],
)
def test_size_class(spark, area, name):
    assert one(spark, G.size_class(F.lit(area), F.lit(100), F.lit(100))) == name


def test_iou(spark):
    iou = lambda a, b: G.bbox_iou(*[F.lit(v) for v in (*a, *b)])
    got = one(spark, iou((0, 0, 10, 10), (20, 20, 30, 30)), iou((0, 0, 10, 10), (10, 0, 20, 10)), iou((0, 0, 10, 10), (0, 0, 5, 10)))
    assert got == [0.0, 0.0, 0.5]
    assert one(spark, iou((1, 1, 1, 1), (1, 1, 1, 1))) == 0.0
    dist = G.bbox_distance(*[F.lit(v) for v in (0, 0, 11, 11, 0, 0, 13, 13)])
    assert one(spark, dist) == pytest.approx(2**0.5)


def test_stored_crop_record(spark):
    # a real record: box 2786,1232..2996,1410 in 3264x2448 with 30 px padding
    box = [F.lit(v) for v in (2786, 1232, 2996, 1410)]
    w, h = F.lit(3264), F.lit(2448)
    window = G.crop_window(*box, w, h, F.lit(30), F.lit(30))
    x, y = G.relative_centre(box[0], box[2], w), G.relative_centre(box[1], box[3], h)
    got = one(spark, window, G.spatial_zone(x, y), G.size_class(G.box_area(*box), w, h), G.near_edge(x, y))
    assert tuple(got[0]) == (2756, 1202, 3026, 1440)
    assert got[1:] == ["middle_right", "very_small", True]


def test_points_are_truncated_before_min_max(spark):
    points = F.array(F.array(F.lit(-0.5), F.lit(10.9)), F.array(F.lit(7.99), F.lit(-3.2)))
    assert tuple(one(spark, G.bbox_from_points(points))) == (0, -3, 7, 10)
    assert tuple(one(spark, G.bbox_from_points_late(points, F.lit(5), F.lit(5)))) == (0, 0, 5, 5)


def test_padding(spark):
    pad = lambda area, kind, x, y, w=1000: G.padding_factor(F.lit(area), F.lit(kind), F.lit(x), F.lit(y), F.lit(w), F.lit(w))
    got = one(spark, pad(400, "crack", 0.5, 0.5), pad(5000, "missing_part", 0.05, 0.5), pad(20000, "dent", 0.5, 0.5), pad(8000, "other", 0.5, 0.5, 300))
    assert got == [pytest.approx(0.6), pytest.approx(0.15), pytest.approx(0.2125), pytest.approx(0.28)]


def test_letterbox_and_ids(spark):
    assert tuple(one(spark, G.letterbox(F.lit(200), F.lit(100)))) == (2.24, 448, 224, 0, 112)
    ids = one(spark, G.region_id(F.lit("a"), "roi", F.lit(7)), G.region_id(F.lit("a"), "roi", F.lit(1234)), G.region_id(F.lit("a"), "grid", F.lit(5), F.lit(6)))
    assert ids == ["a_roi_007", "a_roi_1234", "a_grid_5_6"]


@pytest.mark.parametrize(
    "name,mode,zone",
    [
        ("zona1_ko_2_3_155_zona_5_imageDANO_original.jpg", "strip_ext", "5"),
        ("zona1_ko_zona_10.jpg", "strip_ext", "10"),
        ("zona1_ko_zona_10.jpg", "raw", "unknown"),
        ("zona1_ko_zona_x_1.jpg", "strip_ext", "unknown"),
        ("zona3_ko_2.jpg", "dataset_prefix", "3"),
        ("zona3_ko_2.jpg", "strip_ext", "unknown"),
    ],
)
def test_vehicle_zone(spark, name, mode, zone):
    assert one(spark, L.vehicle_zone(F.lit(name), mode)) == zone


def test_normalize(spark):
    for label, (bench, sure) in TAXONOMY.items():
        got = one(spark, L.normalize_label(F.lit(f" {label.upper()} ")))
        assert (got["benchmark_label"], got["confidence"], got["error"]) == (bench, sure, None)
    odd = one(spark, L.normalize_label(F.lit("Rust")))
    assert tuple(odd) == ("Unknown", 0.0, "rust", "NO_MAPPING_FOR_rust")
    assert one(spark, L.dominant_or_single(F.lit(""), F.lit("dent"))) == "dent"
    assert one(spark, L.dominant_or_single(F.lit(None).cast("string"), F.lit(""))) == "unknown"
    assert one(spark, L.display_label(F.lit("7")), L.display_label(F.lit("Degraded varnish"))) == ["Missing Accessory", "Degraded Varnish"]
    assert [one(spark, L.label_of(F.lit(n))) for n in LABEL_NAMES.values()] == list(LABEL_NAMES)


def counts(*rows):
    return F.array(*[F.struct(F.lit(n).cast("bigint").alias("n"), F.lit(f).cast("bigint").alias("first"), F.lit(t).alias("name")) for n, f, t in rows])


def test_descriptions(spark):
    c = counts((1, 0, "deep_scratch"), (3, 2, "dent"), (1, 1, "crack"))
    place = (F.lit("Center hood"), F.lit("frontal"))
    got = one(
        spark,
        X.describe_damage(c, *place),
        X.describe_damage(c, *place, "short"),
        X.describe_damage(c, *place, "v1"),
        X.describe_damage(c, *place, "v2"),
        X.describe_crop(F.lit(True), c, *place),
    )
    assert got == [
        "3 dents and 1 deep_scratch and 1 crack on Center hood (frontal area)",
        "3 dents and 1 deep_scratch and 1 crack on Center hood (frontal)",
        "3 dents, 1 deep_scratch, 1 crack on Center hood (frontal area)",
        "3 dents, 1 deep scratch, 1 crack on Center hood (frontal area)",
        "1 deep_scratch and 1 crack and 3 dents on Center hood (frontal). Specific defects visible: deep_scratch, crack, dent.",
    ]
    none = F.array().cast("array<struct<n:bigint,first:bigint,name:string>>")
    assert one(spark, X.describe_damage(none, *place, "v1"), X.describe_damage(none, *place, "v2")) == [
        "no visible damage",
        "no visible damage on Center hood (frontal area)",
    ]
    assert one(spark, X.format_spatial(counts((2, 5, "top_left"), (1, 0, "middle_center")))) == (
        "2 defects in Top Left, 1 defect in Middle Center"
    )


def test_answers_and_truncation(spark):
    assert one(spark, X.strip_fence(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, X.truncate_text(F.lit("x" * 501)), X.truncate_text(F.lit("x" * 500))) == ["x" * 500 + "...\n\n*(Truncated)*", "x" * 500]
    null = F.lit(None).cast("string")
    got = one(spark, X.answer_or_error(F.lit("Error: down"), null), X.answer_or_error(null, F.lit("timeout")), X.answer_or_error(F.lit("fine"), null))
    assert got == [
        '{"damages":[],"summary":"Analysis failed","error":"Error: down"}',
        '{"damages":[],"summary":"Error","error":"timeout"}',
        "fine",
    ]


def vec(*values):
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<float>")


def test_vectors(spark):
    assert one(spark, V.l2_normalize(vec(3, 4)), V.l2_normalize(vec(0, 0))) == [pytest.approx([0.6, 0.8]), [0.0, 0.0]]
    assert one(spark, V.l2sq(vec(1, 0), vec(0, 1)), V.similarity_pct(F.lit(2.0)), V.cosine(vec(0, 0), vec(1, 0))) == [2.0, -100.0, None]
    fused = one(spark, V.fuse_concat(vec(2, 0), vec(0, 5)))
    assert fused == pytest.approx([0.6 / 0.52**0.5, 0, 0, 0.4 / 0.52**0.5])
    with pytest.raises(ValueError):
        V.fuse_concat(vec(1), vec(1), 0.7, 0.4)
    with pytest.raises(ValueError):
        V.fuse_mean(vec(1), vec(1), "other")
    assert one(spark, V.has_bad_values(vec("nan", 1)), V.has_bad_values(vec("inf")), V.has_bad_values(vec(1))) == [True, True, False]


def test_sql_functions(spark):
    assert "l2sq" in register(spark)
    row = spark.sql(
        "SELECT l2sq(array(1f, 0f), array(0f, 1f)) a, cosine(array(1f, 0f), array(1f, 1f)) b, normalize_label(' DENT ') c, canonical_label('4') d, "
        "spatial_zone(0.1D, 0.9D) e, bbox_iou(0, 0, 10, 10, 0, 0, 5, 10) f"
    ).first()
    assert (row.a, round(row.b, 6), row.c, row.d, row.e, row.f) == (2.0, 0.707107, "Dent", "deep_scratch", "bottom_left", 0.5)
