from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from defectlens.llm import catalog, whitening

INF, NAN = float("inf"), float("nan")


def brute(vectors):
    """Exact mean, deviations and covariance in fractions."""
    x = [[int(np.floor(1024 * np.float64(c))) + 100_000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    sums = [sum(col) for col in zip(*x)]
    centred = [[n * a - s for a, s in zip(row, sums)] for row in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in centred), n**3)) for j in range(dims)] for i in range(dims)])
    return x, centred, cov


def check(rows, vectors, ids, dims_out):
    _, centred, cov = brute(vectors)
    n = len(vectors)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:dims_out], v[:, ::-1][:, :dims_out]
    by_row = {}
    for r in rows:
        by_row.setdefault(r[0], []).append(r)
    assert set(by_row) == set(ids) and len(rows) == len(ids) * dims_out
    z = np.array([[r[4] for r in sorted(by_row[i], key=lambda r: r[1])[:dims_out]] for i in ids])
    want = np.array([[float(Fraction(a, n)) for a in row] for row in centred]) @ v / np.sqrt(e)
    sign = np.sign((z * want).sum(0))
    assert np.abs(z * sign - want).max() < 1e-6
    for i, row in zip(ids, centred):
        for _, c, count, deviation, _, explained, error in by_row[i]:
            assert count == n and deviation == sum(a * a for a in row) and error < 1e-4
            assert explained == pytest.approx(e[c - 1] / np.trace(cov), rel=1e-9)


def test_query(spark, data_dir):
    rows = [tuple(r) for r in catalog.QUERIES["op13_whitening"](spark, data_dir).collect()]
    given = [r for r in spark.read.parquet(f"{data_dir}/embeddings.parquet").collect() if r.embedding is not None and np.isfinite(r.embedding).all()]
    check(rows, [r.embedding for r in given], [r.vec_id for r in given], 8)


def test_rows_left_out_and_far_values(spark, table):
    rnd = np.random.default_rng(3)
    fine = [[float(a) for a in np.float32(rnd.normal(0, 1, 4) * [1, 10, 0.1, 5])] for _ in range(60)]
    fine += [[1e8, -3e7, 2e6, 7.0], [-1e11, 0.0, 1.0, 3e11]] + [fine[0]] * 30
    rows = [(i, v) for i, v in enumerate(fine)]
    odd = [None, [], [1.0, None, 2.0, 3.0], [1.0, NAN, 2.0, 3.0], [INF, 1.0, 2.0, 3.0], [1.0, 2.0], [1e300, 1.0, 1.0, 1.0]]
    rows += [(1000 + i, v) for i, v in enumerate(odd)]
    df = table(rows, "vec_id long, embedding array<double>").repartition(5)
    found = whitening.components(df, ["vec_id"], count=2)
    assert {r.row.vec_id for r in found.collect()} == set(range(len(fine)))
    x, centred, _ = brute(fine)
    assert {r.row.vec_id: r.deviation for r in found.collect()} == {i: Decimal(sum(a * a for a in row)) for i, row in enumerate(centred)}


def test_covariance_is_exact(spark, table):
    rnd = np.random.default_rng(4)
    fine = [[float(a) for a in rnd.integers(-5000, 5000, 5) / 7] for _ in range(300)]
    df = table([(i, v) for i, v in enumerate(fine)], "vec_id long, embedding array<double>").repartition(7)
    x, _, cov = brute(fine)
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    squares = whitening.pair_squares(np.array(x) - np.array(centre))
    got = whitening.covariance(n, [s - n * c for s, c in zip(sums, centre)], squares)
    assert got.tolist() == cov.tolist()
    check([(r.row.vec_id, *r[1:]) for r in whitening.components(df, ["vec_id"]).collect()], fine, list(range(300)), 5)


def test_nothing_to_whiten(spark, table):
    df = table([(1, [1.0, 2.0]), (None, [1.0, 2.0]), (2, None)], "vec_id long, embedding array<double>")
    for frame in (df, df.limit(0), df.filter("vec_id = 2")):
        assert whitening.components(frame, ["vec_id"]).count() == 0
    # one dimension varies: one component; null ids and repeated rows are kept
    line = table([(1, [1.0, 2.0]), (None, [2.0, 2.0]), (1, [1.0, 2.0]), (3, [4.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.components(line, ["vec_id", "row"]).collect()
    assert sorted((r.row.vec_id or 0, r.component) for r in got) == [(0, 1), (1, 1), (1, 1), (3, 1)]
    assert np.mean([r.whitened**2 for r in got]) == pytest.approx(1)
