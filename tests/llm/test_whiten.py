import math

import numpy as np
import pytest

from palaver.llm import whiten as W

SCHEMA = "vec_id long, embedding array<float>"


def table_of(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return W.op13_embedding_whitening(spark, str(tmp_path))


@pytest.mark.parametrize("d", [1, 2, 3, 10, 33])
def test_jacobi_equals_the_library(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, d))
    a = a @ a.T
    values, vectors = W.jacobi(a)
    want = np.linalg.eigvalsh(a)[::-1]
    assert np.allclose(values, want, rtol=1e-12, atol=1e-12 * want[0])
    assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-13) and np.allclose(vectors @ np.diag(values) @ vectors.T, a, atol=1e-12 * want[0])


def test_jacobi_keeps_small_eigenvalues():
    """A graded matrix: relative accuracy far beyond what the largest entry would leave."""
    rng = np.random.default_rng(0)
    m = np.eye(6) + 0.01 * rng.normal(size=(6, 6))
    m = (m + m.T) / 2
    scale = 10.0 ** -np.arange(0, 18, 3)
    values, _ = W.jacobi(scale[:, None] * m * scale)
    from fractions import Fraction

    exact = [[Fraction(float(x)) for x in row] for row in scale[:, None] * m * scale]
    for k in (5, 4):  # the determinant of a - e I changes its sign next to e

        def sign(e, exact=exact):
            a = [[x - (e if i == j else 0) for j, x in enumerate(r)] for i, r in enumerate(exact)]
            out = 1
            for i in range(6):
                out *= a[i][i]
                for r in range(i + 1, 6):
                    f = a[r][i] / a[i][i]
                    a[r] = [x - f * y for x, y in zip(a[r], a[i], strict=True)]
            return out > 0

        e = Fraction(float(values[k]))
        assert sign(e * Fraction(10**10 - 1, 10**10)) != sign(e * Fraction(10**10 + 1, 10**10))


def test_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(700, 40)) @ rng.normal(size=(40, 40)) / 30).astype(np.float32)
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)]
    bad = [(1000, None), (1001, [None] + [0.0] * 39), (1002, [math.nan] + [0.0] * 39), (1003, [math.inf] + [0.0] * 39), (1004, [0.5] * 7), (1005, [])]
    got = table_of(spark, tmp_path, [*rows, *bad, rows[5]])
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    x = np.floor(64 * np.vstack([v, v[5]]).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    y = x - sums / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = y @ vectors[:, :32] / np.sqrt(values[:32])
    assert len(got) == 701 * 32 and {r.n for r in got} == {701} and {r.vec_id for r in got} == set(range(700))
    sides = {}
    for r in got:
        k = r.component - 1
        assert r.deviation == sum((n * int(c) - int(s)) ** 2 for c, s in zip(x[r.vec_id], sums, strict=True))
        assert abs(abs(r.whitened) - abs(want[r.vec_id, k])) < 1e-9 and abs(r.explained / (values[k] / values.sum()) - 1) < 1e-9
        if abs(r.whitened) > 1e-6:
            sides.setdefault(k, set()).add(r.whitened * want[r.vec_id, k] > 0)
        assert r.identity_error < 1e-9
    assert all(len(s) == 1 for s in sides.values())


def test_few_dimensions_ranks_and_nothing(spark, tmp_path):
    rows = [(i, [float(i % 7), 2.0 * (i % 7), 0.25]) for i in range(50)]
    got = table_of(spark, tmp_path / "a", rows).collect()
    assert {r.component for r in got} == {1, 2, 3} and {r.component for r in got if r.whitened is None} == {2, 3}
    assert {r.explained for r in got if r.component > 1} == {0.0} and all(r.identity_error < 1e-9 for r in got)
    same = table_of(spark, tmp_path / "b", [(1, [1.0, 2.0]), (None, [1.0, 2.0])]).collect()
    assert len(same) == 4 and all((r.whitened, r.explained, r.identity_error, r.deviation) == (None, None, None, 0) for r in same)
    assert table_of(spark, tmp_path / "c", [(1, None), (2, [])]).count() == 0
    assert table_of(spark, tmp_path / "d", [], SCHEMA).count() == 0
    wide = spark.createDataFrame([(i, [float(i), -float(i * i)], 1.0, "n") for i in range(9)], "vec_id long, embedding array<double>, whitened double, x string")
    assert W.whitened(wide).where("component = 1 and identity_error < 1e-9").count() == 9


def test_large_entries(spark):
    rows = [(i, [float(i) * 2.0**33, float(i % 3)]) for i in range(20)] + [(99, [2.0**41, 0.0])]
    got = W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 40 and all(r.identity_error < 1e-6 for r in got) and any(r.deviation is None for r in got)
