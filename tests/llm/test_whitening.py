"""Whitening against dense linear algebra, exact sums and edge cases."""

import numpy as np
import pytest
from conftest import SF

from rowferry.llm import queries, whitening


def brute(rows):
    used = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in used})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], dtype=float) / n
    cov = y.T @ y / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:4], vectors.T[::-1][:4]
    out = {}
    for i, x in used:
        own = np.array([n * c - s for c, s in zip(x, sums)], dtype=float) / n
        dev = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        for k, (e, v) in enumerate(zip(values, vectors), 1):
            out.setdefault((i, k), []).append((n, dev, abs(own @ v) / np.sqrt(e), e / np.trace(cov)))
    return out


def check(got, want):
    assert len(got) == sum(map(len, want.values()))
    for r in got:
        options = want[r.vec_id, r.component]
        assert any(
            (r.n, r.deviation) == o[:2] and abs(abs(r.whitened) - o[2]) < 1e-9 and abs(r.explained - o[3]) < 1e-9 for o in options
        )
        assert 0 <= r.identity_error < 1e-9


def test_registered_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = queries.op13_whitening(spark, SF).collect()
    check(got, brute([(r.vec_id, r.embedding) for r in rows]))


def test_edge_cases(spark):
    rng = np.random.default_rng(0)
    good = [(i, rng.normal(size=5).tolist()) for i in range(40)] + [(50, [1.0] * 5), (51, [1.0] * 5), (None, [0.0] * 5), (50, [2.0] * 5)]
    bad = [(60, None), (61, []), (62, [1.0, None, 0.0, 0.0, 0.0]), (63, [float("nan")] * 5), (64, [float("inf")] * 5), (65, [1.0, 2.0])]
    schema = "vec_id long, embedding array<double>, x string, n int, component double"
    table = spark.createDataFrame([(i, v, "a", 1, 0.5) for i, v in good + bad], schema).repartition(7)
    got = whitening.whiten(table).collect()
    check(got, brute(good))
    signs = {np.sign(r.whitened) for r in got if r.component == 1}
    assert len(signs) > 1
    assert whitening.whiten(table.where("false")).count() == 0
    assert whitening.whiten(table.where("vec_id = 51")).count() == 0


def test_exact_beyond_64_bits(spark):
    table = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(table).collect()
    x = {1: [2**63 - 1, 0], 2: [-(2**63), 256], 3: [1280, 512]}
    sums = [sum(c) for c in zip(*x.values())]
    exact = {i: sum((3 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in x.items()}
    assert {r.vec_id: r.deviation for r in got} == {i: v if v < 2**63 else None for i, v in exact.items()}
    assert all(np.isfinite(r.whitened) for r in got)


@pytest.mark.parametrize("d", [1, 2, 3, 8, 40])
def test_components(d):
    rng = np.random.default_rng(d)
    base = np.linalg.qr(rng.normal(size=(d, d)))[0]
    close = np.ones(d)
    close[: min(d, 3)] = 5 + 1e-9 * np.arange(min(d, 3))
    for matrix in (np.eye(d), np.diag(np.arange(1.0, d + 1)), (base * close) @ base.T, (base * rng.random(d)) @ base.T * 1e9):
        matrix = (matrix + matrix.T) / 2
        values, vectors = whitening.leading_components(matrix, 4)
        size = np.abs(matrix).max()
        assert np.allclose(values, np.sort(np.linalg.eigvalsh(matrix))[::-1][:4], atol=1e-13 * size * d, rtol=0)
        assert np.allclose(vectors @ vectors.T, np.eye(len(vectors)), atol=1e-13)
        assert np.abs(matrix @ vectors.T - vectors.T * values).max() < 1e-12 * size
    assert len(whitening.leading_components(np.zeros((d, d)), 4)[0]) == 0
