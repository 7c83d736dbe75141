"""Whitening against numpy's eigh over exact integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from contentlens.llm import registry, whitening
from tests.conftest import SF


def exact(vectors):
    x = np.array([[math.floor(256 * c) for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), dtype=object)
    n, sums = len(fit), fit.sum(0)
    off = (fit - np.array([s / n for s in sums])).astype(float)
    values, turn = np.linalg.eigh(off.T @ off / n)
    return x, n, sums, values[::-1], turn[:, ::-1].T


def frame(spark, vectors, kind="float"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], f"vec_id long, embedding array<{kind}>")


def check(rows, ids, vectors, k):
    x, n, sums, values, components = exact(vectors)
    mean = np.array([s / n for s in sums])
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == len(ids) * k
    for c in range(k):
        white = (x - mean).astype(float) @ components[c] / math.sqrt(values[c])
        mine = np.array([got[i, c + 1].whitened for i in ids])
        sign = np.sign(white @ mine)
        assert np.abs(sign * mine - white).max() < 1e-9
        for at, i in enumerate(ids):
            r = got[i, c + 1]
            assert r.n == n and r.deviation == sum((n * v - s) ** 2 for v, s in zip(x[at].tolist(), sums.tolist()))
            assert math.isclose(r.explained, values[c] / values.sum(), rel_tol=1e-9) and r.identity_error < 1e-9


def test_query_against_eigh(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check(registry.op11_embedding_whitening(spark, SF).collect(), [r.vec_id for r in rows], [r.embedding for r in rows], 4)


@pytest.mark.parametrize("block, keep", [(4, 192), (8, 32), (16, 192)])
def test_small_blocks_and_restarts(spark, monkeypatch, block, keep):
    """Fewer columns than dimensions, with and without starting anew: the residuals still certify all components."""
    monkeypatch.setattr(whitening, "KEEP", keep)
    rng = np.random.default_rng(3)
    v = (rng.standard_normal((300, 90)) * np.linspace(2, 1, 90)).tolist()
    model = whitening.fit(frame(spark, v, "double"), k=4, block=block)
    _, n, _, values, components = exact(v)
    assert model.n == n and model.passes > 2
    assert np.allclose(model.values, values[:4], rtol=1e-12)
    assert all(min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9 for a, b in zip(model.components, components))


def test_odd_rows(spark):
    rng = np.random.default_rng(0)
    good = rng.standard_normal((40, 3)).tolist()
    odd = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 0.0], [1.0, 2.0]]
    vectors = good + odd + good[:5]  # repeated rows are fitted once
    rows = whitening.whitened(frame(spark, vectors, "double")).collect()
    ids = [*range(40), *range(46, 51)]
    check(rows, ids, good + good[:5], 3)  # three dimensions give three components


def test_hot_vector_counts_once(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((30, 4)).tolist() + [[0.5, -0.5, 0.25, -0.0]] * 200
    check(whitening.whitened(frame(spark, v, "double"), k=2).collect(), list(range(230)), v, 2)


def test_flat_and_empty(spark):
    assert whitening.whitened(frame(spark, [])).count() == 0
    assert whitening.whitened(frame(spark, [[1.0, 2.0]] * 3)).count() == 0  # no variance
    line = [[float(i), 2.0 * i, 0.0] for i in range(5)]
    assert {r.component for r in whitening.whitened(frame(spark, line)).collect()} == {1}  # rank one


def test_equal_eigenvalues(spark):
    v = [[s if i == j else 0.0 for i in range(4)] for j in range(4) for s in (1.0, -1.0)]
    rows = whitening.whitened(frame(spark, v)).collect()
    assert len(rows) == 32 and all(r.identity_error < 1e-12 and math.isclose(r.explained, 0.25) for r in rows)


def test_large_entries_stay_exact(spark):
    v = [[1e12, 3.0], [-1e12, 4.0], [5e11, 5.0]]
    got = whitening.whitened(frame(spark, v, "double"), k=1).collect()
    x, n, sums, _, _ = exact(v)
    want = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    assert [r.deviation for r in sorted(got, key=lambda r: r.vec_id)] == [w if w < 1 << 63 else None for w in want]
    assert whitening.whitened(frame(spark, [[1e300, 1.0], [-1e300, 2.0], [0.0, 3.0]], "double"), k=1).count() == 3


def test_clashing_columns(spark):
    df = frame(spark, np.eye(3).tolist()).withColumns({c: F.lit("mine") for c in ("__x", "whitened", "deviation", "x", "extra")})
    out = whitening.whiten(df, whitening.fit(df, k=2))
    assert {*out.columns} == {"vec_id", "embedding", "__x", "x", "extra", "whitened", "deviation"}
    assert {(r["__x"], r.x, r.extra, len(r.whitened)) for r in out.collect()} == {("mine", "mine", "mine", 2)}
