"""Whitening against dense linear algebra, and the eigenvector refinement on hard spectra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.eigen import LONG, refined_eigen, residual
from llm.q_whitening import op12_embedding_whitening
from llm.whitening import by_component, whiten
from tests.llm.conftest import SF


def spectrum(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values),) * 2))
    q = q.astype(LONG)
    for _ in range(3):  # orthonormal in long double
        q = q @ (1.5 * np.eye(len(values), dtype=LONG) - 0.5 * q.T @ q)
    a = (q * np.array(values, LONG)) @ q.T
    return (a + a.T) / 2, q


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(50, 1, 24),
        [3.0] * 5 + [1.0] * 5,  # equal eigenvalues
        [5, 5 - 1e-5, 5 - 2e-5, 5 - 3e-5, 2, 1],  # below single precision apart
        [7, 7 - 1e-9, 7 - 3e-9, 1, 1 - 1e-10, 1 - 4e-10, 0.5],
        [1e6, 10, 1, 1e-3, 1e-4],
        [4, 0, 0],
    ],
)
def test_refined_eigen(values):
    a, q = spectrum(values)
    e, x = refined_eigen(a)
    assert max(residual(a, x, e)) < 1e-16
    true = np.sort(np.array(values, LONG))[::-1]
    assert np.abs(e - true).max() < 1e-16 * max(values) * 4
    # single vectors are right where an eigenvalue is alone
    order = np.argsort(-np.array(values), kind="stable")
    for k, j in enumerate(order):
        gap = min([abs(values[j] - v) for i, v in enumerate(values) if i != j], default=1) / max(values)
        if gap > 1e-11:
            assert 1 - abs(x[:, k] @ q[:, j]) < (1e-17 / gap) ** 2 + 1e-17


def test_refined_eigen_of_nothing():
    e, x = refined_eigen(np.zeros((3, 3)))
    assert not e.any() and np.array_equal(x, np.eye(3))
    assert refined_eigen(np.zeros((0, 0)))[1].shape == (0, 0)


def expected(vectors, k=16):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    mean = s / n
    e, q = np.linalg.eigh(np.cov((fit - 1_000_000).T, bias=True).reshape(x.shape[1], -1))
    e, q = e[::-1], q[:, ::-1]
    k = min(k, int((e > e.sum() * 1e-13).sum()))
    dev = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s)) for row in x]
    return n, dev, ((x - mean) @ q[:, :k]) / np.sqrt(e[:k]), e[:k] / e.sum()


def compare(rows, ids, vectors):
    n, dev, white, share = expected(vectors)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(rows) == white.size
    for j in range(white.shape[1]):
        col = np.array([got[i, j + 1]["whitened"] for i in ids])
        assert min(np.abs(col - white[:, j]).max(), np.abs(col + white[:, j]).max()) < 1e-6
        assert all(abs(got[i, j + 1]["explained"] / share[j] - 1) < 1e-9 for i in ids)
    for i, d in zip(ids, dev):
        assert got[i, 1]["n"] == n and got[i, 1]["deviation"] == d
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


def test_query_against_dense_algebra(spark):
    data = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    use = [r for r in data if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    compare(op12_embedding_whitening(spark, SF).collect(), [r[0] for r in use], [r[1] for r in use])


def test_hard_rows(spark):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(40, 5)).round(3)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(base)]
    rows += [(100 + i, base[0].tolist(), "x") for i in range(200)]  # a hot vector counts once in the fit
    bad = [(None, None, None), (300, None, "x"), (301, [], "x"), (302, [1.0, None, 2.0, 3.0, 4.0], "x"), (303, [float("nan")] * 5, "x"), (304, [float("inf"), 0.0, 0.0, 0.0, 0.0], "x"), (305, [1.0, 2.0], "x"), (306, [1e30, 0.0, 0.0, 0.0, 0.0], "x")]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, n string").withColumns({c: F.lit("clash") for c in ("x", "v", "d", "whitened", "component", "count")})
    out = by_component(whiten(table.repartition(7))).collect()
    compare(out, [r[0] for r in rows], [r[1] for r in rows])
    # a null id is projected as well, and repeated rows each
    twice = spark.createDataFrame([(None, [0.0, 1.0]), (1, [2.0, 5.0]), (1, [2.0, 5.0]), (2, [4.0, 0.5])], "vec_id long, embedding array<float>")
    assert by_component(whiten(twice)).groupBy("vec_id").count().filter("count = 4").count() == 1


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert by_component(whiten(spark.createDataFrame([], schema))).count() == 0
    assert by_component(whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema))).count() == 0
    line = by_component(whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0])], schema))).collect()
    assert {r["component"] for r in line} == {1} and sorted(round(abs(r["whitened"]), 9) for r in line) == [0, 1.224744871, 1.224744871]
    assert all(abs(r["explained"] - 1) < 1e-12 for r in line)


def test_exact_at_large_numbers(spark):
    big = [(1, [1e9, -3e9]), (2, [2e9, 4e9]), (3, [-5e9, 1e9])]
    out = by_component(whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>"))).collect()
    _, dev, white, _ = expected([v for _, v in big])
    got = {r["vec_id"]: r["deviation"] for r in out}
    assert [got[i] for i, _ in big] == [d if d < 1 << 63 else None for d in dev]
    assert max(r["identity_error"] for r in out) < 1e-9
