import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_cases import SF, records
from locusframe.llm.whitening import bidiagonalise, whiten


def brute_force(rows, keep=16):
    """Covariance of the distinct integer vectors and its eigenvectors; whitened values up to the sign of a component."""
    x = {i: np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000 for i, v in rows}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(0)
    y = (n * fit - s) / n
    cov = y.T @ y / n
    e, vectors = np.linalg.eigh(cov)
    e, vectors = e[::-1], vectors[:, ::-1]
    k = min(keep, int((e > 1e-12 * e[0]).sum()))
    return n, s, x, e[:k], vectors[:, :k], np.trace(cov)


def check(got, rows, keep=16, distinct_variances=True):
    n, s, x, e, vectors, trace = brute_force(rows, keep)
    assert len(got) == len(rows) * len(e) and {r.component for r in got} == set(range(1, len(e) + 1))
    table = {(r.vec_id, r.component): r for r in got}
    for k, (value, vector) in enumerate(zip(e, vectors.T), 1):
        signs = set()
        for i, v in x.items():
            r = table[i, k]
            assert r.n == n and r.deviation == sum(int(q) ** 2 for q in n * v - s) and abs(r.explained - value / trace) < 1e-9 and r.identity_error < 1e-9
            want = float(((n * v - s) / n) @ vector / math.sqrt(value))
            if distinct_variances and abs(want) > 1e-6:
                signs.add(math.copysign(1, want * r.whitened))
                assert abs(abs(want) - abs(r.whitened)) < 1e-6
        assert len(signs) <= 1


def test_equals_eigenvectors_of_the_covariance(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    check(whiten(vectors).collect(), [(r.vec_id, r.embedding) for r in vectors.collect()])


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(3)
    mixed = rng.standard_normal((60, 5)) @ rng.standard_normal((5, 5))
    return [(i, v.tolist()) for i, v in enumerate(mixed)]


def test_odd_rows(spark, small):
    nan, inf = float("nan"), float("inf")
    odd = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [nan] * 5), (104, [inf, 0.0, 0.0, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [1e30] * 5)]
    frame = spark.createDataFrame([(i, v, 1, "n") for i, v in small + odd], "vec_id int, embedding array<double>, n int, component string")
    check(whiten(frame).collect(), small)
    # copies count once, and give rows each
    copies = frame.where("vec_id < 100").unionByName(frame.where("vec_id < 30").withColumn("vec_id", F.col("vec_id") + 200))
    check(whiten(copies).collect(), small + [(i + 200, v) for i, v in small if i < 30])


def test_directions_without_variance_are_no_components(spark, small):
    flat = [(i, [*v[:3], v[0] * 0 + 2.0, 1.0]) for i, v in small]
    check(whiten(spark.createDataFrame(flat, "vec_id long, embedding array<float>")).collect(), [(i, np.float32(v).tolist()) for i, v in flat])
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert whiten(same).count() == 0 and whiten(same.where("false")).count() == 0
    assert whiten(spark.createDataFrame([(1, [0.5, 1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_equal_variances(spark):
    """A cross has the same variance in every direction: any basis whitens it."""
    rows = [(2 * i + k, [(1.0 if k else -1.0) * (j == i) for j in range(6)]) for i in range(6) for k in range(2)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    check(got, rows, distinct_variances=False)
    table = {(r.vec_id, r.component): r.whitened for r in got}
    w = np.array([[table[i, k] for k in range(1, 7)] for i, _ in rows])
    assert np.allclose(w.T @ w / len(rows), np.eye(6))


def test_null_ids(spark, small):
    frame = spark.createDataFrame([(None, v) for _, v in small], "vec_id long, embedding array<double>")
    got = records(whiten(frame, keep=2), "vec_id", "component")
    assert len(got) == 120 and {i for i, _ in got} == {"null"}


def test_bidiagonal_form():
    rng = np.random.default_rng(1)
    y = rng.standard_normal((40, 12)) * np.logspace(0, -3, 12)
    v, b = bidiagonalise(lambda z, w: ((q := y @ z) @ y, (y @ w).T @ q, float(q @ q)), 12, np.linalg.norm(y))
    assert np.allclose(v.T @ v, np.eye(12)) and np.allclose(np.linalg.svd(b)[1], np.linalg.svd(y)[1])
    assert np.allclose(b, np.triu(np.tril(b, 1)))
