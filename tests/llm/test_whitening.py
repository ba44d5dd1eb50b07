"""Whitening against a decomposition of the whole covariance at once."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def correlated(n, d, seed):
    g = np.random.default_rng(seed)
    return (g.normal(size=(n, d)) * np.geomspace(1, 0.05, d) @ g.normal(size=(d, d)) / 8 + 0.3).astype(np.float32).astype(float)


def held(got, vectors):
    """got: rows of whitened(); vectors: by id, of one length."""
    ids = sorted(vectors)
    x = np.array([[math.floor(1024 * c) + 100_000 for c in vectors[i]] for i in ids], object)
    n, sums = len(ids), x.sum(axis=0)
    mid = x.astype(float) - np.array([s / n for s in sums])
    e, v = np.linalg.eigh(mid.T @ mid / n)
    e, v = e[::-1], v[:, ::-1].T
    own = {(r.vec_id, r.component): r for r in got}
    k = min(8, x.shape[1])
    assert sorted(own) == sorted((i, c) for i in ids for c in range(1, k + 1)) and len(got) == len(own)
    for at, i in enumerate(ids):
        r = own[i, 1]
        assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[at], sums, strict=True))
    white = np.array([[own[i, c].whitened for c in range(1, k + 1)] for i in ids])
    assert np.abs(np.abs((white * (mid @ v[:k].T / np.sqrt(e[:k]))).mean(axis=0)) - 1).max() < 1e-6
    assert np.allclose([own[ids[0], c].explained for c in range(1, k + 1)], e[:k] / e.sum(), rtol=1e-9)
    cov = (white - white.mean(axis=0)).T @ (white - white.mean(axis=0)) / n
    assert np.abs(cov - np.eye(k)).max() < 1e-9 and all(r.identity_error < 1e-9 for r in got)


@pytest.mark.parametrize("parts", [1, 40])
def test_against_numpy(spark, parts):
    """40 tasks: summaries of a few rows each, two levels of merging."""
    v = correlated(300, 12, 1)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(900, None), (901, [float("nan")] * 12), (902, [float("inf")] + [0.0] * 11), (903, [None] + [0.0] * 11), (904, [0.0] * 12)]
    got = whitening.whitened(spark.createDataFrame(rows + odd, SCHEMA).repartition(parts)).collect()
    held(got, dict(rows) | {904: [0.0] * 12})


def test_given_table(spark, sf):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    held(queries.op13_whitening(spark, sf).collect(), rows)


def test_merging_loses_nothing():
    g = np.random.default_rng(3)
    x = g.integers(-1000, 1000, size=(500, 9)) * np.geomspace(1, 50, 9).astype(int) + 100_000
    parts = [whitening.Summary.of(p) for p in np.split(x, [3, 4, 200, 201, 450])]
    s = parts[0].plus(parts[1]).plus(*parts[2:])
    mid = x - x.mean(axis=0)
    assert s.n == 500 and s.sums == x.sum(axis=0).tolist() and s.rows.shape == (9, 9)
    assert np.allclose(s.covariance(), mid.T @ mid / 500, rtol=1e-9, atol=1e-6)
    assert np.allclose(s.eigen()[0], np.linalg.eigvalsh(mid.T @ mid / 500)[::-1], rtol=1e-9)


def test_lengths_repeats_and_flat_components(spark):
    rows = [(1, [0.5, 0.25, 1.0]), (2, [0.5, 0.75, 1.0]), (None, [0.5, 0.5, 1.0]), (2, [0.5, 0.75, 1.0]), (7, [2.0]), (8, [])]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    three = [r for r in got if r.n == 4]
    assert len(got) == 13 and len(three) == 12 and sum(r.vec_id is None for r in got) == 3
    assert all((r.whitened is None) == (r.component > 1) for r in three) and all(abs(r.identity_error) < 1e-9 for r in got)
    one = next(r for r in got if r.vec_id == 7)
    assert (one.component, one.n, one.deviation, one.whitened, one.explained, one.identity_error) == (1, 1, 0, None, None, 0.0)


def test_no_rows_and_large_numbers(spark):
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).count() == 0
    got = whitening.whitened(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 1.0])], SCHEMA)).collect()
    assert len(got) == 6 and all(r.deviation is None or r.deviation >= 0 for r in got)
    x = whitening.integers(np.array([[3e9, 1.0], [1.0, 2.0], [-7.5, 3e9]]))
    w = whitening.Whitening.of(whitening.Summary.of(x), 2)
    want = [sum((3 * int(a) - int(s)) ** 2 for a, s in zip(r, x.sum(axis=0), strict=True)) for r in x]
    assert w.deviations(x) == [v if v < 2**63 else None for v in want]


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(correlated(40, 4, 2))], SCHEMA)
    wide = df.withColumns({n: F.lit(f"own {n}") for n in ("id", "v", "d", "k", "n", "sums", "vectors", "up", "whitened", "component", "a.b")})
    a, b = ({(r.vec_id, r.component): (r.n, r.deviation, round(abs(r.whitened), 9)) for r in whitening.whitened(x).collect()} for x in (df, wide))
    assert a == b
