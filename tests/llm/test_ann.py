"""On clustered vectors a query visits few leaves, and stops where nothing nearer can lie."""

import numpy as np

from sparkloom.llm import ann


def clustered(n, d, clusters, seed):
    g = np.random.default_rng(seed)
    return g.normal(size=(clusters, d))[g.integers(clusters, size=n)] + g.normal(size=(n, d)) / 12


def test_few_leaves_on_clustered_vectors(spark, monkeypatch):
    n, k = 8000, 10
    x = clustered(n, 24, 120, 3)
    monkeypatch.setattr(ann, "LEAF", 128)
    visited = []
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, k).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        visited.append(r.visits)
    hit = 0
    for q in range(0, n, 100):
        dist = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        dist[q] = np.inf
        hit += len(set(got[q]) & set(np.argsort(dist, kind="stable")[:k].tolist()))
    assert hit / (k * len(got)) >= 0.9 and len(got) == 80
    assert max(visited) * 128 < 0.2 * n


def test_margins_bound_the_distance():
    x = clustered(3000, 16, 40, 5)
    forest = ann.Forest.fit(x, 3, 32)
    leaves = forest.assign(x)
    for q in x[:20] + 0.05:
        dist = np.sqrt(((x - q) ** 2).sum(axis=1))
        for t, leaf, margin in forest.order(q):
            assert margin <= dist[leaves[:, t] == leaf].min(initial=np.inf) + 1e-9


def test_the_nearest_by_products_are_the_nearest():
    g = np.random.default_rng(6)
    x = np.round(g.normal(size=(700, 8)), 1)
    for scale in (1.0, 1e-160, 1e160):
        for n, k in ((700, 5), (3, 5), (5, 5)):
            for v, (at, dist) in zip(x[:50] * scale, ann._near(x[:50] * scale, x[:n] * scale, k), strict=True):
                with np.errstate(over="ignore"):
                    every = np.sqrt(((x[:n] * scale - v) ** 2).sum(axis=1))
                kth = np.sort(every)[min(k, n) - 1]
                assert sorted(at.tolist()) == np.flatnonzero(every <= kth).tolist() and (dist == every[at]).all()
