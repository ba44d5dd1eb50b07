"""Codes, errors and codebooks are those of Lloyd's rounds by full scans."""

import hashlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from sparkloom.llm import codes, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, scale=256, parts=16, entries=64, rounds=2):
    """{position in rows: (code, error)} and the digest, for vectors of one length."""
    kept = [(k, np.floor(scale * np.array(v, float)).astype(object)) for k, (_, v, _) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (rows[r[0]][0] is None, rows[r[0]][0] or 0, rows[r[0]][1]))
    d = len(kept[0][1])
    cuts = [k * d // parts for k in range(parts + 1)]
    book = [[list(x[a:b]) for _, x in order[:entries]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def assign():
        out = {}
        for k, x in kept:
            own = []
            for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                far = [sum((int(s) - int(t)) ** 2 for s, t in zip(x[a:b], e, strict=True)) for e in book[p]]
                own.append((min(far), far.index(min(far))))
            out[k] = own
        return out

    for _ in range(rounds):
        found = assign()
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            for e in range(len(book[p])):
                mine = [x[a:b] for k, x in kept if found[k][p][1] == e]
                if mine:
                    book[p][e] = [int(sum(c)) // len(mine) for c in zip(*mine, strict=True)]
    out = {k: ("".join(f"{e:02x}" for _, e in own), sum(f for f, _ in own)) for k, own in assign().items()}
    return out, hashlib.sha256(",".join(str(int(v)) for p in book for e in p for v in e).encode()).hexdigest()


def vectors(n, d, seed, centres=0):
    g = np.random.default_rng(seed)
    v = g.normal(size=(n, d)) / 8
    if centres:
        v = v / 40 + g.normal(size=(centres, d))[g.integers(centres, size=n)] / 8
    return v.astype(np.float32).astype(float).tolist()


def held(spark, rows, lengths=1):
    got = [tuple(r) for r in codes.compressed(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    want, errors = [], defaultdict(int)
    found = {}
    for d in {len(v) for _, v, _ in rows if v is not None}:
        own = [r if r[1] is not None and len(r[1]) == d else (r[0], None, r[2]) for r in rows]
        if not any(v is not None and all(x is not None and np.isfinite(x) for x in v) for _, v, _ in own):
            continue
        out, sha = brute(own)
        found |= {k: (*x, sha) for k, x in out.items()}
    for k, (_, error, _) in found.items():
        errors[rows[k][2]] += error
    want = [(rows[k][0], code, error, errors[rows[k][2]], sha) for k, (code, error, sha) in found.items()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_as_by_brute_force(spark):
    rows = [(i * 7 % 301, v, i % 5 or None) for i, v in enumerate(vectors(200, 32, 1))]
    nan, inf = float("nan"), float("inf")
    odd = [(1, [0.0] * 32, 1), (2, None, 1), (3, [nan] + [0.1] * 31, 2), (4, [inf] + [0.1] * 31, 2), (5, [None] + [0.1] * 31, 2), (None, [0.25] * 32, None)]
    held(spark, rows + odd + rows[:20])


def test_lengths_of_their_own(spark):
    rows = [(i, v, 1) for i, v in enumerate(vectors(70, 21, 2))] + [(100 + i, v, 2) for i, v in enumerate(vectors(9, 5, 3))] + [(500, [-1.0], 1), (501, [], None)]
    held(spark, rows)


def test_ties_and_clusters(spark):
    g = np.random.default_rng(4)
    held(spark, [(i, (g.integers(-2, 3, size=16) / 256).tolist(), i % 3) for i in range(150)])
    held(spark, [(i, v, i % 3) for i, v in enumerate(vectors(160, 32, 5, centres=20))])


def test_no_rows(spark):
    assert codes.compressed(spark.createDataFrame([], SCHEMA)).count() == 0
    assert codes.compressed(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0


@pytest.mark.parametrize("big", [False, True])
def test_bounds_save_distances_and_change_nothing(big):
    x = codes.integers(np.array(vectors(3000, 4, 6, centres=64)) * (1e6 if big else 1))
    c = x[:64].copy()
    own = codes.groups(c)
    at, best, low = codes.first(x, c, own)
    for _ in range(4):
        new = c.copy()
        for e in np.unique(at):
            new[e] = x[at == e].sum(axis=0) // (at == e).sum()
        far = np.sqrt(((new - c) ** 2).sum(axis=1).astype(float)) * (1 + 1e-12)
        drift, c = np.array([far[own == g].max(initial=0) for g in range(own.max() + 1)]), new
        low = codes._bounds(codes._packed_bounds(low))
        at, best, low, taken = codes.again(x, c, own, at, low, drift)
        full = codes.squares(x, c)
        assert (at == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
        for g in range(own.max() + 1):
            others = np.where(np.arange(64)[None] == at[:, None], codes.FAR, full)[:, own == g].min(axis=1, initial=codes.FAR)
            assert (low[:, g] <= codes._below(others)).all()
    assert taken < 0.7 * x.shape[0] * 64


def test_components_saturate_where_errors_would_not_fit(spark):
    rows = [(i, [(-1) ** i * 3e38] * 16, 1) for i in range(4)] + [(9, [0.5] * 16, 1)]
    got = codes.compressed(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5 and all(0 <= r.error < 2**63 for r in got)


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    names = "vec_id, code, error, label_error, codebooks_sha256"
    want = con.sql(f"select {names} from ({queries.oracle_sql()['op11_vector_codes']}) order by vec_id").fetchall()
    assert [tuple(r) for r in queries.op11_vector_codes(spark, sf).select(*names.split(", ")).orderBy("vec_id").collect()] == want


def test_columns_with_clashing_names(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(vectors(80, 16, 8))], SCHEMA)
    wide = df.withColumns({n: F.lit(f"own {n}") for n in ("id", "v", "d", "turn", "x", "codes", "ids", "labels", "error", "code", "a.b")})
    assert sorted(map(tuple, codes.compressed(wide).collect())) == sorted(map(tuple, codes.compressed(df).collect()))
