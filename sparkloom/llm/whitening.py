"""Whitening of vectors by hierarchical merging of singular value decompositions.

A summary of some rows is their number, their exact sums, and the full-rank singular values and right vectors of the rows less
their mean. Two summaries are merged by stacking their scaled vectors with one more row, the difference of their means
by the root of n1 n2 / (n1 + n2), and decomposing again: nothing is lost but rounding, and no dimension is left out. Each
task summarises its own rows, batch after batch; summaries meet FAN at a time, level by level, so a task never holds
more than FAN summaries of at most d + 1 by d numbers, however many rows there are. The last one gives the eigenvalues
(singular values squared, over n) and eigenvectors of the covariance.

Cases: vectors that are null or hold null or non-finite components are dropped; zero vectors are kept, an empty one has no
component. Vectors of each length are a fit list of their own. A component without variance has null whitened and takes
no part in identity_error (0 where none has any); explained is null where there is no variance at all. Entries saturate
at 2^40 in size; a deviation that no long holds is null. Null ids and repeated rows are rows like any other; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut
from .vectors import doubles, finite, matrices

SCALE, SHIFT, MOST = 1024, 100_000, 2**40
#: Summaries that a task merges.
FAN = 16
#: A component's variance counts as none below this share of all of it.
NONE = 1e-13


def integers(v: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(v * SCALE), -MOST, MOST).astype(np.int64) + SHIFT


@dataclass
class Summary:
    """n rows with exact sums; rows: singular values times right vectors of the rows less their mean."""

    n: int
    sums: list
    rows: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        """Of whole numbers, or of doubles (then the sums are rounded)."""
        whole = np.issubdtype(x.dtype, np.integer)
        sums = x.astype(object).sum(axis=0).tolist() if whole and len(x) * int(np.abs(x).max(initial=0)) >= 1 << 62 else x.sum(axis=0).tolist()
        return cls(len(x), sums, _reduced(x - np.array([s / len(x) for s in sums])))

    def plus(self, *others: Summary) -> Summary:
        n, sums, stack = self.n, self.sums, [self.rows]
        for o in others:
            gap = np.array([float(b) / o.n - float(a) / n for a, b in zip(sums, o.sums, strict=True)])
            stack += [o.rows, (n / (n + o.n) * o.n) ** 0.5 * gap[None]]
            n, sums = n + o.n, [a + b for a, b in zip(sums, o.sums, strict=True)]
        return Summary(n, sums, _reduced(np.vstack(stack)))

    def eigen(self) -> tuple[np.ndarray, np.ndarray]:
        """Eigenvalues of the covariance, falling, and its unit eigenvectors as rows."""
        d = self.rows.shape[1]
        _, s, vt = np.linalg.svd(np.vstack([self.rows, np.zeros((max(d - len(self.rows), 0), d))]), full_matrices=False)
        return s * s / self.n, vt

    def covariance(self) -> np.ndarray:
        return self.rows.T @ self.rows / self.n


def _reduced(m: np.ndarray) -> np.ndarray:
    """Singular values times right vectors: at most as many rows as columns, with the same products of columns."""
    if len(m) > 2 * m.shape[1]:
        m = np.linalg.qr(m, mode="r")
    _, s, vt = np.linalg.svd(m, full_matrices=False)
    return s[:, None] * vt


_SUMMARY = "d int, k long, n long, sums array<string>, vectors binary"


def _row(d: int, k: int, s: Summary) -> dict:
    # sums as decimal text: of whole numbers they may go beyond a long
    return {"d": d, "k": k, "n": s.n, "sums": [repr(v) for v in s.sums], "vectors": s.rows.tobytes()}


def _summary(n: int, sums: list[str], vectors: bytes) -> Summary:
    number = int if all(s.lstrip("-").isdigit() for s in sums) else float
    return Summary(int(n), [number(s) for s in sums], np.frombuffer(vectors, float).reshape(-1, len(sums)))


def summaries(rows: DataFrame, made: Callable[[np.ndarray], np.ndarray]) -> dict[int, Summary]:
    """The summary of each length of vectors. rows: a column v of doubles; made: the matrix to summarise of some vectors
    of one length (without columns: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own: dict[int, Summary] = {}
        for b in batches:
            for _, v in matrices(b.column(0)):
                x = made(v)
                if x.shape[1]:
                    new = Summary.of(x)
                    own[v.shape[1]] = own[v.shape[1]].plus(new) if v.shape[1] in own else new
        k = TaskContext.get().partitionId()
        found = [_row(d, k, s) for d, s in own.items()]
        if found:
            yield pa.RecordBatch.from_pylist(found, pa.schema([("d", pa.int32()), ("k", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("vectors", pa.binary())]))

    def merge(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("k")
        every = [_summary(n, list(s), v) for n, s, v in zip(p["n"], p["sums"], p["vectors"], strict=True)]
        return pd.DataFrame([_row(int(p["d"].iloc[0]), int(p["k"].iloc[0]) // FAN, every[0].plus(*every[1:]) if len(every) > 1 else every[0])])

    level = cut(rows.select("v").mapInArrow(run, _SUMMARY))
    while (level.agg(F.max("k")).first()[0] or 0) > 0:
        level = cut(level.groupBy("d", F.expr(f"k div {FAN}").alias("up")).applyInPandas(lambda p: merge(p), _SUMMARY))
    return {r["d"]: _summary(r["n"], r["sums"], r["vectors"]) for r in level.toLocalIterator()}


@dataclass
class Whitening:
    """Of one length: n, exact sums, and of each component its variance, its share of all and its vector."""

    n: int
    sums: list[int]
    variance: np.ndarray
    explained: list[float | None]
    vectors: np.ndarray

    @classmethod
    def of(cls, s: Summary, components: int) -> Whitening:
        e, v = s.eigen()
        total = float(e.sum())
        e[e <= NONE * total] = 0
        return cls(s.n, s.sums, e[:components], [float(x) / total if total > 0 else None for x in e[:components]], v[:components])

    def off(self, x: np.ndarray) -> np.ndarray:
        """n times the rows less their mean, in whole numbers."""
        most = max(map(abs, self.sums), default=0) + self.n * int(np.abs(x).max(initial=0))
        return self.n * (x if most < 1 << 62 else x.astype(object)) - np.array(self.sums, np.int64 if most < 1 << 62 else object)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows, a column for each component that has variance."""
        has = self.variance > 0
        return (self.off(x).astype(float) / self.n) @ (self.vectors[has] / self.variance[has, None] ** 0.5).T

    def deviations(self, x: np.ndarray) -> list[int | None]:
        gap = self.off(x)
        if gap.dtype != object and gap.shape[1] * float(np.abs(gap).max(initial=0)) ** 2 < 2.0**62:
            return (gap * gap).sum(axis=1).tolist()
        about = (gap.astype(float) ** 2).sum(axis=1)
        exact = (sum(int(g) ** 2 for g in row) if a < 2.0**64 else 1 << 64 for row, a in zip(gap, about, strict=True))
        return [s if s < 1 << 63 else None for s in exact]


def fit(rows: DataFrame, components: int) -> dict[int, Whitening]:
    """The whitening of each length of vectors in column v."""
    return {d: Whitening.of(s, components) for d, s in summaries(rows, integers).items()}


def identity_errors(rows: DataFrame, fitted: dict[int, Whitening]) -> dict[int, float]:
    """Of each length, by how much the covariance of its whitened vectors is off the identity: by the same merging."""
    found = summaries(rows, lambda v: fitted[v.shape[1]].whiten(integers(v)) if v.shape[1] else v)
    covariance = {d: s.covariance() for d, s in found.items()}
    return {d: float(np.abs(covariance[d] - np.eye(len(covariance[d]))).max()) if d in covariance else 0.0 for d in fitted}


def whitened(df: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """op13: vec_id, component, n, deviation, whitened, explained, identity_error of every vector and component."""
    bounded_batches(df.sparkSession)
    rows = doubles(df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")), "v").where(finite("v"))
    fitted = fit(rows, components)
    errors = identity_errors(rows, fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, v in matrices(b.column(1)):
                if not v.shape[1]:
                    continue
                w, x = fitted[v.shape[1]], integers(v)
                k, has = len(w.variance), w.variance > 0
                flat = np.full((len(x), k), np.nan)
                flat[:, has] = w.whiten(x)
                ids = b.column(0).take(pa.array(np.repeat(at, k)))
                deviations = pa.array(w.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, w.n)), deviations,
                        pa.array(flat.ravel(), mask=~np.tile(has, len(x))), pa.array(w.explained * len(x), pa.float64()), pa.array(np.full(len(x) * k, errors[v.shape[1]])),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
