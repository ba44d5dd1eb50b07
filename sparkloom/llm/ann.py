"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample (SAMPLE_BYTES of vectors); their depth follows the number of vectors, so that a leaf
holds about LEAF of them, as long as the sample has four for each leaf. Every vector is then indexed, one leaf a tree. A
query walks all trees through one shared priority queue, nearest margins first, and so visits the leaves most likely to
hold its neighbours; candidates of these leaves are reranked by exact Euclidean distance in double precision. How many
leaves a query visits at most is set by an audit: for AUDIT queries the exact neighbours are found by a full scan, and the
smallest number of leaves that recalls `recall` of them is taken; both figures are columns of the result. The sample
gives every query its k nearest there, and their distance as a bound: it stops at the first leaf that lies further away, behind a
plane beyond that distance, and takes nothing beyond it, which loses nothing.

Equal vectors are indexed once, with their k + 1 smallest ids: no other can be among k nearest, ties going to the
smaller id. Large leaves are split into chunks, each ranked in its own task, which return at most k + 1 rows a query.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without id, take no part;
vectors of different lengths have no distance, so each length has a forest of its own; repeated ids count once for each
different vector; fewer than k candidates: all are returned; an empty table gives no rows; extra columns are not read,
whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .vectors import doubles, usable

#: Bytes of the vectors that the trees are fitted on, trees, and vectors that a leaf is to hold.
SAMPLE_BYTES, TREES, LEAF = 8 << 20, 4, 1024
#: Queries of an audit, and vectors of a leaf that are ranked in one task.
AUDIT, CHUNK = 64, 8192


@dataclass
class Forest:
    """For each tree: normals, offsets and children of its nodes; a child below zero is leaf -1 - child."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    leaves: list[int]

    @classmethod
    def fit(cls, x: np.ndarray, trees: int, leaves: int, seed: int = 7) -> Forest:
        rng, out, counts = np.random.default_rng(seed), [], []
        for _ in range(trees):
            normals, offsets, children, n_leaves = [], [], [], 0

            def grow(part: np.ndarray, depth: int) -> int:
                nonlocal n_leaves
                if depth == 0 or len(part) < 4:
                    n_leaves += 1
                    return -n_leaves
                a, b = x[rng.choice(part, 2, replace=False)]
                normal = a - b
                if not normal.any():
                    normal = rng.normal(size=x.shape[1])
                margin = x[part] @ (normal := normal / np.linalg.norm(normal))
                offset = float(np.median(margin))
                right = margin > offset
                if not right.any():
                    n_leaves += 1
                    return -n_leaves
                i = len(normals)
                normals.append(normal)
                offsets.append(offset)
                children.append([0, 0])
                children[i] = [grow(part[~right], depth - 1), grow(part[right], depth - 1)]
                return i

            root = grow(np.arange(len(x)), int(np.ceil(np.log2(leaves)))) if len(x) else -1
            if root < 0:
                normals, offsets, children, n_leaves = [np.zeros(x.shape[1])], [np.inf], [[-1, -1]], 1
            out.append((np.array(normals), np.array(offsets), np.array(children)))
            counts.append(n_leaves)
        return cls(out, counts)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each row in each tree."""
        out = np.zeros((len(x), len(self.trees)), np.int32)
        for t, (normals, offsets, children) in enumerate(self.trees):
            node = np.zeros(len(x), np.int64)
            while (open_ := node >= 0).any():
                i = node[open_]
                side = (np.einsum("ij,ij->i", x[open_], normals[i]) > offsets[i]).astype(int)
                node[open_] = children[i, side]
            out[:, t] = -1 - node
        return out

    def order(self, q: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(tree, leaf, margin) in the order in which the shared queue of all trees reaches them. No vector of the leaf is
        nearer than the margin: it lies behind a plane that far away."""
        queue = [(-np.inf, t, 0) for t in range(len(self.trees))]
        while queue:
            far, t, node = heapq.heappop(queue)
            if node < 0:
                yield t, -1 - node, max(far, 0.0)
                continue
            normals, offsets, children = self.trees[t]
            margin = float(normals[node] @ q - offsets[node]) if np.isfinite(offsets[node]) else -1.0
            for side, m in ((0, -margin), (1, margin)):
                heapq.heappush(queue, (max(far, -m), t, int(children[node][side])))


def _matrix(raw: pd.Series, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), ">f8").reshape(-1, d).astype(np.float64)


def _packed(df: DataFrame) -> DataFrame:
    """v: a vector as the big-endian bytes of its doubles (compact to shuffle, and equal only for equal vectors)."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == "v" else f.dataType) for f in df.schema.fields])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(v=[(np.asarray(x, np.float64) + 0.0).astype(">f8").tobytes() for x in p["v"]])

    return df.mapInPandas(run, schema)


def _near(q: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each query the places among x that may be its k nearest, all ties included, and their distances. A matrix product
    says which; these are then measured exactly."""
    own, norms = (q * q).sum(axis=1), (x * x).sum(axis=1)
    for i in range(0, len(q), 256):
        rough = own[i : i + 256, None] + norms[None] - 2 * (q[i : i + 256] @ x.T)
        # what rounding can do to the rough squares
        slack = 1e-9 * (own[i : i + 256] + norms.max(initial=0))
        if not np.isfinite(rough).all():
            rough, slack = np.zeros_like(rough), np.zeros_like(slack)
        least = np.partition(rough, k - 1, axis=1)[:, k - 1] if k < len(x) else rough.max(axis=1, initial=0)
        for v, row, most in zip(q[i : i + 256], rough, least + slack, strict=True):
            at = np.flatnonzero(row <= most)
            dist = np.sqrt(((x[at] - v) ** 2).sum(axis=1))
            kept = dist <= np.partition(dist, k - 1)[k - 1] if len(at) > k else np.ones(len(at), bool)
            yield at[kept], dist[kept]


def nearest(df: DataFrame, k: int = 10, every: int = 100, recall: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """op3: query_id, rank, vec_id, score of the k nearest of each row whose id is divisible by `every`; visits (leaves
    visited by a query) and audit_recall (of them)."""
    rows = doubles(df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")), "v").where(usable("v") & F.col("id").isNotNull())
    lengths = sorted(r["d"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.lit(1)).collect())  # as many as there are lengths
    out = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, visits int, audit_recall double")
    for d in lengths:
        out = out.unionByName(_of_length(rows.where(F.size("v") == d), d, k, every, recall))
    return out


def _of_length(rows: DataFrame, d: int, k: int, every: int, recall: float) -> DataFrame:
    """The result for the vectors of one length."""
    rows = cut(_packed(rows).distinct())
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    classes = cut(rows.withColumn("k", first).where(F.col("k") <= k + 1).groupBy("v").agg(F.min("id").alias("cls"), F.sort_array(F.collect_list("id")).alias("ids")))
    queries = rows.where(F.col("id") % every == 0).join(classes.select("v", "cls"), "v").select("id", "cls")
    asked = classes.join(queries.select("cls").distinct(), "cls", "left_semi").select("cls", "v")
    n, held = classes.count(), max(8, SAMPLE_BYTES // (8 * d))
    drawn = classes.orderBy(F.xxhash64("cls"), "cls").limit(held).select("v", "ids").toPandas()
    sample, sample_ids = _matrix(drawn["v"], d), [list(map(int, i)) for i in drawn["ids"]]
    forest = Forest.fit(sample, TREES, max(1, min(-(-n // LEAF), len(sample) // 4)))
    visits, reached = _audit(forest, classes, asked, d, k, recall)

    def index(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            leaf = forest.assign(_matrix(p["v"], d)) if len(p) else np.zeros((0, TREES), np.int32)
            for t in range(leaf.shape[1]):
                yield pd.DataFrame({"tree": np.int32(t), "leaf": leaf[:, t], "v": p["v"], "ids": p["ids"]})

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The leaves that a query visits, as long as one may hold a vector within its bound, with that bound: the distance
        of its k + 1 nearest (it may be one itself) among the sample."""
        for p in parts:
            out = []
            q = _matrix(p["v"], d)
            near = _near(q, sample, k + 1) if len(sample) > k else ((None, np.array([np.inf])) for _ in q)
            for cls, v, x, (_, dist) in zip(p["cls"], p["v"], q, near, strict=True):
                bound = float(dist.max()) * (1 + 1e-9)
                for (t, leaf, margin), _ in zip(forest.order(x), range(visits)):
                    if margin > bound:
                        break
                    out.append((cls, v, t, leaf, bound))
            yield pd.DataFrame(out, columns=["cls", "v", "tree", "leaf", "bound"])

    held = cut(classes.mapInPandas(index, "tree int, leaf int, v binary, ids array<long>"))
    counts = held.groupBy("tree", "leaf").count().withColumn("chunks", F.ceil(F.col("count") / CHUNK).cast("int")).drop("count")
    held = held.join(F.broadcast(counts), ["tree", "leaf"]).withColumn("chunk", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int")).drop("chunks")

    wanted = asked.mapInPandas(walk, "cls long, v binary, tree int, leaf int, bound double").join(F.broadcast(counts), ["tree", "leaf"])
    wanted = wanted.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def rerank(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(q) and len(c):
            ids = c["ids"].tolist()
            for cls, bound, (at, dist) in zip(q["cls"], q["bound"], _near(_matrix(q["v"], d), _matrix(c["v"], d), k + 1), strict=True):
                near = [(s, int(i)) for j, s in zip(at.tolist(), dist.tolist(), strict=True) if s <= bound for i in ids[j]]
                out += [(cls, i, s) for s, i in heapq.nsmallest(k + 1, near)]
        return pd.DataFrame(out, columns=["cls", "id", "score"])

    def begin(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What a query's bound comes from: its nearest in the sample."""
        for p in parts:
            out: list[tuple] = []
            if len(p) and len(sample):
                for cls, (at, dist) in zip(p["cls"], _near(_matrix(p["v"], d), sample, k + 1), strict=True):
                    near = [(s, i) for j, s in zip(at.tolist(), dist.tolist(), strict=True) for i in sample_ids[j]]
                    out += [(cls, i, s) for s, i in heapq.nsmallest(k + 1, near)]
            yield pd.DataFrame(out, columns=["cls", "id", "score"])

    keys = ["tree", "leaf", "chunk"]
    found = wanted.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(rerank, "cls long, id long, score double")
    found = found.unionByName(asked.mapInPandas(begin, "cls long, id long, score double"))
    order = Window.partitionBy("cls").orderBy("score", "id")
    best = found.groupBy("cls", "id").agg(F.min("score").alias("score")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    own = Window.partitionBy("query_id", "cls").orderBy("score", "id")
    out = queries.withColumnRenamed("id", "query_id").join(best.drop("r"), "cls").where("query_id <> id").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score", F.lit(visits).alias("visits"), F.lit(reached).alias("audit_recall"))


def exact(classes: DataFrame, q: np.ndarray, d: int, k: int) -> list[np.ndarray]:
    """The k nearest vectors of each of a few queries among all (nearest first), by a full scan; a query itself, at distance zero, is left out."""

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                x = _matrix(p["v"], d)
                for i, (at, dist) in enumerate(_near(q, x, k + 1)):
                    dist = np.where(dist == 0, np.inf, dist)
                    j = np.argsort(dist, kind="stable")[:k]
                    yield pd.DataFrame({"q": i, "score": dist[j], "v": p["v"].to_numpy()[at[j]]})

    found = classes.select("v").mapInPandas(scan, "q int, score double, v binary").where(F.col("score") < float("inf"))
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "v"))).where(F.col("r") <= k).toPandas()
    return [_matrix(best[best["q"] == i].sort_values("r")["v"], d) if (best["q"] == i).any() else np.zeros((0, d)) for i in range(len(q))]


def _audit(forest: Forest, classes: DataFrame, asked: DataFrame, d: int, k: int, recall: float) -> tuple[int, float]:
    """How many leaves a query must visit, by the exact neighbours of at most AUDIT queries, and the recall of so many."""
    picked = asked.orderBy(F.xxhash64("cls"), "cls").limit(AUDIT).toPandas()
    q = _matrix(picked["v"], d)
    needed: list[int] = []
    for v, truth in zip(q, exact(classes, q, d, k) if len(q) else (), strict=True):
        if len(truth):
            at = {(t, leaf): i for i, (t, leaf, _) in enumerate(forest.order(v), 1)}
            needed += [min(at[t, int(leaf)] for t, leaf in enumerate(row)) for row in forest.assign(truth)]
    if not needed:
        return 1, 1.0
    visits = int(np.sort(needed)[max(0, int(np.ceil(recall * len(needed))) - 1)])
    return visits, float(np.mean(np.array(needed) <= visits))
