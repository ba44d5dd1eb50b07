"""Embedding near-duplicates by hierarchical navigable small-world graphs, one for each shard.

Vectors are dealt to shards within their label. Each shard's graph is built once and stored; then every vector queries the
graph of every shard of its label; what the beams bring back is verified by cosine in double precision and unioned. Each
task audits itself: vectors are drawn, and their true links found by brute force, until LINKED of them have links or
all are drawn; beams are widened until the links found, as a mean over these vectors, reach the asked recall. Within each
group so connected, all links are counted exactly, in blocks, so a dense group is neither capped nor emitted as pairs: a
task returns one row for each vector. Groups of several tasks meet in distributed connected components.

Equal vectors of a label are one vector with a count. Shards hold about SHARD_BYTES of vectors; a task holds two shards.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors without label, have no
links and are their own component; vectors of different lengths don't link; a null id is a row of its own with a null
component, not kept; repeated ids share the links of all their rows; an empty table gives no rows; extra columns are
not read, whatever their names.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import _packed
from .common import connected_components, cut
from .vectors import doubles, usable

#: Bytes of a shard's vectors in double precision; links that a vector sets itself.
SHARD_BYTES, DEGREE = 4 << 20, 10
#: Vectors with links that an audit waits for.
LINKED = 32
#: Vectors that walk a graph together, and how many of a beam are expanded at a time.
WALK, EXPAND = 256, 4


class Hnsw:
    """A graph over unit vectors; nearness is the cosine, in single precision.

    Each level holds a random part of the one below. A vector's neighbours on a level are the nearest, taken so that they
    lie nearer to it than to one another as far as there are such, among the nearest on that level and on every level
    above: the sparser ones give the long links by which a walk gets about. The nearest are found by blocks of matrix
    products, and all vectors of a block walk at a time.
    """

    def __init__(self, x: np.ndarray, degree: int = DEGREE, seed: int = 11):
        self.x = x.astype(np.float32)
        n = len(x)
        top = (-np.log(np.random.default_rng(seed).random(n)) / np.log(degree)).astype(int) if n else np.zeros(0, int)
        self.nodes = [np.flatnonzero(top >= h) for h in range(int(top.max()) + 1 if n else 0)]
        self.links = [self._level(h, degree, 2 * degree if h == 0 else degree) for h in range(len(self.nodes))]

    def to_bytes(self) -> bytes:
        """The graph without its vectors."""
        out = io.BytesIO()
        np.save(out, np.array([len(self.nodes)]))
        for part in [p for level in zip(self.nodes, self.links, strict=True) for p in level]:
            np.save(out, part.astype(np.int32))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes, x: np.ndarray) -> Hnsw:
        self, src = cls.__new__(cls), io.BytesIO(raw)
        self.x, levels = x.astype(np.float32), int(np.load(src)[0])
        parts = [np.load(src).astype(np.int64) for _ in range(2 * levels)]
        self.nodes, self.links = parts[::2], parts[1::2]
        return self

    def _nearest(self, own: np.ndarray, among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the k nearest of each vector, itself left out; -1 and -inf where there are fewer."""
        k = min(k, len(among))
        sims = self.x[own] @ self.x[among].T
        sims[own[:, None] == among[None]] = -np.inf
        at = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < len(among) else np.broadcast_to(np.arange(k), (len(own), k))
        sims = np.take_along_axis(sims, at, axis=1)
        return np.where(np.isinf(sims), -1, among[at]), sims

    def _level(self, h: int, degree: int, most: int) -> np.ndarray:
        """(nodes, most) neighbours as places among the level's nodes, -1 for none: its own, and those that chose it."""
        ids = self.nodes[h]
        out = np.full((len(ids), most), -1)
        if len(ids) < 2:
            return out
        place = np.full(len(self.x), -1)
        place[ids] = np.arange(len(ids))
        edges = []
        for at in range(0, len(ids), WALK):
            own = ids[at : at + WALK]
            found = [self._nearest(own, ids, 2 * degree), *[self._nearest(own, up, max(degree // 2, 2)) for up in self.nodes[h + 1 :]]]
            near, sims = (np.concatenate([f[i] for f in found], axis=1) for i in (0, 1))
            near, sims = _chosen(self.x, near, sims, degree)
            rows, cols = np.nonzero(near >= 0)
            edges.append((place[own[rows]], place[near[rows, cols]], sims[rows, cols], cols))
        src, dst, sim, rank = (np.concatenate(e) for e in zip(*edges, strict=True))
        # links back come after a node's own, the nearest first; what is there twice counts by its first
        both = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([rank - 1e6, -sim.astype(float)])
        order = np.lexsort((both[2], both[1], both[0]))
        a, b, weight = (e[order] for e in both)
        once = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        a, b, weight = a[once], b[once], weight[once]
        order = np.lexsort((weight, a))
        a, b = a[order], b[order]
        turn = np.arange(len(a)) - np.searchsorted(a, a, side="left")
        out[a[turn < most], turn[turn < most]] = b[turn < most]
        return out

    def _walk(self, q: np.ndarray, start: np.ndarray, beam: int, h: int) -> np.ndarray:
        """(vectors, beam): the best places found on a level from the start places (vectors, any number), -1 for none."""
        x, links, n = self.x[self.nodes[h]], self.links[h], len(self.nodes[h])
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), n + 1), bool)  # the last place takes what isn't there
        seen[:, n] = True
        best, sims = np.full((len(q), beam), n), np.full((len(q), beam), -np.inf, np.float32)
        done = np.ones((len(q), beam), bool)
        new = np.where(start < 0, n, start)
        while new.size:
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = n
            new[seen[rows[: len(new)] if len(new) == len(q) else live[:, None], new]] = n
            line = rows if len(new) == len(q) else live[:, None]
            seen[line, new] = True
            got = np.einsum("qkd,qd->qk", x[np.minimum(new, n - 1)], q[line[:, 0]], optimize=True)
            got[new == n] = -np.inf
            whole, every = np.concatenate([sims[line[:, 0]], got], axis=1), np.concatenate([best[line[:, 0]], new], axis=1)
            open_ = np.concatenate([done[line[:, 0]], new == n], axis=1)
            at = np.argpartition(-whole, beam - 1, axis=1)[:, :beam] if whole.shape[1] > beam else np.broadcast_to(np.arange(whole.shape[1]), whole.shape)
            for held, part in ((sims, whole), (best, every), (done, open_)):
                held[line[:, 0], : at.shape[1]] = np.take_along_axis(part, at, axis=1)
            live = np.flatnonzero(~done.all(axis=1))
            if not len(live):
                break
            ahead = np.where(done[live], -np.inf, sims[live])
            k = min(EXPAND, beam)
            top = np.argpartition(-ahead, k - 1, axis=1)[:, :k]
            use = np.take_along_axis(ahead, top, axis=1) > -np.inf
            nodes = np.take_along_axis(best[live], top, axis=1)
            flags = done[live]
            np.put_along_axis(flags, top, True, axis=1)
            done[live] = flags
            around = links[np.minimum(nodes, n - 1)].reshape(len(live), -1)
            new = np.where((around < 0) | ~np.repeat(use, links.shape[1], axis=1), n, around)
        return np.where(best == n, -1, best)

    def query(self, q: np.ndarray, beam: int, own: np.ndarray | None = None) -> np.ndarray:
        """(vectors, beam) ids of what a walk down the levels finds near each vector, -1 for none. own: places of the vectors
        themselves in this graph, where they are, to set out from as well."""
        q = q.astype(np.float32)
        start = np.zeros((len(q), 1), np.int64)
        for h in range(len(self.nodes) - 1, 0, -1):
            place = np.searchsorted(self.nodes[h - 1], self.nodes[h])
            found = self._walk(q, start, EXPAND, h)
            start = np.where(found < 0, -1, place[found])
        if own is not None:
            start = np.concatenate([start, own[:, None]], axis=1)
        found = self._walk(q, start, beam, 0)
        return np.where(found < 0, -1, self.nodes[0][found])


def _chosen(x: np.ndarray, near: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's candidates (ids, -1 for none) the ones to link: first those that lie nearer to it than to any taken
    before, the nearest first, then the nearest of the others."""
    order = np.lexsort((-sims, near), axis=1)
    near, sims = np.take_along_axis(near, order, axis=1), np.take_along_axis(sims, order, axis=1)
    sims[:, 1:][near[:, 1:] == near[:, :-1]] = -np.inf
    order = np.argsort(-sims, axis=1, kind="stable")
    near, sims = np.take_along_axis(near, order, axis=1), np.take_along_axis(sims, order, axis=1)
    v = x[np.maximum(near, 0)]
    among = v @ v.transpose(0, 2, 1)
    taken = np.zeros(near.shape, bool)
    for k in range(near.shape[1]):
        clear = ~(taken[:, :k] & (among[:, k, :k] >= sims[:, k, None])).any(axis=1)
        taken[:, k] = clear & (sims[:, k] > -np.inf) & (taken.sum(axis=1) < most)
    order = np.argsort(~taken, axis=1, kind="stable")[:, :most]
    near, sims = np.take_along_axis(near, order, axis=1), np.take_along_axis(sims, order, axis=1)
    return np.where(np.isinf(sims), -1, near), sims


def united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each one's group after groups that edges join are one."""
    while len(a):
        p, q = root[a], root[b]
        apart = p != q
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while True:
            far = root[root]
            if (far == root).all():
                break
            root = far
    return root


def audited(x: np.ndarray, side: np.ndarray | None, least: float, seed: int = 5, chunk: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Vectors that have links, drawn at random until LINKED are found or none is left, and their links (a row each)."""
    order, found, truths, n = np.random.default_rng(seed).permutation(len(x)), [], [], 0
    for i in range(0, len(order), chunk):
        part = order[i : i + chunk]
        hit = x[part] @ x.T >= least
        hit[np.arange(len(part)), part] = False
        if side is not None:
            hit &= side[part][:, None] != side[None]
        own = np.flatnonzero(hit.any(axis=1))[: LINKED - n]
        found.append(part[own])
        truths.append(hit[own])
        n += len(own)
        if n >= LINKED:
            break
    return np.concatenate([np.zeros(0, int), *found]), np.concatenate([np.zeros((0, len(x)), bool), *truths])


def linked(a: np.ndarray, b: np.ndarray | None, least: float, weight_a: np.ndarray, weight_b: np.ndarray | None = None, graphs: list[Hnsw] | None = None, recall: float = 0.99, beam: int = 24) -> tuple[np.ndarray, np.ndarray, float]:
    """(links of each row, group of each row, recall of the audit) within a, or between the rows of a and b (stacked).

    a, b: unit vectors. A row's links are the weights of the rows linked to it. graphs: those of a and b.
    """
    x = a if b is None else np.vstack([a, b])
    weight = weight_a if b is None else np.concatenate([weight_a, weight_b])
    n, m = len(x), len(a)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 1.0
    side = np.zeros(n, int) if b is None else np.repeat([0, 1], [m, n - m])
    graphs = graphs or [Hnsw(part) for part in ([a] if b is None else [a, b])]
    targets = [(graphs[0], 0, range(n) if b is None else range(m, n))]
    if b is not None:
        targets.append((graphs[1], m, range(m)))
    audit, truth = audited(x, None if b is None else side, least)
    while True:
        group = np.arange(n)
        for graph, at, asking in targets:
            for i in range(asking.start, asking.stop, WALK):
                own = np.arange(i, min(i + WALK, asking.stop))
                if beam >= len(graph.x):
                    rows, near = (k.ravel() for k in np.meshgrid(own, np.arange(len(graph.x)), indexing="ij"))
                else:
                    found = graph.query(x[own], beam, own - at if b is None else None)
                    rows, cols = np.nonzero(found >= 0)
                    rows, near = own[rows], found[rows, cols]
                near = near + at
                linked_ = (x[rows] * x[near]).sum(axis=1) >= least
                group = united(group, rows[linked_], near[linked_])
        same = (truth & (group[audit][:, None] == group[None])).sum(axis=1)
        reached = float((same / truth.sum(axis=1)).mean()) if len(audit) else 1.0
        if reached >= recall or beam >= n:
            break
        beam *= 2
    count, order = np.zeros(n), np.argsort(group, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        if len(part) > 1:
            for i in range(0, len(part), 1024):
                hit = x[part[i : i + 1024]] @ x[part].T >= least
                hit[np.arange(hit.shape[0]), np.arange(i, i + hit.shape[0])] = False
                if b is not None:
                    hit &= side[part[i : i + 1024]][:, None] != side[part][None]
                count[part[i : i + 1024]] += hit @ weight[part]
    return count.astype(np.int64), group, reached


def near_duplicates(df: DataFrame, least: float = 0.93, shard: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """op10: vec_id, n_links, component_id, kept of every row, and the least recall that the audits of its tasks reached."""
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.col(label_col).cast("string").alias("label"))
    rows = doubles(src, "v").where(usable("v") & F.col("label").isNotNull() & F.col("id").isNotNull())
    packed = cut(_packed(rows.select("id", "label", "v")).distinct())
    classes = cut(packed.groupBy("label", "v").agg(F.min("id").alias("cls"), F.count(F.lit(1)).alias("weight")).withColumn("d", F.octet_length("v")))
    sizes = classes.groupBy("label", "d").count().withColumn("shards", F.ceil(F.col("count") / (F.lit(shard) if shard else F.greatest(F.lit(32), F.lit(SHARD_BYTES) / F.col("d")))).cast("int")).drop("count")
    dealt = classes.join(sizes, ["label", "d"]).withColumn("s", F.pmod(F.xxhash64("cls", "v"), F.col("shards")).cast("int"))

    def unit(raw: bytes, d: int) -> np.ndarray:
        x = np.frombuffer(raw, ">f8").reshape(-1, d // 8).astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def build(p: pd.DataFrame) -> pd.DataFrame:
        p = p.iloc[np.lexsort((p["v"].to_numpy(), p["cls"].to_numpy()))]
        d, raw = int(p["d"].iloc[0]), b"".join(p["v"])
        first = {c: [p[c].iloc[0]] for c in ("label", "d", "s", "shards")}
        packed = {"cls": [p["cls"].to_numpy(np.int64).tobytes()], "weight": [p["weight"].to_numpy(np.int64).tobytes()], "v": [raw], "graph": [Hnsw(unit(raw, d)).to_bytes()]}
        return pd.DataFrame(first | packed)

    # one row a shard: its vectors and its graph, built once
    shards = cut(dealt.groupBy("label", "d", "s").applyInPandas(build, "label string, d int, s int, shards int, cls binary, weight binary, v binary, graph binary"))
    # a shard meets every shard of its label and length, itself included: the task of a pair of shards
    met = shards.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    met = met.withColumn("s1", F.least("s", "o")).withColumn("s2", F.greatest("s", "o"))

    def task(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("s")
        d = int(p["d"].iloc[0])
        x = [unit(raw, d) for raw in p["v"]]
        w = [np.frombuffer(raw, np.int64).astype(float) for raw in p["weight"]]
        graphs = [Hnsw.from_bytes(raw, part) for raw, part in zip(p["graph"], x, strict=True)]
        n, group, reached = linked(x[0], x[1] if len(x) > 1 else None, least, w[0], w[1] if len(w) > 1 else None, graphs)
        cls, raw = np.concatenate([np.frombuffer(c, np.int64) for c in p["cls"]]), b"".join(p["v"])
        return pd.DataFrame({"label": p["label"].iloc[0], "cls": cls, "v": [raw[i : i + d] for i in range(0, len(raw), d)], "n": n, "root": cls[group], "recall": reached})

    found = cut(met.groupBy("label", "d", "s1", "s2").applyInPandas(task, "label string, cls long, v binary, n long, root long, recall double"))
    n = found.groupBy("label", "v").agg(F.sum("n").alias("n"), F.min("recall").alias("recall"))
    same = packed.join(classes.select("label", "v", "cls", "weight"), ["label", "v"]).join(n, ["label", "v"], "left")
    same = same.select("id", "cls", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), "recall")
    edges = found.select(F.col("cls").alias("src"), F.col("root").alias("dst")).unionByName(same.select(F.col("id").alias("src"), F.col("cls").alias("dst"))).where("src <> dst")
    comps = connected_components(edges)
    per_id = same.groupBy("id").agg(F.sum("n").cast("long").alias("n_links"), F.min("recall").alias("audit_recall"))
    every = df.select(F.col(id_col).cast("long").alias("vec_id"))
    out = every.join(per_id, every.vec_id == per_id.id, "left").drop("id").join(comps, F.col("vec_id") == comps.node, "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").cast("long").alias("component_id"), "audit_recall")
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), "audit_recall")
