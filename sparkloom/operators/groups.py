"""Duplicate groups and leakage between splits, over samples with digests and 64-bit perceptual hashes (16 hex digits)."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.errors import ParameterError
from ..plans.session import cut


def _members(d: DataFrame, keys: list[str]) -> DataFrame:
    """d (with id) and its groups' canonical id and size, from partial aggregates joined back: a group that holds a third
    of the rows meets in no task."""
    g = d.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min("id").alias("canonical"), F.count(F.lit(1)).alias("size"))
    return d.join(g, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])).drop(*[f"__{k}" for k in keys])


def exact_groups(df: DataFrame, id_col: str, digest: str) -> DataFrame:
    """id, canonical (the smallest id of the group), size: members of groups of more than one."""
    d = df.where(F.col(f"`{digest}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{digest}`").alias("digest"))
    return _members(d, ["digest"]).where("size > 1").select("id", "canonical", "size")


def word(h: Column) -> Column:
    """A hash of 16 hexadecimal digits as one 64-bit number."""
    half = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def digits(w: Column) -> Column:
    """The number as 16 hexadecimal digits again."""
    return F.lower(F.lpad(F.hex(w), 16, "0"))


@dataclass(frozen=True)
class Bands:
    """Keys of which hashes within `most` bits share one: of most + t bands t at least are equal, so a key is t bands.

    More bands make more keys, but more selective ones. t is what n hashes ask for, if a key written costs as much as
    COST comparisons; what is found is the same for any t.
    """

    most: int
    t: int

    COST = 1000

    @classmethod
    def for_count(cls, most: int, n: int) -> Bands:
        if not 0 <= most <= 15:
            raise ParameterError("0 to 15 bits")
        return cls(most, min((1, 2, 3), key=lambda t: math.comb(most + t, t) * (cls.COST + n / 2 ** (64 * t / (most + t)))))

    def _masks(self) -> list[int]:
        cuts = [64 * i // (self.most + self.t) for i in range(self.most + self.t + 1)]
        return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(cuts)]

    @staticmethod
    def _literal(mask: int) -> Column:
        return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")

    def keys(self, w: Column) -> Column:
        """array of (which bands, as bits; what these hold)."""
        masks = self._masks()
        chosen = list(itertools.combinations(range(len(masks)), self.t))
        return F.array(*[F.struct(F.lit(sum(1 << i for i in own)).alias("at"), w.bitwiseAND(self._literal(sum(masks[i] for i in own))).alias("bits")) for own in chosen])

    def first(self, pairs: DataFrame, x: str, y: str, at: str) -> DataFrame:
        """Pairs under the first key that both hashes share (that of their first t equal bands), so that each is there once."""
        differ = F.col(x).bitwiseXOR(F.col(y))
        same = reduce(Column.bitwiseOR, [F.when(differ.bitwiseAND(self._literal(m)) == 0, 1 << i).otherwise(0) for i, m in enumerate(self._masks())])
        d = pairs.withColumn("__same", same).withColumn("__first", F.lit(0))
        for _ in range(self.t):
            d = d.withColumn("__lowest", F.col("__same").bitwiseAND(-F.col("__same")))
            d = d.withColumn("__first", F.col("__first").bitwiseOR(F.col("__lowest"))).withColumn("__same", F.col("__same").bitwiseXOR(F.col("__lowest")))
        return d.where(F.col("__first") == F.col(at)).drop("__same", "__first", "__lowest")


def _words(df: DataFrame, hash_col: str) -> DataFrame:
    return df.where(F.col(f"`{hash_col}`").isNotNull()).select(word(F.col(f"`{hash_col}`")).alias("w")).distinct()


def near_pairs(hashes: DataFrame, hash_col: str, most: int) -> DataFrame:
    """a, b: pairs of distinct hashes that differ in at most `most` (up to 15) bits, a < b. Equal hashes are one entry.

    All pairs are asked for, so all are written; who wants groups takes perceptual_groups, which writes none.
    """
    d = cut(_words(hashes, hash_col))
    bands = Bands.for_count(most, d.count())
    e = d.withColumn("key", F.explode(bands.keys(F.col("w"))))
    x, y = F.col("x.w"), F.col("y.w")
    j = e.alias("x").join(e.alias("y"), F.col("x.key") == F.col("y.key")).where((x < y) & (F.bit_count(x.bitwiseXOR(y)) <= most))
    j = bands.first(j.select(x.alias("x"), y.alias("y"), F.col("x.key.at").alias("at")), "x", "y", "at").select(digits(F.col("x")).alias("p"), digits(F.col("y")).alias("q"))
    return j.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


#: Hashes under one key that a task holds at a time.
CELL = 20_000


def local_links(x: np.ndarray, most: int, first: int | None = None) -> Iterator[tuple[np.ndarray, int]]:
    """The groups of two or more among different hashes, linked by differing in at most `most` bits, and the greatest
    distance of a link in each. first: only links between the first so many and the others count.

    A group grows from one member by comparing each of its members with what is in no group yet; a dense one is found at
    once, and no pair is ever written.
    """
    side = None if first is None else np.arange(len(x)) < first
    left = np.arange(len(x))
    while len(left):
        group, queue, left = [left[0]], [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(x[left] ^ x[i]) <= most
            if side is not None:
                near &= side[left] != side[i]
            queue += left[near].tolist()
            group += left[near].tolist()
            left = left[~near]
        if len(group) > 1:
            own, far = np.array(group), 0
            for at in range(0, len(own), 256):
                d = np.bitwise_count(x[own[at : at + 256], None] ^ x[own][None])
                d[d > most] = 0
                if side is not None:
                    d[side[own[at : at + 256], None] == side[own][None]] = 0
                far = max(far, int(d.max()))
                if far == most:
                    break
            yield own, far


def links(hashes: DataFrame, most: int) -> DataFrame:
    """w, root, far: for each key, its hashes (column w, distinct) that have links, tied to one of them, with the greatest
    distance of a link among these: a forest for each key, at most a row a hash and key.

    A key with many hashes is dealt into cells of about CELL, and pairs of cells are tasks of their own.
    """
    bands = Bands.for_count(most, hashes.count())
    e = cut(hashes.withColumn("key", F.explode(bands.keys(F.col("w")))))
    large = e.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL).select("key", F.ceil(F.col("n") / CELL).cast("int").alias("cells"))
    e = e.join(large, "key", "left").withColumn("cell", F.coalesce(F.pmod(F.xxhash64("w"), F.col("cells")).cast("int"), F.lit(0)))
    cells = cut(e.groupBy("key", "cells", "cell").agg(F.collect_list("w").alias("ws")).where((F.size("ws") > 1) | F.col("cells").isNotNull()))
    parts = cells.where("cells is not null")
    across = parts.alias("x").join(parts.alias("y"), F.col("x.key") == F.col("y.key")).where("x.cell < y.cell").select(F.col("x.ws").alias("a"), F.col("y.ws").alias("b"))
    tasks = cells.select(F.col("ws").alias("a"), F.lit(None).cast("array<long>").alias("b")).unionByName(across)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, int, int]] = []
            for k in range(batch.num_rows):
                a, b = (batch.column(c).slice(k, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
                x = np.concatenate([a, b])
                for own, far in local_links(x.view(np.uint64), most, len(a) if len(b) else None):
                    members = x[own]
                    out.append((members, int(members.min()), far))
            if out:
                size = [len(m) for m, _, _ in out]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([m for m, _, _ in out])), pa.array(np.repeat([r for _, r, _ in out], size)), pa.array(np.repeat([f for _, _, f in out], size))], ["w", "root", "far"])

    return cut(tasks.mapInArrow(run, "w long, root long, far long"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """node, component (the smallest node reachable): labels spread to neighbours and then jump along the labels, each
    round checkpointed, until nothing changes."""
    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).distinct())
    labels = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component"))
    for _ in range(rounds):
        near = e.join(labels.select(F.col("node").alias("v"), F.col("component").alias("c")), "v").groupBy(F.col("u").alias("node")).agg(F.min("c").alias("c"))
        nxt = labels.join(near, "node").select("node", F.least("component", "c").alias("component"), F.col("component").alias("before"))
        jump = nxt.select(F.col("node").alias("component"), F.col("component").alias("far"))
        nxt = cut(nxt.join(jump, "component", "left").select("node", F.coalesce("far", "component").alias("component"), "before"))
        moved = nxt.where("component <> before").isEmpty()
        labels = nxt.select("node", "component")
        if moved:
            return labels
    raise RuntimeError("the components did not settle")


def perceptual_groups(df: DataFrame, id_col: str, hash_col: str, most: int = 8) -> DataFrame:
    """id, canonical, size, max_distance: groups linked by hashes within `most` bits; equal hashes always link.
    max_distance is that of the furthest link, 0 for equal hashes alone."""
    tied = links(cut(_words(df, hash_col)), most)
    comp = cut(components(tied.where("w <> root").select("w", "root").distinct(), "w", "root"))
    far = tied.select("root", "far").groupBy("root").agg(F.max("far").alias("far")).join(comp, F.col("root") == F.col("node")).groupBy("component").agg(F.max("far").alias("max_distance"))
    d = df.where(F.col(f"`{hash_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), word(F.col(f"`{hash_col}`")).alias("h"))
    d = d.join(comp, F.col("h") == F.col("node"), "left").withColumn("component", F.coalesce("component", "h"))
    g = _members(d.select("id", "component"), ["component"]).where("size > 1")
    return g.join(far, "component", "left").select("id", "canonical", "size", F.coalesce("max_distance", F.lit(0)).cast("long").alias("max_distance"))


def leakage(df: DataFrame, id_col: str, digest: str, hash_col: str | None = None, split: str = "split", most: int = 4) -> DataFrame:
    """kind, a, b: pairs of representatives (the smallest id of a digest or hash in a split) in different splits, equal
    by digest, else near by hash. Members of a representative are in leak_members()."""
    d = df.where(F.col(f"`{split}`").isNotNull())
    rep = d.where(F.col(f"`{digest}`").isNotNull()).groupBy(F.col(f"`{digest}`").alias("g"), F.col(f"`{split}`").alias("s")).agg(F.min(f"`{id_col}`").alias("id"))
    exact = rep.alias("x").join(rep.alias("y"), "g").where("x.s < y.s").select(F.lit("exact").alias("kind"), F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    if not hash_col:
        return exact
    hs = d.where(F.col(f"`{hash_col}`").isNotNull()).groupBy(F.col(f"`{hash_col}`").alias("h"), F.col(f"`{split}`").alias("s")).agg(F.min(f"`{id_col}`").alias("id"))
    near = near_pairs(hs, "h", most)
    x, y = hs.select(F.col("h").alias("a"), F.col("s").alias("s1"), F.col("id").alias("i")), hs.select(F.col("h").alias("b"), F.col("s").alias("s2"), F.col("id").alias("j"))
    far = near.join(x, "a").join(y, "b").where("s1 <> s2").select(F.lit("near").alias("kind"), F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    return exact.union(far.join(exact.select("a", "b"), ["a", "b"], "left_anti").select("kind", "a", "b"))


def leak_members(df: DataFrame, id_col: str, digest: str, split: str = "split") -> DataFrame:
    """id, representative of each row, by digest and split."""
    d = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{digest}`").alias("digest"), F.col(f"`{split}`").alias("split"))
    return _members(d, ["digest", "split"]).select("id", F.col("canonical").alias("representative"))


def first_match(candidates: DataFrame, active: DataFrame, hash_col: str, id_col: str, most: int = 8) -> DataFrame:
    """candidate hash, match: for each, the smallest id of an active row whose hash is within `most` bits. Candidates
    aren't compared with one another, nor active rows."""
    asked = cut(_words(candidates, hash_col))
    held = cut(active.where(F.col(f"`{hash_col}`").isNotNull()).groupBy(word(F.col(f"`{hash_col}`")).alias("w")).agg(F.min(f"`{id_col}`").alias("id")))
    bands = Bands.for_count(most, held.count())
    x = asked.withColumn("key", F.explode(bands.keys(F.col("w")))).alias("x")
    y = held.withColumn("key", F.explode(bands.keys(F.col("w")))).alias("y")
    near = x.join(y, F.col("x.key") == F.col("y.key")).where(F.bit_count(F.col("x.w").bitwiseXOR(F.col("y.w"))) <= most)
    return near.groupBy(F.col("x.w").alias("w")).agg(F.min("y.id").alias("match")).select(digits(F.col("w")).alias("h"), "match")


def rows_across_splits(df: DataFrame, split: str = "_split") -> DataFrame:
    """splits, n: how many different rows occur in how many splits, over one."""
    own = [F.col(f"`{c}`") for c in df.columns if c != split]
    return df.groupBy(*own).agg(F.count_distinct(f"`{split}`").alias("splits")).where("splits > 1").groupBy("splits").agg(F.count(F.lit(1)).alias("n"))
