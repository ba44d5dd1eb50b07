"""Near copies by exact similarity: texts that share at least 80 % of all their distinct 5-word shingles (Jaccard).

Candidates come from two indexes and every one is verified on the whole shingle sets:

* the byte-position index of simhash.py over 64-bit fingerprints of the 5-word shingles, which pairs lightly edited
  copies (at most 3 bits apart);
* for what fingerprints of 64 bits can't tell from unlike texts (at similarity 0.8 they differ in some ten bits), BANDS
  keys of each text, each of the least hashes of its shingles under ROWS random functions. Two texts of similarity s
  share a key with the chance 1 - (1 - s ** ROWS) ** BANDS: all but 8 of a million pairs at 0.8, all but one of ten
  million at 0.84; texts with a passage in common (0.25 of their shingles, say) meet twice in a thousand.

Texts with the same words are one class. Pairs whose numbers of shingles rule out the similarity are left out. Classes of
a key that at most HOT have are paired: each class's pair with most keys in common is verified first, then of the others
those that join two components. Classes that meet on keys of more than HOT make clusters; a cluster's pairs aren't
written out, but its sets are compared block by block, each pair of blocks (of BLOCK shingles together) in a task, which
takes what is reached out of the comparison and returns a forest: a dense group costs little more than its size.

Cases: case and white space don't count; null text and white space only are one class; fewer words than a shingle are
one shingle; texts of any length are read whole; an empty table gives no rows; ids and other columns are not read, but
pass through with_class, whatever their names. Words, shingles and texts are compared by 64-bit hashes: of n different
texts about n^2 / 2^65 pairs are taken for equal, three among ten thousand million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import bounded_batches, connected_components, cut, sweep
from .pieces import by_bytes, column_bytes

SHINGLE = 5
#: Keys of a text, and how many least hashes make one.
BANDS, ROWS = 50, 7
#: Classes of a key that are paired one by one, and shingles of a cluster's block.
HOT, BLOCK = 16, 1 << 20
#: Bytes of text taken together.
SLICE = 2 << 20
#: Classes that are broadcast at most (more are joined by a shuffle).
BROADCAST = 500_000

_BLANK = np.zeros(256, bool)
_BLANK[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on all (the finaliser of splitmix64; its fixed values)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(texts: pa.Array) -> list[np.ndarray]:
    """For each text the hashes of its shingles (unsigned), repeats included."""
    data, offsets = column_bytes(pc.utf8_lower(texts))
    held = ~_BLANK[data]
    begins = held.copy()
    begins[1:] &= ~held[:-1]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    begins &= held
    at = np.flatnonzero(begins)
    first = np.searchsorted(at, offsets)
    place = np.concatenate([[0], np.cumsum(held, dtype=np.int32)])
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(place[np.append(at, len(data))].astype(np.int64)), pa.py_buffer(data[held])).dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    h = known[words.indices.to_numpy()]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        size = min(n, SHINGLE)
        s = np.zeros(max(n - SHINGLE + 1, min(n, 1)), np.uint64)
        for k in range(size):
            s = _mixed(s + h[a + k : a + k + len(s)])
        out.append(s)
    return out


def _functions() -> tuple[np.ndarray, np.ndarray]:
    """An odd factor and a summand of each of the random functions."""
    h = _mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return h[: BANDS * ROWS] | np.uint64(1), h[BANDS * ROWS :]


def keys(found: np.ndarray, chunk: int = 1024) -> np.ndarray:
    """The keys of a set of shingles (unsigned hashes); none of an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    factor, summand = _functions()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), chunk):
        least = np.minimum(least, (found[i : i + chunk, None] * factor + summand).min(axis=0))
    out = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = _mixed(out + row)
    return out.view(np.int64)


def text_class() -> Column:
    """The same number for texts with the same words."""
    words = F.btrim(F.regexp_replace(F.lower(F.coalesce(F.col("text"), F.lit(""))), "[ \t\n\x0b\f\r]+", " "))
    return F.xxhash64(words)


def with_class(docs: DataFrame, name: str) -> DataFrame:
    """The columns of docs and the class of each row's text."""
    return docs.withColumn(name, text_class())


def _texts(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(text_class().alias("class"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def _sets(texts: DataFrame) -> DataFrame:
    """class, n and toks (the distinct shingles) of every row of class and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes(whole, 1, SLICE):
                toks = [np.unique(s.view(np.int64)) for s in shingles(b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in toks], pa.int32()), _lists(toks)], ["class", "n", "toks"])

    return texts.mapInArrow(run, "class long, n int, toks array<long>")


def _heads(texts: DataFrame) -> DataFrame:
    """class, n, keys and fp (the fingerprint) of every row of class and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes(whole, 1, SLICE):
                every = shingles(b.column(1))
                sets = [np.unique(s) for s in every]
                fp = np.array([simhash.majority(s) for s in every], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in sets], pa.int32()), _lists([keys(t) for t in sets]), pa.array(fp)], ["class", "n", "keys", "fp"])

    return texts.mapInArrow(run, "class long, n int, keys array<long>, fp long")


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("src"), F.greatest(x, y).alias("dst")]


def _possible(x: str, y: str) -> Column:
    """Whether numbers of shingles leave room for the similarity."""
    return F.expr(f"5 * least({x}, {y}) >= 4 * greatest({x}, {y})")


def _whole(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, n and toks (all shingles) of the classes wanted."""
    wanted = cut(wanted.distinct())
    if wanted.count() <= BROADCAST:
        wanted = F.broadcast(wanted)
    return cut(_sets(_texts(docs).join(wanted, "class", "left_semi").dropDuplicates(["class"])))


def _similar(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (src, dst) of classes whose shingle sets, taken whole, are similar."""
    x, y = (sets.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("toks").alias(f"t_{c}")) for c in ("src", "dst"))
    shared = F.size(F.array_intersect("t_src", "t_dst"))
    return pairs.join(x, "src").join(y, "dst").where(9 * shared >= 4 * (F.col("n_src") + F.col("n_dst"))).select("src", "dst")


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (i, j) of similar sets that span the components of all such links.

    Searches breadth first: whatever is reached leaves the sets still compared.
    """
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(t) for t in sets])
    has, edges = np.zeros(len(names), bool), []
    left, left_flat, left_size = np.arange(len(sets)), flat, size
    own = np.split(flat, np.cumsum(size)[:-1])
    queue: list[int] = []
    while len(left):
        if not queue:
            queue, stays = [int(left[0])], np.arange(len(left)) > 0
        else:
            i = queue.pop()
            has[own[i]] = True
            shared = np.add.reduceat(has[left_flat].astype(np.int64), np.cumsum(left_size) - left_size)
            has[own[i]] = False
            near = 9 * shared >= 4 * (left_size + size[i])
            edges += [(i, int(j)) for j in left[near]]
            queue += left[near].tolist()
            stays = ~near
        if not stays.all():
            left_flat = left_flat[np.repeat(stays, left_size)]
            left, left_size = left[stays], left_size[stays]
    return edges


def _clustered(sets: DataFrame, clusters: DataFrame) -> DataFrame:
    """Links within clusters (class, cluster), found block by block."""
    d = sets.join(clusters, "class")
    blocks = d.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    d = d.join(blocks, "cluster").withColumn("b", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    d = d.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.select("cluster", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), "class", "toks")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("class")
        ids = p["class"].to_numpy()
        e = np.array(forest(p["toks"].tolist()), np.int64).reshape(-1, 2)
        return pd.DataFrame({"src": ids[e].min(axis=1), "dst": ids[e].max(axis=1)})

    return d.groupBy("cluster", "b1", "b2").applyInPandas(run, "src long, dst long")


def _by_fingerprint(heads: DataFrame) -> DataFrame:
    """Pairs of classes: the first of every fingerprint with the others of it, and with that of each linked one."""
    firsts = heads.groupBy("fp").agg(F.min("class").alias("least"))
    same = heads.join(firsts, "fp").where("class <> least").select(*_pair("class", "least"))
    found = simhash.links(firsts.select("fp"), joined=True).distinct()
    a, b = firsts.toDF("src", "a"), firsts.toDF("dst", "b")
    return same.unionByName(found.join(a, "src").join(b, "dst").select(*_pair("a", "b")))


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs (src, dst) of two components."""
    a, b = comp.toDF("src", "ca"), comp.toDF("dst", "cb")
    d = pairs.join(a, "src", "left").join(b, "dst", "left")
    return d.where(F.coalesce("ca", "src") != F.coalesce("cb", "dst")).select("src", "dst")


def links(docs: DataFrame) -> DataFrame:
    """(src, dst) pairs of similar classes that span the components of all such pairs that a key or a fingerprint shows."""
    spark = docs.sparkSession
    heads = cut(_heads(_texts(docs)).dropDuplicates(["class"]))
    entries = _entries(heads)
    hot = entries.where(F.col("k") > HOT).select("class", "lead").where("class <> lead").distinct()
    clusters = cut(connected_components(hot, "class", "lead").toDF("class", "cluster"))
    pairs = _tallied(entries, clusters, heads)
    sweep(spark)
    sets = _whole(docs, pairs.select(F.explode(F.array("src", "dst")).alias("class")).unionByName(clusters.select("class")))
    found = cut(_clustered(sets, clusters))
    best = pairs.groupBy("src").agg(F.max_by("dst", F.struct("tally", -F.col("dst"))).alias("dst"))
    best = cut(best.unionByName(pairs.groupBy("dst").agg(F.max_by("src", F.struct("tally", -F.col("src"))).alias("src"))).distinct())
    sweep(spark)
    found = cut(found.unionByName(_similar(sets, _apart(best, connected_components(found)))))
    tried = best.withColumn("tried", F.lit(True))
    rest = cut(_apart(pairs.select("src", "dst"), connected_components(found)).join(tried, ["src", "dst"], "left_anti"))
    sweep(spark)
    return found if rest.isEmpty() else cut(found.unionByName(_similar(sets, rest)))


def _entries(heads: DataFrame) -> DataFrame:
    """class, n, key, k and lead (number and least class of the key's) of keys that classes share."""
    index = heads.select("class", "n", F.explode("keys").alias("key"))
    met = index.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("class").alias("lead")).where("k > 1")
    return cut(index.join(met, "key"))


def _tallied(entries: DataFrame, clusters: DataFrame, heads: DataFrame) -> DataFrame:
    """src, dst, tally: candidates outside of clusters, and how many keys they share; linked fingerprints count as more."""
    few = entries.where(F.col("k") <= HOT).join(clusters, "class", "left").select("key", "class", "n", "cluster")
    apart = F.expr("x.class < y.class and not coalesce(x.cluster = y.cluster, false)")
    pairs = few.alias("x").join(few.alias("y"), "key").where(apart).where(_possible("x.n", "y.n"))
    pairs = pairs.groupBy(F.col("x.class").alias("src"), F.col("y.class").alias("dst")).agg(F.count(F.lit(1)).alias("tally"))
    prints = _by_fingerprint(heads.select("class", "fp")).withColumn("tally", F.lit(BANDS + 1).cast("long"))
    return cut(pairs.unionByName(prints).groupBy("src", "dst").agg(F.max("tally").alias("tally")))


def components(docs: DataFrame) -> DataFrame:
    """class and component of every class that is similar to another."""
    return connected_components(links(docs)).toDF("class", "component")
