"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is eight bytes. Two fingerprints that differ in at most three bits share the byte at five or more of the
eight positions. Any five of eight positions hold one of FOURS, fourteen sets of four (their complements are the blocks
of the Steiner system S(3, 4, 8), which hold every three positions). The index is keyed by these, (positions, their
bytes): fourteen entries for each distinct fingerprint, with keys of 32 bits. Among the fingerprints of one key the
shared positional bytes of a pair are tallied, pairs that reach the guaranteed minimum (8 - bits) are kept and verified
bit by bit.

Equal fingerprints are one entry. A key with more than BLOCK fingerprints is split into blocks that meet in pairs, each
pair a task of its own, so that no task holds an unbounded group, and every task returns a forest that connects what it
found linked instead of all pairs. Components are then found by contraction.

Cases: null or empty text, or white space only, has fingerprint zero and is linked like any other; fewer words than a
shingle are one shingle; repeated rows and repeated ids are rows of one component; a row with a null id is in the
component of its text, and never gives it its name unless all of its ids are null; texts of any length are read whole;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, cut
from .pieces import by_bytes

#: The three ways to pair four positions.
_PAIRINGS = (((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2)))
#: Positions of which a pair within three bits shares all, for one of them at least: either half; or a pair of the first
#: half with a pair of the second, from the same way of pairing.
FOURS = [(0, 1, 2, 3), (4, 5, 6, 7), *[(*a, *(4 + p for p in b)) for pairing in _PAIRINGS for a in pairing for b in pairing]]
#: Fingerprints of a key that are compared in one task.
BLOCK = 4096


def fingerprint(text: str | None, shingle: int = 3, chunk: int = 1 << 14) -> int:
    """64-bit SimHash: a bit is 1 if set in over half the XXH64 (seed 42) of the shingles, repeats counted."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False)))
    return majority(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(shingles)), chunk)


def majority(h: np.ndarray, chunk: int = 1 << 14) -> int:
    """The 64 bits of which each is 1 if set in over half of the hashes; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), chunk):
        ones += np.unpackbits(h[i : i + chunk].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(df: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""
    bounded_batches(df.sparkSession)
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes(whole, 1):
                fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return src.mapInArrow(run, "doc_id long, fp long")


def _positional(fp: np.ndarray) -> np.ndarray:
    return fp.astype(np.int64).view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)


def forest(fp: np.ndarray, bits: int, joined: bool = False) -> list[tuple[int, int]]:
    """Edges (i, j) that connect exactly what links of at most `bits` differing bits connect; joined: links themselves,
    else from the first of each component.

    Searches breadth first: whatever is reached leaves the set of those still compared, so a dense group costs little
    more than its size.
    """
    byte, left, edges = _positional(fp), np.arange(len(fp)), []
    ones = fp.astype(np.int64).view(np.uint64)
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        root = queue[0]
        while queue and len(left):
            i = queue.pop()
            shared = (byte[left] == byte[i]).sum(axis=1)  # tally of shared positional bytes
            near = shared >= 8 - bits
            near[near] = np.bitwise_count(ones[left[near]] ^ ones[i]) <= bits
            hit = left[near]
            queue += hit.tolist()
            edges += [(i if joined else root, int(j)) for j in hit]
            left = left[~near]
    return edges


def links(fps: DataFrame, bits: int = 3, joined: bool = False) -> DataFrame:
    """(src, dst) edges among distinct fingerprints (column fp) that span the components of all links; joined: every
    edge is a link."""
    if not 0 <= bits <= 3:
        raise ValueError("the index guarantees links of at most 3 bits")
    keys = [F.concat(F.lit(bytes([k])), *[F.substring(F.unhex(F.lpad(F.hex("fp"), 16, "0")), p + 1, 1) for p in t]) for k, t in enumerate(FOURS)]
    index = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    index = cut(index.join(sizes, "key")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # a fingerprint of block b meets each other block o in the task of (least, greatest)
    index = index.withColumn("b", block).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    index = index.select("key", "n", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), "fp")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = np.sort(pdf["fp"].to_numpy())
        e = np.array(forest(fp, bits, joined), np.int64).reshape(-1, 2)
        return pd.DataFrame({"src": fp[e[:, 0]], "dst": fp[e[:, 1]]})

    # many keys a task: one Arrow group each would cost more than the comparison, so pairs of equal keys go native
    small = index.where("n <= 8")
    pair = small.alias("x").join(small.alias("y"), "key").where("x.fp < y.fp")
    native = pair.where(F.bit_count(F.expr("x.fp ^ y.fp")) <= bits).select(F.col("x.fp").alias("src"), F.col("y.fp").alias("dst"))
    return native.unionByName(index.where("n > 8").drop("n").groupBy("key", "b1", "b2").applyInPandas(run, "src long, dst long"))


def components(df: DataFrame, bits: int = 3, shingle: int = 3) -> DataFrame:
    """op7: doc_id, fingerprint, component_id of every document."""
    docs = cut(fingerprints(df, shingle))
    least = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    least = cut(least)
    found = connected_components(links(least.select("fp"), bits).distinct())
    grouped = least.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    grouped = cut(grouped)
    ids = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = grouped.join(ids, "component").select("fp", "component_id")
    return docs.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component_id"))
