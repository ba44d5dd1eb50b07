"""Compression of vectors to codes by Lloyd's rounds with Yinyang bounds, all in whole numbers.

A vector's components become integers and are cut into PARTS parts; each part has a codebook of at most ENTRIES entries.
The entries of a codebook are clustered into groups, which stay. Of every part of every vector the first round keeps, for
each group, a lower bound of the distance to the group's entries (other than the one assigned). When entries move, a
bound shrinks by the furthest move within its group; only groups whose shrunken bound isn't beyond the distance to the
vector's own entry are scanned. Bounds are rounded down, so an entry that could be as near is always scanned, and what
is scanned is compared in exact integers, ties going to the lower index: codes are those of a full scan.

Vectors lie in blocks; a block's row carries its integers, codes, bounds and the sums of its parts by entry. A round reads
one table of blocks and writes the next; of these only the sums are added up and brought to the driver, which holds
codebooks: 64 vectors of each length.

Cases: vectors that are null or hold null or non-finite components are dropped; zero and empty vectors are kept.
Vectors of each length have codebooks of their own; where 16 doesn't divide the length d, part k begins at floor(k*d/16), and
an empty part has index 0. With fewer than 64 rows a codebook has as many entries. Components saturate where an error
would not fit a long any more: at 2^30 / sqrt(d) in size, half a million or more in the vector for d of 64. Null ids come
last, equal ids in the order of their vectors; repeated rows count each; an empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, forget, stored
from .vectors import doubles, finite, matrices

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Entries of a group of bounds, and bytes of integers of a block.
GROUP, BLOCK_BYTES = 10, 1 << 20

FAR = np.iinfo(np.int64).max


def integers(v: np.ndarray) -> np.ndarray:
    """The components of vectors (rows) as whole numbers."""
    most = int(2**30 / max(v.shape[1], 1) ** 0.5)
    return np.clip(np.floor(v * SCALE), -most, most).astype(np.int64)


def edges(d: int) -> list[int]:
    """Where the parts of a vector of length d begin, and its end."""
    return [k * d // PARTS for k in range(PARTS + 1)]


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows of x, rows of c)."""
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if x.shape[1] * (2 * int(most)) ** 2 < 1 << 52:  # then doubles are exact
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None]).astype(np.int64)
    out = np.zeros((len(x), len(c)), np.int64)
    for j in range(x.shape[1]):
        out += (x[:, j, None] - c[None, :, j]) ** 2
    return out


def groups(c: np.ndarray) -> np.ndarray:
    """The group of each entry: a few rounds of Lloyd over the entries themselves, from evenly spaced ones."""
    n = -(-len(c) // GROUP)
    mid = c[np.linspace(0, len(c) - 1, n).astype(int)].astype(float)
    for _ in range(5):
        own = ((c[:, None].astype(float) - mid[None]) ** 2).sum(axis=2).argmin(axis=1)
        mid = np.array([c[own == g].mean(axis=0) if (own == g).any() else mid[g] for g in range(n)])
    return own


def _below(squared: np.ndarray) -> np.ndarray:
    """Roots, rounded down; inf where there is no distance."""
    return np.where(squared == FAR, np.inf, np.sqrt(np.where(squared == FAR, 0, squared).astype(float)) * (1 - 1e-12))


def _packed_bounds(low: np.ndarray) -> np.ndarray:
    """The upper halves of single-precision numbers, which are never above low."""
    return ((np.maximum(low, 0) * (1 - 1e-6)).astype(np.float32).view(np.uint32) >> 16).astype(np.uint16)


def _bounds(packed: np.ndarray) -> np.ndarray:
    return (packed.astype(np.uint32) << 16).view(np.float32).astype(float)


def first(x: np.ndarray, c: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry, its squared distance, bound of each group) of every row by a full scan. own: the groups of c."""
    dist, rows = squares(x, c), np.arange(len(x))
    at = dist.argmin(axis=1)
    best = dist[rows, at]
    dist[rows, at] = FAR
    return at, best, np.stack([_below(dist[:, own == g].min(axis=1)) if (own == g).any() else np.full(len(x), np.inf) for g in range(own.max() + 1)], axis=1)


def again(x: np.ndarray, c: np.ndarray, own: np.ndarray, was: np.ndarray, low: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after entries moved, from the entries assigned before and their bounds, and how many distances were taken.
    drift: how far an entry of each group moved at most."""
    held = ((x - c[was]) ** 2).sum(axis=1)
    low = low - drift[None]
    scan = low <= (np.sqrt(held.astype(float)) * (1 + 1e-12))[:, None]
    at, best, taken = was.copy(), held.copy(), len(x)
    near = np.full(scan.shape, FAR)
    near_at, second = np.full(scan.shape, -1), np.full(scan.shape, FAR)
    for g in range(scan.shape[1]):
        rows, of = np.flatnonzero(scan[:, g]), np.flatnonzero(own == g)
        if not len(rows) or not len(of):
            continue
        dist, line = squares(x[rows], c[of]), np.arange(len(rows))
        taken += dist.size
        j = dist.argmin(axis=1)
        found, name = dist[line, j], of[j]
        dist[line, j] = FAR
        near[rows, g], near_at[rows, g], second[rows, g] = found, name, dist.min(axis=1)
        better = (found < best[rows]) | (found == best[rows]) & (name < at[rows])
        best[rows[better]], at[rows[better]] = found[better], name[better]
    new = np.where(scan, _below(np.where(near_at == at[:, None], second, near)), low)
    # an entry that was left joins the others of its group, where that was not scanned
    left = np.flatnonzero(at != was)
    g = own[was[left]]
    new[left, g] = np.where(scan[left, g], new[left, g], np.minimum(new[left, g], _below(held[left])))
    return at, best, new, taken


class Book:
    """The codebooks of one length: entries (k, d), the groups of each part's entries, and how far they moved."""

    def __init__(self, entries: np.ndarray, own: list[np.ndarray] | None = None, moved: list[np.ndarray] | None = None):
        self.entries, self.d = entries, entries.shape[1]
        cuts = edges(self.d)
        self.parts = [entries[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.own = own or [groups(p) for p in self.parts]
        self.moved = moved or [np.zeros(g.max() + 1) for g in self.own]

    def then(self, sums: np.ndarray, counts: np.ndarray) -> Book:
        """The next codebooks: sums (k, d), counts (PARTS, k); entries without vectors stay."""
        cuts, entries = edges(self.d), self.entries.copy()
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            used = counts[k] > 0
            entries[used, a:b] = [[int(s) // int(n) for s in row] for row, n in zip(sums[used, a:b], counts[k][used], strict=True)]
        new = Book(entries, self.own)
        far = [np.sqrt(((p - q) ** 2).sum(axis=1).astype(float)) * (1 + 1e-12) for p, q in zip(self.parts, new.parts, strict=True)]
        new.moved = [np.array([f[g == i].max(initial=0) for i in range(g.max() + 1)]) for f, g in zip(far, self.own, strict=True)]
        return new

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for p in self.parts for row in p.tolist() for v in row).encode()).hexdigest()

    def coded(self, x: np.ndarray, was: np.ndarray | None = None, low: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], int]:
        """Codes (rows, PARTS), errors, bounds of each part, and the distances taken."""
        cuts, codes, errors, bounds, taken = edges(self.d), [], np.zeros(len(x), np.int64), [], 0
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if was is None:
                at, best, bound = first(x[:, a:b], self.parts[k], self.own[k])
                n = len(x) * len(self.entries)
            else:
                at, best, bound, n = again(x[:, a:b], self.parts[k], self.own[k], was[:, k], low[k], self.moved[k])
            codes.append(at)
            bounds.append(bound)
            errors += best
            taken += n
        return np.stack(codes, axis=1), errors, bounds, taken

    def sums(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cuts, k = edges(self.d), len(self.entries)
        out, counts = np.zeros((k, self.d), np.int64), np.zeros((PARTS, k), np.int64)
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            counts[p] = np.bincount(codes[:, p], minlength=k)
            used = np.flatnonzero(counts[p])
            ordered = x[np.argsort(codes[:, p], kind="stable"), a:b]
            out[used, a:b] = np.add.reduceat(ordered, (np.cumsum(counts[p]) - counts[p])[used], axis=0)
        return out, counts


BLOCK = "d int, ids array<long>, labels array<string>, x binary, codes binary, bounds binary, sums binary, counts binary, taken long"
_BLOCK = pa.schema([("d", pa.int32()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), *[(c, pa.binary()) for c in ("x", "codes", "bounds", "sums", "counts")], ("taken", pa.int64())])


def _block(book: Book, ids: list, labels: list, x: np.ndarray, was: np.ndarray | None = None, low: list[np.ndarray] | None = None) -> dict:
    codes, _, bounds, taken = book.coded(x, was, low)
    sums, counts = book.sums(x, codes)
    packed = b"".join(_packed_bounds(b).tobytes() for b in bounds)
    return {"d": book.d, "ids": ids, "labels": labels, "x": x.astype(np.int32).tobytes(), "codes": codes.astype(np.uint8).tobytes(), "bounds": packed, "sums": sums.tobytes(), "counts": counts.tobytes(), "taken": taken}


def _read(book: Book, row: dict) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Integers, codes and bounds of a block."""
    n = len(row["ids"])
    x, codes = np.frombuffer(row["x"], np.int32).reshape(n, book.d).astype(np.int64), np.frombuffer(row["codes"], np.uint8).reshape(n, PARTS).astype(np.int64)
    flat, low, at = np.frombuffer(row["bounds"], np.uint16), [], 0
    for g in book.own:
        size = n * (int(g.max()) + 1)
        low.append(_bounds(flat[at : at + size]).reshape(n, -1))
        at += size
    return x, codes, low


def begin(rows: DataFrame, books: dict[int, Book]) -> DataFrame:
    """Blocks of the vectors, coded by a full scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, labels = b.column(0), b.column(1)
            for at, v in matrices(b.column(2)):
                x, step = integers(v), max(1, BLOCK_BYTES // (4 * max(v.shape[1], 1)))
                for i in range(0, len(at), min(step, 4096)):
                    part = at[i : i + min(step, 4096)]
                    row = _block(books[v.shape[1]], ids.take(pa.array(part)).to_pylist(), labels.take(pa.array(part)).to_pylist(), x[i : i + len(part)])
                    yield pa.RecordBatch.from_pylist([row], _BLOCK)

    return rows.mapInArrow(run, BLOCK)


def onward(blocks: DataFrame, books: dict[int, Book]) -> DataFrame:
    """The blocks after a round: only groups whose bound fails are scanned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                book = books[row["d"]]
                x, codes, low = _read(book, row)
                yield pa.RecordBatch.from_pylist([_block(book, row["ids"], row["labels"], x, codes, low)], _BLOCK)

    return blocks.mapInArrow(run, BLOCK)


def coded(blocks: DataFrame, books: dict[int, Book]) -> DataFrame:
    """vec_id, label, code, error and codebooks_sha256 of every vector, by a last assignment."""
    shas = {d: b.sha256() for d, b in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                book = books[row["d"]]
                codes, errors, _, _ = book.coded(*_read(book, row))
                flat = codes.astype(np.uint8).tobytes().hex()
                text = [flat[i : i + 2 * PARTS] for i in range(0, len(flat), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()), pa.array(text, pa.string()), pa.array(errors), pa.array([shas[book.d]] * len(text), pa.string())],
                    ["vec_id", "label", "code", "error", "codebooks_sha256"],
                )

    return blocks.mapInArrow(run, "vec_id long, label string, code string, error long, codebooks_sha256 string")


def moved(blocks: DataFrame, books: dict[int, Book]) -> dict[int, Book]:
    """The next codebooks, from the blocks' sums: a task adds up its own blocks, Spark those of all tasks."""
    shape = {d: (len(b.entries), d) for d, b in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            for row in b.to_pylist():
                both = np.concatenate([np.frombuffer(row["sums"], np.int64), np.frombuffer(row["counts"], np.int64)])
                own[row["d"]] = own.get(row["d"], 0) + both
        for d, both in own.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(both), d, np.int32)), pa.array(np.arange(len(both), dtype=np.int32)), pa.array(both)], ["d", "k", "n"])

    parts = blocks.select("d", "sums", "counts").mapInArrow(run, "d int, k int, n long")
    total = {d: np.zeros(k * d + PARTS * k, object) for d, (k, _) in shape.items()}
    for r in parts.groupBy("d", "k").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).toLocalIterator():
        total[r["d"]][r["k"]] = int(r["n"])
    return {d: books[d].then(t[: shape[d][0] * d].reshape(shape[d]), t[shape[d][0] * d :].reshape(PARTS, shape[d][0])) for d, t in total.items()}


def start(rows: DataFrame) -> dict[int, Book]:
    """The first codebooks of each length: the vectors of the smallest ids."""
    turn = F.row_number().over(Window.partitionBy("d").orderBy(F.col("id").asc_nulls_last(), "v"))
    few = rows.withColumn("d", F.size("v")).withColumn("turn", turn).where(F.col("turn") <= ENTRIES)
    found: dict[int, list] = {}
    for r in few.orderBy("d", "turn").select("d", "v").toLocalIterator():
        found.setdefault(r["d"], []).append(r["v"])
    return {d: Book(integers(np.array(v, float).reshape(len(v), d))) for d, v in found.items()}


def compressed(df: DataFrame, rounds: int = ROUNDS, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """op11: vec_id, code, error, label_error, codebooks_sha256 of every vector kept."""
    spark = df.sparkSession
    bounded_batches(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("v"))
    rows = doubles(rows, "v").where(finite("v"))
    books = start(rows)
    # each round's table replaces the last
    blocks, path = stored(begin(rows, books))
    for i in range(rounds):
        books = moved(blocks, books)
        if i < rounds - 1:
            (blocks, new), old = stored(onward(blocks, books)), path
            forget(spark, old)
            path = new
    out = cut(coded(blocks, books))
    forget(spark, path)
    sums = out.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    both = out.alias("o").join(sums.alias("s"), F.expr("o.label <=> s.label"))
    return both.select("o.vec_id", "o.code", "o.error", "s.label_error", "o.codebooks_sha256")
