"""I-Match fingerprints: terms of a band of inverse document frequency, hashed under randomised subsets of the lexicon.

A term is a run of ASCII letters, ASCII digits and characters beyond ASCII of the lower-cased text. The lexicon holds the
terms that at least LEAST and at most MOST of all documents have, counted over all of them. It is brought to every task:
since a document of t distinct terms can push at most t of them over the line, it has no more than mean(t) / LEAST
terms, whatever the number of documents.

A fingerprint hashes the sorted distinct lexicon terms of a text under SUBSETS random subsets of the lexicon. What share
of the lexicon a subset takes must fit the text: one that takes nearly all of a text's terms changes with any edit, one
that takes none says nothing. So each subset is nested at shares of a half, a quarter and so on, and a text with n
terms is hashed at the first two shares that leave it less than one term on average, 2^-s and 2^-(s+1) with
s = bit length of n. Likeness of two fingerprints is the share of equal hashes among those subsets, of shares that both
have, in which either has a term: it grows with the overlap of their terms, 1 for equal fingerprints.

The document that follows another is met in a sort by ranges: each task walks its documents in order and holds two at a
time; the first and last of each task meet afterwards.

Cases: null and empty texts, and texts without terms, have the fingerprint of their whole text as one term; a text whose
terms are all outside the lexicon is fingerprinted on all its terms. Fingerprints of texts of very unlike size (more
than a step of s) have likeness 0. Equal ids follow one another in the order of a hash of their texts, null ids come
last; a single document is followed by itself; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored, sweep
from .pieces import by_bytes, tidy

#: Shares of the documents between which a term's own must lie (an inverse document frequency of 0.7 to 6.9).
LEAST, MOST = 0.001, 0.5
SUBSETS = 32
#: Bytes of text whose terms are taken together.
SLICE = 1 << 20

_U = np.uint64
#: An odd multiplier of positions and its inverse modulo 2^64; an odd multiplier for each subset.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_DRAWS = np.random.default_rng(12).integers(1 << 63, size=SUBSETS, dtype=np.uint64) * _U(2) + _U(1)
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash of the term) of every term of every text, in order, repeats included.

    A term's hash is that of its bytes as a polynomial modulo 2^64, taken from running sums over the slice and then mixed.
    """
    lower = pc.utf8_lower(pa.array(texts, pa.large_string()))
    ends = np.frombuffer(lower.buffers()[1], np.int64)[: len(texts) + 1]
    data = np.frombuffer(lower.buffers()[2] or b"", np.uint8)[: ends[-1]]
    word = _WORD[data]
    # a term ends with its text
    start = word.copy()
    start[1:] &= ~word[:-1]
    stop = word.copy()
    stop[:-1] &= ~word[1:]
    inner = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(data))]
    start[inner] = word[inner]
    stop[inner - 1] = word[inner - 1]
    a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
    run = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * _powers(_BASE, len(data)), dtype=_U)])
    h = (run[b] - run[a]) * _powers(_BACK, len(data))[a] if len(a) else np.zeros(0, _U)
    return np.searchsorted(ends, a, side="right") - 1, _mixed(h + (b - a).astype(_U))


def distinct(texts: list[str], lexicon: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, term) of the distinct terms of each text, sorted; with a sorted lexicon those in it, or all of
    a text that has none there, or the whole text for one that has no terms."""
    doc, h = terms(texts)
    every, at = np.unique(h, return_inverse=True)
    pair = np.unique(doc * len(every) + at) if len(h) else np.zeros(0, np.int64)
    doc, at = (pair // len(every), pair % len(every)) if len(pair) else (pair, pair)
    if lexicon is None:
        return doc, every[at]
    i = np.searchsorted(lexicon, every)
    known = (i < len(lexicon)) & (lexicon[np.minimum(i, len(lexicon) - 1)] == every) if len(lexicon) else np.zeros(len(every), bool)
    inside = known[at] if len(at) else np.zeros(0, bool)
    n = np.bincount(doc[inside], minlength=len(texts))
    keep = inside | (n[doc] == 0)
    doc, h = doc[keep], every[at][keep]
    bare = np.flatnonzero(np.bincount(doc, minlength=len(texts)) == 0)
    if len(bare):
        own = np.array([xxhash.xxh64_intdigest(texts[k].encode()) for k in bare.tolist()], _U)
        doc, h = np.concatenate([doc, bare]), np.concatenate([h, own])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    return doc, h


def fingerprints(texts: list[str], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(s, hashes) of each text: hashes are (texts, 2 * SUBSETS) of 16 bits, those of share 2^-s first; 0: no term."""
    doc, h = distinct(texts, lexicon)
    n = np.bincount(doc, minlength=len(texts))
    s = np.frexp(n.astype(float))[1]  # the bit length
    out = np.zeros((len(texts), 2 * SUBSETS), np.uint16)
    bound = _U(1) << (_U(64) - s[doc].astype(_U))  # a draw below it takes the term at share 2^-s
    for j, draw in enumerate(_DRAWS):
        u = _mixed(h ^ draw)
        for step in (0, 1):
            of = np.flatnonzero(u < (bound >> _U(step)))
            if not len(of):
                continue
            d = doc[of]
            first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            place = np.arange(len(of)) - np.repeat(first, np.diff(np.concatenate([first, [len(of)]])))
            # the sorted terms as a polynomial in their places
            total = np.add.reduceat(_mixed(h[of]) * _powers(_BASE, int(place.max()) + 1)[place], first)
            out[d[first], step * SUBSETS + j] = np.maximum(_mixed(total) >> _U(48), _U(1)).astype(np.uint16)
    return s, out


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each pair of rows of a and b."""
    (s, x), (t, y) = a, b
    x, y = x.reshape(-1, 2, SUBSETS), y.reshape(-1, 2, SUBSETS)
    out, equal = np.zeros(len(s)), (s == t) & (x == y).all(axis=(1, 2))
    for off in (-1, 0, 1):  # t - s
        rows = np.flatnonzero(t - s == off)
        p, q = x[rows, max(off, 0) : 2 + min(off, 0)], y[rows, max(-off, 0) : 2 - max(off, 0)]
        either, same = ((p > 0) | (q > 0)).sum(axis=(1, 2)), ((p == q) & (p > 0)).sum(axis=(1, 2))
        out[rows] = same / np.maximum(either, 1)
    out[equal] = 1.0
    return out


def text_of(s: np.ndarray, hashes: np.ndarray) -> list[str]:
    """Fingerprints as text: s and the hashes in hexadecimal digits."""
    flat = hashes.astype(">u2").tobytes().hex()
    size = 8 * SUBSETS
    return [f"{k:02x}{flat[i * size : (i + 1) * size]}" for i, k in enumerate(s.tolist())]


def edited(text: str, following: str) -> str:
    """text, its last third of characters replaced by the first as many of the next one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def lexicon(texts: DataFrame, least: float = LEAST, most: float = MOST) -> np.ndarray:
    """The sorted hashes of the terms whose share of the documents lies in the band. texts: a column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes(whole, 0, SLICE):
                h, n = np.unique(distinct(b.column(0).to_pylist())[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])
            tidy()

    bounded_batches(texts.sparkSession)
    n = texts.count()
    df = texts.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    kept = df.where((F.col("n") >= least * n) & (F.col("n") <= most * n)).select("term")
    return np.sort(np.array([r[0] for r in kept.collect()], np.int64).view(_U))


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


def _results(ids: list, texts: list[str], prints: tuple[np.ndarray, np.ndarray], nexts: list[str], next_prints: tuple[np.ndarray, np.ndarray], lex: np.ndarray) -> list[pa.Array]:
    changed = [edited(t, n) for t, n in zip(texts, nexts, strict=True)]
    other = fingerprints(changed, lex)
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        pa.array(text_of(*prints), pa.string()), pa.array(text_of(*other), pa.string()), pa.array(likeness(prints, other)), pa.array(likeness(prints, next_prints)),
    ]


def fingerprinted(df: DataFrame, least: float = LEAST, most: float = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """op12: fingerprints of every document and of its edited text, and how like they are to each other and to the next."""
    spark = df.sparkSession
    bounded_batches(spark)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lex = lexicon(texts, least, most)
    sweep(spark)  # the counts' shuffle is done with
    order = [F.col("id").desc_nulls_last(), "digest", "turn"]
    # turn deals equal rows over tasks, whichever of them comes first
    keyed = texts.withColumn("digest", F.xxhash64("text")).withColumn("turn", F.monotonically_increasing_id())
    walk = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, names = TaskContext.get().partitionId(), ["part", "kind", "text", *_NAMES]

        def edge(kind: str, i: int | None, text: str) -> pa.RecordBatch:
            own = [pa.array([part], pa.int32()), pa.array([kind]), pa.array([text], pa.string()), pa.array([i], pa.int64())]
            return pa.RecordBatch.from_arrays([*own, pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.string())] * 3, *[pa.nulls(1, pa.float64())] * 2], names)

        held = None  # the last document so far and its fingerprint
        for whole in batches:
            for b in by_bytes(whole, 1, SLICE):
                ids, new = b.column(0).to_pylist(), b.column(1).to_pylist()
                s, x = fingerprints(new, lex)
                if held is None:
                    yield edge("first", None, new[0])
                else:
                    ids, new, s, x = [held[0], *ids], [held[1], *new], np.concatenate([held[2], s]), np.concatenate([held[3], x])
                m = len(new) - 1
                if m:
                    out = _results(ids[:m], new[:m], (s[:m], x[:m]), new[1:], (s[1:], x[1:]), lex)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, part, np.int32)), pa.array(["done"] * m), pa.nulls(m, pa.string()), *out], names)
                held = (ids[m], new[m], s[m:], x[m:])
            tidy()
        if held is not None:
            yield edge("last", held[0], held[1])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                both = fingerprints([row["text"], row["following"]], lex)
                own, other = ((both[0][k : k + 1], both[1][k : k + 1]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(_results([row["doc_id"]], [row["text"]], own, [row["following"]], other, lex), _NAMES)

    found, _ = stored(walk.mapInArrow(run, f"part int, kind string, text string, {_RESULT}"))
    sweep(spark)  # the shuffled texts are done with
    # tasks in their order, each followed by the next that had documents, the last by the first: a number a task
    parts = sorted(r[0] for r in found.where("kind = 'first'").select("part").collect())
    turns = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, follower int")
    heads = found.where("kind = 'first'").select(F.col("part").alias("follower"), F.col("text").alias("following"))
    ends = found.where("kind = 'last'").select("part", "doc_id", "text").join(turns, "part").join(heads, "follower").select("doc_id", "text", "following")
    return found.where("kind = 'done'").select(_NAMES).unionByName(ends.mapInArrow(finish, _RESULT))
