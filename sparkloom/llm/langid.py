"""Language identification of mixed-language text.

A word's script narrows the languages it can be in; each language scores the word by its character trigrams; Viterbi
with a penalty for switching labels every word, so that runs of words become spans of one language. The document's
language is the one with the most letters.

Learned from at most `max_rows` labelled documents a language and `max_all` of all (documented bounds), chosen by a hash
of id and text, and from `max_chars` characters, of which each language has its own share; every text is predicted whole.

Cases: null text, or text without letters, is `und` with score 0; words of a script that no language was seen in are
open to every language but count for none in the score; ties go to the language that comes first in sorted order;
without anything to learn from, everything is `und`; equal rows are predicted each on its own and learned from once; a
null id is never held out; extra columns are not read, those kept pass through whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_text
from .pieces import by_bytes

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Most labelled documents of a language, and of all languages, that a fit takes; characters taken of them together.
MAX_ROWS, MAX_ALL, MAX_CHARS = 250, 4000, 4_000_000
#: Of a language's documents, a threshold of their hashes lets pass so many times max_rows before they are ranked.
SLACK = 2
#: Scripts by code point ranges (fixed values of the Unicode blocks).
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F),
    ("latin", 0x1E00, 0x1EFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
SWITCH = 8.0
#: Bytes of text whose words are scored together.
SLICE = 5 << 20


def script(word: str) -> str:
    c = ord(word[0])
    return next((name for name, a, b in SCRIPTS if a <= c <= b), "other")


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of words with a border on each side, as numbers, and how many each word has."""
    flat = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    at = np.arange(size.sum() - 2 * len(words)) + 2 * np.repeat(np.arange(len(words)), size - 2)
    return (flat[at] << 42) | (flat[at + 1] << 21) | flat[at + 2], size - 2


@dataclass
class Model:
    """grams: sorted trigram numbers; weights: their log-probabilities in each language, the last row for others."""

    languages: list[str]
    grams: np.ndarray
    weights: np.ndarray
    scripts: dict[str, np.ndarray]

    def _is_plain(self, word: str) -> bool:
        return word.isascii() and "latin" in self.scripts

    def scores(self, words: list[str]) -> np.ndarray:
        """(words, languages): each word's log-likelihood less that of its best language; very low where its script rules a language out."""
        if not words:
            return np.zeros((0, len(self.languages)))
        codes, n = _codes(words)
        i = np.searchsorted(self.grams, codes)
        hit = (i < len(self.grams)) & (self.grams[np.minimum(i, len(self.grams) - 1)] == codes) if len(self.grams) else np.zeros(len(codes), bool)
        row, first = np.where(hit, i, len(self.grams)), np.concatenate([[0], np.cumsum(n)[:-1]])
        # a language at a time, since one word may be as long as its text
        out = np.stack([np.add.reduceat(w[row], first) for w in self.weights.T], axis=1) / np.sqrt(n)[:, None]
        kinds = [script(w) for w in words]
        for kind in set(kinds):
            may = self.scripts.get(kind)
            if may is not None and not may.all():
                out[np.ix_([k == kind for k in kinds], ~may)] = -1e3
        return np.maximum(out - out.max(axis=1, keepdims=True), -30.0)

    def viterbi(self, emitted: list[np.ndarray]) -> list[np.ndarray]:
        """The best path (a language's number for each word) through each text's scores; all texts step together."""
        if not emitted:
            return []
        n = np.array([len(e) for e in emitted])
        order, k = np.argsort(-n, kind="stable"), len(self.languages)
        out = [np.zeros(x, np.int8) for x in n]
        alive = np.searchsorted(-n[order], -np.arange(n.max()), side="left")  # texts longer than t
        first = np.concatenate([[0], np.cumsum(n)[:-1]])[order]
        flat, best = np.concatenate(emitted), np.zeros((len(n), k))
        path, back = np.zeros(len(flat), np.int8), np.zeros((len(flat), k), np.int8)
        for t, m in enumerate(alive):
            d = best[:m]
            top = d.argmax(axis=1)
            jump = d[np.arange(m), top][:, None] - (SWITCH if t else 0)
            stay = d >= jump
            back[first[:m] + t] = np.where(stay, np.arange(k), top[:, None])
            best[:m] = np.where(stay, d, jump) + flat[first[:m] + t]
        at = best.argmax(axis=1)
        for t in range(len(alive) - 1, -1, -1):
            m = alive[t]
            path[first[:m] + t] = at[:m]
            at[:m] = back[first[:m] + t, at[:m]]
        for row, i in enumerate(order):
            out[i] = path[first[row] : first[row] + n[i]]
        return out

    def paths(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The best path of each text.

        Let L be the language of the best total. If no run of words gains more than one switch costs by leaving L,
        even with free choice among the others, staying in L is optimal; only other texts are searched.
        """
        table: dict[str, int] = {}
        numbers = [np.fromiter((table.setdefault(w, len(table)) for w in t), np.int64, len(t)) for t in texts]
        scores = self.scores(list(table))
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(texts)
        rest = []
        for i, x in enumerate(numbers):
            if not len(x):
                continue
            e = scores[x]
            k = int(e.sum(axis=0).argmax())
            run = np.concatenate([[0.0], np.cumsum(-e[:, k])])  # the best language of every word scores 0
            if (run - np.minimum.accumulate(run)).max() <= SWITCH:
                out[i] = np.full(len(x), k, np.int8)
            else:
                rest.append(i)
        for i, p in zip(rest, self.viterbi([scores[numbers[i]] for i in rest]), strict=True):
            out[i] = p
        return out

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, language) of each run of words in one language, in characters."""
        found = list(WORD.finditer(text or ""))
        path = self.paths([[m[0].lower() for m in found]])[0] if self.languages else []
        out: list[tuple[int, int, str]] = []
        for m, k in zip(found, path, strict=False):
            name = self.languages[k]
            if out and out[-1][2] == name:
                out[-1] = (out[-1][0], m.end(), name)
            else:
                out.append((m.start(), m.end(), name))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score: the share of the letters that lie in spans of it, in words of scripts that were learned."""
        words = [WORD.findall((t or "").lower()) for t in texts]
        if not self.languages:
            return [("und", 0.0) for _ in texts]
        out = []
        for ws, p in zip(words, self.paths(words), strict=True):
            if not ws:
                out.append(("und", 0.0))
                continue
            size = np.fromiter(map(len, ws), float, len(ws))
            k = int(np.bincount(p, size, len(self.languages)).argmax())
            own = (p == k) & ([True] * len(ws) if all(map(self._is_plain, ws)) else [script(w) in self.scripts for w in ws])
            out.append((self.languages[k], float(size[own].sum() / size.sum())))
        return out


def fit_texts(rows: list[tuple[str, str]], least: int = 2) -> Model:
    """rows: (text, language)."""
    languages = sorted({lang for _, lang in rows})
    counts, scripts = {x: Counter() for x in languages}, {x: Counter() for x in languages}
    for lang in languages:
        words = [w for text, of in rows if of == lang for w in WORD.findall(text.lower())]
        scripts[lang].update(map(script, words))
        codes, _ = _codes(words) if words else (np.zeros(0, np.int64), None)
        counts[lang] = dict(zip(*(x.tolist() for x in np.unique(codes, return_counts=True)), strict=True))
    every: Counter = Counter()
    for c in counts.values():
        every.update(c)
    grams = np.array(sorted(g for g, n in every.items() if n >= least), np.int64)
    seen = np.array([[counts[x].get(g, 0) for x in languages] for g in grams.tolist()] + [[0] * len(languages)], float)
    total = np.array([sum(counts[x].values()) for x in languages], float)
    weights = np.log((seen + 0.5) / (total + 0.5 * len(seen)))
    share = {x: {s: n / sum(scripts[x].values()) for s, n in scripts[x].items()} for x in languages}
    may = {s: np.array([share[x].get(s, 0) >= 0.01 for x in languages]) for s in {s for x in languages for s in share[x]}}
    return Model(languages, grams, weights, {s: x for s, x in may.items() if x.any()})


def held_out(c: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def within(sizes: list[tuple[str, int]], most: int) -> list[int]:
    """Numbers of the (language, size) rows taken: each language has an equal share of `most`, to which those before it
    that need less add what they leave. A row that doesn't fit is skipped; where none fits, the shortest is taken."""
    rows: dict[str, list[int]] = {}
    for i, (lang, _) in enumerate(sizes):
        rows.setdefault(lang, []).append(i)
    out, left = [], most
    for turn, lang in enumerate(sorted(rows, key=lambda x: (sum(sizes[i][1] for i in rows[x]), x))):
        budget, own = left // (len(rows) - turn), []
        for i in rows[lang]:
            if sizes[i][1] <= budget:
                own.append(i)
                budget -= sizes[i][1]
        own = own or [min(rows[lang], key=lambda i: sizes[i][1])]
        left = max(left - sum(sizes[i][1] for i in own), 0)
        out += own
    return sorted(out)


def sample(known: DataFrame, max_rows: int, max_all: int) -> DataFrame:
    """doc_id, lang, digest and size of the rows to learn from, by language and hash; equal rows are one.

    A threshold of the hash, by the number of a language's different rows, leaves about SLACK * max_rows of each to be
    ranked, so that no task gets more, however many rows a language has. The number comes from a sketch of the same hashes
    (2 % off), which repeats don't change; a language with no more than that many rows passes whole. Rows are taken in turn
    from each language in sorted order, so no more than the first max_all languages can enter, and no more counts are
    broadcast.
    """
    from pyspark.sql import Window

    rows = known.select("doc_id", "lang", F.xxhash64("text").alias("digest"), F.length("text").alias("size"))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "digest"))
    count = F.broadcast(rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).orderBy("lang").limit(max_all))
    share = F.pmod("h", F.lit(1 << 31)) / float(1 << 31)
    few = rows.join(count, "lang").where(share * F.col("n") <= SLACK * max_rows).drop("n").distinct()
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "digest"))
    return few.withColumn("k", turn).where(F.col("k") <= max_rows).orderBy("k", "lang").limit(max_all).select("doc_id", "lang", "digest", "size")


def fit(df: DataFrame, max_rows: int = MAX_ROWS, max_all: int = MAX_ALL, max_chars: int = MAX_CHARS) -> Model:
    """Learns from documents that have a text and a language and are not held out."""
    known = df.select("doc_id", "text", "lang").where("text is not null and lang is not null").where(~held_out())
    # sizes first; texts that aren't taken never leave the executors
    rows = sample(known, max_rows, max_all).collect()
    picked = [rows[i] for i in within([(r["lang"], r["size"]) for r in rows], max_chars)]
    if not picked:
        return fit_texts([])
    key = ["doc_id", "lang", "digest"]
    known = known.withColumn("digest", F.xxhash64("text"))
    taken = df.sparkSession.createDataFrame([tuple(r[c] for c in key) for r in picked], T.StructType([known.schema[c] for c in key]))
    match = F.expr(" and ".join(f"k.{c} <=> t.{c}" for c in key))
    texts = known.alias("k").join(F.broadcast(taken).alias("t"), match, "left_semi").dropDuplicates(key)
    return fit_texts([(r["text"], r["lang"]) for r in texts.orderBy("lang", F.xxhash64("doc_id", "digest"), "doc_id").toLocalIterator()])


def predict(df: DataFrame, model: Model, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns of df to keep (doc_id unless named) with prediction and score of every row; nothing is shuffled."""
    src, fields, at = with_text(df, keep)
    n = len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes(whole, at, SLICE):
                got = model.predict(b.column(at).to_pylist())
                new = [pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *new], [*[f.name for f in fields], *names])

    return src.mapInArrow(run, T.StructType([*fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def identified(df: DataFrame) -> DataFrame:
    """op8: prediction for every document, learned from those that are not held out."""
    return predict(df, fit(df)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
