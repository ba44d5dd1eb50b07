"""Toxicity by a classifier chain.

The categories are predicted one after the other by linear models over words and word beginnings; each later model also
gets the earlier categories' probabilities. In training these are out-of-fold predictions, so that a later model meets
probabilities of the same quality as in use.

Fitting uses at most `max_rows` labelled rows of together at most `max_chars` characters, chosen by a hash of the id
(documented bounds; the driver holds no more than these); a text that doesn't fit into what is left is passed over, and
if none does, the shortest is taken. The vocabulary is what separates some category from the rest of the sample: features
are ranked by how many standard deviations their number of documents of the category lies off the expected one, and enter
as long as so much isn't to be expected of the best of so many by chance; the first LEAST of them enter in any case.
Scoring reads the whole text of every document.

Cases: null or empty text has no words and gets the models' base rates; a document without label is scored like any
other; equal label rows, and equal texts of a document, are learned from once; of every combination of labels the first
KEPT rows are in the sample, however rare it is; null labels and labels without an id are left out; if there
are no labels, or all of a kind, every document gets the observed rate (0 without labels) and no words; equal rows are
scored each on its own, and rows with a null id too; extra columns are not read, those kept pass through whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, with_text
from .langid import within
from .pieces import by_bytes

WORD = regex.compile(r"[\p{L}\p{N}]+")
#: Most labelled rows, and characters of them, that a fit takes.
MAX_ROWS, MAX_CHARS = 4000, 20_000_000
#: Rows of each combination of labels that a sample holds in any case, if there are so many.
KEPT = 50
#: Bytes of text whose words are looked up together.
SLICE = 1 << 20
#: Features that enter in any case, and at most.
LEAST, MOST = 32, 400

#: Beside each word, its beginnings of these lengths are features (marked by an asterisk): inflected forms share them.
STEMS = (4, 5, 6)


def words(text: str | None) -> set[str]:
    """The features of a text: its words and their beginnings."""
    own = set(WORD.findall((text or "").lower()))
    return own.union(*[{w[:k] + "*" for w in own if len(w) > k} for k in STEMS])


@dataclass
class Chain:
    """A fitted chain: words, and for each category weights (words, earlier categories, base)."""

    categories: list[str]
    vocabulary: dict[str, int]
    weights: list[np.ndarray]

    def score(self, found: list[list[int]]) -> np.ndarray:
        """Probabilities (documents, categories) of documents given by their words' numbers."""
        n = len(self.vocabulary)
        rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
        cols = np.fromiter((c for f in found for c in f), np.int64, len(rows))
        out = np.zeros((len(found), len(self.categories)))
        for k, w in enumerate(self.weights):
            z = np.bincount(rows, w[cols], len(found)) + out[:, :k] @ w[n : n + k] + w[-1]
            out[:, k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last weight is the unpenalised base."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def separating(doc: np.ndarray, feature: np.ndarray, names: list[str], marks: dict[str, np.ndarray], n: int, most: int = MOST) -> list[int]:
    """The features of the vocabulary, best first. doc, feature: which of n documents has which feature.

    Of n documents, n1 of the category, k with a feature: k * n1 / n of these are expected, with the deviation of the
    hypergeometric distribution; half a document is taken off the difference. Of V features the best reaches about
    sqrt(2 ln V) deviations by chance.
    """
    total = np.bincount(feature, minlength=len(names)).astype(float)
    best = np.zeros(len(names))
    for y in marks.values():
        n1 = y.sum()
        if not 0 < n1 < n:
            continue
        with_c = np.bincount(feature, y[doc], len(names))
        spread = np.sqrt(total * n1 / n * (n - n1) / n * (n - total) / max(n - 1, 1))
        best = np.maximum(best, np.where(spread > 0, (np.abs(with_c - total * n1 / n) - 0.5) / np.maximum(spread, 1e-9), 0))
    chance = (2 * np.log(max(len(names), 1))) ** 0.5
    front = np.flatnonzero(best >= np.sort(best)[-most]) if len(names) > most else np.arange(len(names))
    ranked = sorted(front[best[front] > 0].tolist(), key=lambda i: (-best[i], names[i]))[:most]
    return [i for at, i in enumerate(ranked) if at < LEAST or best[i] > chance]


def fit_chain(texts: Iterable[str | None], labels: dict[str, list[int]], folds: int = 5, most: int = MOST) -> Chain:
    """labels: for each category, in the chain's order, 0 or 1 of every text."""
    ids: dict[str, int] = {}
    # numbers instead of words: what the driver holds of a text is a few bytes a feature
    found = [np.array([ids.setdefault(w, len(ids)) for w in words(t)], np.int32) for t in texts]
    names, every = list(labels), list(ids)
    y = {c: np.asarray(labels[c], float) for c in names}
    doc, feature = np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate([np.zeros(0, np.int32), *found])
    chosen = separating(doc, feature, every, y, len(found), most)
    vocabulary = {every[k]: i for i, k in enumerate(chosen)}
    column = np.full(len(every), -1, np.int32)
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((len(found), len(chosen)))
    held = column[feature] >= 0
    x[doc[held], column[feature[held]]] = 1
    fold, weights = np.arange(len(found)) % folds, []
    for c in names:
        if not 0 < y[c].sum() < len(found):
            rate = min(max(y[c].mean(), 1e-9), 1 - 1e-9) if len(found) else 1e-9
            w = np.zeros(x.shape[1] + 1)
            w[-1] = np.log(rate / (1 - rate))
            weights.append(w)
            x = np.hstack([x, np.full((len(found), 1), rate)])
            continue
        weights.append(_logistic(x, y[c]))
        held = np.zeros(len(found))
        for f in range(folds):
            part = fold == f
            if part.any() and not part.all():
                held[part] = 1 / (1 + np.exp(-np.clip(np.hstack([x[part], np.ones((part.sum(), 1))]) @ _logistic(x[~part], y[c][~part]), -30, 30)))
        x = np.hstack([x, held[:, None]])
    return Chain(names, vocabulary, weights)


def fit(documents: DataFrame, labels: DataFrame, categories: dict[str, str], max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Chain:
    """categories: name and SQL condition over the label columns, in the chain's order."""
    names = [f"c{k}" for k in range(len(categories))]
    marks = labels.select("doc_id", *[F.expr(e).cast("int").alias(n) for n, e in zip(names, categories.values(), strict=True)]).na.drop()
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # the sample first, by id alone; then sizes; then only the texts that fit are read
    labelled = cut(marks.distinct().join(texts.select("doc_id").distinct(), "doc_id", "left_semi"))
    turn = [F.xxhash64("doc_id"), "doc_id", *names]
    # the combinations are at most two to the number of categories
    rare = [labelled.where(" and ".join(f"{n} = {r[n]}" for n in names)).orderBy(*turn).limit(KEPT) for r in labelled.select(*names).distinct().orderBy(*names).collect()]
    ids = reduce(DataFrame.unionByName, rare, labelled.orderBy(*turn).limit(max_rows)).distinct()
    digest = F.xxhash64("text").alias("digest")
    order = [F.xxhash64("doc_id"), "doc_id", "digest", *names]
    # equal texts of a document first become one; then again so many, the rare ones among them
    sized = texts.select("doc_id", F.length("text").alias("size"), digest).join(F.broadcast(ids), "doc_id").distinct().orderBy(*order).limit(max_rows + len(rare) * KEPT).collect()
    picked = [sized[i] for i in within([("", r["size"]) for r in sized], max_chars)]
    if not picked:
        return fit_chain([], {c: [] for c in categories})
    wanted = documents.sparkSession.createDataFrame(sorted({(r["doc_id"], r["digest"]) for r in picked}), T.StructType([marks.schema["doc_id"], T.StructField("digest", T.LongType())]))
    rows = texts.withColumn("digest", digest).join(F.broadcast(wanted), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    text = {(r["doc_id"], r["digest"]): r["text"] for r in rows.toLocalIterator()}
    return fit_chain([text[r["doc_id"], r["digest"]] for r in picked], {c: [r[n] for r in picked] for c, n in zip(categories, names, strict=True)})


def score(documents: DataFrame, chain: Chain, threshold: float = 0.25, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The columns to keep (doc_id unless named) with p_<category>... and toxic (the last category's probability reaches
    the threshold), their names after prefix; nothing is shuffled."""
    src, fields, at = with_text(documents, keep)
    names, n = [f"{prefix}p_{c}" for c in chain.categories], len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = chain.vocabulary
        known = vocabulary.keys()
        for whole in batches:
            for b in by_bytes(whole, at, SLICE):
                p = chain.score([[vocabulary[w] for w in known & words(t)] for t in b.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *[pa.array(p[:, k]) for k in range(p.shape[1])]], [*[f.name for f in fields], *names])

    out = src.mapInArrow(run, T.StructType([*fields, *[T.StructField(x, T.DoubleType()) for x in names]]))
    return out.withColumn(f"{prefix}toxic", F.col(names[-1]) >= threshold)


#: The chain of the labels table: low quality first, then toxicity given it.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def toxicity(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = 0.25) -> DataFrame:
    """op6: the chain's probabilities and decision for every document."""
    return score(documents, fit(documents, labels, CATEGORIES, max_rows), threshold)
