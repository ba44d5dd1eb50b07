"""Near copies of the pipeline against brute force over all pairs."""

import random

import numpy as np

import corpus_pipeline as pipeline
from sparkloom.llm import near

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def slow_groups(texts):
    """Numbers of texts in groups linked by 5-word similarity of 0.8 or more, each group by its least number."""
    words = [(t or "").lower().encode().split() for t in texts]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in words]
    of = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if of[i] != of[j] and 10 * len(a & b) >= 8 * len(a | b):
                low, high = sorted((of[i], of[j]))
                of = [low if x == high else x for x in of]
    return of


def edited(seed):
    """A dense group of copies with 0 to 12 words changed, short and empty texts, and a line that many texts share."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(500)}" for _ in range(160)]
    line = " the same line of boilerplate words at the end of every text"
    texts = ["", " \n", None, "a", "A ", "one two three", "one two four", "a b c d e f g h i j", "a b c d e f g h i k"]
    for n in range(70):
        w = list(base)
        for at in rnd.sample(range(160), n % 13):
            w[at] = f"edit{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"v{rnd.randrange(10**6)}" for _ in range(n)) + line for n in (1, 2, 3, 5, 8, 20, 60) for _ in range(6)]
    rnd.shuffle(texts)
    return texts


def test_near_copies_are_those_of_brute_force(spark, sf):
    for texts in (edited(1), edited(2)):
        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
        got = sorted(r.doc_id for r in pipeline.near_copies(spark, docs, sf).collect())
        assert got == sorted(set(slow_groups(texts)))


def test_edited_copies_beyond_three_bits_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = sorted({rows[k][0] for k in slow_groups([t for _, t in rows])})
    got = sorted(r.doc_id for r in pipeline.near_copies(spark, docs, sf).collect())
    assert got == want and 145 not in got and 177 not in got


def test_keys_meet_as_often_as_they_should():
    rng = np.random.default_rng(3)
    for same, least, most in ((0.8, 1.0, 1.0), (0.6, 0.55, 0.95), (0.25, 0.0, 0.03)):
        met = 0
        for _ in range(200):
            h = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
            both, own = int(200 * same), (200 - int(200 * same)) // 2
            a, b = h[: both + own], np.concatenate([h[:both], h[both + own :]])
            met += bool(np.intersect1d(near.keys(a), near.keys(b)).size)
        assert least <= met / 200 <= most, (same, met)


def test_clusters_in_blocks_give_the_same_groups(spark, monkeypatch):
    texts = edited(4)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    groups = []
    for hot, block in ((16, 1 << 20), (2, 2000), (1000, 1 << 20)):
        monkeypatch.setattr(near, "HOT", hot)
        monkeypatch.setattr(near, "BLOCK", block)
        groups.append({(r["class"], r["component"]) for r in near.components(docs).collect()})
    assert groups[0] == groups[1] == groups[2] and groups[0]


def test_rows_are_kept_by_text_not_by_id(spark, sf):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(None, a), (7, b), (7, c), (9, b), (None, c), (None, a)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = [(r.doc_id, r.text) for r in pipeline.near_copies(spark, docs, sf).collect()]
    assert sorted(got, key=lambda x: x[1]) == [(None, a), (7, b), (7, c)]
