"""Fingerprints by their definition: order of documents, edits, lexicon band, subsets."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from sparkloom.llm import imatch

SCHEMA = "doc_id long, text string"
WORD = regex.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def prose(n, seed, words=60, vocabulary=400):
    g = np.random.default_rng(seed)
    names = [f"w{i:x}é" if i % 7 == 0 else f"Word{i:x}" for i in range(vocabulary)]
    return [" ".join(g.choice(names, size=int(g.integers(1, words)))) for _ in range(n)]


def term(word):
    return int(imatch.terms([word])[1][0])


def test_terms_as_by_a_pattern():
    texts = ["The cat, the CAT", "", "a", "ÉTÉ été x\x00y 'z'", " ends here", "here", "!", "日本 9a_b"] + prose(30, 1)
    doc, h = imatch.terms(texts)
    want = [(k, term(w)) for k, t in enumerate(texts) for w in WORD.findall(t.lower())]
    assert list(zip(doc.tolist(), h.tolist(), strict=True)) == want
    assert len({term(w) for w in ("ab", "ba", "a", "b", "aa", "aaa", "abab")}) == 7


def brute(texts, lexicon, i):
    """The fingerprint of a text, subset by subset."""
    own = {term(w) for w in WORD.findall(texts[i].lower())}
    own = sorted((own & lexicon) or own or {__import__("xxhash").xxh64_intdigest(texts[i].encode())})
    s, out = len(own).bit_length(), []
    u = np.array(own, np.uint64)
    for step in (0, 1):
        for draw in imatch._DRAWS:
            inside = u[imatch._mixed(u ^ draw) < np.uint64(1 << (64 - s - step))]
            total = sum(int(m) * pow(imatch._BASE, k, 1 << 64) for k, m in enumerate(imatch._mixed(inside))) % (1 << 64)
            out.append(max(int(imatch._mixed(np.array([total], np.uint64))[0]) >> 48, 1) if len(inside) else 0)
    return f"{s:02x}" + "".join(f"{x:04x}" for x in out)


def test_fingerprints_as_by_brute_force(spark):
    texts = prose(60, 2) + ["", "?!", "neverseen"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    lex = imatch.lexicon(df, 0.05, 0.2)
    n = Counter(w for t in texts for w in set(WORD.findall(t.lower())))
    want = {term(w) for w, k in n.items() if 0.05 * len(texts) <= k <= 0.2 * len(texts)}
    assert set(lex.tolist()) == want and 0 < len(want) < len(n)
    s, x = imatch.fingerprints(texts, lex)
    assert imatch.text_of(s, x) == [brute(texts, want, i) for i in range(len(texts))]


def following(rows):
    """Each row's next text: by id falling, nulls last; of one id in the order of a hash, which the caller gives."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    return [(a[0], a[1] or "", b[1] or "") for a, b in zip(order, order[1:] + order[:1], strict=True)]


@pytest.mark.parametrize("n", [1, 2, 200])
def test_documents_and_their_followers(spark, n):
    texts = [None if i % 17 == 3 else "" if i % 17 == 4 else t for i, t in enumerate(prose(n, n))]
    rows = [(None if n > 2 and i % 31 == 5 else i * 37 % 150, t) for i, t in enumerate(texts)]
    if n > 2:
        rows += [rows[7]] * 40 + [(11, "long " * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    hashed = [(r[0], r[1], r[2]) for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    want = Counter((i, len(t), hashlib.sha256(imatch.edited(t, b).encode()).hexdigest()) for i, t, b in following(hashed))
    got = imatch.fingerprinted(df).collect()
    assert Counter((r[0], r[1], r[2]) for r in got) == want
    assert all(0 <= x <= 1 for r in got for x in r[5:])
    prints = {}
    by_text = {(i, len(t)): t for i, t, _ in following(hashed)}
    for r in got:
        assert prints.setdefault(by_text[r[0], r[1]], r[3]) == r[3]


def test_likeness_follows_the_overlap():
    g = np.random.default_rng(5)
    names = [f"w{i}" for i in range(20_000)]
    for n in (20, 300, 3000):
        full, third, none = [], [], []
        for _ in range(12):
            a, b = (list(g.choice(names, size=n, replace=False)) for _ in range(2))
            ts = [" ".join(a), " ".join(a[: 2 * n // 3] + b[: n // 3]), " ".join(b), " ".join(reversed(a))]
            s, x = imatch.fingerprints(ts, np.sort(np.array([term(w) for w in names], np.uint64)))
            p = [(s[k : k + 1], x[k : k + 1]) for k in range(4)]
            full.append(imatch.likeness(p[0], p[3])[0])
            third.append(imatch.likeness(p[0], p[1])[0])
            none.append(imatch.likeness(p[0], p[2])[0])
            assert imatch.likeness(p[0], p[1]) == imatch.likeness(p[1], p[0])
        assert full == [1.0] * 12 and 0.25 < np.mean(third) < 0.65 and np.mean(none) < 0.12


def test_no_documents_and_other_columns(spark):
    assert imatch.fingerprinted(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(i, t) for i, t in enumerate(prose(40, 9))], SCHEMA)
    wide = df.withColumns({n: F.lit(f"own {n}") for n in ("id", "digest", "turn", "part", "kind", "follower", "following", "n_chars", "fingerprint", "a.b")})
    assert sorted(map(tuple, imatch.fingerprinted(wide).collect())) == sorted(map(tuple, imatch.fingerprinted(df).collect()))


def test_one_task_for_each_document(spark):
    """As many ranges as documents: every follower is met over the edges."""
    texts = prose(30, 11)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r[0]: r[2] for r in imatch.fingerprinted(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: hashlib.sha256(imatch.edited(t, texts[i - 1]).encode()).hexdigest() for i, t in enumerate(texts)}
