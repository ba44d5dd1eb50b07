"""The training-data operators against brute force, on driver tables and on awkward rows."""

import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import ann, bpe, counts, hnsw, langid, licenses, packing, sharding, simhash, toxicity
from sparkloom.llm.common import connected_components

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = [None, "", " ", "a", "see <|ENDOFTEXT|> here <|EndOfText|>, <|endoftext|>.", "J\u030c \u01f0 A\u030a.B", "a\x00 b\u00a0 c\u3000 d", "  double  spaces \n\n tabs\t", "it's we'll <|endoftext|> x", "日本語 テスト 😀 ´ ſ İ Σας", "x" * 5000, "word " * 3000, "Ünïcode ÀB", "\x00\x1c \x85z", "%%% ### ,,, .", "a a a a", "MIT License"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, a clashing name."""
    rows = [(i, t, None, None if i % 2 else "s", i) for i, t in enumerate(ODD)]
    rows += [rows[3], rows[3], rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long").cache()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def tokenizer(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def u32(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


# 1, 2


def test_bpe_is_the_library(odd, docs):
    t = tokenizer(BYTES)
    for df in (odd, docs):
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids
            want[r.doc_id, len(ids), hashlib.sha256(u32(ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in bpe.digest(df, BYTES).collect()) == want


def test_bpe_one_million_letters():
    m = bpe.loaded(BYTES)
    ids = m.encode("ab" * 50_000)
    assert m.decode(ids) == "ab" * 50_000


def test_bpe_decodes_broken_sequences():
    m, t = bpe.loaded(BYTES), tokenizer(BYTES)
    for ids in ([220, 128, 255], [50256, 13, 50256], [], list(range(120, 260))):
        assert m.decode(u32(ids)) == t.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_token_counts(odd, docs, path):
    t = tokenizer(path)
    for df in (odd, docs):
        want = Counter((r.doc_id, len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False)), n > 1024) for r in df.select("doc_id", "text").collect())
        assert Counter(tuple(r) for r in counts.token_counts(df, path).collect()) == want


def test_sentencepiece_counts(odd):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.n_tokens for r in counts.token_counts(odd, P.path("piece_bpe_32k.model")).collect()}
    assert got == {r.doc_id: len(m.encode(r.text or "")) for r in odd.select("doc_id", "text").collect()}


# 3


def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16))
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)]
    rows += [(900 + i, x[0].tolist(), 0) for i in range(300)]  # a third of the rows are one vector
    rows += [(2000, None, 0), (2100, [0.0] * 16, 0), (2200, [float("nan")] * 16, 0), (2300, [None] * 16, 0), (2400, [1.0, 2.0], 1), (2401, [3.0, 4.0], 1), (2402, [3.0, 5.0], 1), (2500, [], 1), (None, x[1].tolist(), 1), (0, x[0].tolist(), 0), (2600, x[2].tolist(), None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 32)
    df = vectors(spark).withColumn("id", F.lit("x")).withColumn("v", F.lit(1)).withColumn("cls", F.lit(2)).withColumn("d", F.lit(3))
    seen, x = set(), {}
    for r in df.collect():
        if r.vec_id is not None and r.embedding and len(r.embedding) == 16 and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding):
            x[r.vec_id] = np.array(r.embedding)
            seen.add(r.vec_id)
    got = defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    queries = [q for q in seen if q % 100 == 0]
    assert got.pop(2400) == [(1, 2401, math.sqrt(8.0)), (2, 2402, math.sqrt(13.0))]  # of length two
    assert sorted(got) == sorted(queries)
    hits = 0
    for q in queries:
        want = sorted((math.sqrt(((x[q] - v) ** 2).sum()), i) for i, v in x.items() if i != q)[:10]
        assert [g[0] for g in got[q]] == list(range(1, 11))
        assert all(abs(s - math.sqrt(((x[q] - x[i]) ** 2).sum())) < 1e-12 for _, i, s in got[q])
        assert [(s, i) for _, i, s in got[q]] == sorted((s, i) for _, i, s in got[q])
        hits += len({i for _, i in want} & {i for _, i, _ in got[q]})
    assert hits >= 0.9 * 10 * len(queries)
    assert [g[1] for g in got[0]] == list(range(900, 910))  # ties to smaller ids
    assert ann.nearest(df.where("false")).count() == 0
    assert ann.nearest(df.where("vec_id in (0, 5, 7)")).count() == 2


# 4


def test_sharding(odd, docs):
    for df in (odd, docs):
        out = sharding.sharded(df, 5, 512).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((r.doc_id, 16 + len((r.text or "").encode()), zlib.crc32((r.text or "").encode())) for r in df.select("doc_id", "text").collect())
        by = defaultdict(list)
        for r in out:
            by[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
    load = Counter()
    for r in out:
        load[r.shard] += r.size
    assert len(load) == 5 and max(load.values()) < 1.02 * sum(load.values()) / 5
    assert sharding.sharded(docs.where("false"), 5, 512).count() == 0


def test_sharding_of_many_equal_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sharding, "RUN", 7)
    df = spark.range(300).selectExpr("if(id < 100, 5, id) doc_id", "if(id < 100, 'same', concat('text', id)) text", "id slot")
    out = sharding.sharded(df, 3, 64, str(tmp_path / "map")).collect()
    assert sum(r.doc_id == 5 for r in out) == 100 and len(out) == 300
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        assert r.next_shard in (r.shard, 3)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {r.version for r in spark.read.parquet(str(tmp_path / "map")).collect()} == {1, 2}


def test_slot_map_versions(spark, docs, tmp_path):
    w = sharding.slot_bytes(sharding.records(docs, 256), 256)
    one = sharding.slot_map(w, 4).cache()
    two = sharding.grow(one, 4)
    sharding.store_map(one, str(tmp_path / "m"))
    sharding.store_map(two, str(tmp_path / "m"))
    a = {r.virtual_slot: r.shard for r in sharding.load_map(spark, str(tmp_path / "m"), 1).collect()}
    b = {r.virtual_slot: r.shard for r in sharding.load_map(spark, str(tmp_path / "m")).collect()}
    size = {r.virtual_slot: r.bytes for r in w.collect()}
    assert len(a) == len(b) == 256 and all(b[s] in (a[s], 4) for s in a)
    moved = sum(size[s] for s in a if b[s] == 4)
    assert 0.15 < moved / sum(size.values()) <= 0.2 and all(size[s] for s in a if b[s] == 4)


# 5


def binary_lengths(n, length):
    rest = n % length
    return [length] * (n // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def test_packing(odd, docs):
    t = tokenizer(WORDS)
    for df in (odd, docs):
        want = Counter(tuple([r.doc_id, u32(t.encode(r.text or "", add_special_tokens=False).ids + [1])]) for r in df.select("doc_id", "text").collect())
        out = packing.packed(df, WORDS).collect()
        assert sorted(r.sequence_id for r in out) == list(range(len(out))) and all(r.offset == 0 and r.length <= 2048 and r.length & (r.length - 1) == 0 for r in out)
        got = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out)
        expected = Counter()
        for (doc, ids), k in want.items():
            n, at = len(ids) // 4, 0
            for m in binary_lengths(n, 2048):
                expected[doc, at, m, zlib.crc32(ids[4 * at : 4 * (at + m)]), n] += k
                at += m
            assert at == n
        assert got == expected
    assert packing.packed(docs.where("false"), WORDS).count() == 0
    doc, piece, start, size = packing.decomposed(np.array([2048 * 2 + 5, 1, 2048]), 2048)
    assert doc.tolist() == [0, 0, 0, 0, 1, 2] and piece.tolist() == [0, 1, 2, 3, 0, 0]
    assert start.tolist() == [0, 2048, 4096, 4100, 0, 0] and size.tolist() == [2048, 2048, 4, 1, 1, 2048]


# 6


def test_toxicity_held_out(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 4 <> 0")
    pairs = labels.where("doc_id % 4 = 0").select("doc_id", F.col("toxic").alias("truth")).join(toxicity.toxicity(d, train), "doc_id").collect()
    assert sum(bool(r.truth) == r.toxic for r in pairs) >= 0.93 * len(pairs)
    assert not any(r.toxic for r in pairs if not r.truth) or sum(r.toxic for r in pairs if not r.truth) <= 0.02 * len(pairs)


def test_toxicity_edges(spark, odd):
    schema = "doc_id long, quality int, toxic int"
    none = toxicity.toxicity(odd, spark.createDataFrame([], schema))
    assert none.count() == odd.count() and none.where("toxic").count() == 0
    some = toxicity.toxicity(odd, spark.createDataFrame([(3, 1, 0), (4, None, 1), (4, 1, 0), (None, 1, 1)], schema))
    assert some.count() == odd.count() and some.where("p_toxic is null").count() == 0
    assert toxicity.toxicity(odd.where("false"), spark.createDataFrame([(3, 1, 0)], schema)).count() == 0


def slow_logistic(x, y, l2=1.0):
    """Ridge logistic regression by plain Newton steps in Python numbers; the last weight is the base."""
    x = [[*row, 1.0] for row in x]
    k = len(x[0])
    w = [0.0] * k
    ridge = [l2] * (k - 1) + [1e-3]
    for _ in range(60):
        p = [1 / (1 + math.exp(-sum(a * b for a, b in zip(w, row, strict=True)))) for row in x]
        g = [sum(row[j] * (t - q) for row, t, q in zip(x, y, p, strict=True)) - ridge[j] * w[j] for j in range(k)]
        h = [[sum(row[i] * row[j] * q * (1 - q) for row, q in zip(x, p, strict=True)) + (ridge[i] if i == j else 0) for j in range(k)] for i in range(k)]
        w = [a + b for a, b in zip(w, np.linalg.solve(np.array(h), np.array(g)).tolist(), strict=True)]
    return w


def test_toxicity_chain_by_hand(spark):
    """Features, folds, out-of-fold probabilities, weights and scores of a small table, worked out again."""
    rng = np.random.default_rng(6)
    common, bad, poor = ["tree", "house", "road", "lake", "sun"], ["vile", "nasty"], ["junk", "spam"]
    rows = []
    for i in range(60):
        low, tox = i % 3 == 0, i % 4 == 0
        ws = [*rng.choice(common, 6), *(rng.choice(poor, 2) if low else []), *(rng.choice(bad, 2) if tox and i % 8 else [])]
        rows.append((i, " ".join(ws), int(not low), int(tox)))
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int")
    order = [r.doc_id for r in docs.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    texts = [rows[i][1].split() for i in order]
    y = {"low_quality": [1 - rows[i][2] for i in order], "toxic": [rows[i][3] for i in order]}
    found = [{w[:k] + "*" for w in t for k in (4, 5, 6) if len(w) > k} | set(t) for t in texts]
    best = {}
    for f in set().union(*found):
        k = sum(f in x for x in found)
        for marks in y.values():
            n, n1, a = len(found), sum(marks), sum(f in x and m for x, m in zip(found, marks, strict=True))
            spread = math.sqrt(k * n1 / n * (n - n1) / n * (n - k) / (n - 1))
            best[f] = max(best.get(f, 0), (abs(a - k * n1 / n) - 0.5) / spread if spread else 0)
    chosen = sorted((f for f in best if best[f] > 0), key=lambda f: (-best[f], f))[: toxicity.LEAST]
    chain = toxicity.fit(docs, labels, toxicity.CATEGORIES)
    assert list(chain.vocabulary) == chosen and {"junk", "vile", "nasty"} <= set(chosen)
    x = [[float(f in t) for f in chosen] for t in found]
    held = [0.0] * len(x)
    for fold in range(5):
        w = slow_logistic([r for i, r in enumerate(x) if i % 5 != fold], [v for i, v in enumerate(y["low_quality"]) if i % 5 != fold])
        for i in range(fold, len(x), 5):
            held[i] = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, [*x[i], 1.0], strict=True))))
    first, second = slow_logistic(x, y["low_quality"]), slow_logistic([[*r, h] for r, h in zip(x, held, strict=True)], y["toxic"])
    assert np.allclose(chain.weights[0], first, atol=1e-4) and np.allclose(chain.weights[1], second, atol=1e-4)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    for i, r in zip(order, x, strict=True):
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(first, [*r, 1.0], strict=True))))
        q = 1 / (1 + math.exp(-sum(a * b for a, b in zip(second, [*r, p, 1.0], strict=True))))
        assert abs(got[i].p_low_quality - p) < 1e-4 and abs(got[i].p_toxic - q) < 1e-4 and got[i].toxic == (got[i].p_toxic >= 0.25)


def test_toxicity_sample_passes_long_texts_over(spark):
    rows = [(i, "vile words here" if i % 2 else "tree and lake") for i in range(40)] + [(100 + i, "long text " * 500) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "1 quality", "int(doc_id % 2) toxic")
    chain = toxicity.fit(docs, labels, toxicity.CATEGORIES, max_chars=1000)
    assert "vile" in chain.vocabulary and "long" not in chain.vocabulary


# 7


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, bits=3):
    root = {f: f for f in set(fps.values())}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(root)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    least = {}
    for d, f in fps.items():
        least[find(f)] = min(least.get(find(f), d), d)
    return {d: least[find(f)] for d, f in fps.items()}


def test_simhash(odd, docs, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.components(docs).collect()}
    fps = {d: slow_fingerprint(t) for d, t in texts.items()}
    comps = slow_components(fps)
    assert got == {d: (f"{f:016x}", comps[d]) for d, f in fps.items()}
    out = simhash.components(odd)
    assert out.count() == odd.count()
    empty = {r.doc_id: (r.fingerprint, r.component_id) for r in out.collect()}
    assert empty[0] == empty[1] == empty[2] == ("0" * 16, 0)
    assert simhash.components(docs.where("false")).count() == 0


def test_every_five_positions_hold_an_indexed_four():
    from itertools import combinations

    assert len(set(simhash.FOURS)) == 14 and all(any(set(f) <= set(five) for f in simhash.FOURS) for five in combinations(range(8), 5))


def test_simhash_links_of_dense_and_random_hashes(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 62))
    near = {base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)) for _ in range(300)}
    other = {int(x) for x in rng.integers(0, 1 << 62, 300)}
    fps = {f - (1 << 64) if f >> 63 else f: f for f in near | other}
    df = spark.createDataFrame([(s,) for s in fps], "fp long")
    monkeypatch.setattr(simhash, "BLOCK", 16)
    comp = {r.node: r.component for r in connected_components(simhash.links(df)).collect()}
    want = slow_components(fps)
    got_groups, want_groups = defaultdict(set), defaultdict(set)
    for s in fps:
        got_groups[comp.get(s, s)].add(s)
        want_groups[want[s]].add(s)
    assert {frozenset(g) for g in got_groups.values()} == {frozenset(g) for g in want_groups.values()}


def test_connected_components_of_a_chain(spark):
    e = spark.range(200).selectExpr("id src", "id + 1 dst").union(spark.createDataFrame([(500, 501), (501, 501)], "src long, dst long"))
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert connected_components(e.where("false")).count() == 0


# 8


def test_language(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = d.select("doc_id", "lang").join(langid.identified(d), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in out)


def test_language_edges(odd):
    out = langid.identified(odd)
    assert out.count() == odd.count() and {r.lang_pred for r in out.collect()} == {"und"}
    m = langid.fit_texts([("the house and the tree stand", "en"), ("дом и дерево стоят", "ru"), ("das haus und der baum", "de")])
    assert m.predict([None, "12 34", "дерево", "the tree"])[:3] == [("und", 0.0), ("und", 0.0), ("ru", 1.0)]
    assert [s[2] for s in m.spans("the house and the tree stand " * 4 + "дом и дерево стоят")] == ["en", "ru"]


def slow_prediction(rows, text):
    """Language and score of a text by dictionaries and a plain search over all states of all words."""
    import unicodedata

    def words(t):
        out, w = [], ""
        for c in t.lower() + " ":
            kind = unicodedata.category(c)[0]
            if kind == "L" or (kind == "M" and w):
                w += c
            else:
                out += [w] if w else []
                w = ""
        return out

    langs = sorted({lang for _, lang in rows})
    grams = lambda w: [f"^{w}$"[i : i + 3] for i in range(len(w))]
    seen = {x: Counter(g for t, lang in rows if lang == x for w in words(t) for g in grams(w)) for x in langs}
    known = {g for g, n in sum(seen.values(), Counter()).items() if n >= 2}
    weight = lambda x, g: math.log((seen[x][g] + 0.5 if g in known else 0.5) / (sum(seen[x].values()) + 0.5 * (len(known) + 1)))
    ws = words(text)
    if not ws:
        return "und", 0.0
    cost = []
    for w in ws:
        e = [sum(weight(x, g) for g in grams(w)) / math.sqrt(len(w)) for x in langs]
        cost.append([max(v - max(e), -30.0) for v in e])
    best = [(v, [k]) for k, v in enumerate(cost[0])]
    for e in cost[1:]:
        best = [max(((v - langid.SWITCH * (p[-1] != k) + e[k], [*p, k]) for v, p in best), key=lambda x: x[0]) for k in range(len(langs))]
    path = max(best, key=lambda x: x[0])[1]
    letters = [sum(len(w) for w, p in zip(ws, path, strict=True) if p == k) for k in range(len(langs))]
    k = letters.index(max(letters))
    return langs[k], letters[k] / sum(letters)


def test_language_scores_like_a_plain_search(docs):
    rows = [(r.text, r.lang) for r in docs.orderBy("doc_id").limit(60).collect()]
    model = langid.fit_texts(rows)
    by = {lang: t.split() for t, lang in rows if len(t) > 300}
    mixed = [" ".join(a[:12] + b[5:20] + a[20:25]) for a in by.values() for b in by.values()]
    texts = [t[:400] for t, _ in rows[:15]] + mixed + ["", "1 2", "don't A.B.c naïve", "Ⅻ ½ x²"]
    got = model.predict(texts)
    for t, (lang, score) in zip(texts, got, strict=True):
        want = slow_prediction(rows, t)
        assert lang == want[0] and abs(score - want[1]) < 1e-9, (t, lang, score, want)
    assert len({round(s, 3) for _, s in got}) > 5


def test_viterbi_is_exact():
    rng = np.random.default_rng(5)
    m = langid.Model(["a", "b", "c"], np.zeros(0, np.int64), np.zeros((1, 3)), {})

    def cost(p, e):
        return sum(e[t, k] for t, k in enumerate(p)) - langid.SWITCH * sum(x != y for x, y in zip(p, p[1:], strict=False))

    for _ in range(30):
        e = -rng.exponential(6, (6, 3))
        e -= e.max(axis=1, keepdims=True)
        best = max(cost(p, e) for p in __import__("itertools").product(range(3), repeat=6))
        assert abs(cost(m.viterbi([e, e[:2]])[0].tolist(), e) - best) < 1e-9


# 9


def slow_licenses(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    # rules, in the plain way: every match of every rule, then pairwise suppression
    text = "".join(f" {w}" for w in words) + " "
    hits = []
    for r in licenses.rules():
        for m in re.finditer("(?<= )" + r["pattern"], text):
            hits.append((text[: m.start()].count(" ") - 1, text[: m.end()].count(" "), r["priority"], r["label"]))
    kept = set()
    for i, h in enumerate(hits):
        inside = any(g[2] <= h[2] and g[0] <= h[0] and g[1] >= h[1] and (g[:2] != h[:2] or (g[2], g[3]) < (h[2], h[3])) for j, g in enumerate(hits) if j != i)
        if not inside:
            kept.add(h[3])
    base = {x for _, x in places}
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | kept))


LICENSED = ["Licensed under the Apache License, Version 2.0.", "MIT License MIT License mit  license", "GNU Lesser General Public License version 2.1 or later; GNU General Public License", "CC BY 4.0 and CC-BY-SA 3.0", "SPDX-License-Identifier: GPL-2.0-or-later", "BSD 3-Clause License. All rights reserved", "permission is hereby granted, free of charge, to any person obtaining a copy", "İ MIT LICENSE ſ", "Beerware License, beer ware license; OpenRAIL-M License, open rail license", "cc by cc by CC-BY", "what the fuc\u212a you want"]


def test_licenses(spark, odd, docs):
    extra = spark.createDataFrame(list(enumerate(LICENSED)), "doc_id long, text string")
    for df in (odd, extra, docs):
        got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.licenses(df).collect())
        assert got == Counter((r.doc_id, *slow_licenses(r.text)) for r in df.select("doc_id", "text").collect())
    assert licenses.licenses(odd.where("false")).count() == 0
    assert len(licenses.rules()) >= 200


def spellings(pattern):
    """Some strings that a rule's regex matches: every option taken and left out, every alternative."""
    import re

    m = re.search(r"\(\?:([^()]*)\)(\??)|\[(\w+)\]|(.)\?", pattern)
    if not m:
        return {pattern}
    options = m[1].split("|") if m[1] is not None else list(m[3]) if m[3] else [m[4]]
    options += [""] if m[2] or m[4] else []
    return {x for o in options for x in spellings(pattern[: m.start()] + o + pattern[m.end() :])}


def test_every_spelling_of_a_rule_holds_a_keyword():
    for r in licenses.rules():
        for x in spellings(r["pattern"].removesuffix("(?= )").replace("[1-4] [05]", "4 0")):
            assert set(x.split()) & set(r["keywords"]), (r, x)


def test_licenses_of_a_long_list(spark):
    n = 8000
    df = spark.createDataFrame([(1, "MIT License, all rights reserved. GNU GPL v2 " * n)], "doc_id long, text string")
    r = licenses.licenses(df).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.labels, r.n_detections) == (8 * n, n, 0, 8 * n - 8, "gpl,mit,proprietary", 3 * n)


# 10


def test_embedding_near_duplicates(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 12))
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    rows += [(300 + i, (x[0] + 0.1 * rng.normal(size=12)).tolist(), 0) for i in range(120)]  # a dense group
    rows += [(500 + i, x[1].tolist(), 1) for i in range(20)] + [(530, (3 * x[1]).tolist(), 0), (531, x[1].tolist(), None), (532, None, 1), (533, [0.0] * 12, 1), (534, [float("inf")] * 12, 1), (535, [None] * 12, 1), (0, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    uniq = {}
    for i, v, lab in rows:
        ok = v is not None and lab is not None and None not in v and np.isfinite(v).all() and any(v)
        uniq[i] = (np.array(v) / np.linalg.norm(v), lab) if ok else None
    n, root = Counter(), {i: i for i in uniq}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in uniq if uniq[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if uniq[a][1] == uniq[b][1] and uniq[a][0] @ uniq[b][0] >= 0.93:
                n[a] += 1
                n[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    for shard in (6144, 64):
        got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(df, 0.93, shard).collect()}
        want = {(i, n[i], find(i), find(i) == i) for i in uniq}
        assert got == want
    assert hnsw.near_duplicates(df.where("false")).count() == 0
    assert hnsw.near_duplicates(df, 0.93, 64).agg(F.min("audit_recall")).first()[0] >= 0.99


def test_audits_wait_for_vectors_with_links(monkeypatch):
    """Two isolated pairs among many vectors without links are found, at one shard and between two."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 16))
    x[700], x[850] = x[3] + 0.01, x[400] - 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    who, truth = hnsw.audited(x, None, 0.98)
    assert sorted(who.tolist()) == [3, 400, 700, 850] and truth.sum() == 4
    n, group, reached = hnsw.linked(x, None, 0.98, np.ones(900))
    assert reached == 1.0 and n.sum() == 4 and group[3] == group[700] and group[400] == group[850]
    graphs = [hnsw.Hnsw.from_bytes(hnsw.Hnsw(p).to_bytes(), p) for p in (x[:450], x[450:])]
    n, group, reached = hnsw.linked(x[:450], x[450:], 0.98, np.ones(450), np.ones(450), graphs)
    assert reached == 1.0 and n.sum() == 4 and group[3] == group[700] and group[400] == group[850]


def test_language_reads_long_words_to_their_end():
    rows = [("abab abab bab", "aa"), ("xyxy xyxy yxy", "xx")] * 3
    model = langid.fit_texts(rows)
    assert model.predict(["ab" * 25 + "xy" * 100, "xy" * 25 + "ab" * 100]) == [("xx", 1.0), ("aa", 1.0)]
