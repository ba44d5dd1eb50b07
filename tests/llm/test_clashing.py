"""Columns with the operators' own names, and rows without an id, change nothing."""

from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import ann, bpe, counts, hnsw, langid, licenses, packing, sharding, simhash, toxicity

NAMES = [
    "__text", "__raw", "__slot", "__k", "__n", "__from", "__part", "__h", "__class", "fp", "key", "n", "b", "o", "s", "v", "d", "id", "cls", "k", "size", "digest", "component", "least", "length", "start", "salt",
    "piece", "ids", "n_words", "starts", "detections", "every", "runs", "sorted", "toxic", "p_toxic", "lang_pred", "score", "held_out", "virtual_slot", "shard", "rank", "weight", "shards", "graph", "c0", "c1", "a.b",
]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "the house and the tree", "The house AND the tree", "MIT License", "das haus und der baum ist alt", "vile words here", "x " * 400]
    rows = [(i, t, "en" if i % 2 else "de", None, i) for i, t in enumerate(texts)] + [(None, "no id at all", "en", "s", 1), (None, None, None, None, None), (2, texts[2], "de", None, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i == 6)) for i in range(8)], "doc_id long, quality int, toxic int")


def widened(df):
    return df.withColumns({n: F.lit(f"own {i}") for i, n in enumerate(NAMES)})


@pytest.mark.parametrize("name", ["bpe", "counts", "sharding", "packing", "toxicity", "simhash", "language", "licenses"])
def test_documents(spark, docs, labels, name):
    run = {
        "bpe": lambda d: bpe.digest(d, P.path("byte_bpe_50k.json")), "counts": lambda d: counts.token_counts(d, P.path("byte_bpe_50k.json")), "sharding": lambda d: sharding.sharded(d, 3, 16),
        "packing": lambda d: packing.packed(d, P.path("word_bpe_49k.json")), "toxicity": lambda d: toxicity.toxicity(d, labels), "simhash": simhash.components, "language": langid.identified, "licenses": licenses.licenses,
    }[name]
    plain, wide = (Counter(map(tuple, run(d).collect())) for d in (docs, widened(docs)))
    if name == "packing":  # which of equal rows comes first is free
        plain, wide = (Counter((r[0], r[1], r[2], r[3], r[4]) for r in c.elements()) for c in (plain, wide))
    assert plain == wide
    if name != "packing":
        assert sum(plain.values()) == docs.count() and sum(n for r, n in plain.items() if r[0] is None) == 2


def test_other_columns_pass_through(docs, labels):
    wide = widened(docs)
    kept = bpe.bpe_decode(bpe.bpe_encode(wide.drop("ids"), P.path("byte_bpe_50k.json")), P.path("byte_bpe_50k.json"))
    assert {"a.b", "__text", "c0", "doc_id"} <= set(kept.columns) and kept.where("decoded = 'MIT License' and `a.b` like 'own %' and c0 like 'own %'").count() == 1


def test_vectors(spark):
    rows = [(i, [1.0, i / 50, 0.5], i % 2) for i in range(60)] + [(None, [1.0, 0.0, 0.5], 0), (60, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for run in (ann.nearest, hnsw.near_duplicates):
        assert Counter(map(tuple, run(df).collect())) == Counter(map(tuple, run(widened(df)).collect()))
