"""The pipeline's stages against brute force and on awkward rows."""

import corpus_pipeline as pipeline
from sparkloom.llm import langid, toxicity

from .test_near import slow_groups
from .test_operators import ODD


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    (_, lang), (_, tox), (_, near), (_, pack) = pipeline.STAGES
    a = lang(spark, docs, sf)
    want = {r.doc_id for r in langid.identified(docs).collect() if r.lang_pred != "und" and r.score >= pipeline.LEAST_SHARE}
    assert a.columns == docs.columns and {r.doc_id for r in a.collect()} == want
    b = tox(spark, a, sf)
    bad = {r.doc_id for r in toxicity.toxicity(a, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.toxic}
    assert b.columns == docs.columns and {r.doc_id for r in b.collect()} == want - bad
    c = near(spark, b, sf)
    rows = sorted((r.doc_id, r.text) for r in b.collect())
    firsts = {rows[k][0] for k in slow_groups([t for _, t in rows])}
    assert c.columns == docs.columns and sorted(r.doc_id for r in c.collect()) == sorted(firsts)
    d = pack(spark, c, sf)
    assert {r.doc_id for r in d.select("doc_id").distinct().collect()} == firsts
    assert pipeline.run(spark, sf).count() == d.count()


def test_awkward_rows(spark, sf):
    rows = [(i, t, None, None, None) for i, t in enumerate(ODD)] + [(3, "a", None, None, None), (None, "null id", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.where("false")):
        for _, stage in pipeline.STAGES:
            d = stage(spark, d, sf)
            d.count()
    once = pipeline.near_copies(spark, docs, sf)
    assert once.where("doc_id = 3").count() == 1 and once.where("text is null or trim(text) = ''").count() == 1


def test_columns_with_the_stages_own_names_pass_through(spark, sf):
    names = ["__lang", "__share", "__text", "__toxic", "__p_toxic", "__class", "__turn", "__k", "class", "a.b"]
    texts = [f"the house and the tree stand here as number {i} of the houses and trees" for i in range(6)] + [None, "the house"]
    rows = [(i, t, "en", None, None, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns[5:] == names and all([r[f"{n}"] for n in names] == [f"{n}{r.doc_id}" for n in names] for r in docs.collect())
    assert {r.doc_id for r in docs.collect()} >= {7} and docs.where("text is null").isEmpty()
    assert pipeline.pack(spark, docs, sf).count() > 0


def test_documents_of_no_learned_language_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    by = {r.lang: r.text for r in docs.where("length(text) > 400").select("lang", "text").collect()}
    even = " ".join(" ".join(t.split()[:12]) for t in by.values())
    more = [(10**9, "\u65e5\u672c\u8a9e \u30c6\u30b9\u30c8 " * 20), (10**9 + 1, even), (10**9 + 2, by["en"]), (10**9 + 3, "12 34 !!")]
    out = pipeline.language(spark, docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True), sf)
    assert sorted(r.doc_id for r in out.where("doc_id >= 1000000000").collect()) == [10**9 + 2]
    assert out.where("doc_id < 1000000000").count() == docs.count()
