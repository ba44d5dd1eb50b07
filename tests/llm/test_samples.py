"""Repeated rows don't fill the samples that models are fitted on."""

from pyspark.sql import functions as F

from sparkloom.llm import langid, toxicity


def test_one_text_repeated_leaves_its_language_known(spark):
    xx = [(i, f"ovu tamo srdce {i} hladno vodje", "xx") for i in range(50)]
    yy = [(1000 + i, f"the quick house {i} with water", "yy") for i in range(200)]
    df = spark.createDataFrame(xx + yy, "doc_id long, text string, lang string")
    hot = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("ovu tamo srdce 7 hladno vodje").alias("text"), F.lit("xx").alias("lang"))
    for docs in (df, df.unionByName(hot)):
        rows = langid.sample(docs, 100, 4000).groupBy("lang").count().collect()
        assert {r["lang"]: r["count"] for r in rows} == {"xx": 50, "yy": 100}
    m = langid.fit(df.unionByName(hot))
    assert m.languages == ["xx", "yy"] and [x for x, _ in m.predict(["hladno tamo srdce", "quick water house"])] == ["xx", "yy"]


def test_repeated_documents_and_labels_do_not_fill_the_sample(spark):
    texts = [(i, f"plain words {i} here and there" if i % 4 else f"vile nasty {i} slur words") for i in range(200)]
    docs = spark.createDataFrame(texts + [texts[5]] * 5000, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 4 == 0)) for i in range(200)] + [(5, 1, 0)] * 5000, "doc_id long, quality int, toxic int")
    seen = []
    real = toxicity.fit_chain
    toxicity.fit_chain = lambda given, marks, *a, **k: seen.append((list(given), marks)) or real(seen[-1][0], marks, *a, **k)
    try:
        chain = toxicity.fit(docs, labels, toxicity.CATEGORIES, max_rows=100)
    finally:
        toxicity.fit_chain = real
    given, marks = seen[0]
    assert len(given) == len(set(given)) >= 100 and 25 <= sum(marks["toxic"]) <= 60
    out = {r["doc_id"]: r["toxic"] for r in toxicity.score(docs.limit(200), chain).collect()}
    assert sum(out[i] == (i % 4 == 0) for i in range(200)) >= 198


def test_a_rare_label_is_in_the_sample(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 == 3, F.concat(F.lit("vile slur "), "id")).otherwise(F.concat(F.lit("plain words "), "id")).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 1000 == 3).cast("int").alias("toxic"))
    chain = toxicity.fit(docs, labels, toxicity.CATEGORIES, max_rows=200)
    got = toxicity.score(docs, chain, threshold=0.1).where("toxic").select("doc_id").collect()
    assert sorted(r[0] for r in got) == [1000 * k + 3 for k in range(20)]
