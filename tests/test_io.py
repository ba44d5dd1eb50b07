import io
import sqlite3
import zipfile

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkloom.plans.errors import ParameterError
from sparkloom.sources import bundles, readers, writers
from sparkloom.streaming import incremental


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("id;amount\n007;1.5\n008;2\n", encoding="utf-8-sig")
    df = readers.read_csv(spark, str(p), ";", all_text=True)
    assert df.columns == ["id", "amount"] and [r.id for r in df.collect()] == ["007", "008"]
    assert dict(readers.read_csv(spark, str(p), ";").dtypes)["amount"] == "double"
    (tmp_path / "b.csv").write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="at byte 8 has 3 fields, not 2"):
        readers.read_csv(spark, str(tmp_path / "b.csv")).collect()
    (tmp_path / "c.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ParameterError):
        readers.read_csv(spark, str(tmp_path / "c.csv"))


def test_json(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"a":1}\n{"a":2}\n')
    (tmp_path / "a.json").write_text('[{"a":1},{"a":2}]')
    assert readers.read_table(spark, str(tmp_path / "a.ndjson")).count() == readers.read_table(spark, str(tmp_path / "a.json")).count() == 2


def test_databases(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "x.db")
    con.execute("create table sales(amount real)")
    con.execute("create table accounts(id integer, name text)")
    con.executemany("insert into accounts values (?, ?)", [(i, f"n{i}") for i in range(50)])
    con.commit()
    con.close()
    assert readers.list_tables(str(tmp_path / "x.db")) == ["accounts", "sales"]
    assert readers.read_database(spark, str(tmp_path / "x.db")).count() == 50 and readers.read_database(spark, str(tmp_path / "x.db"), "sales").count() == 0
    with pytest.raises(ParameterError):
        readers.read_database(spark, str(tmp_path / "x.db"), "nope")
    d = duckdb.connect(str(tmp_path / "y.duckdb"))
    d.execute("create table t as select range::bigint as a from range(5)")
    d.close()
    assert readers.read_table(spark, str(tmp_path / "y.duckdb")).agg({"a": "sum"}).first()[0] == 10


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, s string")
    for fmt in ("csv", "tsv", "jsonl", "parquet", "json", "sqlite", "duckdb"):
        path = str(tmp_path / f"out.{fmt}")
        writers.export(df, path, fmt)
        assert readers.read_table(spark, path, fmt).count() == 2
        with pytest.raises((ParameterError, PySparkException)):
            writers.export(df, path, fmt)


def test_zip(spark, tmp_path):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, c in (("a.txt", "hi"), ("../x.txt", "no"), ("e.txt", "")):
            z.writestr(n, c)
    (tmp_path / "f.zip").write_bytes(b.getvalue())
    (tmp_path / "g.zip").write_bytes(b"junk")
    out = readers.expand_zip(readers.binary_assets(spark, str(tmp_path), "*.zip")).collect()
    assert sorted((r.entry or "", r.skipped or "") for r in out) == [("", "broken"), ("../x.txt", "traversal"), ("a.txt", ""), ("e.txt", "empty")]


def test_files_and_manifest(spark):
    f = spark.createDataFrame([(0, "a/x.parquet", "s", 5), (1, "a/y.csv", "t", 5), (2, "b/z.parquet", "u", 50)], "position long, path string, sha256 string, size long")
    assert [r.path for r in readers.filter_files(f, ["*.parquet"], ["b/*"]).collect()] == ["a/x.parquet"]
    m = readers.manifest_hash(f, "v1", {}).first()[0]
    assert m == readers.manifest_hash(f.orderBy("path"), "v1", {}).first()[0] != readers.manifest_hash(f, "v2", {}).first()[0]


def test_rag_bundle_is_complete(spark, tmp_path):
    c = spark.createDataFrame([("c1", "a1")], "chunk_id string, asset_id string")
    docs, idx = spark.createDataFrame([("a1", "active"), ("a2", "active")], "asset_id string, state string"), spark.createDataFrame([("a1",)], "asset_id string")
    with pytest.raises(ParameterError):
        writers.export_rag(c, c, docs, idx, str(tmp_path / "r"))
    writers.export_rag(c, c, docs.where("asset_id = 'a1'"), idx, str(tmp_path / "r"))


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(10).selectExpr("id", "cast(id * 10 as double) v").write.parquet(src)
    df = incremental.incoming(spark, src, spark.read.parquet(src).schema)
    q = incremental.sink(df, str(tmp_path / "out"), str(tmp_path / "cp"), [{"rule": "maximum", "column": "v", "value": 50}], str(tmp_path / "bad"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6 and spark.read.parquet(str(tmp_path / "bad")).count() == 4


def test_file_blocks(spark, tmp_path):
    from sparkloom.operators import documents

    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{ns}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "b.md").write_text("# One\npara a\n\npara b\n")
    (tmp_path / "c.html").write_text("<h2>H</h2><p>x</p>")
    (tmp_path / "d.docx").write_bytes(b"junk")
    out = documents.file_blocks(readers.binary_assets(spark, str(tmp_path))).collect()
    name = lambda r: r.path.rsplit("/", 1)[-1]
    assert sorted((name(r), r.block, r.kind, r.text, r.heading) for r in out if not r.error) == [
        ("a.docx", 0, "heading", "Top", "Top"), ("a.docx", 1, "paragraph", "Text", "Top"), ("b.md", 0, "heading_1", "One", "One"), ("b.md", 1, "paragraph", "para a", "One"),
        ("b.md", 2, "paragraph", "para b", "One"), ("c.html", 0, "heading_2", "H", "H"), ("c.html", 1, "p", "x", "H"),
    ]
    assert [name(r) for r in out if r.error] == ["d.docx"]


def test_bundles_replay_and_refuse_changes(spark, tmp_path):
    from sparkloom.plans import recipe as recipes
    from sparkloom.plans.errors import ParameterError
    from sparkloom.sources import bundles

    df = spark.createDataFrame([(1, "a", 2.5), (2, "b", None), (2, "b", None)], "n long, s string, x double")
    other = spark.createDataFrame([("a", 7)], "s string, y long")
    steps = recipes.compile_script('data = drop_duplicates(data)\ndata = filter(data, column="n", op="greater", value=0)')
    manifest = bundles.write_bundle(str(tmp_path / "b"), df, steps, {"other": other})
    assert set(manifest["digests"]) == {"input", "output", "datasets/other"}
    assert sorted(map(tuple, bundles.replay_bundle(spark, str(tmp_path / "b")).collect())) == [(1, "a", 2.5), (2, "b", None)]
    assert bundles.content_digest(df) == bundles.content_digest(df.orderBy("s", ascending=False)) != bundles.content_digest(df.distinct())
    df.limit(1).write.mode("append").parquet(str(tmp_path / "b/input"))
    with pytest.raises(ParameterError, match="input was changed"):
        bundles.replay_bundle(spark, str(tmp_path / "b"))


def test_normalised_imports_are_made_once(spark, tmp_path):
    from sparkloom.sources import bundles

    src = tmp_path / "t.csv"
    src.write_text("a,b\n1,x\n2,y\n")
    got, key = bundles.normalised(spark, str(src), str(tmp_path / "store"), "digest-1")
    assert sorted(map(tuple, got.collect())) == [(1, "x"), (2, "y")]
    src.write_text("a,b\n9,z\n")
    assert bundles.normalised(spark, str(src), str(tmp_path / "store"), "digest-1")[0].count() == 2
    again, other = bundles.normalised(spark, str(src), str(tmp_path / "store"), "digest-2")
    assert again.count() == 1 and other != key


def test_filtered_export_and_examples(spark, tmp_path):
    from sparkloom.plans.errors import ParameterError
    from sparkloom.sources import bundles

    df = spark.range(50).selectExpr("id", "id % 5 k")
    bundles.export_query(df, str(tmp_path / "out"), "parquet", [{"column": "k", "op": "eq", "value": 2}], columns=["id"])
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(2, 50, 5))
    with pytest.raises(ParameterError):
        bundles.export_query(df, str(tmp_path / "no"), "parquet", most=10)
    assert [r.id for r in bundles.contract_examples(df.where("k = 1"), ["id"], 3).collect()] == [1, 6, 11]


def test_models_are_checked_and_stored_by_content(spark, tmp_path):
    from sparkloom.operators import documents
    from sparkloom.plans.errors import ParameterError
    from sparkloom.sources import bundles

    df = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr")], "id long, text string, l string")
    fitted = documents.bayes_fit(df, "l", documents.tfidf_vocabulary(df))
    model = bundles.bayes_model(fitted)
    key = bundles.archive_model(spark, model, str(tmp_path))
    assert bundles.archive_model(spark, model, str(tmp_path)) == key and bundles.load_model(spark, str(tmp_path), key) == model
    got = documents.bayes_classify(df, bundles.bayes_frame(spark, model), "id")
    assert {r.id: r.label for r in got.collect()} == {1: "en", 2: "fr"}
    for bad in ({}, {"kind": "tfidf", "words": ["a"], "idf": [float("nan")]}, {"kind": "tfidf", "words": ["a", "a"], "idf": [1, 2]}, {"kind": "bayes", "words": ["a"], "labels": {"x": {"prior": 0.0, "log_p": []}}}):
        with pytest.raises(ParameterError):
            bundles.check_model(bad)


def test_plugins_declare_what_they_can():
    from sparkloom.plans.errors import ParameterError
    from sparkloom.plans.plugins import Plugin, Plugins

    class Planner:
        def plan(self, prompt):
            return {"topic": prompt}

    plugins = Plugins()
    plugins.register(Plugin("own-planner", "1.0.2", ">=1.2, <2", ("prompt_planner",), {"prompt_planner": Planner()}))
    assert plugins.providing("prompt_planner")[0][1].plan("x") == {"topic": "x"} and plugins.providing("exporter") == []
    bad = [("own-planner", "1", ">=1", ("prompt_planner",)), ("Bad", "1", ">=1", ("prompt_planner",)), ("b2", "x", ">=1", ("prompt_planner",)), ("b3", "1", ">=2", ("prompt_planner",)), ("b4", "1", "~1", ("prompt_planner",)), ("b5", "1", ">=1", ()), ("b6", "1", ">=1", ("exporter",))]
    for name, version, api, capabilities in bad:
        with pytest.raises(ParameterError):
            plugins.register(Plugin(name, version, api, capabilities, {"prompt_planner": Planner(), "exporter": Planner()}))


def test_digests_of_tables(spark):
    """Sums of row digests: equal under any order and partitioning, other for a changed, repeated or removed row."""
    import hashlib

    from sparkloom.functions import digests

    df = spark.range(3000).selectExpr("id", "concat('row ', id) t", "if(id % 7 = 0, null, id / 3) x").repartition(5)
    own = bundles.content_digest(df)
    assert own == bundles.content_digest(df.repartition(13).orderBy("x")) == bundles.content_digest(df.coalesce(1))
    first = df.where("id = 5")
    others = [df.where("id <> 5"), df.unionByName(first), df.unionByName(first).unionByName(first), df.withColumn("t", F.when(F.col("id") == 5, "row").otherwise(F.col("t"))), df.withColumn("x", F.coalesce("x", F.lit(0.0))), df.drop("x"), df.where("false")]
    assert len({own, *[bundles.content_digest(o) for o in others]}) == 8
    texts = [f"text {i}" for i in range(500)] + ["text 1"] * 3
    got = digests.multiset_digest(spark.createDataFrame([(t, int(t[-1]) % 2) for t in texts], "t string, g int").repartition(7), F.sha2("t", 256), "x", ["g"]).collect()
    for r in got:
        mine = [t for t in texts if int(t[-1]) % 2 == r["g"]]
        total = sum(int(hashlib.sha256(t.encode()).hexdigest(), 16) for t in mine) % (1 << 256)
        assert (r["n"], r["digest"]) == (len(mine), hashlib.sha256(f"x/{len(mine)}/{total:064x}".encode()).hexdigest())
    none = digests.multiset_digest(df.where("false"), F.sha2("t", 256)).first()
    assert none["digest"] == hashlib.sha256(f"/0/{0:064x}".encode()).hexdigest()


def test_dataset_with_card_and_media(spark, tmp_path):
    samples = spark.createDataFrame([(i, f"s{i % 3}", "train" if i % 4 else "test") for i in range(40)], "id long, asset string, split string")
    media = spark.createDataFrame([(f"p{k}", f"s{k}", 10, "image/png") for k in range(3)], "path string, sha256 string, size long, media_type string")
    out = writers.export_dataset(samples, str(tmp_path / "d"), "Things", "cc0-1.0", media)
    assert {r["split"]: r["n"] for r in out.collect()} == {"train": 30, "test": 10}
    card = spark.read.text(str(tmp_path / "d" / "card"), wholetext=True).first()[0]
    assert "pretty_name: Things" in card and "  - name: test\n    num_examples: 10" in card and all(r["digest"] in card for r in out.collect())
    assert spark.read.parquet(str(tmp_path / "d" / "media")).count() == 3
    assert {r["split"]: r["digest"] for r in writers.dataset_manifest(samples.repartition(9)).collect()} == {r["split"]: r["digest"] for r in out.collect()}
    with pytest.raises(ParameterError):
        writers.export_dataset(samples, str(tmp_path / "e"), media=media.where("sha256 <> 's1'"))


def test_plugins_chosen_by_name(spark, tmp_path):
    from sparkloom.operators import acquisition, documents
    from sparkloom.plans.plugins import Plugin, Plugins

    class Own:
        def export(self, df, path):
            df.write.option("header", True).csv(path)

        def embed(self, chunks):
            return chunks.select("id", F.array(F.length("text").cast("double"), F.lit(1.0)).alias("vector"))

        def search(self, spark, query, limit, cursor):
            return spark.createDataFrame([(f"https://a.org/{query}/{i}", "image/png", "<b>t</b>", "d") for i in range(9)], "url string, mime string, title string, description string")

    plugins, own = Plugins(), Own()
    plugins.register(Plugin("own", "1.0", ">=1.0", ("exporter", "embedding_provider", "discovery_provider"), {c: own for c in ("exporter", "embedding_provider", "discovery_provider")}))
    df = spark.createDataFrame([(1, "ab"), (2, "c")], "id long, text string")
    writers.export(df, str(tmp_path / "x"), "own", plugins=plugins)
    assert spark.read.option("header", True).csv(str(tmp_path / "x")).count() == 2
    for bad in ({}, {"plugins": plugins}):
        with pytest.raises(ParameterError):
            writers.export(df, str(tmp_path / "y"), "other", **bad)
    assert {r.id: r.vector for r in documents.embedded_by(df, plugins.named("embedding_provider", "own"), "id", 2).collect()} == {1: [2.0, 1.0], 2: [1.0, 1.0]}
    with pytest.raises(Exception, match="no vector of 3"):
        documents.embedded_by(df, own, "id", 3).collect()
    found = acquisition.search_by(spark, plugins.named("discovery_provider", "own"), "fox", 4).collect()
    assert len(found) == 4 and all(r.title == "t" and r.canonical_url.startswith("https://a.org/fox/") for r in found)


def test_second_inputs_are_kept_by_content(spark, tmp_path):
    right = spark.createDataFrame([(1, "a")], "k long, v string")
    step = {"operation": "combine", "parameters": {"right": "r", "left_key": "k", "right_key": "k", "how": "left"}}
    first, kept = bundles.submitted([step], {"r": right}, str(tmp_path))
    again, _ = bundles.submitted([step], {"r": right}, str(tmp_path))
    other, _ = bundles.submitted([step], {"r": right.withColumn("v", F.lit("b"))}, str(tmp_path))
    assert first == again != other and list(kept) == [first[0]["parameters"]["right"]] and step["parameters"]["right"] == "r"
    with pytest.raises(ParameterError):
        bundles.submitted([step], {}, str(tmp_path))
