"""Missing values, ties, cardinality, parameters: cases that the driver tables don't hold."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkloom.functions import scalar
from sparkloom.operators import acquisition, aggregates, budgets, charts, cleaning, combine, documents, groups, media, pixels, predicates, prepare, quantiles, requests, reshape, versions
from sparkloom.plans import recipe
from sparkloom.plans.errors import ParameterError
from sparkloom.plans.registry import registry


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(1, 2.0, "a", " x,y "), (2, None, "b", ""), (3, float("nan"), None, None), (4, 8.0, "a", "z")], "id long, x double, c string, t string")


def test_nan_is_missing(table):
    assert rows(aggregates.null_counts(table)) == [("c", 1), ("id", 0), ("t", 1), ("x", 2)]
    assert cleaning.drop_missing(table, ["x"]).count() == 2
    assert [r.x for r in cleaning.fill_missing(table, ["x"], "mean").orderBy("id").collect()] == [2.0, 5.0, 5.0, 8.0]


def test_sum_of_nothing_is_zero(table):
    assert rows(aggregates.aggregate(table, ["c"], ["x"], "sum")) == [("a", 10.0), ("b", 0.0), (None, 0.0)]


def test_fills(table):
    assert [r.x for r in cleaning.fill_missing(table, ["x"], "forward", order=["id"]).orderBy("id").collect()] == [2.0, 2.0, 2.0, 8.0]
    assert [r.x for r in cleaning.fill_missing(table, ["x"], "backward", order=["id"]).orderBy("id").collect()] == [2.0, 8.0, 8.0, 8.0]
    assert [r.c for r in cleaning.fill_missing(table, ["c"], "mode").orderBy("id").collect()] == ["a", "b", "a", "a"]
    with pytest.raises(PySparkException):
        cleaning.fill_missing(table.where("false"), ["c"], "mode").union(cleaning.fill_missing(table.where("c = 'q' or id = 3"), ["c"], "mode")).collect()


@pytest.mark.parametrize("partition", [[], ["g"]])
def test_backward_fills_take_one_pass(spark, partition):
    """A frame that reaches to the end of its partition costs the square of its rows."""
    d = spark.createDataFrame([(None, 0, 1, None), (None, 1, 1, 5.0), (1, 0, 2, None), (1, 1, 1, None), (2, 0, 1, 7.0), (3, 0, 2, None)], "a int, b int, g int, x double")
    out = cleaning.fill_missing(d, ["x"], "backward", order=["a", "b"], partition=partition)
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    found = [r.x for r in out.orderBy(F.col("a").asc_nulls_first(), "b").collect()]
    assert found == ([5.0, 5.0, None, 7.0, 7.0, None] if partition else [5.0, 5.0, 7.0, 7.0, 7.0, None])


def test_dialects_differ(table):
    assert predicates.query_table(table, [{"column": "c", "op": "contains", "value": "A"}])[1].first()[0] == 2
    assert predicates.lab_filter(table, "c", "contains", "A").count() == 0
    assert predicates.conditions(table, [], "all").count() == 4 and predicates.conditions(table, [], "any").count() == 0
    assert predicates.browse(table, ["id"], match="any").count() == 4
    assert predicates.lab_filter(table, "c", "not_equal", "a").count() == 1
    with pytest.raises(ParameterError):
        predicates.conditions(table, [{"column": "c", "op": "regex", "value": "(?=a)"}])


def test_explode_and_melt(table):
    assert rows(reshape.explode(table.select("id", "t"), "t", ",")) == [(1, " x"), (1, "y "), (2, ""), (3, None), (4, "z")]
    assert reshape.melt(table, ["id"], ["x", "c"]).count() == 8


def test_join_cardinality(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k long, v string")
    right = spark.createDataFrame([(1, "x"), (None, "y"), (4, "z")], "k long, v string")
    out = combine.combine(left, right, "k", "k", "outer")
    assert out.columns == ["k", "v", "v_right"] and rows(out) == [(1, "a", "x"), (3, "c", None), (4, None, "z"), (None, "b", "y")]
    with pytest.raises(PySparkException):
        combine.combine(left, right.union(right), "k", "k", "lookup").collect()
    assert combine.combine(left, right.union(right), "k", "k", "left", "many_to_many").count() == 5


def test_arithmetic(spark):
    df = spark.createDataFrame([(7.0, -3.0), (1.0, 0.0), (0.0, 0.0)], "a double, b double")
    assert [r.y for r in cleaning.derive(df, "y", "a / b").collect()] == [-7 / 3, float("inf"), None]
    assert cleaning.derive(df, "y", "a % b").first().y == -2.0
    for bad in ("a ** 2", "__import__('os')", "a.b", "a[0]", "q + 1", "a +"):
        with pytest.raises(ParameterError):
            cleaning.derive(df, "y", bad)


def test_nested_duplicates(spark):
    df = spark.createDataFrame([(1, ["a"], {"x": 1}), (2, ["a"], {"x": 1}), (3, ["b"], {"x": 2})], "id long, tags array<string>, meta map<string,int>")
    assert [r.id for r in cleaning.drop_duplicates(df, ["tags", "meta"], ["id"]).orderBy("id").collect()] == [1, 3]


def test_positions(table):
    assert [r.id for r in cleaning.exclude(table, [0, 2], ["id"]).orderBy("id").collect()] == [2, 4]
    with pytest.raises(PySparkException):
        cleaning.exclude(table, [4], ["id"]).collect()
    assert cleaning.exclude(table.where("false"), [], ["id"]).count() == 0


def test_preprocess_fits_on_train_alone(spark):
    df = spark.createDataFrame([(0.0, "a", "train"), (2.0, "b", "train"), (1000.0, "c", "test"), (None, None, "train")], "n double, cat string, _split string")
    out = prepare.preprocess(df, ["n"], ["cat"], "minmax")
    assert out.columns == ["n", "_split", "n_missing", "cat_a", "cat_b"]
    assert sorted(r.n for r in out.collect()) == [0.0, 0.5, 1.0, 500.0]


def test_split_properties(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 7)
    s = prepare.split(df, "random", "id", 0.7, 0.2)
    assert {r[0]: r[1] for r in s.groupBy("_split").count().collect()} == {"train": 70, "validation": 19, "test": 11}  # int(100 * (0.7 + 0.2)) is 89
    assert prepare.split(df, "group", "id", 0.6, 0.2, by="g").groupBy("g").agg(F.count_distinct("_split").alias("n")).where("n > 1").count() == 0
    assert prepare.largest_remainder(10, [1, 1, 1]) == [4, 3, 3]
    assert balanced_groups([("a", 6), ("b", 3), ("c", 1)], {"train": 0.6, "test": 0.4}) == {"a": "train", "b": "test", "c": "test"}


@pytest.mark.parametrize("kind", charts.KINDS)
def test_charts(spark, kind):
    df = spark.range(40).selectExpr("cast(id as double) x", "cast(id * id as double) y", "id % 4 g", "if(id < 30, 'train', 'test') _split", "id")
    args = {"pair": {}, "missingness": {}}.get(kind, {"x": "g" if kind in ("bar", "grouped", "stacked", "error") else "x", "y": "y", "group": "_split" if kind in ("grouped", "stacked") else None})
    assert registry.apply(df, "chart", {"kind": kind, "order": ["id"], **{k: v for k, v in args.items() if v}}).count() > 0 or kind == "outlier"


def test_findings(spark):
    df = spark.createDataFrame([(i, 2.0 * i, "a" if i else "b", "k") for i in range(200)] + [(0, 0.0, "b", "k")], "a long, b double, c string, d string")
    got = {(r.finding, r.column) for r in aggregates.findings(df).collect()}
    assert {("constant", "d"), ("correlated", "a, b"), ("imbalanced", "c"), ("high_cardinality", "a"), ("duplicate_rows", None)} <= got


def test_license_truth_table(spark):
    cases = [("CC BY 4.0", "CC BY", True), ("CC BY-NC 4.0", "CC BY", False), ("CC BY-SA", "CC BY", False), ("CC BY 3.0", "CC BY 4.0", False), ("cc0 1.0", "CC0", True), ("Creative Commons BY-SA 4.0", "cc-by-sa", True), ("MIT", "mit", True), (None, "CC BY", False)]
    for actual, allowed, expected in cases:
        d = scalar.with_licence(spark.range(1).select(F.lit(actual).cast("string").alias("name")), "name", "parts")
        assert d.select(scalar.license_among("parts", [allowed])).first()[0] is expected, (actual, allowed)


def test_urls(spark):
    cases = {"HTTP://Example.COM:80/a?b#c": "http://example.com/a?b", "https://x.org.": "https://x.org/", "https://u:p@x.org/": None, "nope": None, "https://x.org:8443/p": "https://x.org:8443/p"}
    for raw, want in cases.items():
        assert spark.range(1).select(scalar.canonical_url(F.lit(raw))).first()[0] == want


def test_diff(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "id long, l string, v double")
    b = spark.createDataFrame([(2, "z", 2.0), (3, "x", 1.0)], "id long, l string, v double")
    assert rows(versions.keyed_diff(a, b, "id", "l")) == [("*", "added", 1), ("*", "changed", 1), ("*", "removed", 1), ("l", "label", 1), ("v", "feature", 0)]
    assert rows(versions.multiset_diff(a, b)) == [("added", 2), ("removed", 2)]


def test_perceptual_groups(spark):
    df = spark.createDataFrame([(1, "0000000000000000"), (2, "0000000000000003"), (3, "000000000000000f"), (4, "ffffffffffffffff"), (5, None), (6, "0000000000000000")], "id long, h string")
    assert rows(groups.perceptual_groups(df, "id", "h", 2)) == [(1, 1, 4, 2), (2, 1, 4, 2), (3, 1, 4, 2), (6, 1, 4, 2)]
    assert groups.perceptual_groups(df.where("false"), "id", "h", 2).count() == 0


def test_cascade(spark):
    df = spark.createDataFrame(
        [(1, "https://a.org/1", "CC BY 4.0", 10, 10, True, "image/png", 50, 50, "s1", 90.0, None, "red fox", 60, 60), (2, "https://b.org/1", "CC BY 4.0", 10, 10, True, "image/png", 50, 50, "s2", 90.0, None, "red fox", 60, 60), (3, "https://a.org/2", "CC BY 4.0", 10, 10, True, "image/png", 50, 50, "s1", 90.0, None, "red fox", 60, 60), (4, "https://a.org/3", "CC BY 4.0", 10, 10, True, "image/png", 50, 50, "s4", 90.0, None, "blue sky", 60, 60), (5, "https://a.org/4", "CC BY 4.0", 10, 95, True, "image/png", 50, 50, "s5", 90.0, None, "red fox", 60, 60)],
        "candidate_id long, url string, license string, declared_bytes long, bytes long, decoded boolean, mime string, width int, height int, sha256 string, quality double, phash string, text string, declared_width int, declared_height int",
    )
    out = acquisition.cascade(df, acquisition.Spec(licenses=["CC BY"], domains=["a.org"], keywords=["red", "fox"], storage_budget=100))
    assert {r.candidate_id: (r.state, r.reason) for r in out.collect()} == {1: ("accepted", None), 2: ("rejected", "domain_not_allowed"), 3: ("rejected", "exact_duplicate"), 4: ("rejected", "not_relevant"), 5: ("rejected", "storage_budget")}
    assert acquisition.estimates(75, 1000) == (100, 167) and acquisition.trial(100, 10) == (10, 30)


def slow_cascade(rows, spec, known, near):
    """The checks, one candidate after another, with what was downloaded and stored so far."""
    loaded = stored = 0
    held, out = set(known), {}
    for r in sorted(rows, key=lambda r: r["candidate_id"]):
        i, size = r["candidate_id"], r["bytes"]
        if r["license"] != "CC BY 4.0":
            out[i] = "rejected", "license_not_allowed"
        elif r["url"].split("/")[2] != "a.org":
            out[i] = "rejected", "domain_not_allowed"
        elif 0 < (r["declared_width"] or 0) < spec.min_width:
            out[i] = "rejected", "declared_size"
        elif loaded >= spec.byte_budget:
            out[i] = "rejected", "byte_budget"
        elif size > spec.byte_budget - loaded:
            out[i] = "failed", None
        else:
            loaded += size
            late = {
                "decode_failed": not r["decoded"], "mime_not_allowed": not (r["mime"] or "").startswith("image/"), "too_small": (r["width"] or 0) < spec.min_width,
                "exact_duplicate": r["sha256"] in held, "low_quality": (r["quality"] or 0) < spec.min_quality, "near_duplicate": r["phash"] in near, "storage_budget": stored + size > spec.storage_budget,
            }
            reason = next((k for k, bad in late.items() if bad), None)
            if reason is None:
                stored += size
                held |= {r["sha256"]} - {None}
                if "red" not in r["text"]:
                    reason = "not_relevant"
            out[i] = "rejected" if reason else "accepted", reason
    return out


def test_cascade_like_one_candidate_after_another(spark, monkeypatch):
    import random

    monkeypatch.setattr(budgets, "BLOCK", 10)
    rnd = random.Random(7)
    kind = "candidate_id long, url string, license string, declared_width int, declared_height int, bytes long, decoded boolean, mime string, width int, height int, sha256 string, quality double, phash string, text string"
    pick = lambda *xs: rnd.choice(xs)
    content = {}
    rows = []
    for i in range(900):
        sha = pick(None, *[f"s{k}" for k in range(150)])
        body = content.setdefault(sha or i, (pick(*range(1, 60), 400), rnd.random() > 0.1, pick("image/png", "image/gif", "text/html", None) if rnd.random() < 0.3 else "image/png", pick(5, 50, 50, 50, None), pick(None, 1.0, 90.0, 90.0, 90.0), pick("p1", "p2", "p3", "p4", None)))
        size, decoded, mime, width, quality, phash = body
        rows.append((i, pick("https://a.org/x", "https://a.org/x", "https://b.org/x"), pick("CC BY 4.0", "CC BY 4.0", "none"), pick(None, 0, 5, 100, 100), 60, size, decoded, mime, width, 60, sha, quality, phash, pick("red fox", "red fox", "blue")))
    names = [c.split()[0] for c in kind.split(", ")]
    spec = acquisition.Spec(licenses=["CC BY"], domains=["a.org"], min_width=10, byte_budget=9000, storage_budget=600, keywords=["red"])
    known, near = spark.createDataFrame([("s1",), ("s2",)], "sha256 string"), spark.createDataFrame([("p1",)], "phash string")
    df = spark.createDataFrame(rows, kind)
    got = {r.candidate_id: (r.state, r.reason) for r in acquisition.cascade(df, spec, known, near).collect()}
    want = slow_cascade([dict(zip(names, r, strict=True)) for r in rows], spec, {"s1", "s2"}, {"p1"})
    assert got == want and {r for _, r in want.values()} == {None, *acquisition.REASONS} and "failed" in {s for s, _ in want.values()}
    assert acquisition.cascade(df.where("false"), spec).count() == 0


def test_budget_by_size_classes(spark, monkeypatch):
    """As if rows were gone through one by one, over 1,000 blocks, with one row a round on the driver."""
    import math
    import random

    monkeypatch.setattr(budgets, "BLOCK", 10)
    kinds = {
        "ones that mostly exceed the budget": (lambda r: (r.randrange(1, 100_000),) * 2, 3000),
        "all alike": (lambda r: (7, 7), 20_000),
        "a few large, many small": (lambda r: (r.choice([1, 2, 3, 1 << 20]),) * 2, 5000),
        "by one less each": (lambda r, n=iter(range(100_000, 0, -1)): (next(n),) * 2, 99_500),
        "more needed than taken": (lambda r: (lambda n: (n, n // r.choice([1, 1, 2, 3])))(r.randrange(0, 64)), 2500),
        "nothing left": (lambda r: (r.randrange(0, 3),) * 2, 0),
    }
    for name, (make, budget) in kinds.items():
        rnd = random.Random(5)
        rows = [(i, *make(rnd)) for i in range(10_500)]
        rounds = []
        out = budgets.left_before(spark.createDataFrame(rows, "id long, need long, take long"), "take", budget, ["id"], "left", "need", lambda i, found, rounds=rounds: rounds.append(found))
        left, want = budget, {}
        for i, need, take in rows:
            want[i] = left
            left -= take if need <= left else 0
        assert {r["id"]: r["left"] for r in out.collect()} == want, name
        ratio = 4 if name.startswith("more") else 1
        assert len(rounds) <= ratio * 2 * (math.log2(budget + 2) + 2), (name, len(rounds))


def test_run_until_a_target(spark):
    kind = "candidate_id long, url string, license string, declared_width int, declared_height int, bytes long, decoded boolean, mime string, width int, height int, sha256 string, quality double, phash string, text string"
    rows = [(i, "https://a.org/x", "CC BY" if i % 3 else "none", 50, 50, 10, True, "image/png", 50, 50, f"s{i % 40}", 90.0, None, "red fox") for i in range(100)]
    asked = []

    def search(n):
        start = sum(asked)
        asked.append(min(n, len(rows) - start))
        return spark.createDataFrame(rows[start : start + n], kind) if start < len(rows) else None

    spec = acquisition.Spec(licenses=["CC BY"])
    judged, why = acquisition.run(spec, 20, 100, search)
    assert why == "completed" and judged.where("state = 'accepted'").count() >= 20
    asked.clear()
    judged, why = acquisition.run(spec, 90, 1000, search)
    assert why == "queries_exhausted" and judged.count() == 100 and len(asked) > 1
    want = acquisition.cascade(spark.createDataFrame(rows, kind), spec)
    assert {(r.candidate_id, r.state, r.reason) for r in judged.collect()} == {(r.candidate_id, r.state, r.reason) for r in want.collect()}
    asked.clear()
    assert acquisition.run(acquisition.Spec(licenses=["CC BY"], byte_budget=60), 90, 1000, search)[1] == "byte_budget"
    asked.clear()
    assert acquisition.run(spec, 90, 20, search)[1] == "candidate_budget"
    asked.clear()
    assert acquisition.run(spec, 90, 1000, search, trial_only=True)[1] == "planned_batch_done"


def test_requests():
    ask = requests.parse_request
    assert ask("Find 1,200 images of red foxes in snow, at least 800 px, cc-by only") == {"count": 1200, "min_width": 800, "min_height": 800, "licenses": ["cc-by"], "domains": [], "topic": "red foxes in snow"}
    assert ask("collect 30 lighthouses 640x480 from a.example.org")["count"] == 30 and ask("lighthouse pictures")["min_width"] == 512
    got = ask("20 photos of old lighthouses 640 x 480")
    assert (got["count"], got["min_width"], got["min_height"], ask("lighthouse pictures")["topic"]) == (20, 640, 480, "lighthouse")
    assert ask("I want at least 50 accepted photos of harbours at dusk from pics.example.com")["domains"] == ["pics.example.com"]
    assert (ask("50 usable images of old doors, min 300px")["min_height"], ask("download me 2,500 tulips")["count"], ask("7 tulips")["count"]) == (300, 2500, 100)
    assert ask("photos of red and green boats include 3 masts cc0 only") | {"count": 1} == {"count": 1, "min_width": 512, "min_height": 512, "licenses": ["cc0"], "domains": [], "topic": "red and green boats"}
    for bad in ("", "  ", "a csv of cars", "cars without people", "cars with a free license", "images in the public domain"):
        with pytest.raises(ParameterError):
            ask(bad)


def test_hash_and_blur():
    import math

    import numpy as np

    picture = np.random.default_rng(1).integers(0, 256, (32, 32))
    low = [[sum(picture[y, x] * math.cos((2 * x + 1) * u * math.pi / 64) * math.cos((2 * y + 1) * v * math.pi / 64) for y in range(32) for x in range(32)) for u in range(8)] for v in range(8)]
    flat = [c for row in low for c in row]
    middle = sorted(flat[1:])[31]
    assert media.perceptual_hash(picture) == f"{int(''.join(str(int(c >= middle)) for c in flat), 2):016x}"
    assert abs(media.blur_score(np.full((9, 9), 40)) - 40**2 * (32 / 81) * (49 / 81)) < 1e-9 and media.blur_score(np.zeros((2, 2))) == 0.0
    spot = np.zeros((5, 5), int)
    spot[2, 2] = 10
    assert media.blur_score(spot) == np.var([80] + [0] * 24)


def test_documents(spark):
    md = spark.createDataFrame([(1, "# One\n\n" + "A sentence here. " * 80 + "\n\n## Two\n\nShort."), (2, None), (3, "")], "id long, text string")
    for s in ("token", "paragraph", "heading", "recursive"):
        c = documents.chunks(md, "id", strategy=s, size=64, overlap=8)
        assert c.agg(F.max("n_tokens")).first()[0] <= 64 and {r.id for r in c.select("id").distinct().collect()} == {1}
    assert parse_html(spark, "<h1>T</h1><script>x</script><p>a  b</p>") == ("T", [("heading_1", "T", "T"), ("p", "a b", "T")])
    assert [r.kind for r in documents.markdown_blocks(md, "id").orderBy("block").collect()] == ["heading_1", "paragraph", "heading_2", "paragraph"]
    v = documents.hashed_vectors(md, "id", dims=64).collect()
    assert all(len(r.vector) == 64 for r in v)


@pytest.mark.parametrize("rows", [0, 1, 3000])
def test_hashed_features_are_not_shuffled(spark, rows):
    d = spark.range(rows).selectExpr("id", "concat('word ', id % 7, ' and ', id) as text")
    v = documents.hashed_vectors(d, "id", dims=1024)
    assert "Exchange" not in v._jdf.queryExecution().executedPlan().toString()
    assert v.where("size(vector) = 1024").select("id").distinct().count() == v.count() == rows


def parse_html(spark, html):
    """Title and blocks of a page; the title of one without blocks can't be seen."""
    rows = documents.html_blocks(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("block").collect()
    return (rows[0]["title"] if rows else "", [(r["kind"], r["text"], r["heading"]) for r in rows])


def test_html_that_is_not_tidy(spark):
    """Blocks that open in others, tags in scripts, entities, missing ends."""
    html = "<title>Own</title><h2>One</h2><p>a<b>b</b>c<p>d &amp; e</p><li>lost<td>kept<script></td><p>no</p></script> too</td><h1> </h1><blockquote>tail"
    assert parse_html(spark, html) == ("Own", [("heading_2", "One", "One"), ("p", "d & e", "One"), ("td", "kept too", "One")])
    assert parse_html(spark, "<p>x<i>y</i>z</p>") == ("", [("p", "x y z", "")])
    assert parse_html(spark, "<h3>First</h3><title></title>")[0] == "First" and parse_html(spark, None) == ("", [])
    assert parse_html(spark, "<P class='a'>1 &lt; 2 &#233;&#xe9; &eacute;&nope; &#0; & 3 < 4</P ><!-- <p>no</p> --><pre>a\n b</pre><param><style>p{}") == ("", [("p", "1 < 2 éé é&nope; \ufffd & 3 < 4", ""), ("pre", "a b", "")])
    two = spark.createDataFrame([(1, "<h1>A</h1><p>x</p>"), (1, "<p>y</p>"), (None, "<p>z</p>")], "page_id long, html string")
    assert sorted((r["text"], r["heading"], r["block"]) for r in documents.html_blocks(two).collect()) == [("A", "A", 0), ("x", "A", 1), ("y", "", 0), ("z", "", 0)]


def test_chunk_names_and_places(spark):
    import hashlib
    import json
    import uuid

    text = "# Top\n\none two three. four\n\n## Sub\n\nfive six seven. " + "eight nine ten. " * 40
    df = spark.createDataFrame([(7, text)], "id long, text string")
    for strategy in ("recursive", "token"):
        rows = documents.chunks(df, "id", strategy=strategy, size=32, overlap=4).orderBy("chunk").collect()
        blocks = [b.text for b in documents.text_blocks(text)]
        for r in rows:
            name = json.dumps(["7", hashlib.sha256(text.encode()).hexdigest(), {"chunk_size": 32, "overlap": 4, "strategy": strategy}, r.chunk, hashlib.sha256(r.text.encode()).hexdigest()], sort_keys=True)
            assert r.chunk_id == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
            assert len(r.text) == r.char_end - r.char_start and (strategy == "recursive" or "\n\n".join(blocks)[r.char_start : r.char_end] == r.text)
            assert 0 <= r.block_start <= r.block_end < len(blocks) and blocks[r.block_start].split()[0] if r.chunk else r.text.startswith("Top")


def test_chunks_by_hand():
    text = "# Top\n\none two\nthree. four\n\n## Sub\n\nfive six seven. eight nine ten eleven twelve"
    cut = documents.chunk_text
    assert documents.text_blocks(text) == [("Top", "Top"), ("Top", "one two three. four"), ("Sub", "Sub"), ("Sub", "five six seven. eight nine ten eleven twelve")]
    assert cut(text, "paragraph", 32, 0) == [("Top", 1, "Top"), ("Top", 5, "one two three. four"), ("Sub", 1, "Sub"), ("Sub", 9, "five six seven. eight nine ten eleven twelve")]
    assert cut(text, "heading", 32, 0) == [("Top", 6, "Top\n\none two three. four"), ("Sub", 10, "Sub\n\nfive six seven. eight nine ten eleven twelve")]
    assert cut(text, "token", 7, 2) == [("Top", 7, "Top\n\none two three. four\n\nSub"), ("Top", 7, "four\n\nSub\n\nfive six seven. eight"), ("Sub", 6, ". eight nine ten eleven twelve")]
    # recursive: blocks are packed up to 7 tokens; the long one is cut behind a sentence end in the window's second half
    assert cut(text, "recursive", 7, 1) == [
        ("Top", 7, "Top\n\none two three. four\n\nSub"), ("Sub", 7, "five six seven. eight nine ten"), ("Sub", 3, "ten eleven twelve"),
    ]
    assert cut("a b c d e. f g h i j k l", "recursive", 8, 2) == [("", 6, "a b c d e."), ("", 8, "e. f g h i j k"), ("", 3, "j k l")]
    assert cut("", "recursive", 8, 2) == cut(" \n", "token", 8, 2) == []


def test_assign_splits(spark):
    df = spark.range(100).selectExpr("id", "if(id < 70, 'a', if(id < 97, 'b', null)) label", "cast(id % 13 as string) g")
    shares = {"train": 0.7, "validation": 0.2, "test": 0.1}
    n = {(r.label, r.split): r["count"] for r in prepare.assign_splits(df, "id", shares, "stratified", "label").groupBy("label", "split").count().collect()}
    want = {(k, s): c for k, m in (("a", 70), ("b", 27), (None, 3)) for s, c in zip(shares, prepare.largest_remainder(m, list(shares.values())), strict=True) if c}
    assert n == want
    got = prepare.assign_splits(df, "id", shares, "random")
    assert got.exceptAll(prepare.assign_splits(df, "id", shares, "random")).isEmpty() and got.groupBy("split").count().where("split = 'train' and count = 70").count() == 1
    g = prepare.assign_splits(df, "id", shares, "group", "g")
    assert g.count() == 100 and g.groupBy("g").agg(F.count_distinct("split").alias("k")).where("k > 1").isEmpty()
    manual = spark.createDataFrame([(1, "test"), (2, "train")], "id long, split string")
    assert prepare.assign_splits(df, "id", {}, "manual", manual=manual).where("split is not null").count() == 2
    assert prepare.assign_splits(df.where("false"), "id", shares, "stratified", "label").count() == 0


def test_naive_bayes(spark):
    df = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "qq", None)], "id long, text string, l string")
    model = documents.bayes_fit(df, "l", documents.tfidf_vocabulary(df))
    assert {r.id: r.label for r in documents.bayes_classify(df, model, "id").collect()} == {1: "en", 2: "fr", 3: "und"}


def test_contract(spark):
    df = spark.createDataFrame([("1", "a"), ("x", "b"), (None, " "), ("9", "b")], "n string, c string")
    report, bad = aggregates.contract(df, [{"rule": "numeric", "column": "n"}, {"rule": "required", "column": "c"}, {"rule": "maximum", "column": "n", "value": 5}, {"rule": "unique", "column": "c"}])
    assert [r.failed for r in report.collect()] == [1, 1, 2, 2, 3] and bad.count() == 3


def test_recipes(spark, table, tmp_path):
    assert recipe.compile_script('data = filter(data, column="c", op="equals", value="a")') == [{"operation": "filter", "parameters": {"column": "c", "op": "equals", "value": "a"}}]
    for bad in ("import os", "data = nope(data)", "data = filter(data, column=open('x'))", "x = filter(data)"):
        with pytest.raises(ParameterError):
            recipe.compile_script(bad)
    store = recipe.VersionStore(spark, str(tmp_path / "t"))
    steps = recipe.bind([{"operation": "filter", "parameters": {"column": "c", "op": "equals", "value": "{{v:\"a\"}}"}}], {})
    assert store.commit(table, [], 0) == 1 and store.commit(recipe.run(store.load(), steps)[0], steps, 1) == 2
    with pytest.raises(ParameterError):
        store.commit(table, [], 1)
    assert rows(recipe.run(store.load(1), store.steps(2))[0]) == rows(store.load(2)) and store.load(2).count() == 2


def test_registry(table):
    assert registry.search("join")[0].id == "combine" and registry.search("the median of missing values")[0].id in ("fill_missing", "profile") and registry.search("plots of things")[0].id == "chart" and\
        [o.id for o in registry.search("", "prepare")] == sorted(o.id for o in registry.search("the", "prepare")) and not registry.search("zebra") and registry.search("normalizing columns")[0].id == "scale" and len(registry.ids()) >= 35
    with pytest.raises(ParameterError):
        registry.check(table, "rename", {"column": "nope", "new_name": "y"})


def test_media(spark):
    df = spark.createDataFrame([('{"format":{"duration":"2.5"},"streams":[{"codec_type":"video","width":4,"height":2},{"codec_type":"audio"}]}',)], "probe string")
    r = media.probe_rows(df).first()
    assert (r.kind, r.duration, r.width) == ("video", 2.5, 4)
    assert spark.range(1).select(F.size(media.segments(F.lit(2.5), 1.0))).first()[0] == 3


def test_operators_leave_their_input_alone(table):
    before = rows(table)
    for op, p in (("drop_missing", {}), ("fill_missing", {"columns": ["x"], "method": "median"}), ("scale", {"columns": ["x"]}), ("encode", {"columns": ["c"]}), ("clip", {"columns": ["x"]}), ("pivot", {"index": "id", "column": "c", "value": "x"}), ("ordinal", {"column": "c", "categories": ["a"]})):
        assert repr(rows(registry.apply(table, op, p))) == repr(rows(registry.apply(table, op, p)))
    assert repr(rows(table)) == repr(before)


def test_quantiles_by_group(spark, monkeypatch):
    """One group of nine tenths of the rows, ties, a missing group, groups without values; sketches of few steps."""
    import numpy as np

    rng = np.random.default_rng(4)
    by = ["hot"] * 27_000 + [None] * 1500 + ["flat"] * 900 + ["ties"] * 500 + ["one"] + ["none"] * 3 + ["ends"] * 4
    x = [*rng.normal(size=28_500), *[2.5] * 900, *rng.integers(0, 4, size=500), 7.0, None, float("nan"), None, float("-inf"), 1.0, 2.0, float("inf")]
    y = [*rng.exponential(size=len(by)).round(2)]
    df = spark.createDataFrame([(b, None if v is None else float(v), float(w)) for b, v, w in zip(by, x, y, strict=True)], "g string, x double, y double").repartition(5)
    at = [0.0, 0.003, 0.25, 0.5, 0.9, 1.0]
    for accuracy, hot in ((10_000, 1000), (200, 2)):
        monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
        monkeypatch.setattr(quantiles, "HOT", hot)
        got = {r["g"]: r for r in quantiles.grouped_quantiles(df, ["g"], {"a": F.col("x"), "b": F.col("y") * 2}, at).collect()}
        assert set(got) == set(by) and got["none"]["a"] is None and got["none"]["b"] is not None
        for g in set(by) - {"ends"}:
            for name, column in (("a", x), ("b", [2 * v for v in y])):
                own = [v for b, v in zip(by, column, strict=True) if b == g and v is not None and v == v]
                assert not own or np.allclose(got[g][name], np.quantile(np.array(own, float), at), rtol=0, atol=1e-9), (g, name)
        assert got["ends"]["a"][0] == float("-inf") and got["ends"]["a"][3] == 1.5 and got["ends"]["a"][5] == float("inf")
    assert quantiles.grouped_quantiles(df.where("false"), ["g"], {"a": F.col("x")}, at).count() == 0


def test_quantiles_of_many_values(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    at = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    columns = {"a": rng.normal(size=20000), "b": np.round(rng.exponential(size=20000), 1), "c": np.full(20000, 3.0)}
    rows = [(*map(float, v), None, float(i) if i < 3 else None) for i, v in enumerate(zip(*columns.values(), strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double, none double, few double")
    want = {k: np.quantile(v, at) for k, v in columns.items()} | {"few": np.quantile([0.0, 1.0, 2.0], at)}
    for ranked in (10, 10**6):
        monkeypatch.setattr(scalar, "RANKED", ranked)
        got = scalar.quantile_row(df, {c: F.col(c) for c in df.columns}, at).first()
        assert got["none"] is None and all(np.allclose(got[k], v, rtol=0, atol=1e-9) for k, v in want.items())


def slow_groups(rows, most):
    """(members, greatest distance of a link) by comparing all hashes."""
    hashes = sorted({h for _, h in rows if h})
    root = {h: h for h in hashes}

    def find(h):
        while root[h] != h:
            h = root[h]
        return h

    far = {}
    for i, a in enumerate(hashes):
        for b in hashes[i + 1 :]:
            d = (int(a, 16) ^ int(b, 16)).bit_count()
            if d <= most:
                far[a, b] = d
                root[max(find(a), find(b))] = min(find(a), find(b))
    out = {}
    for i, h in rows:
        if h:
            out.setdefault(find(h), ([], set()))[0].append(i)
    return {tuple(sorted(ids)): max([d for (a, _), d in far.items() if find(a) == r], default=0) for r, (ids, _) in out.items() if len(ids) > 1}


@pytest.mark.parametrize("most", [0, 3, 4, 8, 15])
def test_near_hashes(spark, monkeypatch, most):
    import random

    rnd = random.Random(most)
    centres = [rnd.getrandbits(64) for _ in range(30)]
    rows = [(i, f"{rnd.choice(centres) ^ sum(1 << b for b in rnd.sample(range(64), rnd.choice([0, 1, 2, 5, 9, 16]))):016x}") for i in range(260)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)] + [(2000, None)]
    df = spark.createDataFrame(rows, "id long, h string")
    hashes = sorted({h for _, h in rows if h})
    want = {(a, b) for i, a in enumerate(hashes) for b in hashes[i + 1 :] if (int(a, 16) ^ int(b, 16)).bit_count() <= most}
    held = rows[::3]
    for cost, cell in ((1000, 20_000), (0, 7)):
        monkeypatch.setattr(groups.Bands, "COST", cost)
        monkeypatch.setattr(groups, "CELL", cell)
        assert sorted(map(tuple, groups.near_pairs(df, "h", most).collect())) == sorted(want)
        got = {}
        for r in groups.perceptual_groups(df, "id", "h", most).collect():
            got.setdefault((r.canonical, r.size, r.max_distance), []).append(r.id)
        assert {tuple(sorted(v)): k[2] for k, v in got.items()} == slow_groups(rows, most)
        assert all(k[0] == min(v) and k[1] == len(v) for k, v in got.items())
        found = {r.h: r.match for r in groups.first_match(df, spark.createDataFrame(held, "id long, h string"), "h", "id", most).collect()}
        near = {h: [i for i, o in held if o and (int(h, 16) ^ int(o, 16)).bit_count() <= most] for h in hashes}
        assert found == {h: min(v) for h, v in near.items() if v}
    assert groups.perceptual_groups(df.where("false"), "id", "h", most).count() == 0


def test_many_near_hashes_write_no_pairs(spark):
    """50,000 hashes within four bits of one: all pairs would be 10^9."""
    import itertools

    near = itertools.islice((sum(1 << b for b in c) for c in itertools.combinations(range(64), 4)), 50_000)
    df = spark.createDataFrame([(i, f"{h ^ 0xF0F0AAAA12345678:016x}") for i, h in enumerate(near)], "id long, h string")
    tied = groups.links(df.select(groups.word(F.col("h")).alias("w")), 8)
    assert tied.count() <= 50_000 * 45
    got = groups.perceptual_groups(df, "id", "h", 8).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("canonical").alias("k"), F.max("max_distance").alias("d")).first()
    assert tuple(got) == (50_000, 1, 8)


def balanced_groups(sizes, shares):
    """Each group, the largest first, to the split that is furthest below its target: one after another."""
    names, total = list(shares), sum(n for _, n in sizes)
    short = dict(zip(names, prepare.largest_remainder(total, list(shares.values())), strict=True))
    out = {}
    for g, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        s = max(names, key=lambda k: (short[k], -names.index(k)))
        out[g], short[s] = s, short[s] - n
    return out


def test_groups_dealt_by_size_are_dealt_one_by_one(spark):
    import random

    rnd = random.Random(8)
    for trial in range(200):
        shares = {f"s{i}": rnd.choice([0.0, 0.1, 0.3, 1.0, 2.5]) for i in range(rnd.randrange(1, 5))} | {"z": 1.0}
        sizes = [(f"g{i:05}", rnd.choice([1, 1, 1, 2, 3, 7, 40, rnd.randrange(1, 500)])) for i in range(rnd.choice([1, 5, 60, 400]))]
        dealt = prepare.deal_sizes([(n, sum(m == n for _, m in sizes)) for n in {n for _, n in sizes}], shares)
        want, seen = balanced_groups(sizes, shares), {}
        for g, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
            r = seen[n] = seen.get(n, -1) + 1
            start, turn = [c for c in dealt[n] if c[0] <= r][-1]
            assert turn[(r - start) % len(turn)] == want[g], trial
        assert all(len(c) <= len(shares) for c in dealt.values())
    rows = [(f"g{i % 37 if i % 3 else i % 5:03}" if i % 11 else None, i) for i in range(700)]
    out = prepare.assign_splits(spark.createDataFrame(rows, "g string, i long"), "i", {"train": 0.7, "validation": 0.2, "test": 0.1}, "group", "g").collect()
    sizes = {}
    for g, _ in rows:
        sizes[g or ""] = sizes.get(g or "", 0) + 1
    want = balanced_groups(list(sizes.items()), {"train": 0.7, "validation": 0.2, "test": 0.1})
    assert len(out) == 700 and all(r.split == want[r.g or ""] for r in out)


def test_numbers_as_tables_show_them(spark):
    import random
    import struct

    rnd = random.Random(3)
    xs = [0.0, -0.0, 1.0, 10.0, -2.5, 1e15, 1e16, 1e20, 1.5e300, 123456789.125, 1e7, 9999999.0, 1e-3, 1e-4, 1e-5, 0.00012345, 5e-324, 1.7976931348623157e308, 0.1, 1 / 3, 1e22, 12345678901234567.0, 2.0**-44, 2e-3, float("inf"), float("-inf"), float("nan")]
    xs += [struct.unpack("d", rnd.randbytes(8))[0] for _ in range(2000)] + [rnd.uniform(-1, 1) * 10 ** rnd.randrange(-8, 20) for _ in range(2000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double")
    got = {r.i: r.s for r in df.select("i", scalar.rendered_column(df, "x").alias("s")).collect()}
    assert [(i, got[i]) for i, x in enumerate(xs) if got[i] != repr(x)] == []
    assert predicates.lab_filter(df, "x", "equals", "1e+20").count() == 1 and predicates.conditions(df, [{"column": "x", "op": "in", "value": [1e16, "1e-05"]}]).count() == 2
    assert cleaning.replace(df, "x", {"10000000.0": 7.0}).where("i = 10").first().x == 7.0
    both = spark.createDataFrame([(True, 1.0), (None, None)], "b boolean, x double")
    assert reshape.melt(both, ["x"]).select("value").collect()[0][0] == "True"


def test_pictures_of_any_size(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    grey = [rng.integers(0, 256, (h, w)) for h, w in ((32, 32), (32, 32), (40, 17), (3, 2), (1, 1), (64, 96))]
    rows = [(i, g.ravel().tolist(), g.shape[1], g.shape[0]) for i, g in enumerate(grey)] + [(90, None, 2, 2), (91, [1, 2, 3], 2, 2), (92, [1, 2, 300, 4], 2, 2), (93, [], 0, 0), (94, [1, None, 2, 3], 2, 2)]
    df = spark.createDataFrame(rows, "id long, pixels array<int>, width int, height int").repartition(2)
    got = {r.id: r for r in pixels.grey_features(df, ["id"]).collect()}
    for i, g in enumerate(grey):
        assert got[i].phash == f"{int(pixels.hashes(g[None])[0]):016x}" and abs(got[i].blur - float(pixels.sharpness(g[None])[0])) < 1e-9
    assert all(got[i].phash is None and got[i].blur is None for i in (90, 91, 92, 93, 94)) and len(got) == len(rows)
    # averaging keeps the mean, and a picture blown up has the hash of the small one
    assert np.allclose(pixels.averaging(17).sum(axis=1), 1) and np.allclose(pixels.averaging(100).sum(axis=1), 1)
    small = grey[0]
    assert pixels.hashes(np.kron(small, np.ones((2, 3), int))[None])[0] == pixels.hashes(small[None])[0]


def test_palettes(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    for n, kinds, most in ((1, 1, 8), (500, 5, 8), (2000, 2000, 8), (300, 40, 3), (64, 2, 1)):
        shown = rng.integers(0, 256, (kinds, 3))
        p = shown[rng.integers(kinds, size=n)]
        got = pixels.palette(p, most)
        different = len(np.unique(p, axis=0))
        assert sum(c for c, _ in got) == n and len(got) == min(most, different) and got == sorted(got, key=lambda x: (-x[0], x[1]))
        if different <= most:  # then they are the colours themselves
            each, count = np.unique(p, axis=0, return_counts=True)
            assert sorted(got) == sorted((int(c), int(r) << 16 | int(g) << 8 | int(b)) for (r, g, b), c in zip(each.tolist(), count, strict=True))
        # each pixel's box is as near as the colours can tell: cutting lowers the error
        err = lambda k: min_error(p, pixels.palette(p, k))  # noqa: B023, E731
        assert err(most) <= err(1) + 1e-9
    x = rng.integers(0, 256, (2, 5, 4, 3))
    df = spark.createDataFrame([(i, x[i].ravel().tolist(), 4, 5) for i in range(2)], "id long, pixels array<int>, width int, height int")
    for r in pixels.colour_details(df, ["id"]).collect():
        flat = x[r.id].reshape(-1, 3)
        assert [r.red, r.green, r.blue] == [np.histogram(flat[:, k], bins=16, range=(0, 256))[0].tolist() for k in range(3)]
        assert np.allclose(r.means, flat.mean(axis=0)) and [(c["count"], int(c["colour"][1:], 16)) for c in r.palette] == pixels.palette(flat)


def min_error(p, colours):
    import numpy as np

    c = np.array([[v >> 16, v >> 8 & 255, v & 255] for _, v in colours], float)
    return float(((p[:, None].astype(float) - c[None]) ** 2).sum(axis=2).min(axis=1).sum())
