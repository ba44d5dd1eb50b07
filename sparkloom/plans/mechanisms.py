"""Queries of operators that need an algorithm of their own, with SQL that says the result another way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import acquisition, budgets, documents, media, pixels, predicates, prepare, quantiles, requests, reshape
from ..sources import bundles, readers, writers
from . import recipe
from .catalog import _QUERIES, _t, query, r, tables
from .coverage import _folder, _union
from .plugins import Plugin, Plugins

# --- HTML

_NAMES = "p|li|blockquote|pre|td|h[1-6]"
_ENTITIES = (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def _plain_sql(c: str) -> str:
    """Without tags, the entities that occur read, white space collapsed."""
    out = rf"regexp_replace({c}, '(?s)</?[A-Za-z][^>]*>|<[!?][^>]*>', ' ', 'g')"
    for name, char in _ENTITIES:
        out = f"replace({out}, '{name}', '{char}')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


def _without(c: str, name: str) -> str:
    return rf"regexp_replace({c}, '(?is)<{name}\b[^>]*>.*?(</{name}\s*>|\z)', ' ', 'g')"


#: A page without comments and without what is dropped with all it holds.
_PAGE = _without(_without(_without(r"regexp_replace(html, '(?s)<!--.*?(-->|\z)', ' ', 'g')", "script"), "style"), "noscript")


@query("pages", rf"""
    with page as (select page_id, {_PAGE} as h from pages),
    parts as (
        select page_id, {_plain_sql(r"regexp_extract(h, '(?is)<title\b[^>]*>(.*?)(</title\s*>|\z)', 1)")} as title,
            string_split(regexp_replace({_without("h", "title")}, '(?i)<({_NAMES})([\s/][^>]*)?>', chr(1) || '\0', 'g'), chr(1)) as ps
        from page),
    part as (select page_id, title, unnest(ps) as x, unnest(range(len(ps))) as pos from parts),
    named as (select *, lower(regexp_extract(x, '^<([A-Za-z0-9]+)', 1)) as name from part where x like '<%'),
    block as (
        select page_id, title, pos, name, {_plain_sql(r"regexp_extract(x, '(?is)^<' || name || '([\s/][^>]*)?>(.*?)</' || name || '\s*>', 2)")} as text
        from named),
    kept as (select *, case when regexp_matches(name, '^h[1-6]$') then text end as head from block where text <> '')
    select page_id, row_number() over w - 1 as block, case when head is null then name else 'heading_' || name[2] end as kind, text,
        coalesce(last_value(head ignore nulls) over (partition by page_id order by pos rows unbounded preceding), '') as heading,
        coalesce(nullif(title, ''), first_value(head ignore nulls) over (partition by page_id order by pos rows between unbounded preceding and unbounded following), '') as title
    from kept window w as (partition by page_id order by pos)""")
def html_blocks(df):
    return documents.html_blocks(df)


# --- chunks

_MARKS = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def _blocks_sql(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """blocks(k, idx, heading, body, n): headings and paragraphs with the heading above and their tokens."""
    return rf"""
        lines as (select {key} as k, unnest(string_split({text}, chr(10))) as raw, unnest(range(len(string_split({text}, chr(10))))) as pos from {table}),
        marked as (select *, regexp_matches(raw, '^#{{1,6}}\s+\S') as head, regexp_replace(raw, '^\s+|\s+$', '', 'g') = '' as blank from lines),
        grouped as (
            select *, sum(case when head or blank then 1 else 0 end) over w as g,
                last_value(case when head then regexp_extract(raw, '^#{{1,6}}\s+(.+?)\s*$', 1) end ignore nulls) over w as above
            from marked window w as (partition by k order by pos rows unbounded preceding)),
        bodies as (
            select k, min(pos) as pos, coalesce(any_value(above), '') as heading,
                case when head then any_value(above) else string_agg(regexp_replace(raw, '^\s+|\s+$', '', 'g'), ' ' order by pos) end as body
            from grouped where not blank group by k, g, head),
        blocks as (select k, row_number() over (partition by k order by pos) - 1 as idx, heading, body, len(regexp_extract_all(body, '{_MARKS}')) as n from bodies)"""


def _chunks_sql(strategy: str, size: int, overlap: int) -> str:
    """CTEs that end in chunk_<strategy>(k, chunk, heading, n_tokens, value): windows found by following one after another."""
    s = strategy
    first_unit = {
        "token": "select k, idx, 0 as unit from blocks",
        "paragraph": "select k, idx, idx as unit from blocks",
        "heading": """select k, idx, sum(new) over (partition by k order by idx rows unbounded preceding) as unit from (
            select k, idx, case when lag(heading) over (partition by k order by idx) = heading then 0 else 1 end as new from blocks)""",
        "recursive": f"""select k, idx, unit from packed_{s}""",
    }[s]
    packed = f"""
        packed_{s}(k, idx, unit, room) as (
            select k, idx, 0::bigint, {size} - n from blocks where idx = 0
            union all
            select b.k, b.idx, case when b.n <= p.room then p.unit else p.unit + 1 end, case when b.n <= p.room then p.room else {size} end - b.n
            from packed_{s} p join blocks b on b.k = p.k and b.idx = p.idx + 1),""" if s == "recursive" else ""
    back = f"list_max(list_filter(stops, lambda e: e > first + {max(overlap, size // 2)} and e < first + {size})) + 1" if s == "recursive" else "null"
    ends = f"case when first + {size} >= n then n else coalesce({back}, first + {size}) end"
    return rf"""{packed}
        unit_{s} as ({first_unit}),
        body_{s} as (
            select k, unit, string_agg(body, chr(10) || chr(10) order by idx) as body, list(heading order by idx) as heads, list(n order by idx) as sizes
            from unit_{s} join blocks using (k, idx) group by k, unit),
        token_{s} as (
            select *, regexp_extract_all(body, '{_MARKS}') as toks, regexp_split_to_array(body, '{_MARKS}') as gaps, len(regexp_extract_all(body, '{_MARKS}')) as n
            from body_{s}),
        stop_{s} as (select *, list_filter(range(n), lambda i: toks[i + 1] in ('.', '!', '?')) as stops from token_{s} where n > 0),
        window_{s}(k, unit, first, n, stops, until) as (
            select k, unit, first, n, stops, {ends} from (select k, unit, 0::bigint as first, n, stops from stop_{s})
            union all
            select k, unit, first, n, stops, {ends} from (select k, unit, until - {overlap} as first, n, stops from window_{s} where until < n)),
        chunk_{s} as (
            select w.k, row_number() over (partition by w.k order by w.unit, w.first) - 1 as chunk, w.until - w.first as n_tokens,
                t.heads[len(list_filter(range(1, len(t.sizes) + 1), lambda i: list_sum(t.sizes[1:i]) <= w.first)) + 1] as heading,
                list_aggregate(list_transform(range(w.first, w.until), lambda i: case when i > w.first then t.gaps[i + 1] else '' end || t.toks[i + 1]), 'string_agg', '') as value
            from window_{s} w join stop_{s} t using (k, unit))"""


def _name_sql(strategy: str, size: int, overlap: int) -> str:
    """chunk_id of a row of chunk_<strategy> c and its document d."""
    name = f"""'["' || c.k || '", "' || sha256(d.text) || '", {{"chunk_size": {size}, "overlap": {overlap}, "strategy": "{strategy}"}}, ' || c.chunk || ', "' || sha256(c.value) || '"]'"""
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    kind = "['8', '9', 'a', 'b'][(('0x' || h[17])::int % 4) + 1]"
    return f"(select h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || {kind} || h[18:20] || '-' || h[21:32] from (select {h} as h))"


@query("documents", f"""with recursive {_blocks_sql()}, {_chunks_sql("recursive", 256, 32)}
    select d.doc_id, c.chunk, c.heading, c.n_tokens, {_name_sql("recursive", 256, 32)} as chunk_id from chunk_recursive c join documents d on d.doc_id = c.k""")
def chunk_recursive(df):
    return documents.chunks(df, "doc_id", strategy="recursive", size=256, overlap=32).select("doc_id", "chunk", "heading", "n_tokens", "chunk_id")


@query("documents", f"""with recursive {_blocks_sql()}, {_chunks_sql("heading", 128, 16)}
    select d.doc_id, c.chunk, c.heading, c.n_tokens, sha256(c.value) as digest, {_name_sql("heading", 128, 16)} as chunk_id from chunk_heading c join documents d on d.doc_id = c.k""")
def chunk_ids(df):
    out = documents.chunks(df, "doc_id", strategy="heading", size=128, overlap=16)
    return out.select("doc_id", "chunk", "heading", "n_tokens", F.sha2("text", 256).alias("digest"), "chunk_id")


@query("documents", f"""with recursive {_blocks_sql()}, {", ".join(_chunks_sql(s, 256, 32) for s in documents.STRATEGIES)},
    every as ({" union all ".join(f"select '{s}' as strategy, n_tokens from chunk_{s}" for s in documents.STRATEGIES)})
    select strategy, count(*) as chunks, round(avg(n_tokens), 4) as mean_tokens, max(n_tokens)::bigint as max_tokens from every group by 1""")
def chunk_strategies(df):
    return documents.compare_strategies(df, "doc_id").withColumn("mean_tokens", r("mean_tokens"))


# --- budgets, quantiles, groups


@query("part", """
    with recursive c as (
        select p_partkey as id, row_number() over (order by p_partkey) as pos, case when p_partkey % 17 = 0 then 4000 else (p_partkey * 7919) % 97 + p_size end as need,
            case when p_partkey % 5 = 0 then 0 else (p_partkey * 7919) % 97 + p_size end as take from part
    ), g as (select id, pos, greatest(need, take) as need, take from c),
    r(pos, remaining, after_) as (
        select 0::bigint, 30000::bigint, 30000::bigint
        union all
        select g.pos, after_, after_ - case when g.need <= after_ then g.take else 0 end from r join g on g.pos = r.pos + 1)
    select id as p_partkey, remaining from g join r using (pos)""")
def budget_by_classes(df):
    d = df.select(
        "p_partkey", F.expr("if(p_partkey % 17 = 0, 4000, (p_partkey * 7919) % 97 + p_size)").alias("need"), F.expr("if(p_partkey % 5 = 0, 0, (p_partkey * 7919) % 97 + p_size)").alias("take")
    )
    return budgets.left_before(d, "take", 30_000, ["p_partkey"], "remaining", "need", block=100).select("p_partkey", "remaining")


@query("lineitem", """
    select l_returnflag, l_suppkey % 50 as supplier, [round(quantile_cont(l_tax, 0.1), 6), round(quantile_cont(l_tax, 0.5), 6)] as tax, [round(quantile_cont(v, 0.1), 6), round(quantile_cont(v, 0.5), 6)] as price
    from (select *, case when l_suppkey % 50 < 48 then l_extendedprice end as v from lineitem) group by all""")
def quantiles_by_group(df):
    d = df.withColumn("supplier", F.col("l_suppkey") % 50)
    price = F.when(F.col("supplier") < 48, F.col("l_extendedprice"))
    out = quantiles.grouped_quantiles(d, ["l_returnflag", "supplier"], {"tax": F.col("l_tax"), "price": price}, [0.1, 0.5])
    rounded = lambda c: F.when(F.col(c)[0].isNotNull(), F.transform(c, lambda x: F.round(x, 6))).otherwise(F.array(F.lit(None).cast("double"), F.lit(None).cast("double")))
    return out.select("l_returnflag", "supplier", rounded("tax").alias("tax"), rounded("price").alias("price"))


@query("orders", """
    with recursive s as (select o_custkey % 300 + o_orderkey % 2 * (o_custkey % 7) as g, count(*) as n from orders group by 1),
    t as (select sum(n)::bigint as total from s),
    target as (select floor(0.7 * total)::bigint as a, floor(0.2 * total)::bigint as b, floor(0.1 * total + 1e-9)::bigint as c, total from t),
    o as (select g, n, row_number() over (order by n desc, g::varchar) as pos from s),
    d(pos, split, a, b, c) as (
        select 0::bigint, null::varchar, a + (total - a - b - c), b, c from target
        union all
        select o.pos, case when a >= b and a >= c then 'train' when b >= c then 'validation' else 'test' end,
            a - case when a >= b and a >= c then n else 0 end, b - case when not (a >= b and a >= c) and b >= c then n else 0 end, c - case when not (a >= b and a >= c) and not b >= c then n else 0 end
        from d join o on o.pos = d.pos + 1)
    select g, n, d.split from o join d using (pos)""")
def groups_dealt(df):
    d = df.withColumn("g", F.expr("o_custkey % 300 + o_orderkey % 2 * (o_custkey % 7)"))
    out = prepare.assign_splits(d, "o_orderkey", {"train": 0.7, "validation": 0.2, "test": 0.1}, "group", "g")
    return out.groupBy("g", "split").agg(F.count(F.lit(1)).alias("n"))


# --- numbers as text

_EDGE = "(o_orderkey * 7919 || 'e' || (o_orderkey % 45 - 25))::double"


@query("orders", f"""
    select o_orderkey, {_EDGE}::varchar as shown, case when o_orderkey % 2 = 0 then 'True' else 'False' end as flag, {_EDGE}::varchar = '1.2e+16' or {_EDGE}::varchar like '%e-05' as found from orders""")
def number_rendering(df):
    d = df.select("o_orderkey", F.expr("cast(concat(o_orderkey * 7919, 'e', o_orderkey % 45 - 25) as double)").alias("x"), (F.col("o_orderkey") % 2 == 0).alias("b"))
    m = reshape.melt(d, ["o_orderkey"], ["x", "b"]).groupBy("o_orderkey").pivot("variable", ["x", "b"]).agg(F.first("value"))
    found = predicates.conditions_predicate(d, [{"column": "x", "op": "eq", "value": "1.2e+16"}, {"column": "x", "op": "regex", "value": "e-05$"}], "any")
    return m.join(d.select("o_orderkey", found.alias("found")), "o_orderkey").select("o_orderkey", F.col("x").alias("shown"), F.col("b").alias("flag"), "found")


# --- digests


def _digest_sql(rows: str, extra: str, by: str = "") -> str:
    """n and digest of the rows' digests h in `rows`: limbs of 32 bits summed, carried, and hashed with extra and the count."""
    key = f"{by}, " if by else ""
    limbs = ", ".join(f"sum(('0x' || substr(h, {1 + 8 * (7 - i)}, 8))::bigint)::hugeint as s{i}" for i in range(8))
    cte = f"t0 as (select {key}count(*) as n, {limbs} from ({rows}) {f'group by {by}' if by else ''}), u0 as (select *, 0::hugeint as c0 from t0)"
    for i in range(8):
        cte += f", u{i + 1} as (select *, (s{i} + c{i}) % 4294967296 as l{i}, (s{i} + c{i}) // 4294967296 as c{i + 1} from u{i})"
    total = " || ".join(f"lpad(lower(to_hex(l{i}::bigint)), 8, '0')" for i in reversed(range(8)))
    return f"with {cte} select {key}n, sha256({extra} || '/' || n || '/' || {total}) as digest from u8"


_KINDS = '[["n_nationkey", "int"], ["n_name", "string"], ["n_regionkey", "int"]]'


@query("nation", _digest_sql("""select sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') as h from nation""", f"'{_KINDS}'"))
def table_digest(df):
    return bundles.table_digest(df.repartition(5))


@query("documents", f"""select digest as manifest from ({_digest_sql("select sha256(sha256(text) || '/' || n_chars || '/' || doc_id || '.txt') as h from documents", "'{\"options\": {\"top\": 5}, \"snapshot\": \"v1\"}'")})""")
def manifest_digest(df):
    return readers.manifest_hash(df.selectExpr("concat(doc_id, '.txt') path", "sha2(text, 256) sha256", "n_chars size"), "v1", {"top": 5})


_SPLIT = "case when c_custkey % 10 = 0 then 'test' else 'train' end"


@query("customer", _digest_sql(f"""select {_SPLIT} as split, sha256('{{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","split":"' || {_SPLIT} || '"}}') as h from customer""", "''", "split"))
def dataset_export(df):
    path = _folder(df)
    d = df.selectExpr("c_custkey", "c_name", "if(c_custkey % 10 = 0, 'test', 'train') split")
    return writers.export_dataset(d, path, "customers", "cc0-1.0").select("split", "n", "digest")


# --- files

_LINES = "c_name || chr(10) || '\"' || c_mktsegment || '\", ' || c_custkey"


@query("customer", f"select c_custkey, {_LINES} as note, c_acctbal, case when c_custkey % 9 = 0 then null else c_nationkey end as nation, 'int' as kind from customer")
def csv_ranges(df):
    """Files whose fields hold line ends and quotes, in ranges of 4 KB; the types are those that are inferred."""
    path = _folder(df)
    d = df.select("c_custkey", F.expr("concat(c_name, chr(10), '\"', c_mktsegment, '\", ', c_custkey)").alias("note"), "c_acctbal", F.expr("if(c_custkey % 9 = 0, null, c_nationkey)").alias("nation"))
    writers.export(d.repartition(2, "c_custkey"), path, "csv")
    out = readers.read_csv(df.sparkSession, path, range_bytes=4096)
    return out.withColumn("c_custkey", F.col("c_custkey").cast("long")).withColumn("kind", F.lit(dict(out.dtypes)["nation"]))


@query("supplier", "select s_suppkey, s_name || ' [\"{' as label, [s_nationkey, null] as tags, s_acctbal as balance from supplier")
def json_ranges(df):
    """One array of objects, in ranges of 2 KB."""
    path = _folder(df)
    element = F.to_json(F.struct("s_suppkey", F.expr("concat(s_name, ' [\"{')").alias("label"), F.struct(F.col("s_acctbal").alias("balance"), F.array("s_nationkey", F.lit(None).cast("int")).alias("tags")).alias("more")), {"pretty": "true"})
    d = df.select(F.col("s_suppkey").alias("k"), F.concat(element, F.lit(",")).alias("value"))
    ends = df.sparkSession.createDataFrame([(-1, "["), (1 << 60, "{}\n]")], "k long, value string")
    d.unionByName(ends).repartition(1).sortWithinPartitions("k").select("value").write.text(path)
    out = readers.read_table(df.sparkSession, path, "json", range_bytes=2048).where("s_suppkey is not null")
    return out.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "label", F.col("more.tags").cast("array<int>").alias("tags"), F.col("more.balance").alias("balance"))


def _local(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/")


@query("customer", _union(sqlite="select c_custkey, c_name, c_acctbal from customer", duckdb="select c_custkey, c_name, c_acctbal from customer"))
def database_files(df):
    """A SQLite and a DuckDB file, written and read in ranges of row ids."""
    from .coverage import _tagged

    parts = {}
    for kind in ("sqlite", "duckdb"):
        path = f"{_local(_folder(df))}.{kind}"
        writers.export(df.select("c_custkey", "c_name", "c_acctbal"), path, kind, "customers")
        parts[kind] = readers.read_table(df.sparkSession, path)
    return _tagged(**parts)


@query("orders", "select o_orderstatus, round(avg(o_totalprice), 2) as price, max(o_orderkey) as last from orders where o_totalprice >= 1000 group by 1")
def bundle_replayed(df):
    path = _folder(df)
    steps = [{"operation": "conditions", "parameters": {"conditions": [{"column": "o_totalprice", "op": "ge", "value": 1000}]}}]
    bundles.write_bundle(path, df, steps)
    out = bundles.replay_bundle(df.sparkSession, path)
    return out.groupBy("o_orderstatus").agg(r(F.avg("o_totalprice"), 2).alias("price"), F.max("o_orderkey").alias("last"))


@query("part", "select p_partkey, p_name from part where p_size >= 20 and p_name ilike '%re%'")
def exported_query(df):
    path = _folder(df)
    bundles.export_query(df, path, "jsonl", [{"column": "p_size", "op": "gte", "value": 20}, {"column": "p_name", "op": "contains", "value": "re"}], None, ["p_partkey", "p_name"])
    return readers.read_table(df.sparkSession, path, "jsonl").select("p_partkey", "p_name")


@query("nation", "select n_nationkey, n_name, n_regionkey, true as again from nation")
def imported_by_content(df):
    """A file's table kept by what it is: the second import reads what the first one stored."""
    path, store = _folder(df), _folder(df)
    writers.export(df, path, "tsv")
    first, key = bundles.normalised(df.sparkSession, path, store, "file-digest", "tsv")
    second, again = bundles.normalised(df.sparkSession, path, store, "file-digest", "tsv")
    return second.withColumn("n_nationkey", F.col("n_nationkey").cast("int")).withColumn("n_regionkey", F.col("n_regionkey").cast("int")).withColumn("again", F.lit(key == again))


@tables(_QUERIES["bayes_language"][1])
def model_archived(spark, d):
    """The language model stored, loaded again and applied."""
    df = _t(spark, d, "documents")
    store = _folder(df)
    key = bundles.archive_model(spark, bundles.bayes_model(documents.bayes_fit(df, "lang", documents.tfidf_vocabulary(df))), store)
    return documents.bayes_classify(df, bundles.bayes_frame(spark, bundles.load_model(spark, store, key)), "doc_id").select("doc_id", "label", r("p").alias("p"))


@query("documents", r"""
    with p as (select doc_id, unnest(string_split(text, chr(10))) as x, unnest(range(len(string_split(text, chr(10))))) as at_ from documents),
    k as (select doc_id, at_, regexp_replace(x, '^\s+|\s+$', '', 'g') as x from p where regexp_replace(x, '^\s+|\s+$', '', 'g') <> '')
    select doc_id, row_number() over (partition by doc_id order by at_) - 1 as block, case when at_ = 0 then 'heading' else 'paragraph' end as kind, x as text from k""")
def docx_blocks(df):
    """Documents as DOCX files, a paragraph a line and the first line a heading, parsed again."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    import pandas as pd

    def pack(parts):
        for p in parts:
            out = []
            for text in p["text"]:
                body = "".join(f'<w:p>{"<w:pPr><w:pStyle w:val=%sHeading1%s/></w:pPr>" % (chr(34), chr(34)) if not i else ""}<w:r><w:t>{escape(x)}</w:t></w:r></w:p>' for i, x in enumerate(text.split("\n")))
                raw = io.BytesIO()
                with zipfile.ZipFile(raw, "w") as z:
                    z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
                out.append(raw.getvalue())
            yield pd.DataFrame({"path": [f"{i}.docx" for i in p["doc_id"]], "content": out})

    files = df.select("doc_id", "text").mapInPandas(pack, "path string, content binary")
    return documents.file_blocks(files).selectExpr("cast(regexp_extract(path, '^[0-9]+', 0) as bigint) doc_id", "block", "kind", "text")


@query("documents", "select 'chunks' as part, count(*) as n from documents union all select 'embeddings', count(*) from documents union all select 'indexes', count(*) from documents")
def rag_bundle(df):
    path = _folder(df)
    d = df.select(F.col("doc_id").alias("asset_id"), F.lit("active").alias("state"), "text")
    index = d.select("asset_id", F.lit("hash").alias("model"))
    writers.export_rag(d.select("asset_id", "text"), documents.hashed_vectors(d, "asset_id", dims=16), d.drop("text"), index, path)
    counts = [df.sparkSession.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name in ("chunks", "embeddings", "indexes")]
    return counts[0].union(counts[1]).union(counts[2])


# --- pictures

def _pictures(df: DataFrame) -> DataFrame:
    """vec_id, pixels, width, height: a grey picture of 32 x 32 for each vector, without pattern, so that no frequency is 0."""
    e = lambda at: F.get("embedding", at.cast("int")).cast("float")
    i = lambda x: x.cast("long")

    def pixel(k):
        far = (e(F.pmod(i(k) * i(k) + 3 * i(k), F.lit(61))).cast("double") + 0.7 * e(F.pmod(i(k) * 7 + F.floor(k / 32) * 5, F.lit(64))).cast("double") * (F.pmod(i(k) * 37, F.lit(11)) - 5))
        return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(128 + 170 * far).cast("double"))).cast("int")

    return df.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(1023)), pixel).alias("pixels"), F.lit(32).alias("width"), F.lit(32).alias("height"))


_PIXELS = """px as materialized (
        select vec_id, i, least(255, greatest(0, floor(128 + 170 * (embedding[((i * i + 3 * i) % 61 + 1)::int]::double + 0.7 * embedding[((i * 7 + (i // 32) * 5) % 64 + 1)::int]::double * ((i * 37) % 11 - 5)))))::int as v
        from embeddings, range(1024) t(i))"""


@query("embeddings", f"""
    with {_PIXELS},
    rows_ as (select vec_id, i // 32 as y, u, sum(v * cos((2 * (i % 32) + 1) * u * pi() / 64)) as c from px, range(8) f(u) group by all),
    low as (select vec_id, w, u, sum(c * cos((2 * y + 1) * w * pi() / 64)) as c from rows_, range(8) f(w) group by all),
    mid as (select vec_id, median(c) as m from low where u + w > 0 group by 1),
    bits as (select vec_id, (w * 8 + u) // 4 as at_, sum((case when c >= m then 1 else 0 end) * (8 >> (u % 4)::int)) as nibble from low join mid using (vec_id) group by 1, 2),
    edge as (
        select a.vec_id, a.i, case when a.i % 32 between 1 and 30 and a.i // 32 between 1 and 30 then least(255, greatest(0, 9 * a.v - sum(b.v))) else a.v end as v
        from px a join px b on b.vec_id = a.vec_id and abs(b.i % 32 - a.i % 32) <= 1 and abs(b.i // 32 - a.i // 32) <= 1 group by a.vec_id, a.i, a.v),
    blur as (select vec_id, var_pop(v) as blur from edge group by 1)
    select vec_id, phash, round(blur, 4) as blur, round(least(100, 25 * log10(1 + blur)), 4) as quality
    from (select vec_id, string_agg(lower(to_hex(nibble::bigint)), '' order by at_) as phash from bits group by 1) join blur using (vec_id)""")
def pixel_hash(df):
    return pixels.grey_features(_pictures(df), ["vec_id"]).select("vec_id", "phash", r("blur").alias("blur"), r("quality").alias("quality"))


@query("embeddings", f"""
    with {_PIXELS}, colour as (select vec_id, i // 3 as p, i % 3 as k, v from px where i < 1023),
    bins as (select vec_id, k, v // 16 as b, count(*) as n from colour group by all),
    grid as (select vec_id, k, b from (select distinct vec_id from px), range(3) c(k), range(16) r(b)),
    full_ as (select vec_id, k, list(coalesce(n, 0) order by b) as h from grid left join bins using (vec_id, k, b) group by all),
    means as (select vec_id, k, round(avg(v), 4) as m from colour group by all)
    select a.vec_id, a.h as red, b.h as green, c.h as blue, [x.m, y.m, z.m] as means, 341::bigint as counted
    from full_ a join full_ b using (vec_id) join full_ c using (vec_id) join means x using (vec_id) join means y using (vec_id) join means z using (vec_id)
    where a.k = 0 and b.k = 1 and c.k = 2 and x.k = 0 and y.k = 1 and z.k = 2""")
def picture_details(df):
    d = _pictures(df).select("vec_id", F.slice("pixels", 1, 1023).alias("pixels"), F.lit(31).alias("width"), F.lit(11).alias("height"))
    out = pixels.colour_details(d, ["vec_id"])
    counted = F.aggregate("palette", F.lit(0).cast("long"), lambda a, x: a + x["count"])
    return out.select("vec_id", "red", "green", "blue", F.transform("means", lambda x: F.round(x, 4)).alias("means"), counted.alias("counted"))


def _plan_sql(name: str, frames: str, step: str, problem: str = "null") -> str:
    return f"""select event_id, '{name}' as part, case when problem is null and n > 500 then 'too_many_frames' else problem end as problem, case when problem is null and n <= 500 then n end as frames,
        case when problem is null and n <= 500 and {step} is not null then round(2 + (n - 1) * {step}, 4) end as last from (
        select *, case when span is null or span <= 0 then 'start_out_of_range' else {problem} end as problem, ({frames})::bigint as n from v)"""


@query("events", f"""with v as (select event_id, abs(value) as duration, nullif(event_id % 31, 0)::double as fps, least(300, abs(value) - 2) as span from events)
    {_plan_sql("seconds", "ceil(span / 0.75)", "0.75")} union all {_plan_sql("frames", "ceil(span * fps / 5)", "5 / fps", "case when fps is null then 'unknown_rate' end")}
    union all {_plan_sql("count", "12", "span / 12")} union all {_plan_sql("scene", "12", "null::double")}""")
def frame_plans(df):
    from .coverage import _tagged

    d = df.select("event_id", F.abs("value").alias("duration"), F.nullif(F.col("event_id") % 31, F.lit(0)).cast("double").alias("fps"))
    plans = {"seconds": {"interval": 0.75}, "frames": {"interval": 5}, "count": {"count": 12}, "scene": {"count": 12}}
    parts = {s: media.frame_plan(d, s, start=2.0, length=300.0, **k).select("event_id", "problem", "frames", F.round(F.try_element_at("times", F.lit(-1)), 4).alias("last")) for s, k in plans.items()}
    return _tagged(**parts)


# --- inputs and plugins by name


@query("nation", "select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey")
def second_input_kept(df):
    """A join whose second table is replaced after submission: the result is that of the table as it was."""
    path, store = _folder(df), _folder(df)
    regions = df.select("n_regionkey").distinct().selectExpr("n_regionkey r_regionkey", "element_at(array('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'), n_regionkey + 1) r_name")
    regions.write.parquet(path)
    step = {"operation": "combine", "parameters": {"right": "regions", "left_key": "n_regionkey", "right_key": "r_regionkey", "how": "left"}}
    steps, kept = bundles.submitted([step], {"regions": df.sparkSession.read.parquet(path)}, store)
    regions.withColumn("r_name", F.lit("changed")).write.mode("overwrite").parquet(path)
    return recipe.run(df, steps, kept)[0].select("n_nationkey", "n_name", "r_name")


class _ByLength:
    """Relevance by the length of the text."""

    def relevance(self, text):
        return F.length(text) / 40.0


@query("part", """select p_partkey as candidate_id, case when length(p_name) / 40.0 < 0.2 then 'rejected' when length(p_name) / 40.0 < 0.6 then 'review' else 'accepted' end as state from part""")
def relevance_by_plugin(df):
    plugins = Plugins()
    plugins.register(Plugin("by-length", "1.0", ">=1.0", ("relevance_evaluator",), {"relevance_evaluator": _ByLength()}))
    c = df.selectExpr(
        "p_partkey candidate_id", "'https://a.org/' url", "'CC BY 4.0' license", "0 declared_width", "0 declared_height", "1 bytes", "true decoded", "'image/png' mime", "10 width", "10 height",
        "cast(null as string) sha256", "90.0D quality", "cast(null as string) phash", "p_name text",
    )
    return acquisition.cascade(c, acquisition.Spec(), evaluator=plugins.named("relevance_evaluator", "by-length")).select("candidate_id", "state")


# --- planning of acquisitions


@query("nation", """
    select n_nationkey, 40 + n_nationkey as count, 300 + n_nationkey * 10 as min_width, case when n_nationkey % 2 = 0 then 300 + n_nationkey * 10 else 480 end as min_height,
        case when n_nationkey % 3 = 0 then 'cc-by' end as license, case when n_nationkey % 4 = 0 then 'pics.' || n_nationkey || '.example.org' end as domain, 'old boats of ' || lower(n_name) as topic
    from nation""")
def requests_read(df):
    """Requests in words, one for each nation, read back."""
    import pandas as pd

    asked = df.select("n_nationkey", F.concat(
        F.lit("Please find "), F.expr("40 + n_nationkey"), F.lit(" usable photos of old boats of "), "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.expr("concat(', at least ', 300 + n_nationkey * 10, ' px')")).otherwise(F.expr("concat('; ', 300 + n_nationkey * 10, ' x 480')")),
        F.when(F.col("n_nationkey") % 3 == 0, ", cc-by only").otherwise(""), F.when(F.col("n_nationkey") % 4 == 0, F.expr("concat(' from pics.', n_nationkey, '.example.org')")).otherwise(""),
    ).alias("asked"))

    def read(parts):
        for p in parts:
            found = [requests.parse_request(x) for x in p["asked"]]
            rows = [(k, f["count"], f["min_width"], f["min_height"], next(iter(f["licenses"]), None), next(iter(f["domains"]), None), f["topic"]) for k, f in zip(p["n_nationkey"], found, strict=True)]
            yield pd.DataFrame(rows, columns=["n_nationkey", "count", "min_width", "min_height", "license", "domain", "topic"])

    return asked.mapInPandas(read, "n_nationkey int, count int, min_width int, min_height int, license string, domain string, topic string")


@query("orders", """
    with o as (select o_orderkey, o_custkey % 90 + 1 as n, o_orderkey % 200 as budget, o_custkey % 7 as accepted, o_custkey % 7 + o_orderkey % 13 as evaluated from orders),
    e as (select *, greatest(n, ceil(n / 0.75))::bigint as low from o)
    select o_orderkey, low, greatest(low, least(budget, ceil(n / 0.45)))::bigint as high, least(n, 20)::bigint as target, greatest(3 * least(n, 20), least(n, 20) + 5)::bigint as cap,
        greatest(4, least(64, ceil(n / greatest(case when evaluated > 0 then accepted / evaluated else 0.5 end, 0.05))))::bigint as batch
    from e""")
def yield_plans(df):
    """Estimates, trial runs and batch sizes for plans of many sizes."""
    import pandas as pd

    def plan(parts):
        for p in parts:
            rows = []
            for k, c in zip(p["o_orderkey"].tolist(), p["o_custkey"].tolist(), strict=True):
                n = c % 90 + 1
                rows.append((k, *acquisition.estimates(n, k % 200), *acquisition.trial(n, 20), acquisition.batch_size(n, c % 7, c % 7 + k % 13)))
            yield pd.DataFrame(rows, columns=["o_orderkey", "low", "high", "target", "cap", "batch"])

    return df.select("o_orderkey", "o_custkey").mapInPandas(plan, "o_orderkey long, low long, high long, target long, cap long, batch long")


@query("part", """
    with w as (select p_partkey, p_name as base, unnest([''] || string_split(p_type, ' ')) as v, unnest(range(len(string_split(p_type, ' ')) + 1)) as k from part),
    q as (select p_partkey, min(k) as k, trim(base || ' ' || v) as text from w group by p_partkey, trim(base || ' ' || v))
    select p_partkey, row_number() over (partition by p_partkey order by k) - 1 as place, text from q""")
def search_texts(df):
    """Search texts of a subject with its variants."""
    import pandas as pd

    def texts(parts):
        for p in parts:
            rows = [(k, i, q) for k, name, kind in zip(p["p_partkey"], p["p_name"], p["p_type"], strict=True) for i, q in enumerate(acquisition.queries(name.split(" "), kind.split(" ")))]
            yield pd.DataFrame(rows, columns=["p_partkey", "place", "text"])

    return df.select("p_partkey", "p_name", "p_type").mapInPandas(texts, "p_partkey long, place long, text string")


@query("supplier", """
    with c as (select s_suppkey as id, s_nationkey % 4 = 0 as bad, s_suppkey % 30 as sha from supplier), f as (select sha, min(id) as first from c where not bad group by 1)
    select id as candidate_id, case when bad then 'license_not_allowed' when first < id then 'exact_duplicate' end as reason, case when bad or first < id then 'rejected' else 'accepted' end as state from c left join f using (sha)""")
def acquisition_run(df):
    """Batch after batch through the checks until the providers have no more: as if all had come at once."""
    c = df.selectExpr(
        "s_suppkey candidate_id", "'https://a.org/' url", "if(s_nationkey % 4 = 0, 'none', 'CC BY 4.0') license", "0 declared_width", "0 declared_height", "1 bytes", "true decoded", "'image/png' mime", "10 width", "10 height",
        "sha2(cast(s_suppkey % 30 as string), 256) sha256", "90.0D quality", "cast(null as string) phash", "'' text",
    )
    n, given = df.agg(F.max("s_suppkey") + 1).first()[0], [0]

    def search(size):
        start, given[0] = given[0], min(given[0] + max(size, -(-n // 6)), n)
        return c.where(f"candidate_id >= {start} and candidate_id < {given[0]}") if start < n else None

    judged, why = acquisition.run(acquisition.Spec(licenses=["CC BY"]), 10 * n, 10 * n, search)
    if why != "queries_exhausted":
        raise RuntimeError(why)
    return judged.select("candidate_id", "reason", "state")


@query("nation", "select n_nationkey, sha256(n_name || chr(10)) as sha256, strlen(n_name) + 1 as size, 'text/plain' as media_type from nation")
def binary_files(df):
    path = _folder(df)
    df.select(F.col("n_name").alias("value"), F.col("n_nationkey").alias("k")).repartition("k").write.partitionBy("k").text(path)
    found = readers.binary_assets(df.sparkSession, path, "*.txt")
    return found.select(F.regexp_extract("path", "k=([0-9]+)", 1).cast("int").alias("n_nationkey"), "sha256", "size", "media_type")


@query("supplier", "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def bounded_table(df):
    """A table within its limits passes as it is."""
    return readers.with_limits(df, rows=10_000_000, columns=20)
