"""More queries with their SQL: the operators and branches that catalog.py doesn't reach."""

from __future__ import annotations

import uuid
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import acquisition, aggregates, charts, cleaning, combine, documents, groups, media, predicates, prepare
from ..sources import readers, writers
from .catalog import _PH, _QUERIES, _hashes, _t, query, r, tables
from .session import cut


def _with_sql(name: str, sql: str) -> None:
    """Gives a query of catalog.py its SQL."""
    _QUERIES[name] = (_QUERIES[name][0], sql)


def _tagged(**parts: DataFrame) -> DataFrame:
    """The rows of several frames with one more column, part."""
    out = None
    for name, d in parts.items():
        d = d.withColumn("part", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


def _union(**parts: str) -> str:
    return " union all ".join(f"select *, '{name}' as part from ({sql})" for name, sql in parts.items())


# --- predicates

_NO = "select o_orderkey, nullif(o_orderstatus, 'F') as status, o_totalprice, o_custkey from orders"


def _orders(df: DataFrame) -> DataFrame:
    return df.select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("status"), "o_totalprice", "o_custkey")


@query("orders", _union(
    eq=f"select o_orderkey from ({_NO}) where status = 'O' and o_custkey < 700 and o_totalprice <= 200000",
    ne=f"select o_orderkey from ({_NO}) where status <> 'O' and o_totalprice > 300000",
    isin=f"select o_orderkey from ({_NO}) where o_custkey in (1, 5, 9, 700) and status in ('O', 'P')",
    missing=f"select o_orderkey from ({_NO}) where status is null and o_totalprice < 100000",
))
def query_filters(df):
    def kept(*filters: tuple) -> DataFrame:
        return d.where(predicates.query_predicate(d, [dict(zip(("column", "op", "value"), f, strict=False)) for f in filters])).select("o_orderkey")

    d = _orders(df)
    return _tagged(
        eq=kept(("status", "eq", "O"), ("o_custkey", "lt", 700), ("o_totalprice", "lte", 200000.0)),
        ne=kept(("status", "ne", "O"), ("o_totalprice", "gt", 300000.0)),
        isin=kept(("o_custkey", "in", [1, 5, 9, 700]), ("status", "in", ["O", "P"])),
        missing=kept(("status", "is_null"), ("o_totalprice", "lt", 100000.0)),
    )


@query("orders", _union(
    equals=f"select o_orderkey from ({_NO}) where o_custkey::varchar = '12'",
    greater=f"select o_orderkey from ({_NO}) where o_totalprice > 400000",
    less=f"select o_orderkey from ({_NO}) where o_totalprice < 20000",
    contains=f"select o_orderkey from ({_NO}) where contains(o_custkey::varchar, '11')",
    is_null=f"select o_orderkey from ({_NO}) where status is null",
    not_null=f"select o_orderkey from ({_NO}) where status is not null",
))
def lab_filters(df):
    d, ask = _orders(df), {"equals": ("o_custkey", "12"), "greater": ("o_totalprice", 400000), "less": ("o_totalprice", 20000), "contains": ("o_custkey", "11"), "is_null": ("status", None), "not_null": ("status", None)}
    return _tagged(**{op: predicates.lab_filter(d, c, op, v).select("o_orderkey") for op, (c, v) in ask.items()})


@query("nation", _union(
    any_without="select n_nationkey from nation order by n_nationkey limit 7",
    isin="select n_nationkey from nation where n_regionkey::varchar in ('1', '3') order by n_nationkey limit 50",
    any_of="select n_nationkey from nation where n_regionkey > 3 or n_name = 'NATION_2' order by n_nationkey limit 50",
))
def browse_matches(df):
    def page(size: int, match: str, *conditions: dict) -> DataFrame:
        return predicates.browse(df, ["n_nationkey"], conditions=list(conditions), match=match, size=size).select("n_nationkey")

    isin, over = {"column": "n_regionkey", "op": "in", "value": [1, 3]}, {"column": "n_regionkey", "op": "gt", "value": 3}
    return _tagged(any_without=page(7, "any"), isin=page(50, "all", isin), any_of=page(50, "any", over, {"column": "n_name", "op": "eq", "value": "NATION_2"}))


@query("orders", f"select o_orderkey, status from ({_NO}) order by status desc nulls last, o_orderkey limit 1000 offset 400")
def page_missing_last(df):
    return predicates.query_table(_orders(df), columns=["o_orderkey", "status"], sort="status", descending=True, limit=1000, offset=400, tie=["o_orderkey"])[0]


@query("orders", "select o_orderkey, o_custkey from (select *, row_number() over (order by o_orderkey) - 1 as p from orders) where p in (0, 5, 17, 301)")
def sample_selected(df):
    return cleaning.sample_rows(df, "selected", positions=[0, 5, 17, 301], order=["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("part", "select least(100, count(*)) as n, least(100, count(*)) as distinct_rows from part")
def sample_random_size(df):
    return cleaning.sample_rows(df, "random", 100, 7, ["p_partkey"]).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_partkey").alias("distinct_rows"))


# --- cleaning


@query("events", """select event_id, json_extract_string(props, '$.k') as k, (json_extract_string(props, '$.k'))::double as number, coalesce(case when event_id % 3 = 0 then null else value end, -1) as v,
    case when event_id % 2 = 0 then timestamp '2024-02-29 10:00:00' end as t from events""")
def json_cast_fill(df):
    d = df.select("event_id", scalar.json_value(F.col("props"), "$.k").alias("k"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"), F.expr("if(event_id % 2 = 0, '2024-02-29T10:00:00Z', null)").alias("t"))
    d = cleaning.cast(d.withColumn("number", F.col("k")), "number", "number")
    return cleaning.fill_missing(cleaning.cast(d, "t", "datetime"), ["v"], "constant", -1.0)


@query("orders", """with b as (select 'b' || (o_custkey % 4) as k, case when o_custkey % 4 = 0 then null else round(o_totalprice) end as v from orders) select k, round(coalesce(sum(v), 0), 0) as v from b group by 1""")
def agg_sum_all_missing(df):
    d = df.select(F.concat(F.lit("b"), F.col("o_custkey") % 4).alias("k"), F.when(F.col("o_custkey") % 4 != 0, F.round("o_totalprice")).alias("v"))
    return aggregates.aggregate(d, ["k"], ["v"], "sum").select("k", r("v", 0).alias("v"))


# --- statistics and profiles


def _describe_sql(table: str, numeric: list[str], text: list[str]) -> str:
    parts = [
        f"select '{c}' as \"column\", count({c}) as count, count(distinct {c}) as \"unique\", null as top, round(avg({c}), 2) as mean, round(stddev_samp({c}), 2) as std, min({c})::double as min, round(quantile_cont({c}, 0.25), 2) as q25, round(quantile_cont({c}, 0.5), 2) as q50, round(quantile_cont({c}, 0.75), 2) as q75, max({c})::double as max from {table}"
        for c in numeric
    ]
    parts += [f"select '{c}', count({c}), count(distinct {c}), (select {c} from {table} where {c} is not null group by 1 order by count(*) desc, 1 limit 1), null, null, null, null, null, null, null from {table}" for c in text]
    return " union all ".join(parts)


@query("customer", _describe_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"]))
def describe_customer(df):
    d = aggregates.describe(df)
    return d.select("column", "count", "unique", "top", *[r(c, 2).alias(c) for c in ("mean", "std")], "min", *[r(c, 2).alias(c) for c in ("q25", "q50", "q75")], "max")


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _profile_sql(table: str, columns: list[str]) -> str:
    one = """select '{c}' as "column", count(*) as rows, count(*) - count({c}) as missing, count(distinct {c}) as "unique", round(avg({c}) filter (isfinite({c})), 3) as mean, round(quantile_cont({c}, 0.5) filter (isfinite({c})), 3) as median,
        round(stddev_samp({c}) filter (isfinite({c})), 3) as std, min({c}) filter (isfinite({c})) as min, max({c}) filter (isfinite({c})) as max, count(*) filter (isinf({c})) as infinite,
        (select count(*) from {t}, (select quantile_cont({c}, 0.25) as a, quantile_cont({c}, 0.75) as b from {t} where isfinite({c})) where isfinite({c}) and ({c} < a - 1.5 * (b - a) or {c} > b + 1.5 * (b - a))) as outliers from {t}"""
    return " union all ".join(one.format(c=c, t=table) for c in columns)


_LI = "(select l_quantity, l_extendedprice, l_discount, case when l_linenumber = 1 then 'infinity'::double when l_linenumber = 2 then null when l_orderkey % 50 = 0 then 9.5 else l_tax end as l_tax from lineitem)"


@query("lineitem", _profile_sql(_LI, _NUM))
def column_profile_numbers(df):
    tax = F.expr("case when l_linenumber = 1 then double('infinity') when l_linenumber = 2 then null when l_orderkey % 50 = 0 then 9.5 else l_tax end")
    p = aggregates.column_profile(df.select(*_NUM[:3], tax.alias("l_tax")))
    return p.select("column", "rows", "missing", "unique", *[r(c, 3).alias(c) for c in ("mean", "median", "std")], "min", "max", "infinite", "outliers")


@query("nation", """with v as (select 'n_regionkey' as c, n_regionkey::varchar as v, count(*) as n from nation group by 2 union all select 'n_name', n_name, count(*) from nation group by 2 union all select 'n_nationkey', n_nationkey::varchar, count(*) from nation group by 2),
    r as (select *, row_number() over (partition by c order by n desc, v) as k from v) select c as "column", v as value, n from r where k <= 10""")
def import_profile_values(df):
    return aggregates.import_profile(df).select("column", F.inline("values"))


@query("customer", """with r as (select min(c_acctbal) as a, max(c_acctbal) as b from customer), g as (select unnest(range(20)) as k), n as (select least(floor((c_acctbal - a) / ((b - a) / 20)), 19)::int as k, count(*) as n from customer, r group by 1)
    select round(a + g.k * ((b - a) / 20), 4) as low, round(a + (g.k + 1) * ((b - a) / 20), 4) as high, coalesce(n, 0) as n from g cross join r left join n on n.k = g.k""")
def distribution_number(df):
    return aggregates.distribution(df, "c_acctbal").select(r("low").alias("low"), r("high").alias("high"), "n")


@query("lineitem", " union all ".join(f"select '{c}' as \"column\", 'variance' as method, count(*) filter (abs({c} - m) / s > 1.6) as outliers, round(var_pop({c}) / max(v), 6) as ratio, coalesce(var_pop({c}) < 1e-8, false) as low_variance from lineitem, (select avg({c}) as m, stddev_pop({c}) as s, var_pop({c}) as v from lineitem)" for c in _NUM))
def outliers_variance(df):
    own = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.var_pop(c).alias("v")) for c in _NUM]).alias("x")).select(F.inline("x"))
    out = aggregates.outliers(df, _NUM, "variance", 1.6)
    return out.join(own, "column").select("column", "method", "outliers", F.round(F.col("variance") / F.col("v"), 6).alias("ratio"), "low_variance")


@query("lineitem", " union all ".join(f"select '{c}' as \"column\", round(var_pop({c}), 2) as variance, coalesce(var_pop({c}) < 1e-8, false) as low_variance from {t}" for c, t in [("l_quantity", "lineitem"), ("l_discount", "lineitem"), ("one", "(select 1.0 as one from lineitem)")]))
def outliers_low_variance(df):
    d = df.select("l_quantity", "l_discount", F.lit(1.0).alias("one"))
    return aggregates.outliers(d, d.columns).select("column", F.round("variance", 2).alias("variance"), "low_variance")


_FIND = "(select c_custkey as id, c_custkey * 2.0 as twice, case when c_custkey % 50 = 0 then 'rare' else 'often' end as flag, 'x' as same, case when c_custkey % 7 = 0 then null else c_nationkey end as nation, case when c_custkey % 100 = 0 then 1000.0 else c_custkey % 3 end as skewed, case when c_custkey % 5 = 0 then 'infinity'::double else 1.0 end as far from customer)"


@query("customer", f"""with d as {_FIND}, n as (select count(*) as n from d) select 'missing' as finding, 'nation' as "column", (count(*) - count(nation))::double as value from d
    union all select 'infinite', 'far', count(*) filter (isinf(far)) from d union all select 'high_cardinality', 'id', count(*) from d union all select 'high_cardinality', 'twice', count(*) from d union all select 'constant', 'same', 1.0
    union all select 'imbalanced', 'flag', round(count(*) filter (flag = 'often') / count(*) filter (flag = 'rare'), 4) from d union all select 'correlated', 'id, twice', 1.0
    union all select 'skewed', 'skewed', round(skewness(skewed), 4) from d union all select 'class_share', flag, round(count(*) / max(n), 4) from d, n group by flag
    union all select 'equals_target', 'again', 1.0""")
def findings_customer(df):
    d = df.selectExpr("c_custkey id", "c_custkey * 2.0D twice", "if(c_custkey % 50 = 0, 'rare', 'often') flag", "'x' same", "if(c_custkey % 7 = 0, null, c_nationkey) nation", "if(c_custkey % 100 = 0, 1000D, double(c_custkey % 3)) skewed", "if(c_custkey % 5 = 0, double('infinity'), 1.0D) far", "if(c_custkey % 50 = 0, 'rare', 'often') again")
    out = aggregates.quality(d, "flag").where("not (finding = 'imbalanced' and column = 'again')")
    return out.select("finding", "column", r(F.col("value").cast("double")).alias("value"))


@query("customer", " union all ".join(["select 'c_name' as \"column\", sum(strlen(c_name))::bigint as bytes from customer", "select 'c_custkey', 8 * count(*) from customer", "select 'c_nationkey', 4 * count(c_nationkey) from customer", "select 'c_acctbal', 8 * count(*) from customer", "select 'c_mktsegment', sum(strlen(c_mktsegment))::bigint from customer"]))
def memory_by_column(df):
    return aggregates.memory(df)


# --- joins


@tables("select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey")
def join_checked_cardinality(spark, d):
    return combine.combine(_t(spark, d, "nation"), _t(spark, d, "region"), "n_regionkey", "r_regionkey", "inner", "many_to_one").select("n_nationkey", "n_name", "r_name")


@tables("select region.r_regionkey, r_name, n from region left join (select n_regionkey as r_regionkey, count(*) as n from nation group by 1) x on x.r_regionkey = region.r_regionkey")
def join_one_to_one(spark, d):
    n = _t(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count(F.lit(1)).alias("n"))
    return combine.combine(_t(spark, d, "region"), n, "r_regionkey", "r_regionkey", "left", "one_to_one")


@tables("""select d.doc_id as sample_id, d.doc_id % 300 as asset_id, l.toxic from documents d join (select distinct doc_id % 300 as asset_id, sha256((doc_id % 300)::varchar) as sha from documents) a on a.asset_id = d.doc_id % 300
    left join (select sha256(doc_id::varchar) as sha, toxic from labels) l using (sha)""")
def catalog_samples(spark, d):
    docs = _t(spark, d, "documents")
    samples = docs.selectExpr("doc_id sample_id", "doc_id % 300 asset_id")
    assets = docs.selectExpr("doc_id % 300 asset_id", "sha2(cast(doc_id % 300 as string), 256) sha256").distinct()
    analysis = _t(spark, d, "labels").selectExpr("sha2(cast(doc_id as string), 256) sha256", "toxic")
    return combine.samples_with_assets(samples, assets, analysis).select("sample_id", "asset_id", "toxic")


@tables("select vec_id as chunk_id, vec_id % 40 as asset_id from embeddings where vec_id % 3 = 0 and vec_id % 40 not in (select vec_id % 40 from embeddings where vec_id % 40 < 5) and vec_id % 40 in (7, 8, 9)")
def catalog_searchable(spark, d):
    e = _t(spark, d, "embeddings")
    rows = e.selectExpr("vec_id chunk_id", "if(vec_id % 3 = 0, 'm1', 'm2') model")
    chunks = e.selectExpr("vec_id chunk_id", "vec_id % 40 asset_id")
    assets = e.selectExpr("vec_id % 40 asset_id", "if(vec_id % 40 < 5, 'excluded', 'active') state").distinct()
    return combine.searchable_chunks(rows, chunks, assets, "m1", [3, 7, 8, 9]).select("chunk_id", "asset_id")


# --- duplicates and leakage

_DIST = "bit_count(xor(('0x' || {a})::ubigint::hugeint, ('0x' || {b})::ubigint::hugeint))"


_with_sql("perceptual_groups", f"""
    with recursive h as ({_PH}), u as (select distinct h, ('0x' || h)::ubigint::hugeint as x from h),
    p as (select a.h as a, b.h as b, bit_count(xor(a.x, b.x)) as d from u a join u b on bit_count(xor(a.x, b.x)) <= 4),
    c(a, b) as (select a, b from p union select c.a, p.b from c join p on c.b = p.a),
    k as (select a as h, min(b) as component from c group by 1), far as (select component, max(d) as d from p join k on k.h = p.a group by 1)
    select doc_id as id, min(doc_id) over (partition by component) as canonical, count(*) over (partition by component) as size, coalesce(d, 0)::bigint as max_distance from h join k using (h) left join far using (component)
    qualify count(*) over (partition by component) > 1""")


@query("documents", f"""with h as ({_PH}), s as (select h, case when doc_id % 3 = 0 then 'test' else 'train' end as s, min(doc_id) as id from h group by all),
    g as (select sha256(text) as g, case when doc_id % 3 = 0 then 'test' else 'train' end as s, min(doc_id) as id from documents group by all),
    e as (select 'exact' as kind, a.id as a, b.id as b from g a join g b on a.g = b.g and a.s < b.s)
    select * from e union all select 'near', least(x.id, y.id), greatest(x.id, y.id) from s x join s y on x.h < y.h and x.s <> y.s and {_DIST.format(a='x.h', b='y.h')} <= 4 where (least(x.id, y.id), greatest(x.id, y.id)) not in (select a, b from e)""")
def leakage_near(df):
    d = df.select("doc_id", F.sha2("text", 256).alias("g"), F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train").alias("split")).join(_hashes(df), "doc_id")
    return groups.leakage(d, "doc_id", "g", "h")


@query("documents", f"""with h as ({_PH}), c as (select distinct h from h where doc_id % 4 = 1), a as (select h, min(doc_id) as id from h where doc_id % 4 <> 1 group by 1)
    select c.h, min(id) as match from c join a on {_DIST.format(a='c.h', b='a.h')} <= 8 group by 1""")
def first_match(df):
    h = _hashes(df)
    return groups.first_match(h.where("doc_id % 4 = 1"), h.where("doc_id % 4 <> 1"), "h", "doc_id")


# --- charts


@query("lineitem", """with q as (select quantile_cont(v, 0.25) as a, quantile_cont(v, 0.75) as b from (select case when l_orderkey % 90 = 0 then l_tax + 9 else l_tax end as v from lineitem))
    select l_orderkey, l_linenumber, v as value from (select l_orderkey, l_linenumber, case when l_orderkey % 90 = 0 then l_tax + 9 else l_tax end as v from lineitem), q where v < a - 1.5 * (b - a) or v > b + 1.5 * (b - a) order by 1, 2 limit 1000""")
def chart_outlier(df):
    d = df.select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 90 == 0, F.col("l_tax") + 9).otherwise(F.col("l_tax")).alias("v"))
    return charts.chart(d, "outlier", "v", order=["l_orderkey", "l_linenumber"])


@query("lineitem", "select l_quantity, l_tax, l_returnflag from lineitem order by l_orderkey, l_linenumber limit 1000")
def chart_scatter(df):
    return charts.chart(df, "scatter", "l_quantity", "l_tax", "l_returnflag", order=["l_orderkey", "l_linenumber"])


@query("customer", "select c_custkey, c_nationkey, c_acctbal from customer order by c_custkey limit 1000")
def chart_pair(df):
    return charts.chart(df, "pair", order=["c_custkey"])


_AT = [(i + 0.5) / 200 for i in range(200)]
_QQ = ", ".join(f"({p}, {NormalDist().inv_cdf(p)!r})" for p in _AT)


@query("events", f"with s as (select unnest({_AT}) as p, unnest(quantile_cont(value, {_AT})) as s from events) select round(t::double, 4) as theoretical, round(s + 1e-6, 4) as sample from (values {_QQ}) z(p, t) join s on s.p::double = z.p::double")
def chart_qq(df):
    return charts.chart(df, "qq", "value").select(r("theoretical").alias("theoretical"), r(F.col("sample") + 1e-6).alias("sample"))


@query("events", """with d as (select value::double as x from events), s as (select count(x) as n, stddev_samp(x) * pow(count(x), -0.2) as bw, min(x) as a, max(x) as b from d),
    h as (select least(floor((x - a) / ((b - a) / 512)), 511) as k, count(*) as n from d, s group by 1), c as (select (a + k * ((b - a) / 512) + a + (k + 1) * ((b - a) / 512)) / 2 as c, h.n as k from h, s),
    g as (select a + i * (b - a) / 99 as x, n, bw from s, (select unnest(range(100)) as i))
    select round(x, 4) as x, round(sum(k * exp(-0.5 * pow((x - c) / bw, 2))) / (max(n) * max(bw) * 2.5066282746310002), 9) as density from g, c group by x""")
def chart_density(df):
    return charts.chart(df, "density", "value").select(r("x").alias("x"), F.round("density", 9).alias("density"))


# --- documents

_W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_VOCAB = f"v as (select w as word, count(*) as df from (select distinct doc_id, unnest({_W}) as w from documents) group by 1 order by df desc, word limit 512)"
_TF = f"tf as (select doc_id, w as word, count(*) as n from (select doc_id, unnest({_W}) as w from documents) where w in (select word from v) group by all)"


@query("documents", f"""with {_VOCAB}, {_TF}, x as (select doc_id, word, (1 + ln(n)) * (ln((1 + (select count(*) from documents)) / (1 + df)) + 1) as w from tf join v using (word))
    select doc_id, word, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from x""")
def tfidf_weights(df):
    return documents.tfidf_vectors(df, documents.tfidf_vocabulary(df), "doc_id").select("doc_id", "word", r("weight", 6).alias("weight"))


@query("documents", f"""with {_VOCAB}, {_TF}, p as (select lang as label, ln(count(*) / sum(count(*)) over ()) as prior from documents group by 1),
    c as (select lang as label, word, sum(n) as n from tf join documents using (doc_id) group by all),
    m as (select label, word, ln((coalesce(n, 0) + 1) / (sum(coalesce(n, 0)) over (partition by label) + count(*) over (partition by label))) as lp, prior from p cross join v left join c using (label, word)),
    s as (select doc_id, label, sum(n * lp) + max(prior) as s from tf join m using (word) group by all), e as (select doc_id, label, exp(s - max(s) over (partition by doc_id)) as e from s),
    q as (select doc_id, label, e / sum(e) over (partition by doc_id) as p from e), b as (select doc_id, arg_max(label, p) as label, max(p) as p from q group by 1), k as (select doc_id, count(*) as known from tf group by 1)
    select doc_id, case when coalesce(known, 0) >= 2 and coalesce(p, 0) >= 0.6 then label else 'und' end as label, round(coalesce(p, 0.0), 4) as p from (select distinct doc_id from documents) left join b using (doc_id) left join k using (doc_id)""")
def bayes_language(df):
    model = documents.bayes_fit(df, "lang", documents.tfidf_vocabulary(df))
    return documents.bayes_classify(df, model, "doc_id").select("doc_id", "label", r("p").alias("p"))


@query("documents", f"""with w as (select doc_id, {_W} as w from documents), f as (select doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from w), n as (select doc_id, f, count(*) as n from f group by all),
    x as (select doc_id, ('0x' || substr(sha256(f), 1, 16))::ubigint % 384 as dim, sum((case when ('0x' || substr(sha256(f), 17, 2))::ubigint % 2 = 1 then 1.0 else -1.0 end) * (1 + ln(n))) as x from n group by all)
    select doc_id, dim::int as dim, round(x / sqrt(sum(x * x) over (partition by doc_id)), 6) + 0 as value from x where abs(x) > 1e-9""")
def hashed_vectors(df):
    v = documents.hashed_vectors(df, "doc_id").select("doc_id", F.posexplode("vector").alias("dim", "x")).where("abs(x) > 1e-9")
    return v.select("doc_id", "dim", (r("x", 6) + 0).alias("value"))


_STOP = " ".join(f"when best = len(list_intersect(w, {ws!r})) then '{lang}'" for lang, ws in documents.FREQUENT.items())
_with_sql("document_language_stopwords", rf"""with w as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}]+')) as w, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_]'))::bigint as tokens from documents),
    b as (select *, greatest({', '.join(f'len(list_intersect(w, {ws!r}))' for ws in documents.FREQUENT.values())}) as best from w) select doc_id, tokens, case when best < 3 then 'und' {_STOP} end as language from b""")


@query("documents", r"""select doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\b\d{2,}\b', '#', 'g'), '[^\S\n]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))) as digest from documents""")
def document_clean(df):
    return documents.clean(df, "text", "NFC", r"\b\d{2,}\b", "#", True).select("doc_id", F.sha2("text", 256).alias("digest"))


_with_sql("markdown_blocks", r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10))))) as line from documents),
    h as (select *, regexp_matches(raw, '^#{1,6}\s+\S') as head, trim(raw) = '' as blank from l),
    s as (select *, head or blank or coalesce(lag(head or blank) over w, true) as starts from h window w as (partition by doc_id order by line)),
    g as (select *, sum(starts::int) over w as g, last_value(case when head then regexp_extract(raw, '^#{1,6}\s+(.*?)\s*#*$', 1) end ignore nulls) over w as heading from s window w as (partition by doc_id order by line)),
    b as (select doc_id, g, min(line) as line, max(heading) as heading, bool_or(head) as head, string_agg(trim(raw), ' ' order by line) as body, min(case when head then length(regexp_extract(raw, '^(#{1,6})', 1)) end) as level from g where not blank group by all)
    select doc_id, row_number() over (partition by doc_id order by line) - 1 as block, case when head then 'heading_' || level else 'paragraph' end as kind, case when head then heading else body end as text, coalesce(heading, '') as heading, line + 1 as line from b""")


@query("documents", r"""with t as (select doc_id, len(regexp_extract_all(regexp_replace(text, '(^|\n)#{1,6}(\s)', '\1\2', 'g'), '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')) as n from documents),
    w as (select doc_id, n, unnest(range(0, greatest(0, ceil((n - 256) / 224.0))::bigint + 1)) as chunk from t where n > 0) select doc_id, chunk, least(256, n - chunk * 224)::bigint as n_tokens from w""")
def chunk_token(df):
    return documents.chunks(df, "doc_id", strategy="token", size=256, overlap=32).select("doc_id", "chunk", "n_tokens")


# --- acquisition


@tables("""with c as (select event_id as id, user_id % 50 as remote, event_id % 400 as page from events where event_id % 2 = 1 and user_id % 50 not in (select user_id % 50 from events where event_id = 0 or event_id = 2) and event_id % 400 not in (select event_id % 400 from events where event_id in (0, 2))),
    a as (select *, row_number() over (partition by remote order by id) as k from c), b as (select *, row_number() over (partition by page order by id) as j from a where k = 1) select id as candidate_id from b where j = 1""")
def discover_new(spark, d):
    e = _t(spark, d, "events").selectExpr("event_id candidate_id", "1 run_id", "'p' provider", "cast(user_id % 50 as string) remote_id", "cast(event_id % 400 as string) canonical_url")
    return acquisition.discover(e.where("candidate_id in (0, 2)"), e.where("candidate_id % 2 = 1"), "candidate_id").select("candidate_id")


@query("part", "with w as (select p_partkey, round(least(1.0, len(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda x: length(x) > 2)), ['red', 'ring']))::double / 2), 4) as s from part) select p_partkey, case when s >= 0.9 then 'accept' when s >= 0.4 then 'review' else 'reject' end as state from w")
def relevance_states(df):
    return df.select("p_partkey", acquisition.relevance_state(F.col("p_name"), F.array(F.lit("red"), F.lit("ring")), 0.9, 0.4).alias("state"))


@query("part", """select p_partkey, trim(regexp_replace(regexp_replace('<b>' || p_name || '</b>   x', '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) as title from part where p_partkey % 3 <> 0 and p_partkey % 4 <> 1""")
def provider_results(df):
    raw = df.selectExpr("p_partkey", "concat('<b>', p_name, '</b>   x') title", "cast(null as string) description", "if(p_partkey % 3 = 0, 'http://a.org/1', 'HTTPS://a.org/1') url", "if(p_partkey % 4 = 1, 'text/html', 'image/png') mime")
    return acquisition.normalise_results(raw).select("p_partkey", "title")


@query("part", "select distinct trim(x) as url from (select unnest(string_split(replace(p_name || ', https://a.org/' || (p_partkey % 7) || chr(10) || ',', chr(10), ','), ',')) as x from part) where trim(x) <> ''")
def direct_urls(df):
    return acquisition.direct_urls(df.selectExpr("concat(p_name, ', https://a.org/', p_partkey % 7, '\n', ',') t"), "t")


@query("nation", "select n_nationkey as query_id, row_number() over (order by n_regionkey desc, n_nationkey % 2 desc, n_nationkey) - 1 as place from nation where n_nationkey % 5 <> 0")
def runnable_queries(df):
    q = df.selectExpr("n_nationkey query_id", "n_nationkey % 5 = 0 exhausted", "n_regionkey priority", "n_nationkey % 2 accepted", "n_nationkey created_at")
    return acquisition.runnable(q).select("query_id", "place")


_CAND = "select event_id as candidate_id, user_id % 20 as query_id, ['discovered', 'failed', 'downloading', 'accepted', 'evaluating'][(event_id % 5 + 1)::int] as state, event_id % 4 as attempts, event_id % 3 as bytes, ts as discovered_at from events"


def _cands(df: DataFrame) -> DataFrame:
    states = F.array(*map(F.lit, ("discovered", "failed", "downloading", "accepted", "evaluating")))
    return df.select(F.col("event_id").alias("candidate_id"), (F.col("user_id") % 20).alias("query_id"), F.get(states, (F.col("event_id") % 5).cast("int")).alias("state"), (F.col("event_id") % 4).alias("attempts"), (F.col("event_id") % 3).alias("bytes"), F.col("ts").alias("discovered_at"))


@query("events", f"with c as ({_CAND}) select candidate_id, query_id, query_id::varchar as text from c where state = 'discovered' or state = 'failed' and attempts < 3 order by discovered_at, candidate_id limit 64")
def pending_candidates(df):
    c = _cands(df)
    q = c.select("query_id").distinct().withColumn("text", F.col("query_id").cast("string"))
    return acquisition.pending(c, q, 64).select("candidate_id", "query_id", "text")


@query("events", _union(
    recovered=f"with c as ({_CAND}) select candidate_id, case when state in ('downloading', 'evaluating') then case when bytes > 0 then 'failed' else 'discovered' end else state end as state from c",
    given_up=f"with c as ({_CAND}) select candidate_id, 'download_failed' as state from c where state = 'failed' and attempts >= 3",
))
def recovered_candidates(df):
    c = _cands(df)
    return _tagged(recovered=acquisition.recovered(c).select("candidate_id", "state"), given_up=acquisition.given_up(c).withColumnRenamed("reason", "state"))


@query("events", f"""with c as ({_CAND}), p as (select * from c where state = 'accepted' order by discovered_at, candidate_id limit 30 offset 30), d as (select event_id as decision_id, (event_id - event_id % 5 + 3) as candidate_id from events)
    select candidate_id, query_id, (select count(*) from d where d.candidate_id = p.candidate_id) as decisions, (select min(decision_id) from d where d.candidate_id = p.candidate_id) as first from p""")
def review_page(df):
    c = _cands(df)
    d = df.selectExpr("event_id decision_id", "event_id - event_id % 5 + 3 candidate_id", "ts decided_at", "'review' state")
    q = c.select("query_id").distinct()
    return acquisition.review_page(c, d, q, "accepted", 1, 30).select("candidate_id", "query_id", F.size("decisions").cast("long").alias("decisions"), F.get("decisions", F.lit(0))["decision_id"].alias("first"))


@query("events", """with h as (select event_id % 60 as asset_id, arg_max(case when event_id % 7 < 3 then 'accept' else 'reject' end, event_id) as s from events where event_id % 60 < 40 group by 1)
    select a.asset_id, case s when 'accept' then 'active' when 'reject' then 'excluded' else 'quarantined' end as state from (select distinct event_id % 60 as asset_id from events) a left join h using (asset_id)""")
def asset_states(df):
    assets = df.selectExpr("event_id % 60 asset_id", "'quarantined' state").distinct()
    human = df.where("event_id % 60 < 40").selectExpr("event_id % 60 asset_id", "event_id decision_id", "1 decided_at", "if(event_id % 7 < 3, 'accept', 'reject') decision")
    return acquisition.asset_states(assets, human)


@tables("""with c as (select o_custkey % 4 as run_id, ['accepted', 'rejected', 'review'][(o_orderkey % 3 + 1)::int] as state from orders) select n_nationkey as run_id, n_name as plan, coalesce(a, 0) as accepted, coalesce(e, 0) as evaluated from nation left join
    (select run_id, count(*) filter (state = 'accepted') as a, count(*) as e from c group by 1) x on x.run_id = n_nationkey""")
def runs_with_counters(spark, d):
    n = _t(spark, d, "nation")
    c = _t(spark, d, "orders").selectExpr("o_custkey % 4 run_id", "element_at(array('accepted', 'rejected', 'review'), int(o_orderkey % 3) + 1) state", "1L bytes")
    out = acquisition.runs_with_counters(n.selectExpr("n_nationkey run_id", "n_nationkey plan_id"), n.selectExpr("n_nationkey plan_id", "n_name plan"), c)
    return out.select("run_id", "plan", F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("evaluated", F.lit(0)).alias("evaluated"))


@query("orders", """with i as (select o_custkey % 9 as job_id, o_orderkey as item_id, ['pending', 'running', 'completed', 'failed', 'skipped'][(o_orderkey % 5 + 1)::int] as s from orders)
    select job_id, count(*) filter (s = 'pending') as pending, count(*) filter (s = 'running') as running, count(*) filter (s = 'completed') as completed, count(*) filter (s = 'failed') as failed, count(*) filter (s = 'skipped') as skipped, count(*) as total,
    max(item_id) filter (s in ('completed', 'failed', 'skipped')) as checkpoint, round(100.0::double * count(*) filter (s in ('completed', 'failed', 'skipped')) / count(*), 2) as percent from i group by 1""")
def job_progress(df):
    return aggregates.job_progress(df.selectExpr("o_custkey % 9 job_id", "o_orderkey item_id", "element_at(array('pending', 'running', 'completed', 'failed', 'skipped'), int(o_orderkey % 5) + 1) state"))


@query("documents", "select count(*) as documents, sum(doc_id % 7)::bigint as chunks, max(case when doc_id % 2 = 0 then 384 else 128 end) as dimensions, max('m' || doc_id % 3) as model from documents")
def document_stats(df):
    return aggregates.document_stats(df.selectExpr("doc_id % 7 chunks", "if(doc_id % 2 = 0, 384, 128) dimensions", "concat('m', doc_id % 3) model"))


@query("documents", "select lang as kind, count(*) as objects, sum(n_chars)::bigint as bytes from documents group by 1")
def storage_inventory(df):
    return aggregates.storage_inventory(df.selectExpr("lang media_type", "n_chars size"))


# --- preparation


@query("customer", """with d as (select c_custkey, case when c_custkey % 11 = 0 then null else c_acctbal end as n, case when c_custkey % 13 = 0 then null else c_mktsegment end as s, case when c_custkey % 4 = 0 then 'test' else 'train' end as _split, c_custkey % 4 = 0 and c_custkey % 8 = 0 as odd from customer),
    m as (select median(n) as m, stddev_pop(coalesce(n, (select median(n) from d where _split = 'train'))) as s, avg(coalesce(n, (select median(n) from d where _split = 'train'))) as a from d where _split = 'train')
    select c_custkey, (n is null)::int as n_missing, round((coalesce(n, m) - a) / m.s, 4) as n, coalesce(not odd and d.s = 'BUILDING', false)::int as s_building, coalesce(not odd and d.s = 'MACHINERY', false)::int as s_machinery, (d.s is null and not odd)::int as s_nan from d, m""")
def preprocess_categories(df):
    d = df.selectExpr("c_custkey", "if(c_custkey % 11 = 0, null, c_acctbal) n", "if(c_custkey % 8 = 0, 'UNSEEN', if(c_custkey % 13 = 0, null, c_mktsegment)) s", "if(c_custkey % 4 = 0, 'test', 'train') _split")
    out = prepare.preprocess(d, ["n"], ["s"])
    missing = F.when(F.expr("c_custkey % 13 = 0 and c_custkey % 8 <> 0"), 1).otherwise(0)
    return out.select("c_custkey", "n_missing", r("n").alias("n"), F.col("s_BUILDING").alias("s_building"), F.col("s_MACHINERY").alias("s_machinery"), missing.alias("s_nan"))


_SHARES = {"train": 0.7, "validation": 0.2, "test": 0.1}


@query("customer", """with n as (select c_mktsegment as label, count(*) as n from customer group by 1), s as (select * from (values ('train', 0, 0.7::double), ('validation', 1, 0.2::double), ('test', 2, 0.1::double)) t(split, i, share)),
    w as (select label, split, i, n, floor(n * share + 1e-9)::bigint as w, round(n * share - floor(n * share + 1e-9), 9) as f from n cross join s), k as (select *, row_number() over (partition by label order by f desc, i) as k, sum(w) over (partition by label) as whole from w)
    select label, split, w + case when k <= n - whole then 1 else 0 end as n from k where w + case when k <= n - whole then 1 else 0 end > 0""")
def assign_stratified(df):
    out = prepare.assign_splits(df, "c_custkey", _SHARES, "stratified", "c_mktsegment")
    return out.groupBy(F.col("c_mktsegment").alias("label"), "split").agg(F.count(F.lit(1)).alias("n"))


@query("customer", "select c_custkey, case when c_custkey < 100 then case when c_custkey % 2 = 0 then 'train' else 'test' end end as split from customer")
def assign_manual(df):
    manual = df.where("c_custkey < 100").selectExpr("c_custkey", "if(c_custkey % 2 = 0, 'train', 'test') split")
    return prepare.assign_splits(df, "c_custkey", {}, "manual", manual=manual).select("c_custkey", "split")


@query("customer", "select count(distinct c_nationkey) as groups, 0::bigint as crossing, count(*) as n from customer")
def assign_groups(df):
    out = prepare.assign_splits(df, "c_custkey", _SHARES, "group", "c_nationkey").groupBy("c_nationkey").agg(F.count_distinct("split").alias("k"), F.count(F.lit(1)).alias("n"))
    return out.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("k") > 1).alias("crossing"), F.sum("n").alias("n"))


# --- media


@query("events", """select event_id, case when event_id % 3 = 0 then 'video' when event_id % 3 = 1 then 'audio' else 'unknown' end as kind, (event_id % 50)::double as duration, case when event_id % 3 = 0 then 640 end as width,
    least(1000, ceil((event_id % 50) / 7.0))::bigint as frames, ceil((event_id % 50) / 20.0)::bigint as segments from events""")
def media_probe(df):
    probe = F.concat(
        F.lit('{"format": {"duration": "'), F.col("event_id") % 50, F.lit('", "size": "1"}, "streams": ['),
        F.expr("""case when event_id % 3 = 0 then '{"codec_type": "audio", "codec_name": "aac"}, {"codec_type": "video", "codec_name": "h264", "width": 640, "height": 360}' when event_id % 3 = 1 then '{"codec_type": "audio", "codec_name": "mp3"}' else '' end"""),
        F.lit("]}"),
    )
    d = media.probe_rows(df.select("event_id", probe.alias("probe")))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    count = lambda c: F.when(c.isNull(), 0).otherwise(size(c)).cast("long")
    return d.select("event_id", "kind", "duration", "width", count(media.frame_times(F.col("duration"), 7.0)).alias("frames"), count(media.segments(F.col("duration"), 20.0)).alias("segments"))


@query("part", """select p_partkey, case when p_size * p_size * 10000 < 65536 then 'tiny' when p_size * p_size * 10000 < 307200 then 'small' when p_size * p_size * 10000 < 2073600 then 'medium' when p_size * p_size * 10000 < 8294400 then 'large' else 'huge' end as bucket,
    round(least(100.0, 25 * log10(1 + p_retailprice)), 4) as quality from part""")
def image_quality(df):
    return df.select("p_partkey", media.size_bucket(F.col("p_size") * 100, F.col("p_size") * 100).alias("bucket"), r(media.quality_of(F.col("p_retailprice"))).alias("quality"))


# --- files


def _folder(df: DataFrame) -> str:
    """A new folder among the checkpoints, which every machine sees."""
    cut(df.limit(0))
    return f"{df.sparkSession.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


def _round_trip(df: DataFrame, fmt: str) -> DataFrame:
    path = _folder(df)
    writers.export(df, path, fmt)
    return readers.read_table(df.sparkSession, path, fmt)


_FILES = "select c_custkey, c_name || ', \"' || c_mktsegment || '\"' as name, c_acctbal, case when c_custkey % 9 = 0 then null else c_nationkey end as nation from customer"


@query("customer", _union(csv=_FILES, tsv=_FILES, jsonl=_FILES, parquet=_FILES))
def files_round_trip(df):
    d = df.selectExpr("c_custkey", "concat(c_name, ', \"', c_mktsegment, '\"') name", "c_acctbal", "if(c_custkey % 9 = 0, null, c_nationkey) nation")
    kinds = {"c_custkey": "long", "c_acctbal": "double", "nation": "int"}
    return _tagged(**{f: _round_trip(d, f).select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in d.columns]) for f in ("csv", "tsv", "jsonl", "parquet")})


@query("documents", "select doc_id % 50 as asset_id, case when doc_id % 50 < 10 then 'new' else 'old' end as state, count(*) as n from documents group by all")
def index_replaced(df):
    path = _folder(df)
    d = df.selectExpr("doc_id % 50 asset_id", "doc_id chunk_id")
    writers.replace_index(d.withColumn("state", F.lit("old")), path)
    writers.replace_index(d.where("asset_id < 10").withColumn("state", F.lit("new")), path)
    return df.sparkSession.read.parquet(path).groupBy(F.col("asset_id").cast("long").alias("asset_id"), "state").agg(F.count(F.lit(1)).alias("n"))


@query("pages", "select page_id from pages where (regexp_matches(url, '\\.com/.*en/.*$') or regexp_matches(url, '/[0-7]\\d\\d')) and not regexp_matches(url, 'ref=') and length(html) <= 6000")
def provider_files(df):
    d = df.selectExpr("page_id", "url path", "length(html) size", "page_id position")
    return readers.filter_files(d, ["*.com/*en/*", "*/[0-7][0-9][0-9]*"], ["*ref=*"], 6000).select("page_id")


@query("supplier", """
    with recursive c as (
        select s_suppkey as k, row_number() over (order by s_suppkey) as pos, case when s_suppkey % 4 = 0 then null else (s_suppkey * 7919) % 100 + 1 end as declared,
            case when s_suppkey % 9 = 0 then null else (s_suppkey * 7919) % 100 + 1 + s_suppkey % 3 end as actual, s_suppkey % 7 = 0 as other from supplier where s_suppkey % 10 <> 5
    ), s as (select coalesce(sum(10), 0)::bigint as used from supplier where s_suppkey % 10 = 5),
    r(pos, before, after_) as (
        select 0::bigint, 1500 - used, 1500 - used from s
        union all
        select c.pos, after_, after_ - case when actual is null or actual > 95 or other or greatest(coalesce(declared, 0), actual) > after_ then 0 else actual end from r join c on c.pos = r.pos + 1
    ), o as (
        select k, case when declared > before or actual <= 95 and actual > before then 'total_byte_limit' when actual is null then 'download_failed' when actual > 95 then 'file_too_large' when other then 'checksum_mismatch' end as reason, actual from c join r using (pos)
    )
    select k as path, case when reason is null then 'completed' when reason = 'total_byte_limit' then 'skipped' else 'failed' end as state, reason, case when reason is null then actual end as bytes from o
    union all select s_suppkey, 'completed', null, 10 from supplier where s_suppkey % 10 = 5
""")
def provider_imports(df):
    files = df.selectExpr("lpad(s_suppkey, 12, '0') path", "if(s_suppkey % 4 = 0, null, (s_suppkey * 7919) % 100 + 1) byte_size", "'a' expected_sha256")
    fetched = df.where("s_suppkey % 9 <> 0").selectExpr("lpad(s_suppkey, 12, '0') path", "(s_suppkey * 7919) % 100 + 1 + s_suppkey % 3 actual_size", "if(s_suppkey % 7 = 0, 'b', 'a') sha256")
    done = df.where("s_suppkey % 10 = 5").selectExpr("lpad(s_suppkey, 12, '0') path", "10L bytes", "'a' sha256")
    out = acquisition.provider_import(files, fetched, 1500, 95, done)
    return out.select(F.col("path").cast("long").alias("path"), "state", "reason", "bytes")


@query("documents", "select sha256(text) as sha256, count(*) as copies, 'objects/sha256/' || substr(sha256(text), 1, 2) || '/' || sha256(text) as key, min(doc_id) as path from documents group by 1")
def assets_stored_once(df):
    d = readers.unique_assets(df.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("size"), F.lit("text/plain").alias("media_type")))
    return d.select("sha256", "copies", F.col("object_key").alias("key"), F.col("path").cast("long").alias("path"))


@query("documents", "select doc_id, doc_id - doc_id % 97 as entry_of, true as same from documents where text <> ''")
def zip_entries(df):
    """Documents in archives of up to 97 entries, expanded again; digests are compared with those of the texts."""
    import io
    import zipfile

    import pandas as pd

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for i, t in sorted(zip(p["doc_id"], p["text"], strict=True)):
                z.writestr(f"{i}.txt", t)
        return pd.DataFrame({"path": [str(p["doc_id"].min() - p["doc_id"].min() % 97)], "content": [raw.getvalue()]})

    d = df.where("text <> ''").select("doc_id", "text", (F.col("doc_id") - F.col("doc_id") % 97).alias("g"))
    found = readers.expand_zip(d.groupBy("g").applyInPandas(pack, "path string, content binary"))
    found = found.where("skipped is null").selectExpr("cast(split(entry, '[.]')[0] as bigint) doc_id", "cast(path as bigint) entry_of", "sha256")
    return found.join(d.select("doc_id", F.sha2("text", 256).alias("own")), "doc_id").select("doc_id", "entry_of", (F.col("sha256") == F.col("own")).alias("same"))
