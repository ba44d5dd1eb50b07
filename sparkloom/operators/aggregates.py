"""Aggregation, statistics, profiles, outliers, quality and contracts. Reports are frames in long form."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import floating, is_numeric, missing_as_null, need, numeric_columns, one_of, quantile_row, strip
from ..plans.errors import ParameterError
from .cleaning import comparable
from .quantiles import grouped_quantiles
from .reshape import text_of

AGGREGATIONS = ("sum", "mean", "median", "min", "max", "count", "nunique", "std")


def _agg(how: str, c: str) -> Column:
    x = F.col(f"`{c}`")
    return {
        "sum": lambda: F.coalesce(F.sum(x), F.lit(0)), "mean": lambda: F.avg(x), "min": lambda: F.min(x), "max": lambda: F.max(x),
        "count": lambda: F.count(x), "nunique": lambda: F.count_distinct(x), "std": lambda: F.stddev_samp(x),
    }[how]()


def aggregate(df: DataFrame, by: list[str], values: list[str], how: str = "sum") -> DataFrame:
    """by columns (missing is a group) and one aggregate of each value column; a sum without values is 0."""
    one_of(how, AGGREGATIONS, "aggregation")
    need(df, *by, *values)
    values = [v for v in values if v not in by]
    d = missing_as_null(df)
    if how == "median":
        q = grouped_quantiles(d, by, {v: F.col(f"`{v}`") for v in values}, [0.5])
        return q.select(*[F.col(f"`{b}`") for b in by], *[F.col(f"`{v}`")[0].alias(v) for v in values])
    return d.groupBy(*[F.col(f"`{b}`") for b in by]).agg(*[_agg(how, v).alias(v) for v in values])


def null_counts(df: DataFrame) -> DataFrame:
    """column, missing: one pass for all columns."""
    d = missing_as_null(df)
    one = d.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return one.unpivot([], [F.col(f"`{c}`") for c in df.columns], "column", "missing")


def describe(df: DataFrame) -> DataFrame:
    """column, count, unique, top, freq, mean, std, min, q25, q50, q75, max: one pass for moments, one for quartiles."""
    d, nums = missing_as_null(df), numeric_columns(df)
    if nums:
        d = d.crossJoin(F.broadcast(quantile_row(d, {f"__q{i}": F.col(f"`{c}`") for i, c in enumerate(nums)}, [0.25, 0.5, 0.75])))  # one row
    rows = []
    for c in df.columns:
        x = F.col(f"`{c}`")
        base = [F.lit(c).alias("column"), F.count(x).alias("count"), F.count_distinct(x).alias("unique")]
        if is_numeric(df, c):
            q = F.first(f"__q{nums.index(c)}")
            rest = [F.lit(None).cast("string").alias("top"), F.lit(None).cast("long").alias("freq"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).cast("double").alias("min"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), F.max(x).cast("double").alias("max")]
        else:
            top = F.mode(x.cast("string"), True)
            rest = [top.alias("top"), F.lit(None).cast("long").alias("freq"), *[F.lit(None).cast("double").alias(k) for k in ("mean", "std", "min", "q25", "q50", "q75", "max")]]
        rows.append(F.struct(*base, *rest))
    one = d.agg(F.array(*rows).alias("r"))
    return one.select(F.inline("r"))


def covariance(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """a, b, covariance of pairs of numeric columns (sample)."""
    cols = columns or numeric_columns(df)
    d = missing_as_null(df)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    return d.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.covar_samp(f"`{a}`", f"`{b}`").alias("covariance")) for a, b in pairs]).alias("r")).select(F.inline("r"))


QUANTILES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)


def quantiles(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, quantile, value: exact and interpolated."""
    cols = columns or numeric_columns(df)
    one = quantile_row(missing_as_null(df), {c: F.col(f"`{c}`") for c in cols}, list(QUANTILES))
    at = F.array(*map(F.lit, QUANTILES))
    row = lambda c: lambda x: F.struct(F.lit(c).alias("column"), x["q"].alias("quantile"), x["v"].alias("value"))
    parts = [F.transform(F.arrays_zip(at.alias("q"), F.col(f"`{c}`").alias("v")), row(c)) for c in cols]
    return one.select(F.inline(F.flatten(F.array(*parts))))


def value_frequencies(df: DataFrame, columns: list[str], top: int = 500) -> DataFrame:
    """column, value, n: the most frequent texts of each column, missing as <NA>."""
    need(df, *columns)
    d = missing_as_null(df).select(*[F.coalesce(text_of(df, c), F.lit("<NA>")).alias(c) for c in columns])
    long = d.unpivot([], [F.col(f"`{c}`") for c in columns], "column", "value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return long.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).drop("r")


def correlation(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """a, b, correlation (Pearson) of 2 to 60 numeric columns; missing where a column is constant."""
    cols = columns or numeric_columns(df, ["_split"])
    if not 2 <= len(cols) <= 60:
        raise ParameterError("2 to 60 numeric columns")
    return missing_as_null(df).agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), _corr(a, b).alias("correlation")) for a in cols for b in cols]).alias("r")).select(F.inline("r"))


def _corr(a: str, b: str) -> Column:
    both = F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()
    x, y = (F.when(both, floating(F.col(f"`{c}`"))) for c in (a, b))
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def skewness(c: str) -> Column:
    """Adjusted Fisher-Pearson skewness."""
    x = F.col(f"`{c}`").cast("double")
    n = F.count(x).cast("double")
    return F.when((n > 2) & (F.stddev_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def distribution(df: DataFrame, column: str, bins: int = 20, top: int = 50) -> DataFrame:
    """label, low, high, n: a histogram of a number with more than `bins` values, else the most frequent values."""
    need(df, column)
    d = missing_as_null(df)
    few = d.select(F.col(f"`{column}`")).na.drop().distinct().limit(bins + 1).count() <= bins
    if is_numeric(df, column) and not few:
        from .charts import histogram

        h = histogram(d, column, bins)
        return h.select(F.concat_ws("..", F.col("low").cast("string"), F.col("high").cast("string")).alias("label"), "low", "high", "n")
    f = d.groupBy(F.coalesce(text_of(df, column), F.lit("<NA>")).alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(top)
    return f.select("label", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), "n")


def outliers(df: DataFrame, columns: list[str], method: str = "iqr", threshold: float = 3.0) -> DataFrame:
    """column, method, outliers, variance (population), low_variance.

    iqr: beyond 1.5 interquartile ranges. zscore and variance: further from the mean than threshold deviations.
    """
    one_of(method, ("iqr", "zscore", "variance"), "method")
    need(df, *columns)
    d = missing_as_null(df)
    stats = d.agg(*[F.struct(F.avg(f"`{c}`").alias("mean"), F.stddev_pop(f"`{c}`").alias("sd")).alias(f"__s{i}") for i, c in enumerate(columns)])
    d = d.crossJoin(F.broadcast(stats))  # one row
    if method == "iqr":
        d = d.crossJoin(F.broadcast(quantile_row(d, {f"__q{i}": F.col(f"`{c}`") for i, c in enumerate(columns)}, [0.25, 0.75])))  # one row
    out = []
    for i, c in enumerate(columns):
        x, s = F.col(f"`{c}`").cast("double"), F.col(f"__s{i}")
        if method == "iqr":
            q = F.col(f"__q{i}")
            reach = 1.5 * (q[1] - q[0])
            odd = (x < q[0] - reach) | (x > q[1] + reach)
        else:
            odd = F.abs(x - s["mean"]) / F.coalesce(F.nullif(s["sd"], F.lit(0.0)), F.lit(1.0)) > threshold
        v = F.var_pop(x)
        out.append(F.struct(F.lit(c).alias("column"), F.lit(method).alias("method"), F.count_if(odd).alias("outliers"), v.alias("variance"), F.coalesce(v < 1e-8, F.lit(False)).alias("low_variance")))
    return d.agg(F.array(*out).alias("r")).select(F.inline("r"))


def import_profile(df: DataFrame, top: int = 10, few: int = 100) -> DataFrame:
    """column, type, missing, distinct, min, max (text), mean, values: one pass; values where at most `few` are distinct."""
    aggs = []
    for c in df.columns:
        x, t = F.col(f"`{c}`"), df.schema[c].dataType.simpleString()
        mean = F.avg(x).cast("double") if is_numeric(df, c) else F.lit(None).cast("double")
        aggs.append(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.count_if(x.isNull()).alias("missing"), F.count_distinct(x).alias("distinct"), F.min(x).cast("string").alias("min"), F.max(x).cast("string").alias("max"), mean.alias("mean")))
    base = df.agg(F.array(*aggs).alias("r")).select(F.inline("r"))
    values = value_frequencies(df, df.columns, top).groupBy("column").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "value"))).alias("v"))
    shown = F.transform("v", lambda x: F.struct(x["value"].alias("value"), (-x["n"]).alias("n")))
    return base.join(F.broadcast(values), "column", "left").select(*base.columns, F.when(F.col("distinct") <= few, shown).alias("values"))


def column_profile(df: DataFrame) -> DataFrame:
    """column, type, rows, missing, unique, mean, median, std, min, max, skew, outliers, infinite; finite values only."""
    d, quarts = missing_as_null(df), []
    nums = numeric_columns(df)
    finite = {c: F.when(F.abs(F.col(f"`{c}`").cast("double")) < float("inf"), F.col(f"`{c}`").cast("double")) for c in nums}
    q = quantile_row(d, {f"__q{i}": finite[c] for i, c in enumerate(nums)}, [0.25, 0.5, 0.75]) if nums else None
    if q is not None:
        d = d.crossJoin(F.broadcast(q))  # one row
    for c in df.columns:
        x = F.col(f"`{c}`")
        base = [F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type"), F.count(F.lit(1)).alias("rows"), F.count_if(x.isNull()).alias("missing"), F.count_distinct(comparable(df, c)).alias("unique")]
        if c in nums:
            v, b = finite[c], F.col(f"__q{nums.index(c)}")
            reach = 1.5 * (b[2] - b[0])
            n = F.count(v).cast("double")
            skew = F.when((n > 2) & (F.stddev_pop(v) > 0), F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2))
            rest = [F.avg(v).alias("mean"), F.first(b[1]).alias("median"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), skew.alias("skew"), F.count_if((v < b[0] - reach) | (v > b[2] + reach)).alias("outliers"), F.count_if(F.abs(x.cast("double")) == float("inf")).alias("infinite")]
        else:
            rest = [*[F.lit(None).cast("double").alias(k) for k in ("mean", "median", "std", "min", "max", "skew")], F.lit(0).cast("long").alias("outliers"), F.lit(0).cast("long").alias("infinite")]
        quarts.append(F.struct(*base, *rest))
    return d.agg(F.array(*quarts).alias("r")).select(F.inline("r"))


def findings(df: DataFrame, unique_share: float = 0.8) -> DataFrame:
    """finding, column, value: what a person should look at.

    missing and infinite values, |skew| > 1, class imbalance over 4 (2 to 30 values), over 100 unique values that are over
    unique_share of the rows, constants, repeated rows, |correlation| > 0.95, and equal rows in different splits.
    """
    p = column_profile(df)
    parts = [
        p.where("missing > 0").select(F.lit("missing").alias("finding"), "column", F.col("missing").cast("double").alias("value")),
        p.where("infinite > 0").select(F.lit("infinite"), "column", F.col("infinite").cast("double")),
        p.where("abs(skew) > 1").select(F.lit("skewed"), "column", "skew"),
        p.where((F.col("unique") > 100) & (F.col("unique") > unique_share * F.col("rows"))).select(F.lit("high_cardinality"), "column", F.col("unique").cast("double")),
        p.where("unique <= 1").select(F.lit("constant"), "column", F.col("unique").cast("double")),
    ]
    d = missing_as_null(df)
    texts = [c for c in df.columns if not is_numeric(df, c) and c != "_split"]
    if texts:
        f = d.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in texts]).unpivot([], [F.col(f"`{c}`") for c in texts], "column", "v").na.drop()
        f = f.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n")).groupBy("column").agg(F.count(F.lit(1)).alias("k"), (F.max("n") / F.min("n")).alias("value"))
        parts.append(f.where("k between 2 and 30 and value > 4").select(F.lit("imbalanced"), "column", "value"))
    keys = [comparable(df, c) for c in df.columns]
    dup = d.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("value"))
    parts.append(dup.where("value > 0").select(F.lit("duplicate_rows"), F.lit(None).cast("string"), F.col("value").cast("double")))
    nums = numeric_columns(df, ["_split"])
    if 2 <= len(nums) <= 60:
        c = d.agg(F.array(*[F.struct(F.lit(f"{a}, {b}").alias("column"), _corr(a, b).alias("value")) for a, b in combinations(nums, 2)]).alias("r")).select(F.inline("r"))
        parts.append(c.where("not isnan(value) and abs(value) > 0.95").select(F.lit("correlated"), "column", "value"))
    if "_split" in df.columns:
        own = [k.alias(f"k{i}") for i, (k, c) in enumerate(zip(keys, df.columns, strict=True)) if c != "_split"]
        s = d.groupBy(*own).agg(F.count_distinct("_split").alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("value"))
        parts.append(s.where("value > 0").select(F.lit("split_overlap"), F.lit("_split"), F.col("value").cast("double")))
    return reduce(DataFrame.union, parts)


def quality(df: DataFrame, target: str | None = None, group: str | None = None, unique_share: float = 0.8) -> DataFrame:
    """findings, and with a target its class proportions and columns equal to it, with a group those crossing splits."""
    out = findings(df, unique_share)
    d = missing_as_null(df)
    if target:
        need(df, target)
        n = d.agg(F.count(F.lit(1)).alias("__n"))
        p = d.groupBy(F.coalesce(text_of(df, target), F.lit("<NA>")).alias("column")).agg(F.count(F.lit(1)).alias("k")).crossJoin(F.broadcast(n))  # one row
        out = out.union(p.select(F.lit("class_share"), "column", (F.col("k") / F.col("__n")).cast("double")))
        others = [c for c in df.columns if c != target]
        same = d.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.bool_and(F.col(f"`{c}`").cast("string").eqNullSafe(F.col(f"`{target}`").cast("string"))).alias("same")) for c in others]).alias("r")).select(F.inline("r"))
        out = out.union(same.where("same").select(F.lit("equals_target"), "column", F.lit(1.0)))
    if group and "_split" in df.columns:
        g = d.groupBy(f"`{group}`").agg(F.count_distinct("_split").alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("value"))
        out = out.union(g.where("value > 0").select(F.lit("group_crosses_splits"), F.lit(group), F.col("value").cast("double")))
    return out


RULES = ("required", "unique", "numeric", "minimum", "maximum", "allowed")


def _failed(df: DataFrame, rule: dict) -> Column:
    kind, c = one_of(rule["rule"], RULES, "rule"), F.col(f"`{rule['column']}`")
    need(df, rule["column"])
    value = c.cast("double") if is_numeric(df, rule["column"]) else F.expr(f"try_cast(trim(cast(`{rule['column']}` as string)) as double)")
    match kind:
        case "required":
            return c.isNull() | (strip(c) == "")
        case "unique":
            return F.col(f"__times_{rule['column']}") > 1
        case "numeric":
            return c.isNotNull() & value.isNull()
        case "minimum":
            return c.isNotNull() & (value.isNull() | (value < float(rule["value"])))
        case "maximum":
            return c.isNotNull() & (value.isNull() | (value > float(rule["value"])))
    names = [x.strip() for x in rule["value"].split(",")] if isinstance(rule["value"], str) else [str(x) for x in rule["value"]]
    return c.isNotNull() & ~strip(c).isin(names)


def contract(df: DataFrame, rules: list[dict[str, Any]]) -> tuple[DataFrame, DataFrame]:
    """(rule, column, failed rows of each rule and overall; failing rows with the numbers of the rules they break)."""
    d = missing_as_null(df)
    for c in {r["column"] for r in rules if r["rule"] == "unique"}:
        need(df, c)
        # counted and joined back: a value that fills the column (missing ones, say) meets in no task
        times = d.groupBy(F.col(f"`{c}`").alias("__value")).agg(F.count(F.lit(1)).alias(f"__times_{c}"))
        d = d.join(times, F.col(f"`{c}`").eqNullSafe(F.col("__value"))).drop("__value")
    flags = d.withColumns({f"__f{i}": F.coalesce(_failed(d, r), F.lit(False)) for i, r in enumerate(rules)})
    broken = F.filter(F.array(*[F.when(F.col(f"__f{i}"), F.lit(i)) for i in range(len(rules))]), lambda x: x.isNotNull())
    marked = flags.withColumn("broken_rules", broken)
    parts = [F.struct(F.lit(r["rule"]).alias("rule"), F.lit(r["column"]).alias("column"), F.count_if(F.col(f"__f{i}")).alias("failed")) for i, r in enumerate(rules)]
    parts.append(F.struct(F.lit("any").alias("rule"), F.lit("*").alias("column"), F.count_if(F.size("broken_rules") > 0).alias("failed")))
    report = marked.agg(F.array(*parts).alias("r")).select(F.inline("r"))
    return report, marked.where(F.size("broken_rules") > 0).select(*[F.col(f"`{c}`") for c in df.columns], "broken_rules")


def memory(df: DataFrame) -> DataFrame:
    """column, bytes: what the values take (text by its UTF-8 bytes, numbers by their width, missing ones nothing)."""
    width = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
    sums = []
    for c, kind in df.dtypes:
        x = F.col(f"`{c}`")
        n = F.octet_length(x) if kind in ("string", "binary") else F.octet_length(F.to_json(F.struct(x))) if kind.startswith(("array", "map", "struct")) else F.when(x.isNotNull(), width.get(kind, 8))
        sums.append(F.struct(F.lit(c).alias("column"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("bytes")))
    return df.agg(F.array(*sums).alias("r")).select(F.inline("r"))


def document_stats(indexes: DataFrame) -> DataFrame:
    """documents, chunks, dimensions, model of a project's index entries, in one row."""
    return indexes.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.max("dimensions").alias("dimensions"), F.max("model").alias("model"))


ITEM_STATES = ("pending", "running", "completed", "failed", "skipped")


def job_progress(items: DataFrame) -> DataFrame:
    """job_id, a count of each state, total, percent done (finished one way or the other; 100 without items) and the last
    item that was finished."""
    done = F.col("state").isin("completed", "failed", "skipped")
    counts = [F.count_if(F.col("state") == s).alias(s) for s in ITEM_STATES]
    g = items.groupBy("job_id").agg(*counts, F.count(F.lit(1)).alias("total"), F.count_if(done).alias("__done"), F.max(F.when(done, F.col("item_id"))).alias("checkpoint"))
    return g.withColumn("percent", F.coalesce(F.round(F.try_divide(100.0 * F.col("__done"), F.col("total")), 2), F.lit(100.0))).drop("__done")


def storage_inventory(objects: DataFrame) -> DataFrame:
    """kind, objects, bytes: what lies in the store."""
    return objects.groupBy(F.col("media_type").alias("kind")).agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
