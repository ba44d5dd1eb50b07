"""Data of charts as frames in long form; nothing is drawn. Limits on points are part of each chart."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import missing_as_null, need, numeric_columns, one_of, quantile_row
from ..plans.session import cut
from .ordering import with_position
from .quantiles import grouped_quantiles

KINDS = ("histogram", "density", "violin", "box", "qq", "error", "outlier", "scatter", "bubble", "pair", "line", "rolling", "bar", "split", "grouped", "stacked", "missingness")


def _x(c: str) -> Column:
    return F.col(f"`{c}`").cast("double")


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin, low, high, n: equal widths, the last bin closed; a single value gets a width of one around it."""
    need(df, column)
    d = missing_as_null(df).select(_x(column).alias("x")).where(F.abs("x") < float("inf"))
    r = d.agg(F.min("x").alias("a"), F.max("x").alias("b")).select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    r = r.withColumn("w", (F.col("b") - F.col("a")) / bins)
    counted = d.crossJoin(F.broadcast(r)).groupBy(F.least(F.floor((F.col("x") - F.col("a")) / F.col("w")), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row
    grid = r.where("a is not null").select("a", "w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counted, "bin", "left").select("bin", (F.col("a") + F.col("bin") * F.col("w")).alias("low"), (F.col("a") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def density(df: DataFrame, column: str, points: int = 100, bins: int = 512) -> DataFrame:
    """x, density: Gaussian kernel estimate over binned values; bandwidth sd * n^-0.2."""
    h = histogram(df, column, bins)
    s = missing_as_null(df).select(_x(column).alias("x")).where(F.abs("x") < float("inf")).agg(F.count("x").alias("n"), F.stddev_samp("x").alias("sd"), F.min("x").alias("a"), F.max("x").alias("b"))
    s = s.withColumn("bw", F.coalesce(F.nullif(F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)), F.lit(0.0)), F.lit(1.0)))
    grid = s.where("n > 0").select("n", "bw", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("a") + i * (F.col("b") - F.col("a")) / (points - 1))).alias("x"))
    centre = h.where("n > 0").select(((F.col("low") + F.col("high")) / 2).alias("c"), F.col("n").alias("k"))
    both = grid.agg(F.collect_list(F.struct("x", "n", "bw")).alias("g")).crossJoin(F.broadcast(centre.agg(F.collect_list(F.struct("c", "k")).alias("h"))))  # one row each: points and bins
    kernel = lambda g: F.aggregate("h", F.lit(0.0), lambda acc, b: acc + b["k"] * F.exp(-0.5 * F.pow((g["x"] - b["c"]) / g["bw"], 2)))
    return both.select(F.inline(F.transform("g", lambda g: F.struct(g["x"].alias("x"), (kernel(g) / (g["n"] * g["bw"] * 2.5066282746310002)).alias("density")))))


def box(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """group, min, q1, median, q3, max."""
    d, at = missing_as_null(df), [0, 0.25, 0.5, 0.75, 1]
    if group:
        q = grouped_quantiles(d.withColumn("__by", F.col(f"`{group}`")), ["__by"], {"q": F.col(f"`{column}`")}, at).withColumnRenamed("__by", "group")
    else:
        q = quantile_row(d, {"q": F.col(f"`{column}`")}, at).withColumn("group", F.lit("all"))
    return q.select("group", *[F.col("q")[i].alias(n) for i, n in enumerate(("min", "q1", "median", "q3", "max"))])


def qq(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """theoretical, sample: normal against sample quantiles, at most `points`."""
    d = missing_as_null(df).select(_x(column).alias("x")).na.drop()
    n = min(points, d.limit(points).count())
    if not n:
        return d.sparkSession.createDataFrame([], "theoretical double, sample double")
    at = [(i + 0.5) / n for i in range(n)]
    z = F.array(*[F.lit(NormalDist().inv_cdf(p)) for p in at])
    return quantile_row(d, {"s": F.col("x")}, at).select(F.inline(F.arrays_zip(z.alias("theoretical"), F.col("s").alias("sample"))))


def error_bars(df: DataFrame, column: str, group: str) -> DataFrame:
    """group, mean, low, high: 1.96 standard errors either way."""
    half = 1.96 * F.stddev_samp(_x(column)) / F.sqrt(F.count(_x(column)))
    g = missing_as_null(df).groupBy(F.col(f"`{group}`").alias("group")).agg(F.avg(_x(column)).alias("mean"), F.coalesce(half, F.lit(0.0)).alias("half"))
    return g.select("group", "mean", (F.col("mean") - F.col("half")).alias("low"), (F.col("mean") + F.col("half")).alias("high"))


def outlier_points(df: DataFrame, column: str, order: list[str], most: int = 1000) -> DataFrame:
    """The first values, by order, beyond 1.5 interquartile ranges."""
    d = missing_as_null(df)
    d = d.crossJoin(F.broadcast(quantile_row(d, {"__q": F.col(f"`{column}`")}, [0.25, 0.75])))  # one row
    a, b = F.col("__q")[0], F.col("__q")[1]
    return d.where((_x(column) < a - 1.5 * (b - a)) | (_x(column) > b + 1.5 * (b - a))).orderBy(*[f"`{o}`" for o in order]).limit(most).select(*[F.col(f"`{o}`") for o in order], F.col(f"`{column}`").alias("value"))


def points(df: DataFrame, columns: list[str], order: list[str], most: int = 1000) -> DataFrame:
    """The first rows of some columns: scatter, bubble and pair (at most six columns) charts."""
    need(df, *columns)
    return df.orderBy(*[f"`{o}`" for o in order]).limit(most).select(*[F.col(f"`{c}`") for c in columns])


def line(df: DataFrame, x: str, y: str, order: list[str], window: int | None = None, most: int = 2000, group: str | None = None) -> DataFrame:
    """x, y by x, with a rolling mean of the last `window` rows (2 to 100) if asked, thinned to evenly spaced points."""
    d = with_position(missing_as_null(df).select(F.col(f"`{x}`").alias("x"), _x(y).alias("y"), *[F.col(f"`{o}`").alias(f"__o{i}") for i, o in enumerate(order)]), ["x", *[f"__o{i}" for i in range(len(order))]], "__pos")
    if window:
        # rows of a block and the last `window` of the block before lie in one partition: no task sees the whole table
        block = 100_000
        d = d.withColumn("__b", F.explode(F.array_distinct(F.array(F.floor(F.col("__pos") / block), F.floor((F.col("__pos") + window - 1) / block)))))
        w = Window.partitionBy("__b").orderBy("__pos").rowsBetween(-(window - 1), 0)
        d = d.withColumn("y", F.avg("y").over(w)).where(F.floor(F.col("__pos") / block) == F.col("__b"))
    n = d.agg(F.max("__pos").alias("__last"))
    step = F.greatest(F.lit(1.0), (F.col("__last") + 1) / float(most))
    d = d.crossJoin(F.broadcast(n)).where(F.floor(F.col("__pos") / step) != F.floor((F.col("__pos") - 1) / step))  # one row
    return d.orderBy("__pos").select("x", "y")


def bars(df: DataFrame, x: str, y: str | None = None, how: str = "count", most: int = 100) -> DataFrame:
    """x, value: count, mean, sum or median by group."""
    one_of(how, ("count", "mean", "sum", "median"), "aggregation")
    v = _values(missing_as_null(df).select(F.col(f"`{x}`").alias("x"), *([_x(y).alias("y")] if y else [])), ["x"], how)
    return v.select("x", "value").orderBy("x").limit(most)


def _values(d: DataFrame, by: list[str], how: str) -> DataFrame:
    """by and value: count, mean, sum or median of y in each group."""
    if how == "median":
        return grouped_quantiles(d, by, {"value": F.col("y")}, [0.5]).select(*by, F.col("value")[0].alias("value"))
    a = {"count": lambda: F.count(F.lit(1)).cast("double"), "mean": lambda: F.avg("y"), "sum": lambda: F.coalesce(F.sum("y"), F.lit(0.0))}[how]()
    return d.groupBy(*by).agg(a.alias("value"))


def grouped_bars(df: DataFrame, x: str, group: str, y: str | None = None, how: str = "count", series: int = 20, most: int = 100) -> DataFrame:
    """x, group, value for the first groups and xs; combinations that don't occur are 0."""
    d = missing_as_null(df)
    one_of(how, ("count", "mean", "sum", "median"), "aggregation")
    v = cut(_values(d.select(F.col(f"`{x}`").alias("x"), F.col(f"`{group}`").cast("string").alias("group"), *([_x(y).alias("y")] if y else [])), ["x", "group"], how))
    xs, gs = v.select("x").distinct().orderBy("x").limit(most), v.select("group").distinct().orderBy("group").limit(series)
    grid = xs.crossJoin(F.broadcast(gs))  # at most `most` times `series` rows
    v = v.toDF("__x", "__g", "value")
    j = grid.join(v, F.col("x").eqNullSafe(F.col("__x")) & F.col("group").eqNullSafe(F.col("__g")), "left")
    return j.select("x", "group", F.coalesce("value", F.lit(0.0)).alias("value"))


def missingness(df: DataFrame, order: list[str], rows: int = 100, columns: int = 60) -> DataFrame:
    """0/1 for the first rows and columns."""
    return missing_as_null(df).orderBy(*[f"`{o}`" for o in order]).limit(rows).select(*[F.col(f"`{c}`").isNull().cast("int").alias(c) for c in df.columns[:columns]])


def chart(df: DataFrame, kind: str, x: str | None = None, y: str | None = None, group: str | None = None, aggregation: str = "count", window: int = 5, order: list[str] = ()) -> DataFrame:
    """The data of one of the 17 kinds of chart."""
    one_of(kind, KINDS, "kind")
    order = list(order)
    match kind:
        case "histogram":
            return histogram(df, x)
        case "density" | "violin":
            return density(df, x)
        case "box":
            return box(df, x, group)
        case "qq":
            return qq(df, x)
        case "error":
            return error_bars(df, y or x, group or x)
        case "outlier":
            return outlier_points(df, x, order)
        case "scatter" | "bubble":
            return points(df, [c for c in (x, y, group) if c], order)
        case "pair":
            return points(df, numeric_columns(df)[:6], order)
        case "line":
            return line(df, x, y, order)
        case "rolling":
            return line(df, x, y, order, window)
        case "bar" | "split":
            return bars(df, x or "_split", y, aggregation)
        case "grouped" | "stacked":
            return grouped_bars(df, x, group, y, aggregation)
    return missingness(df, order)


def facets(df: DataFrame, buckets: dict[str, Column], top: int = 50) -> DataFrame:
    """facet, bucket, n of several bucketings, the most frequent of each."""
    parts = [df.groupBy(c.cast("string").alias("bucket")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "bucket").limit(top).select(F.lit(name).alias("facet"), "bucket", "n") for name, c in buckets.items()]
    return reduce(DataFrame.union, parts)
