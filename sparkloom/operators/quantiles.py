"""Exact quantiles by group, however large a group is.

One pass takes a mergeable sketch of every group, which brackets each quantile. A second one lays every value against its
group's brackets: what lies below one is only counted, what lies inside is counted by value, both map-side first. Running
counts over the values inside then say which two the quantile lies between. So no task ever ranks a group: it ranks what
is inside a bracket, about one value in 2,500 of a large group.

Brackets stay in DataFrames. Those of the groups that hold over a thousandth of all rows (fewer than a thousand, so they
are broadcast) meet their rows where these are; the others are joined by group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import cut

#: Accuracy of the sketches; how far beyond a quantile its bracket reaches, in steps of that.
ACCURACY, REACH = 10_000, 4.0
#: Groups with a larger share of the rows than one in HOT are met without a shuffle.
HOT = 1000


def _same(names: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names], F.lit(True))


def grouped_quantiles(df: DataFrame, by: list[str], columns: dict[str, Column], at: list[float]) -> DataFrame:
    """The by columns (missing is a group) and, for each name, the exact, linearly interpolated quantiles of a column in the
    group as an array, null where the group has no value. NaN and null are missing. Groups of no more than ACCURACY values
    are ranked whole, since a step of the sketch is less than a value there."""
    keys, names = [f"__g{i}" for i in range(len(by))], list(columns)
    wide = df.select(*[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys, strict=True)], *[F.nanvl(c.cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(columns.values())])
    edges = [min(1.0, max(0.0, p + s * REACH / ACCURACY)) for p in at for s in (-1, 1)]
    sketch = lambda i: F.struct(F.count(f"x{i}").alias("n"), F.percentile_approx(f"x{i}", edges, ACCURACY).alias("e"))
    groups = cut(wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[sketch(i).alias(f"s{i}") for i in range(len(names))]))
    total = groups.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    brackets = groups.withColumn("hot", F.col("rows") * HOT > total)
    states = ["rows", *[f"s{i}" for i in range(len(names))]]
    kinds = {r["hot"] for r in brackets.select("hot").distinct().collect()}
    hot = brackets.where("hot").select(*keys, *states)  # fewer than HOT rows
    met = wide.alias("w").join(F.broadcast(hot).alias("b"), _same(keys, "w", "b"), "left").select("w.*", *[f"b.{s}" for s in states])
    if False in kinds:
        cold = (met.where("rows is null").drop(*states) if True in kinds else wide).alias("w").join(brackets.where("not hot").alias("b"), _same(keys, "w", "b")).select("w.*", *[f"b.{s}" for s in states])
        met = met.where("rows is not null").unionByName(cold) if True in kinds else cold

    def place(i: int, k: int) -> Column:
        """Of a value against a bracket: the value if it is inside, null if below; no struct at all if above."""
        x, few = F.col(f"x{i}"), F.col(f"s{i}.n") <= ACCURACY
        low, high = few | (x >= F.col(f"s{i}.e")[2 * k]), few | (x <= F.col(f"s{i}.e")[2 * k + 1])
        return F.when(x.isNotNull() & high, F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.when(low, x).alias("v")))

    places = F.filter(F.array(*[place(i, k) for i in range(len(names)) for k in range(len(at))]), lambda p: p.isNotNull())
    counted = met.select(*keys, F.explode(places).alias("p")).groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("n")).select(*keys, "p.*", "n")
    up_to = F.sum("n").over(Window.partitionBy(*keys, "i", "k").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    sizes = groups.select(*keys, F.posexplode(F.array(*[F.col(f"s{i}.n") for i in range(len(names))])).alias("i", "size"))
    ranked = counted.withColumn("up_to", up_to).alias("c").join(sizes.alias("z"), _same([*keys, "i"], "c", "z")).select("c.*", "z.size")
    rank = F.element_at(F.array(*[F.lit(float(p)) for p in at]), F.col("k") + 1) * (F.col("size") - 1)
    ranked = ranked.withColumn("rank", rank).withColumn("low", F.floor("rank"))
    found = ranked.groupBy(*keys, "i", "k").agg(
        F.min(F.when(F.col("up_to") > F.col("low"), F.col("v"))).alias("a"), F.min(F.when(F.col("up_to") > F.least(F.col("low") + 1, F.col("size") - 1), F.col("v"))).alias("b"),
        F.max(F.col("rank") - F.col("low")).alias("part"), F.bool_or(F.col("v").isNull() & (F.col("up_to") > F.col("low"))).alias("missed"),
    )
    between = F.when((F.col("part") == 0) | (F.col("a") == F.col("b")), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    value = F.when(F.coalesce(F.col("missed"), F.lit(False)) | F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a bracket misses its quantile"))).otherwise(between)
    rows = found.withColumn("q", value).groupBy(*keys).agg(*[F.max(F.when((F.col("i") == i) & (F.col("k") == k), F.col("q"))).alias(f"q{i}_{k}") for i in range(len(names)) for k in range(len(at))])
    out = groups.alias("g").join(rows.alias("r"), _same(keys, "g", "r"), "left")
    whole = lambda i: F.when(F.col(f"g.s{i}.n") > 0, F.array(*[F.col(f"r.q{i}_{k}") for k in range(len(at))]))
    return out.select(*[F.col(f"g.{k}").alias(b) for b, k in zip(by, keys, strict=True)], *[whole(i).alias(n) for i, n in enumerate(names)])


def join_groups(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """a with the columns of b, one row a group in either, whatever is missing."""
    renamed = b.select(*[F.col(f"`{c}`").alias(f"__b{i}") for i, c in enumerate(by)], *[F.col(f"`{c}`") for c in b.columns if c not in by])
    same = reduce(lambda x, y: x & y, [F.col(f"`{c}`").eqNullSafe(F.col(f"__b{i}")) for i, c in enumerate(by)], F.lit(True))
    return a.join(renamed, same).drop(*[f"__b{i}" for i in range(len(by))])
