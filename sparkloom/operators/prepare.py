"""Preparation for training: splits, train-only preprocessing, scaling and encoding."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_numeric, missing_as_null, need, one_of, quantile_row
from ..plans.errors import ParameterError
from .ordering import with_position

SPLITS = ("train", "validation", "test")


def _hash(key: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key.cast("string"))


def split(df: DataFrame, method: str, key: str, train: float = 0.8, validation: float = 0.1, seed: int = 42, by: str | None = None) -> DataFrame:
    """Adds _split: random, stratified (within each value of `by`), or group / source (whole groups of `by`).

    Items are ranked by a seeded hash of their key and cut at int(n * train) and int(n * (train + validation)): the
    same rows always fall the same way, and repeated keys fall together. Group methods cut the list of groups. The first
    share is taken as it is written (0.7 of 90 is 63), the sum of both as the double it is.
    """
    one_of(method, ("random", "stratified", "group", "source"), "method")
    if not (train > 0 and validation >= 0 and train + validation <= 1 + 1e-9):
        raise ParameterError("shares must be positive and sum to 1 at most")
    if method != "random" and not by:
        raise ParameterError("the method needs a column")

    written = F.lit(Decimal(repr(float(train))))

    def cut_at(pos: Column, n: Column) -> Column:
        return F.when(pos < F.floor(n.cast("decimal(19,0)") * written), "train").when(pos < F.floor(n * (train + validation)), "validation").otherwise("test")

    if method == "stratified":
        # one numbering over (label, hash): no label meets in one task
        units = df.select(F.col(f"`{by}`").alias("__b"), F.col(f"`{key}`").alias("__u")).withColumn("__h", _hash(F.col("__u"), seed))
        ranked = with_position(units.groupBy("__b", "__u", "__h").agg(F.count(F.lit(1)).alias("__times")), ["__b", "__h", "__u"], "__r")
        first = ranked.groupBy(F.col("__b").alias("__own")).agg(F.min("__r").alias("__first"), F.count(F.lit(1)).alias("__n"))
        cut = ranked.join(first, F.col("__b").eqNullSafe(F.col("__own"))).select("__b", "__u", cut_at(F.col("__r") - F.col("__first"), F.col("__n")).alias("_split"))
        return df.join(cut, F.col(f"`{by}`").eqNullSafe(F.col("__b")) & F.col(f"`{key}`").eqNullSafe(F.col("__u"))).drop("__b", "__u")
    unit = key if method == "random" else by
    groups = df.select(F.col(f"`{unit}`").alias("__g")).distinct().withColumn("__h", _hash(F.col("__g"), seed))
    ranked = with_position(groups, ["__h", "__g"], "__r")
    n = ranked.agg(F.count(F.lit(1)).alias("__n"))
    cut = ranked.crossJoin(F.broadcast(n)).select("__g", cut_at(F.col("__r"), F.col("__n")).alias("_split"))  # one row
    return df.join(cut, F.col(f"`{unit}`").eqNullSafe(F.col("__g"))).drop("__g")


def largest_remainder(n: int, shares: list[float]) -> list[int]:
    """Whole counts that sum to n, by largest remainder; ties to the earlier share."""
    total = sum(shares)
    exact = [n * s / total for s in shares]
    out = [int(x) for x in exact]
    for i in sorted(range(len(shares)), key=lambda i: (out[i] - exact[i], i))[: n - sum(out)]:
        out[i] += 1
    return out


def deal_sizes(sizes: list[tuple[int, int]], shares: dict[str, float]) -> dict[int, list[tuple[int, list[str]]]]:
    """For each size of groups, of which there are so many: from the r-th group on (by name), the splits that take turns.

    Groups go, the largest first, to the split furthest below its target, ties to the earlier one. Among groups of one size
    those splits take turns that are within one group of the furthest; others join when the gap has been made up. So a size
    has at most as many courses as there are splits, however many groups.
    """
    names, total = list(shares), sum(size * n for size, n in sizes)
    short = dict(zip(names, largest_remainder(total, list(shares.values())), strict=True))
    out: dict[int, list[tuple[int, list[str]]]] = {}
    for size, n in sorted(sizes, reverse=True):
        out[size], r = [], 0
        while r < n:
            most = max(short.values())
            turn = sorted((s for s in names if short[s] > most - size or size == 0), key=lambda s: (-short[s], names.index(s)))
            if size == 0:
                turn = turn[:1]
            others = [short[s] for s in names if s not in turn]
            rounds = (most - max(others)) // size if others and size else n - r
            k = min(n - r, rounds * len(turn))
            out[size].append((r, turn))
            for i, s in enumerate(turn):
                short[s] -= size * (k // len(turn) + (i < k % len(turn)))
            r += k
    return out


def _cut_at(position: Column, n: Column, shares: dict[str, float]) -> Column:
    """The split of a 0-based position among n, with largest-remainder counts; ties to the earlier split."""
    total = float(sum(shares.values()))
    exact = [n * F.lit(s / total) for s in shares.values()]
    whole = [F.floor(e + F.lit(1e-9)).cast("long") for e in exact]
    rest = n - sum(whole[1:], whole[0])
    parts = [F.round(e - w, 9) for e, w in zip(exact, whole, strict=True)]
    rank = [sum((F.when((q > p) | ((q == p) & F.lit(j < i)), 1).otherwise(0) for j, q in enumerate(parts) if j != i), F.lit(0)) for i, p in enumerate(parts)]
    counts = [w + F.when(r < rest, 1).otherwise(0) for w, r in zip(whole, rank, strict=True)]
    out, end = F.lit(list(shares)[-1]), F.lit(0).cast("long")
    ends = []
    for c in counts:
        end = end + c
        ends.append(end)
    for name, e in reversed(list(zip(shares, ends, strict=True))):
        out = F.when(position < e, name).otherwise(out)
    return out


def assign_splits(df: DataFrame, id_col: str, shares: dict[str, float], method: str = "random", by: str | None = None, seed: int = 42, manual: DataFrame | None = None) -> DataFrame:
    """Adds split to assets: random, stratified (largest-remainder counts in each label), group or source (whole groups),
    or manual (id and split of `manual`; ids that it doesn't name get null).

    Ids are unique. Ranks come from a seeded hash of the id, within a label by global positions, so that no label meets
    in one task. Groups go, the largest first, to the split furthest below its target: the driver deals their different
    sizes, of which there are few, and each group finds its turn among those of its size.
    """
    one_of(method, ("random", "stratified", "group", "source", "manual"), "method")
    if method != "manual" and (not shares or min(shares.values()) < 0 or sum(shares.values()) <= 0):
        raise ParameterError("shares must not be negative, and one must be positive")
    if method == "manual":
        named = manual.select(F.col(f"`{id_col}`").alias("__id"), F.col("split"))
        return df.join(named, F.col(f"`{id_col}`") == F.col("__id"), "left").drop("__id")
    if method != "random" and not by:
        raise ParameterError("the method needs a column")
    if method in ("random", "stratified"):
        label = F.col(f"`{by}`").cast("string") if method == "stratified" else F.lit("")
        ranked = with_position(df.select(F.col(f"`{id_col}`").alias("__id"), label.alias("__label")).withColumn("__h", _hash(F.concat_ws("\0", "__label", F.col("__id").cast("string")), seed)), ["__label", "__h", "__id"], "__pos")
        first = ranked.groupBy(F.col("__label").alias("__own")).agg(F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__n"))
        placed = ranked.join(first, F.col("__label").eqNullSafe(F.col("__own"))).select("__id", _cut_at(F.col("__pos") - F.col("__first"), F.col("__n"), shares).alias("split"))
        return df.join(placed, F.col(f"`{id_col}`") == F.col("__id")).drop("__id")
    name = F.coalesce(F.col(f"`{by}`").cast("string"), F.lit(""))
    groups = df.groupBy(name.alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = with_position(groups.withColumn("__down", -F.col("__n")), ["__down", "__g"], "__pos")
    by_size = ranked.groupBy("__n").agg(F.count(F.lit(1)).alias("k"), F.min("__pos").alias("__first"))
    # different sizes: fewer than the root of twice the rows
    found = by_size.collect()
    dealt = deal_sizes([(r["__n"], r["k"]) for r in found], shares)
    courses = df.sparkSession.createDataFrame([(r["__n"], r["__first"], dealt[r["__n"]]) for r in found], "__size long, __first long, __courses array<struct<start:long,turn:array<string>>>")
    placed = ranked.join(courses, F.col("__n") == F.col("__size")).withColumn("__r", F.col("__pos") - F.col("__first"))
    placed = placed.withColumn("__c", F.element_at(F.filter("__courses", lambda c: c["start"] <= F.col("__r")), -1))
    placed = placed.select("__g", F.get(F.col("__c.turn"), F.pmod(F.col("__r") - F.col("__c.start"), F.size("__c.turn").cast("long")).cast("int")).alias("split"))
    return df.join(placed, name == F.col("__g")).drop("__g")


def scale(df: DataFrame, columns: list[str], method: str = "standard") -> DataFrame:
    """standard (population deviation), minmax or robust; a width of zero counts as one."""
    one_of(method, ("standard", "minmax", "robust"), "method")
    need(df, *columns)
    d = missing_as_null(df)
    return _apply(d, columns, _fit(d, columns, method))


def _fit(d: DataFrame, columns: list[str], method: str) -> DataFrame:
    """One row: __s0... with centre c and width w of each column."""
    wide = lambda w: F.coalesce(F.nullif(w, F.lit(0.0)), F.lit(1.0)).alias("w")
    if method == "robust":
        q = quantile_row(d, {f"q{i}": F.col(f"`{c}`") for i, c in enumerate(columns)}, [0.25, 0.5, 0.75])
        return q.select(*[F.struct(F.col(f"q{i}")[1].alias("c"), wide(F.col(f"q{i}")[2] - F.col(f"q{i}")[0])).alias(f"__s{i}") for i in range(len(columns))])
    parts = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        centre, width = (F.avg(x), F.stddev_pop(x)) if method == "standard" else (F.min(x), F.max(x) - F.min(x))
        parts.append(F.struct(centre.alias("c"), wide(width)).alias(f"__s{i}"))
    return d.agg(*parts)


def _apply(d: DataFrame, columns: list[str], stats: DataFrame) -> DataFrame:
    j = d.crossJoin(F.broadcast(stats))  # one row
    return j.select(*[((F.col(f"`{c}`").cast("double") - F.col(f"__s{columns.index(c)}.c")) / F.col(f"__s{columns.index(c)}.w")).alias(c) if c in columns else F.col(f"`{c}`") for c in d.columns])


def log(df: DataFrame, columns: list[str]) -> DataFrame:
    """ln(1 + x); a value of -1 or less is an error."""
    need(df, *columns)
    x = lambda c: F.col(f"`{c}`").cast("double")
    return missing_as_null(df).withColumns({c: F.when(x(c) <= -1, F.raise_error(F.lit(f"{c} holds a value of -1 or less"))).otherwise(F.log1p(x(c))) for c in columns})


def ordinal(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """Place in an ordered list (at most 500); unknown values -1, missing stays missing."""
    need(df, column)
    if not 1 <= len(categories) <= 500:
        raise ParameterError("1 to 500 categories")
    place = F.array_position(F.array(*[F.lit(str(c)) for c in categories]), F.col(f"`{column}`").cast("string")) - 1
    return df.withColumn(column, F.when(F.col(f"`{column}`").isNotNull(), place).cast("long"))


def _labels(d: DataFrame, column: str, most: int) -> list[str]:
    got = sorted(r[0] for r in d.select(F.col(f"`{column}`").cast("string")).na.drop().distinct().limit(most + 1).collect())  # bounded by the check below
    if len(got) > most:
        raise ParameterError(f"{column} has more than {most} categories")
    return got


def _one_hot(c: str, v: str | None) -> Column:
    x = F.col(f"`{c}`")
    return (x.isNull() if v is None else F.coalesce(x.cast("string") == v, F.lit(False))).cast("int").alias(f"{c}_{'nan' if v is None else v}")


def encode(df: DataFrame, columns: list[str], most: int = 100, most_all: int = 500) -> DataFrame:
    """One-hot columns c_v for each value in sorted order and c_nan for missing ones, in place of c."""
    need(df, *columns)
    d = missing_as_null(df)
    new = [_one_hot(c, v) for c in columns for v in [*_labels(d, c, most), None]]
    if len(new) > most_all:
        raise ParameterError(f"more than {most_all} columns")
    return d.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], *new)


def preprocess(df: DataFrame, numeric: list[str] = (), categorical: list[str] = (), scaling: str = "standard", indicator: bool = True) -> DataFrame:
    """Imputes (median), scales and one-hot encodes with what the train rows alone show.

    Values that train rows don't have are all zero; missing ones are marked in c_missing.
    """
    need(df, "_split", *numeric, *categorical)
    d = missing_as_null(df)
    train = d.where("_split = 'train'")
    if train.isEmpty():
        raise ParameterError("no train rows")
    numeric, categorical = list(numeric), list(categorical)
    med = quantile_row(train, {f"__m{i}": F.col(f"`{c}`") for i, c in enumerate(numeric)}, [0.5]) if numeric else None
    med = med.select(*[F.coalesce(F.col(f"__m{i}")[0], F.lit(0.0)).alias(f"__m{i}") for i in range(len(numeric))]) if numeric else None
    out = d.withColumns({f"{c}_missing": F.col(f"`{c}`").isNull().cast("int") for c in numeric}) if indicator and numeric else d
    if med is not None:
        def filled(x: DataFrame) -> DataFrame:
            j = x.crossJoin(F.broadcast(med))  # one row
            return j.select(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.col(f"__m{numeric.index(c)}")).alias(c) if c in numeric else F.col(f"`{c}`") for c in x.columns])

        out = _apply(filled(out), numeric, _fit(filled(train), numeric, scaling))
    new = [_one_hot(c, v) for c in categorical for v in _labels(train, c, 100)]
    return out.select(*[F.col(f"`{c}`") for c in out.columns if c not in categorical], *new)


def is_text(df: DataFrame, c: str) -> bool:
    return not is_numeric(df, c)
