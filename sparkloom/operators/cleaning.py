"""Cleaning of tables. NaN counts as missing; operators that keep the first row need order columns."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import arithmetic, is_numeric, missing_as_null, need, numeric_columns, one_of, quantile_row, rendered, split_field, strip
from ..plans.errors import ParameterError
from .ordering import fill, with_position


def _cols(names: list[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def fill_missing(df: DataFrame, columns: list[str], method: str, value: Any = None, order: list[str] = (), partition: list[str] = ()) -> DataFrame:
    """mean, median, mode (the smallest of equally frequent values), constant, forward or backward.

    Statistics come from one aggregation and are joined back as a single row. A column without any value raises for
    mode and stays missing for mean and median.
    """
    one_of(method, ("mean", "median", "mode", "constant", "forward", "backward"), "method")
    need(df, *columns)
    df = missing_as_null(df)
    if method in ("forward", "backward"):
        if not order:
            raise ParameterError("an ordered fill needs order columns")
        for c in columns:
            df = fill(df, c, list(order), backward=method == "backward", partition=list(partition))
        return df
    if method == "constant":
        return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(float(value)).cast(df.schema[c].dataType) if is_numeric(df, c) else F.lit(value)) for c in columns})
    aggs = []
    for i, c in enumerate(columns):
        col = F.col(f"`{c}`")
        if method != "mode" and not is_numeric(df, c):
            raise ParameterError(f"{c} is not numeric")
        if method == "median":
            continue
        a = F.avg(col) if method == "mean" else F.mode(col, True)
        if method == "mode":
            a = F.when(a.isNull(), F.raise_error(F.lit(f"{c} has no value"))).otherwise(a)
        aggs.append(a.alias(f"__m{i}"))
    stats = df.agg(*aggs) if aggs else quantile_row(df, {f"__m{i}": F.col(f"`{c}`") for i, c in enumerate(columns)}, [0.5]).select(*[F.col(f"__m{i}")[0].alias(f"__m{i}") for i in range(len(columns))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.select(*[F.coalesce(F.col(f"`{c}`"), F.col(f"__m{columns.index(c)}")).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def drop_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows with a missing value in any of the columns go."""
    need(df, *(columns or []))
    return missing_as_null(df).na.drop(how="any", subset=columns or df.columns)


def comparable(df: DataFrame, c: str) -> Column:
    """A column as a key: maps as sorted entries, so that nested values compare by content."""

    def key(col: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.MapType):
            return F.array_sort(F.map_entries(col))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.MapType, T.ArrayType)):
            return F.transform(col, lambda x: key(x, kind.elementType))
        return col

    return key(F.col(f"`{c}`"), df.schema[c].dataType)


def drop_duplicates(df: DataFrame, columns: list[str] | None = None, order: list[str] = (), keep: str = "first") -> DataFrame:
    """One row of each group of equal keys: the first or last by order."""
    one_of(keep, ("first", "last"), "keep")
    df = missing_as_null(df)
    keys = [comparable(df, c) for c in columns or df.columns]
    by = [F.col(f"`{o}`").asc_nulls_first() if keep == "first" else F.col(f"`{o}`").desc_nulls_last() for o in order] or [F.lit(0)]
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("__k = 1").drop("__k")


def duplicates(df: DataFrame, columns: list[str], order: str, keep: str = "first") -> DataFrame:
    """Rows of groups of more than one, with duplicate_group (in order of first appearance) and canonical. order tells
    rows apart."""
    one_of(keep, ("first", "last"), "keep")
    need(df, *columns, order)
    df = missing_as_null(df)
    keys = [comparable(df, c).alias(f"__k{i}") for i, c in enumerate(columns)]
    # what is asked of a group comes from partial aggregates and is joined back, so no group meets in one task
    found = df.select(*keys, F.col(f"`{order}`").alias("__o")).groupBy(*[f"__k{i}" for i in range(len(keys))])
    found = found.agg(F.count(F.lit(1)).alias("__n"), F.min("__o").alias("__first"), F.max("__o").alias("__last")).where("__n > 1")
    found = found.select(*[F.col(f"__k{i}").alias(f"__g{i}") for i in range(len(keys))], "__first", "__last")
    numbers = with_position(found.select("__first").distinct(), ["__first"], "duplicate_group")
    found = found.join(numbers, "__first")
    d = df.select("*", *keys)
    same = reduce(lambda a, b: a & b, [F.col(f"__k{i}").eqNullSafe(F.col(f"__g{i}")) for i in range(len(keys))])
    d = d.join(found, same).withColumn("canonical", F.col(f"`{order}`").eqNullSafe(F.col("__first" if keep == "first" else "__last")))
    return d.select(*[F.col(f"`{c}`") for c in df.columns], "canonical", "duplicate_group")


def clip(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values outside the low and high quantiles become these."""
    need(df, *columns)
    if not 0 <= low < high <= 1:
        raise ParameterError("0 <= low < high <= 1")
    df = missing_as_null(df)
    q = quantile_row(df, {f"__q{i}": F.col(f"`{c}`") for i, c in enumerate(columns)}, [low, high])
    d = df.crossJoin(F.broadcast(q))  # one row

    def bound(i: int, c: str) -> Column:
        x, b = F.col(f"`{c}`").cast("double"), F.col(f"__q{i}")
        return F.when(x < b[0], b[0]).when(x > b[1], b[1]).otherwise(x)

    return d.select(*[bound(columns.index(c), c).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def cast(df: DataFrame, column: str, to: str) -> DataFrame:
    """string, number or datetime (UTC); a value that can't be cast is an error."""
    one_of(to, ("string", "number", "datetime"), "type")
    need(df, column)
    kind = {"string": "string", "number": "double", "datetime": "timestamp"}[to]
    return df.withColumn(column, F.col(f"`{column}`").cast(kind))


def rename(df: DataFrame, column: str, new_name: str) -> DataFrame:
    need(df, column)
    if not new_name.strip() or (new_name in df.columns and new_name != column):
        raise ParameterError("the new name is blank or taken")
    return df.withColumnRenamed(column, new_name)


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    need(df, *columns)
    if not set(df.columns) - set(columns):
        raise ParameterError("at least one column must stay")
    return df.drop(*columns)


def replace(df: DataFrame, column: str, mapping: dict[str, Any]) -> DataFrame:
    """Values by the text they render as; others stay."""
    need(df, column)
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if not mapping:
        return df
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(str(k)), F.lit(v).cast(kind))])
    shown = rendered(c, kind)
    return df.withColumn(column, F.when(c.isNotNull() & F.map_contains_key(m, shown), m[shown]).otherwise(c))


def strings(df: DataFrame, column: str, action: str, find: str = "", replacement: str = "", delimiter: str = ",", index: int = 0, output: str | None = None) -> DataFrame:
    """lower, upper, strip, length, replace (literal) or split (field `index`)."""
    need(df, column)
    c = F.col(f"`{column}`").cast("string")
    match action:
        case "lower":
            out = F.lower(c)
        case "upper":
            out = F.upper(c)
        case "strip":
            out = strip(c)
        case "length":
            out = F.length(c).cast("long")
        case "replace":
            out = F.replace(c, F.lit(find), F.lit(replacement)) if find else c
        case "split":
            out = split_field(c, delimiter, index)
        case _:
            raise ParameterError(f"unknown action {action!r}")
    return df.withColumn(output or column, out)


def dates(df: DataFrame, column: str, part: str, output: str | None = None) -> DataFrame:
    """year, month, day, weekday (Monday 0), hour, floor_day or floor_month (text YYYY-MM-01), in UTC."""
    need(df, column)
    t = F.col(f"`{column}`").cast("timestamp")
    parts = {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "weekday": F.weekday(t), "hour": F.hour(t)}
    if part in parts:
        out = parts[part].cast("long")
    elif part == "floor_day":
        out = F.date_trunc("day", t)
    elif part == "floor_month":
        out = F.date_format(t, "yyyy-MM-'01'")
    else:
        raise ParameterError(f"unknown part {part!r}")
    return df.withColumn(output or f"{column}_{part}", out)


def derive(df: DataFrame, output: str, expression: str) -> DataFrame:
    """A new column from an arithmetic expression over numeric columns."""
    return df.withColumn(output, arithmetic(expression, numeric_columns(df)))


def exclude(df: DataFrame, positions: list[int], order: list[str]) -> DataFrame:
    """Rows without those at 0-based positions of the order; a position that doesn't exist is an error."""
    d = with_position(df, order, "__pos")
    if not positions:
        return d.drop("__pos")
    n = d.agg(F.max("__pos").alias("__max"))
    last = F.coalesce(F.col("__max"), F.lit(-1))
    d = d.crossJoin(F.broadcast(n.select(F.when((last < max(positions)) | F.lit(min(positions) < 0), F.raise_error(F.lit("a position is out of range"))).otherwise(last).alias("__max"))))  # one row
    return d.where(~F.col("__pos").isin(positions) & (F.col("__max") >= 0)).drop("__pos", "__max")


def sample_rows(df: DataFrame, method: str, n: int = 100, seed: int = 0, order: list[str] = (), positions: list[int] = ()) -> DataFrame:
    """first, random (by a seeded hash of the whole row), representative (evenly spaced) or selected positions."""
    one_of(method, ("first", "random", "representative", "selected"), "method")
    if n < 1 or len(positions) > 500:
        raise ParameterError("at least one row, at most 500 positions")
    cols = [F.col(f"`{o}`") for o in order]
    if method == "first":
        return df.orderBy(*cols).limit(n)
    if method == "random":
        return df.orderBy(F.xxhash64(F.lit(seed), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))), *cols).limit(n)
    d = with_position(df, list(order), "__pos")
    if method == "selected":
        return d.where(F.col("__pos").isin(list(positions))).drop("__pos")
    total = d.agg(F.count(F.lit(1)).alias("__n"))
    d = d.crossJoin(F.broadcast(total))  # one row
    step = F.greatest(F.lit(1.0), F.col("__n") / F.lit(float(n)))
    return d.where(F.floor(F.col("__pos") / step) != F.floor((F.col("__pos") - 1) / step)).drop("__pos", "__n")


def normalise_name(name: str) -> str:
    return re.sub(r"\W+", "_", name.strip().lower()).strip("_")
