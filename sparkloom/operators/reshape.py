"""Reshaping."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import need, one_of, rendered_column
from ..plans.errors import ParameterError


def text_of(df: DataFrame, c: str) -> Column:
    """A cell as text, as tables render it."""
    return rendered_column(df, c)


def melt(df: DataFrame, ids: list[str], values: list[str] | None = None) -> DataFrame:
    """ids, variable, value (text): one row for each value column."""
    need(df, *ids, *(values or []))
    values = values or [c for c in df.columns if c not in ids]
    if not values:
        raise ParameterError("no value columns")
    texts = df.select(*[F.col(f"`{c}`") for c in ids], *[text_of(df, c).alias(c) for c in values])
    return texts.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in values], "variable", "value")


def explode(df: DataFrame, column: str, separator: str = ",") -> DataFrame:
    """One row for each field of a literal split; missing stays one missing row, empty text one empty row."""
    need(df, column)
    if not separator:
        raise ParameterError("the separator is empty")
    parts = F.split(F.col(f"`{column}`").cast("string"), re.escape(separator), -1)
    return df.select(*[F.explode_outer(parts).alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])


def pivot(df: DataFrame, index: str, column: str, value: str, how: str = "sum", most: int = 500) -> DataFrame:
    """index x labels of column (as text, missing as "nan"); at most `most` labels."""
    one_of(how, ("sum", "mean", "count", "min", "max"), "aggregation")
    need(df, index, column, value)
    label = F.coalesce(text_of(df, column), F.lit("nan"))
    labels = [r[0] for r in df.select(label.alias("l")).distinct().limit(most + 1).collect()]  # bounded by the check below
    if len(labels) > most:
        raise ParameterError(f"more than {most} labels")
    d = df.select(F.col(f"`{index}`"), label.alias("__l"), F.col(f"`{value}`").alias("__v"))
    agg = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}[how]("__v")
    return d.groupBy(f"`{index}`").pivot("__l", sorted(labels)).agg(agg)
