"""Comparison of two versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import missing_as_null, need, rendered_column


def _text(df: DataFrame, columns: list[str]) -> DataFrame:
    return missing_as_null(df).select(*[F.coalesce(rendered_column(df, c), F.lit("\0")).alias(c) for c in columns])


def multiset_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """change, n: rows added and removed, by common columns as text, repeats counted."""
    cols = [c for c in old.columns if c in new.columns]
    a, b = _text(old, cols), _text(new, cols)
    count = lambda d, what: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("change"), "n")
    return count(b.exceptAll(a), "added").union(count(a.exceptAll(b), "removed"))


def kind_of(column: str, label: str | None) -> str:
    return "split" if column == "_split" else "label" if column == label else "feature"


def keyed_diff(old: DataFrame, new: DataFrame, key: str, label: str | None = None) -> DataFrame:
    """column, kind, changed: rows added, removed, changed, and changes of each common column, matched by a unique key."""
    need(old, key)
    need(new, key)
    cols = [c for c in old.columns if c in new.columns and c != key]
    a = missing_as_null(old).select(F.col(f"`{key}`").alias("__a"), F.struct(*[rendered_column(old, c).alias(c) for c in cols], F.lit(1).alias("__p")).alias("x"))
    b = missing_as_null(new).select(F.col(f"`{key}`").alias("__b"), F.struct(*[rendered_column(new, c).alias(c) for c in cols], F.lit(1).alias("__p")).alias("y"))
    j = a.join(b, F.col("__a") == F.col("__b"), "full")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    changed: list[Column] = [both & ~F.col(f"x.`{c}`").eqNullSafe(F.col(f"y.`{c}`")) for c in cols]
    some = F.lit(False)
    for c in changed:
        some = some | c
    parts = [("*", "added", F.count_if(F.col("x").isNull())), ("*", "removed", F.count_if(F.col("y").isNull())), ("*", "changed", F.count_if(some))]
    parts += [(c, kind_of(c, label), F.count_if(k)) for c, k in zip(cols, changed, strict=True)]
    return j.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), n.alias("changed")) for c, k, n in parts]).alias("r")).select(F.inline("r"))
