"""Three predicate dialects, kept apart because they differ in case, wildcards, typing and empty lists.

query: typed comparisons, `contains` is a case-insensitive LIKE in which % and _ are wildcards.
lab: one condition, equality on text, `contains` literal and case-sensitive.
conditions / browse: lists of conditions matched all or any; a null predicate counts as false.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import need, one_of, rendered_column, safe_regex
from ..plans.errors import ParameterError

_COMPARE: dict[str, Callable[[Column, Any], Column]] = {"eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "le": lambda c, v: c <= v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "ge": lambda c, v: c >= v}


def _all(parts: list[Column], empty: bool = True) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(empty)


def _any(parts: list[Column], empty: bool = False) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(empty)


def query_predicate(df: DataFrame, filters: list[dict], search: str | None = None) -> Column:
    """AND of filters {column, op, value} and of a search over all columns."""
    parts = []
    for f in filters:
        need(df, f["column"])
        c, op, v = F.col(f"`{f['column']}`"), f["op"], f.get("value")
        if op in ("is_null", "not_null"):
            parts.append(c.isNull() if op == "is_null" else c.isNotNull())
        elif op == "contains":
            parts.append(c.cast("string").ilike(f"%{v}%"))
        elif op == "in":
            if not isinstance(v, list) or not 1 <= len(v) <= 1000:
                raise ParameterError("in takes 1 to 1000 values")
            parts.append(c.isin(v))
        elif op in ("eq", "ne", "lt", "lte", "gt", "gte"):
            parts.append(_COMPARE[op](c, F.lit(v)))
        else:
            raise ParameterError(f"unknown operator {op!r}")
    if search:
        parts.append(_any([F.coalesce(F.col(f"`{n}`").cast("string").ilike(f"%{search}%"), F.lit(False)) for n in df.columns]))
    return _all(parts)


def query_table(df: DataFrame, filters: list[dict] = (), search: str | None = None, columns: list[str] | None = None, sort: str | None = None, descending: bool = False, limit: int = 100, offset: int = 0, tie: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """A page (sorted, missing last) and a one-row frame with the total; the page size is the feature."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ParameterError("a page has 1 to 1000 rows")
    need(df, *(columns or []), *([sort] if sort else []))
    kept = df.where(query_predicate(df, list(filters), search))
    order = [F.col(f"`{sort}`").desc_nulls_last() if descending else F.col(f"`{sort}`").asc_nulls_last()] if sort else []
    order += [F.col(f"`{t}`") for t in tie]
    page = kept.orderBy(*order) if order else kept
    page = page.offset(offset).limit(limit) if offset else page.limit(limit)
    return page.select(*[F.col(f"`{c}`") for c in columns or df.columns]), kept.agg(F.count(F.lit(1)).alias("total"))


def frequency(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """value, n: the most frequent values; ties by value, missing last."""
    need(df, column)
    if not 1 <= top <= 100:
        raise ParameterError("1 to 100 values")
    return df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(top)


def lab_filter(df: DataFrame, column: str, op: str, value: Any = None) -> DataFrame:
    """One condition on a table: equality as text (null never matches), strict numbers, literal contains."""
    need(df, column)
    c, shown = F.col(f"`{column}`"), rendered_column(df, column)
    match op:
        case "equals":
            p = shown == str(value)
        case "not_equal":
            p = shown != str(value)
        case "greater":
            p = c.cast("double") > float(value)
        case "less":
            p = c.cast("double") < float(value)
        case "contains":
            p = F.contains(shown, F.lit(str(value)))
        case "is_null":
            p = c.isNull()
        case "not_null":
            p = c.isNotNull()
        case _:
            raise ParameterError(f"unknown operator {op!r}")
    return df.where(p)


def conditions_predicate(df: DataFrame, conditions: list[dict], match: str = "all") -> Column:
    """All or any of at most 30 conditions; an empty list keeps every row for all and none for any."""
    one_of(match, ("all", "any"), "match")
    if len(conditions) > 30:
        raise ParameterError("30 conditions at most")
    parts = []
    for k in conditions:
        need(df, k["column"])
        c, shown, op, v = F.col(f"`{k['column']}`"), rendered_column(df, k["column"]), k["op"], k.get("value")
        match op:
            case "gt" | "ge" | "lt" | "le":
                p = _COMPARE[op](c.cast("double"), float(v))
            case "eq":
                p = shown == str(v) if isinstance(v, str) else c == F.lit(v)
            case "ne":
                p = shown != str(v) if isinstance(v, str) else c != F.lit(v)
            case "in":
                p = shown.isin([str(x) for x in v])
            case "between_dates":
                p = c.cast("timestamp").between(F.lit(v[0]).cast("timestamp"), F.lit(v[1]).cast("timestamp"))
            case "contains":
                p = F.contains(shown, F.lit(str(v)))
            case "regex":
                p = shown.rlike(safe_regex(v))
            case "is_null":
                p = c.isNull()
            case "not_null":
                p = c.isNotNull()
            case _:
                raise ParameterError(f"unknown operator {op!r}")
        parts.append(F.coalesce(p, F.lit(False)))
    return _all(parts) if match == "all" else _any(parts)


def conditions(df: DataFrame, conditions: list[dict], match: str = "all") -> DataFrame:
    return df.where(conditions_predicate(df, conditions, match))


def browse(df: DataFrame, order: list[str], search: str | None = None, conditions: list[dict] = (), match: str = "all", sort: str | None = None, descending: bool = False, page: int = 0, size: int = 50) -> DataFrame:
    """A page of rows with their positions. Search is literal and case-sensitive; `any` without conditions keeps all.

    order: columns that identify a row's place. Positions come from one global rank and so cost a sort: the page is the
    feature.
    """
    if not 1 <= size <= 200:
        raise ParameterError("a page has 1 to 200 rows")
    p = conditions_predicate(df, list(conditions), match) if conditions else F.lit(True)
    if search:
        p = p & _any([F.coalesce(F.contains(rendered_column(df, n), F.lit(search)), F.lit(False)) for n in df.columns])
    from .ordering import with_position

    kept = with_position(df, order, "position").where(p)
    keys = ([F.col(f"`{sort}`").desc_nulls_last() if descending else F.col(f"`{sort}`").asc_nulls_last()] if sort else []) + [F.col("position")]
    return kept.orderBy(*keys).offset(page * size).limit(size)
