"""The operators as a registry: id, category, parameters, and a function DataFrame, parameters -> DataFrame."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from ..operators import aggregates, charts, cleaning, combine, predicates, prepare, reshape
from .errors import ParameterError


@dataclass(frozen=True)
class Parameter:
    """kind: column, columns, enum, number, boolean, string, json or dataset."""

    kind: str
    required: bool = True
    choices: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Operation:
    id: str
    category: str
    run: Callable[..., DataFrame]
    parameters: dict[str, Parameter] = field(default_factory=dict)
    aliases: tuple[str, ...] = ()
    report_only: bool = False
    deterministic: bool = True
    version: str = "1"


_C, _CS, _S, _J = Parameter("column"), Parameter("columns"), Parameter("string"), Parameter("json")
_N, _O = Parameter("number", False), Parameter("columns", False)


def _opt(p: Parameter) -> Parameter:
    return Parameter(p.kind, False, p.choices, p.low, p.high)


def _enum(*choices: str, required: bool = True) -> Parameter:
    return Parameter("enum", required, choices)


_BUILT_IN = [
    Operation("profile", "explore", lambda df: aggregates.null_counts(df), {}, ("missing",), True),
    Operation("column_profile", "explore", aggregates.column_profile, {}, ("summary",), True),
    Operation("findings", "explore", aggregates.findings, {}, (), True),
    Operation("statistics", "explore", lambda df, kind="describe", columns=None: {"describe": lambda: aggregates.describe(df), "covariance": lambda: aggregates.covariance(df, columns), "quantiles": lambda: aggregates.quantiles(df, columns), "frequency": lambda: aggregates.value_frequencies(df, columns or df.columns)}[kind](), {"kind": _enum("describe", "covariance", "quantiles", "frequency", required=False), "columns": _O}, ("describe",), True),
    Operation("correlation", "explore", aggregates.correlation, {"columns": _O}, ("pearson",), True),
    Operation("distribution", "explore", aggregates.distribution, {"column": _C}, ("histogram",), True),
    Operation("outliers", "explore", aggregates.outliers, {"columns": _CS, "method": _enum("iqr", "zscore", "variance", required=False), "threshold": _N}, (), True),
    Operation("quality", "explore", aggregates.quality, {"target": _opt(_C), "group": _opt(_C)}, (), True),
    Operation("chart", "explore", charts.chart, {"kind": _enum(*charts.KINDS), "x": _opt(_C), "y": _opt(_C), "group": _opt(_C), "aggregation": _opt(_S), "window": Parameter("number", False, (), 2, 100), "order": _O}, ("plot",), True),
    Operation("duplicates", "explore", cleaning.duplicates, {"columns": _CS, "order": _C, "keep": _enum("first", "last", required=False)}),
    Operation("fill_missing", "clean", cleaning.fill_missing, {"columns": _CS, "method": _enum("mean", "median", "mode", "constant", "forward", "backward"), "value": _opt(_J), "order": _O, "partition": _O}, ("impute",)),
    Operation("drop_missing", "clean", cleaning.drop_missing, {"columns": _O}),
    Operation("drop_duplicates", "clean", cleaning.drop_duplicates, {"columns": _O, "order": _O, "keep": _enum("first", "last", required=False)}, ("dedupe",)),
    Operation("drop_columns", "clean", cleaning.drop_columns, {"columns": _CS}),
    Operation("clip", "clean", cleaning.clip, {"columns": _CS, "low": _N, "high": _N}, ("winsorize",)),
    Operation("filter", "rows", predicates.lab_filter, {"column": _C, "op": _S, "value": _opt(_J)}, ("where",)),
    Operation("conditions", "rows", predicates.conditions, {"conditions": _J, "match": _enum("all", "any", required=False)}),
    Operation("exclude", "rows", cleaning.exclude, {"positions": _J, "order": _CS}),
    Operation("sort", "rows", lambda df, columns, descending=False, order=(): sort(df, columns, descending, order), {"columns": _CS, "descending": Parameter("boolean", False), "order": _O}),
    Operation("sample", "rows", cleaning.sample_rows, {"method": _enum("first", "random", "representative", "selected"), "n": _N, "seed": _N, "order": _O, "positions": _opt(_J)}),
    Operation("rename", "columns", cleaning.rename, {"column": _C, "new_name": _S}),
    Operation("cast", "columns", cleaning.cast, {"column": _C, "to": _enum("string", "number", "datetime")}, ("convert",)),
    Operation("derive", "columns", cleaning.derive, {"output": _S, "expression": _S}, ("compute",)),
    Operation("strings", "columns", cleaning.strings, {"column": _C, "action": _enum("lower", "upper", "strip", "length", "replace", "split"), "find": _opt(_S), "replacement": _opt(_S), "delimiter": _opt(_S), "index": _N, "output": _opt(_S)}),
    Operation("dates", "columns", cleaning.dates, {"column": _C, "part": _enum("year", "month", "day", "weekday", "hour", "floor_day", "floor_month"), "output": _opt(_S)}),
    Operation("replace", "columns", cleaning.replace, {"column": _C, "mapping": _J}, ("map",)),
    Operation("aggregate", "reshape", aggregates.aggregate, {"by": _CS, "values": _CS, "how": _enum(*aggregates.AGGREGATIONS, required=False)}, ("group",)),
    Operation("pivot", "reshape", reshape.pivot, {"index": _C, "column": _C, "value": _C, "how": _enum("sum", "mean", "count", "min", "max", required=False)}),
    Operation("melt", "reshape", reshape.melt, {"ids": _CS, "values": _O}, ("unpivot",)),
    Operation("explode", "reshape", reshape.explode, {"column": _C, "separator": _opt(_S)}),
    Operation("combine", "reshape", lambda df, right, **k: combine.combine(df, right, **k), {"right": Parameter("dataset"), "left_key": _opt(_C), "right_key": _opt(_S), "how": _enum("left", "inner", "outer", "right", "lookup", "concat", required=False), "cardinality": _enum(*combine.CARDINALITY, required=False)}, ("join", "merge")),
    Operation("scale", "prepare", prepare.scale, {"columns": _CS, "method": _enum("standard", "minmax", "robust", required=False)}, ("normalize",)),
    Operation("log", "prepare", prepare.log, {"columns": _CS}),
    Operation("ordinal", "prepare", prepare.ordinal, {"column": _C, "categories": _J}),
    Operation("encode", "prepare", prepare.encode, {"columns": _CS}, ("one_hot",)),
    Operation("split", "prepare", prepare.split, {"method": _enum("random", "stratified", "group", "source"), "key": _C, "train": _N, "validation": _N, "seed": _N, "by": _opt(_C)}),
    Operation("preprocess", "prepare", prepare.preprocess, {"numeric": _O, "categorical": _O, "scaling": _enum("standard", "minmax", "robust", required=False), "indicator": Parameter("boolean", False)}),
]


def sort(df: DataFrame, columns: list[str], descending: bool = False, order: list[str] = ()) -> DataFrame:
    """Missing values last in both directions; ties by the order columns."""
    from pyspark.sql import functions as F

    by = [F.col(f"`{c}`").desc_nulls_last() if descending else F.col(f"`{c}`").asc_nulls_last() for c in columns]
    return df.orderBy(*by, *[F.col(f"`{o}`") for o in order])


#: Words of a question that name no operation.
STOP = frozenset("a an and are can do does from how i in is it of on or please some that the this to want what which with".split())
#: How much a word says where it stands, and how much less a word that only begins like it.
WEIGHTS, BEGINS = {"id": 4.0, "alias": 3.0, "choice": 1.5, "parameter": 1.0, "category": 1.0}, 0.4
_ENDINGS = ("ations", "ation", "ings", "ing", "ies", "ed", "es", "e", "s", "y")


def stem(word: str) -> str:
    """A word without its first ending that leaves three letters; a doubled last letter becomes one."""
    for end in _ENDINGS:
        if word.endswith(end) and len(word) - len(end) >= 3:
            word = word.removesuffix(end)
            break
    return word[:-1] if len(word) > 3 and word[-1] == word[-2] else word


def stems(text: str) -> list[str]:
    return [stem(w) for w in re.findall(r"[a-z0-9]+", text.lower().replace("_", " ")) if w not in STOP]


class WordIndex:
    """Which operations a stem stands for, and how strongly: by the best of the places where it occurs."""

    def __init__(self) -> None:
        self.postings: dict[str, dict[str, float]] = {}

    def add(self, op: Operation) -> None:
        said = [("id", op.id), ("category", op.category), *[("alias", a) for a in op.aliases]]
        said += [("parameter", p) for p in op.parameters] + [("choice", c) for p in op.parameters.values() for c in p.choices]
        for place, text in said:
            for s in stems(text):
                held = self.postings.setdefault(s, {})
                held[op.id] = max(held.get(op.id, 0.0), WEIGHTS[place])

    def scores(self, asked: list[str], of: int) -> dict[str, float]:
        """Sums over the stems asked for, rarer ones counting more."""
        out: dict[str, float] = {}
        for a in dict.fromkeys(asked):
            best: dict[str, float] = {}
            for s, held in self.postings.items():
                near = 1.0 if s == a else BEGINS if min(len(s), len(a)) >= 3 and (s.startswith(a) or a.startswith(s)) else 0.0
                for op, w in held.items() if near else ():
                    best[op] = max(best.get(op, 0.0), near * w)
            for op, w in best.items():
                out[op] = out.get(op, 0.0) + w * math.log(1 + of / len(best))
        return out


class Registry:
    def __init__(self) -> None:
        self._ops: dict[str, Operation] = {}
        self._words = WordIndex()
        for o in _BUILT_IN:
            self.register(o)

    def register(self, op: Operation) -> None:
        if op.id in self._ops:
            raise ParameterError(f"{op.id} exists")
        self._ops[op.id] = op
        self._words.add(op)

    def get(self, id_: str) -> Operation:
        if id_ not in self._ops:
            raise ParameterError(f"unknown operation {id_!r}")
        return self._ops[id_]

    def ids(self) -> list[str]:
        return sorted(self._ops)

    def search(self, text: str = "", category: str = "") -> list[Operation]:
        """Operations of a category for what is asked, the best first: words count by where an operation has them and by how
        few operations do. Without a word that could name an operation, all of them by id."""
        own = {k: o for k, o in sorted(self._ops.items()) if not category or o.category == category}
        asked = stems(text)
        if not asked:
            return list(own.values())
        scores = self._words.scores(asked, len(self._ops))
        return [own[k] for k in sorted(own.keys() & scores.keys(), key=lambda k: (-scores[k], k))]

    def check(self, df: DataFrame, id_: str, given: dict[str, Any]) -> Operation:
        """The operation, once its parameters are known to be right."""
        op = self.get(id_)
        if extra := set(given) - set(op.parameters):
            raise ParameterError(f"{id_}: unknown parameters {', '.join(sorted(extra))}")
        for name, p in op.parameters.items():
            v = given.get(name)
            if v is None:
                if p.required:
                    raise ParameterError(f"{id_}: {name} is missing")
                continue
            bad = (
                (p.kind == "column" and v not in df.columns) or (p.kind == "columns" and (not isinstance(v, (list, tuple)) or any(c not in df.columns for c in v)))
                or (p.kind == "enum" and v not in p.choices) or (p.kind == "boolean" and not isinstance(v, bool)) or (p.kind == "string" and (not isinstance(v, str) or len(v) > 1000))
                or (p.kind == "number" and (isinstance(v, bool) or not isinstance(v, (int, float)) or (p.low is not None and v < p.low) or (p.high is not None and v > p.high)))
                or (p.kind == "json" and len(str(v)) > 50_000)
            )
            if bad:
                raise ParameterError(f"{id_}: {name} is not a valid {p.kind}")
        return op

    def apply(self, df: DataFrame, id_: str, parameters: dict[str, Any], datasets: dict[str, DataFrame] | None = None) -> DataFrame:
        op = self.check(df, id_, parameters)
        args = {k: (datasets or {})[v] if op.parameters[k].kind == "dataset" and isinstance(v, str) else v for k, v in parameters.items() if v is not None}
        return op.run(df, **args)


registry = Registry()
