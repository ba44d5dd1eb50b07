"""Recipes: lists of steps that become one plan, with placeholders, a small script syntax, versions and replay."""

from __future__ import annotations

import ast
import hashlib
import json
import re
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .errors import ParameterError
from .registry import Registry, registry

MAX_STEPS = 30
_HOLE = re.compile(r"\{\{\s*([A-Za-z_]\w*)\s*(?::(.*?))?\}\}", re.S)


def bind(steps: Any, values: dict[str, Any]) -> Any:
    """Placeholders {{name:default}} by values; a string that is one placeholder takes the value's type (default: JSON)."""
    if isinstance(steps, list):
        return [bind(x, values) for x in steps]
    if isinstance(steps, dict):
        return {k: bind(v, values) for k, v in steps.items()}
    if not isinstance(steps, str):
        return steps

    def value(m: re.Match) -> Any:
        if m[1] in values:
            return values[m[1]]
        if m[2] is None:
            raise ParameterError(f"no value for {m[1]}")
        try:
            return json.loads(m[2])
        except ValueError:
            return m[2]

    if whole := _HOLE.fullmatch(steps):
        return value(whole)
    return _HOLE.sub(lambda m: str(value(m)), steps)


def compile_script(text: str, ops: Registry = registry) -> list[dict]:
    """Steps from lines of the form data = operation(data, name=literal). Nothing is executed."""
    try:
        tree = ast.parse(text)
    except SyntaxError as e:
        raise ParameterError(f"line {e.lineno}: not a script") from e
    steps = []
    for node in tree.body:
        match node:
            case ast.Assign(targets=[ast.Name(id="data")], value=ast.Call(func=ast.Name(id=op), args=[ast.Name(id="data")], keywords=kw)):
                ops.get(op)
                try:
                    steps.append({"operation": op, "parameters": {k.arg: ast.literal_eval(k.value) for k in kw if k.arg}})
                except ValueError as e:
                    raise ParameterError(f"line {node.lineno}: parameters are literals") from e
                if any(k.arg is None for k in kw):
                    raise ParameterError(f"line {node.lineno}: parameters are named")
            case _:
                raise ParameterError(f"line {node.lineno}: only data = operation(data, name=value)")
    return checked(steps)


def checked(steps: list[dict]) -> list[dict]:
    if not 1 <= len(steps) <= MAX_STEPS:
        raise ParameterError(f"1 to {MAX_STEPS} steps")
    return steps


def run(df: DataFrame, steps: list[dict], datasets: dict[str, DataFrame] | None = None, ops: Registry = registry) -> tuple[DataFrame, dict[int, DataFrame]]:
    """The table after all steps, as one lazy plan, and the reports of report-only steps by their number."""
    reports: dict[int, DataFrame] = {}
    for i, s in enumerate(checked(steps)):
        out = ops.apply(df, s["operation"], s.get("parameters", {}), datasets)
        if ops.get(s["operation"]).report_only:
            reports[i] = out
        else:
            df = out
    return df, reports


def key(input_digest: str, steps: list[dict], ops: Registry = registry) -> str:
    """Key of a result: digest of input, steps and operation versions."""
    versions = {s["operation"]: ops.get(s["operation"]).version for s in steps}
    return hashlib.sha256(json.dumps([input_digest, steps, versions], sort_keys=True).encode()).hexdigest()


class VersionStore:
    """Immutable versions of a table below a path. A commit names the revision it was made from.

    A commit writes its rows to a folder of its own first, and then one log file named by the new revision, which must
    not exist: of two that were made from one revision, the second to write the log fails and stays invisible. (The check
    is as strict as the file system's: a store without atomic creation leaves a gap of milliseconds.)
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> list[dict]:
        try:
            return [json.loads(r[0]) for r in self.spark.read.option("recursiveFileLookup", "true").text(f"{self.path}/log").collect()]  # one short row a commit
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def revision(self) -> int:
        return max((x["revision"] for x in self._log()), default=0)

    def commit(self, df: DataFrame, steps: list[dict], base: int) -> int:
        """Writes a new version, unless another commit came first."""
        if base != self.revision():
            raise ParameterError(f"made from revision {base}, the table is at {self.revision()}")
        new, data = base + 1, f"data/{uuid.uuid4().hex}"
        df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{self.path}/{data}")
        entry = json.dumps({"revision": new, "base": base, "steps": steps, "data": data})
        try:
            self.spark.createDataFrame([(entry,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{self.path}/log/{new:09d}")
        except Exception as e:
            if "PATH_ALREADY_EXISTS" in str(e):
                raise ParameterError(f"another commit made revision {new}") from e
            raise
        return new

    def load(self, revision: int | None = None) -> DataFrame:
        log = {x["revision"]: x["data"] for x in self._log()}
        if not log or (revision or max(log)) not in log:
            raise ParameterError(f"no revision {revision}")
        return self.spark.read.parquet(f"{self.path}/{log[revision or max(log)]}")

    def restore(self, revision: int) -> int:
        return self.commit(self.load(revision), [{"operation": "restore", "parameters": {"revision": revision}}], self.revision())

    def steps(self, revision: int) -> list[dict]:
        return next(x["steps"] for x in self._log() if x["revision"] == revision)
