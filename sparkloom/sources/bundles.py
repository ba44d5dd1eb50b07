"""Imports kept by content, filtered exports, and bundles from which a result can be made again."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import multiset_digest, row_digest
from ..operators.predicates import query_predicate
from ..plans import recipe
from ..plans.errors import ParameterError
from ..plans.registry import Registry, registry
from . import readers, writers

#: Rows that a filtered export takes, and rows that a sample or a contract's examples show.
EXPORT_ROWS, SAMPLE_ROWS, EXAMPLE_ROWS = 1_000_000, 20, 100


def table_digest(df: DataFrame) -> DataFrame:
    """n and digest of a table's rows, whatever their order, and its columns: one row."""
    return multiset_digest(df, row_digest(df.columns), json.dumps(df.dtypes))


def content_digest(df: DataFrame) -> str:
    return table_digest(df).first()["digest"]


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def normalised(spark: SparkSession, path: str, store: str, file_digest: str, fmt: str | None = None, version: str = "1", **options: Any) -> tuple[DataFrame, str]:
    """A file's table as zstd Parquet in the store, and its key: a digest of the file's digest, format, options and
    version. What is there already is read, not made again."""
    fmt = fmt or readers.infer_format(path)
    key = readers.cache_key(file_digest, fmt, options, version)
    where = f"{store.rstrip('/')}/tables/{key[:2]}/{key}"
    if not _exists(spark, f"{where}/_SUCCESS"):
        readers.read_table(spark, path, fmt, **options).write.mode("overwrite").option("compression", "zstd").parquet(where)
    return spark.read.parquet(where), key


def first_rows(df: DataFrame, order: list[str], n: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows in an order: the sample of a profile or an import."""
    return df.orderBy(*[F.col(f"`{c}`") for c in order]).limit(n)


def contract_examples(failing: DataFrame, order: list[str], n: int = EXAMPLE_ROWS) -> DataFrame:
    """At most n failing rows of a contract, the first in an order."""
    return first_rows(failing, order, n)


def export_query(df: DataFrame, path: str, fmt: str, filters: list[dict] = (), search: str | None = None, columns: list[str] | None = None, most: int = EXPORT_ROWS) -> None:
    """Writes the rows that pass filters and search; refused if there are more than `most`."""
    kept = df.where(query_predicate(df, list(filters), search)).select(*[F.col(f"`{c}`") for c in columns or df.columns])
    if kept.limit(most + 1).count() > most:
        raise ParameterError(f"more than {most} rows")
    writers.export(kept, path, fmt)


def write_bundle(path: str, source: DataFrame, steps: list[dict], datasets: dict[str, DataFrame] | None = None) -> dict:
    """Input, other inputs, steps and output of a recipe below a path, with the digest of each; returns the manifest."""
    spark, datasets = source.sparkSession, datasets or {}
    out, _ = recipe.run(source, steps, datasets)
    tables = {"input": source, "output": out} | {f"datasets/{name}": d for name, d in datasets.items()}
    digests = {}
    for name, d in tables.items():
        d.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/{name}")
        digests[name] = content_digest(spark.read.parquet(f"{path}/{name}"))
    manifest = {"steps": steps, "digests": digests}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")
    return manifest


def replay_bundle(spark: SparkSession, path: str) -> DataFrame:
    """The output made again from a bundle's inputs; refused if a stored table or the new output has another digest."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in manifest["digests"]}
    for name, d in tables.items():
        if content_digest(d) != manifest["digests"][name]:
            raise ParameterError(f"{name} was changed")
    out, _ = recipe.run(tables["input"], manifest["steps"], {n.removeprefix("datasets/"): d for n, d in tables.items() if n.startswith("datasets/")})
    if content_digest(out) != manifest["digests"]["output"]:
        raise ParameterError("the recipe gives another output")
    return out


def submitted(steps: list[dict], datasets: dict[str, DataFrame], store: str, ops: Registry = registry) -> tuple[list[dict], dict[str, DataFrame]]:
    """Steps and inputs as they are at submission: each other table that a step names is kept in the store by its content,
    and the step names that. What happens to a table later doesn't change the result; a table kept before isn't written
    again."""
    bound, kept = [], {}
    for s in recipe.checked(steps):
        parameters = dict(s.get("parameters", {}))
        for name, p in ops.get(s["operation"]).parameters.items():
            if p.kind != "dataset" or not isinstance(parameters.get(name), str):
                continue
            if parameters[name] not in datasets:
                raise ParameterError(f"no dataset {parameters[name]!r}")
            df = datasets[parameters[name]]
            key = content_digest(df)
            where = f"{store.rstrip('/')}/snapshots/{key[:2]}/{key}"
            if not _exists(df.sparkSession, f"{where}/_SUCCESS"):
                df.write.mode("overwrite").option("compression", "zstd").parquet(where)
            parameters[name] = key
            kept[key] = df.sparkSession.read.schema(df.schema).parquet(where)
        bound.append(s | {"parameters": parameters})
    return bound, kept


#: Limits of a stored word model.
MODEL_WORDS, MODEL_LABELS, MODEL_BYTES = 512, 100, 2 << 20


def check_model(model: dict) -> dict:
    """A word model (kind, words, idf or labels and log-probabilities) that is complete, finite and within its limits."""
    words = model.get("words")
    if model.get("kind") not in ("tfidf", "bayes") or not isinstance(words, list) or not 1 <= len(words) <= MODEL_WORDS:
        raise ParameterError(f"a model has a kind and 1 to {MODEL_WORDS} words")
    if len(set(words)) != len(words) or any(not isinstance(w, str) or not w for w in words):
        raise ParameterError("words are different texts")
    if model["kind"] == "tfidf":
        rows = [model.get("idf")]
    else:
        labels = model.get("labels")
        if not isinstance(labels, dict) or not 1 <= len(labels) <= MODEL_LABELS:
            raise ParameterError(f"1 to {MODEL_LABELS} labels")
        if any(not isinstance(x, dict) or not isinstance(x.get("prior"), (int, float)) for x in labels.values()):
            raise ParameterError("each label has a prior")
        rows = [x.get("log_p") for x in labels.values()]
    for row in rows:
        if not isinstance(row, list) or len(row) != len(words) or any(isinstance(v, bool) or not isinstance(v, (int, float)) or v != v or abs(v) == float("inf") for v in row):
            raise ParameterError("one finite number for each word")
    if len(json.dumps(model)) > MODEL_BYTES:
        raise ParameterError("the model is too large")
    return model


def bayes_model(model: DataFrame) -> dict:
    """The stored form of documents.bayes_fit: at most MODEL_WORDS words a label reach the driver."""
    rows = model.orderBy("label", "word").limit(MODEL_WORDS * MODEL_LABELS + 1).collect()
    words = sorted({r["word"] for r in rows})
    labels: dict[str, dict] = {}
    for r in rows:
        labels.setdefault(r["label"], {"prior": r["prior"], "log_p": []})["log_p"].append(r["log_p"])
    return check_model({"kind": "bayes", "words": words, "labels": labels})


def bayes_frame(spark: SparkSession, model: dict) -> DataFrame:
    """A stored model as documents.bayes_classify takes it."""
    rows = [(label, w, float(v), float(x["prior"])) for label, x in check_model(model)["labels"].items() for w, v in zip(model["words"], x["log_p"], strict=True)]
    return spark.createDataFrame(rows, "label string, word string, log_p double, prior double")


def archive_model(spark: SparkSession, model: dict, store: str) -> str:
    """Stores a model by the digest of its content, and returns the digest; the same model is stored once."""
    import hashlib

    text = json.dumps(check_model(model), sort_keys=True, ensure_ascii=False)
    key = hashlib.sha256(text.encode()).hexdigest()
    if not _exists(spark, f"{store}/models/{key}/_SUCCESS"):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{store}/models/{key}")
    return key


def load_model(spark: SparkSession, store: str, key: str) -> dict:
    """A stored model; refused if its content has another digest."""
    import hashlib

    text = spark.read.text(f"{store}/models/{key}", wholetext=True).first()[0].rstrip("\n")
    if hashlib.sha256(text.encode()).hexdigest() != key:
        raise ParameterError("the model was changed")
    return check_model(json.loads(text))
