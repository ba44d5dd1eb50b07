"""Sinks. Nothing is overwritten."""

from __future__ import annotations

import os
import sqlite3

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digests import multiset_digest, row_digest
from ..plans.errors import ParameterError
from ..plans.plugins import Plugins

#: Rows that a single-file database export takes; larger ones belong in Parquet.
FILE_ROWS = 1_000_000


def export(df: DataFrame, path: str, fmt: str, table: str = "data", plugins: Plugins | None = None) -> None:
    """csv, tsv, json (one array), jsonl, parquet as folders of files; xlsx, sqlite, duckdb as one file of bounded size; any
    other format is the name of a plugin's exporter."""
    w = df.write.mode("errorifexists")
    match fmt:
        case "csv":
            w.option("header", True).option("quoteAll", False).option("escape", '"').csv(path)
        case "tsv":
            w.option("header", True).option("sep", "\t").option("escape", '"').csv(path)
        case "jsonl":
            w.option("ignoreNullFields", False).json(path)
        case "parquet":
            w.option("compression", "zstd").parquet(path)
        case "json" | "xlsx" | "sqlite" | "duckdb":
            _one_file(df, path, fmt, table)
        case _:
            if plugins is None:
                raise ParameterError(f"unknown format {fmt!r}")
            plugins.named("exporter", fmt).export(df, path)


def _one_file(df: DataFrame, path: str, fmt: str, table: str) -> None:
    if os.path.exists(path):
        raise ParameterError(f"{path} exists")
    pdf = df.limit(FILE_ROWS + 1).toPandas()
    if len(pdf) > FILE_ROWS:
        raise ParameterError(f"more than {FILE_ROWS} rows")
    temp = f"{path}.part"
    if os.path.exists(temp):
        os.remove(temp)
    if fmt == "json":
        pdf.to_json(temp, orient="records", date_format="iso")
    elif fmt == "xlsx":
        pdf.to_excel(temp, index=False)
    elif fmt == "sqlite":
        with sqlite3.connect(temp) as con:
            pdf.to_sql(table, con, index=False)
        con.close()
    else:
        import duckdb

        con = duckdb.connect(temp)
        con.register("__rows", pdf)
        con.execute(f'create table "{table}" as select * from __rows')
        con.close()
    os.replace(temp, path)


def dataset_manifest(samples: DataFrame) -> DataFrame:
    """split, n, digest of the samples of each split, in any order."""
    return multiset_digest(samples, row_digest(sorted(samples.columns)), by=["split"])


def export_dataset(samples: DataFrame, path: str, name: str = "dataset", license: str | None = None, media: DataFrame | None = None) -> DataFrame:
    """Writes samples by split, a manifest (split, n, digest), a card in Markdown and, if given, the list of media files that
    samples name (path, sha256, size, media_type); returns the manifest. A sample whose media file isn't listed is
    refused."""
    spark = samples.sparkSession
    if media is not None and not samples.join(media.select(F.col("sha256").alias("asset")), "asset", "left_anti").isEmpty():
        raise ParameterError("a sample names a media file that isn't listed")
    samples.write.mode("errorifexists").option("compression", "zstd").partitionBy("split").parquet(f"{path}/samples")
    dataset_manifest(samples).write.mode("errorifexists").json(f"{path}/manifest")
    out = spark.read.schema("split string, n long, digest string").json(f"{path}/manifest")
    if media is not None:
        media.select("path", "sha256", "size", "media_type").write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/media")
    lines = card(name, license, samples.dtypes, [(r["split"], r["n"], r["digest"]) for r in out.orderBy("split").collect()])  # a row a split
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/card")
    return out


def card(name: str, license: str | None, columns: list[tuple[str, str]], splits: list[tuple[str, int, str]]) -> list[str]:
    """The lines of a dataset's card: a header of fields, its splits with digests, and its columns."""
    head = ["---", f"pretty_name: {name}", *([f"license: {license}"] if license else []), "dataset_info:", "  splits:"]
    head += [line for split, n, _ in splits for line in (f"  - name: {split}", f"    num_examples: {n}")]
    body = ["---", "", f"# {name}", "", "| split | rows | digest |", "| - | - | - |", *[f"| {s} | {n} | {d} |" for s, n, d in splits]]
    return head + body + ["", "| column | type |", "| - | - |", *[f"| {c} | {t} |" for c, t in columns]]


def export_rag(chunks: DataFrame, embeddings: DataFrame, documents: DataFrame, indexes: DataFrame, path: str) -> None:
    """Chunks, vectors and index metadata; refused if an active document has no index."""
    from ..operators.combine import unindexed

    if not unindexed(documents, indexes).isEmpty():
        raise ParameterError("an active document is not indexed")
    for name, d in (("chunks", chunks), ("embeddings", embeddings), ("indexes", indexes)):
        d.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/{name}")


def replace_index(new: DataFrame, path: str) -> None:
    """Replaces the chunks of the assets in `new`, and only these."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("asset_id").parquet(path)
