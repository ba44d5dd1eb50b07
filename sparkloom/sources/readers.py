"""Scans. Every reader returns a DataFrame; what the files are is found by suffix unless it is named."""

from __future__ import annotations

import csv
import fnmatch
import hashlib
import io
import json
import sqlite3
import zipfile
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.digests import multiset_digest
from ..plans.errors import ParameterError
from . import ranges

#: Formats by suffix.
SUFFIXES = {"csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "parquet": "parquet", "xlsx": "xlsx", "db": "sqlite", "sqlite": "sqlite", "sqlite3": "sqlite", "duckdb": "duckdb"}
DELIMITERS = (",", ";", "\t", "|")


def infer_format(path: str) -> str:
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in SUFFIXES:
        raise ParameterError(f"unknown suffix {suffix!r}")
    return SUFFIXES[suffix]


def csv_header(first_line: str, delimiter: str) -> list[str]:
    """Names of a header; empty and repeated ones are errors. A byte-order mark is accepted."""
    names = next(csv.reader(io.StringIO(first_line.lstrip("﻿")), delimiter=delimiter), [])
    if not names or any(not n.strip() for n in names):
        raise ParameterError("the header has an empty name")
    if len({n.strip().lower() for n in names}) != len(names):
        raise ParameterError("the header repeats a name")
    return names


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", all_text: bool = False, strict: bool = True, range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """With a header. strict: ragged records fail, and the error says where. all_text: every column stays text, leading
    zeros and all. A file is read in ranges of range_bytes, each a task, whatever its quotes enclose."""
    if delimiter not in DELIMITERS:
        raise ParameterError("the delimiter is one of , ; tab |")
    names = csv_header(ranges.first_record(path, delimiter), delimiter)
    return ranges.read_csv_ranges(spark, path, names, delimiter, all_text, strict, range_bytes)


class _FilePart(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class _FileTable(DataSource):
    """A table of a SQLite or DuckDB file that executors can open at the same path."""

    @classmethod
    def name(cls) -> str:
        return "sparkloom_file_table"

    def schema(self) -> str:
        kind, path, table = self.options["kind"], self.options["file"], self.options["table"]
        rows = _describe(kind, path, table)
        return ", ".join(f"`{n}` {t}" for n, t in rows)

    def reader(self, schema) -> DataSourceReader:
        return _FileReader(dict(self.options), [f.name for f in schema.fields], [f.dataType.simpleString() for f in schema.fields])


class _FileReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str], kinds: list[str]):
        self.o, self.names, self.kinds = options, names, kinds

    def partitions(self) -> list[InputPartition]:
        ends = f"select min(rowid), max(rowid) from {_quoted(self.o['table'])}"
        try:
            if self.o["kind"] == "sqlite":
                a, b = sqlite3.connect(f"file:{self.o['file']}?mode=ro", uri=True).execute(ends).fetchone()
            else:
                import duckdb

                a, b = duckdb.connect(self.o["file"], read_only=True).execute(ends).fetchone()
        except Exception:  # noqa: BLE001  a view or a table without row ids: one range
            return [_FilePart(None, None)]
        if a is None:
            return [_FilePart(0, -1)]
        step = max(1, -(-(b - a + 1) // int(self.o.get("partitions", 8))))
        return [_FilePart(x, min(x + step - 1, b)) for x in range(a, b + 1, step)]

    def read(self, part: _FilePart) -> Iterator[tuple]:
        cast = {"bigint": int, "double": float, "string": str}
        cols, table = ", ".join(map(_quoted, self.names)), _quoted(self.o["table"])
        if self.o["kind"] == "sqlite":
            con = sqlite3.connect(f"file:{self.o['file']}?mode=ro", uri=True)
            where = "" if part.low is None else f" where rowid between {part.low} and {part.high}"
            rows = con.execute(f"select {cols} from {table}{where}")
        else:
            import duckdb

            where = "" if part.low is None else f" where rowid between {part.low} and {part.high}"
            found = duckdb.connect(self.o["file"], read_only=True).execute(f"select {cols} from {table}{where}")
            rows = chain.from_iterable(iter(lambda: found.fetchmany(10_000), []))
        for r in rows:
            yield tuple(None if v is None else cast.get(k, lambda x: x)(v) for v, k in zip(r, self.kinds, strict=True))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _describe(kind: str, path: str, table: str) -> list[tuple[str, str]]:
    if kind == "sqlite":
        rows = sqlite3.connect(f"file:{path}?mode=ro", uri=True).execute(f"pragma table_info({_quoted(table)})").fetchall()
        return [(n, "bigint" if "INT" in (t or "").upper() else "double" if any(x in (t or "").upper() for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else "string") for _, n, t, *_ in rows]
    import duckdb

    rows = duckdb.connect(path, read_only=True).execute(f"describe {_quoted(table)}").fetchall()
    known = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp"}
    return [(r[0], known.get(r[1], "string")) for r in rows]


def list_tables(path: str, kind: str | None = None) -> list[str]:
    """Tables of a database file, in the order in which the first is the default (SQLite by name, DuckDB as shown)."""
    kind = kind or infer_format(path)
    if kind == "sqlite":
        return [r[0] for r in sqlite3.connect(f"file:{path}?mode=ro", uri=True).execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name")]
    if kind == "duckdb":
        import duckdb

        return [r[0] for r in duckdb.connect(path, read_only=True).execute("show tables").fetchall()]
    if kind == "xlsx":
        return list(pd.ExcelFile(path).sheet_names)
    return []


def read_database(spark: SparkSession, path: str, table: str | None = None, kind: str | None = None, partitions: int = 8) -> DataFrame:
    """A table of a SQLite or DuckDB file, the first if none is named, read in ranges of rowid."""
    kind = kind or infer_format(path)
    tables = list_tables(path, kind)
    table = table or (tables[0] if tables else None)
    if table not in tables:
        raise ParameterError(f"no table {table!r}")
    spark.dataSource.register(_FileTable)
    return spark.read.format("sparkloom_file_table").options(kind=kind, file=path, table=table, partitions=str(partitions)).load()


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Any of csv, tsv, json (an array), jsonl, parquet, xlsx, sqlite, duckdb."""
    fmt = fmt or infer_format(path)
    match fmt:
        case "csv" | "tsv":
            return read_csv(spark, path, options.pop("delimiter", "\t" if fmt == "tsv" else ","), **options)
        case "json":
            return ranges.read_json_array(spark, path, **options)
        case "jsonl":
            return spark.read.json(path)
        case "parquet":
            return spark.read.parquet(path)
        case "xlsx":
            return spark.createDataFrame(pd.read_excel(path, sheet_name=options.get("sheet", 0)))
        case "sqlite" | "duckdb":
            return read_database(spark, path, options.get("table"), fmt)
    raise ParameterError(f"unknown format {fmt!r}")


def with_limits(df: DataFrame, rows: int = 200_000, columns: int = 1000) -> DataFrame:
    """The frame, or an error at run time if it has more rows or columns. Off unless called."""
    if len(df.columns) > columns:
        raise ParameterError(f"more than {columns} columns")
    n = df.agg(F.count(F.lit(1)).alias("__n")).select(F.when(F.col("__n") > rows, F.raise_error(F.lit(f"more than {rows} rows"))).otherwise(F.lit(True)).alias("__ok"))
    return df.crossJoin(F.broadcast(n)).where("__ok").drop("__ok")  # one row


def binary_assets(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, sha256, size, media_type, content of files."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kinds = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif", "mp4": "video/mp4", "wav": "audio/wav", "mp3": "audio/mpeg", "pdf": "application/pdf", "txt": "text/plain", "md": "text/markdown", "html": "text/html", "csv": "text/csv"}
    media = F.coalesce(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[suffix], F.lit("application/octet-stream"))
    return d.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), media.alias("media_type"), "content")


def unique_assets(assets: DataFrame) -> DataFrame:
    """One row for each digest: identical bytes are stored once."""
    return assets.groupBy("sha256").agg(F.min_by(F.struct("path", "size", "media_type"), "path").alias("a"), F.count(F.lit(1)).alias("copies")).select("sha256", "a.*", "copies", F.concat(F.lit("objects/sha256/"), F.substring("sha256", 1, 2), F.lit("/"), "sha256").alias("object_key"))


def expand_zip(archives: DataFrame, max_entries: int = 20_000, max_bytes: int = 20 << 30, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """path, entry, size, sha256, content, skipped: entries of archives; what is skipped has a reason and no content.

    All or nothing: an archive over a limit, or broken, is one row with a reason.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for path, content in zip(p["path"], p["content"], strict=True):
                rows: list[tuple] = []
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                    infos, seen = z.infolist(), set()
                    if len(infos) > max_entries or sum(i.file_size for i in infos) > max_bytes:
                        raise ValueError("limits")
                    for i in infos:
                        n = i.filename.replace("\\", "/")
                        why = (
                            "directory" if n.endswith("/") else "traversal" if n.startswith("/") or ".." in n.split("/") or ":" in n.split("/")[0] else "symlink" if (i.external_attr >> 16) & 0o170000 == 0o120000
                            else "duplicate" if n.lower() in seen else "empty" if i.file_size == 0 else "unsupported" if suffixes and not n.lower().endswith(suffixes) else None
                        )
                        seen.add(n.lower())
                        body = None if why else z.read(i)
                        rows.append((path, n, i.file_size, hashlib.sha256(body).hexdigest() if body else None, body, why))
                except (ValueError, zipfile.BadZipFile, RuntimeError) as e:
                    rows = [(path, None, None, None, None, "limits" if str(e) == "limits" else "broken")]
                yield pd.DataFrame(rows, columns=["path", "entry", "size", "sha256", "content", "skipped"])

    return archives.select("path", "content").mapInPandas(run, "path string, entry string, size long, sha256 string, content binary, skipped string")


def filter_files(files: DataFrame, allow: list[str] = (), ignore: list[str] = (), max_size: int | None = None, max_files: int | None = None, order: str = "position") -> DataFrame:
    """Files by case-sensitive globs and size, the first max_files in their order."""
    p = F.lit(not allow)
    for g in allow:
        p = p | F.col("path").rlike(fnmatch.translate(g).replace(r"\z", "$").replace(r"\Z", "$"))
    for g in ignore:
        p = p & ~F.col("path").rlike(fnmatch.translate(g).replace(r"\z", "$").replace(r"\Z", "$"))
    if max_size is not None:
        p = p & (F.col("size") <= max_size)
    out = files.where(p).orderBy(order)
    return out.limit(max_files) if max_files is not None else out


def manifest_hash(files: DataFrame, snapshot: str, options: dict) -> DataFrame:
    """manifest: one digest of a snapshot, its files (path, sha256, size, in any order) and options."""
    row = F.sha2(F.concat_ws("/", "sha256", F.col("size").cast("string"), "path"), 256)
    return multiset_digest(files, row, json.dumps({"snapshot": snapshot, "options": options}, sort_keys=True)).select(F.col("digest").alias("manifest"))


def cache_key(file_hash: str, fmt: str, options: dict, version: str) -> str:
    """Key of an analysis: digest of file, format, options and parser version."""
    return hashlib.sha256(json.dumps({"file": file_hash, "format": fmt, "options": options, "version": version}, sort_keys=True).encode()).hexdigest()
