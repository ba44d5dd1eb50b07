"""CSV files and JSON arrays read in byte ranges, whatever their quotes and brackets enclose.

Whether a byte lies inside quotes depends on all before it. So each range is first looked at on its own, for each state in
which it may begin; what comes out is a small function from the state at its start to that at its end. The driver composes
these functions over a file's ranges, and with the true states at hand every range is read on its own: it takes the
records that begin in it, reading on past its end for the last one.

Files are opened where the tasks run: at a path that all machines share, or by a URI that Arrow's file systems know.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.errors import ParameterError

RANGE_BYTES = 8 << 20
_QUOTE, _BACKSLASH, _LINE, _RETURN = 0x22, 0x5C, 0x0A, 0x0D


def _system(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder; hidden ones and markers don't count."""
    from pyarrow import fs

    system, at = _system(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise ParameterError(f"no file at {path!r}")
    found = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File]
    scheme = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    return sorted((scheme + f.path, f.size) for f in found if not f.base_name.startswith(("_", ".")))


class _Bytes:
    """A file that is read at any place."""

    def __init__(self, path: str):
        system, at = _system(path)
        self.file = system.open_input_file(at)
        self.size = self.file.size()

    def at(self, start: int, end: int) -> np.ndarray:
        start, end = max(start, 0), min(end, self.size)
        return np.frombuffer(self.file.read_at(end - start, start), np.uint8) if end > start else np.zeros(0, np.uint8)

    def while_byte(self, start: int, byte: int, step: int) -> int:
        """The first place from start on (forwards or backwards) that doesn't hold the byte."""
        while 0 <= start < self.size and self.file.read_at(1, start)[0] == byte:
            start += step
        return start


# --- CSV: outside or inside quotes


def _quote_events(data: np.ndarray, before: int, delimiter: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of an odd number of quotes begin, and whether a field begins there.

    An even run leaves everything as it is. An odd one closes what is open; outside it opens a field if it begins one, and
    else is part of a plain value. A run that goes on from before the data counts there.
    """
    at = np.flatnonzero(data == _QUOTE)
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    size = np.diff(np.append(first, len(at)))
    start = at[first]
    own = (size & 1 == 1) & ~((start == 0) & (before == _QUOTE))
    start = start[own]
    previous = np.where(start > 0, data[np.maximum(start - 1, 0)].astype(np.int16), before) if len(start) else np.zeros(0, np.int16)
    return start, np.isin(previous, [delimiter, _LINE, _RETURN, -1])


def _states(opens: np.ndarray, state: int) -> np.ndarray:
    """The state after each event: one that begins a field turns it around, another leads outside."""
    if not len(opens):
        return np.zeros(0, np.int64)
    turns = np.cumsum(opens)
    last = np.maximum.accumulate(np.where(opens, -1, np.arange(len(opens))))
    return np.where(last >= 0, (turns - turns[np.maximum(last, 0)]) & 1, (state + turns) & 1)


class Csv:
    """Records end at line ends outside quotes."""

    def __init__(self, delimiter: str = ",", fields: int | None = None, header: bool = True):
        self.delimiter, self.fields, self.header = ord(delimiter), fields, header

    def look(self, f: _Bytes, start: int, end: int) -> dict:
        """The state at the end for either state at the start."""
        before = int(f.at(start - 1, start)[0]) if start else -1
        at, opens = _quote_events(f.at(start, f.while_byte(end, _QUOTE, 1)), before, self.delimiter)
        opens = opens[at < end - start]  # a run that begins behind the range is the next one's
        return {"to": [int(s[-1]) if len(s := _states(opens, k)) else k for k in (0, 1)]}

    def after(self, state: int, look: dict) -> int:
        return look["to"][state]

    def joined(self, a: dict, b: dict) -> dict:
        """The look of two ranges in a row."""
        return {"to": [b["to"][k] for k in a["to"]]}

    def states(self, looks: list[dict]) -> list[int]:
        out = [0]
        for x in looks:
            out.append(self.after(out[-1], x))
        if out[-1]:
            raise ParameterError("a quote is not closed")
        return out[:-1]

    def records(self, f: _Bytes, start: int, end: int, state: int) -> tuple[list[bytes], list[int]]:
        """Records that begin in the range, and where."""
        before, more = int(f.at(start - 1, start)[0]) if start else -1, 0
        while True:
            stop = min(f.while_byte(min(end + more, f.size), _QUOTE, 1), f.size)
            data = f.at(start, stop)
            at, opens = _quote_events(data, before, self.delimiter)
            after = np.concatenate([[state], _states(opens, state)])
            outside = lambda x: after[np.searchsorted(at, x)] == 0  # noqa: B023, E731
            lines = np.flatnonzero(data == _LINE)
            lines = lines[outside(lines)]
            if stop == f.size or len(lines) and lines[-1] >= end - 1 - start:
                break
            more = max(2 * more, 1 << 16)
        begins = lines[lines < end - 1 - start] + 1
        if not start:
            begins = np.concatenate([[3 if bytes(data[:3]) == b"\xef\xbb\xbf" else 0], begins])
        elif before == _LINE and state == 0:
            begins = np.concatenate([[0], begins])
        ends = np.append(lines, len(data))[np.searchsorted(lines, begins)]
        marks = np.flatnonzero(data == self.delimiter)
        marks = marks[outside(marks)]
        fields = np.searchsorted(marks, ends) - np.searchsorted(marks, begins) + 1
        raw, out, places = data.tobytes(), [], []
        for i, (a, b, n) in enumerate(zip(begins.tolist(), ends.tolist(), fields.tolist(), strict=True)):
            text = raw[a:b].rstrip(b"\r")
            if self.header and not start and not i or not text.strip():
                continue
            if self.fields is not None and n != self.fields:
                raise ParameterError(f"the record at byte {start + a} has {n} fields, not {self.fields}")
            out.append(text)
            places.append(start + a)
        return out, places


# --- JSON arrays: inside or outside a text, and how many brackets are open


def _texts(data: np.ndarray, lead: int) -> np.ndarray:
    """Whether each byte comes after an odd number of quotes that no backslash escapes. lead: backslashes before the data."""
    slash = data == _BACKSLASH
    count = np.arange(len(data)) - np.maximum.accumulate(np.where(slash, -1, np.arange(len(data))))  # of the run that ends here
    runs = np.where(np.maximum.accumulate(~slash) if len(data) else slash, count, np.arange(len(data)) + 1 + lead)
    behind = np.concatenate([[lead], runs[:-1]]) if len(data) else np.zeros(0, np.int64)
    quote = (data == _QUOTE) & (behind & 1 == 0)
    return (np.cumsum(quote) - quote) & 1


class JsonArray:
    """Records are the elements of the outermost array."""

    _OPEN, _CLOSE, _COMMA = np.frombuffer(b"[{", np.uint8), np.frombuffer(b"]}", np.uint8), 0x2C

    def _steps(self, data: np.ndarray, lead: int, state: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each byte: whether it lies outside texts, and by how much it changes the depth."""
        outside = ((_texts(data, lead) + state) & 1 == 0) & (data != _QUOTE)
        return outside, outside * (np.isin(data, self._OPEN).astype(np.int8) - np.isin(data, self._CLOSE))

    def _lead(self, f: _Bytes, start: int) -> int:
        return start - 1 - f.while_byte(start - 1, _BACKSLASH, -1) if start else 0

    def look(self, f: _Bytes, start: int, end: int) -> dict:
        data, lead = f.at(start, end), self._lead(f, start)
        quotes = int((np.append(_texts(np.append(data, np.uint8(0x20)), lead), 0))[len(data)])
        return {"turn": quotes, "deeper": [int(self._steps(data, lead, k)[1].sum()) for k in (0, 1)]}

    def after(self, state: tuple[int, int], look: dict) -> tuple[int, int]:
        inside, depth = state
        return (inside + look["turn"]) & 1, depth + look["deeper"][inside]

    def joined(self, a: dict, b: dict) -> dict:
        """The look of two ranges in a row."""
        return {"turn": a["turn"] ^ b["turn"], "deeper": [a["deeper"][k] + b["deeper"][(k + a["turn"]) & 1] for k in (0, 1)]}

    def states(self, looks: list[dict]) -> list[tuple[int, int]]:
        out = [(0, 0)]
        for x in looks:
            out.append(self.after(out[-1], x))
        if out[-1] != (0, 0):
            raise ParameterError("the array is not closed")
        return out[:-1]

    def records(self, f: _Bytes, start: int, end: int, state: tuple[int, int]) -> tuple[list[bytes], list[int]]:
        inside, depth = state
        lead, more = self._lead(f, start), 0
        while True:
            data = f.at(start, end + more)
            outside, step = self._steps(data, lead, inside)
            deep = depth + np.cumsum(step)
            # an element ends at a comma of the array, or where the array is closed; one begins behind that comma or the opening
            ends = np.flatnonzero(outside & ((data == self._COMMA) & (deep == 1) | (step == -1) & (deep == 0)))
            opening = np.flatnonzero((step == 1) & (deep == 1))[:1] if depth == 0 else np.zeros(0, np.int64)
            begins = np.sort(np.concatenate([opening, ends[data[ends] == self._COMMA]])) + 1
            begins = begins[begins <= end - start]
            if not len(begins) or len(ends) and ends[-1] >= begins[-1] or end + more >= f.size:
                break
            more = max(2 * more, 1 << 16)
        raw, out, places = data.tobytes(), [], []
        for a in begins.tolist():
            b = int(ends[np.searchsorted(ends, a)]) if len(ends) and ends[-1] >= a else len(raw)
            if raw[a:b].strip():
                out.append(raw[a:b].strip())
                places.append(start + a)
        return out, places


# --- as a data source


def _steps(start: int, end: int, size: int) -> list[tuple[int, int]]:
    return [(a, min(a + size, end)) for a in range(start, end, size)]


def _kind(options: dict) -> Csv | JsonArray:
    return Csv(options["delimiter"], options.get("fields"), options["header"]) if options["kind"] == "csv" else JsonArray()


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, state):
        self.path, self.start, self.end, self.state = path, start, end, state


class _Records(DataSource):
    """file, offset, value: the text of each record."""

    @classmethod
    def name(cls) -> str:
        return "sparkloom_records"

    def schema(self) -> str:
        return "file string, offset long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _RecordReader(json.loads(self.options["plan"]))


class _RecordReader(DataSourceReader):
    def __init__(self, plan: dict):
        self.plan = plan

    def partitions(self) -> list[InputPartition]:
        return [_Range(*r) for r in self.plan["ranges"]] or [_Range("", 0, 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if part.end <= part.start:
            return
        state = tuple(part.state) if isinstance(part.state, list) else part.state
        scan, f, records, places = _kind(self.plan), _Bytes(part.path), [], []
        for a, b in _steps(part.start, part.end, self.plan["step"]):
            try:
                found, at = scan.records(f, a, b, state)
            except ParameterError as e:
                raise ParameterError(f"{part.path}: {e}") from None
            if b < part.end:
                state = scan.after(state, scan.look(f, a, b))
            records += found
            places += at
            if len(records) < 10_000 and b < part.end:
                continue
            for i in range(0, len(records), 10_000):
                own = records[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(own)), pa.array(places[i : i + 10_000], pa.int64()), pa.array(own, pa.binary()).cast(pa.string())], ["file", "offset", "value"])
            records, places = [], []


def records(spark: SparkSession, path: str, kind: str, delimiter: str = ",", fields: int | None = None, header: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file, offset, value of every record of CSV files or JSON arrays, by ranges of bytes. A task takes a range, or several
    in a row where there are many small ones, up to RANGE_BYTES. fields: how many a CSV record must have; another is an
    error that names its place."""
    options = {"kind": kind, "delimiter": delimiter, "fields": fields, "header": header, "step": range_bytes}
    found = files(path)
    tasks, steps = 4 * spark.sparkContext.defaultParallelism, sum(-(-n // range_bytes) for _, n in found)
    span = range_bytes * max(1, min(RANGE_BYTES // range_bytes, -(-steps // tasks)))
    ranges = [(p, a, b) for p, n in found for a, b in _steps(0, n, span)]

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = _kind(options)
        for p in parts:
            own = []
            for path, a, b in zip(p["path"], p["a"], p["b"], strict=True):
                f = _Bytes(path)
                own.append(json.dumps(reduce(scan.joined, (scan.look(f, *x) for x in _steps(int(a), int(b), range_bytes)))))
            yield pd.DataFrame({"n": p["n"], "found": own})

    looks: list[dict] = []
    if len(ranges) > len(found):  # a file of one range begins and ends outside
        numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(ranges)], "n long, path string, a long, b long")
        got = numbered.repartition(min(len(ranges), 8 * spark.sparkContext.defaultParallelism), "n").mapInPandas(look, "n long, found string")
        looks = [json.loads(r["found"]) for r in got.orderBy("n").collect()]  # a few numbers a range
    plan = []
    scan = _kind(options)
    for p, _ in found:
        own = [i for i, r in enumerate(ranges) if r[0] == p] if looks else []
        states = scan.states([looks[i] for i in own]) if looks else []
        plan += [(*ranges[i], s) for i, s in zip(own, states, strict=True)] if looks else [(*r, 0 if kind == "csv" else (0, 0)) for r in ranges if r[0] == p]
    spark.dataSource.register(_Records)
    return spark.read.format("sparkloom_records").option("plan", json.dumps(options | {"ranges": plan})).load()


def first_record(path: str, delimiter: str = ",") -> str:
    """The header of a CSV file, or of the first file of a folder."""
    for p, n in files(path):
        f, end = _Bytes(p), 1 << 16
        while n:
            found = Csv(delimiter, None, False).records(f, 0, min(end, n), 0)[0]
            if found:
                return found[0].decode()
            if end >= n:
                break
            end *= 2
    return ""


def parsed(spark: SparkSession, values: DataFrame, fmt: str, schema: str | None = None, **options) -> DataFrame:
    """A column of records as Spark's own reader of the format takes them."""
    texts = getattr(values._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    reader = spark.read.options(**options)
    reader = reader.schema(schema) if schema else reader
    return DataFrame(getattr(reader._jreader, fmt)(texts), spark)


def read_csv_ranges(spark: SparkSession, path: str, names: list[str], delimiter: str, all_text: bool, strict: bool, range_bytes: int = RANGE_BYTES) -> DataFrame:
    values = records(spark, path, "csv", delimiter, len(names) if strict else None, True, range_bytes).select("value")
    options = {"header": False, "sep": delimiter, "quote": '"', "escape": '"'}
    schema = ", ".join(f"`{n}` string" for n in names)
    if not all_text:
        kinds = parsed(spark, values, "csv", inferSchema=True, **options).schema
        if len(kinds) == len(names):
            schema = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, kinds, strict=True))
    return parsed(spark, values, "csv", schema, mode="FAILFAST" if strict else "PERMISSIVE", **options)


def read_json_array(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The elements of arrays; a file that holds a single object is one."""
    found = files(path)
    heads = {bytes(_Bytes(p).at(0, 4096)).lstrip(b"\xef\xbb\xbf \t\r\n")[:1] for p, n in found if n}
    if heads - {b"["}:
        return spark.read.json(path, multiLine=True)
    return parsed(spark, records(spark, path, "json", range_bytes=range_bytes).select("value"), "json")
