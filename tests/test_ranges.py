"""Files read in byte ranges are those read whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.plans.errors import ParameterError
from sparkloom.sources import ranges, readers


def quoted(rnd):
    """A value as a CSV file may hold it, and what it is."""
    kind = rnd.randrange(7)
    if kind == 0:
        return "", None
    if kind == 1:
        return '""', ""
    if kind == 2:
        return 'plain "with" quotes', 'plain "with" quotes'
    text = "".join(rnd.choice(['"', ",", "\n", "a", "é", " ", "x,\n", '",\n"', "\r\n"]) for _ in range(rnd.randrange(1, 30))) if kind < 5 else f"word {rnd.random()}"
    return ('"' + text.replace('"', '""') + '"', text) if kind < 5 else (text, text)


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_ranges_of_any_size(tmp_path, size):
    rnd = random.Random(size)
    rows = [[quoted(rnd) for _ in range(3)] for _ in range(40 if size < 10 else 400)]
    raw = "a,b,c\n" + "\n".join(",".join(f for f, _ in r) for r in rows)
    p = tmp_path / "x.csv"
    p.write_bytes(raw.encode())
    scan, f = ranges.Csv(",", 3), ranges._Bytes(str(p))
    parts = [(a, min(a + size, f.size)) for a in range(0, f.size, size)]
    found = []
    for (a, b), state in zip(parts, scan.states([scan.look(f, a, b) for a, b in parts]), strict=True):
        records, places = scan.records(f, a, b, state)
        assert all(a <= at < b for at in places)
        found += records
    assert found == [",".join(x for x, _ in r).encode().rstrip(b"\r") for r in rows]


@pytest.mark.parametrize("size", [1, 5, 97])
def test_arrays_in_ranges_of_any_size(tmp_path, size):
    rnd = random.Random(size)
    texts = ['a "b" \\ c', "[{,]}", "\\", '\\"', "é\n", ""]
    rows = [{"k": i, "t": rnd.choice(texts) * rnd.randrange(1, 4), "n": [{"x": [1, {"y": rnd.choice(texts)}]}, None]} for i in range(60)] + [7, None, "[", []]
    p = tmp_path / "x.json"
    for text in (json.dumps(rows, indent=2), json.dumps(rows, ensure_ascii=False), " [ ] ", "[]"):
        p.write_text(text)
        scan, f = ranges.JsonArray(), ranges._Bytes(str(p))
        parts = [(a, min(a + size, f.size)) for a in range(0, f.size, size)]
        found = []
        for (a, b), state in zip(parts, scan.states([scan.look(f, a, b) for a, b in parts]), strict=True):
            found += scan.records(f, a, b, state)[0]
        assert [json.loads(x) for x in found] == json.loads(text)


def test_one_file_by_many_tasks(spark, tmp_path):
    rnd = random.Random(3)
    p = tmp_path / "wide.csv"
    with p.open("w", newline="") as out:
        out.write("﻿id,text,price\n")
        for i in range(4000):
            text = "".join(rnd.choice(["line\n", 'say ""this"", ', "word "]) for _ in range(6))
            out.write(f'{i},"{text}",{i / 4}\n')
    df = readers.read_csv(spark, str(p), range_bytes=8192)
    assert df.rdd.getNumPartitions() >= 8 and dict(df.dtypes) == {"id": "int", "text": "string", "price": "double"}
    whole = spark.read.options(header=True, quote='"', escape='"', multiLine=True, inferSchema=True).csv(str(p)).toDF("id", "text", "price")
    assert df.exceptAll(whole).isEmpty() and whole.exceptAll(df).isEmpty() and df.count() == 4000
    assert sum(n > 0 for n in df.groupBy(F.spark_partition_id()).count().toPandas()["count"]) >= 8
    with p.open("a", newline="") as out:
        at = p.stat().st_size
        out.write("5,short\n")
    with pytest.raises(Exception, match=f"at byte {at} has 2 fields, not 3"):
        readers.read_csv(spark, str(p), range_bytes=8192).collect()
    assert readers.read_csv(spark, str(p), strict=False, range_bytes=8192).count() == 4001
    with p.open("a") as out:
        out.write('6,"open')
    with pytest.raises(ParameterError, match="not closed"):
        readers.read_csv(spark, str(p), range_bytes=8192)


def test_one_array_by_many_tasks(spark, tmp_path):
    rows = [{"id": i, "t": 'a "quoted" [text] \\ {x}' * (i % 5), "n": {"x": [i, None]}} for i in range(3000)]
    p = tmp_path / "wide.json"
    p.write_text(json.dumps(rows, indent=1))
    df = readers.read_table(spark, str(p), range_bytes=8192)
    assert df.rdd.getNumPartitions() >= 8
    assert sorted((r.id, r.t, tuple(r.n.x)) for r in df.collect()) == [(r["id"], r["t"], tuple(r["n"]["x"])) for r in rows]
    p.write_text('{"id": 1}')
    assert readers.read_table(spark, str(p)).collect()[0].id == 1
    p.write_text("[]")
    assert readers.read_table(spark, str(p)).count() == 0


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_small_ranges_share_tasks(spark, tmp_path, kind):
    """Thousands of ranges don't become thousands of tasks; states go on from range to range within a task."""
    rows = [(i, 'x, "y"\n' * (i % 9)) for i in range(2000)]
    p = tmp_path / f"x.{kind}"
    text = "id,t\n" + "\n".join(f'{i},"{t.replace(chr(34), chr(34) * 2)}"' for i, t in rows) if kind == "csv" else json.dumps([{"id": i, "t": t} for i, t in rows])
    p.write_text(text)
    df = readers.read_table(spark, str(p), range_bytes=32) if kind == "json" else readers.read_csv(spark, str(p), range_bytes=32)
    assert p.stat().st_size > 2000 * 32 and df.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted((r.id, r.t or "") for r in df.collect()) == rows


def test_folders_and_empty_files(spark, tmp_path):
    spark.range(100).selectExpr("id", "concat('a', chr(10), id) t").repartition(3).write.option("header", True).option("escape", '"').csv(str(tmp_path / "d"))
    assert {tuple(r) for r in readers.read_csv(spark, str(tmp_path / "d"), range_bytes=64).collect()} == {(i, f"a\n{i}") for i in range(100)}
    (tmp_path / "e.csv").write_text("a,b\n")
    df = readers.read_csv(spark, str(tmp_path / "e.csv"))
    assert df.columns == ["a", "b"] and df.count() == 0
    with pytest.raises(ParameterError):
        readers.read_csv(spark, str(tmp_path / "none.csv"))
