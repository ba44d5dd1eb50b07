"""Every query with SQL gives what DuckDB gives; the others run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

ORACLE = entry.oracle_sql()
OWN = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.execute(f"create view {t[:-8]} as select * from read_parquet('{sf}/{t}')")
    return c


def plain(rows):
    return sorted(tuple("nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0 if isinstance(v, float) else v) for v in r) for r in rows)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    if name in ORACLE:
        names = sorted(con.sql(ORACLE[name]).columns)
        assert names == cols
        quoted = ", ".join(f'"{c}"' for c in names)
        assert plain(rows) == plain(con.sql(f"select {quoted} from ({ORACLE[name]})").fetchall())


def as_sql(spark, folder, name, **tables):
    """A query over small tables of its own, and its SQL over the same."""
    c = duckdb.connect()
    for t, d in tables.items():
        d.write.parquet(f"{folder}/{t}.parquet")
        c.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    quoted = ", ".join(f'"{x}"' for x in sorted(c.sql(ORACLE[name]).columns))
    found = entry.queries()[name](spark, str(folder)).selectExpr(*quoted.replace('"', "`").split(", ")).collect()
    return plain([tuple(r) for r in found]), plain(c.sql(f"select {quoted} from ({ORACLE[name]})").fetchall())


def test_many_values_in_more_rows(spark, tmp_path):
    """Over 100 names and balances, but under four fifths of the rows."""
    d = spark.range(600).selectExpr("id as c_custkey", "concat('c', id % 200) as c_name", "int(id % 25) as c_nationkey", "double(id * 7 % 300) as c_acctbal", "if(id % 3 = 0, 'A', 'B') as c_mktsegment")
    found, expected = as_sql(spark, tmp_path, "quality_target", customer=d)
    assert found == expected and sum("high_cardinality" in str(r) for r in found) == 3


@pytest.mark.parametrize("n", [0, 3, 90, 170])
def test_cuts_of_a_split(spark, tmp_path, n):
    """90 * 0.7 is 62.99... as a double; a split may have no rows."""
    found, expected = as_sql(spark, tmp_path, "split_random_counts", customer=spark.range(n).selectExpr("id as c_custkey"))
    assert found == expected and len(found) == 3


def test_hashed_texts_that_share_an_id(spark, tmp_path):
    texts = [(1, "One two, one TWO"), (2, "two_3 über ½ 日本 one"), (1, "two one"), (None, "a b a"), (None, "b"), (3, None), (4, " .,"), (1, "one")]
    found, expected = as_sql(spark, tmp_path, "hashed_vectors", documents=spark.createDataFrame(texts, "doc_id long, text string"))
    assert found == expected and {r[1] for r in found} == {"1", "2", "None"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_training_data_part(monkeypatch):
    real = entry.importlib.import_module

    def gone(name):
        if name.startswith("sparkloom.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name)

    monkeypatch.setattr(entry.importlib, "import_module", gone)
    assert "cond_agg_sort" in entry.queries() and "pipeline" not in entry.queries()
    assert entry.oracle_sql()
