"""Every query that has SQL, against that SQL, on the smallest tables."""

import glob
import os
import re
from collections import Counter

import duckdb
import pytest

from docstrata import catalog
from docstrata.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{source}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(float(v), 9) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in (r[i] for i in order))) for r in values)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = con.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")
def test_furniture_without_broadcast(spark, con):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = catalog.QUERIES["furniture_removed"](spark, DATA)
        want = con.sql(catalog.ORACLES["furniture_removed"])
        assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
        assert "SortMergeJoin" in got._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_furniture_of_odd_lines(spark, tmp_path):
    """Blank lines, null texts, null ids and sources, and lines longer than 100 octets stay; what repeats in a third of a source's documents goes."""
    long = "x" * 101
    wide = "é" * 60
    given = [(k, "a", f"Page {k + 1}/9\n\n{long}\n{wide}\nbody {'abcdef'[k]}") for k in range(6)] + [(None, "a", None), (7, None, "Page 1/9"), (8, "b", "alone")]
    spark.createDataFrame(given, "doc_id bigint, source string, text string").selectExpr("*", "'en' AS lang").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["furniture_removed"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.line) for r in got) == sorted([(k, x) for k in range(6) for x in ("", long, wide, f"body {'abcdef'[k]}")] + [(7, "Page 1/9"), (8, "alone")])


def test_furniture_of_lines_with_much_white_space(spark, tmp_path):
    """Lines are long by their squeezed bytes, wherever their signs stand; the check doesn't step over every sign of a long line."""
    lines = ["a" * 100, "a" * 101, " " * 300 + "b", "c" + "\u3000" * 400 + "d", ("x " * 50).strip(), "x " * 50 + "yz", "\t".join("e" * 50), "é" * 50, "é" * 51, " " * 120 + "f" * 101, " " * 27 + "g" * 100 + " " * 9, " " * 28 + "g" * 101, "", " ", "p 1/2" + " " * 200 + "7"]
    spark.createDataFrame([(i, "\n".join(lines), "en", "web", 1) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in catalog.QUERIES["furniture_keys"](spark, str(tmp_path)).collect()}
    space = re.compile("[\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+")
    keys = Counter(k for x in lines if 1 <= len((k := space.sub(" ", x).strip(" ")).encode()) <= 100)
    assert got == {("web", k.replace("1/2", "#").replace("7", "#"), 4 * n) for k, n in keys.items()}
    assert "{101}" not in catalogue._keyed(catalogue.SPARK)
