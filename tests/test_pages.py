"""The rules of lines and pages on literal rows, in both dialects, the first that holds deciding."""

from collections import Counter

import duckdb
import pytest

from docstrata import catalog
from docstrata.functions.dialect import DUCK, SPARK
from docstrata.plans import pages

PROSE = "an ordinary sentence with more than forty letters"
#: line, font, cells, wide, touching; rule and whether cells are rendered.
LINES = [
    ("write to <a@b.org>", 12, 1, False, False, 1, True), ("a@b = c.d e@f", 12, 1, False, False, 2, False),
    ("x = y", 12, 3, True, False, 2, False), ("x = y", 12, 4, True, False, 8, True),
    ("one >&two>' three four", 12, 1, True, False, 3, False), ("one >&two>'", 12, 1, True, False, 8, True),
    ("the step -wise plan", 12, 1, True, False, 4, False), ("top- down a b", 12, 1, True, False, 8, True),
    ("Part one ..... 12", 12, 1, False, False, 5, True), ("Part one ..... xii", 12, 1, False, False, 12, False),
    ("• four words are here", 12, 1, True, False, 6, False), ("• FOUR WORDS ARE HERE", 12, 1, True, False, 8, True),
    (PROSE, 12, 1, True, False, 7, False), (PROSE, 13, 1, True, False, 8, True), (PROSE, 12, 2, False, True, 9, True),
    ("short", 12, 2, True, True, 8, True),
    ("six words that are not many", 11, 2, False, True, 9, True), ("six words that are not many", 10.5, 2, False, True, 12, False),
    ("X " * 36, 12, 1, False, False, 10, False),
    ("© 2020", 12, 1, False, False, 11, False),
    ("", 12, 0, False, False, 12, False),
]
CELLS = "large rotated across down bulleted n_shapes short definitions n_lines n_cells long".split()
#: The sums of a page; rule and whether whole lines are rendered.
PAGES = [
    ((True, True, 9, 9, 9, 1, 9, 9, 99, 999, 99), 1, False),
    ((False, True, 9, 9, 9, 1, 9, 9, 99, 999, 99), 2, False),
    ((False, False, 8, 6, 9, 1, 9, 9, 99, 999, 99), 3, False), ((False, False, 8, 5, 4, 20, 0, 0, 1, 1, 0), 4, True),
    ((False, False, 0, 0, 4, 21, 0, 0, 1, 1, 0), 7, False), ((False, False, 0, 0, 3, 20, 3, 0, 1, 1, 0), 5, True),
    ((False, False, 0, 0, 0, 20, 2, 1, 1, 1, 0), 6, True), ((False, False, 0, 0, 0, 21, 9, 9, 19, 99, 99), 7, False),
    ((False, False, 0, 0, 0, 21, 9, 9, 20, 40, 12), 8, True), ((False, False, 0, 0, 0, 21, 9, 9, 20, 39, 12), 9, False), ((False, False, 0, 0, 0, 21, 9, 9, 20, 40, 11), 9, False),
]


def shown(d, value):
    return d.text(value) if isinstance(value, str) else f"CAST({value} AS DOUBLE)" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value).lower()


@pytest.mark.parametrize("d", [SPARK, DUCK], ids=["spark", "duck"])
def test_ladders(spark, d):
    def run(columns, rows, rule, result):
        values = ", ".join("(" + ", ".join(shown(d, v) for v in (k, *row)) + ")" for k, row in enumerate(rows))
        source = f"VALUES {values} AS t(k, {columns})" if d is SPARK else f"(VALUES {values}) AS t(k, {columns})"
        query = f"SELECT {rule}, {result} FROM {source} ORDER BY k"
        return [tuple(r) for r in (spark.sql(query).collect() if d is SPARK else duckdb.sql(query).fetchall())]

    rule, cells = pages._first(pages.line_ladder(d, "x", "font", "n", "wide", "near"))
    assert run("x, font, n, wide, near", [r[:5] for r in LINES], rule, cells) == [r[5:] for r in LINES]
    rule, whole = pages._first(pages.page_ladder())
    assert run(", ".join(CELLS), [r[0] for r in PAGES], rule, whole) == [r[1:] for r in PAGES]
    assert len(pages.LINE_RULES) == len(pages.line_ladder(d, "x", "f", "n", "w", "t")) and len(pages.PAGE_RULES) == len(pages.page_ladder())


def test_pages_of_odd_ids_and_long_gaps(spark, tmp_path):
    """Missing and repeated ids, words behind long white space, against the check's SQL; texts are read and judged once."""
    prose = "these are some words of a line, with parts; and more"
    texts = ["\n".join([prose, " " * 200 + prose, "a1b " * 60 + prose, "x@y.org " * 3, "• one two three four words", "", "l-wise one two three", "1+1=2"] * n) for n in (1, 3, 5)]
    spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in zip([1, 2, 3, None], [*texts, texts[0]])], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    for t in ("documents", "lineitem"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = catalog.QUERIES["p29_p33_render_modes"](spark, str(tmp_path))
    want = con.sql(catalog.ORACLES["p29_p33_render_modes"])
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
    assert got._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1
    # Pages of one id are one page; the SQL has repeated lines once.
    twice = tmp_path / "twice"
    spark.createDataFrame([(1, t, "en", "web", len(t)) for t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(twice / "documents.parquet"))
    spark.read.parquet(f"{tmp_path}/lineitem.parquet").write.parquet(str(twice / "lineitem.parquet"))
    rows = catalog.QUERIES["p29_p33_render_modes"](spark, str(twice)).collect()
    assert len(rows) == sum(1 for t in texts for x in t.split("\n") if x.strip()) and len({(r.page_rule, r.whole_lines) for r in rows}) == 1
