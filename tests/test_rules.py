"""Rules on inputs with known results, in both dialects; layout rules on small pages."""

import duckdb
import pyarrow as pa
import pytest

from docstrata.functions import scalars as f
from docstrata.functions.dialect import DUCK, SPARK
from docstrata.operators import layout
from docstrata.plans import catalogue
from docstrata.sources import markdown

LONG = "The committee shall publish a yearly report on the state of rivers"
CASES = [
    (f.text_score, ("The parties shall meet",), 12 * 2 + 6 * 2 + 3 * 4),
    (f.text_score, ("xkcdbrtw ]~ (of)",), 12 + 3 - 8 - 20),
    (f.text_score, ("",), 0),
    (f.readable, ("a = b",), True),
    (f.readable, ("= = a",), False),
    (f.readable, ("□",), True),
    (f.readable, ("| * =",), False),
    (f.symbol_noise, ("ab^",), True),
    (f.symbol_noise, ("abcdefgh^",), False),
    (f.symbol_noise, ("abcdefgh^}",), True),
    (f.symbol_noise, ("a|*%#",), False),
    (f.symbol_noise, ("^}1",), False),
    (f.bullet_prose, ("• four words are here",), True),
    (f.bullet_prose, ("- four words are here",), False),
    (f.definition_prose, (LONG,), True),
    (f.definition_prose, (LONG.upper(),), False),
    (f.definition_prose, (LONG + " www.rivers.org",), False),
    (f.column_start, ("(Total",), True),
    (f.column_start, ("/Total",), False),
    (f.column_start, ("see ftp://x",), True),
    (f.column_start, ("École",), False),
    (f.leader_label, ("Part one ..... NP",), "Part one"),
    (f.leader_page, ("Part one ... (17)",), "(17)"),
    (f.leader_label, ("Part one . . . 17",), ""),
    (f.leader_label, ("Part one ..... N7",), ""),
    (f.marker_digits, ("(MNV)",), "019"),
    (f.marker_digits, ("N7",), ""),
    (f.classify_score, (59.9,), "Substantially different"),
]


def literal(value):
    return f"CAST({value} AS DOUBLE)" if isinstance(value, float) else "'" + value.replace("'", "''") + "'"


@pytest.mark.parametrize(("rule", "given", "want"), CASES)
def test_text_rules(spark, rule, given, want):
    for d, run in ((SPARK, lambda q: spark.sql(q).first()[0]), (DUCK, lambda q: duckdb.sql(q).fetchall()[0][0])):
        args = [literal(v) for v in given]
        assert run("SELECT " + rule(d, *args)) == want


def numbers(spark, parts):
    out = []
    for run in (lambda q: tuple(spark.sql(q).first()), lambda q: duckdb.sql(q).fetchall()[0]):
        out.append([None if v is None else round(float(v), 6) for v in run("SELECT " + ", ".join(f"{p} AS c{i}" for i, p in enumerate(parts)))])
    assert out[0] == out[1]
    return out[0]


def test_geometry_rules(spark):
    m, n = ("2", "1", "-1", "3", "10", "20"), ("1", "0", "4", "1", "5", "6")
    assert numbers(spark, f.times(m, n)) == [2, 1, 7, 7, 14, 43]
    assert numbers(spark, f.moved(m, "1", "2")) == [10, 27]
    assert numbers(spark, f.moved_box(("0", "1", "-1", "0", "0", "0"), "1", "2", "3", "4")) == [-6, 1, 4, 3]
    assert numbers(spark, f.drawn_line("1", "5", "9", "5.05", "2")) == [1, 4, 8, 2]
    assert numbers(spark, f.drawn_line("3", "9", "3", "1", "0.1")) == [2.875, 1, 0.25, 8]
    assert numbers(spark, f.drawn_line("3", "9", "5", "1", "1")) == [None] * 4
    for d in (SPARK, DUCK):
        assert numbers(spark, [f"CASE WHEN {f.wide_clip(d, '90.0', '25.0')} THEN 1 ELSE 0 END", f"CASE WHEN {f.wide_clip(d, '100.0', '20.0')} THEN 1 ELSE 0 END"]) == [0, 1]
    assert round(float(spark.sql("SELECT " + f.advance(SPARK, "'a b c'", "10", "1", "2", "50", "2")).first()[0]), 6) == (10 + 4 + 4) * 0.5 * 2


def test_image_rules(spark):
    boxes = [(100, 200, 150), (100, 23, 300), (300, 60, 60), (740, 150, 40), (740, 500, 45)]
    for d in (SPARK, DUCK):
        assert numbers(spark, [f"CASE WHEN {f.content_image(d, y, w, h)} THEN 1 ELSE 0 END" for y, w, h in boxes]) == [1, 0, 0, 0, 1]
        assert numbers(spark, [f"CASE WHEN {f.background(d, c, s, w, 800)} THEN 1 ELSE 0 END" for c, s, w in (("'#fff'", "NULL", 590), ("'#fff'", "NULL", 580), ("NULL", "NULL", 612), ("'#fff'", "'#000'", 612))]) == [1, 0, 0, 0]
    for d, run in ((SPARK, lambda q: spark.sql(q).first()[0]), (DUCK, lambda q: duckdb.sql(q).fetchall()[0][0])):
        anchors = f"{'array' if d is SPARK else 'list_value'}(500e0, 330e0, 300e0, 220e0, 200e0)"
        # 200 is no right column, 500 none either; from 90 on, 220 is too near.
        assert [run(f"SELECT {f.anchor_inside(d, anchors, x, w)}") for x, w in (("72", "400"), ("90", "250"), ("90", "230"), ("180", "400"))] == [220, 300, None, 330]


def seg(text, x, y, font=12.0, width=None, seq=0):
    return layout.Segment(text, x, y, font, len(text) * 6.0 if width is None else width, seq=seq)


def test_cells_begin_at_gaps():
    line = [seg("a", 10, 0, width=10), seg("b", 40.9, 0, width=10), seg("c", 71.9, 0, width=60), seg("d", 80, 0, width=5), seg("e", 153, 0)]
    assert [[s.text for s in c] for c in layout.split_cells(line)] == [["a", "b"], ["c", "d"], ["e"]]


def test_anchors_follow_the_running_mean():
    assert layout.repeated_anchors([seg("w", x, 0) for x in (100, 103, 104.4, 50, 50, 200, 200.5, 199.5)]) == pytest.approx([102.466666, 200.0])
    assert layout.repeated_anchors([seg("□ ", 10, y) for y in range(5)]) == []
    assert layout.repeated_anchors([seg("-", 10, y) for y in range(5)]) == [10]


def test_columns_are_cut_by_distance_not_by_bins():
    lines = layout.text_lines([seg(t, x, y) for y, xs in ((60, (10, 103.9)), (40, (11, 104.1)), (20, (14, 99))) for t, x in zip("pq", xs, strict=True)])
    assert layout.common_columns(lines) == [10, 103.9]


def test_many_groups_between_lines():
    page = [seg("left", 10, 100.0)] + [layout.Segment("t", 50 + 9 * k, 99.9 - k / 10, 12, 5, turn=20.0 * (k + 1)) for k in range(12)] + [seg("right", 300, 98.0)]
    assert "left right" in [z.text for z in layout.text_lines(page)]


def test_visual_runs():
    assert [[s.text for s in g] for g in layout.visual_groups([seg("a", 1, 100), seg("b", 2, 96), seg("c", 3, 95), seg("d", 4, 91, 40)])] == [["a", "b"], ["c", "d"]]


def test_wrapped_cells_go_on():
    rows = [("Part", 10, 100), ("Use", 120, 100), ("bolt", 10, 84), ("holds the", 120, 84), ("cover", 121, 68), ("nut", 10, 52), ("ends it", 120, 52), ("Left of all", 0, 36)]
    (table, *rest) = layout.page_blocks([seg(t, x, y, seq=i) for i, (t, x, y) in enumerate(rows)])
    assert [[c[0][0][1] for c in r] for r in table.rows] == [["Part", "Use"], ["bolt", "holds the cover"], ["nut", "ends it"]]
    assert [b.kind for b in rest] == ["paragraph"]


def test_double_spaces_are_no_heading():
    lines = layout.text_lines([seg("Big  gap", 10, 200, 20), seg("text", 10, 100), seg("text", 10, 80)])
    lines[0].text = "Big  gap"
    assert not layout.is_heading(lines, 0, 12)


def test_deep_quotes_end():
    found = markdown.parse("> " * 3000 + "x")
    depth = 0
    block = found.blocks[0]
    while block.kind == "quote":
        block, depth = block.children[0], depth + 1
    assert depth == markdown.DEPTH + 1 and block.inlines[0][1] == "x"


def test_box_and_line_rules(spark):
    assert numbers(spark, [f.line_width(("0.1", "0", "0", "0.2", "9", "9"), "10"), f.line_width(("0", "0", "0", "0", "0", "0"), "4"), f.line_width(("3", "4", "0", "1", "0", "0"), "2")]) == [2, 0.04, 10]
    for d in (SPARK, DUCK):
        cases = [f.black_box(d, "'#000'", "NULL", "6", "8"), f.black_box(d, "'#000'", "'#000'", "6", "8"), f.black_box(d, "'#000000'", "NULL", "5", "8"), f.black_box(d, "'#000'", "NULL", "612", "792"), f.white_box(d, "'#fff'", "NULL", "3", "3"), f.white_box(d, "'#fffffe'", "NULL", "3", "3")]
        assert numbers(spark, [f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in cases]) == [1, 0, 0, 0, 1, 0]
    for run in (lambda q: spark.sql(q).first()[0], lambda q: duckdb.sql(q).fetchall()[0][0]):
        held = "SELECT {0} FROM (SELECT 0 AS x, 0 AS y, 20 AS w, 20 AS h) a CROSS JOIN (SELECT {1} AS x, 5 AS y, {2} AS w, 10 AS h) b"
        assert [run(held.format(f.holds_box(SPARK, "a", "b"), x, w)) for x, w in ((5, 10), (-1.5, 20), (-2, 10), (0, 21))] == [True, True, False, False]


def test_split_words(spark):
    for d, run in ((SPARK, lambda q: spark.sql(q).first()[0]), (DUCK, lambda q: duckdb.sql(q).fetchall()[0][0])):
        fixed = f.literal(d, f.literal(d, f.hyphenated(d, "'break- down, step -wise; D igital ensurea EU™s plan'"), f.SPLIT_CAPITALS), f.JOINED_PROSE)
        assert run("SELECT " + fixed) == "break-down, step-wise; Digital ensure a EU's plan"


def test_places_of_words_without_a_window(spark):
    """Words of short and of very long lines stand where the check's SQL puts them, and Spark deals texts at most, not words."""
    texts = ["one two.  three,\n\n a  b", " ".join(["w" * (k % 5) + "." * (k % 7 == 0) for k in range(700)]), "é, x. y", ""]
    spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string").createOrReplaceTempView("placed_documents")
    documents = pa.table({"doc_id": list(range(len(texts))), "text": texts, "lang": ["en"] * len(texts), "source": ["s"] * len(texts)})
    con = duckdb.connect()
    con.register("placed_documents", documents)
    for rows in (catalogue._words, catalogue._spread, catalogue._cells):
        columns = "doc_id, line_no, seq, text, y, font, width, x" + (", cell" if rows is catalogue._cells else "")
        sql = lambda d: f"SELECT {columns} FROM ({rows(d).replace('@documents', 'placed_documents')}) r ORDER BY doc_id, line_no, seq"  # noqa: E731, B023
        found = spark.sql(catalogue._dealt(spark, sql(SPARK)))
        assert [tuple(r) for r in found.collect()] == con.sql(sql(DUCK)).fetchall()
        plan = spark.sql(catalogue._dealt(spark, rows(SPARK).replace("@documents", "placed_documents")))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == (rows is catalogue._cells)
