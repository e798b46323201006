"""Each rule of the shifted-text repair on literal words, in both dialects; the steps of a line in their order."""

import duckdb

from docstrata.functions import shifted as s
from docstrata.functions.dialect import DUCK, SPARK
from docstrata.plans import shifted

#: Words by the number of the rule that decides on them: 1 is the first.
WORDS = [
    ("Ł", 1, "•"), ("total––", 1, "total......"), (">&a>'", 1, "(a)"),
    ("---", 2, "---"), ("…", 2, "…"),
    ("e1(Q3+Q4)", 3, "H1(Q3+Q4)"), ("(e2(Q4", 3, "(H2(Q4"),
    ("Q4", 4, "Q4"), ("(Q1)", 4, "(Q1)"),
    ("12,5", 5, "12,5"), ("(-300.)", 5, "(-300.)"),
    ("IEC-61000", 6, "IEC-61000"), ("$A1_", 6, "$A1_"),
    ("NIQ", 7, "1,4"), ("(IMN)", 7, "(0,01)"),
    ("AB1c", 8, "AB1c"), ("ABC9x!", 8, "ABC9x!"),
    ("OMOQ", 9, "2024"), ("eN", 9, "H1"), ("QP", 9, "43"), ("(NIMMMKR)", 9, "(1,000.5)"),
    ("a1.b", 10, "a1.b"), ("x,9y", 10, "x,9y"),
    ("ABC", 11, "ABC"), ("DW", 11, "DW"),
    ("plain", 12, "plain"), ("Mixed*x", 12, "Mixed*x"),
    ("DQ\\", 14, "any"),
    ("$JUHHPHQW", 15, "Agreement"), ("WKLV+DQG", 15, "thisHand"[:4] + "Hand"),
    ("é$JUHHPHQW", 16, "éAgreement"), ("WKH&—RI&", 16, "theC—ofC"),
    ("<XXX", 18, "<XXX"), ("A[B]", 18, "A[B]"),
    ("ZZZZZZZ", 18, "ZZZZZZZ"),
]


def both(spark, expressions, given):
    """The expressions' values on every given text, the same in both engines; one query each."""
    rows = lambda d: ", ".join(f"({k}, {d.text(x)})" for k, x in enumerate(given))
    listed = lambda d: ", ".join(f"{e(d, 'x')} AS c{i}" for i, e in enumerate(expressions))
    out = [tuple(r) for r in spark.sql(f"SELECT {listed(SPARK)} FROM VALUES {rows(SPARK)} AS t(k, x) ORDER BY k").collect()]
    other = duckdb.sql(f"SELECT {listed(DUCK)} FROM (VALUES {rows(DUCK)}) AS t(k, x) ORDER BY k").fetchall()
    assert out == [tuple(r) for r in other]
    return out


def test_words(spark):
    """Every word's rule and repair; the rule is the first whose test holds."""
    tests = [lambda d, x, k=k: f"coalesce({s.ladder(d, x)[k][0]}, false)" for k in range(len(s.RULES))]
    assert len(s.RULES) == len(s.ladder(DUCK, "x"))
    for (word, rule, want), got in zip(WORDS, both(spark, [s.rule, s.word, *tests], [w for w, _, _ in WORDS]), strict=True):
        assert got[:2] == (rule, want), word
        assert got[2:].index(True) + 1 == rule, word


MARKERS = [
        ("Part one ... NO", "Part one ... 12"), ("Part one .. NO", "Part one .. NO"),
        ("ŒNPŒ and ŒxŒNŒ", "– 13 – and Œx– 1 –"), ("Œ1 2Œ", "Œ1 2Œ"),
        ("see EMNF  and EF", "see (01) and EF"), ("two  spaces", "two  spaces"),
]
STRINGS = [
        ("ŒNŒ", "– 1 –"), ("A[B]c", "A[B]c"), ("some text", "some text"), ("A", "A"),
        ("WKH $JUHHPHQW", "the Agreement"), ("THE LAW OF", "THE LAW OF"),
]
def test_markers_and_file_strings(spark):
    for rule, cases in ((s.markers, MARKERS), (s.text, STRINGS)):
        assert [r[0] for r in both(spark, [rule], [g for g, _ in cases])] == [w for _, w in cases]


LINES = [
        # Pairs are taken before single words, and what is taken is gone.
        ("OMOQe N", "2024H1"), ("OMOQe O actual", "2024H2 actual"), ("OMOQeN OMORe N", "2024H1 2025H1"),
        # A word that could end one pair and begin the next ends the first.
        ("OMOQ eN eN", "2024 H1 H1"),
        ("eNEnNHnO F", "H1(Q1+Q2)"),
        # Labels are read after their digits are: C is an ampersand only between labels.
        ("A1 C A22", "A1 & A22"), ("Vitamin C Tablets", "Vitamin C Tablets"), ("eN C eO", "H1 & H2"),
        # An opening parenthesis asks for prose with a closing one and no sum.
        ("some ordinary prose words E Like these )", "some ordinary prose words (Like these)"), ("some ordinary prose words = E Like these )", "some ordinary prose words = E Like these)"),
        ("gain E Loss )", "gain E Loss)"), ("some ordinary prose words E like these )", "some ordinary prose words E like these)"),
        # The later steps: hyphens, capitals, joined prose, spaces, periods, markers.
        ("a top- down D igital elementsand ( x ) last3 years ŒNŒ", "a top-down Digital elements and (x) last 3 years – 1 –"),
]
def test_lines(spark, monkeypatch):
    """Lines through all steps, in both engines."""
    split = {SPARK: "split", DUCK: "string_split"}

    def given(d):
        rows = ", ".join(f"({k}, {d.text(' '.join(g.split()))})" for k, (g, _) in enumerate(LINES))
        values = f"VALUES {rows} AS t(k, x)" if d is SPARK else f"(VALUES {rows}) AS t(k, x)"
        return f"SELECT 1 AS doc_id, k AS line_no, {split[d]}(x, ' ') AS ws FROM {values}"

    monkeypatch.setattr(shifted, "_broken", given)
    got = {r["line_no"]: r["fixed"] for r in spark.sql(shifted._spark_lines(SPARK)).collect()}
    assert got == {r[1]: r[2] for r in duckdb.sql(shifted._duck_lines(DUCK)).fetchall()}
    for k, (line, want) in enumerate(LINES):
        assert got[k] == want, line


def test_work_of_a_word_is_bounded(spark):
    """Spark's rules name what they use more than once, so their text doesn't grow with each use; a word's rule and repair are asked once, and words that skip rules keep theirs."""
    assert len(s.word(SPARK, "x")) < len(s.word(DUCK, "x")) * 0.6 and len(s.text(SPARK, "x")) < len(s.text(DUCK, "x")) * 0.6
    given = [*(w for w, _, _ in WORDS), "IVMMM", "MIM", "JKLMNOP", "$MMMMMM", "ABCDEFGH", "TKHVHDWV", "Word.", "aM", "éx", "", "e2", "2e1", "20", "Nx,"]
    both(spark, [s.rule, s.word, s.fiscal_one, lambda d, x: s.fiscal_two(d, d.text("OMOQ"), x), s.text, s.markers], given)
    rows = ", ".join(f"({SPARK.text(x)})" for x in given)
    assert spark.sql(f"SELECT r.rule <> {s.rule(SPARK, 'x')} OR r.fixed <> {s.word(SPARK, 'x')} AS bad FROM (SELECT x, {s.rule_and_word(SPARK, 'x')} AS r FROM VALUES {rows} AS t(x)) f").where("bad").count() == 0
