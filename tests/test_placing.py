"""Band joins against all pairs, with places on the grid's borders; plans without nested loops; odd rows."""

import random

import pytest

from docstrata.operators import placing


def frame(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_against_all_pairs(spark, how):
    rng = random.Random(1)
    # Places in steps of a half: bands of 3 and 8 meet their cells' borders often.
    side = lambda n, first: [(rng.choice([1, 2, None]), first + k, rng.randint(-30, 60) / 2, rng.randint(0, 40) / 2) for k in range(n)]
    left, right = side(120, 0), side(120, 1000)
    a, b = frame(spark, left, "page int, a int, ax double, ay double"), frame(spark, right, "page int, b int, bx double, by double")
    near = lambda p, q: p[0] is not None and p[0] == q[0] and -1 <= q[2] - p[2] <= 2 and 0 <= q[3] - p[3] <= 8
    got = placing.band_join(a, b, ["page"], {"ax": ("bx", -1.0, 2.0), "ay": ("by", 0.0, 8.0)}, how)
    if how == "inner":
        assert sorted((r.a, r.b) for r in got.collect()) == sorted((p[1], q[1]) for p in left for q in right if near(p, q))
    else:
        assert sorted(r.a for r in got.collect()) == sorted(p[1] for p in left if any(near(p, q) for q in right) == (how == "left_semi"))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()


LINK = "page int, number int, href string, x double, y double, width double, height double"
SEGMENT = "page int, number int, text string, x double, y double, font double, width double, rotation double"


def test_links(spark):
    links = frame(spark, [(1, 0, "https://www.a.org/x", 72.0, 500.0, 100.0, 12.0), (1, 1, "http://www.a.org/x/", 72.0, 500.0, 120.0, 12.0), (1, 2, "http://", 72.0, 500.0, 9.0, 12.0), (None, 3, "http://www.a.org/x", 72.0, 500.0, 9.0, 12.0)], LINK)
    top = 792.0 - 500 - 12
    at = lambda down: 792.0 - (top - down) - 10
    segments = [
        (1, 0, "WWW.A.ORG/X see www.", 72.0, at(0), 10.0, 20.0, 0.0),
        (1, 1, "www.a.org / x/.", 82.0, at(24), 10.0, 20.0, 0.0),  # as far above and aside as can be
        (1, 2, "www.a.org/x", 82.5, at(24), 10.0, 20.0, 0.0),  # too far aside
        (1, 3, "www.a.org/x", 72.0, at(4), 10.0, 20.0, 0.0),  # on the line
        (1, 4, "www.a.org/x", 72.0, at(4), 10.0, 95.0, 0.0),  # wide enough
        (1, 5, "www.a.org/x", 72.0, at(9), 10.0, 20.0, 90.0),  # rotated
        (1, 6, " E ", 70.0, at(0) + 6.5, 10.0, 8.0, 0.0),  # a stray mark
        (1, 7, "E", 70.0, at(0) + 6.6, 10.0, 8.0, 0.0),
        (1, 8, "E", 70.5, at(0), 10.0, 8.0, 0.0),
        (None, 9, "www.a.org/x", 72.0, at(9), 10.0, 20.0, 0.0),
        (1, 10, None, None, None, None, None, None),
    ]
    got = {r.number: r for r in placing.lay_links(frame(spark, segments, SEGMENT), links).collect()}
    assert set(got) == set(range(11)) - {6}
    # Of two links the first by number wins.
    assert got[1].moved and got[1].text == "www.a.org/x" and got[1].y == at(0) and got[1].width == 100.0
    assert got[3].text == "www.a.org/x" and got[3].width == 100.0 and not got[3].moved and got[3].y == at(4)
    assert all(got[k].width == dict((s[1], s[6]) for s in segments)[k] and not got[k].moved for k in (0, 2, 5, 7, 8, 9, 10))
    # The second link's address with its slash reads the same, and it is wider.
    assert got[4].width == 120.0
    assert placing.lay_links(frame(spark, [], SEGMENT), links).count() == 0


def test_sum_signs(spark):
    base = [("40", 300.0, 400.0, 8.0, 9.0), ("h=2", 316.0, 364.0, 8.0, 9.0), ("Ih", 336.0, 380.0, 10.0, 9.0), ("THD", 200.0, 380.0, 10.0, 50.0)]
    page = lambda p, rows: [(p, k, *r) for k, r in enumerate(rows)]
    rows = page(1, base) + page(2, base + [("a ∑", 318.0, 400.0, 8.0, 9.0)]) + page(3, base[:3]) + page(4, base[:1] + [("h=2", 316.5, 364.0, 8.0, 9.0)] + base[2:]) + page(5, base[:2] + [("Ih", 308.0, 380.0, 10.0, 9.0)] + base[3:]) + page(None, base)
    lines = frame(spark, rows, "page int, number int, text string, x double, y double, font double, width double")
    (one,) = placing.sum_signs(lines).collect()
    assert one.page == 1 and one.font == 17.5 and one.x == pytest.approx(300 - 2.45) and one.width == pytest.approx(7.875)
    assert placing.sum_signs(lines.limit(0)).count() == 0


def test_fiscal_quarters(spark):
    year = (1, 0, "2024", 100.0, 500.0, 10.0, 18.0, 0.0)
    rows = [
        year, (1, 1, "43", 125.5, 500.0, 10.0, 9.0, 0.0), (1, 2, "44", 125.6, 500.0, 10.0, 9.0, 0.0), (1, 3, "43", 116.5, 502.5, 10.0, 9.0, 0.0), (1, 4, "43", 116.4, 500.0, 10.0, 9.0, 0.0),
        (1, 5, "44", 120.0, 502.6, 10.0, 9.0, 0.0), (1, 6, "44", 120.0, 500.0, 12.0, 9.0, 0.0), (1, 7, "44", 120.0, 500.0, 10.0, 9.0, 90.0), (1, 8, "45", 120.0, 500.0, 10.0, 9.0, 0.0), (2, 9, "43", 120.0, 500.0, 10.0, 9.0, 0.0),
        (None, 10, "43", 120.0, None, 10.0, 9.0, 0.0),
    ]
    got = {r.number: r.fixed for r in placing.fiscal_quarters(frame(spark, rows, SEGMENT)).collect()}
    assert got == {0: "2024", 1: "Q3", 2: "44", 3: "Q3", 4: "43", 5: "44", 6: "44", 7: "44", 8: "45", 9: "43", 10: "43"}


def test_anchor_to_right(spark):
    from pyspark.sql import functions as F

    rows = [(10.0, 4.0, [5.0, 10.0, 28.0, 12.0]), (10.0, 4.0, [28.5]), (10.0, 10.0, [40.0]), (10.0, 10.0, []), (None, 1.0, [1.0])]
    df = spark.createDataFrame(rows, "x double, f double, a array<double>")
    assert [r[0] for r in df.select(placing.anchor_to_right(F.col("x"), F.col("f"), F.col("a"))).collect()] == [12.0, None, 40.0, None, None]
