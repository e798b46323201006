"""The rules of a word for Arrow batches against the rules as SQL, on known and random words; lists, nulls and what is remembered."""

import random

import pyarrow as pa

from docstrata.functions import scalars as f
from docstrata.functions import shifted as s
from docstrata.functions import shifted_words
from docstrata.functions.dialect import SPARK
from docstrata.plans import shifted
from tests.test_shifted import WORDS

DOWN = str.maketrans(f.UNSHIFTED, f.SHIFTED)


def random_words(n):
    r = random.Random(4)
    signs = "$&'%*()+,<>[]{}ABIMNOPQRSTUVWXYZHJLKDE0123.,-_/–Łé¼·eaz^~}`!�£ſß²Ⅳ"
    known = s.USEFUL + f.COMMON + ["Agreement", "2024H1", "x[1]", "a<b>", "in(the)"]
    odd = ["".join(r.choice(signs) for _ in range(r.randrange(0, 12))) for _ in range(n)]
    return odd + ["".join(r.choice((w, w.capitalize(), w.upper())).translate(DOWN) if r.random() < 0.8 else r.choice(["é", "—", "<", ">", "[", "NO", "QP"]) for w in r.choices(known, k=r.randrange(1, 4))) for _ in range(n)]


def test_rules_are_those_of_the_sql(spark):
    words = sorted({w for w, _, _ in WORDS} | set(random_words(3000)))
    rows = spark.createDataFrame([(w,) for w in words], "x string").selectExpr("x", f"{s.rule_and_word(SPARK, 'x')} AS r").collect()
    assert {r.x: shifted_words.repaired(r.x) for r in rows} == {r.x: (r.r.rule, r.r.fixed) for r in rows}
    assert len({r.r.rule for r in rows}) >= 14


def test_lists_and_nulls(monkeypatch):
    given = pa.array([["WKLV", None, "Q4"], None, [], ["Q4", "WKLV", "WKLV"]], pa.list_(pa.string()))
    asked = []
    monkeypatch.setattr(shifted_words, "repaired", lambda w, plain=shifted_words.repaired: (asked.append(w), plain(w))[1])
    run = shifted_words.repairing()
    this, quarter, none = ({"rule": k, "fixed": w} for k, w in (*map(shifted_words.repaired, ("WKLV", "Q4")), (0, None)))
    asked.clear()
    assert run(given).to_pylist() == [[this, none, quarter], None, [], [quarter, this, this]]
    assert sorted(asked) == ["Q4", "WKLV"]
    # A word that was met is not asked again; what is remembered is bounded and changes nothing.
    assert run(given.slice(3)).to_pylist() == [[quarter, this, this]] and len(asked) == 2
    monkeypatch.setattr(shifted_words, "KNOWN", 1)
    assert shifted_words.repairing()(given).to_pylist() == [[this, none, quarter], None, [], [quarter, this, this]]
    assert shifted_words.repairing_lines()(given).to_pylist() == [f"{this['fixed']} Q4", None, "", f"Q4 {this['fixed']} {this['fixed']}"]


def test_lines_are_those_of_the_sql(spark):
    """Fiscal periods, ampersands and joins of words that are repaired already, in one function and step by step."""
    r = random.Random(9)
    pool = ["OMOQe", "OMOQeN", "N", "O", "e", "eN", "eO", "eNEnNHnO", "F", "e1(", "C", "A1", "B22", "a", "top-", "down", "D", "igital", "elementsand", "level", "D,", "returns", "™s", "user™s", "é", "--", "(OMOQ", "eN)", "0", "-", "200", "byor", "Word."]
    given = [[r.choice(pool) for _ in range(r.randrange(1, 12))] for _ in range(4000)] + [[], ["C"], ["e"]]
    d, at = SPARK, lambda i: f"coalesce(get(ws, {i}), '')"
    rows = spark.createDataFrame(list(enumerate(given)), "k int, ws array<string>")
    rows = rows.selectExpr("k", "ws", f"transform(ws, (w, i) -> CASE WHEN i + 1 < size(ws) THEN {s.fiscal_two(d, 'w', at('i + 1'))} END) AS two").selectExpr("k", "ws", "two", "split(regexp_replace(array_join(transform(two, t -> CASE WHEN t IS NULL THEN '-' ELSE 'x' END), ''), 'x.', 'TS'), '') AS flags")
    rows = rows.selectExpr("k", f"filter(transform(ws, (w, i) -> CASE get(flags, i) WHEN 'T' THEN get(two, i) WHEN 'S' THEN null ELSE coalesce({s.fiscal_one(d, 'w')}, w) END), w -> w IS NOT NULL) AS ws")
    want = {x.k: x.x for x in rows.selectExpr("k", f"{shifted._connected(d)} AS x").selectExpr("k", f"{s.joins(d, 'x')} AS x").collect()}
    got = {k: shifted_words.line(ws) for k, ws in enumerate(given)}
    assert got == want
    assert sum(x != " ".join(ws) for x, ws in zip(got.values(), given, strict=True)) > 1000
