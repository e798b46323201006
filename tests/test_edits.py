"""Edit logs against a plain replay, on given tables and on random logs; rules at block borders."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docstrata.operators import edits
from docstrata.plans import edited

SF = "/root/testdata/sf0.001"


def plain(blocks, log):
    """One edit after the other on lists."""
    blocks = [[k, n, list(c)] for k, n, c in blocks]
    for op, b, at, text, kind, level, style in log:
        inline = lambda i: 0 <= i < len(blocks) and blocks[i][0] in edits.INLINE  # noqa: B023, E731
        if not blocks and op in ("insert", "split"):
            if op == "split" or text:
                blocks.append(["paragraph", 0, [(c, style or 0) for c in text or ""] if op == "insert" else []])
            continue
        if b is None or at is None or not 0 <= b < len(blocks):
            continue
        chars = blocks[b][2]
        at = max(0, min(at, len(chars)))
        if op == "insert" and inline(b):
            chars[at:at] = [(c, style or 0) for c in text or ""]
        elif op == "backspace" and at > 0 and inline(b):
            del chars[at - 1]
        elif op == "delete" and at < len(chars) and inline(b):
            del chars[at]
        elif op in ("backspace", "delete") and (op == "delete" or at == 0):
            left = b - 1 if op == "backspace" else b
            if inline(left) and inline(left + 1) and at in (0, len(chars)):
                blocks[left][2] += blocks[left + 1][2]
                del blocks[left + 1]
        elif op == "split" and inline(b):
            if not chars and blocks[b][0] in ("bullet", "numbered", "quote"):
                blocks[b] = ["paragraph", 0, []]
            else:
                head = blocks[b][0] == "heading"
                blocks.insert(b + 1, ["paragraph" if head else blocks[b][0], 0 if head else blocks[b][1], chars[at:]])
                del chars[at:]
        elif op == "turn" and kind in edits.INLINE and inline(b):
            blocks[b][:2] = kind, level or 0
    return [(k, n, c) for k, n, c in blocks]


def replayed(spark, cases):
    rows = [(i, [(k, n, c) for k, n, c in blocks] if blocks is not None else None, log) for i, (blocks, log) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i int, blocks {edits.BLOCKS}, log {edits.LOG}")
    got = df.select("i", edits.replay(F.col("blocks"), F.col("log")).alias("b"), edits.path(F.col("blocks"), F.lit(0), F.lit(2)).alias("p")).collect()
    return {r.i: [(b.kind, b.level, [tuple(c) for c in b.chars]) for b in r.b] for r in got}, {r.i: r.p for r in got}


def test_random_logs(spark):
    rng = random.Random(7)
    kinds = [*edits.INLINE, "table", "rule"]
    cases = []
    for _ in range(60):
        blocks = [(rng.choice(kinds), rng.randint(0, 3), [(rng.choice("abc"), rng.randint(0, 31)) for _ in range(rng.randint(0, 6))]) for _ in range(rng.randint(0, 5))]
        blocks = [(k, n, c if k in edits.INLINE else []) for k, n, c in blocks]
        log = [(rng.choice(["insert", "backspace", "delete", "split", "turn", "other", None]), rng.choice([-1, 0, 1, 2, 3, None]), rng.choice([-2, 0, 1, 2, 9, None]), rng.choice(["xy", "", None]), rng.choice([*kinds, None]), rng.choice([1, None]), rng.choice([4, None])) for _ in range(rng.randint(0, 25))]
        cases.append((blocks, log))
    cases += [(None, [("insert", 0, 0, "new", None, None, 1)]), (cases[0][0], None)]
    got, _ = replayed(spark, cases)
    for i, (blocks, log) in enumerate(cases):
        assert got[i] == plain(blocks or [], log or []), (blocks, log)


def test_paths(spark):
    a = [("a", 0), ("b", 3)]
    cases = [([("heading", 2, a)], []), ([("bullet", 0, a)], []), ([("numbered", 0, [("x", 16 | 8 | 4)])], []), ([("table", 0, [])], []), ([], [])]
    _, paths = replayed(spark, cases)
    assert [paths[k] for k in range(5)] == ["body > h2 > strong > em", "body > ul > li > strong > em", "body > ol > li > code > u > s", "body > table", "body"]


@pytest.mark.parametrize("sf", [SF])
def test_query_against_plain(spark, sf):
    got = {}
    for r in edited.edited(spark, sf).orderBy("doc_id", "place").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.level, r.text, r.styles))
    pages = {r.doc_id: [(b.kind, b.level, [tuple(c) for c in b.chars]) for b in r.blocks] for r in edited.pages(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    logs = {r.doc_id: [tuple(e) for e in r.log] for r in edited.logs(spark.read.parquet(f"{sf}/events.parquet")).collect()}
    both = set(pages) & set(logs)
    assert both and set(got) == both
    for i in both:
        assert got[i] == [(k, n, "".join(c for c, _ in chars), sum(s for _, s in chars)) for k, n, chars in plain(pages[i], logs[i])]


def test_runs_give_what_characters_give(spark):
    """Blocks of runs against blocks of characters, signs beyond the basic plane too."""
    rng = random.Random(9)
    chars = [("a\U0001f600b", 0), ("cé", 3), ("x", 1)]
    single = [(c, n) for run, n in chars for c in run]
    logs = [[(rng.choice(["insert", "backspace", "delete", "split", "turn"]), rng.randint(0, 2), rng.randint(-1, 8), "y\U0001f600", "code", 1, 4) for _ in range(20)] for _ in range(40)]
    rows = [([("paragraph", 0, chars), ("quote", 0, chars)], [("paragraph", 0, single), ("quote", 0, single)], log) for log in logs]
    df = spark.createDataFrame(rows, f"runs {edits.BLOCKS}, blocks {edits.BLOCKS}, log {edits.LOG}")
    for r in df.select("log", edits.replay_runs(F.col("runs"), F.col("log")).alias("a"), edits.replay(F.col("blocks"), F.col("log")).alias("b"), *[edits.path(F.col(c), F.lit(0), F.lit(k)).alias(f"{c}{k}") for c in ("runs", "blocks") for k in (0, 4)]).collect():
        spread = lambda blocks: [(b.kind, b.level, [(c, x.style) for x in b.chars for c in x.ch]) for b in blocks]
        assert spread(r.a) == spread(r.b) == plain(rows[0][1], [tuple(e) for e in r.log])
        assert (r.runs0, r.runs4) == (r.blocks0, r.blocks4) == ("body > p", "body > p > strong > em")


def test_long_text_and_log(spark):
    """A log of 3,000 edits of a text of 500,000 characters; a copy of its characters for each edit takes minutes."""
    log = [("insert", 0, k, "z", None, None, 1) for k in range(3000)]
    df = spark.createDataFrame([([("paragraph", 0, [("a" * 500_000, 0)])], log)], f"blocks {edits.BLOCKS}, log {edits.LOG}")
    began = time.time()
    (b,) = df.select(edits.replay_runs(F.col("blocks"), F.col("log")).alias("b")).first().b
    assert "".join(c.ch for c in b.chars) == "z" * 3000 + "a" * 500_000 and time.time() - began < 60
