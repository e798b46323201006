"""The positional index against brute force: proximity, document borders, the order and grouping of rows, blocks of items."""

import random

import numpy as np
import pytest

from docstrata.llm import decontam

TERMS = "a b c d e f g h i j k l m".split()


def plain_near(text, items, window, slack):
    ws, found = (text or "").lower().split(), set()
    for name, item in items:
        terms = item.lower().split()
        for k in range(max(1, len(terms) - window + 1)) if terms else ():
            part = terms[k : k + window]
            size = len(part) + slack
            if any({*part} <= {*ws[s : s + size]} for s in range(max(1, len(ws)))):
                found.add(name)
    return sorted(found)


def plain_exact(text, items, window):
    ws, found, hit = (text or "").lower().split(), set(), set()
    for name, item in items:
        terms = item.lower().split()
        for k in range(max(1, len(terms) - window + 1)) if terms else ():
            part = terms[k : k + window]
            for s in range(len(ws) - len(part) + 1):
                if ws[s : s + len(part)] == part:
                    found.add(name)
                    hit |= {*range(s, s + len(part))}
    return sorted(found), len(hit)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(11)
    texts = [None, "", "A b C", "a a a a", *(" ".join(rng.choice(TERMS) for _ in range(rng.choice((2, 5, 9, 30, 200)))) for _ in range(70))]
    items = [(str(i), " ".join(rng.choice(TERMS) for _ in range(rng.choice((1, 3, 4, 6, 9))))) for i in range(25)] + [("x", "zz a b c"), ("y", ""), ("0", "a b")]
    return list(enumerate(texts)), items


@pytest.mark.parametrize(("block", "segment", "parts"), [(8 << 20, 2 << 20, 1), (60, 300, 3), (8 << 20, 64, 2), (100, 2 << 20, 1)])
@pytest.mark.parametrize("slack", [0, 2])
def test_matches_against_brute_force(spark, tables, monkeypatch, block, segment, parts, slack):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontam, "SEGMENT_BYTES", segment)
    docs, items = tables
    frame = spark.createDataFrame([docs[i] for i in random.Random(parts).sample(range(len(docs)), len(docs))], "doc_id bigint, text string").repartition(parts)
    got = decontam.matches(frame, spark.createDataFrame(items, "item_id string, text string"), 4, slack).collect()
    assert len(got) == len(docs)
    for r in got:
        text = docs[r.doc_id][1]
        assert (r["items"], r.n_hit) == plain_exact(text, items, 4)
        assert r.near == plain_near(text, items, 4, slack)
        assert r.n_words == len((text or "").split())
        assert len({w for s in r.spans for w in range(s.start, s.end)}) == r.n_hit


def test_no_match_over_a_border(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, "f g h i j"), (4, None), (5, "j i h g f e d c b a")], "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: (r["items"], r.near) for r in decontam.matches(docs, spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id int, text string")).collect()}
    assert got == {1: ([], []), 2: ([], []), 3: ([], []), 4: ([], []), 5: ([], ["1"])}


def test_postings_come_back():
    rng = random.Random(2)
    for n in (0, 1, 7):
        texts = [" ".join(rng.choice(TERMS) for _ in range(rng.randint(0, 3000))).encode() for _ in range(n)]
        made = decontam.Segment.of(texts)
        back = decontam.Segment.unpacked(made.n_words, made.terms, made.counts, made.packed())
        assert np.array_equal(back.positions, made.positions)
        every = [w for t in texts for w in t.split()]
        first = 0
        for term, count in zip(made.terms.to_pylist(), made.counts.tolist(), strict=True):
            assert [i for i, w in enumerate(every) if w == term] == back.positions[first : first + count].tolist()
            first += count


def test_ids_of_any_kind_and_no_rows(spark):
    docs = spark.createDataFrame([("x", "a b c", 1), ("x", "a b c", 1), (None, "q", 2)], "doc_id string, text string, segment int")
    bench = spark.createDataFrame([(1, "b c")], "item_id int, text string")
    assert sorted((r.doc_id or "", r.n_hit) for r in decontam.matches(docs, bench).collect()) == [("", 0), ("x", 2), ("x", 2)]
    assert decontam.matches(docs.limit(0), bench).count() == 0 and decontam.matches(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert [r.doc_id for r in decontam.decontaminate(docs, bench).collect()] == [None]
