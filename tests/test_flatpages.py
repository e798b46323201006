"""Folds over many pages as columns against the folds over one page's segments, on odd texts and on random ones."""

import random

import numpy as np
import pyarrow as pa
import pytest

from docstrata.operators import columns as repairs
from docstrata.operators import flatpages, layout
from docstrata.operators.layout import Segment

WORDS = "a Word, of.the Longer-words, 12 end. www.x.org mail@y.com Sum 3.4 é ☐ – x\ty \xa0 \x0b one Two Fees....12 ://a Total Amount, y, z. A".split(" ")


def texts(seed, n):
    r = random.Random(seed)
    line = lambda: " ".join(r.choice(WORDS if r.random() < 0.3 else WORDS[:5] + ["", "Part"]) for _ in range(r.choice((0, 1, 3, 9, 30, 60))))
    return [r.choice((None, "", "\n", " ", "\t\n\n a")) if r.random() < 0.15 else "\n".join(line() for _ in range(r.randrange(1, 14))) for _ in range(n)]


def plain_segments(values, spread):
    """A page's segments word by word, by their line and place."""
    rows = []
    for text in values:
        for j, line in enumerate((text or "").split("\n") if text is not None else ()):
            letters = ends = 0
            for i, w in enumerate(line.split(" ")):
                if w:
                    x = 72 + letters * 5.4 + i * 4
                    rows.append((j, i, Segment(w, x + 40 * ends if spread else x, 720.0 - 14 * j, 12.0, len(w) * 12.0 * 0.45, seq=i)))
                    letters, ends = letters + len(w), ends + (w[-1] in ".,")
    return [s for _, _, s in sorted(rows, key=lambda row: row[:2])]


def expected(kind, key, made):
    if kind == "lines":
        return [(key, round(z.y, 3), z.text, len(z.cells)) for z in layout.text_lines(made)]
    if kind == "columns":
        lines = layout.text_lines(made)
        rows = [("window", i, x) for i in range(len(lines) - 1) for x in layout.common_columns(lines[i : i + layout.TABLE_WINDOW])]
        return [(key, *r) for r in rows + [("repeated", i, x) for i, x in enumerate(plain_anchors(made))] + [("run", i, g[0].x) for i, g in enumerate(layout.visual_groups(made))]]
    for k, s in enumerate(made):
        s.seq = k
    return [(key, s.seq, s.text, s.x, s.y, s.width) for s in repairs.repair(612, 792, made)]


def plain_anchors(segments):
    means = []
    for s in segments:
        if s.text.strip() and s.width > 0 and s.text.strip() not in layout.CHECK_BOXES:
            near = next((m for m in means if abs(m[0] - s.x) <= layout.ANCHOR), None)
            if near:
                near[:] = (near[0] * near[1] + s.x) / (near[1] + 1), near[1] + 1
            else:
                means.append([s.x, 1])
    return sorted(m for m, n in means if n >= layout.ANCHOR_SEGMENTS)


FOLDS = {"lines": flatpages.text_lines, "columns": flatpages.shared_columns, "repair": lambda pages: flatpages.repaired(pages, 612, 792)}


def rows(batch):
    return sorted(map(repr, zip(*(c.to_pylist() for c in batch.columns), strict=True)))


@pytest.mark.parametrize("kind", FOLDS)
@pytest.mark.parametrize("seed", range(12))
def test_folds_agree(kind, seed):
    values = texts(seed, 12)
    keys = sorted(random.Random(seed).choice(range(30)) for _ in values)
    spread = kind != "lines"
    got = FOLDS[kind](flatpages.derived(pa.array(keys, pa.int64()), pa.array(values, pa.string()), spread))
    want = [row for key in dict.fromkeys(keys) for row in expected(kind, key, plain_segments([v for k, v in zip(keys, values, strict=True) if k == key], spread))]
    assert rows(got) == sorted(map(repr, want))


@pytest.mark.parametrize("kind", FOLDS)
def test_pages_of_any_shape(kind):
    """Overlaps, repeats, other orders, near lines, several fonts, no width: not only derived places."""
    r = random.Random(7)
    for n in range(60):
        made = []
        for _ in range(r.randrange(1, 40)):
            font = 12.0 if n % 3 else r.choice((6.0, 12.0, 20.0))
            made.append(Segment(r.choice(WORDS) or "w", r.choice((72.0, 100.0, 214.5, 300.0, 302.0, 410.0, 470.0)) + (r.random() if n % 2 else 0), 700.0 - r.randrange(8) * r.choice((14, 14, 2)), font, r.choice((0.0, 5.0, 20.0, 60.0, 400.0)), seq=0))
        if n % 4 == 0:
            made.sort(key=lambda s: (-s.y, s.x))
        for k, s in enumerate(made):
            s.seq = k
        column = lambda name: np.array([getattr(s, name) for s in made])  # noqa: B023, E731
        pages = flatpages.Pages(pa.array([n], pa.int64()), np.zeros(len(made), np.int64), pa.array([s.text for s in made]), *(column(c) for c in ("x", "y", "font", "width", "seq")))
        assert rows(FOLDS[kind](pages)) == sorted(map(repr, expected(kind, n, made)))


def test_chunks_hold_whole_pages(monkeypatch):
    monkeypatch.setattr(flatpages, "CHUNK_BYTES", 10)
    keys, parts = [None, None, 1, 1, 1, 2, 3, 3, 4, 5, 5, 5], [1, 3, 1, 2, 3, 2]
    batches, at = [], 0
    for n in parts:
        batches.append(pa.RecordBatch.from_arrays([pa.array(keys[at : at + n], pa.int64()), pa.array(["text 7"] * n)], ["doc_id", "text"]))
        at += n
    got = [b.column(0).to_pylist() for b in flatpages.whole(iter(batches))]
    assert [k for g in got for k in g] == keys and len(got) == 3
    assert all(a[-1] != b[0] for a, b in zip(got, got[1:], strict=False))


def raised_plainly(segments, anchors):
    """Every anchor, every line, every segment."""
    out = [Segment(**vars(s) | {}) for s in segments]
    lines, moved = layout.visual_groups(segments), {id(s): o for s, o in zip(segments, out, strict=True)}
    for anchor in anchors[1:]:
        for line in lines:
            y, font = line[0].y, max(line[0].font, 8.0)
            side = lambda group, right: [s for s in group if (s.x + 1.5 * font >= anchor) == right]  # noqa: B023, E731
            said = " ".join(s.text for s in side(line, False))
            if not repairs.domain_like(" ".join(s.text for s in side(line, True))) or not said.strip() or repairs.domain_like(said):
                continue
            for other in reversed([o for o in lines if 0 < o[0].y - y <= 2 * font]):
                if repairs.domain_like(" ".join(s.text for s in side(other, False))) and not repairs.domain_like(" ".join(s.text for s in side(other, True))):
                    for s in side(line, True):
                        moved[id(s)].y = other[0].y
                    break
    return out


def test_addresses_are_raised_as_by_all_anchors():
    r = random.Random(3)
    moves = 0
    for _ in range(1500):
        made = [Segment(r.choice(("www.a.org", "Name", "b.com", "Text", " ")), r.randrange(8) * 50.0, 700.0 - r.randrange(6) * 14, 12.0, 30.0, seq=k) for k in range(r.randrange(2, 14))]
        anchors = sorted({r.randrange(9) * 50.0 + r.choice((0, 18, 25)) for _ in range(r.randrange(2, 6))})
        got, want = repairs.raised_domains(made, anchors), raised_plainly(made, anchors)
        assert [s.y for s in got] == [s.y for s in want]
        moves += any(a.y != b.y for a, b in zip(made, want, strict=True))
    assert moves > 20
