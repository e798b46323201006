"""Column repair on small pages."""

import pytest

from docstrata.operators import columns
from docstrata.operators.layout import Segment


def seg(text, x, y, width=None, font=10.0, seq=0):
    return Segment(text, x, y, font, len(text) * 4.5 if width is None else width, seq=seq)


def shown(segments):
    return sorted(((round(s.x, 2), s.y, s.text) for s in segments), key=lambda v: (-v[1], v[0]))


def band(x, ys):
    return [seg("Cell", x, y) for y in ys]


def test_cells_snap_to_the_right_column():
    page = [seg("Name", 50, 500), seg("Value", 260, 500, 60), *band(300, (520, 540, 480))]
    assert (300, 500, "Value") in shown(columns.snapped(600, page, [50, 300]))
    assert page[1].x == 260
    # Small letters do not begin a column; a cell stands at it; a check box is in the line.
    for line in ([seg("value", 260, 500, 60)], [seg("Value", 260, 500, 60), seg("Other", 310, 500)], [seg("☐", 60, 500), seg("Value", 260, 500, 60)]):
        moved = columns.snapped(600, [seg("Name", 10, 500), *line, *band(300, (520, 480))], [300])
        assert [s.x for s in moved if s.text.lower() == "value"] == [260]
    # The column does not go on below.
    assert columns.snapped(600, [seg("Name", 50, 500), seg("Value", 260, 500, 60), *band(300, (520,))], [300])[1].x == 260


def test_occupied():
    line = [seg("a", 300, 0), seg("b", 280, 0)]
    assert columns.occupied(line, 295, line[0]) and not columns.occupied(line, 295.1, line[0])
    assert not columns.occupied(line[:1], 300, line[0])


def test_anchor_inside():
    s = seg("x", 50, 0, 400)
    assert columns.anchor_inside(600, [500, 330, 250, 190, 100], s) == 250
    assert columns.anchor_inside(600, [431], seg("x", 50, 0, 400)) is None
    assert columns.anchor_inside(600, [240], seg("x", 108, 0, 400)) is None


def test_cuts():
    assert columns.cut_at(seg("Head office in town Branch 12 abroad", 50, 0), 170) == ("Head office in town", "Branch 12 abroad")
    assert columns.cut_at(seg("head office in town", 50, 0), 170) is None
    assert columns.cut_at(seg("Head", 50, 0), 170) is None
    # No cut is near enough.
    assert columns.cut_at(seg("a B", 50, 0), 400) is None


def test_texts_over_two_columns():
    wide = seg("Head office in town ABCBranch abroad", 50, 500, 300)
    page = [wide, *band(250, (520, 480, 460))]
    assert shown(columns.cut_columns(600, page, [50, 250]))[1:3] == [(50, 500, "Head office in town"), (250, 500, "ABC Branch abroad")]
    assert columns.cut_columns(600, [wide, *band(250, (520,))], [50, 250])[0] == wide
    # The address goes up to the heading on its left.
    page = [seg("www.above.example.org", 52, 515), seg("some words stand here www.next.org", 50, 500, 300), *band(250, (530, 480))]
    assert (250, 515, "www.next.org") in shown(columns.cut_columns(600, page, [50, 250]))


def test_raised_domains():
    page = [seg("www.one.org", 50, 515), seg("of the office", 50, 500), seg("www.two.org", 300, 500)]
    assert (300, 515, "www.two.org") in shown(columns.raised_domains(page, [50, 300]))
    assert shown(columns.raised_domains([seg("www.one.org", 50, 525), *page[1:]], [50, 300])) == shown([seg("www.one.org", 50, 525), *page[1:]])


@pytest.mark.parametrize(
    ("value", "want"),
    [("Part one ..... 12", ("Part one", ".....", "12")), ("Part . . ... (NP)", ("Part", ". . ...", "13")), ("Part .. 12", None), ("Part ..... N2", None), ("..... 12", None), ("Part.....12", None)],
)
def test_leader_parts(value, want):
    assert columns.leader_parts(value) == want


def test_leader_numbers():
    whole = columns.leader_numbers(600, [seg("Part one ..... 12", 50, 500)], [50, 500])
    assert shown(whole) == [(50, 500, "Part one"), (91, 500, "....."), (500, 500, "12")]
    joined = columns.leader_numbers(600, [seg("Part", 50, 500), seg("one ....", 90, 500), seg("12", 200, 500)], [50, 500])
    assert shown(joined) == [(50, 500, "Part one"), (91, 500, "...."), (500, 500, "12")]
    done = [seg("Part", 50, 500), seg(".....", 90, 500), seg("12", 505, 500)]
    assert shown(columns.leader_numbers(600, done, [50, 500])) == shown(done)
    assert columns.leader_numbers(600, done, [50, 300]) == done


def test_sublabels():
    heads = [seg("North", 100, 500, 60), seg("South", 200, 500, 60)]
    label = seg("2019 2020", 120, 485, 110)
    assert shown(columns.sublabels(800, [*heads, label]))[2:] == [(121, 485, "2019"), (221, 485, "2020")]
    for page in ([*heads, seg("2019 2020 2021", 120, 485, 110)], [heads[0], label], [*heads, seg("East", 150, 500, 20), label], [*heads, seg("2019 2020", 120, 474, 110)]):
        assert shown(columns.sublabels(800, page)) == shown(page)


def test_empty_page_and_ties():
    assert columns.repair(600, 800, []) == []
    same = [seg("Same", 50, 500, seq=k) for k in range(4)]
    assert columns.repair(600, 800, same) == same


def test_page_folds_look_at_near_segments_only():
    """A long page's anchors and bands: the first mean within reach is joined wherever means have moved to, and no list of all segments is scanned for each."""
    from docstrata.operators import layout

    page = [seg("Word", 72 + 7 * (k * k % 3001), 700 - 14 * (k % 40), 20, seq=k) for k in range(4000)]
    means = []
    for s in page:
        mean = next((m for m in means if abs(m[0] - s.x) <= layout.ANCHOR), None)
        if mean is None:
            means.append([s.x, 1])
        else:
            mean[0], mean[1] = (mean[0] * mean[1] + s.x) / (mean[1] + 1), mean[1] + 1
    assert layout.repeated_anchors(page) == sorted(m for m, n in means if n >= layout.ANCHOR_SEGMENTS)
    edges = columns.Edges(page)
    assert len(list(edges.near(300.0, 12.0))) < 100
    assert all(columns.in_band(edges, s, 303.0) == columns.in_band(page, s, 303.0) for s in page[:200])
