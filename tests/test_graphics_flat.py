"""The fold over flat columns against the fold of one page, operator by operator."""

import random

import pyarrow as pa
import pytest

from docstrata.operators import flat, graphics

NAMES = [*"q Q cm g G rg RG w d re m l c h f S s B b n".split(), "F", "f*", "B*", "b*", "xx", None]
KIND = pa.list_(pa.struct([("number", pa.int64()), ("name", pa.string()), ("args", pa.list_(pa.float64()))]))


def pages(seed, odd):
    r = random.Random(seed)
    number = lambda: r.choice((0.0, -0.0, 0.1, 0.25, 1.0, 3.0, -2.5, 17.3, r.uniform(-50, 50)) + ((None, float("nan"), float("inf"), 1e300) if odd and r.random() < 0.1 else ()))
    out = []
    for _ in range(r.randrange(1, 25)):
        ops = []
        for _ in range(r.choice((0, 3, 20, 60))):
            name = r.choice(NAMES)
            ops.append({"number": None if r.random() < 0.05 else r.randrange(99), "name": name, "args": None if odd and r.random() < 0.02 else [number() for _ in range(max(0, graphics._NEED.get(name, 0) + r.choice((0, 0, 0, 1, 2, -1))))]})
        out.append(None if r.random() < 0.05 else ops)
    return pa.array(out, KIND)


def one_by_one(operators):
    lists, sizes = [], []
    for page in operators.to_pylist():
        page = page or []
        lists += [dict(zip(graphics._SHAPE, row[:5] + ([*row[5]], [*row[6]], [{"name": n, "xy": [*xy]} for n, xy in row[7]]), strict=True)) for row in graphics._painted([o["number"] for o in page], [o["name"] for o in page], [o["args"] or [] for o in page])]
        sizes.append(len(lists) - sum(sizes))
    return lists, sizes


@pytest.mark.parametrize("odd", [False, True])
@pytest.mark.parametrize("seed", range(40))
def test_flat_fold_paints_what_single_pages_do(seed, odd):
    operators = pages(seed, odd)
    got = graphics._fold(operators)
    lists, sizes = one_by_one(operators)
    assert flat.sizes(got) == sizes
    assert list(map(repr, got.flatten().to_pylist())) == list(map(repr, lists))


def test_numbers_are_not_folded_one_by_one(monkeypatch):
    """Pages of plain numbers never reach the loop over single operands."""
    wanted = one_by_one(pages(5, False))[0]

    def refuse(*page):
        raise AssertionError("folded alone")
        yield page

    monkeypatch.setattr(graphics, "_painted", refuse)
    assert len(wanted) > 5 and list(map(repr, graphics._fold(pages(5, False)).flatten().to_pylist())) == list(map(repr, wanted))


def test_deep_nesting_and_no_pages():
    deep = [{"number": k, "name": "cm", "args": [1.0, 0.0, 0.0, 1.0, 0.5, 0.0]} for k in range(3000)] + [{"number": 1, "name": "re", "args": [0.0, 0.0, 2.0, 2.0]}, {"number": 7, "name": "f", "args": []}]
    assert graphics._fold(pa.array([deep], KIND)).to_pylist()[0][0]["box"] == [1500.0, 0.0, 2.0, 2.0]
    assert graphics._fold(pa.array([], KIND)).to_pylist() == [] and graphics._fold(pa.array([None, []], KIND)).to_pylist() == [[], []]
