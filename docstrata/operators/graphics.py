"""The graphics state over the operators of a page's content, and parts of forms under their matrix.

Operators are rows (number, name, operands). A page's operators are folded in their order
in one row: the state in force (matrix, colours, line width, dashes), the saved states, the
rectangles and the path that wait to be painted, and what has been painted. Coordinates
are multiplied by the matrix in force when they are given, widths when they are painted.

Known operators: q Q cm, g G rg RG, w d, re m l c h, f S s B b n. Defined cases: a restore
without a save gives the default state; operators with too few operands and unknown ones
change nothing; rectangles under a quarter point wide or high are not painted; a page
without operators has no shapes; null operands are counted, and make null what is worked
out of them. The fold is a small loop over a batch's flat columns, so the work is linear
in the operators.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from docstrata.operators import flat
from docstrata.operators.editor import let

STATE = "struct<m:array<double>,fill:string,stroke:string,width:double,dash:array<double>>"
COMMANDS = "array<struct<name:string,xy:array<double>>>"
SHAPES = f"array<struct<number:bigint,kind:string,fill:string,stroke:string,width:double,dash:array<double>,box:array<double>,path:{COMMANDS}>>"
OPERATORS = "array<struct<number:bigint,name:string,args:array<double>>>"
#: Least width and height of a painted rectangle, least width of a line, least scale.
LEAST, LEAST_WIDTH, LEAST_SCALE = 0.25, 0.25, 0.01


def times(m: Column, n: Column) -> Column:
    """The product of two matrices (a, b, c, d, e, f), n applied first."""
    a, b, c, d, e, f = (F.get(m, F.lit(k)) for k in range(6))
    o, p, q, r, s, t = (F.get(n, F.lit(k)) for k in range(6))
    return F.array(a * o + c * p, b * o + d * p, a * q + c * r, b * q + d * r, a * s + c * t + e, b * s + d * t + f)


def moved(m: Column, xy: Column) -> Column:
    """Points, one after the other in an array, under a matrix."""
    at = lambda k: F.get(m, F.lit(k))
    pairs = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(xy) - 1))
    return F.when(F.size(xy) > 1, F.transform(F.filter(pairs, lambda k: k < F.size(xy)), lambda k: F.when(k % 2 == 0, at(0) * F.get(xy, k) + at(2) * F.get(xy, k + 1) + at(4)).otherwise(at(1) * F.get(xy, k - 1) + at(3) * F.get(xy, k) + at(5)))).otherwise(F.expr("cast(array() as array<double>)"))


def moved_box(m: Column, box: Column) -> Column:
    """The box (x, y, width, height) around a moved box."""
    x, y, w, h = (F.get(box, F.lit(k)) for k in range(4))

    def around(p: Column) -> Column:
        xs, ys = [F.get(p, F.lit(k)) for k in (0, 2, 4, 6)], [F.get(p, F.lit(k)) for k in (1, 3, 5, 7)]
        return F.array(F.least(*xs), F.least(*ys), F.greatest(*xs) - F.least(*xs), F.greatest(*ys) - F.least(*ys))

    return let(moved(m, F.array(x, y, x + w, y, x, y + h, x + w, y + h)), around)


def scale(m: Column) -> Column:
    a, b, c, d = (F.get(m, F.lit(k)) for k in range(4))
    return F.greatest(F.sqrt(a * a + b * b), F.sqrt(c * c + d * d), F.lit(LEAST_SCALE))


def moved_segment(m: Column, x: Column, y: Column, width: Column, font: Column) -> Column:
    """A form's text segment on its page: (x, y, width, font), each size by its own scale."""
    a, b, c, d = (F.get(m, F.lit(k)) for k in range(4))
    return let(moved(m, F.array(x, y)), lambda p: F.array(F.get(p, F.lit(0)), F.get(p, F.lit(1)), width * F.greatest(F.sqrt(a * a + b * b), F.lit(LEAST_SCALE)), font * F.greatest(F.sqrt(c * c + d * d), F.lit(LEAST_SCALE))))


def moved_path(m: Column, commands: Column) -> Column:
    """A form's path on its page."""
    return F.transform(commands, lambda c: F.struct(c["name"].alias("name"), moved(m, c["xy"]).alias("xy")))


def colour(*parts: Column) -> Column:
    """#rrggbb of one grey or three parts between 0 and 1."""
    byte = lambda v: F.lower(F.lpad(F.hex(F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)) * 255 + 0.5)), 2, "0"))
    return F.concat(F.lit("#"), *(byte(v) for v in (parts if len(parts) == 3 else parts * 3)))


#: Operands that an operator needs, whether it fills and whether it strokes.
_NEED = {"cm": 6, "g": 1, "G": 1, "rg": 3, "RG": 3, "w": 1, "d": 2, "re": 4, "m": 2, "l": 2, "c": 6}
_FILLS, _STROKES = frozenset(("f", "F", "f*", "B", "B*", "b", "b*")), frozenset(("S", "s", "B", "B*", "b", "b*"))
_FIRST = ((1.0, 0.0, 0.0, 1.0, 0.0, 0.0), "#000000", "#000000", 1.0, ())


def _along(a, x, c, y, e=None):
    """a * x + c * y, and e if given; null where a part is."""
    try:
        return a * x + c * y if e is None else a * x + c * y + e
    except TypeError:
        return None


def _order(v: float) -> tuple[bool, float]:
    return v != v, v


def _ends(vs):
    """Least and greatest, as SQL has them: nulls don't count, and what is no number is greatest."""
    try:
        if sum(vs) == sum(vs):
            return min(vs), max(vs)
    except TypeError:
        pass
    vs = [v for v in vs if v is not None]
    return (min(vs, key=_order), max(vs, key=_order)) if vs else (None, None)


def _byte(v) -> str:
    return f"{math.floor(_ends((1.0, _ends((0.0, v))[1]))[0] * 255 + 0.5):02x}"


def _colour(parts) -> str:
    return "#" + ("".join(map(_byte, parts)) if len(parts) == 3 else _byte(parts[0]) * 3)


def _times(m, n):
    a, b, c, d, e, f = m
    o, p, q, r, s, t = n
    # A null last part makes the sum null too.
    return _along(a, o, c, p), _along(b, o, d, p), _along(a, q, c, r), _along(b, q, d, r), None if e is None else _along(a, s, c, t, e), None if f is None else _along(b, s, d, t, f)


def _moved(m, xy) -> list:
    a, b, c, d, e, f = m
    out = []
    for x, y in zip(xy[::2], xy[1::2]):
        out += (None if e is None else _along(a, x, c, y, e), None if f is None else _along(b, x, d, y, f))
    return out


def _moved_box(m, box) -> list:
    x, y, w, h = box
    right, top = (None if p is None or q is None else p + q for p, q in ((x, w), (y, h)))
    p = _moved(m, (x, y, right, y, x, top, right, top))
    (left, end), (low, high) = _ends(p[::2]), _ends(p[1::2])
    return [left, low, None if left is None else end - left, None if low is None else high - low]


def _scale(m) -> float:
    a, b, c, d = m[:4]
    root = lambda v: None if v is None else math.sqrt(v)
    return _ends((root(_along(a, a, b, b)), root(_along(c, c, d, d)), LEAST_SCALE))[1]


def _shown(size) -> bool:
    return size is not None and not size < LEAST


def _painted(numbers, names, args):
    """What a page's operators paint, one after the other: number, kind, fill, stroke, width, dash, box, path."""
    now, saved, boxes, path = _FIRST, [], [], []
    for number, name, given in zip(numbers, names, args):
        if name is None or len(given) < _NEED.get(name, 0):
            continue
        if name in ("m", "l"):
            path.append((name, _moved(now[0], given[-2:])))
        elif name == "re":
            boxes.append(_moved_box(now[0], given[-4:]))
        elif name == "c":
            path.append((name, _moved(now[0], given[-6:])))
        elif name == "h":
            path.append((name, []))
        elif name == "q":
            saved.append(now)
        elif name == "Q":
            now = saved.pop() if saved else _FIRST
        elif name == "cm":
            now = (_times(now[0], given[-6:]), *now[1:])
        elif name in ("g", "rg"):
            now = (now[0], _colour(given[-_NEED[name] :]), *now[2:])
        elif name in ("G", "RG"):
            now = (*now[:2], _colour(given[-_NEED[name] :]), *now[3:])
        elif name == "w":
            now = (*now[:3], _ends((None if given[-1] is None else abs(given[-1]), LEAST_WIDTH))[1], now[4])
        elif name == "d":
            now = (*now[:4], [abs(v) for v in given[:-1] if v is not None and v != 0])
        elif name == "n":
            boxes, path = [], []
        elif name in _FILLS or name in _STROKES:
            strokes = name in _STROKES
            if path and name in ("s", "b", "b*"):
                path.append(("h", []))
            style = now[1] if name in _FILLS else None, now[2] if strokes else None, now[3] * _scale(now[0]), now[4] if strokes else ()
            for box in boxes:
                if _shown(box[2]) and _shown(box[3]):
                    yield number, "rectangle", *style, box, ()
            if path:
                yield number, "path", *style, (), path
            boxes, path = [], []


def _numbers(lists: list) -> pa.Array:
    return flat.lists([len(v) for v in lists], pa.array([*chain.from_iterable(lists)], pa.float64()))


def _alone(pages: list[tuple]) -> tuple[list[int], pa.Array]:
    """Pages folded one by one, operand by operand: how many shapes each has, and their columns."""
    made = [[*_painted(*page)] for page in pages]
    number, kind, fill, stroke, width, dash, box, path = zip(*chain.from_iterable(made), strict=True) if any(made) else [()] * 8
    commands = [*chain.from_iterable(path)]
    drawn = pa.StructArray.from_arrays([pa.array([c[0] for c in commands], pa.string()), _numbers([c[1] for c in commands])], ["name", "xy"])
    text, double = pa.string(), pa.float64()
    columns = [pa.array(number, pa.int64()), pa.array(kind, text), pa.array(fill, text), pa.array(stroke, text), pa.array(width, double), _numbers(dash), _numbers(box), flat.lists([len(p) for p in path], drawn)]
    return [len(m) for m in made], pa.StructArray.from_arrays(columns, _SHAPE)


_SHAPE = ["number", "kind", "fill", "stroke", "width", "dash", "box", "path"]
#: Operators by what they do to a page: commands of a path, boxes, states, paints.
_KINDS = {name: k for k, names in enumerate((("m",), ("l",), ("c",), ("h",), ("re",), ("q",), ("Q",), ("cm",), ("g", "rg"), ("G", "RG"), ("w",), ("d",), ("n",), tuple(_FILLS | _STROKES))) for name in names}
_POINTS = np.array([1, 1, 3, 0])
_HEX = pa.array([f"{k:02x}" for k in range(256)])


def _in_force(kinds: list[int], lengths: list[int]):
    """One pass over pages' operators, in their order, without their numbers: which matrix is in force at each operator (the operator that made it, -1 for the first one), matrices by how many others they stand on,
    and shapes as (paint, box or -1, first and last command, and the operators that made its fill, stroke, width and dash)."""
    matrix, levels, level, shapes = [-1] * len(kinds), [], {-1: -1}, []
    commands = at = 0
    for n in lengths:
        m = fill = stroke = width = dash = -1
        saved, boxes, first = [], [], commands
        for i, kind in enumerate(kinds[at : at + n], at):
            if kind < 0:
                continue
            matrix[i] = m
            if kind == 13:
                state = fill, stroke, width, dash
                shapes += [(i, box, 0, 0, *state) for box in boxes]
                if commands > first:
                    shapes.append((i, -1, first, commands, *state))
                boxes, first = [], commands
            elif kind < 4:
                commands += 1
            elif kind == 4:
                boxes.append(i)
            elif kind == 8:
                fill = i
            elif kind == 9:
                stroke = i
            elif kind == 10:
                width = i
            elif kind == 5:
                saved.append((m, fill, stroke, width, dash))
            elif kind == 6:
                m, fill, stroke, width, dash = saved.pop() if saved else (-1,) * 5
            elif kind == 7:
                level[i] = level[m] + 1
                if level[i] == len(levels):
                    levels.append([])
                levels[level[i]].append(i)
                m = i
            elif kind == 11:
                dash = i
            else:
                boxes, first = [], commands
        at += n
    return np.array(matrix, np.int64), levels, np.array(shapes, np.int64).reshape(-1, 8).T


def _inside(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at starts and have sizes, one run after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _first(vs, better):
    """The least or greatest of columns; of equal ones the first."""
    return reduce(lambda a, b: np.where(better(b, a), b, a), vs)


def _fold(operators: pa.Array) -> pa.Array:
    """Pages' operators as flat columns, and what they paint as flat columns again. What is in force where is told by a loop without numbers; numbers are worked out for all operators at once. Pages with numbers that are null or too large are folded alone."""
    numbers, names, args = operators.flatten().flatten()
    lengths, sizes, values = np.array(flat.sizes(operators), np.int64), np.array(flat.sizes(args), np.int64), args.flatten()
    page, ends = np.repeat(np.arange(len(lengths)), lengths), np.cumsum(sizes)
    given = values.to_numpy(zero_copy_only=False).astype(float)
    encoded = names.dictionary_encode()
    known = encoded.dictionary.to_pylist()
    code = pc.fill_null(encoded.indices, len(known)).to_numpy(zero_copy_only=False)
    kind = np.array([_KINDS.get(name, -1) for name in known] + [-1])[code]
    kind[sizes < np.array([_NEED.get(name, 0) for name in known] + [0])[code]] = -1
    is_ = lambda test: np.array([test(name) for name in known] + [False], bool)[code]
    matrix, levels, (paint, box, low, high, fill, stroke, width, dash) = _in_force(kind.tolist(), lengths.tolist())
    odd = np.zeros(len(lengths), bool)
    odd[page[np.repeat(np.arange(len(sizes)), sizes)[~np.isfinite(given)]]] = True

    def operands(ops: np.ndarray, n: int) -> list[np.ndarray]:
        """The last n operands of operators."""
        return [given[ends[ops] - n + k] for k in range(n)]

    with np.errstate(all="ignore"):
        # The last row is the matrix before any.
        m = np.zeros((6, len(sizes) + 1))
        m[:, -1] = _FIRST[0]
        for ops in levels:
            ops = np.array(ops)
            m[:, ops] = _times(m[:, matrix[ops]], operands(ops, 6))
        odd[page[~np.isfinite(m[:, :-1]).all(axis=0)]] = True

        command = np.flatnonzero((kind >= 0) & (kind < 4))
        points = _POINTS[kind[command]]
        of = np.repeat(command, points)
        a, b, c, d, e, f = m[:, matrix[of]]
        at = _inside(ends[command] - 2 * points, 2 * points)
        x, y = given[at[::2]], given[at[1::2]]
        xy = np.stack((a * x + c * y + e, b * x + d * y + f), axis=1)
        odd[page[of[~np.isfinite(xy).all(axis=1)]]] = True

        x, y, w, h = operands(boxed := box[box >= 0], 4)
        right, top = x + w, y + h
        corners = _moved(m[:, matrix[boxed]], (x, y, right, y, x, top, right, top))
        left, bottom = (_first(corners[k::2], np.less) for k in (0, 1))
        boxes = np.full((len(box), 4), 0.0)
        boxes[box >= 0] = np.stack((left, bottom, _first(corners[::2], np.greater) - left, _first(corners[1::2], np.greater) - bottom), axis=1)
        odd[page[paint[~np.isfinite(boxes).all(axis=1)]]] = True

        a, b, c, d = m[:4, matrix[paint]]
        line = np.ones(len(sizes) + 1)
        ops = np.flatnonzero(kind == 10)
        line[ops] = _first((np.abs(given[ends[ops] - 1]), LEAST_WIDTH), np.greater)
        wide = line[width] * _first((np.sqrt(a * a + b * b), np.sqrt(c * c + d * d), LEAST_SCALE), np.greater)
        odd[page[paint[~np.isfinite(wide)]]] = True

    colours, ops = [pa.array(["#000000"])], np.flatnonzero((kind == 8) | (kind == 9))
    place = np.zeros(len(sizes) + 1, np.int64)
    for several in (False, True):
        own = ops[is_(lambda name: name in ("rg", "RG"))[ops] == several]
        place[own] = sum(map(len, colours)) + np.arange(len(own))
        with np.errstate(all="ignore"):
            shown = [_HEX.take(pa.array(np.floor(_first((1.0, _first((0.0, np.where(np.isfinite(v), v, 0.0)), np.greater)), np.less) * 255 + 0.5).astype(np.int64))) for v in operands(own, 3 if several else 1)]
        colours.append(pc.binary_join_element_wise("#", *(shown if several else shown * 3), ""))
    colours = pa.concat_arrays(colours)

    kept = np.flatnonzero(~odd[page[paint]] & ((box < 0) | ~((boxes[:, 2] < LEAST) | (boxes[:, 3] < LEAST))))
    paint, box, low, high, fill, stroke, width, dash, boxes, wide = (v[kept] for v in (paint, box, low, high, fill, stroke, width, dash, boxes, wide))
    fills, strokes, closes = is_(_FILLS.__contains__)[paint], is_(_STROKES.__contains__)[paint], is_({"s", "b", "b*"}.__contains__)[paint]
    # Dashes without those of nothing, the last operand is where they begin; the row after the last operator has none.
    ops = np.flatnonzero(kind == 11)
    at = _inside(ends[ops] - sizes[ops], sizes[ops] - 1)
    dashed = given[at] != 0
    dashes = np.abs(given[at[dashed]])
    count = np.zeros(len(sizes) + 1, np.int64)
    count[ops] = np.bincount(np.repeat(np.arange(len(ops)), sizes[ops] - 1)[dashed], minlength=len(ops))
    first = np.cumsum(count) - count
    n_dash = np.where(strokes, count[dash], 0)
    # Commands of each path, and one more where it is closed.
    last, closed = len(command), closes & (box < 0)
    n = high - low + closed
    at = _inside(low, n)
    at[np.cumsum(n)[closed] - 1] = last
    points = np.append(points, 0)
    start = np.cumsum(points) - points
    coordinates = flat.lists((2 * points[at]).tolist(), pa.array(xy[_inside(start[at], points[at])].ravel()))
    drawn = pa.StructArray.from_arrays([pa.concat_arrays([names.take(pa.array(command)), pa.array(["h"])]).take(pa.array(at)), coordinates], ["name", "xy"])
    columns = [
        numbers.take(pa.array(paint)), pa.array(["rectangle", "path"]).take(pa.array((box < 0).astype(np.int64))), colours.take(pa.array(place[fill], mask=~fills)), colours.take(pa.array(place[stroke], mask=~strokes)), pa.array(wide),
        flat.lists(n_dash.tolist(), pa.array(dashes[_inside(first[dash], n_dash)])), flat.lists(np.where(box >= 0, 4, 0).tolist(), pa.array(boxes[box >= 0].ravel())), flat.lists(n.tolist(), drawn),
    ]
    made, counts = pa.StructArray.from_arrays(columns, _SHAPE), np.bincount(page[paint], minlength=len(lengths))
    if odd.any():
        edges, which = np.concatenate(([0], np.cumsum(lengths))), np.flatnonzero(odd)
        lists = args.to_pylist() if odd.all() else None
        slices = [slice(edges[k], edges[k + 1]) for k in which]
        found, others = _alone([(numbers[k].to_pylist(), names[k].to_pylist(), [v or [] for v in (lists[k] if lists else args[k].to_pylist())]) for k in slices])
        order = np.argsort(np.concatenate((np.repeat(np.arange(len(lengths)), counts), np.repeat(which, found))), kind="stable")
        counts[which] = found
        made = pa.concat_arrays([made, others]).take(pa.array(order))
    return flat.lists(counts.tolist(), made)


def shapes(operators: Column) -> Column:
    """What a page's operators paint, in order: rectangles with their box, paths with their commands."""
    return F.arrow_udf(_fold, SHAPES)(F.coalesce(operators.cast(OPERATORS), F.expr(f"cast(array() as {OPERATORS})")))
