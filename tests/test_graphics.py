"""The fold over content operators against a plain interpreter, and forms' parts under a matrix."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from docstrata.operators import graphics
from docstrata.plans import painted


def times(m, n):
    a, b, c, d, e, f = m
    o, p, q, r, s, t = n
    return [a * o + c * p, b * o + d * p, a * q + c * r, b * q + d * r, a * s + c * t + e, b * s + d * t + f]


def point(m, x, y):
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def colour(parts):
    parts = list(parts) * (1 if len(parts) == 3 else 3)
    return "#" + "".join(f"{math.floor(min(1, max(0, v)) * 255 + 0.5):02x}" for v in parts)


def plain(ops):
    first = lambda: {"m": [1, 0, 0, 1, 0, 0], "fill": "#000000", "stroke": "#000000", "width": 1.0, "dash": []}
    now, saved, boxes, path, out = first(), [], [], [], []
    need = {"cm": 6, "g": 1, "G": 1, "rg": 3, "RG": 3, "w": 1, "d": 2, "re": 4, "m": 2, "l": 2, "c": 6}
    for number, name, args in ops:
        args = args or []
        if len(args) < need.get(name, 0):
            continue
        if name == "q":
            saved.append(dict(now))
        elif name == "Q":
            now = saved.pop() if saved else first()
        elif name == "cm":
            now = now | {"m": times(now["m"], args[-6:])}
        elif name in ("g", "rg"):
            now = now | {"fill": colour(args[-need[name] :])}
        elif name in ("G", "RG"):
            now = now | {"stroke": colour(args[-need[name] :])}
        elif name == "w":
            now = now | {"width": max(abs(args[-1]), 0.25)}
        elif name == "d":
            now = now | {"dash": [abs(v) for v in args[:-1] if v]}
        elif name == "re":
            x, y, w, h = args[-4:]
            ps = [point(now["m"], *p) for p in ((x, y), (x + w, y), (x, y + h), (x + w, y + h))]
            left, low = min(p[0] for p in ps), min(p[1] for p in ps)
            boxes.append([left, low, max(p[0] for p in ps) - left, max(p[1] for p in ps) - low])
        elif name in ("m", "l", "c", "h"):
            xy = [] if name == "h" else args[-need[name] :]
            path.append((name, [v for k in range(0, len(xy), 2) for v in point(now["m"], xy[k], xy[k + 1])]))
        elif name in ("f", "S", "s", "B", "b", "n"):
            if name in ("s", "b") and path:
                path.append(("h", []))
            fill, stroke = now["fill"] if name in "fBb" else None, now["stroke"] if name in "SsBb" else None
            m = now["m"]
            width = now["width"] * max(math.hypot(m[0], m[1]), math.hypot(m[2], m[3]), 0.01)
            if name != "n":
                for b in boxes:
                    if b[2] >= 0.25 and b[3] >= 0.25:
                        out.append((number, "rectangle", fill, stroke, width, now["dash"] if stroke else [], b, []))
                if path:
                    out.append((number, "path", fill, stroke, width, now["dash"] if stroke else [], [], list(path)))
            boxes, path = [], []
    return out


def rounded(x):
    return round(x, 6) if isinstance(x, float) else [rounded(v) for v in x] if isinstance(x, (list, tuple)) else x


def shown(found):
    return [[s.number, s.kind, s.fill, s.stroke, rounded(s.width), rounded(list(s.dash)), rounded(list(s.box)), [[c.name, rounded(list(c.xy))] for c in s.path]] for s in found]


def test_random_pages(spark):
    rng = random.Random(3)
    number = lambda: round(rng.uniform(-3, 5), 2)
    sizes = {"q": 0, "Q": 0, "cm": 6, "g": 1, "G": 1, "rg": 3, "RG": 3, "w": 1, "d": 3, "re": 4, "m": 2, "l": 2, "c": 6, "h": 0, "f": 0, "S": 0, "s": 0, "B": 0, "b": 0, "n": 0, "x": 1}
    pages = []
    for _ in range(40):
        names = [rng.choice(list(sizes)) for _ in range(rng.randint(0, 60))]
        pages.append([(k, n, [number() for _ in range(max(0, sizes[n] + rng.choice([0, 0, 0, 1, -1])))]) for k, n in enumerate(names)])
    pages.append([(0, "Q", None), (1, None, None), (2, "re", [0.0, 0.0, 5.0, 0.2]), (3, "f", [])])
    df = spark.createDataFrame([(i, p) for i, p in enumerate([*pages, None])], f"i int, ops {graphics.OPERATORS}")
    got = {r.i: shown(r.s) for r in df.select("i", graphics.shapes(F.col("ops")).alias("s")).collect()}
    for i, p in enumerate(pages):
        assert got[i] == [rounded(list(s[:-1])) + [[[n, rounded(xy)] for n, xy in s[-1]]] for s in plain(p)], p
    assert got[len(pages)] == []


def test_query_against_plain(spark):
    sf = "/root/testdata/sf0.001"
    given = {r.page: [tuple(o) for o in r.operators] for r in painted.operators(spark.read.parquet(f"{sf}/lineitem.parquet")).collect()}
    got = {}
    for r in painted.shapes(spark, sf).orderBy("page", "place").collect():
        got.setdefault(r.page, []).append((r.number, r.kind, r.fill, r.stroke, pytest.approx(r.width, abs=2e-6), len(r.dash.split()), len(r.box.split()), len(r.path.split())))
    want = {p: [(s[0], s[1], s[2], s[3], s[4], len(s[5]), len(s[6]), sum(1 + len(xy) for _, xy in s[7])) for s in plain(ops)] for p, ops in given.items()}
    assert got == {p: w for p, w in want.items() if w}


def test_parts_of_forms(spark):
    m = [0.0, 2.0, -3.0, 0.0, 10.0, 20.0]
    df = spark.createDataFrame([(m, [1.0, 2.0, 3.0, 4.0], [("m", [1.0, 2.0]), ("c", [0.0, 0.0, 1.0, 0.0, 0.0, 1.0]), ("h", [])])], f"m array<double>, box array<double>, path {graphics.COMMANDS}")
    r = df.select(graphics.moved_box(F.col("m"), F.col("box")).alias("box"), graphics.moved_path(F.col("m"), F.col("path")).alias("path"), graphics.moved_segment(F.col("m"), F.lit(1.0), F.lit(2.0), F.lit(5.0), F.lit(4.0)).alias("segment"), graphics.scale(F.col("m")).alias("scale")).first()
    assert r.box == [-8.0, 22.0, 12.0, 6.0] and r.segment == [4.0, 22.0, 10.0, 12.0] and r.scale == 3.0
    assert [(c.name, c.xy) for c in r.path] == [("m", [4.0, 22.0]), ("c", [10.0, 20.0, 10.0, 22.0, 7.0, 20.0]), ("h", [])]


def test_only_numbers_are_shuffled_and_long_pages_stay_linear(spark):
    lineitem = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = painted.operators(lineitem)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert "l_linenumber" in below and "name, re" not in below
    # One page of 60,000 rectangles, each painted at once; copying what is painted takes minutes.
    n = 60_000
    ops = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.array(F.struct((2 * k).alias("number"), F.lit("re").alias("name"), F.array(k, F.lit(0), F.lit(5), F.lit(7)).alias("args")), F.struct((2 * k + 1).alias("number"), F.lit("f").alias("name"), F.array().alias("args")))))
    began = time.time()
    page = spark.range(1).select(graphics.shapes(ops).alias("s")).select(F.size("s").alias("n"), F.aggregate("s", F.lit(0.0), lambda t, s: t + F.get(s["box"], F.lit(0))).alias("x")).first()
    assert (page.n, page.x) == (n, n * (n + 1) / 2) and time.time() - began < 30


def test_null_operands(spark):
    ops = [(0, "cm", [None, 0.0, 0.0, 1.0, 0.0, 3.0]), (1, "rg", [None, 1.0, 0.0]), (2, "w", [None]), (3, "re", [1.0, 2.0, 3.0, 4.0]), (4, "m", [1.0, 2.0]), (5, "b", []), None]
    df = spark.createDataFrame([(ops,)], f"ops {graphics.OPERATORS}")
    (s,) = df.select(graphics.shapes(F.col("ops")).alias("s")).first().s
    # The box has no edges and isn't painted; the path keeps its commands.
    assert (s.kind, s.fill, s.width, [(c.name, c.xy) for c in s.path]) == ("path", "#00ff00", 0.25, [("m", [None, None]), ("h", [])])
