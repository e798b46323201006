"""How a page and its lines are rendered: ordered rules on lines, met again by the page.

A page is a document; its lines are the text's lines, cut into cells after commas and
semicolons. Cell ``k`` stands ``2 + 5 * (length % 7)`` points after the one before it
(none, where the length is a multiple of 7), in a font of ``7 + line_no % 8`` points. A
page's shapes are the rows of ``lineitem`` whose part has its number. Everything about
one line is an array in one row; lines are judged and gathered once, to the page.
"""

from __future__ import annotations

from docstrata.functions import scalars as f
from docstrata.functions.dialect import SPARK
from docstrata.plans.catalogue import _lines, _register

#: The rules in their order.
LINE_RULES = ("address", "expression", "shifted parenthesis", "broken hyphen", "leader", "bulleted prose", "definition", "wide gap", "fragmented prose", "long", "copyright", "none")
PAGE_RULES = ("large image", "rotated", "dense grid", "bulleted lines", "short fragmented lines", "definition line", "few lines", "many cells and long lines", "none")
WIDTH, HEIGHT = f.PAGE_WIDTH, f.PAGE_HEIGHT


def letters(d, x, least):
    """How many words have so many letters."""
    return d.size(d.keep(d.split(f.squeeze(d, x), " "), "w", f"{d.chars(d.sub('w', r'[^\p{L}]', ''))} >= {least}"))


def email(d, x):
    """Whether a word, without the signs around it, has an at sign and a dot."""
    bare = d.sub("w", r"^[,;:<>()\[\]]+|[,;:<>()\[\]]+$", "")
    return f"({d.size(d.keep(d.split(f.squeeze(d, x), ' '), 'w', f"({bare} LIKE '%@%' AND {bare} LIKE '%.%')"))} > 0)"


def led(d, x):
    return f"({d.contains(x, d.text('...'))} AND {d.like(x, r'(?:^|\s)[0-9]+\s*$')})"


def definition(d, x, font, letters=letters):
    return f"({font} BETWEEN 7 AND 12.5 AND NOT {d.like(x, '[=+]')} AND NOT {f.domain_like(d, x)} AND NOT {led(d, x)} AND {d.like(x, r'\p{Ll}')} AND {d.chars(x)} >= 42 AND {letters(d, x, 2)} >= 6)"


def fragmented(d, x, font, n_cells, touching, letters=letters):
    return f"({n_cells} >= 2 AND {font} >= 11 AND {d.like(x, r'\p{Ll}')} AND {letters(d, x, 2)} >= 6 AND {touching})"


def line_ladder(d, x, font, n_cells, wide, touching, letters=letters):
    """(test, whether the line's cells are rendered) of every rule, in order."""
    three = f"{letters(d, x, 3)} >= 3 AND {x} NOT LIKE '%=%'"
    shifted = f"{x} LIKE '%>&%' AND {d.contains(x, d.text('>' + chr(39)))}"
    bulleted = f"({d.like(x, r'^\s*(?:•|o) ')} AND {letters(d, x, 2)} >= 4 AND {d.like(x, r'\p{Ll}')})"
    return (
        (email(d, x), True),
        (f"({n_cells} <= 3 AND {d.like(x, '[=+]')})", False),
        (f"({shifted} AND {three})", False),
        (f"({d.like(x, '-(?: ?wise| ?down)')} AND {three})", False),
        (led(d, x), True),
        (bulleted, False),
        (f"({definition(d, x, font, letters)} AND NOT {fragmented(d, x, font, n_cells, touching, letters)})", False),
        (wide, True),
        (fragmented(d, x, font, n_cells, touching, letters), True),
        (f"{d.chars(x)} > 70", False),
        (f"{x} LIKE '%©%'", False),
        ("true", False),
    )


def page_ladder():
    """(test, whether lines are rendered whole) of every rule on a page's sums, in order."""
    few = "n_shapes <= 20"
    return (
        ("large", False),
        ("rotated", False),
        ("(across >= 8 AND down >= 6)", False),
        (f"(bulleted >= 4 AND {few})", True),
        (f"({few} AND short >= 3)", True),
        (f"(definitions > 0 AND {few})", True),
        ("n_lines < 20", False),
        ("(n_cells >= n_lines * 2 AND long >= 12)", True),
        ("true", False),
    )


def _first(ladder) -> tuple[str, str]:
    """The number of the first rule that holds, and its result."""
    rule = "CASE " + " ".join(f"WHEN {test} THEN {k}" for k, (test, _) in enumerate(ladder, 1)) + " END"
    return rule, "CASE " + " ".join(f"WHEN {test} THEN {str(result).lower()}" for test, result in ladder) + " END"


def _measured(d) -> str:
    """doc_id, line_no, line, font, n_cells, width, wide, touching of every line that isn't blank."""
    gap = "CASE WHEN length(c) % 7 = 0 THEN 0 ELSE 2 + 5 * (length(c) % 7) END"
    font = "CAST(7 + line_no % 8 AS DOUBLE)"
    edge = lambda last: d.like("c", r"[\p{L}\p{N}]\s*$" if last else r"^\s*[\p{L}\p{N}]")
    if d is SPARK:
        cells = f"SELECT doc_id, line_no, line, {font} AS font, {d.every('line', '[^,;]+[,;]?')} AS cs FROM ({_lines(d)}) l"
        ends = "transform(cs, (c, k) -> CASE WHEN k = 0 THEN 0 ELSE " + gap + " END)"
        return f"""SELECT doc_id, line_no, line, font, CAST(size(cs) AS BIGINT) AS n_cells, greatest(font * 0.5, aggregate(cs, CAST(0 AS DOUBLE), (a, c) -> a + {f.text_width(d, 'c', 'font')}) + aggregate(gaps, CAST(0 AS DOUBLE), (a, g) -> a + g)) AS width,
          exists(slice(gaps, 2, size(cs)), g -> g >= 2.25 * greatest(font, 8)) AS wide,
          exists(transform(cs, (c, k) -> k > 0 AND get(gaps, k) <= font * 0.08 AND {edge(False)} AND get(lasts, k - 1)), x -> x) AS touching
          FROM (SELECT *, {ends} AS gaps, transform(cs, c -> {edge(True)}) AS lasts FROM ({cells}) c WHERE size(cs) > 0) g"""
    rows = f"SELECT doc_id, line_no, line, {font} AS font, k, cs[k] AS c FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS k FROM (SELECT *, {d.every('line', '[^,;]+[,;]?')} AS cs FROM ({_lines(d)}) l))"
    near = f"SELECT *, CASE WHEN k = 1 THEN 0 ELSE {gap} END AS gap, lag({edge(True)}) OVER (PARTITION BY doc_id, line_no ORDER BY k) AS before FROM ({rows}) r"
    return f"""SELECT doc_id, line_no, any_value(line) AS line, any_value(font) AS font, count(*) AS n_cells, greatest(any_value(font) * 0.5, sum({f.text_width(d, 'c', 'font')}) + sum(gap)) AS width,
      bool_or(k > 1 AND gap >= 2.25 * greatest(font, 8)) AS wide, bool_or(k > 1 AND gap <= font * 0.08 AND {edge(False)} AND before) AS touching FROM ({near}) n GROUP BY doc_id, line_no"""


#: Most words that a rule asks for, and signs of a line in which they are looked for first.
_ENOUGH, _FIRST_SIGNS = 8, 160


def _counted() -> str:
    """Lines with their words of two letters or more, n2, counted once: in the line's first signs, and in all of it where these have not enough for any rule."""
    count = lambda x: f"CAST(regexp_count({SPARK.sub(f.squeeze(SPARK, x), r'[^\p{L} ]+')}, '[^ ]{{2,}}') AS BIGINT)"
    first = f"SELECT *, {count(f'left(line, {_FIRST_SIGNS})')} AS n FROM ({_measured(SPARK)}) m"
    return f"SELECT *, CASE WHEN n >= {_ENOUGH} OR octet_length(line) <= {_FIRST_SIGNS} THEN n ELSE {count('line')} END AS n2 FROM ({first}) c"


def _spark_judged() -> str:
    known = lambda d, x, least: "n2" if least == 2 else letters(d, x, least)
    (mail, shown), *rest = line_ladder(SPARK, "line", "font", "n_cells", "wide", "touching", known)
    # Words are looked at for an address only where a line has its sign.
    rule, cells = _first([(f"(line LIKE '%@%' AND {mail})", shown), *rest])
    named = f"SELECT *, CAST({rule} AS BIGINT) AS line_rule FROM ({_counted()}) c"
    cells = "line_rule IN (" + ", ".join(str(k) for k, (_, shown) in enumerate([(mail, shown), *rest], 1) if shown) + ")"
    return f"""SELECT doc_id, line_no, n_cells, width, line_rule, {cells} AS cells, {SPARK.like('line', r'^\s*• ')} AS bullet, {definition(SPARK, 'line', 'font', known)} AS defines,
      n_cells >= 2 AND font BETWEEN 10 AND 13.5 AND width >= {WIDTH * 0.45} AND n2 >= {_ENOUGH} AS short FROM ({named}) n"""


def _judged(d) -> str:
    if d is SPARK:
        return _spark_judged()
    rule, cells = _first(line_ladder(d, "line", "font", "n_cells", "wide", "touching"))
    return f"""SELECT doc_id, line_no, font, n_cells, width, CAST({rule} AS BIGINT) AS line_rule, {cells} AS cells, {d.like('line', r'^\s*• ')} AS bullet, {definition(d, 'line', 'font')} AS defines,
      n_cells >= 2 AND font BETWEEN 10 AND 13.5 AND width >= {WIDTH * 0.45} AND {letters(d, 'line', 2)} >= 8 AS short FROM ({_measured(d)}) m"""


def _shapes() -> str:
    return f"""SELECT l_partkey AS doc_id, count(*) AS n_shapes, sum(CASE WHEN h <= 1.5 AND w >= 20 THEN 1 ELSE 0 END) AS across, sum(CASE WHEN w <= 1.5 AND h >= 20 THEN 1 ELSE 0 END) AS down, max(w * h) >= {WIDTH * HEIGHT * 0.08} AS large, max(CASE WHEN turn <> 0 THEN 1 ELSE 0 END) = 1 AS rotated
      FROM (SELECT l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN 1.0 ELSE CAST(l_tax * 2400 + 1 AS DOUBLE) END AS w, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity * 4 AS DOUBLE) WHEN l_quantity > 49 THEN 400.0 ELSE 1.0 END AS h, CASE WHEN l_quantity = 1 AND l_discount = 0 THEN 90 ELSE 0 END AS turn FROM @lineitem) b GROUP BY l_partkey"""


def _modes(d) -> str:
    """Every line with its own decision and its page's; pages of one id share one."""
    rule, mode = _first(page_ladder())
    lines = _judged(d)
    if d is SPARK:
        # Lines are judged once and meet in their page's window, without a join of them with themselves.
        tests = {"bulleted": "bullet", "definitions": "defines", "short": "short", "long": f"width >= {WIDTH * 0.55}"}
        sums = ", ".join(f"sum(CASE WHEN {test} THEN 1 ELSE 0 END) OVER p AS {name}" for name, test in tests.items())
        whole = f"SELECT doc_id, line_no, line_rule, cells, count(*) OVER p AS n_lines, sum(n_cells) OVER p AS n_cells, {sums} FROM ({lines}) j WINDOW p AS (PARTITION BY doc_id)"
        whole = f"SELECT w.*, coalesce(n_shapes, 0) AS n_shapes, coalesce(across, 0) AS across, coalesce(down, 0) AS down, coalesce(large, false) AS large, coalesce(rotated, false) AS rotated FROM ({whole}) w LEFT JOIN ({_shapes()}) s ON w.doc_id = s.doc_id"
        return f"SELECT doc_id, line_no, line_rule, cells, CASE WHEN doc_id IS NOT NULL THEN CAST({rule} AS BIGINT) END AS page_rule, CASE WHEN doc_id IS NOT NULL THEN {mode} END AS whole_lines FROM ({whole}) w"
    pages = f"""SELECT doc_id, count(*) AS n_lines, sum(n_cells) AS n_cells, sum(CASE WHEN bullet THEN 1 ELSE 0 END) AS bulleted, sum(CASE WHEN defines THEN 1 ELSE 0 END) AS definitions,
      sum(CASE WHEN short THEN 1 ELSE 0 END) AS short, sum(CASE WHEN width >= {WIDTH * 0.55} THEN 1 ELSE 0 END) AS long FROM ({lines}) j GROUP BY doc_id"""
    whole = f"SELECT p.*, coalesce(n_shapes, 0) AS n_shapes, coalesce(across, 0) AS across, coalesce(down, 0) AS down, coalesce(large, false) AS large, coalesce(rotated, false) AS rotated FROM ({pages}) p LEFT JOIN ({_shapes()}) s ON p.doc_id = s.doc_id"
    return f"SELECT l.doc_id, l.line_no, l.line_rule, l.cells, m.page_rule, m.whole_lines FROM ({lines}) l LEFT JOIN (SELECT doc_id, CAST({rule} AS BIGINT) AS page_rule, {mode} AS whole_lines FROM ({whole}) w) m ON l.doc_id = m.doc_id"


_register("p29_p33_render_modes", _modes)

# Labels of two columns that stand in one line


def address_like(d, x):
    """Whether a word looks like an address: a scheme, an at sign, two dots, or a www in front."""
    return d.like(x, r"://|@|\.\S*\.|(?:^|\s)[,;:()\[\]<>]*www\.")


def starts_column(d, x):
    return d.like(x, r"^[-:;,(\[]*(?:[A-Z0-9]|www\.|http)")


def _labels(d) -> str:
    """Lines of fonts up to 10 with an address, cut where the right part begins like a column, holds an address, and the left part is closest to
    the width before the right column. A left part is no more than TARGET and a few signs wide, so only so many words are tried."""
    target = "(312.12 - x - font * 2)"
    rows = f"SELECT doc_id, line_no, {f.squeeze(d, 'line')} AS line, CAST(20 + line_no % 20 * 10 AS DOUBLE) AS x, CAST(7 + line_no % 5 AS DOUBLE) AS font FROM ({_lines(d)}) l"
    asked = f"SELECT * FROM ({rows}) r WHERE font <= 10 AND 312.12 > x + 134.64 AND {address_like(d, 'line')}"
    if d is SPARK:
        split = f"SELECT *, split(line, ' ') AS ws, CAST(ceil((({target} + 12 * font) / (0.45 * font) + 1) / 2) AS INT) AS most FROM ({asked}) a"
        last = f"SELECT *, array_max(transform(ws, (w, i) -> CASE WHEN {address_like(d, 'w')} THEN i ELSE -1 END)) AS last FROM ({split}) s WHERE size(ws) > 1"
        error = f"abs(length(array_join(slice(ws, 1, k), ' ')) * font * 0.45D - {target})"
        tried = f"filter(sequence(1, greatest(1, least(size(ws) - 1, most, last))), k -> k <= last AND {starts_column(d, 'get(ws, k)')} AND {error} <= font * 12)"
        best = f"SELECT *, array_min(transform({tried}, k -> struct({error} AS error, k AS k))).k AS k FROM ({last}) t"
        return f"SELECT doc_id, line_no, array_join(slice(ws, 1, k), ' ') AS left_text, array_join(slice(ws, k + 1, size(ws)), ' ') AS right_text FROM ({best}) b WHERE k IS NOT NULL"
    cuts = f"SELECT *, unnest(range(1, len(string_split(line, ' ')))) AS k FROM ({asked}) a"
    parts = f"SELECT *, array_to_string(string_split(line, ' ')[1:k], ' ') AS left_text, array_to_string(string_split(line, ' ')[k + 1:], ' ') AS right_text FROM ({cuts}) c"
    errors = f"SELECT *, abs(length(left_text) * font * CAST(0.45 AS DOUBLE) - {target}) AS error FROM ({parts}) p WHERE {starts_column(d, 'right_text')} AND {address_like(d, 'right_text')}"
    return f"SELECT doc_id, line_no, left_text, right_text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY error, k) AS r FROM ({errors}) e WHERE error <= font * 12) b WHERE r = 1"


_register("o07_two_column_labels", _labels)
