"""Editing transforms on styled text, as Columns over ``array<struct<ch:string,style:int>>`` and as JSON documents.

A style is a set of flags; toggling a range clears a flag that every character
of it has and sets it otherwise. Offsets outside the text are clamped.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column
from pyspark.sql import functions as F

from docstrata.operators.model import Block, Document

BOLD, ITALIC, UNDERLINE, STRIKE, CODE = (1 << k for k in range(5))
#: Most rows and columns of a new table.
MOST_ROWS, MOST_COLUMNS = 20, 12
CHARS = "array<struct<ch:string,style:int>>"


def styled(text: Column, style: int = 0) -> Column:
    """Text as styled characters."""
    return F.when(F.length(text) > 0, F.transform(F.split(text, ""), lambda c: F.struct(c.alias("ch"), F.lit(style).alias("style")))).otherwise(F.expr(f"cast(array() as {CHARS})"))


def plain(chars: Column) -> Column:
    return F.array_join(F.transform(chars, lambda c: c["ch"]), "")


def _clamp(chars: Column, at: Column) -> Column:
    return F.least(F.greatest(at, F.lit(0)), F.size(chars))


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split(chars: Column, at: Column) -> tuple[Column, Column]:
    """Characters before and from an offset."""
    k = _clamp(chars, at)
    return F.slice(chars, F.lit(1), k), F.slice(chars, k + 1, F.size(chars) - k)


def insert(chars: Column, at: Column, new: Column) -> Column:
    def put(c: Column) -> Column:
        before, after = split(c, at)
        return F.concat(before, new, after)

    return let(chars, put)


def delete(chars: Column, at: Column) -> Column:
    """Without the character at an offset; ``delete(c, at - 1)`` is the backward form."""
    return F.filter(chars, lambda _, i: i != at)


def toggle(chars: Column, start: Column, end: Column, flag: int) -> Column:
    def all_set(c: Column) -> Column:
        part = F.slice(c, _clamp(c, start) + 1, F.greatest(F.lit(0), _clamp(c, end) - _clamp(c, start)))
        return F.forall(part, lambda x: x["style"].bitwiseAND(F.lit(flag)) != 0)

    def put(c: Column, clear: Column) -> Column:
        changed = lambda x: F.when(clear, x["style"].bitwiseAND(F.lit(~flag))).otherwise(x["style"].bitwiseOR(F.lit(flag)))
        # Only the range is made anew; an offset that is null has none.
        first, last = _clamp(c, start), F.greatest(_clamp(c, start), _clamp(c, end))
        inside = F.transform(F.slice(c, first + 1, last - first), lambda x: F.struct(x["ch"].alias("ch"), changed(x).cast("int").alias("style")))
        return F.when(start.isNull() | end.isNull(), c).otherwise(F.concat(F.slice(c, F.lit(1), first), inside, F.slice(c, last + 1, F.size(c) - last)))

    return let(chars, lambda c: let(all_set(c), lambda clear: put(c, clear)))


def runs(chars: Column) -> Column:
    """Runs of one style: array<struct<text,style>>."""
    style = lambda c, k: F.get(c, k)["style"]

    def cut(c: Column, starts: Column) -> Column:
        def one(at: Column, k: Column) -> Column:
            size = F.coalesce(F.get(starts, k + 1), F.size(c)) - at
            return F.struct(F.array_join(F.transform(F.slice(c, at + 1, size), lambda x: x["ch"]), "").alias("text"), style(c, at).alias("style"))

        return F.transform(starts, one)

    def found(c: Column) -> Column:
        # A run begins where a character's style isn't that of the one before it.
        places = F.filter(F.transform(c, lambda _, i: i), lambda i: (i == 0) | ~F.coalesce(style(c, i) == style(c, i - 1), F.lit(False)))
        return let(places, lambda starts: cut(c, starts))

    return let(chars, found)


def runs_html(found: Column) -> Column:
    """Runs as HTML, marks nested in a fixed order."""
    tags = ((CODE, "code"), (BOLD, "strong"), (ITALIC, "em"), (UNDERLINE, "u"), (STRIKE, "del"))

    def one(r: Column) -> Column:
        has = lambda flag: r["style"].bitwiseAND(F.lit(flag)) != 0
        text = F.replace(F.replace(F.replace(r["text"], F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        opened = [F.when(has(flag), f"<{tag}>").otherwise("") for flag, tag in reversed(tags)]
        closed = [F.when(has(flag), f"</{tag}>").otherwise("") for flag, tag in tags]
        return F.concat(*opened, text, *closed)

    return F.array_join(F.transform(found, one), "")


def new_table(n_rows: Column, n_columns: Column) -> Column:
    """Empty cells of a new table, its size clamped."""
    r, c = F.least(F.greatest(n_rows, F.lit(1)), F.lit(MOST_ROWS)), F.least(F.greatest(n_columns, F.lit(1)), F.lit(MOST_COLUMNS))
    return F.array_repeat(F.array_repeat(F.lit(""), c), r)


def add_row(table: Column, at: Column) -> Column:
    k = _clamp(table, at)
    row = F.array_repeat(F.lit(""), F.coalesce(F.size(F.get(table, F.lit(0))), F.lit(1)))
    return F.concat(F.slice(table, F.lit(1), k), F.array(row), F.slice(table, k + 1, F.size(table) - k))


def add_column(table: Column, at: Column) -> Column:
    return F.transform(table, lambda row: F.concat(F.slice(row, F.lit(1), _clamp(row, at)), F.array(F.lit("")), F.slice(row, _clamp(row, at) + 1, F.size(row) - _clamp(row, at))))


def save(document: Document) -> str:
    """A document as JSON."""
    return json.dumps(asdict(document), ensure_ascii=False)


def _inlines(items: list) -> list:
    return [(kind, value if isinstance(value, str) else _inlines(value), attributes) for kind, value, attributes in items]


def _block(data: dict) -> Block:
    rows = [[(_inlines(c[0]), *c[1:]) for c in row] for row in data["rows"]]
    return Block(data["kind"], _inlines(data["inlines"]), data["level"], data["attributes"], [_block(b) for b in data["children"]], rows)


def load(saved: str | None) -> Document | None:
    """A document from its JSON; None where that is missing or broken."""
    try:
        data = json.loads(saved or "")
        return Document(**{**data, "blocks": [_block(b) for b in data["blocks"]]})
    except (ValueError, KeyError, TypeError):
        return None
