"""Replay of an edit log over a document's blocks, and the path of elements at a place of it.

A block is a kind, a level and styled characters; blocks of other kinds than INLINE hold
none and are neither merged, split nor turned. An edit names its block and offset:

* ``insert`` puts text at the offset, into a new paragraph where there is no block at all;
* ``backspace`` takes the character before the offset; at 0 the block joins the one before;
* ``delete`` takes the character at the offset; at the end the next block joins this one;
* ``split`` ends the block at the offset; the rest is a block of its kind, after a heading
  a paragraph; an empty list item or quote turns into a paragraph instead;
* ``turn`` gives the block another kind and level.

A document's edits are folded in their order in one row, so documents are independent of
each other and nothing is shuffled but the log, to its document. The fold is a small loop
over a batch's flat columns; a block is held as runs of one style, so an edit costs the
runs of its block and not the characters of its document. Defined cases: an edit
whose block is missing, whose kind is unknown or whose fields are null changes nothing;
offsets beyond the text are its end, below 0 its start; null blocks or a null log are
empty ones.
"""

from __future__ import annotations

from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docstrata.operators import flat
from docstrata.operators.editor import BOLD, CHARS, CODE, ITALIC, STRIKE, UNDERLINE, let

INLINE = ("heading", "paragraph", "quote", "bullet", "numbered", "code")
BLOCKS = f"array<struct<kind:string,level:int,chars:{CHARS}>>"
LOG = "array<struct<op:string,block:int,at:int,text:string,kind:string,level:int,style:int>>"
#: Elements of blocks; a heading's has its level.
TAGS = {"heading": "h", "paragraph": "p", "quote": "blockquote", "bullet": "li", "numbered": "li", "code": "pre", "table": "table", "image": "img", "rule": "hr"}


def _inline(block: Column) -> Column:
    return F.coalesce(block["kind"].isin(*INLINE), F.lit(False))


# A block is a list of its kind, level and runs; a run is (characters, style).


def _long(run: tuple) -> int:
    return len(run[0]) if run[0] else 1


def _cut(runs: list, at: int) -> tuple[list, list]:
    """Runs before and from an offset."""
    for k, run in enumerate(runs):
        n = _long(run)
        if at < n:
            inside = at > 0
            return runs[:k] + [(run[0][:at], run[1])] * inside, [(run[0][at:], run[1])] * inside + runs[k + (1 if inside else 0) :]
        at -= n
    return runs, []


def _without(runs: list, at: int) -> list:
    before, rest = _cut(runs, at)
    return before + _cut(rest, 1)[1]


def _is(blocks: list, k: int) -> bool:
    return k < len(blocks) and blocks[k] is not None and blocks[k][0] in INLINE


def _join(blocks: list, k: int) -> None:
    """Block ``k`` gets the characters of the next one, which goes."""
    if _is(blocks, k) and _is(blocks, k + 1):
        blocks[k] = [*blocks[k][:2], blocks[k][2] + blocks.pop(k + 1)[2]]


def _edit(blocks: list, op, k, at, text, kind, level, style) -> None:
    new = [(text, style or 0)] if text else []
    if not blocks:
        if op == "split" or (op == "insert" and new):
            blocks.append(["paragraph", 0, new if op == "insert" else []])
        return
    if k is None or at is None or not 0 <= k < len(blocks) or blocks[k] is None:
        return
    here, level_here, runs = blocks[k]
    size = sum(map(_long, runs))
    at = max(0, min(at, size))
    if op == "backspace" and at == 0 and k > 0:
        _join(blocks, k - 1)
    elif op == "delete" and at == size:
        _join(blocks, k)
    elif here not in INLINE:
        return
    elif op == "insert":
        before, after = _cut(runs, at)
        blocks[k] = [here, level_here, before + new + after]
    elif op == "backspace" and at > 0:
        blocks[k] = [here, level_here, _without(runs, at - 1)]
    elif op == "delete":
        blocks[k] = [here, level_here, _without(runs, at)]
    elif op == "split" and size == 0 and here in ("bullet", "numbered", "quote"):
        blocks[k] = ["paragraph", 0, []]
    elif op == "split":
        before, after = _cut(runs, at)
        blocks[k : k + 1] = [here, level_here, before], ["paragraph", 0, after] if here == "heading" else [here, level_here, after]
    elif op == "turn" and kind in INLINE:
        blocks[k] = [kind, level or 0, runs]


def _replay(blocks: pa.Array, log: pa.Array) -> pa.Array:
    """Batches of documents as flat columns, each replayed in its order, and flat columns again."""
    given = blocks.flatten()
    kinds, levels, chars = given.flatten()
    runs = list(zip(*(x.to_pylist() for x in chars.flatten().flatten()), strict=True))
    edges = [0, *accumulate(flat.sizes(chars))]
    known = given.is_valid().to_pylist()
    made = [[kind, level, runs[edges[k] : edges[k + 1]]] if known[k] else None for k, (kind, level) in enumerate(zip(kinds.to_pylist(), levels.to_pylist(), strict=True))]
    edits = list(zip(*(x.to_pylist() for x in log.flatten().flatten()), strict=True))
    lengths, out, at, first = [], [], 0, 0
    for n, m in zip(flat.sizes(blocks), flat.sizes(log), strict=True):
        document = made[at : at + n]
        for edit in edits[first : first + m]:
            _edit(document, *edit)
        lengths.append(len(document))
        out += document
        at, first = at + n, first + m
    none = [b is None for b in out]
    kinds, levels, runs = zip(*(b or (None, None, []) for b in out), strict=True) if out else [()] * 3
    every = [*chain.from_iterable(runs)]
    chars = pa.StructArray.from_arrays([pa.array([r[0] for r in every], pa.string()), pa.array([r[1] for r in every], pa.int32())], ["ch", "style"])
    columns = [pa.array(kinds, pa.string()), pa.array(levels, pa.int32()), flat.lists([len(r) for r in runs], chars)]
    return flat.lists(lengths, pa.StructArray.from_arrays(columns, ["kind", "level", "chars"], mask=pa.array(none, pa.bool_())))


def replay_runs(blocks: Column, log: Column) -> Column:
    """``replay`` on blocks whose elements of ``chars`` may hold several characters of one style; what is put in is one element."""
    none = lambda kind: F.expr(f"cast(array() as {kind})")
    return F.arrow_udf(_replay, BLOCKS)(F.coalesce(blocks.cast(BLOCKS), none(BLOCKS)), F.coalesce(log.cast(LOG), none(LOG)))


def replay(blocks: Column, log: Column) -> Column:
    """The blocks after all edits of the log, in its order."""
    single = lambda r: F.when(F.length(r["ch"]) > 1, F.transform(F.split(r["ch"], ""), lambda c: F.struct(c.alias("ch"), r["style"].alias("style")))).otherwise(F.array(r))
    return F.transform(replay_runs(blocks, log), lambda b: F.when(b.isNotNull(), F.struct(b["kind"].alias("kind"), b["level"].alias("level"), F.flatten(F.transform(b["chars"], single)).alias("chars")))).cast(BLOCKS)


def _style_at(chars: Column, at: Column) -> Column:
    """The style of the character at an offset, of elements of any length."""
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("int").alias("style"))
    return F.aggregate(chars, start, lambda t, c: F.struct((t["n"] + F.greatest(F.lit(1), F.length(c["ch"]))).alias("n"), F.when(t["n"] <= at, c["style"]).otherwise(t["style"]).alias("style")), lambda t: t["style"])


def path(blocks: Column, block: Column, at: Column) -> Column:
    """The elements around a place, from the body to the marks of the character before it."""
    marks = ((CODE, "code"), (BOLD, "strong"), (ITALIC, "em"), (UNDERLINE, "u"), (STRIKE, "s"))

    def around(b: Column) -> Column:
        tag = F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair])[b["kind"]]
        tag = F.when(b["kind"] == "heading", F.concat(tag, b["level"].cast("string"))).otherwise(F.coalesce(tag, F.lit("div")))
        size = F.aggregate(b["chars"], F.lit(0), lambda n, c: n + F.greatest(F.lit(1), F.length(c["ch"])))
        style = F.coalesce(let(F.greatest(F.lit(0), F.least(at, size) - 1), lambda k: _style_at(b["chars"], k)), F.lit(0))
        wrapper = F.when(b["kind"] == "numbered", F.array(F.lit("ol"))).when(b["kind"] == "bullet", F.array(F.lit("ul"))).otherwise(F.expr("cast(array() as array<string>)"))
        inner = F.filter(F.array(*[F.when(style.bitwiseAND(F.lit(flag)) != 0, name) for flag, name in marks]), lambda x: x.isNotNull())
        return F.when(b.isNull(), F.array(F.lit("body"))).otherwise(F.concat(F.array(F.lit("body")), wrapper, F.array(tag), F.when(_inline(b), inner).otherwise(F.expr("cast(array() as array<string>)"))))

    return F.array_join(let(F.get(blocks, block), around), " > ")
