"""Markdown text to blocks: a line scanner for blocks, a bracket and delimiter scanner for inlines.

An opening sign without its partner is plain text, so every input ends.
"""

from __future__ import annotations

import re

from docstrata.operators.model import Block, Document, Inline, plain

FENCE = re.compile(r"^\s*(```|~~~)(.*)$")
HEADING = re.compile(r"^\s*(#{1,6}) (.*)$")
RULE = re.compile(r"^\s*(?:-{3,}|\*{3,}|_{3,})\s*$")
ITEM = re.compile(r"^\s*(?:([-*+])|([0-9]{1,18})\.) (.*)$")
TASK = re.compile(r"^\[([ xX])\] (.*)$", re.S)
QUOTE = re.compile(r"^\s*> ?")
SEPARATOR = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
LABEL = re.compile(r"\[([^\[\]]*)\]")
TARGET = re.compile(r"\(([^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?:\s+\"([^\"]*)\")?\s*\)")
#: Signs that can't begin anything stay as they are, all up to the next one that can.
PLAIN = re.compile(r"[^\\`\[!*_~]+")
#: Paired signs, longest first, with what they mean.
PAIRS = (("**", "strong"), ("__", "strong"), ("~~", "strike"), ("*", "emphasis"), ("_", "emphasis"))


def inlines(source: str) -> list[Inline]:
    out: list[Inline] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            out.append(("text", "".join(held), {}))
            held.clear()

    closed: dict[str, bool] = {}
    i = 0
    while i < len(source):
        if m := PLAIN.match(source, i):
            held.append(m[0])
            i = m.end()
            continue
        c = source[i]
        if c == "\\" and source[i + 1 : i + 2] == "\n":
            flush()
            out.append(("break", "", {}))
            i += 2
            continue
        if c == "`":
            end = source.find("`", i + 1)
            if end > i:
                flush()
                out.append(("code", source[i + 1 : end], {}))
                i = end + 1
                continue
        if c == "[" or source.startswith("![", i):
            image = c == "!"
            name = LABEL.match(source, i + image)
            m = TARGET.match(source, name.end()) if name else None
            if m:
                flush()
                label, extra = name[1], {"title": m[2]} if m[2] else {}
                out.append(("image", "", {"src": m[1], "alt": label} | extra) if image else ("link", inlines(label), {"href": m[1]} | extra))
                i = m.end()
                continue
        taken = False
        for sign, kind in PAIRS:
            # An underscore inside a word is a letter like any other.
            if not source.startswith(sign, i) or closed.get(sign) or sign[0] == "_" and i and source[i - 1].isalnum():
                continue
            end = source.find(sign, i + len(sign))
            if end < 0:
                closed[sign] = True  # nothing further on closes it either
            elif end > i + len(sign):
                flush()
                out.append((kind, inlines(source[i + len(sign) : end]), {}))
                i, taken = end + len(sign), True
                break
        if not taken:
            held.append(c)
            i += 1
    flush()
    return out


def cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def alignment(cell: str) -> str:
    return {(True, True): "center", (False, True): "right", (True, False): "left"}.get((cell.startswith(":"), cell.endswith(":")), "")


#: Quotes nested deeper than this are one paragraph of their text, so that no document overflows the stack.
DEPTH = 100


def blocks(lines: list[str], depth: int = 0) -> list[Block]:
    out: list[Block] = []
    i = 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif m := FENCE.match(line):
            end = next((k for k in range(i + 1, len(lines)) if lines[k].strip().startswith(m[1])), len(lines))
            out.append(Block("code", [("text", "\n".join(lines[i + 1 : end]), {})], attributes={"language": m[2].strip()} if m[2].strip() else {}))
            i = end + 1
        elif m := HEADING.match(line):
            out.append(Block("heading", inlines(m[2].strip()), len(m[1])))
            i += 1
        elif RULE.match(line):
            out.append(Block("rule"))
            i += 1
        elif QUOTE.match(line):
            end = next((k for k in range(i, len(lines)) if not QUOTE.match(lines[k])), len(lines))
            inner = [QUOTE.sub("", x, count=1) for x in lines[i:end]]
            if depth < DEPTH:
                out.append(Block("quote", children=blocks(inner, depth + 1)))
            else:
                out.append(Block("quote", children=[Block("paragraph", [("text", " ".join(x.lstrip("> \t") for x in inner).strip(), {})])]))
            i = end
        elif "|" in line and i + 1 < len(lines) and "|" in lines[i + 1] + line and SEPARATOR.match(lines[i + 1]):
            aligns = [alignment(c) for c in cells(lines[i + 1])]
            end = next((k for k in range(i + 2, len(lines)) if "|" not in lines[k]), len(lines))
            body = [lines[i], *lines[i + 2 : end]]
            rows = [[(inlines(c), k == 0, aligns[n] if n < len(aligns) else "", 1, 1) for n, c in enumerate(cells(x))] for k, x in enumerate(body)]
            out.append(Block("table", rows=rows))
            i = end
        elif m := ITEM.match(line):
            ordered = m[1] is None
            made = Block("list", attributes={"ordered": str(ordered).lower()} | ({"start": m[2]} if ordered else {}))
            while i < len(lines) and (n := ITEM.match(lines[i])) and (n[1] is None) == ordered and not RULE.match(lines[i]):
                task = TASK.match(n[3])
                made.children.append(Block("item", inlines(task[2] if task else n[3]), attributes={"checked": str(task[1] != " ").lower()} if task else {}))
                i += 1
            out.append(made)
        else:
            end = next((k for k in range(i + 1, len(lines)) if not lines[k].strip() or any(p.match(lines[k]) for p in (FENCE, HEADING, RULE, QUOTE, ITEM))), len(lines))
            out.append(Block("paragraph", inlines(" ".join(x.strip() for x in lines[i:end]))))
            i = end
    return out


def parse(source: str) -> Document:
    found = blocks(source.replace("\r\n", "\n").replace("\r", "\n").split("\n"))
    title = next((plain(b.inlines) for b in found if b.kind == "heading" and b.level == 1), None)
    return Document(found, title, "markdown")
