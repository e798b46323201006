"""Blocks and inlines of a document, and their HTML.

A document is a flat list of blocks. ``path`` places a block below others (list
items and quotes), children follow their parent. Inlines are nested tuples
``(kind, value, attributes)`` where value is text or a list of inlines.
"""

from __future__ import annotations

from dataclasses import dataclass, field

Inline = tuple


@dataclass
class Block:
    kind: str
    inlines: list[Inline] = field(default_factory=list)
    level: int = 0
    #: language, start, ordered, checked, page, reason, src, ... as text
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Block] = field(default_factory=list)
    #: Rows of cells for tables: (inlines, header, align, colspan, rowspan).
    rows: list[list[tuple[list[Inline], bool, str, int, int]]] = field(default_factory=list)


@dataclass
class Document:
    blocks: list[Block] = field(default_factory=list)
    title: str | None = None
    source_format: str | None = None
    language: str | None = None
    warnings: list[str] = field(default_factory=list)
    assets: list[dict[str, str]] = field(default_factory=list)


def text(*parts: str) -> list[Inline]:
    return [("text", p, {}) for p in parts if p]


def plain(inlines: list[Inline]) -> str:
    """Text of inlines; images give their alternative text, breaks a newline."""
    out = []
    for kind, value, attributes in inlines:
        if kind == "image":
            out.append(attributes.get("alt", ""))
        elif kind == "break":
            out.append("\n")
        else:
            out.append(value if isinstance(value, str) else plain(value))
    return "".join(out)


def block_text(block: Block) -> str:
    if block.rows:
        return "\n".join("\t".join(plain(c[0]) for c in row) for row in block.rows)
    own = plain(block.inlines)
    return "\n".join(x for x in [own, *map(block_text, block.children)] if x)


def escape(value: str) -> str:
    return value.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def quote(value: str) -> str:
    return escape(value).replace('"', "&quot;")


def attributes_html(**values: str | int | None) -> str:
    return "".join(f' {name.rstrip("_").replace("_", "-")}="{quote(str(v))}"' for name, v in values.items() if v not in (None, ""))


WRAPS = {"emphasis": "em", "strong": "strong", "strike": "del", "underline": "u"}


def inline_html(inlines: list[Inline]) -> str:
    out = []
    for kind, value, a in inlines:
        inner = escape(value) if isinstance(value, str) else inline_html(value)
        if kind in WRAPS:
            out.append(f"<{WRAPS[kind]}>{inner}</{WRAPS[kind]}>")
        elif kind == "code":
            out.append(f"<code>{inner}</code>")
        elif kind == "link":
            out.append(f"<a{attributes_html(href=a.get('href'), title=a.get('title'))}>{inner}</a>")
        elif kind == "image":
            out.append(f"<img{attributes_html(src=a.get('src'))} alt=\"{quote(a.get('alt', ''))}\"{attributes_html(title=a.get('title'), width=a.get('width'), height=a.get('height'))}>")
        elif kind == "break":
            out.append("<br>")
        else:
            out.append(inner)
    return "".join(out)


def cell_html(cell: tuple) -> str:
    inlines, header, align, colspan, rowspan = cell
    tag = "th" if header else "td"
    style = f"text-align: {align}" if align else None
    return f"<{tag}{attributes_html(colspan=colspan if colspan > 1 else None, rowspan=rowspan if rowspan > 1 else None, style=style)}>{inline_html(inlines)}</{tag}>"


def item_html(item: Block) -> str:
    box = {"true": '<input type="checkbox" disabled checked> ', "false": '<input type="checkbox" disabled> '}.get(item.attributes.get("checked", ""), "")
    inner = "".join(inline_html(c.inlines) if c.kind == "paragraph" else block_html(c) for c in item.children)
    return f"<li>{box}{inline_html(item.inlines)}{inner}</li>\n"


def block_html(block: Block) -> str:
    a, kind = block.attributes, block.kind
    inner = inline_html(block.inlines)
    if kind == "heading":
        level = min(6, max(1, block.level))
        return f"<h{level}>{inner}</h{level}>\n"
    if kind == "paragraph":
        return f"<p>{inner}</p>\n"
    if kind == "quote":
        return f"<blockquote>\n{''.join(map(block_html, block.children))}</blockquote>\n"
    if kind == "code":
        language = f"language-{a['language']}" if a.get("language") else None
        return f"<pre><code{attributes_html(class_=language)}>{inner}</code></pre>\n"
    if kind == "list":
        tag = "ol" if a.get("ordered") == "true" else "ul"
        return f"<{tag}{attributes_html(start=a.get('start') if a.get('start') != '1' else None)}>\n{''.join(map(item_html, block.children))}</{tag}>\n"
    if kind == "table":
        rows = "".join(f"<tr>{''.join(map(cell_html, row))}</tr>\n" for row in block.rows)
        return f"<table>\n{rows}</table>\n"
    if kind == "rule":
        return "<hr>\n"
    if kind == "page_break":
        return f'<hr data-page-break="true"{attributes_html(data_page=a.get("page"))}>\n'
    if kind == "page_placeholder":
        return f'<div data-page-placeholder="true"{attributes_html(data_page=a.get("page"), data_reason=a.get("reason"))}></div>\n'
    if kind == "raw":
        return plain(block.inlines).rstrip("\n") + "\n"
    return f"{inner}\n" if inner else ""


def document_html(doc: Document) -> str:
    head = f'<!DOCTYPE html>\n<html{attributes_html(lang=doc.language)}>\n<head>\n<meta charset="utf-8">\n<title>{escape(doc.title or "Converted document")}</title>\n</head>\n'
    header = f"<header><h1>{escape(doc.title)}</h1></header>\n" if doc.title else ""
    warnings = '<section class="warnings">\n<ul>\n' + "".join(f"<li>{escape(w)}</li>\n" for w in doc.warnings) + "</ul>\n</section>\n" if doc.warnings else ""
    return f"{head}<body>\n<article>\n{header}{''.join(map(block_html, doc.blocks))}</article>\n{warnings}</body>\n</html>\n"


def rows(blocks: list[Block], parent: str = "") -> list[dict]:
    """Blocks as flat rows: path, kind, level, text, html, attributes."""
    out = []
    for i, b in enumerate(blocks):
        path = f"{parent}{i:06d}"
        out.append({"path": path, "kind": b.kind, "level": b.level, "text": block_text(b), "html": item_html(b) if b.kind == "item" else block_html(b), "attributes": [(k, str(v)) for k, v in b.attributes.items()]})
        out += rows(b.children, path + "/")
    return out
