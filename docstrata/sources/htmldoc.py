"""HTML to blocks with the standard tokenizer: headings, paragraphs, lists, tables, code, quotes and links."""

from __future__ import annotations

from html.parser import HTMLParser

from docstrata.operators.model import Block, Document, Inline

#: Elements by what they make.
HEADINGS = {f"h{n}": n for n in range(1, 7)}
PARAGRAPHS = frozenset("p div section article main header footer nav aside figure figcaption address td th li dt dd caption".split())
HIDDEN = frozenset("script style template noscript".split())
MARKS = {"b": "strong", "strong": "strong", "i": "emphasis", "em": "emphasis", "del": "strike", "s": "strike", "u": "underline", "code": "code"}


class Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.doc = Document(source_format="html")
        self.kind, self.level, self.parts, self.marks = "paragraph", 0, [], []
        self.hidden, self.in_title, self.title = 0, False, []
        self.lists: list[Block] = []
        self.rows: list[list] | None = None

    def flush(self) -> None:
        inlines: list[Inline] = []
        before = " "
        for value, marks in self.parts:
            if value == "\n" and "break" in marks:
                inlines.append(("break", "", {}))
                before = " "
                continue
            value = " ".join(value.split()) if value.strip() else ""
            raw = self._raw.pop(0)
            lead = " " if raw[:1].isspace() and before != " " and inlines else ""
            if not value:
                before = " " if lead and inlines and not inlines.append(("text", " ", {})) else before
                continue
            before = " " if raw[-1:].isspace() else value[-1]
            node: Inline = ("text", lead + value + (" " if before == " " else ""), {})
            for kind, extra in reversed(marks):
                node = (kind, node[1] if kind == "code" else [node], extra)
            inlines.append(node)
        self.parts, self._raw = [], []
        while inlines and inlines[-1][0] in ("text", "break") and not str(inlines[-1][1]).strip():
            inlines.pop()
        if inlines and inlines[-1][0] == "text":
            inlines[-1] = ("text", inlines[-1][1].rstrip(), {})
        if not inlines:
            return
        if self.rows is not None and self.rows:
            if self.rows[-1]:
                self.rows[-1][-1][0].extend(inlines)
        elif self.lists and self.kind == "item":
            self.lists[-1].children.append(Block("item", inlines))
        else:
            self.doc.blocks.append(Block(self.kind if self.kind != "item" else "paragraph", inlines, self.level))

    _raw: list[str]

    def reset(self) -> None:
        super().reset()
        self._raw = []

    def handle_starttag(self, tag: str, attrs) -> None:
        a = dict(attrs)
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "html" and a.get("lang"):
            self.doc.language = a["lang"]
        elif tag == "br":
            self.parts.append(("\n", ["break"]))
        elif tag == "a":
            self.marks.append(("link", {"href": a.get("href") or ""}))
        elif tag in MARKS:
            self.marks.append((MARKS[tag], {}))
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists.append(Block("list", attributes={"ordered": str(tag == "ol").lower()} | ({"start": a["start"]} if a.get("start") else {})))
        elif tag == "table":
            self.flush()
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.flush()
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.flush()
            spans = [int(v) if (v := a.get(k) or "").isdigit() else 1 for k in ("colspan", "rowspan")]
            self.rows[-1].append(([], tag == "th", "", *spans))
        elif tag in HEADINGS or tag in PARAGRAPHS or tag in ("pre", "blockquote"):
            self.flush()
            self.marks = []
            self.kind, self.level = ("heading", HEADINGS[tag]) if tag in HEADINGS else ("item", 0) if tag == "li" else ("code", 0) if tag == "pre" else ("paragraph", 0)
        elif tag == "hr":
            self.flush()
            self.doc.blocks.append(Block("rule"))

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == "a" or tag in MARKS:
            kind = "link" if tag == "a" else MARKS[tag]
            k = next((k for k in range(len(self.marks) - 1, -1, -1) if self.marks[k][0] == kind), None)
            if k is not None:
                del self.marks[k]
        elif tag in ("ul", "ol"):
            self.flush()
            if self.lists:
                made = self.lists.pop()
                if made.children:
                    (self.lists[-1].children if self.lists else self.doc.blocks).append(made)
            self.kind = "paragraph"
        elif tag == "table" and self.rows is not None:
            self.flush()
            made, self.rows = Block("table", rows=[r for r in self.rows if r]), None
            if made.rows:
                self.doc.blocks.append(made)
        elif tag in HEADINGS or tag in PARAGRAPHS or tag in ("pre", "blockquote", "tr"):
            self.flush()
            self.kind, self.level = ("item" if self.lists else "paragraph"), 0

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self.parts.append((data, list(self.marks)))
            self._raw.append(data)


def parse(page: str | None) -> Document:
    reader = Reader()
    reader.feed(page or "")
    reader.close()
    reader.flush()
    while reader.lists:
        made = reader.lists.pop()
        if made.children:
            reader.doc.blocks.append(made)
    reader.doc.title = " ".join("".join(reader.title).split()) or None
    return reader.doc
