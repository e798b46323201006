"""DOCX bytes to blocks: the package's document part, its relationships and media."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as tree
import zipfile

from docstrata.operators.model import Block, Document, Inline, plain

DOCUMENT, RELATIONS = "word/document.xml", "word/_rels/document.xml.rels"


class DocumentError(ValueError):
    """kind: InvalidArchive, MissingPart or InvalidXml."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


def _name(element: tree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _find(element: tree.Element, *names: str) -> list[tree.Element]:
    return [e for e in element.iter() if _name(e) in names]


def _value(element: tree.Element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == name), None)


def target_path(target: str) -> str:
    """Package path of a relationship's target."""
    if target.startswith("/"):
        return target[1:]
    return posixpath.normpath(target if target.startswith("word/") else f"word/{target}")


def _relations(data: str | None) -> dict[str, tuple[str, bool]]:
    """Id -> (target, whether it is outside the package)."""
    if not data:
        return {}
    found = {}
    for e in _find(_xml(data), "Relationship"):
        if _value(e, "Id") and _value(e, "Target"):
            found[_value(e, "Id")] = (_value(e, "Target"), _value(e, "TargetMode") == "External")
    return found


def _xml(data: str) -> tree.Element:
    if re.search(r"<!(?:DOCTYPE|ENTITY)", data[:4096]):
        raise DocumentError("InvalidXml", "document types are not read")
    try:
        return tree.fromstring(data)
    except tree.ParseError as e:
        raise DocumentError("InvalidXml", str(e)) from e


def heading_level(style: str | None) -> int | None:
    if not style or not style.lower().startswith("heading"):
        return None
    digits = re.sub(r"[^0-9]", "", style)
    return min(6, max(1, int(digits[:3]))) if digits else 1


class Reader:
    def __init__(self, data: bytes, include_images: bool = True):
        try:
            self.archive = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, OSError) as e:
            raise DocumentError("InvalidArchive", str(e)) from e
        self.doc = Document(source_format="docx")
        self.include_images = include_images
        self.relations = _relations(self.part(RELATIONS))

    def part(self, name: str) -> str | None:
        try:
            return self.archive.read(name).decode("utf-8-sig", "replace")
        except KeyError:
            return None
        except (zipfile.BadZipFile, OSError) as e:
            raise DocumentError("InvalidArchive", str(e)) from e

    def media(self) -> list[str]:
        return [n for n in self.archive.namelist() if n.startswith("word/media/") and not n.endswith("/")]

    def run(self, run: tree.Element) -> list[Inline]:
        style = {_name(e): _value(e, "val") for p in run if _name(p) == "rPr" for e in p}
        on = lambda key: key in style and style[key] not in ("0", "false", "none")
        out: list[Inline] = []
        for e in run:
            kind = _name(e)
            if kind == "t":
                out.append(("text", e.text or "", {}))
            elif kind == "tab":
                out.append(("text", "\t", {}))
            elif kind in ("br", "cr"):
                out.append(("break", "", {}))
            elif kind in ("drawing", "pict") and self.include_images:
                out += self.images(e)
        for key, wrap in (("strike", "strike"), ("i", "emphasis"), ("b", "strong"), ("u", "underline")):
            if on(key) and any(x[0] != "image" for x in out):
                out = [(wrap, out, {})]
        return out

    def images(self, holder: tree.Element) -> list[Inline]:
        alt = next((_value(e, "descr") for e in _find(holder, "docPr") if _value(e, "descr")), "")
        out = []
        for e in _find(holder, "blip", "imagedata"):
            known = self.relations.get(_value(e, "embed") or _value(e, "id") or "")
            if known:
                path = known[0] if known[1] else target_path(known[0])
                number = len(self.doc.assets) + 1
                self.doc.assets.append({"id": f"docx-image-{number}", "path": path, "alt": alt or ""})
                out.append(("image", "", {"src": path, "alt": alt or ""}))
        return out

    def inlines(self, paragraph: tree.Element) -> list[Inline]:
        out: list[Inline] = []
        for e in paragraph:
            kind = _name(e)
            if kind == "r":
                out += self.run(e)
            elif kind == "hyperlink":
                href = self.relations.get(_value(e, "id") or "", ("#" + (_value(e, "anchor") or ""), True))[0]
                out.append(("link", self.inlines(e), {"href": href}))
            elif kind in ("ins", "smartTag", "sdt", "sdtContent", "fldSimple"):
                out += self.inlines(e)
        return out

    def paragraph(self, p: tree.Element) -> Block | None:
        properties = next((e for e in p if _name(e) == "pPr"), None)
        style = next((_value(e, "val") for e in properties if _name(e) == "pStyle"), None) if properties is not None else None
        found = self.inlines(p)
        if not found:
            return None
        if level := heading_level(style):
            return Block("heading", found, level)
        if properties is not None and _find(properties, "numPr"):
            return Block("list", attributes={"ordered": "false"}, children=[Block("item", found)])
        return Block("paragraph", found)

    def table(self, t: tree.Element) -> Block:
        rows = []
        for r in (e for e in t if _name(e) == "tr"):
            header = any(_name(x) == "tblHeader" for p in r if _name(p) == "trPr" for x in p) or bool(any(_find(c, "tblHeader") for c in r if _name(c) == "tc"))
            row = []
            for c in (e for e in r if _name(e) == "tc"):
                span = next((_value(x, "val") for x in _find(c, "gridSpan")), "1") or "1"
                content: list[Inline] = []
                for b in self.content(c):
                    if content:
                        content.append(("break", "", {}))
                    content += b.inlines or ([("text", plain(b.inlines), {})] if b.inlines else [x for i in b.children for x in i.inlines])
                row.append((content, header, "", int(span) if span.isdigit() else 1, 1))
            rows.append(row)
        return Block("table", rows=rows)

    def content(self, holder: tree.Element) -> list[Block]:
        out: list[Block] = []
        for e in holder:
            kind = _name(e)
            if kind == "p":
                b = self.paragraph(e)
                if b:
                    out.append(b)
            elif kind == "tbl":
                out.append(self.table(e))
            elif kind in ("sdt", "sdtContent"):
                out += self.content(e)
        return out

    def read(self) -> Document:
        data = self.part(DOCUMENT)
        if data is None:
            raise DocumentError("MissingPart", DOCUMENT)
        root = _xml(data)
        body = next((e for e in root if _name(e) == "body"), root)
        self.doc.blocks = self.content(body)
        self.doc.title = next((plain(b.inlines) for b in self.doc.blocks if b.kind == "heading" and b.level == 1), None)
        used = {a["path"] for a in self.doc.assets}
        self.doc.warnings += [f"media part {m} is not referenced" for m in self.media() if m not in used]
        return self.doc


def parse(data: bytes, include_images: bool = True) -> Document:
    return Reader(data, include_images).read()
