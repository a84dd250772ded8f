"""Word and PowerPoint files as Markdown (S10): styles and numbering resolved into headings, list levels and tables."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from xml.etree import ElementTree
from xml.etree.ElementTree import Element

MOST_BYTES, MOST_DEPTH = 256_000_000, 50


@lru_cache(4096)
def bare(name: object) -> str:
    """A name without its namespace; comments have none."""
    return name.rpartition("}")[2] if isinstance(name, str) else ""


def local(e: Element) -> str:
    return bare(e.tag)


def value(e: Element | None, name: str = "val") -> str | None:
    """An attribute by its local name."""
    if e is not None:
        for k, v in e.items():
            if bare(k) == name:
                return v
    return None


def child(e: Element | None, *names: str) -> Element | None:
    for name in names:
        if e is None:
            return None
        for c in e:
            if bare(c.tag) == name:
                e = c
                break
        else:
            return None
    return e


def children(e: Element | None, name: str) -> Iterator[Element]:
    return (c for c in (e if e is not None else ()) if local(c) == name)


def number(text: str | None, other: int = 0) -> int:
    return int(text) if text is not None and re.fullmatch(r"-?\d{1,9}", text) else other


class Package:
    """The XML parts of a zipped file and their relations."""

    def __init__(self, content: bytes) -> None:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile as error:
            raise ValueError(str(error)) from error
        if sum(i.file_size for i in self.zip.infolist()) > MOST_BYTES:
            raise ValueError("too long when unpacked")
        self.names = set(self.zip.namelist())

    def part(self, name: str) -> Element | None:
        if name not in self.names:
            return None
        try:
            return ElementTree.fromstring(self.zip.read(name))
        except (ElementTree.ParseError, zipfile.BadZipFile, RuntimeError) as error:  # RuntimeError: encrypted
            raise ValueError(f"{name}: {error}") from error

    def relations(self, name: str) -> dict[str, tuple[str, str]]:
        """Id: (kind, part) of what a part refers to."""
        folder, file = posixpath.split(name)
        found = self.part(f"{folder}/_rels/{file}.rels".lstrip("/"))
        target = lambda e: (value(e, "Target") or "").lstrip("/") if (value(e, "Target") or "").startswith("/") else posixpath.normpath(posixpath.join(folder, value(e, "Target") or ""))
        return {value(e, "Id") or "": ((value(e, "Type") or "").rpartition("/")[2], target(e)) for e in children(found, "Relationship") if value(e, "TargetMode") != "External"}


def markdown_rows(rows: list[list[str]]) -> str:
    """A table, its first row being the head; empty rows go, short ones are filled."""
    rows = [r for r in rows if any(r)]
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + "---|" * width, *lines[1:]]) if lines else ""


def cell_text(parts: list[str]) -> str:
    return re.sub(r"\s+", " ", " ".join(parts)).strip().replace("|", "\\|")


class Styles:
    """What paragraphs inherit along the chains of their styles."""

    def __init__(self, part: Element | None) -> None:
        self.styles = {value(s, "styleId"): s for s in children(part, "style")}
        self.levels: dict[str | None, int | None] = {}
        self.lists: dict[str | None, tuple[str | None, str | None]] = {}
        self.usual = next((i for i, s in self.styles.items() if value(s, "type") == "paragraph" and value(s, "default") in ("1", "true")), None)

    def chain(self, style: str | None) -> Iterator[Element]:
        seen = set()
        style = style if style in self.styles else self.usual
        while style in self.styles and style not in seen:
            seen.add(style)
            yield self.styles[style]
            style = value(child(self.styles[style], "basedOn"))

    def level(self, paragraph: Element | None) -> int | None:
        """The heading level, from 1: an outline level of the paragraph or of the nearest style that has one, or a style's name."""
        own = value(child(paragraph, "outlineLvl"))
        if own is not None:
            return number(own) + 1 if number(own, 9) < 9 else None
        style = value(child(paragraph, "pStyle"))
        if style not in self.levels:
            self.levels[style] = self.style_level(style)
        return self.levels[style]

    def style_level(self, style: str | None) -> int | None:
        for style in self.chain(style):
            name = (value(child(style, "name")) or "").lower()
            if m := re.fullmatch(r"heading (\d)", name):
                return int(m[1])
            if name in ("title", "subtitle"):
                return 1 if name == "title" else 2
            if (outline := value(child(style, "pPr", "outlineLvl"))) is not None:
                return number(outline) + 1 if number(outline, 9) < 9 else None
        return None

    def list_of(self, paragraph: Element | None) -> tuple[str, int] | None:
        """(numbering, level) of a list item; a numbering 0 takes away an inherited one."""
        style, own = value(child(paragraph, "pStyle")), child(paragraph, "numPr")
        if style not in self.lists:
            found = [child(s, "pPr", "numPr") for s in self.chain(style)]
            self.lists[style] = tuple(next((v for n in found if (v := value(child(n, name))) is not None), None) for name in ("numId", "ilvl"))
        found_id, found_level = (v if v is not None else w for v, w in zip((value(child(own, "numId")), value(child(own, "ilvl"))), self.lists[style], strict=True))
        return (found_id, number(found_level)) if found_id not in (None, "0") else None


class Numbering:
    """Lists: their formats, starts and counters."""

    def __init__(self, part: Element | None) -> None:
        self.abstract = {value(a, "abstractNumId"): a for a in children(part, "abstractNum")}
        self.numbers = {value(n, "numId"): n for n in children(part, "num")}
        self.linked = {value(child(a, "styleLink")): a for a in self.abstract.values() if child(a, "styleLink") is not None}
        self.counts: dict[str, dict[int, int]] = defaultdict(dict)
        self.known: dict[tuple[str, int], tuple[str, int, str]] = {}

    def definition(self, numbering: str, level: int) -> tuple[str, int, str]:
        """(format, start, list whose counter runs) of a level."""
        num = self.numbers.get(numbering)
        kept = value(child(num, "abstractNumId"))
        abstract = self.abstract.get(kept)
        link = value(child(abstract, "numStyleLink"))
        abstract = self.linked.get(link, abstract) if link else abstract
        override = next((o for o in children(num, "lvlOverride") if number(value(o, "ilvl")) == level), None)
        own = child(override, "lvl")
        lvl = own if own is not None else next((x for x in children(abstract, "lvl") if number(value(x, "ilvl")) == level), None)
        start = value(child(override, "startOverride")) or value(child(lvl, "start"))
        return value(child(lvl, "numFmt")) or "decimal", number(start, 1), numbering if override is not None else f"a{kept}"

    def mark(self, numbering: str, level: int) -> str:
        if (numbering, level) not in self.known:
            self.known[numbering, level] = self.definition(numbering, level)
        kind, start, counter = self.known[numbering, level]
        counts = self.counts[counter]
        counts[level] = counts[level] + 1 if level in counts else start
        for deeper in [k for k in counts if k > level]:
            del counts[deeper]
        if kind == "none":
            return ""
        return "  " * level + ("- " if kind == "bullet" else f"{counts[level]}. ")


def shown(e: Element, depth: int = 0) -> str:
    """The text of runs as the reader sees it: without deleted parts, field codes and second forms of one thing."""
    out = []
    for c in e:
        name = bare(c.tag)
        if name == "t":
            out.append(c.text or "")
        elif name in ("tab", "ptab"):
            out.append("\t")
        elif name in ("br", "cr"):
            out.append("\n")
        elif name == "noBreakHyphen":
            out.append("-")
        elif name not in ("del", "moveFrom", "pPr", "rPr", "Fallback", "instrText", "delText", "txbxContent") and depth < MOST_DEPTH:
            out.append(shown(c, depth + 1))
    return "".join(out)


def blocks_of(e: Element, depth: int = 0) -> Iterator[Element]:
    """Paragraphs and tables in order, out of whatever wraps them."""
    for c in e:
        if (name := bare(c.tag)) in ("p", "tbl"):
            yield c
        elif name in ("sdt", "sdtContent", "customXml", "ins", "moveTo", "AlternateContent", "Choice", "smartTag") and depth < MOST_DEPTH:
            yield from blocks_of(c, depth + 1)


def table_rows(table: Element, depth: int = 0) -> list[list[str]]:
    rows = []
    for row in children(table, "tr"):
        cells = []
        for cell in children(row, "tc"):
            merge = child(cell, "tcPr", "vMerge")
            inner = [] if merge is not None and value(merge) != "restart" or depth > 10 else [" ".join(c for r in table_rows(b, depth + 1) for c in r) if local(b) == "tbl" else shown(b) for b in blocks_of(cell)]
            cells += [cell_text(inner), *[""] * (number(value(child(cell, "tcPr", "gridSpan")), 1) - 1)][: 1 + MOST_DEPTH]
        rows.append(cells)
    return rows


def docx_text(content: bytes) -> str:
    """A Word file as Markdown; ValueError if it can't be read."""
    package = Package(content)
    name = next((part for kind, part in package.relations("").values() if kind == "officeDocument"), "word/document.xml")
    document = package.part(name)
    if document is None:
        raise ValueError("no document")
    body = child(document, "body") if child(document, "body") is not None else document
    parts = {kind: part for kind, part in package.relations(name).values()}
    styles, numbering = Styles(package.part(parts.get("styles", "word/styles.xml"))), Numbering(package.part(parts.get("numbering", "word/numbering.xml")))
    out, last = [], ""
    for block in blocks_of(body):
        if local(block) == "tbl":
            said, kind = markdown_rows(table_rows(block)), "table"
        else:
            text, about = shown(block), child(block, "pPr")
            text = (re.sub(r" *\n *", "\n", text) if "\n" in text else text).strip()
            level, item = styles.level(about), styles.list_of(about)
            if level is not None and text:
                said, kind = "#" * min(level, 6) + " " + re.sub(r"\s+", " ", text), "heading"
            elif item is not None:
                mark = numbering.mark(*item)  # an empty item counts too
                said, kind = mark + re.sub(r"\s+", " ", text) if text else "", "item"
            else:
                said, kind = text, "text"
        if said:
            out.append(("\n" if kind == last == "item" else "\n\n" if out else "") + said)
            last = kind
    return "".join(out)


def paragraph_text(p: Element) -> str:
    return "".join("\n" if local(c) == "br" else shown(c) if local(c) in ("r", "fld") else "" for c in p).strip()


def slide_lines(tree: Element, holders: dict[str, str], depth: int = 0) -> Iterator[str]:
    """The lines of a slide's shapes: titles, list levels, tables; holders: kinds of the layout's placeholders by index."""
    for shape in tree:
        name = local(shape)
        if name == "grpSp" and depth < MOST_DEPTH:
            yield from slide_lines(shape, holders, depth + 1)
        elif name == "AlternateContent":
            yield from slide_lines(child(shape, "Choice") if child(shape, "Choice") is not None else Element("none"), holders, depth + 1)
        elif name == "graphicFrame":
            table = child(shape, "graphic", "graphicData", "tbl")
            rows = [[cell_text([paragraph_text(p) for p in children(child(c, "txBody"), "p")]) for c in children(r, "tc")] for r in children(table, "tr")]
            if text := markdown_rows(rows):
                yield "\n" + text
        elif name == "sp":
            holder = child(shape, "nvSpPr", "nvPr", "ph")
            kind = (value(holder, "type") or holders.get(value(holder, "idx") or "", "body")) if holder is not None else "box"
            if kind in ("dt", "ftr", "sldNum"):
                continue
            for p in children(child(shape, "txBody"), "p"):
                if not (text := paragraph_text(p)):
                    continue
                about = child(p, "pPr")
                if kind in ("title", "ctrTitle"):
                    yield "# " + re.sub(r"\s+", " ", text)
                elif child(about, "buNone") is None and (kind in ("body", "obj") or child(about, "buChar") is not None or child(about, "buAutoNum") is not None):
                    yield "  " * number(value(about, "lvl")) + "- " + re.sub(r"\s+", " ", text)
                else:
                    yield text


def pptx_text(content: bytes) -> str:
    """A presentation as Markdown, slides in their order under a line each; slides without text have none."""
    package = Package(content)
    name = next((part for kind, part in package.relations("").values() if kind == "officeDocument"), "ppt/presentation.xml")
    deck, relations = package.part(name), package.relations(name)
    if deck is None:
        raise ValueError("no presentation")
    out, layouts = [], {}
    for k, entry in enumerate(children(child(deck, "sldIdLst"), "sldId"), 1):
        ref = next((v for a, v in entry.attrib.items() if a.endswith("}id")), "")
        slide_name = relations.get(ref, ("", ""))[1]
        slide = package.part(slide_name)
        layout = next((part for kind, part in package.relations(slide_name).values() if kind == "slideLayout"), "")
        if layout not in layouts:  # slides share their layouts
            shapes = child(package.part(layout), "cSld", "spTree") if layout else None
            heads = [child(s, "nvSpPr", "nvPr", "ph") for s in children(shapes, "sp")]
            layouts[layout] = {value(h, "idx") or "": value(h, "type") or "body" for h in heads if h is not None}
        holders = layouts[layout]
        tree = child(slide, "cSld", "spTree")
        lines = list(slide_lines(tree, holders)) if tree is not None else []
        if lines:
            out.append(f"--- Slide {k} ---\n\n" + "\n".join(lines))
    return "\n\n".join(out)
