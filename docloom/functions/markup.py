"""Markup that needs a scan with state: headings, Markdown blocks, HTML structure, fixed-width tables, e-mail. Arrow-batched helpers."""

from __future__ import annotations

import email
import email.policy
import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import OVERLAP, TARGET

HEADING = re.compile(r"^(#{1,4})\s+(.+)$", re.M)
REFERENCE = re.compile(r"&(?:(#\d+;|#[xX][0-9a-fA-F]+;)|([A-Za-z][A-Za-z0-9]*;))?")
FENCE = re.compile(r"`{3,}|~{3,}")
#: Classes of lines, the first that matches holds.
LINES = [
    (letter, re.compile(pattern))
    for letter, pattern in (
        ("t", r"\s*\||[\s:]*-{3,}"),
        ("b", r"\s*$"),
        ("h", r"\s*#{1,6}\s"),
        ("r", r"\s*[-*_]{3,}\s*$"),
        ("q", r"\s*>"),
        ("l", r"\s*(?:[-*+]|\d+[.)]) "),
        ("m", r"\s{2,}"),
        ("p", r""),
    )
]
#: Blocks as runs of line classes: text goes on over one blank line, quotes and lists over any number of them to more of their kind.
BLOCK = re.compile(r"fi*|t+|r|[hmp](?:b?p)*|q(?:b*q|p)*|l(?:b*[lm]|p)*")
SKIPPED = frozenset("script style nav header footer aside iframe noscript form".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def sections_of(text: str) -> list[tuple[str | None, int, str]]:
    """(title, level, content); what stands before the first heading has no title."""
    marks = list(HEADING.finditer(text))
    if not marks:
        return [(None, 0, text)]
    before = text[: marks[0].start()].strip()
    ends = [m.start() for m in marks[1:]] + [len(text)]
    return ([(None, 0, before)] if before else []) + [(m[2].strip(), len(m[1]), text[m.end() : end].strip()) for m, end in zip(marks, ends, strict=True)]


@F.pandas_udf(T.ArrayType(T.StructType().add("title", "string").add("level", "integer").add("content", "string")))
def heading_sections(text: pd.Series) -> pd.Series:
    """T03; null for null."""
    return text.map(lambda t: None if t is None else [{"title": a, "level": b, "content": c} for a, b, c in sections_of(t)])


def line_classes(lines: list[str]) -> str:
    """A letter for each line: f opens a fence and i lies in it, t table, h heading, r rule, q quote, l list item, m indented, b blank, p text."""
    out, fence = [], ""
    for line in lines:
        bare = line.strip()
        mark = FENCE.match(bare)
        if fence:
            out.append("i")
            if mark and set(bare) == {fence}:
                fence = ""
        elif mark:
            out.append("f")
            fence = bare[0]
        else:
            out.append(next(letter for letter, pattern in LINES if pattern.match(line)))
    return "".join(out)


def blocks_of(text: str) -> list[str]:
    """Markdown blocks that can stand alone: fences, tables, headings with their text, rules, quotes, lists and paragraphs."""
    lines = text.split("\n")
    found = ("\n".join(lines[m.start() : m.end()]).strip() for m in BLOCK.finditer(line_classes(lines)))
    return [block for block in found if block]


@F.arrow_udf(T.ArrayType(T.StringType()))
def markdown_blocks(text: pa.Array) -> pa.Array:
    """T17"""
    return pa.array((blocks_of(t.as_py() or "") for t in text), pa.list_(pa.string()))


class Outline(HTMLParser):
    """Visible text of a page, and its headings, items, paragraphs and cells within the first main container."""

    CONTAINERS = ("main", "article", "role=main", "class=main-content", "class=content", "class=post-content", "class=article-content", "class=entry-content", "id=main", "id=content", "body")
    PARTS = frozenset("h1 h2 h3 h4 h5 h6 li p td th tr".split())

    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []  # (tag, index of its part or -1)
        self.skip = 0
        self.visible: list[str] = []
        self.parts: list[tuple[str, list[str]]] = []
        self.spans: dict[str, tuple[int, int | None]] = {}
        self.inside: list[tuple[str, int]] = []
        self.feed(source)
        self.close()

    def handle_starttag(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            return
        if tag == "p" and any(t == "p" for t, _ in self.open):
            self.handle_endtag("p")
        if tag == "li" and self.open and self.open[-1][0] == "li":
            self.handle_endtag("li")
        self.skip += tag in SKIPPED
        part = -1
        if tag in self.PARTS and not self.skip:
            part = len(self.parts)
            self.parts.append((tag, []))
        values = {k: (v or "") for k, v in attributes}
        names = [tag, f"role={values.get('role', '')}", f"id={values.get('id', '')}", *(f"class={c}" for c in values.get("class", "").split())]
        if not self.skip:
            for name in names:
                if name in self.CONTAINERS and name not in self.spans:
                    self.spans[name] = (len(self.parts) - (part >= 0), None)
                    self.inside.append((name, len(self.open)))
        self.open.append((tag, part))

    def handle_endtag(self, tag: str) -> None:
        depth = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag), None)
        if depth is None:
            return
        self.skip -= sum(t in SKIPPED for t, _ in self.open[depth:])
        del self.open[depth:]
        for name, at in [x for x in self.inside if x[1] >= depth]:
            self.spans[name] = (self.spans[name][0], len(self.parts))
            self.inside.remove((name, at))

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if text and not self.skip:
            self.visible.append(text)
            for _, part in self.open:
                if part >= 0:
                    self.parts[part][1].append(text)

    def shown(self) -> str:
        return " ".join(self.visible)

    def structured(self) -> str:
        chosen = next((self.spans[c] for c in self.CONTAINERS if c in self.spans), None)
        if chosen is None:
            return " ".join(self.visible)
        lines = []
        for tag, texts in self.parts[chosen[0] : chosen[1]]:
            text = (" " if tag == "p" else "").join(texts)
            if tag == "tr":
                lines.append("")
            elif text:
                mark = {"h1": "\n# ", "h2": "\n## ", "li": "- "}.get(tag, "\n### " if tag[0] == "h" else "")
                lines.append(mark + text + ("\n" if tag[0] == "h" and tag[1:].isdigit() else " | " if tag in ("td", "th") else ""))
        return "\n".join(lines)


def whole_references(source: str) -> str:
    """The source with each ampersand that begins no reference ended by a semicolon written as one, so that it is read as it stands."""
    return REFERENCE.sub(lambda m: m[0] if m[1] or m[2] in html5 else f"&amp;{m[0][1:]}", source)


def page_text(html: Column | str, ended: bool = False) -> Column:
    """All visible text joined by spaces; headings, items, paragraphs and cells of the main container as light Markdown.

    ended: only references that a semicolon ends are decoded; else also those that browsers know without one (`&amp`, `&copy`).
    A task holds an Arrow batch of pages and their texts; a page's outline goes once its texts are made.
    """

    @F.arrow_udf("struct<visible:string,structured:string>")
    def outlined(column: pa.Array) -> pa.Array:
        visible, structured = [], []
        for source in column:
            page = Outline(whole_references(source.as_py() or "") if ended else source.as_py() or "")
            visible.append(page.shown())
            structured.append(page.structured())
        return pa.StructArray.from_arrays([pa.array(visible, pa.string()), pa.array(structured, pa.string())], names=["visible", "structured"])

    return outlined(html)


def fixed_width(text: str) -> list[dict]:
    """Tables of `=== label ===` parts whose header names stand at least two spaces apart; cells are cut at the names' offsets."""
    parts = re.split(r"^=== (.+?) ===\s*$", text, flags=re.M)
    out = []
    for label, body in zip(["", *parts[1::2]], [parts[0], *parts[2::2]], strict=True):
        lines = [x for x in body.split("\n") if x.strip()]
        if not lines:
            continue
        heads = [(m.start(), m[0]) for m in re.finditer(r"\S+(?: \S+)*", lines[0])]
        if len(heads) < 2:
            out.append({"label": label, "header": [], "rows": [[x] for x in lines]})
            continue
        cuts = [0, *[a for a, _ in heads[1:]], None]
        out.append({"label": label, "header": [h for _, h in heads], "rows": [[x[a:b].strip() for a, b in zip(cuts, cuts[1:], strict=False)] for x in lines[1:]]})
    return out


@F.pandas_udf(T.ArrayType(T.StructType().add("label", "string").add("header", T.ArrayType(T.StringType())).add("rows", T.ArrayType(T.ArrayType(T.StringType())))))
def fixed_width_tables(text: pd.Series) -> pd.Series:
    """C09"""
    return text.map(lambda t: fixed_width(t or ""))


def mail_text(raw: bytes) -> str:
    mail = email.message_from_bytes(raw, policy=email.policy.default)
    body = mail.get_body(("plain", "html"))
    text = body.get_content() if body else ""
    if body is not None and body.get_content_type() == "text/html":
        text = " ".join(Outline(text).visible)
    head = [f"{k}: {mail[k]}" for k in ("Subject", "From", "Date") if mail[k]]
    return "\n".join([*head, "", text.strip()])


@F.pandas_udf(T.StringType())
def email_text(content: pd.Series) -> pd.Series:
    """Subject, sender and date lines, then the first plain part (or the HTML part without tags)."""
    return content.map(lambda raw: None if raw is None else mail_text(bytes(raw)))


def packs_of(parts: list[str], size: int, overlap: int) -> list[str]:
    """Sentences packed up to `size` characters; the last ones of a pack, up to `overlap` characters, begin the next as well."""
    out, begin, held = [], 0, 0
    for i, part in enumerate(parts):
        if i > begin and held + len(part) > size:
            out.append(" ".join(parts[begin:i]))
            least, begin, held = begin, i, 0
            while begin > least and held + len(parts[begin - 1]) <= overlap:
                begin -= 1
                held += len(parts[begin])
        held += len(part)
    return out + [" ".join(parts[begin:])] if parts else out


def packed(parts: Column, size: int = TARGET, overlap: int = OVERLAP) -> Column:
    """T06; null for null."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pack(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else packs_of(list(x), size, overlap))

    return pack(parts)
