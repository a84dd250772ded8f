"""PDF files made from the text of documents, each in one of several styles of the format, and the queries that read them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import pdf
from ..sources.readers import sliced
from .queries import register, t

PAGE_LINES, LINE_CHARS, GAP_EVERY, CODE_EVERY = 40, 60, 20, 7
STYLES = ("plain", "kerned", "packed", "form", "lost", "locked", "cut")


def layout_of(k: int) -> tuple[int, float, float, str]:
    """Page, height of the base line, size and font (T for the title's, C for code) of a document's k-th line."""
    page, at = divmod(k, PAGE_LINES)
    return page, 780 - 15 * at - 40 * (at // GAP_EVERY), 24.0 if k == 0 else 11.0, "T" if k == 0 else "C" if k % CODE_EVERY == 0 else "N"


def literal(data: bytes) -> bytes:
    return b"(" + data.replace(b"\\", rb"\\").replace(b"(", rb"\(").replace(b")", rb"\)") + b")"


def pdf_bytes(lines: list[str], style: str) -> bytes:
    """A file with the lines; characters that one-byte fonts lack make it one of two-byte fonts."""
    try:
        "".join(lines).encode("cp1252")
        wide = style == "packed"
    except UnicodeEncodeError:
        wide = True
    codes = {c: i for i, c in enumerate(sorted(set("".join(lines))), 1)}
    table = {ord(c): i for c, i in codes.items()}
    coded = lambda s: b"<" + s.translate(table).encode("utf-16-be", "surrogatepass").hex().encode() + b">" if wide else literal(s.encode("cp1252"))
    pages: list[list[bytes]] = [[]]
    for k, line in enumerate(lines):
        page, y, size, font = layout_of(k)
        if page == len(pages):
            pages.append([])
        if style == "kerned":  # parts of the line with small steps between them, words without blanks
            shown = b"[" + b" -250 ".join(coded(w[:2]) + b" 30 " + coded(w[2:]) for w in line.split(" ")) + b"] TJ"
        else:
            shown = coded(line) + b" Tj"
        pages[page].append(b"BT /%s %.1f Tf 1 0 0 1 72 %.1f Tm %s ET" % (font.encode(), size, y, shown))

    objects: dict[int, tuple[bytes, bytes | None]] = {}  # number: (dictionary or value, stream)

    def stream(data: bytes, head: bytes = b"") -> tuple[bytes, bytes]:
        squeezed = zlib.compress(data) if style != "plain" else data
        return b"<<%s /Length %d%s>>" % (head, len(squeezed), b" /Filter /FlateDecode" if style != "plain" else b""), squeezed

    for i, base in enumerate((b"Times-Bold", b"Courier", b"Times-Roman")):
        if wide:
            objects[3 + i] = b"<</Type /Font /Subtype /Type0 /BaseFont /%s /Encoding /Identity-H /ToUnicode 7 0 R /DescendantFonts [<</Type /Font /Subtype /CIDFontType2 /BaseFont /%s /DW 500>>]>>" % (base, base), None
        else:
            objects[3 + i] = b"<</Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding /FirstChar 32 /Widths [%s]>>" % (base, b"500 " * 224), None
    rows = [b"<%s> <%s>" % (n.to_bytes(2).hex().encode(), c.encode("utf-16-be").hex().encode()) for c, n in codes.items()]
    objects[7] = stream(b"".join(b"%d beginbfchar\n%s\nendbfchar\n" % (len(rows[i : i + 100]), b"\n".join(rows[i : i + 100])) for i in range(0, len(rows), 100)))
    fonts, kids, number = b"/Font <</T 3 0 R /C 4 0 R /N 5 0 R>>", [], 8
    for content in pages:
        data, resources = b"\n".join(content), fonts
        if style == "form":  # the page shows a form that is drawn twice as large in half the scale
            objects[number + 2] = stream(data, b"/Type /XObject /Subtype /Form /Matrix [2 0 0 2 0 0] /Resources <<%s>>" % fonts)
            data, resources = b"q .5 0 0 .5 0 0 cm /F Do Q", b"/XObject <</F %d 0 R>>" % (number + 2)
        objects[number] = b"<</Type /Page /Parent 2 0 R /Contents %d 0 R /Resources <<%s>>>>" % (number + 1, resources), None
        objects[number + 1] = stream(data)
        kids.append(b"%d 0 R" % number)
        number += 3
    objects[1] = b"<</Type /Catalog /Pages 2 0 R>>", None
    objects[2] = b"<</Type /Pages /Count %d /MediaBox [0 0 595 842] /Kids [%s]>>" % (len(kids), b" ".join(kids)), None

    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}

    def put(n: int, head: bytes, data: bytes | None) -> None:
        places[n] = len(out)
        out.extend(b"%d 0 obj\n%s\n" % (n, head) + (b"stream\n" + data + b"\nendstream\n" if data is not None else b"") + b"endobj\n")

    if style == "packed":  # all but streams in an object stream, places in a cross-reference stream
        inner = [n for n in sorted(objects) if objects[n][1] is None]
        bodies, heads, at = [], [], 0
        for n in inner:
            heads.append(b"%d %d" % (n, at))
            bodies.append(objects[n][0])
            at += len(objects[n][0]) + 1
        head = b" ".join(heads) + b"\n"
        pack, cross = number, number + 1
        for n in sorted(objects):
            if objects[n][1] is not None:
                put(n, *objects[n])
        put(pack, *stream(head + b"\n".join(bodies), b"/Type /ObjStm /N %d /First %d" % (len(inner), len(head))))
        start = len(out)
        table = [(1, places[n], 0) if n in places else (2, pack, inner.index(n)) if n in inner else (0, 0, 0) for n in range(cross)] + [(1, start, 0)]
        raw = [a.to_bytes(1) + b.to_bytes(4) + c.to_bytes(2) for a, b, c in table]
        above, coded_rows = bytes(7), []  # each row as its difference to the one above
        for r in raw:
            coded_rows.append(b"\x02" + bytes((x - y) & 255 for x, y in zip(r, above, strict=True)))
            above = r
        put(cross, *stream(b"".join(coded_rows), b"/Type /XRef /Size %d /W [1 4 2] /Root 1 0 R /DecodeParms <</Predictor 12 /Columns 7>>" % (cross + 1)))
        return bytes(out) + b"startxref\n%d\n%%%%EOF\n" % start
    for n in sorted(objects):
        put(n, *objects[n])
    start = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, places[n]) for n in sorted(places))
    out += b"trailer\n<</Size %d /Root 1 0 R%s>>\n" % (number, b" /Encrypt 6 0 R" if style == "locked" else b"")
    out += b"startxref\n%d\n%%%%EOF\n" % (start if style != "lost" else 5)
    return bytes(out) if style != "cut" else bytes(out[9:])


def text_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, lines): each document's text in lines of LINE_CHARS characters."""
    flat = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x20]+", " "))
    cut = F.transform(F.regexp_extract_all("flat", F.lit(f"(?s).{{1,{LINE_CHARS}}}"), F.lit(0)), lambda x: F.trim(x))  # in one pass: a substring is counted from the text's start
    return documents.select("doc_id", flat.alias("flat")).select("doc_id", F.filter(cut, lambda x: x != "").alias("lines"))


def files(documents: DataFrame) -> DataFrame:
    """(path, content): a file for each document, its style by doc_id."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = [pdf_bytes(lines.as_py(), STYLES[i.as_py() % len(STYLES)]) for i, lines in zip(batch["doc_id"], batch["lines"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.string()), pa.array(made, pa.binary())], names=["path", "content"])

    return text_lines(documents).repartition("doc_id").mapInArrow(make, "path string, content binary")


LINES = rf"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, line FROM (
    SELECT doc_id, i, trim(substr(flat, i * {LINE_CHARS} + 1, {LINE_CHARS})) AS line FROM (
    SELECT doc_id, flat, unnest(range(0, length(flat) // {LINE_CHARS} + 1)) AS i FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\x00-\x20]+', ' ', 'g')) AS flat FROM documents WHERE doc_id % {len(STYLES)} NOT IN (5, 6)))) WHERE line <> ''"""


@register("q_pdf_lines", f"SELECT doc_id, (k // {PAGE_LINES})::INT AS page_num, (k % {PAGE_LINES})::INT AS line, line AS text, CASE WHEN k = 0 THEN 24.0 ELSE 11.0 END::DOUBLE AS font_size, CASE WHEN k = 0 THEN 'Times-Bold' WHEN k % {CODE_EVERY} = 0 THEN 'Courier' ELSE 'Times-Roman' END AS font_name, k = 0 AS is_bold FROM ({LINES})")
def _(spark, d):
    found = pdf.pdf_lines(pdf.pdf_runs(files(t(spark, d, "documents"))))
    return found.select(F.col("path").cast("long").alias("doc_id"), "page_num", "line", "text", "font_size", "font_name", "is_bold")


@register(
    "q_pdf_text",
    f"""WITH l AS (SELECT *, k // {PAGE_LINES} AS page, k % {PAGE_LINES} AS pos FROM ({LINES})),
     n AS (SELECT doc_id, max(page) + 1 AS pages FROM l GROUP BY doc_id),
     c AS (SELECT doc_id, page, sum(length(line)) AS chars, avg(CASE WHEN k = 0 THEN 24 ELSE 11 END) AS size FROM l GROUP BY ALL),
     r AS (SELECT c.*, pages, avg(CASE WHEN page IN (0, pages // 4, pages // 2, 3 * pages // 4, pages - 1) THEN chars END) OVER (PARTITION BY doc_id) <= 150 OR chars < 50 AS ocr FROM c JOIN n USING (doc_id)),
     m AS (SELECT l.doc_id, page, pos, ocr, line,
             CASE WHEN k % {CODE_EVERY} = 0 AND k > 0 THEN 'code' WHEN k = 0 AND 24 > size * 1.5 THEN 'title' WHEN k = 0 OR (upper(line) = line AND regexp_matches(line, '\\p{{L}}') AND len(regexp_extract_all(line, '[^ ]+')) <= 10) THEN 'heading' WHEN regexp_matches(line, '[∑∫√≤≥≠≈∞∂∇]') THEN 'equation' ELSE 'text' END AS kind FROM l JOIN r USING (doc_id, page)),
     s AS (SELECT *, CASE WHEN pos = 0 THEN '' WHEN kind <> 'text' OR lag(kind) OVER w <> 'text' OR pos % {GAP_EVERY} = 0 THEN chr(10) || chr(10) ELSE chr(10) END
             || CASE kind WHEN 'code' THEN '```' || chr(10) || line || chr(10) || '```' WHEN 'title' THEN '# ' || line WHEN 'heading' THEN '## ' || line WHEN 'equation' THEN '[EQUATION] ' || line ELSE line END AS part
           FROM m WINDOW w AS (PARTITION BY doc_id, page ORDER BY pos)),
     p AS (SELECT doc_id, page, ocr, string_agg(part, '' ORDER BY pos) AS md FROM s GROUP BY ALL),
     x AS (SELECT doc_id, string_agg(md, chr(10) || chr(10) ORDER BY page) FILTER (NOT ocr) AS text, count(*) AS pages, list(page ORDER BY page) FILTER (ocr) AS ocr_pages FROM p GROUP BY doc_id),
     -- short lines seen over five times are noise, and so are second blank lines
     y AS (SELECT doc_id, i, line, count(*) OVER (PARTITION BY doc_id, trim(line)) AS times FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM x)),
     z AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM y WHERE line = '' OR length(trim(line)) > 60 OR times <= 5),
     clean AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM z WHERE line <> '' OR coalesce(before, '') <> '' GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.doc_id % {len(STYLES)} IN (5, 6) THEN NULL ELSE md5(coalesce(clean.text, '')) END AS text_md5,
       CASE d.doc_id % {len(STYLES)} WHEN 5 THEN 'encrypted' WHEN 6 THEN 'no PDF' END AS error, CASE WHEN d.doc_id % {len(STYLES)} IN (5, 6) THEN 'failed' ELSE 'success' END AS status,
       CASE WHEN d.doc_id % {len(STYLES)} IN (5, 6) THEN 0 ELSE coalesce(pages, 1) END::INT AS page_count, CASE WHEN d.doc_id % {len(STYLES)} IN (5, 6) THEN '' WHEN pages IS NULL THEN '0' ELSE coalesce(array_to_string(ocr_pages, ','), '') END AS ocr_pages
FROM documents d LEFT JOIN x USING (doc_id) LEFT JOIN clean USING (doc_id)""",
)
def _(spark, d):
    found = pdf.pdf(files(t(spark, d, "documents")))
    return found.select(F.col("path").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"), "error", "status", "page_count", F.array_join("ocr_pages", ",").alias("ocr_pages"))
