"""Office files, mails and RTF made from the given tables, and the queries that read them."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markup import heading_sections
from ..sources import readers
from ..sources.compound import END, FREE, SIGNATURE
from ..sources.rtf import rtf_bytes
from .file_queries import work_folder
from .pdf_files import pdf_bytes, text_lines
from .queries import register, t

#: Shorter parts of a zipped file are stored as they are.
SHORT = 1000
WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DRAW = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text, zipfile.ZIP_STORED if len(text) < SHORT else None)
    return out.getvalue()


def relations(*items: tuple[str, str, str]) -> str:
    inner = "".join(f'<Relationship Id="{i}" Type="{OFFICE}/{kind}" Target="{target}"/>' for i, kind, target in items)
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>'


def docx_bytes(blocks: list[tuple[str, int, str]]) -> bytes:
    """A Word file of (kind, level, text): h headings, p paragraphs, b bullets, n numbered items, t rows of a table with cells between |.

    Headings have a style that inherits its outline level; bullets a style with the numbering, numbered items their own.
    """
    text = lambda x: f'<w:r><w:t xml:space="preserve">{escape(x[: len(x) // 2])}</w:t></w:r><w:r><w:t xml:space="preserve">{escape(x[len(x) // 2 :])}</w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del>'
    body, rows = [], []
    for kind, level, x in [*blocks, ("", 0, "")]:
        if rows and kind != "t":
            body.append("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p>{text(c)}</w:p></w:tc>" for c in r.split("|")) + "</w:tr>" for r in rows) + "</w:tbl>")
            rows = []
        if kind == "t":
            rows.append(x)
        elif kind == "h":
            body.append(f'<w:p><w:pPr><w:pStyle w:val="Sub{level}"/></w:pPr>{text(x)}</w:p>')
        elif kind == "b":
            body.append(f'<w:p><w:pPr><w:pStyle w:val="Bullets"/><w:numPr><w:ilvl w:val="{level}"/></w:numPr></w:pPr>{text(x)}</w:p>')
        elif kind == "n":
            body.append(f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="2"/></w:numPr></w:pPr>{text(x)}</w:p>')
        elif kind == "p":
            body.append(f"<w:p>{text(x)}</w:p>")
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="H{k}"><w:name w:val="own {k}"/><w:basedOn w:val="Normal"/><w:pPr><w:outlineLvl w:val="{k - 1}"/></w:pPr></w:style><w:style w:type="paragraph" w:styleId="Sub{k}"><w:name w:val="sub {k}"/><w:basedOn w:val="H{k}"/></w:style>' for k in (1, 2, 3))
    styles += '<w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style><w:style w:type="paragraph" w:styleId="Bullets"><w:name w:val="List Bullet"/><w:pPr><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr></w:style>'
    levels = lambda kind: "".join(f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/><w:numFmt w:val="{kind}"/></w:lvl>' for k in range(3))
    numbering = f'<w:abstractNum w:abstractNumId="10">{levels("bullet")}</w:abstractNum><w:abstractNum w:abstractNumId="11">{levels("decimal")}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="10"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="11"/></w:num>'
    return zipped({
        "_rels/.rels": relations(("r1", "officeDocument", "word/document.xml")),
        "word/_rels/document.xml.rels": relations(("r1", "styles", "styles.xml"), ("r2", "numbering", "numbering.xml")),
        "word/document.xml": f"<w:document {WORD}><w:body>{''.join(body)}</w:body></w:document>",
        "word/styles.xml": f"<w:styles {WORD}>{styles}</w:styles>",
        "word/numbering.xml": f"<w:numbering {WORD}>{numbering}</w:numbering>",
    })


def pptx_bytes(slides: list[tuple[str, list[str]]]) -> bytes:
    """A presentation of (title, items); slide files are numbered against their order, the body's kind stands in the layout."""
    names = [f"slide{len(slides) - k}.xml" for k in range(len(slides))]
    parts = {
        "_rels/.rels": relations(("r1", "officeDocument", "ppt/presentation.xml")),
        "ppt/presentation.xml": f"<p:presentation {DRAW}><p:sldIdLst>" + "".join(f'<p:sldId id="{256 + k}" r:id="s{k}"/>' for k in range(len(slides))) + "</p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": relations(*((f"s{k}", "slide", f"slides/{n}") for k, n in enumerate(names))),
        "ppt/slideLayouts/layout1.xml": f'<p:sldLayout {DRAW}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type="title" idx="0"/></p:nvPr></p:nvSpPr></p:sp><p:sp><p:nvSpPr><p:nvPr><p:ph type="body" idx="7"/></p:nvPr></p:nvSpPr></p:sp></p:spTree></p:cSld></p:sldLayout>',
    }
    for (title, items), name in zip(slides, names, strict=True):
        shape = lambda holder, texts: f"<p:sp><p:nvSpPr><p:nvPr><p:ph {holder}/></p:nvPr></p:nvSpPr><p:txBody>" + "".join(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>" for x in texts) + "</p:txBody></p:sp>"
        parts[f"ppt/slides/{name}"] = f"<p:sld {DRAW}><p:cSld><p:spTree>{shape('idx="0"', [title])}<p:grpSp>{shape('idx="7"', items)}</p:grpSp>{shape('type="sldNum" idx="9"', ['9'])}</p:spTree></p:cSld></p:sld>"
        parts[f"ppt/slides/_rels/{name}.rels"] = relations(("r1", "slideLayout", "../slideLayouts/layout1.xml"))
    return zipped(parts)


def msg_bytes(subject: str, name: str, mail: str, body: str) -> bytes:
    """A message as a compound file: short streams in the mini stream, long ones in sectors, texts in UTF-16."""
    wide = lambda x: x.encode("utf-16-le", "surrogatepass")
    streams = {"__properties_version1.0": bytes(32) + struct.pack("<IIQ", 0x00390040, 6, 133_500_000_000_000_000)}
    streams |= {f"__substg1.0_{k}001F": wide(x) for k, x in (("0037", subject), ("0C1A", name), ("0C1F", mail), ("1000", body))}
    sectors: list[bytes] = []
    table: list[int] = []

    def put(data: bytes) -> int:
        first, n = len(sectors), -(-len(data) // 512)
        for k in range(n):
            sectors.append(data[512 * k : 512 * (k + 1)].ljust(512, b"\0"))
            table.append(first + k + 1 if k + 1 < n else END)
        return first if n else END

    mini, mini_table, places = b"", [], {}
    for path, data in streams.items():
        if len(data) < 4096:
            n = -(-len(data) // 64)
            places[path] = len(mini_table) if n else END
            mini_table += [*range(len(mini_table) + 1, len(mini_table) + n), END] if n else []
            mini += data.ljust(64 * n, b"\0")
        else:
            places[path] = put(data)
    entry = lambda name, kind, below, start, size, right=FREE: wide(name).ljust(64, b"\0") + struct.pack("<HBBIII", 2 * len(name) + 2, kind, 1, FREE, right, below) + bytes(36) + struct.pack("<IQ", start, size)
    root_start = put(mini)
    names = list(streams)
    directory = entry("Root Entry", 5, 1, root_start, len(mini)) + b"".join(entry(x, 2, FREE, places[x], len(streams[x]), k + 2 if k + 1 < len(names) else FREE) for k, x in enumerate(names))
    directory_start = put(directory)
    mini_start = put(struct.pack(f"<{len(mini_table)}I", *mini_table))
    n_fat = 1
    while n_fat * 128 < len(sectors) + n_fat:
        n_fat += 1
    fat_at = len(sectors)
    fat = [*table, *[0xFFFFFFFD] * n_fat]
    fat += [FREE] * (n_fat * 128 - len(fat))
    head = SIGNATURE + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, n_fat, directory_start, 0, 4096, mini_start, -(-len(mini_table) // 128), END, 0)
    head += struct.pack("<109I", *[fat_at + k if k < n_fat else FREE for k in range(109)])
    return head + b"".join(sectors) + struct.pack(f"<{len(fat)}I", *fat)


def made(rows: DataFrame, make: Callable[..., bytes], *columns: str) -> DataFrame:
    """(path, content): a file of each row's columns; its path is in the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in readers.sliced(batches):
            cells = [batch[c].to_pylist() for c in columns]
            content = [make(*r) for r in zip(*cells, strict=True)] if len(batch) else []
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(content, pa.binary())], names=["path", "content"])

    return rows.select("path", *columns).mapInArrow(run, "path string, content binary")


SOUND = r"trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13))"


@register("q_rtf_texts", f"SELECT doc_id, md5({SOUND}) AS text_md5, CASE WHEN {SOUND} = '' THEN 'failed' ELSE 'success' END AS status FROM documents")
def _(spark, d):
    rows = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    found = readers.rtf(made(rows, rtf_bytes, "text"))
    return found.select(F.col("path").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "status")


KINDS = "CASE k % 8 WHEN 0 THEN 'h' WHEN 3 THEN 'b' WHEN 4 THEN 'b' WHEN 5 THEN 'n' WHEN 6 THEN 'n' WHEN 7 THEN 't' ELSE 'p' END"
LINE_ROWS = r"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, line FROM (SELECT doc_id, i, trim(translate(substr(flat, i * 60 + 1, 60), '|#', '/+')) AS line FROM (
    SELECT doc_id, flat, unnest(range(0, length(flat) // 60 + 1)) AS i FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\x00-\x20\x7F-\xA0\x{1680}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}\x{3000}\x{FEFF}\x{FFFE}\x{FFFF}]+', ' ', 'g')) AS flat FROM documents))) WHERE line <> ''"""


def clean_lines(documents: DataFrame) -> DataFrame:
    """(path, lines), each line's white space and control characters as single blanks."""
    flat = documents.withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x20\x7F-\xA0\x{1680}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}\x{3000}\x{FEFF}\x{FFFE}\x{FFFF}]+", " "))
    lines = text_lines(flat).withColumn("lines", F.transform("lines", lambda x: F.translate(x, "|#", "/+")))
    return lines.select(F.col("doc_id").cast("string").alias("path"), "lines").repartition("path")  # what is made of them takes far longer than the scan, whose splits are few


def docx_of(lines: list[str]) -> bytes:
    kinds = {0: "h", 3: "b", 4: "b", 5: "n", 6: "n", 7: "t"}
    return docx_bytes([(kinds.get(k % 8, "p"), 1 + k // 8 % 3 if k % 8 == 0 else int(k % 8 in (4, 6)), x) for k, x in enumerate(lines)])


@register(
    "q_docx_sections",
    f"""WITH l AS (SELECT doc_id, k, k // 8 AS section, {KINDS} AS kind, line FROM ({LINE_ROWS})),
     -- each heading's section: two paragraphs, two bullets, two numbered items, a table of one row
     n AS (SELECT *, CASE k % 8 WHEN 5 THEN section + 1 ELSE 1 END AS number FROM l),
     s AS (SELECT doc_id, section, k, kind, CASE kind WHEN 'h' THEN NULL WHEN 'b' THEN CASE k % 8 WHEN 4 THEN '  - ' ELSE '- ' END || line WHEN 'n' THEN CASE k % 8 WHEN 6 THEN '  ' ELSE '' END || number || '. ' || line WHEN 't' THEN '| ' || line || ' |' || chr(10) || '|---|' ELSE line END AS said,
             CASE WHEN k % 8 = 1 THEN '' WHEN kind IN ('b', 'n') AND k % 8 > 3 THEN chr(10) ELSE chr(10) || chr(10) END AS joint FROM n)
SELECT doc_id, section::INT AS section, max(length(line)) FILTER (kind = 'h') AS title_chars, (section % 3 + 1)::INT AS level, md5(coalesce(string_agg(joint || said, '' ORDER BY k), '')) AS body_md5
FROM s JOIN n USING (doc_id, section, k, kind) GROUP BY doc_id, section""",
)
def _(spark, d):
    files = made(clean_lines(t(spark, d, "documents")), docx_of, "lines")
    found = readers.file_texts(files, {"docx": readers.READERS["docx"]}).filter("status = 'success'")
    parts = found.select("path", F.posexplode(F.split("text", r"\n\n(?=#{1,3} )")).alias("section", "part"))
    head = F.substring_index("part", "\n", 1)
    body = F.when(F.contains("part", F.lit("\n")), F.substr("part", F.length(head) + 3)).otherwise(F.lit(""))
    level = F.length(F.regexp_extract(head, "^#+", 0))
    return parts.select(F.col("path").cast("long").alias("doc_id"), "section", (F.length(head) - level - 1).cast("long").alias("title_chars"), level.alias("level"), F.md5(body).alias("body_md5"))


@register(
    "q_docx_headings",
    f"SELECT doc_id, count(*)::INT AS n_sections FROM ({LINE_ROWS}) WHERE k % 8 = 0 GROUP BY doc_id",
)
def _(spark, d):
    # the Markdown is split again by the splitter that chunks texts
    files = made(clean_lines(t(spark, d, "documents")), docx_of, "lines")
    found = readers.file_texts(files, {"docx": readers.READERS["docx"]}).filter("status = 'success'")
    heads = F.filter(heading_sections(F.col("text")), lambda s: F.coalesce(s["title"], F.lit("")) != "")
    return found.select(F.col("path").cast("long").alias("doc_id"), F.size(heads).alias("n_sections"))


@register(
    "q_pptx_slides",
    f"""WITH l AS (SELECT doc_id, k // 5 AS slide, k % 5 AS pos, line FROM ({LINE_ROWS})),
     s AS (SELECT doc_id, slide, string_agg(CASE WHEN pos = 0 THEN '# ' || line ELSE '- ' || line END, chr(10) ORDER BY pos) AS said FROM l GROUP BY ALL)
SELECT doc_id, count(*)::INT AS n_slides, md5(string_agg('--- Slide ' || (slide + 1) || ' ---' || chr(10) || chr(10) || said, chr(10) || chr(10) ORDER BY slide)) AS text_md5 FROM s GROUP BY doc_id""",
)
def _(spark, d):
    make = lambda lines: pptx_bytes([(lines[i], lines[i + 1 : i + 5]) for i in range(0, len(lines), 5)])
    found = readers.file_texts(made(clean_lines(t(spark, d, "documents")), make, "lines"), {"pptx": readers.READERS["pptx"]}).filter("status = 'success'")
    return found.select(F.col("path").cast("long").alias("doc_id"), F.regexp_count("text", F.lit(r"(?m)^--- Slide \d+ ---$")).alias("n_slides"), F.md5("text").alias("text_md5"))


@register(
    "q_msg_mails",
    """SELECT conv_id, turn, 'Subject: ' || role || chr(10) || 'From: ' || role || ' <' || role || '@example.org>' || chr(10) || 'Date: ' || strftime(epoch_ms(13350000000000 - 11644473600000), '%Y-%m-%d %H:%M:%S') AS head, md5(trim(replace(text, chr(13) || chr(10), chr(10)), ' ' || chr(9) || chr(10) || chr(13))) AS body_md5 FROM conversations""",
)
def _(spark, d):
    rows = t(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("path"), "role", "text")
    make = lambda role, text: msg_bytes(role, role, f"{role}@example.org", text or "")
    found = readers.file_texts(made(rows, make, "role", "text"), {"msg": readers.READERS["msg"]})
    parts = F.split("text", "\n\n", 2)
    return found.select(F.split("path", "-")[0].cast("long").alias("conv_id"), F.split("path", "-")[1].cast("long").alias("turn"), parts[0].alias("head"), F.md5(parts[1]).alias("body_md5"))


@register(
    "q_registry",
    f"""WITH l AS (SELECT doc_id, count(k) AS n FROM documents LEFT JOIN ({LINE_ROWS}) USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'docx' WHEN 1 THEN 'pptx' WHEN 2 THEN 'rtf' WHEN 3 THEN 'pdf' ELSE 'bin' END AS kind, CASE WHEN doc_id % 5 = 4 THEN 'unsupported type' WHEN n = 0 AND doc_id % 5 <> 3 THEN 'no text' END AS error FROM l""",
)
def _(spark, d):
    rows = clean_lines(t(spark, d, "documents")).withColumn("kind", F.element_at(F.array(*map(F.lit, ("docx", "pptx", "rtf", "pdf", "bin"))), (F.col("path").cast("int") % 5 + 1)))

    def make(lines: list[str], kind: str) -> bytes:
        texts = {"docx": docx_of, "pptx": lambda x: pptx_bytes([(y, []) for y in x]), "rtf": lambda x: rtf_bytes("\n".join(x)), "pdf": lambda x: pdf_bytes(x, "packed"), "bin": lambda x: bytes(8)}
        return texts[kind](lines)

    # made once and stored, since the registry reads the files for each of its extractors
    store = f"{work_folder(spark)}/files"
    made(rows.withColumn("path", F.concat("path", F.lit("."), "kind")), make, "lines", "kind").write.parquet(store)
    found = readers.Registry().extract(spark.read.schema("path string, content binary").parquet(store))
    name = F.split("path", r"\.")
    return found.select(name[0].cast("long").alias("doc_id"), name[1].alias("kind"), "error")
