"""Registered queries of workbooks, tools, nested cleaning and voices, with SQL."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup, records
from ..functions.text import nul_free
from ..operators import chunk, layout, profile, retrieve, tools
from ..sources import readers, sheets
from .office_files import made, relations, zipped
from .queries import SIM, register, t

SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def column_name(k: int) -> str:
    """A, B, .. Z, AA, .."""
    out = ""
    k += 1
    while k:
        k, rest = divmod(k - 1, 26)
        out = chr(65 + rest) + out
    return out


class Number(int):
    """A whole number that is no date, however large."""


def xlsx_bytes(book: list[tuple[str, list[list[str | float | None]]]]) -> bytes:
    """A workbook of (sheet, rows): texts shared or inline by turns, numbers plain, whole numbers of over 40,000 as dates unless each is a Number; empty cells aren't there."""
    from xml.sax.saxutils import escape, quoteattr

    strings: dict[str, int] = {}
    parts = {}
    for i, (_, rows) in enumerate(book):
        lines = []
        for r, row in enumerate(rows, 1):
            cells = []
            for k, x in enumerate(row):
                ref = f'r="{column_name(k)}{r}"'
                if isinstance(x, str) and (k + r) % 3:
                    cells.append(f'<c {ref} t="s"><v>{strings.setdefault(x, len(strings))}</v></c>')
                elif isinstance(x, str):
                    cells.append(f'<c {ref} t="inlineStr"><is><t xml:space="preserve">{escape(x)}</t></is></c>')
                elif x is not None:
                    cells.append(f'<c {ref} s="{int(isinstance(x, int) and not isinstance(x, Number) and x > 40_000)}"><v>{x!r}</v></c>')
            lines.append(f'<row r="{r}">{"".join(cells)}</row>')
        parts[f"xl/worksheets/sheet{i + 1}.xml"] = f"<worksheet {SHEET}><sheetData>{''.join(lines)}</sheetData></worksheet>"
    shared = "".join(f'<si><r><t xml:space="preserve">{escape(x[:2])}</t></r><r><t xml:space="preserve">{escape(x[2:])}</t></r><rPh><t>not said</t></rPh></si>' for x in strings)
    named = "".join(f'<sheet name={quoteattr(name)} sheetId="{i + 1}" r:id="s{i + 1}"/>' for i, (name, _) in enumerate(book))
    return zipped(parts | {
        "_rels/.rels": relations(("r1", "officeDocument", "xl/workbook.xml")),
        "xl/workbook.xml": f"<workbook {SHEET}><sheets>{named}</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": relations(*((f"s{i + 1}", "worksheet", f"worksheets/sheet{i + 1}.xml") for i in range(len(book))), ("t", "sharedStrings", "sharedStrings.xml"), ("u", "styles", "styles.xml")),
        "xl/sharedStrings.xml": f"<sst {SHEET}>{shared}</sst>",
        "xl/styles.xml": f'<styleSheet {SHEET}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>',
    })


def workbooks(spark, d) -> DataFrame:
    """(path, content): a workbook for each nation: its suppliers with balances, and the days that those fall on when read as dates."""
    rows = t(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("path"), "s_suppkey", "s_name", "s_acctbal")
    grouped = rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name", "s_acctbal"))).alias("rows"))

    def make(found: list[dict]) -> bytes:
        names = [["key", "name", "balance"], *([Number(r["s_suppkey"]), r["s_name"], r["s_acctbal"]] for r in found)]
        days = [["name", None, "day"], *([r["s_name"], None, 41_000 + r["s_suppkey"] % 4_000] for r in found)]
        return xlsx_bytes([("Suppliers", names), ("Days & more", days)])

    return made(grouped, make, "rows")


@register(
    "q_sheets",
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) + 1 AS row FROM supplier)
SELECT s_nationkey AS nation, 'Suppliers' AS sheet, row::INT AS row, s_suppkey || '|' || s_name || '|' || s_acctbal AS cells FROM s
UNION ALL SELECT s_nationkey, 'Days & more', row::INT, s_name || '||' || (DATE '1899-12-30' + (41000 + s_suppkey % 4000)::INT) FROM s
UNION ALL SELECT DISTINCT s_nationkey, 'Suppliers', 1, 'key|name|balance' FROM s UNION ALL SELECT DISTINCT s_nationkey, 'Days & more', 1, 'name||day' FROM s""",
)
def _(spark, d):
    found = sheets.sheet_rows(workbooks(spark, d)).filter("error IS NULL")
    return found.select(F.col("path").cast("int").alias("nation"), "sheet", "row", F.array_join(F.transform("cells", lambda x: F.coalesce(x, F.lit(""))), "|").alias("cells"))


@register("q_sheet_summaries", "SELECT s_nationkey AS nation, sheet_index, count(*) AS n_rows, 3 AS n_columns, sum(CASE WHEN place <= 5 OR place > total - 5 THEN 1 ELSE 0 END)::BIGINT AS n_shown FROM (SELECT s_nationkey, row_number() OVER w AS place, count(*) OVER (PARTITION BY s_nationkey) AS total FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)), (SELECT unnest([0, 1]) AS sheet_index) GROUP BY ALL")
def _(spark, d):
    found = sheets.sheet_summaries(sheets.sheet_rows(workbooks(spark, d)))
    lines = F.array_union(F.split(F.split("text", r"first rows\):\n")[1], "\n"), F.split(F.split("text", r"last rows\):\n")[1], "\n"))
    shown = F.size(F.filter(lines, lambda x: x.contains(" | "))).cast("long")
    return found.select(F.col("path").cast("int").alias("nation"), "sheet_index", "n_rows", "n_columns", shown.alias("n_shown"))


@register("q_nul_free_nested", "SELECT conv_id, turn, role AS inner_role, text AS inner_text, [role, text] AS both FROM conversations")
def _(spark, d):
    dirty = lambda c: F.concat(F.lit("\u0000"), c, F.lit("\u0000"))
    c = t(spark, d, "conversations")
    nested = F.struct(dirty("role").alias("role"), F.array(F.create_map(F.lit("k"), dirty("text"))).alias("maps"), F.col("turn").alias("n"))
    clean = nul_free(c.select("conv_id", "turn", nested.alias("nested"), F.array(dirty("role"), dirty("text")).alias("both")))
    return clean.select("conv_id", "turn", F.col("nested.role").alias("inner_role"), F.col("nested.maps")[0]["k"].alias("inner_text"), "both")


@register("q_default_voices", "SELECT doc_id, CASE lang WHEN 'es' THEN CASE WHEN doc_id % 2 = 0 THEN 'es-ES-AlvaroNeural' ELSE 'es-ES-ElviraNeural' END WHEN 'fr' THEN CASE WHEN doc_id % 2 = 0 THEN 'fr-FR-HenriNeural' ELSE 'fr-FR-DeniseNeural' END WHEN 'de' THEN CASE WHEN doc_id % 2 = 0 THEN 'de-DE-ConradNeural' ELSE 'de-DE-KatjaNeural' END ELSE CASE WHEN doc_id % 2 = 0 THEN 'en-US-GuyNeural' ELSE 'en-US-JennyNeural' END END AS voice, CASE lang WHEN 'es' THEN 'Spanish' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'en' THEN 'English' ELSE lang END AS language FROM documents")
def _(spark, d):
    rows = t(spark, d, "documents")
    speaker = F.when(F.col("doc_id") % 2 == 0, "Host").otherwise("guest")
    return rows.select("doc_id", records.voice(F.col("lang"), speaker).alias("voice"), records.language_name(F.col("lang")).alias("language"))


@register(
    "q_tools",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'rag_tool' WHEN 'click' THEN CASE WHEN event_id % 3 = 1 THEN 'flashcard_tool' ELSE 'quiz_tool' END ELSE 'python_tool' END AS tool,
              CASE event_type WHEN 'view' THEN 'answered' WHEN 'click' THEN 'made ' || event_id % 3 ELSE 'ran' END AS result FROM events WHERE event_type IN ('view', 'click', 'purchase', 'error')""",
)
def _(spark, d):
    known = tools.Tools()
    known.register("rag_tool", "Answers from the materials", "QUESTION")(lambda rows: rows.select("event_id", F.lit("answered").alias("result")))
    known.register("quiz_tool", "Makes a quiz", "CONTENT_GENERATION")(lambda rows: rows.select("event_id", F.concat(F.lit("made "), F.col("event_id") % 3).alias("result")))
    known.register("flashcard_tool", "Makes cards", "CONTENT_GENERATION")(lambda rows: rows.select("event_id", F.concat(F.lit("made "), F.col("event_id") % 3).alias("result")))
    known.register("python_tool", "Analyses data", "DATA_ANALYSIS", "CODE_EXECUTION")(lambda rows: rows.select("event_id", F.lit("ran").alias("result")))
    kind, rows = F.col("event_type"), t(spark, d, "events")
    intent = F.when(kind == "view", "QUESTION").when(kind == "click", "CONTENT_GENERATION").when(kind == "purchase", "DATA_ANALYSIS").when(kind == "error", "CODE_EXECUTION").otherwise("CHAT")
    wanted = F.when(F.col("event_id") % 3 == 1, "flashcard_tool").when(F.col("event_id") % 3 == 2, "no_such_tool")
    return known.run(rows, intent, wanted).select("event_id", "tool", "result")


@register(
    "q_structured_chunks",
    """WITH d AS (SELECT doc_id, length(text) AS n, regexp_replace(text, '[=\\n\\r]', ' ', 'g') AS x FROM documents),
     p AS (SELECT doc_id, unnest([0, 1, 2]) AS k, n, x FROM d)
SELECT doc_id, k::INT AS part, CASE k WHEN 0 THEN 'Columns: a, b' ELSE 'Part ' || k || ' of the table' END AS title, md5(CASE k WHEN 0 THEN 'Columns: a, b' || chr(10) || 'of document number ' || doc_id || '.' ELSE 'Columns: a, b' || chr(10) || chr(10) || 'Part ' || k || ' of the table' || chr(10) || 'row ' || k || ' has so many characters: ' || n END) AS text_md5 FROM p""",
)
def _(spark, d):
    rows = t(spark, d, "documents")
    part = lambda k: F.concat(F.lit(f"\n=====\nPart {k} of the table\nrow {k} has so many characters: "), F.length("text").cast("string"), F.lit("\n"))
    text = F.concat(F.lit("\nColumns: a, b\nof document number "), F.col("doc_id").cast("string"), F.lit("."), part(1), part(2), F.lit("===\nshort"))
    return rows.select("doc_id", F.posexplode(chunk.structured_chunks(text)).alias("part", "c")).select("doc_id", "part", "c.title", F.md5("c.text").alias("text_md5"))


@register("q_fixed_width", "SELECT s_suppkey, 'suppliers' AS label, s_name AS name, s_acctbal::VARCHAR AS balance FROM supplier")
def _(spark, d):
    rows = t(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").cast("string").alias("balance"))
    width = 30
    text = F.concat(F.lit("=== suppliers ===\n"), F.rpad(F.lit("Full Name"), width, " "), F.lit("Balance\n"), F.rpad("s_name", width, " "), "balance", F.lit("\n"))
    found = rows.select("s_suppkey", markup.fixed_width_tables(text)[0].alias("t"))
    return found.select("s_suppkey", F.col("t.label").alias("label"), F.col("t.rows")[0][0].alias("name"), F.col("t.rows")[0][1].alias("balance"))


@register("q_organic_results", "SELECT page_id, 0 AS pos, url AS link, '' AS snippet FROM pages UNION ALL SELECT page_id, 1, '', 'about ' || page_id FROM pages WHERE page_id % 2 = 0")
def _(spark, d):
    p = t(spark, d, "pages").select("page_id", "url")
    first, second = F.struct(F.lit("t").alias("title"), F.col("url").alias("link")), F.struct(F.lit("u").alias("title"), F.concat(F.lit("about "), "page_id").alias("snippet"))
    answer = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('{"organic_results": ['), F.to_json(first), F.lit(","), F.to_json(second), F.lit("]}"))).otherwise(F.concat(F.lit('{"organic_results": ['), F.to_json(first), F.lit("]}")))
    return p.select("page_id", F.posexplode(records.organic_results(answer)).alias("pos", "r")).select("page_id", "pos", "r.link", "r.snippet")


@register("q_structured_calls", "SELECT conv_id, turn, CASE WHEN length(text) % 3 = 2 THEN NULL ELSE length(text) END AS size FROM conversations")
def _(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("size of: "), "text").alias("prompt"))

    def model(prompts):  # answers some at once, some when told to mind the form, some never
        def one(x: str) -> str:
            again = x.endswith("\nAnswer with valid JSON only.")
            n = len(x) - 9 - again * len("\nAnswer with valid JSON only.")
            return f'{{"size": {n}}}' if n % 3 == 0 or (again and n % 3 == 1) else "It is long."

        return prompts.map(one)

    parsed = lambda c: F.from_json(F.when(c.startswith("{"), c), "size long")
    return readers.structured_call(rows, model, "prompt", parsed).select("conv_id", "turn", "parsed.size")


# the greedy choice, one pick a step: the candidate of greatest half relevance less half likeness to what is chosen
@register("q_mmr_others", f"""WITH RECURSIVE e AS (SELECT vec_id, embedding FROM embeddings),
     c AS (SELECT * FROM (SELECT q.vec_id AS query_id, e.vec_id, e.embedding, {SIM} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {SIM} DESC, e.vec_id) AS rank FROM e, (SELECT vec_id, embedding FROM e WHERE vec_id % 20 = 0) q WHERE e.vec_id <> q.vec_id) WHERE rank <= 30),
     p AS (SELECT a.query_id, a.rank AS i, b.rank AS j, a.s AS relevance, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS alike FROM c a JOIN c b USING (query_id)),
     chosen AS (SELECT query_id, 1 AS pick, 1::BIGINT AS latest, [1::BIGINT] AS taken FROM c WHERE rank = 1
                UNION ALL
                SELECT query_id, pick + 1, latest, list_append(taken, latest) FROM (
                  SELECT query_id, pick, taken, arg_min(i, (-value, i)) AS latest FROM (
                    SELECT h.query_id, h.pick, h.taken, p.i, 0.5 * any_value(p.relevance) - 0.5 * max(p.alike) AS value
                    FROM chosen h JOIN p ON p.query_id = h.query_id AND list_contains(h.taken, p.j) AND NOT list_contains(h.taken, p.i) WHERE h.pick < 8 GROUP BY h.query_id, h.pick, h.taken, p.i)
                  GROUP BY query_id, pick, taken))
SELECT query_id, pick::INT AS pick, vec_id FROM chosen JOIN c USING (query_id) WHERE c.rank = latest""")
def _(spark, d):
    # without the query's own vector, beside which all others would be alike
    v = t(spark, d, "embeddings")
    asked = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    near = retrieve.top_k_of(asked, v, 31, whole=True).filter("vec_id <> query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter("rank <= 30")
    return retrieve.mmr(near, 8).select("query_id", "pick", "vec_id")


@register("q_csv_tables", "SELECT s_suppkey, s_name, s_nationkey::VARCHAR AS nation FROM supplier")
def _(spark, d):
    rows = t(spark, d, "supplier").select(F.concat(F.col("s_nationkey").cast("string"), F.when(F.col("s_nationkey") % 2 == 0, ".csv").otherwise(".tsv")).alias("path"), "s_suppkey", "s_name")
    separator = F.when(F.col("path").endswith(".csv"), ";").otherwise("\t")
    line = F.concat(F.col("s_suppkey").cast("string"), separator, F.lit('"'), "s_name", F.lit('"'))
    texts = rows.withColumn("line", line).groupBy("path").agg(F.concat(F.lit("key"), F.first(separator), F.lit("name\n"), F.array_join(F.sort_array(F.collect_list("line")), "\n")).alias("text"))
    found = sheets.sheet_rows(texts.select("path", F.encode("text", "UTF-8").alias("content"))).filter("row > 1")
    return found.select(F.col("cells")[0].cast("long").alias("s_suppkey"), F.col("cells")[1].alias("s_name"), F.substring_index("path", ".", 1).alias("nation"))


@register(
    "q_dataset_summary",
    """SELECT 'nation' || chr(10) || 'Shape: ' || count(*) || ' rows x 2 columns' || chr(10) || 'Columns: n_name, n_regionkey' || chr(10) || 'Types: n_name=string, n_regionkey=int' || chr(10) || chr(10)
       || 'Statistics:' || chr(10) || 'n_name count: ' || count(n_name) || chr(10) || 'n_name freq: 1' || chr(10) || 'n_name top: ' || min(n_name) || chr(10) || 'n_name unique: ' || count(DISTINCT n_name) AS head,
       (SELECT string_agg(n_name || ' | ' || n_regionkey, chr(10) ORDER BY n_name) FROM (SELECT * FROM nation ORDER BY n_name LIMIT 5)) AS first, (SELECT string_agg(n_name || ' | ' || n_regionkey, chr(10) ORDER BY n_name) FROM (SELECT * FROM nation ORDER BY n_name DESC LIMIT 5)) AS last FROM nation""",
)
def _(spark, d):
    text = profile.summary_text(spark, t(spark, d, "nation").select("n_name", "n_regionkey"), "nation", ["n_name"], full=True).select("summary")
    parts = F.split("summary", r"\n\nSample \((?:first|last) 5 rows\):\n")
    return text.select(F.split(parts[0], "\nn_regionkey ")[0].alias("head"), parts[1].alias("first"), parts[2].alias("last"))


@register("q_youtube_ids", "SELECT page_id, CASE page_id % 5 WHEN 4 THEN NULL ELSE substr(md5(url), 1, 10) || '_' END AS video FROM pages")
def _(spark, d):
    p = t(spark, d, "pages").select("page_id", F.concat(F.substring(F.md5("url"), 1, 10), F.lit("_")).alias("id"))
    forms = ("https://www.youtube.com/watch?list=x&v=", "https://youtu.be/", "https://youtube.com/embed/", "https://m.youtube.com/shorts/", "https://example.org/")
    url = F.concat(F.element_at(F.array(*map(F.lit, forms)), (F.col("page_id") % 5 + 1).cast("int")), "id", F.lit("?t=3"))
    return p.select("page_id", records.youtube_id(url).alias("video"))


# ---- injected models: stubs that Spark runs where a user's models would run --------------------------------------------------
@register(
    "q_ocr_pages",
    r"""SELECT conv_id, turn, coalesce(string_agg(word, ' ' ORDER BY k) FILTER (k % 10 <> 9), '') AS text, round(avg(CASE WHEN k % 10 <> 9 THEN 0.5 + (k % 5) / 10 END) * 100, 6) AS confidence
        FROM (SELECT conv_id, turn, unnest(w) AS word, unnest(range(0, len(w))) AS k FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^\x00-\x20\x7F-\xA0]+') AS w FROM conversations)) GROUP BY conv_id, turn""",
)
def _(spark, d):
    def detector(texts: pd.Series) -> pd.Series:  # a stub: words of an image's caption side by side on one line, every tenth unsure
        return texts.map(lambda x: json.dumps([{"y": 0, "x": k, "bottom": 9, "text": w, "conf": 0.1 if k % 10 == 9 else 0.5 + k % 5 / 10} for k, w in enumerate(re.findall(r"[^\x00-\x20\x7f-\xa0]+", x or ""))]))

    images = t(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("page"), "text")
    found = readers.with_model(images, "found", "string", detector, "text")
    boxes = found.select("page", F.lit(100).alias("page_height"), F.inline(F.from_json("found", "array<struct<y:int,x:int,bottom:int,text:string,conf:double>>")))
    lines = layout.text_lines(boxes, tasks=layout.tasks_of(images, 10_000)).select("page", "text")  # an image has some 85 words
    sure = layout.confident(boxes, ["page"])
    at = F.split("page", "-")
    return lines.join(sure, "page").select(at[0].cast("long").alias("conv_id"), at[1].cast("long").alias("turn"), "text", F.round("confidence", 6).alias("confidence"))


@register("q_embedded_search", "SELECT query_id, doc_id, rank::INT AS rank FROM (SELECT q.doc_id AS query_id, d.doc_id, row_number() OVER (PARTITION BY q.doc_id ORDER BY list_cosine_similarity(d.e, q.e) DESC, d.doc_id) AS rank FROM (SELECT doc_id, [length(text), len(string_split(text, 'e')) * 7, len(string_split(text, ' ')) * 3, 1 + doc_id % 13]::DOUBLE[] AS e FROM documents) d, (SELECT doc_id, [length(text), len(string_split(text, 'e')) * 7, len(string_split(text, ' ')) * 3, 1 + doc_id % 13]::DOUBLE[] AS e FROM documents WHERE doc_id % 20 = 0) q) WHERE rank <= 5")
def _(spark, d):
    def embed(texts: pd.Series) -> pd.Series:  # a stub that counts characters, letters e, blanks, and the number before the text
        return texts.map(lambda x: [float(len(x) - x.index(":") - 1), 7.0 * (x.count("e") + 1), 3.0 * (x.count(" ") + 1), 1.0 + int(x[: x.index(":")]) % 13])

    named = t(spark, d, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text").alias("named"))
    rows = readers.with_model(named, "embedding", "array<double>", embed, "named").select("doc_id", "embedding")
    asked = rows.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieve.top_k_of(asked, rows, 5, key="doc_id").select("query_id", "doc_id", "rank")
