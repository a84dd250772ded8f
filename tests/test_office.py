"""RTF, Word, PowerPoint and Outlook files put together by hand; the registry's one pass."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from docloom.plans import office_files
from docloom.functions import records
from docloom.plans.office_files import DRAW, WORD, docx_bytes, msg_bytes, pptx_bytes, relations, zipped
from docloom.sources import readers
from docloom.sources.compound import Compound, msg_text
from docloom.sources.ooxml import docx_text, pptx_text
from docloom.sources.rtf import rtf_bytes, rtf_text


# ---- RTF
@pytest.mark.parametrize(
    "raw, text",
    [
        (rb"{\rtf1\ansi{\fonttbl{\f0 Times New Roman;}}{\info{\author Bob}}\f0 Caf\'e9 and \u8364? euro}", "Café and € euro"),
        (rb"{\rtf1 a{\*\unknown {deep} gone}b{\b c}d\par\pard e\line f\tab g}", "abcd\ne\nf\tg"),
        (rb"{\rtf1\uc0 \u233 x{\uc2\u233 ??y}\u233 z}", "éxéyéz"),
        (rb"{\rtf1 \u-10179?\u-8704? and \u-10179? alone}", "\U0001f600 and � alone"),
        (rb"{\rtf1\ansicpg1251 \'cf\'f0\'e8 }", "При"),
        (rb"{\rtf1{\fonttbl{\f0\fcharset0 A;}{\f1\fcharset128 B;}}\f0 \'e9\f1 \'93\'fa\'96\'7b\f0 \'e9}", "é日本é"),
        (rb"{\rtf1 x\{y\}\\z\~w\-v\_u}", "x{y}\\z\xa0wv‑u"),
        (rb"{\rtf1 a\bin4 }{\\b}", "ab"),
        (rb"{\rtf1 {\field{\*\fldinst HYPERLINK x}{\fldrslt shown}} {\header no}yes{\pict 00ff}", "shown yes"),
        (b"{\\rtf1 split\r\n lines\\\nnew {\\i open", "split lines\nnew open"),
        (rb"{\rtf1\mac \'8e}", "é"),
        (rb"{\rtf1 a}tail", "a"),
        (rb"{\rtf1 one\cell two\cell\row}", "one|two|"),
    ],
)
def test_rtf(raw, text):
    assert rtf_text(raw) == text


def test_rtf_round_trip_and_damage():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab \n{}\\é€日\U0001f600'u8\t-?") for _ in range(rng.randrange(0, 40))).strip(" \t\r\n")
        assert rtf_text(rtf_bytes(text)) == text
    with pytest.raises(ValueError):
        rtf_text(b"no")
    good = rtf_bytes("some é text " * 20)
    for cut in range(5, len(good)):
        rtf_text(good[:cut])


# ---- Word
def test_docx_structure():
    blocks = [("h", 1, "Head & <one>"), ("p", 0, "Para"), ("b", 0, "b1"), ("b", 1, "b2"), ("n", 0, "n1"), ("n", 1, "sub"), ("n", 0, "n2"), ("t", 0, "x|y|z"), ("t", 0, "1|2"), ("h", 3, "Deep"), ("n", 0, "n3")]
    want = "# Head & <one>\n\nPara\n\n- b1\n  - b2\n1. n1\n  1. sub\n2. n2\n\n| x | y | z |\n|---|---|---|\n| 1 | 2 |  |\n\n### Deep\n\n3. n3"
    assert docx_text(docx_bytes(blocks)) == want


def test_docx_inheritance_and_cells():
    styles = f"""<w:styles {WORD}>
      <w:style w:type="paragraph" w:styleId="T"><w:name w:val="Title"/></w:style><w:style w:type="paragraph" w:styleId="H"><w:name w:val="heading 2"/></w:style>
      <w:style w:type="paragraph" w:styleId="Ring1"><w:basedOn w:val="Ring2"/></w:style><w:style w:type="paragraph" w:styleId="Ring2"><w:basedOn w:val="Ring1"/></w:style>
      <w:style w:type="paragraph" w:styleId="Off"><w:basedOn w:val="H"/><w:pPr><w:outlineLvl w:val="9"/></w:pPr></w:style></w:styles>"""
    numbering = f"""<w:numbering {WORD}><w:abstractNum w:abstractNumId="1"><w:numStyleLink w:val="L"/></w:abstractNum><w:abstractNum w:abstractNumId="2"><w:styleLink w:val="L"/><w:lvl w:ilvl="0"><w:start w:val="4"/><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum>
      <w:num w:numId="5"><w:abstractNumId w:val="1"/></w:num><w:num w:numId="6"><w:abstractNumId w:val="1"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="9"/></w:lvlOverride></w:num></w:numbering>"""
    p = lambda text, about="": f"<w:p><w:pPr>{about}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    style, num = (lambda s: f'<w:pStyle w:val="{s}"/>'), lambda n: f'<w:numPr><w:ilvl w:val="0"/><w:numId w:val="{n}"/></w:numPr>'
    cell = lambda text, about="": f"<w:tc><w:tcPr>{about}</w:tcPr>{p(text)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('a|b', '<w:gridSpan w:val="2"/>')}{cell('c', '<w:vMerge w:val="restart"/>')}</w:tr><w:tr>{cell('1')}{cell('2')}{cell('hidden', '<w:vMerge/>')}</w:tr></w:tbl>"
    body = p("The title", style("T")) + p("Second", style("H")) + p("not one", style("Off")) + p("round", style("Ring1")) + p("four", num(5)) + p("five", num(5)) + p("nine", num(6)) + p("six", num(5)) + p("none", num(0))
    body += f"<w:sdt><w:sdtContent>{p('wrapped')}</w:sdtContent></w:sdt><w:p><w:ins><w:r><w:t>kept</w:t></w:r></w:ins><w:r><w:tab/><w:t>x</w:t><w:br/><w:t>y</w:t></w:r></w:p>{table}"
    text = docx_text(zipped({"word/document.xml": f"<w:document {WORD}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles, "word/numbering.xml": numbering}))
    assert text == "# The title\n\n## Second\n\nnot one\n\nround\n\n4. four\n5. five\n9. nine\n6. six\n\nnone\n\nwrapped\n\nkept\tx\ny\n\n| a\\|b |  | c |\n|---|---|---|\n| 1 | 2 |  |"


# ---- PowerPoint
def test_pptx_structure():
    assert pptx_text(pptx_bytes([("First", ["a", "b & c"]), ("Second", [])])) == "--- Slide 1 ---\n\n# First\n- a\n- b & c\n\n--- Slide 2 ---\n\n# Second"
    table = "<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>h</a:t></a:r></a:p></a:txBody></a:tc></a:tr><a:tr><a:tc><a:txBody><a:p><a:r><a:t>v</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    box = '<p:sp><p:nvSpPr><p:nvPr/></p:nvSpPr><p:txBody><a:p><a:r><a:t>plain</a:t></a:r></a:p><a:p><a:pPr lvl="1"><a:buChar char="x"/></a:pPr><a:r><a:t>deep</a:t></a:r></a:p></p:txBody></p:sp>'
    deck = {"ppt/presentation.xml": f'<p:presentation {DRAW}><p:sldIdLst><p:sldId r:id="a"/><p:sldId r:id="gone"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": relations(("a", "slide", "slides/s.xml")), "ppt/slides/s.xml": f"<p:sld {DRAW}><p:cSld><p:spTree>{box}{table}</p:spTree></p:cSld></p:sld>"}
    assert pptx_text(zipped(deck)) == "--- Slide 1 ---\n\nplain\n  - deep\n\n| h |\n|---|\n| v |"


@pytest.mark.parametrize("read", [docx_text, pptx_text, msg_text])
def test_damage_is_an_error(read):
    for data in (b"", b"PK\x03\x04 broken", zipped({"x": "<a/>"}), zipped({"word/document.xml": "<a", "ppt/presentation.xml": "<b"})):
        with pytest.raises(ValueError):
            read(data)


# ---- Outlook
def test_messages():
    for body in ("short", "é日" * 5000, ""):
        raw = msg_bytes("A subject é", "Ann", "ann@example.org", body)
        assert msg_text(raw) == f"Subject: A subject é\nFrom: Ann <ann@example.org>\nDate: 2024-01-17 21:20:00\n\n{body}"
    assert set(Compound(msg_bytes("s", "n", "m", "x" * 9000)).streams) >= {"__substg1.0_0037001F", "__properties_version1.0"}


def test_damaged_messages():
    raw = msg_bytes("s", "n", "m", "body " * 3000)
    for cut in range(0, len(raw), 311):
        for data in (raw[:cut], raw[:cut] + b"\xff\xfe\xff\xff" + raw[cut + 4 :]):
            try:
                msg_text(data)
            except ValueError:
                pass
    ring = bytearray(raw)
    struct.pack_into("<I", ring, 48, 0)  # the directory's chain leads elsewhere
    try:
        msg_text(bytes(ring))
    except ValueError:
        pass


# ---- registry and models
def test_registry_reads_files_once(spark, tmp_path):
    (tmp_path / "a.rtf").write_bytes(rtf_bytes("hello there"))
    (tmp_path / "b.docx").write_bytes(docx_bytes([("p", 0, "hi")]))
    (tmp_path / "c.xyz").write_bytes(b"?")
    (tmp_path / "d.own").write_bytes(b"?")
    (tmp_path / "e.txt").write_bytes(b"12 34 56")
    registry = readers.Registry()
    registry.by_ext = {}
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    found = registry.extract(files)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {r["path"].rsplit("/", 1)[1]: (r["status"], r["text"], r["error"]) for r in found.collect()}
    assert got["a.rtf"] == ("success", "hello there", None) and got["b.docx"][1] == "hi" and got["c.xyz"][2] == "unsupported type" and got["e.txt"][2] == "too few letters"
    registry.read["mkv"] = lambda content: "mine"
    assert registry.extract(files).count() == 5


def test_structured_call_asks_only_again_what_failed(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(prompts):
        calls.add(len(prompts))
        return prompts.map(lambda p: '{"ok": 1}' if not p.startswith("hard") or "valid JSON" in p else "no")

    rows = spark.createDataFrame([(i, "easy" if i % 10 else "hard") for i in range(200)], "id int, prompt string").repartition(3)
    got = readers.structured_call(rows, model, "prompt", records.robust_json).select("id", "prompt", "answer", F.to_json("parsed").alias("parsed")).collect()
    assert len(got) == 200 and {r["parsed"] for r in got} == {'{"ok":1}'} and calls.value == 220
    never = readers.structured_call(rows, lambda s: s.map(lambda p: "no"), "prompt", records.robust_json).collect()
    assert len(never) == 200 and all(r["parsed"] is None and r["answer"] == "no" for r in never)


def test_files_are_read_a_few_at_once(spark):
    import pyarrow as pa

    from docloom.sources import readers

    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(200)]})
    parts = list(readers.sliced(iter([batch, batch.slice(0, 0)])))
    assert max(len(x) for x in parts) == readers.FILES_AT_ONCE and [p for x in parts for p in x["path"].to_pylist()] == batch["path"].to_pylist() and len(parts[-1]) == 0


def test_docx_sections_reads_each_file_once(spark):
    from docloom.plans.queries import QUERIES

    plan = QUERIES["q_docx_sections"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Join" not in plan  # files are made, then read


def test_styles_are_looked_up_once(monkeypatch):
    from docloom.sources import ooxml

    asked, chain = [], ooxml.Styles.chain
    monkeypatch.setattr(ooxml.Styles, "chain", lambda self, style: asked.append(style) or chain(self, style))
    text = ooxml.docx_text(office_files.docx_of([f"line {k}" for k in range(800)]))
    assert text.startswith("# line 0\n\nline 1") and len(asked) <= 2 * 5  # for levels and for lists: three headings, bullets, no style


def test_registry_reads_stored_files(spark):
    from docloom.plans.queries import QUERIES

    assert not [f for f in QUERIES["q_registry"](spark, "/root/testdata/sf0.001").inputFiles() if "documents" in f]
